"""Queries of the commands and sinks over the star-schema tables, each with DuckDB SQL.

Everything goes through ``plans.pipelines`` and ``sources.sinks``; what a model would say
is made of row numbers. Times are seconds: whole ones, or cut to hundredths so that no
engine has halves to round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import _GAPS, _JUDGED, _MERGED, _PARSED, _ROUNDS, AFTER, BEFORE, DAY, GAP, KEYS, ORACLE_SQL, QUERIES, WIDTH, _events, _gaps, _golden, _judged, _labelled, _merged, _padded, _reply, _table, chunk_offsets, interval_chunk_slices, query
from tidemark.functions.text import clip_name
from tidemark.model import Settings, overlay
from tidemark.operators import cache, intervals, scoring, verdicts
from tidemark.plans import pipelines
from tidemark.sources import recordings, sinks

SECOND = 1_000_000


def _cut(c):
    """Hundredths of seconds of whole microseconds."""
    return F.floor(F.col(c) / 10000) / 100


def _whole(c):
    return F.floor(F.col(c) / SECOND).cast("double")


@query(f"""WITH {_MERGED}, isl2 AS (SELECT rec, strategy, island, min(s) AS s, max(e) AS e FROM isl GROUP BY 1, 2, 3)
SELECT i.rec, i.strategy, (m.s // 10000) / 100 AS start_seconds, (m.e // 10000) / 100 AS end_seconds, round((m.e // 10000) / 100 - (m.s // 10000) / 100, 2) AS duration_seconds,
  (i.t // 10000) / 100 AS time_seconds, round(i.value, 4) AS score
FROM isl i JOIN isl2 m ON i.rec = m.rec AND i.strategy = m.strategy AND i.island = m.island""")
def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(_cut("t").alias("time_seconds"), "event_id", F.col("value").alias("score")))).alias("peaks")
    nested = intervals.merge_intervals(_padded(spark, sf_dir), KEYS, GAP, 0, ["t", "event_id"], [listed])
    stored = sinks.events_json(nested.withColumns({"start": _cut("start"), "end": _cut("end")}), keys=tuple(KEYS))
    return stored.select(*KEYS, "start_seconds", "end_seconds", "duration_seconds", F.explode("peaks").alias("p")).select("*", "p.time_seconds", "p.score").drop("p")


_HOURS = {"lookback_seconds": BEFORE / SECOND, "post_peak_seconds": AFTER / SECOND, "min_gap_seconds": GAP / SECOND, "min_interval_seconds": 3600.0}
_LOOKED = f"""{_PARSED}, w AS (SELECT *, CAST(t // {SECOND} AS DOUBLE) AS ts FROM v),
found AS (SELECT rec, greatest(0.0, ts - {BEFORE // SECOND}) AS s, ts + {AFTER // SECOND} AS e, CASE WHEN ok THEN confidence END AS confidence, coalesce(CASE WHEN ok THEN is_event OR confidence < 0.75 END, TRUE) AS kept FROM w WHERE strategy = 'click'),
looked AS (SELECT rec, ts AS s, ts + 12 AS e, CASE WHEN ok THEN confidence END AS confidence, coalesce(ok AND is_event AND confidence >= 0.75 AND frame BETWEEN 0 AND 4, FALSE) AS kept, ts + 12.0::DOUBLE / 5 * (frame + 0.5::DOUBLE) AS hit FROM w WHERE strategy = 'view')"""


def _refined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = _events(spark, sf_dir).withColumn("t", _whole("t")).withColumn("reply", _reply())
    found = intervals.pad_peaks(ev.where("strategy = 'click'"), "t", BEFORE / SECOND, AFTER / SECOND)
    gaps = ev.where("strategy = 'view'").withColumns({"start": F.col("t"), "end": F.col("t") + 12})
    say = lambda scan: lambda rows: rows.withColumn("verdict", verdicts.parse_verdict(F.col("reply"), scan))
    return pipelines.refine(found, gaps, say(False), say(True), ["rec"], overlay(Settings(), {"timeline": _HOURS}))


@query(f"""WITH {_LOOKED}, x AS (SELECT rec, s, e FROM found WHERE kept UNION ALL SELECT rec, greatest(0, hit - {BEFORE // SECOND}), hit + {AFTER // SECOND} FROM looked WHERE kept),
fl AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP // SECOND} THEN 0 ELSE 1 END AS nw FROM x),
i AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM fl)
SELECT rec, round(min(s), 3) AS "start", round(max(e), 3) AS "end" FROM i GROUP BY rec, k HAVING max(e) - min(s) >= 3600""")
def refine_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir)[0].select("rec", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {_LOOKED} SELECT 'confirm' AS kind, s AS start_seconds, e AS end_seconds, CAST(confidence AS DOUBLE) AS confidence, kept FROM found
UNION ALL SELECT 'scan', s, e, CAST(confidence AS DOUBLE), kept FROM looked""")
def vision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir)[1].select("kind", "start_seconds", "end_seconds", "verdict.confidence", "kept")


@query(f"""WITH c AS ({ORACLE_SQL["golden_build"]})
SELECT rec, "cluster", floor("at" / 10000) / 100 AS time_seconds, CAST(len(string_split(sources, ',')) AS INTEGER) AS n_sources FROM c""")
def golden_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.golden import build_golden

    built = build_golden(_events(spark, sf_dir).where("strategy = 'purchase'"), ["rec"], "t", "event_id", 12 * 3600 * SECOND)
    out = sinks.golden_json(built.withColumn("at", F.floor(F.round("at", 3) / 10000) / 100), ("rec", "cluster"))
    return out.select("rec", "cluster", "time_seconds", F.size("sources").alias("n_sources"))


_TWO = "coalesce(printf('%.2f', {c}), 'n/a')"


@query(f"""WITH sc AS ({ORACLE_SQL["score_strategies"]}), h AS (SELECT 'strategy        labeled/total   TP    FP    precision   recall      F1      ' AS h)
SELECT CAST(0 AS INTEGER) AS no, 'Ground truth events (union of all TP + FN-flagged negatives): ' || CAST(max(truths) AS VARCHAR) AS line FROM sc
UNION ALL SELECT 1, '' UNION ALL SELECT 2, h FROM h UNION ALL SELECT 3, repeat('-', length(h)) FROM h
UNION ALL SELECT CAST(row_number() OVER (ORDER BY strategy) + 3 AS INTEGER), rpad(strategy, 16, ' ') || rpad(labeled || '/' || total, 16, ' ') || rpad(CAST(tp AS VARCHAR), 6, ' ') || rpad(CAST(fp AS VARCHAR), 6, ' ')
  || rpad({_TWO.format(c='"precision"')}, 12, ' ') || rpad({_TWO.format(c="recall")}, 12, ' ') || rpad({_TWO.format(c="f1")}, 8, ' ') FROM sc""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.score_lines(QUERIES["score_strategies"](spark, sf_dir)).select(F.col("no").cast("int").alias("no"), "line")


@query(f"""WITH {_ROUNDS}, g AS (SELECT rec, t FROM ev WHERE strategy = 'purchase' AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.rec = ev.rec AND ev.t BETWEEN l.s AND l.e)),
rows AS (SELECT rec, strategy, CAST(s // {SECOND} AS DOUBLE) AS s, CAST(e // {SECOND} AS DOUBLE) AS e, CASE WHEN idx % 5 = 0 THEN 'FN' WHEN idx % 7 = 0 THEN '' ELSE verdict END AS verdict FROM lab),
tp AS (SELECT rec, s, e FROM rows WHERE verdict = 'TP' UNION ALL SELECT rec, CAST(t // {SECOND} AS DOUBLE), CAST(t // {SECOND} AS DOUBLE) + 60 FROM g),
tfl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM tp),
tis AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS u FROM tfl),
truth AS (SELECT rec, u, min(s) AS s, max(e) AS e FROM tis GROUP BY rec, u),
cov AS (SELECT l.strategy, count(DISTINCT (t.rec, t.u)) AS covered FROM truth t JOIN rows l ON l.rec = t.rec AND l.verdict = 'TP' AND t.s < l.e AND t.e > l.s GROUP BY 1)
SELECT r.strategy, count(*) AS total, count(*) FILTER (WHERE verdict IN ('TP', 'FP')) AS labeled, count(*) FILTER (WHERE verdict = 'TP') AS tp, count(*) FILTER (WHERE verdict = 'FP') AS fp,
  any_value(covered) AS covered, (SELECT count(*) FROM truth) AS truths FROM rows r LEFT JOIN cov ON r.strategy = cov.strategy GROUP BY 1""")
def score_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score command: rows of any verdict count, some without one, and missed ones come as negatives."""
    lab = _labelled(spark, sf_dir)
    said = F.when(F.col("idx") % 5 == 0, "fn").when(F.col("idx") % 7 == 0, F.lit(None).cast("string")).otherwise(F.lower("verdict"))
    sheet = lab.select("rec", "strategy", _whole("start").alias("start_seconds"), _whole("end").alias("end_seconds"), said.alias("verdict"))
    from tidemark.operators.ranges import points_in_intervals

    missed = points_in_intervals(_golden(spark, sf_dir), lab.select("rec", "start", "end"), ["rec"], "at", "start", "end", WIDTH, "left_anti")
    missed = missed.select("rec", F.lit("negatives").alias("strategy"), _whole("at").alias("start_seconds"), (_whole("at") + 60).alias("end_seconds"), F.lit(" FN ").alias("verdict"))
    out, _ = pipelines.score(sheet.unionByName(missed), ["rec"])
    return out.select("strategy", "total", "labeled", "tp", "fp", "covered", "truths")


@query(f"""WITH p AS ({ORACLE_SQL["threshold_sweep"]}), q AS (SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1, (SELECT count(*) FROM events WHERE event_type = 'purchase') - found AS fn FROM p)
SELECT CAST(0 AS INTEGER) AS no, ' threshold      kept  precision   recall      f1   FN' AS line
UNION ALL SELECT CAST(row_number() OVER (ORDER BY threshold DESC) AS INTEGER), lpad(printf('%.2f', threshold), 10, ' ') || '  ' || lpad(CAST(kept AS VARCHAR), CAST(greatest(4, length(CAST(kept AS VARCHAR))) AS INTEGER), ' ') || '/' || rpad(CAST(total AS VARCHAR), CAST(greatest(3, length(CAST(total AS VARCHAR))) AS INTEGER), ' ')
  || '  ' || lpad(printf('%.3f', "precision"), 9, ' ') || '  ' || lpad(printf('%.3f', recall), 7, ' ') || '  ' || lpad(printf('%.3f', f1), 6, ' ') || '  ' || lpad(CAST(fn AS VARCHAR), CAST(greatest(3, length(CAST(fn AS VARCHAR))) AS INTEGER), ' ') FROM q""")
def sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = QUERIES["threshold_sweep"](spark, sf_dir)
    total = _golden(spark, sf_dir).agg(F.count(F.lit(1)).alias("golden"))
    points = points.join(F.broadcast(total)).withColumns({"fn": F.col("golden") - F.col("found"), "f1": scoring.f1(F.col("precision"), F.col("recall"))})  # one row
    return sinks.sweep_lines(points).select(F.col("no").cast("int").alias("no"), "line")


@query(f"""WITH {_MERGED}, c AS (SELECT m.rec, CAST(s // {SECOND} AS DOUBLE) AS s, CAST(e // {SECOND} AS DOUBLE) AS e FROM merged m WHERE strategy = 'error'),
g AS (SELECT rec, CAST(t // {SECOND} AS DOUBLE) AS t, row_number() OVER () AS id FROM ev WHERE strategy = 'purchase'),
a AS (SELECT count(*) AS clips, sum(e - s) AS total, max(e - s) AS longest, avg(e - s) AS mean, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM g WHERE g.rec = c.rec AND g.t BETWEEN c.s AND c.e)) AS tp FROM c),
f AS (SELECT count(DISTINCT id) AS found FROM g JOIN c ON g.rec = c.rec AND g.t BETWEEN c.s AND c.e)
SELECT 'audio' AS pass, 'clips=' || clips || '  TP=' || tp || '  FP=' || (clips - tp) || '  FN=' || ((SELECT count(*) FROM g) - found) AS first,
  'mean_clip_duration=' || printf('%.1f', mean) || 's  max_clip_duration=' || printf('%.1f', longest) || 's  total_duration=' || printf('%.1f', total) || 's (' || printf('%.1f', 100 * total / 1e8) || '% of game)' AS third FROM a, f""")
def golden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _merged(spark, sf_dir).where("strategy = 'error'").select("rec", _whole("start").alias("start"), _whole("end").alias("end"))
    gold = _golden(spark, sf_dir).select("rec", _whole("at").alias("at"))
    out = pipelines.golden_report(found, gold, ["rec"], 1e8)
    return out.select("pass", F.col("lines")[0].alias("first"), F.col("lines")[2].alias("third"))


_SLICED = ORACLE_SQL["interval_chunk_slices"]


@query(f"""WITH x AS ({_SLICED})
SELECT rec, strategy, idx, printf('clip_%03d.mp4', idx) AS clip_file, day AS sequence, 'chunk_' || CAST(day AS VARCHAR) AS source, local_start, local_end - local_start AS duration, 1280 AS width, 23 AS crf FROM x""")
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = interval_chunk_slices(spark, sf_dir).withColumn("sequence", F.col("day"))
    review = Settings().review
    out = sinks.encode_manifest(sinks.clip_manifest(slices, KEYS, F.concat(F.lit("chunk_"), F.col("day").cast("string"))), review.max_width, review.fps, review.crf, review.preset)
    flat = out.select(*KEYS, "idx", "clip_file", "encode", F.explode("parts").alias("p"))
    return flat.select(*KEYS, "idx", "clip_file", "p.sequence", "p.source", "p.local_start", "p.duration", "encode.width", "encode.crf")


@query(f"""WITH x AS ({ORACLE_SQL["chunk_offsets"]})
SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY day) - 1 AS INTEGER) AS part, 'chunk_' || CAST(day AS VARCHAR) AS source, CAST(sum(duration) OVER (PARTITION BY rec) AS BIGINT) AS total FROM x""")
def skim_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = chunk_offsets(spark, sf_dir).withColumn("sequence", F.col("day"))
    listed = sinks.skim_manifest(days, ["rec"], F.concat(F.lit("chunk_"), F.col("day").cast("string")))
    total = days.groupBy("rec").agg(F.sum("duration").alias("total"))
    return listed.select("rec", F.posexplode("parts").alias("part", "p")).join(total, "rec").select("rec", "part", "p.source", "total")


@query(f"""WITH {_MERGED}, x AS ({_SLICED}), tr AS (SELECT rec, t // {DAY} AS day, event_id, t % {DAY} AS local FROM ev)
SELECT tr.rec, CAST(tr.day AS BIGINT) AS day, event_id, EXISTS (SELECT 1 FROM x WHERE x.strategy = 'error' AND x.rec = tr.rec AND x.day = tr.day AND tr.local BETWEEN x.local_start AND x.local_end) AS shaded FROM tr""")
def plot_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = _events(spark, sf_dir).select("rec", F.floor(F.col("t") / DAY).alias("day"), "event_id", (F.col("t") % DAY).alias("local"))
    own = interval_chunk_slices(spark, sf_dir).where("strategy = 'error'")
    return sinks.plot_frame(trace, own, ["rec", "day"], "local", WIDTH).select("rec", "day", "event_id", "shaded")


@query(f"""WITH {_MERGED}, v AS (SELECT rec, idx, s // {SECOND} AS s, idx % 11 <> 0 AND (idx % 121) / 100.0 <= 1 AS ok, idx % 3 = 0 AS is_event, (idx % 121) / 100.0 AS confidence FROM merged WHERE strategy = 'error'),
k AS (SELECT *, coalesce(CASE WHEN ok THEN is_event OR confidence < 0.75 END, TRUE) AS kept FROM v)
SELECT rec, idx, kept, CASE WHEN kept THEN '' ELSE 'pruned/' END || CAST(s AS VARCHAR) || ' - ' || CASE WHEN ok THEN 'c' ELSE 'highlight' END || '.mp4' AS path FROM k""")
def vision_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _merged(spark, sf_dir).where("strategy = 'error'").select("rec", "idx", _whole("start").alias("start"), _whole("end").alias("end"))
    out, _ = pipelines.vision_highlights(found, lambda rows: rows.withColumn("verdict", verdicts.parse_verdict(_reply("idx"))), Settings())
    return out.select("rec", "idx", "kept", "path")


@query(f"""WITH {_JUDGED}, r AS (SELECT *, row_number() OVER (ORDER BY coalesce(distance, 1.0) DESC, doc_id) AS rank FROM k)
SELECT doc_id, printf('%03d - dist%.2f - %s - %s_%s.mp4', rank, coalesce(distance, 1.0), coalesce(agreement, 'no_verdict'), 'loose', printf('clip_%03d', doc_id)) AS copy_as FROM r WHERE rank <= 50""")
def flagged_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 that are furthest off, by rank: a top-k report."""
    from pyspark.sql import Window

    top = verdicts.by_disagreement(_judged(spark, sf_dir), "distance", "doc_id").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce("distance", F.lit(1.0)).desc(), "doc_id")))
    rows = ranked.select("doc_id", "rank", F.struct(F.col("distance").alias("distance_score"), "agreement").alias("judge"), F.lit("loose").alias("strategy"), clip_name(F.col("doc_id")).alias("clip_file"))
    return sinks.flagged_copies(rows).select("doc_id", "copy_as")


@query(f"""WITH {_JUDGED} SELECT doc_id, printf('clip_%03d.mp4', doc_id) AS clip_file, printf('%.2f', doc_id / 4.0) AS start_seconds, CASE WHEN doc_id % 3 = 0 THEN 'TP' ELSE 'FP' END AS verdict,
  CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN CAST(doc_id % 7 AS VARCHAR) ELSE '' END AS ai_score, coalesce(agreement, '') AS agreement, coalesce(printf('%.2f', distance), '') AS distance_score, '' AS corrected_verdict FROM k""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit('{"score": '), (F.col("doc_id") % 7).cast("string"), F.lit(', "caption": "a", "description": "b"}'))
    rows = _judged(spark, sf_dir).select(
        "doc_id", F.lit("loose").alias("strategy"), clip_name(F.col("doc_id")).alias("clip_file"), (F.col("doc_id") / 4).alias("start"), (F.col("doc_id") / 4 + 1).alias("end"),
        F.when(F.col("doc_id") % 3 == 0, "TP").otherwise("FP").alias("verdict"), F.lit(None).cast("string").alias("notes"), verdicts.parse_describe(reply).alias("describe"),
        F.when(F.col("agreement").isNotNull(), F.struct("agreement", F.col("distance").alias("distance_score"), F.lit("r").alias("rationale"))).alias("judge"),
    )
    report = sinks.audit_report(rows)
    number = F.regexp_extract("clip_file", "([0-9]+)", 1).cast("long")
    return report.select(number.alias("doc_id"), "clip_file", "start_seconds", "verdict", "ai_score", "agreement", "distance_score", "corrected_verdict")


@query(f"""WITH {_MERGED}, c AS (SELECT CAST(rec AS VARCHAR) AS recording_id, rec * 100000 + idx AS idx, (s // 10000) / 100 AS s, max_value FROM merged WHERE strategy = 'error')
SELECT recording_id, printf('clip_%03d.mp4', idx) AS clip_file, s AS start_seconds, round(max_value, 4) AS max_peak_score, CASE WHEN idx % 7 BETWEEN 1 AND 5 THEN CAST(idx % 7 AS VARCHAR) ELSE '' END AS ai_score,
  CASE WHEN idx % 7 BETWEEN 1 AND 5 THEN CASE WHEN idx % 4 = 0 THEN 'kept' ELSE 'asked' END ELSE '' END AS ai_caption, '' AS verdict FROM c""")
def pre_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with descriptions, of which a quarter is in the cache already."""
    own = _merged(spark, sf_dir).where("strategy = 'error'").select(F.col("rec").cast("string").alias("recording_id"), (F.col("rec") * 100000 + F.col("idx")).alias("idx"), _cut("start").alias("start"), _cut("end").alias("end"), "max_value")

    def describe(caption: str):
        reply = F.concat(F.lit('{"score": '), (F.col("idx") % 7).cast("string"), F.lit(f', "caption": "{caption}", "description": "d"}}'))
        return lambda rows: rows.withColumn("describe", verdicts.parse_describe(reply))

    named = own.select("idx", F.lit("candidates").alias("strategy"), clip_name(F.col("idx")).alias("clip_file"))
    cached = describe("kept")(named.where("idx % 4 = 0"))
    days = chunk_offsets(spark, sf_dir).select(F.col("rec").cast("string").alias("recording_id"), F.col("day").cast("int").alias("sequence"), F.lit("s").alias("source_path"), F.lit(None).cast("string").alias("proxy_path"), (F.col("global_start") / SECOND).alias("global_start_seconds"), (F.col("duration") / SECOND).alias("duration_seconds"))
    own = own.withColumn("peaks", F.array().cast("array<struct<time_seconds: double, score: double>>"))
    sheet = pipelines.pre_label(own, days, cached, describe("asked"), Settings())["sheet"]
    return sheet.select("recording_id", "clip_file", "start_seconds", "max_peak_score", "ai_score", "ai_caption", "verdict")


@query("""WITH s AS (SELECT 'clip_' || CAST(event_id % 700 AS VARCHAR) AS clip_file, max(event_id) AS idx FROM events GROUP BY 1)
SELECT clip_file, idx FROM s WHERE idx % 700 % 5 = 0 AND idx % 700 % 10 <> 0""")
def export_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each wanted clip, without those that are written already."""
    name = lambda c: F.concat(F.lit("clip_"), c.cast("string")).alias("clip_file")
    sheet = _table(spark, sf_dir, "events").select(name(F.col("event_id") % 700), F.col("event_id").alias("idx"))
    numbers = _table(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("n")).distinct()
    return pipelines.export_picks(sheet, numbers.where("n % 5 = 0").select(name(F.col("n"))), numbers.where("n % 10 = 0").select(name(F.col("n")))).select("clip_file", "idx")


@query("""SELECT 'clip_' || CAST(event_id AS VARCHAR) AS clip_file, CASE WHEN CAST(event_id AS BIGINT) * 20000 > 52428800 THEN 'too large' ELSE 'send' END AS action FROM events WHERE event_id % 3 <> 0""")
def post_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("clip_"), F.col("event_id").cast("string")).alias("clip_file"), (F.col("event_id").cast("long") * 20000).alias("size"), "event_id")
    return pipelines.post_picks(rows, rows.where("event_id % 3 = 0").select("clip_file"), Settings()).select("clip_file", "action")


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 9000 + 1 AS seq, '/r/' || CAST(o_custkey AS VARCHAR) AS dir, strftime(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey % 40000), '%Y%m%d%H%M%S') AS ts FROM orders WHERE o_orderkey % 5 <> 0)
SELECT dir AS recording_id, CAST(seq AS INTEGER) AS sequence, strftime(strptime(ts, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS start_time,
  CASE WHEN k % 4 = 0 THEN '/cache/DJI_' || ts || '_' || seq || '_D.LRF' WHEN k % 2 = 0 THEN dir || '/DJI_' || ts || '_' || seq || '_D.LRF' ELSE dir || '/DJI_' || ts || '_' || seq || '_D.MP4' END AS source FROM f""")
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names to chunks, proxies of the same name, and those that a local cache has."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    ts = F.date_format(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, k % 40000)"), "yyyyMMddHHmmss")
    stem = F.concat(F.lit("DJI_"), ts, F.lit("_"), (F.col("k") % 9000 + 1).cast("string"), F.lit("_D"))
    stem = F.when(F.col("k") % 5 == 0, F.concat(F.lit("other"), F.col("k").cast("string"))).otherwise(stem)
    files = o.select("k", F.concat(F.lit("/r/"), F.col("o_custkey").cast("string"), F.lit("/")).alias("dir"), stem.alias("stem"))
    path = lambda d, kind: F.concat(d, F.col("stem"), F.lit(f".{kind}")).alias("path")
    listed = files.select(path(F.col("dir"), "MP4")).unionByName(files.where("k % 2 = 0").select(path(F.col("dir"), "lrf"))).withColumn("path", F.regexp_replace("path", r"\.lrf$", ".LRF"))
    found = recordings.chunks_of(listed)
    found = recordings.redirect_proxies(found, files.where("k % 4 = 0").select(path(F.lit("/cache/"), "LRF")))
    return found.select("recording_id", "sequence", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), recordings.source_of(True).alias("source"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 1 THEN 'new' ELSE 'old' END AS result FROM events WHERE event_id % 4 <> 0 OR event_id % 6 = 1""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id")
    old = rows.where("event_id % 4 != 0").withColumn("result", F.lit("old"))
    return cache.upsert(old, rows.where("event_id % 6 = 1").withColumn("result", F.lit("new")), ["event_id"])


@query(f"""WITH {_ROUNDS}, pk AS (
  SELECT i.rec, i.strategy, m.idx, i.t, row_number() OVER (PARTITION BY i.rec, i.strategy, m.idx ORDER BY i.value DESC, i.t, i.event_id) AS r
  FROM isl i JOIN lab m ON i.rec = m.rec AND i.strategy = m.strategy AND i.s >= m.s AND i.e <= m.e WHERE m.verdict = 'TP'),
x AS (SELECT rec, strategy || '/' || printf('clip_%03d.mp4', idx) AS source, CAST(t // {SECOND} AS DOUBLE) AS at FROM pk WHERE r = 1),
g AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s) AS idx, s FROM ({"WITH " + _GAPS + " SELECT rec, s FROM gaps"})),
y AS (SELECT * FROM x UNION ALL SELECT rec, 'negatives/' || printf('clip_%03d.mp4', idx), CAST(s // {SECOND} AS DOUBLE) + idx % 50 + 0.5 FROM g WHERE idx % 2 = 0),
f AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY rec ORDER BY "at", source) <= 43200 THEN 0 ELSE 1 END AS nw FROM y),
c AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY "at", source) AS k FROM f)
SELECT rec, CAST(k AS BIGINT) AS "cluster", round(avg("at"), 3) AS at, string_agg(source, ',' ORDER BY "at", source) AS sources FROM c GROUP BY rec, k""")
def golden_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest peaks of clips judged TP, and what notes on negatives say was missed, as reference events."""
    from pyspark.sql import Window

    listed = F.array_sort(F.collect_list(F.struct("t", "event_id", F.col("value").alias("score")))).alias("peaks")
    nested = intervals.merge_intervals(_padded(spark, sf_dir), KEYS, GAP, 0, ["t", "event_id"], [listed])
    peaks = F.transform("peaks", lambda p: F.struct(F.floor(p["t"] / SECOND).cast("double").alias("time_seconds"), p["score"].alias("score")))
    sheet = ["rec", "strategy", "idx", clip_name(F.col("idx")).alias("clip_file"), _whole("start").alias("start_seconds"), _whole("end").alias("end_seconds")]
    tp = _labelled(spark, sf_dir).select(*sheet, "verdict", F.lit("").alias("notes"))
    gaps = _gaps(spark, sf_dir).withColumns({"strategy": F.lit("negatives"), "idx": F.row_number().over(Window.partitionBy("rec").orderBy("start")).cast("long")})
    note = F.concat(F.lit("missed at "), (F.col("idx") % 50).cast("string"), F.lit(".5 sec"))
    fn = gaps.select(*sheet, F.when(F.col("idx") % 2 == 0, "FN").otherwise("TN").alias("verdict"), note.alias("notes"))
    out = pipelines.golden_from_sheets(tp.unionByName(fn), nested.select(*KEYS, "idx", peaks.alias("peaks")), ["rec"], 43200.0)
    return out.select("rec", "cluster", F.round("at", 3).alias("at"), F.array_join("sources", ",").alias("sources"))


from tidemark import catalog_signals  # noqa: E402, F401  registers the queries of whole commands
