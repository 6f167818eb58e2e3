"""Queries of whole commands, and of timelines that are cut into ranges, with DuckDB SQL.

Samples are the vectors of ``embeddings``: a label is a recording, a vector a block of 64
samples, which last a second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import _CONF, _EV, _JUDGED, _MERGED, AFTER, BEFORE, DAY, GAP, HOUR, WIDTH, _events, _golden, _merged, _table, interval_chunk_slices, query
from tidemark.model import Settings, overlay
from tidemark.operators import intervals, peaks, scan, segments, signal, verdicts
from tidemark.plans import pipelines
from tidemark.sources import sinks

RATE, WINDOW, HOP, SIZE = 64, 32, 16, 25
_TIMES = {"lookback_seconds": 1.0, "post_peak_seconds": 1.0, "min_gap_seconds": 0.5, "min_interval_seconds": 0.5, "warmup_seconds": 2.0}
_REVIEW = {"max_negative_clip_seconds": 4.0, "min_negative_clip_seconds": 1.0}


def _settings(sigma: float, least: float) -> Settings:
    rms = {"window_seconds": WINDOW / RATE, "hop_seconds": HOP / RATE, "baseline_window_seconds": SIZE * HOP / RATE, "threshold_sigma": sigma, "min_score_dbfs": least}
    return overlay(Settings(), {"audio": {"sample_rate": RATE}, "detection": {"strategy": "rms_energy", "rms_energy": rms}, "timeline": _TIMES, "review": _REVIEW})


def _recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rec = F.col("label").cast("string").alias("recording_id")
    place = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    samples = _table(spark, sf_dir, "embeddings").select(rec, F.lit(1).alias("sequence"), place.alias("block_idx"), F.col("embedding").alias("block"))
    chunks = _table(spark, sf_dir, "embeddings").groupBy(rec).agg(F.count(F.lit(1)).cast("double").alias("duration_seconds"))
    return samples, chunks.withColumns({"sequence": F.lit(1), "global_start_seconds": F.lit(0.0)})


_HALF = SIZE // 2
_FRAMES = f"""smp AS (
  SELECT rec, 64 * (row_number() OVER (PARTITION BY rec, i ORDER BY vec_id) - 1) + i AS pos, x
  FROM (SELECT CAST(label AS VARCHAR) AS rec, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS i FROM embeddings)),
total AS (SELECT rec, count(*) AS n FROM smp GROUP BY rec),
fr AS (SELECT s.rec, pos // {HOP} - d AS k, x FROM smp s, range(0, {WINDOW // HOP}) r(d)),
vals AS (
  SELECT f.rec, f.k, 20 * log10(sqrt(sum(x * x) / {WINDOW}.0 + {signal.EPS}) + {signal.EPS}) AS v FROM fr f JOIN total t ON f.rec = t.rec
  WHERE f.k >= 0 AND f.k * {HOP} + {WINDOW} <= t.n GROUP BY f.rec, f.k),
cnt AS (SELECT rec, max(k) AS last FROM vals GROUP BY rec),
p1 AS (
  SELECT rec, k, v, FALSE AS pad FROM vals UNION ALL SELECT rec, -j, v, TRUE FROM vals, range(1, {_HALF + 1}) r(j) WHERE k = 0
  UNION ALL SELECT v.rec, v.k + j, v.v, TRUE FROM vals v JOIN cnt c ON v.rec = c.rec AND v.k = c.last, range(1, {_HALF + 1}) r(j)),
b AS (SELECT *, median(v) OVER (PARTITION BY rec ORDER BY k ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS base FROM p1),
r AS (SELECT rec, k, v, base, abs(v - base) AS res FROM b WHERE NOT pad),
p2 AS (
  SELECT rec, k, res, FALSE AS pad FROM r UNION ALL SELECT rec, -j, res, TRUE FROM r, range(1, {_HALF + 1}) x(j) WHERE k = 0
  UNION ALL SELECT v.rec, v.k + j, v.res, TRUE FROM r v JOIN cnt c ON v.rec = c.rec AND v.k = c.last, range(1, {_HALF + 1}) x(j)),
m AS (SELECT *, median(res) OVER (PARTITION BY rec ORDER BY k ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS mad FROM p2),
trace AS (SELECT r.rec, r.k, r.v, r.base, m.mad FROM r JOIN m ON r.rec = m.rec AND r.k = m.k AND NOT m.pad)"""
_FOUND = f"""{_FRAMES}, pr AS (SELECT * FROM (VALUES {{presets}}) p(strategy, sigma, least)),
mk AS (SELECT t.rec, p.strategy, k, v, v - (base + p.sigma * mad * {signal.MAD_SCALE}) AS score, v - (base + p.sigma * mad * {signal.MAD_SCALE}) >= p.least AND v > -40 AS m FROM trace t, pr p),
nw AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER (PARTITION BY rec, strategy ORDER BY k), FALSE) THEN 1 ELSE 0 END AS nw FROM mk),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY rec, strategy ORDER BY k) AS run FROM nw),
apex AS (SELECT *, row_number() OVER (PARTITION BY rec, strategy, run ORDER BY v DESC, k) AS rk FROM rn WHERE m),
pk AS (SELECT rec, strategy, score, k * {HOP / RATE} AS t, greatest(0.0, k * {HOP / RATE} - 1.0) AS s, k * {HOP / RATE} + 1.0 AS e FROM apex WHERE rk = 1 AND k * {HOP / RATE} >= 2.0),
fl AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY rec, strategy ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.5 THEN 0 ELSE 1 END AS f FROM pk),
il AS (SELECT *, sum(f) OVER (PARTITION BY rec, strategy ORDER BY s, t) AS island FROM fl),
found AS (SELECT rec, strategy, min(s) AS s, max(e) AS e, count(*) AS n_peaks, max(score) AS best FROM il GROUP BY rec, strategy, island HAVING max(e) - min(s) >= 0.5)"""


@query(f"""WITH {_FOUND.format(presets="('one', 1.0, 0.2)")}
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s) AS idx, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end", CAST(n_peaks AS INTEGER) AS n_peaks, round(best, 6) AS max_score FROM found""")
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to merged intervals: frames, rolling threshold, runs, warm-up, pads."""
    out = pipelines.detect(*_recordings(spark, sf_dir), _settings(1.0, 0.2))
    return out.select(F.col("recording_id").alias("rec"), "idx", "start", "end", F.size("peaks").alias("n_peaks"), F.round("max_value", 6).alias("max_score"))


@query(f"""WITH {_FOUND.format(presets="('loose', 0.5, 0.5), ('strict', 1.5, 0.8)")},
ufl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM found),
uil AS (SELECT *, sum(f) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS u FROM ufl),
un AS (SELECT rec, min(s) AS s, max(e) AS e FROM uil GROUP BY rec, u),
cur AS (SELECT rec, s, coalesce(max(e) OVER (PARTITION BY rec ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c FROM un),
gaps AS (
  SELECT rec, c AS s, s AS e FROM cur WHERE s > c
  UNION ALL SELECT t.rec, coalesce(x.e, 0.0), t.n / 64.0 FROM total t LEFT JOIN (SELECT rec, max(e) AS e FROM un GROUP BY rec) x ON t.rec = x.rec WHERE coalesce(x.e, 0.0) < t.n / 64.0),
g AS (SELECT rec, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, greatest(1, CAST(ceil((e - s) / 4.0) AS BIGINT)) AS n FROM gaps WHERE e - s >= 1.0),
pc AS (SELECT *, unnest(range(0, n)) AS i FROM g)
SELECT rec, strategy, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end" FROM found
UNION ALL SELECT rec, 'negatives', round(s + i * (e - s) / n, 6), round(CASE WHEN i = n - 1 THEN e ELSE s + (i + 1) * (e - s) / n END, 6) FROM pc""")
def batch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of two settings from one trace, and the pieces of what neither covers."""
    found, rest = pipelines.batch_review(*_recordings(spark, sf_dir), _settings(1.0, 0.2), named={"loose": _settings(0.5, 0.5), "strict": _settings(1.5, 0.8)})
    both = found.select("recording_id", "strategy", "start", "end").unionByName(rest.select("recording_id", F.lit("negatives").alias("strategy"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end")))
    return both.withColumnRenamed("recording_id", "rec")


_UP, _DOWN = 3, 4
_TAPS = ", ".join(f"({i}, {float(h)!r})" for i, h in enumerate(segments.low_pass(_UP, _DOWN)))


@query(f"""WITH smp AS (
  SELECT rec, 64 * (row_number() OVER (PARTITION BY rec, i ORDER BY vec_id) - 1) + i AS k, x
  FROM (SELECT CAST(label AS VARCHAR) AS rec, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS i FROM embeddings)),
taps AS (SELECT * FROM (VALUES {_TAPS}) t(i, h)),
y AS (SELECT rec, (k * {_UP} + i - {24 * _DOWN}) // {_DOWN} AS m, sum(x * h) AS y FROM smp, taps WHERE (k * {_UP} + i - {24 * _DOWN}) % {_DOWN} = 0 GROUP BY 1, 2)
SELECT y.rec, count(*) AS n, round(sum(abs(y)), 2) AS total FROM y JOIN (SELECT rec, max(k) AS last FROM smp GROUP BY rec) e ON y.rec = e.rec AND m >= 0 AND m * {_DOWN} <= last * {_UP} + {_UP - 1} GROUP BY y.rec""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings at three quarters of their rate, over the borders of blocks."""
    out = segments.resample(_recordings(spark, sf_dir)[0], ["recording_id"], RATE, RATE * _UP // _DOWN, RATE, 4)
    each = out.select(F.col("recording_id").alias("rec"), F.explode("block").alias("y"))
    return each.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.col("y").cast("double"))), 2).alias("total"))


@query(f"""WITH {_MERGED}, v AS (SELECT rec, s, e, ((s // 1000000) % 3 = 0) AS is_event, {_CONF.replace("m.", "")} AS confidence FROM merged WHERE strategy = 'error'),
th AS (SELECT unnest([1.01, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50])::DOUBLE AS threshold),
k AS (SELECT t.threshold, v.*, (v.is_event OR v.confidence < t.threshold) AS kept FROM v, th t),
g AS (SELECT rec, t, row_number() OVER () AS id FROM ev WHERE strategy = 'purchase'),
a AS (SELECT threshold, count(*) AS total, count(*) FILTER (WHERE kept) AS kept FROM k GROUP BY 1),
f AS (SELECT threshold, count(DISTINCT g.id) AS found FROM k JOIN g ON k.kept AND g.rec = k.rec AND g.t BETWEEN k.s AND k.e GROUP BY 1)
SELECT a.threshold, a.total, a.kept, f.found, n.asked FROM a LEFT JOIN f ON a.threshold = f.threshold, (SELECT count(*) AS asked FROM merged WHERE strategy = 'error' AND idx % 4 = 0) n""")
def vision_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over verdicts of which three quarters are cached; the rest are asked for."""
    second = F.floor(F.col("start") / 1_000_000)
    one = F.struct((second % 3 == 0).alias("is_event"), ((second % 101).cast("double") / 100).alias("confidence"), F.lit(None).cast("int").alias("frame_index"), F.lit("").alias("rationale"), F.lit("").alias("caption"))
    found = _merged(spark, sf_dir).where("strategy = 'error'").select("rec", (F.col("rec") * 100000 + F.col("idx")).alias("idx"), "start", "end", (F.col("idx") % 4 == 0).alias("fresh"))
    cached = found.where("not fresh").select("idx", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), one.alias("verdict"))
    table, after = pipelines.vision_compare(found, cached, lambda rows: rows.withColumn("verdict", one), _golden(spark, sf_dir), ["rec"], width=WIDTH)
    new = after.join(cached.select("idx"), "idx", "left_anti").agg(F.count(F.lit(1)).alias("asked"))
    return table.select("threshold", "total", "kept", "found").join(F.broadcast(new))  # one row


@query(f"""WITH {_JUDGED} SELECT k.doc_id, l.toxic, agreement, distance, coalesce(agreement <> 'consistent' OR distance >= 0.5, TRUE) AS flagged FROM k JOIN labels l ON k.doc_id = l.doc_id""")
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows described and judged, of which some are cached, and which of them to look at."""
    d = F.col("doc_id")
    reply = F.lit('{"score": 2, "caption": "a", "description": "b"}')
    says = F.when(d % 4 == 0, "consistent").when(d % 4 == 1, "ai_likely_wrong").when(d % 4 == 2, "human_likely_wrong").otherwise("other")
    judged = verdicts.parse_judge(F.concat(F.lit('{"agreement": "'), says, F.lit('", "distance_score": '), F.round((d % 111) / 100.0, 2).cast("string"), F.lit("}")))
    rows = _table(spark, sf_dir, "labels").select("doc_id", "toxic", d.alias("idx"), F.lit("s").alias("strategy"), d.cast("string").alias("clip_file"), F.when(F.col("toxic") == 1, " tp").otherwise("FP").alias("verdict"))
    cached = rows.where("idx % 5 != 0").select("idx", "strategy", "clip_file", verdicts.parse_describe(reply).alias("describe"), F.when(F.col("idx") % 3 == 0, judged).alias("judge"))
    every, flagged = pipelines.label_audit(rows, cached, lambda r: r.withColumn("describe", verdicts.parse_describe(reply)), lambda r: r.withColumn("judge", judged), Settings())
    marked = flagged.select("idx").withColumn("flagged", F.lit(True))
    out = every.join(marked, "idx", "left")
    return out.select("doc_id", "toxic", F.col("judge.agreement").alias("agreement"), F.col("judge.distance_score").alias("distance"), F.coalesce("flagged", F.lit(False)).alias("flagged"))


#: All events as one timeline, cut into ranges of so many rows.
ROWS_PER_RANGE = 2048
_ONE = f"""{_EV}, pad AS (SELECT *, greatest(0, t - {BEFORE // 2000}) AS s, t + {AFTER // 2000} AS e FROM ev),
fl AS (SELECT *, CASE WHEN s - max(e) OVER (ORDER BY s, t, event_id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP // 2000} THEN 0 ELSE 1 END AS nw FROM pad),
isl AS (SELECT *, sum(nw) OVER (ORDER BY s, t, event_id, e ROWS UNBOUNDED PRECEDING) AS island FROM fl)"""


def _one_timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, scan.Ranges]:
    ev = _events(spark, sf_dir).withColumn("all", F.lit(0))
    padded = intervals.pad_peaks(ev, "t", BEFORE // 2000, AFTER // 2000)
    return padded, scan.long_ranges(padded, ["all"], "start", ROWS_PER_RANGE)


@query(f"""WITH {_ONE} SELECT row_number() OVER (ORDER BY min(s)) AS idx, min(s) AS "start", max(e) AS "end", count(*) AS n FROM isl GROUP BY island""")
def one_timeline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a single timeline, merged by scans over its ranges: no task takes it all."""
    padded, ranges = _one_timeline(spark, sf_dir)
    out = intervals.merge_intervals(padded, ["all"], GAP // 2000, 0, ["t", "event_id"], [F.count(F.lit(1)).alias("n")], ranges=ranges)
    return out.select("idx", "start", "end", "n")


@query(f"""WITH {_EV}, m AS (SELECT *, value >= 20 AS m FROM ev),
nw AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER (ORDER BY t, event_id), FALSE) THEN 1 ELSE 0 END AS nw FROM m),
rn AS (SELECT *, sum(nw) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM nw),
ap AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, t, event_id) AS r, count(*) OVER (PARTITION BY run) AS run_length FROM rn WHERE m)
SELECT CAST(run AS BIGINT) AS run, event_id, run_length FROM ap WHERE r = 1""")
def one_timeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumns({"all": F.lit(0), "threshold": F.lit(20.0)})
    ranges = scan.long_ranges(ev, ["all"], "t", ROWS_PER_RANGE)
    return peaks.run_apexes(ev, ["all"], ["t", "event_id"], F.col("value") >= F.col("threshold"), "value", "threshold", ranges).select(F.col("run").cast("long").alias("run"), "event_id", "run_length")


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) <= {HOUR // 30} THEN 0 ELSE 1 END AS nw FROM ev),
c AS (SELECT *, sum(nw) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM g)
SELECT event_id, CAST(k AS BIGINT) AS "cluster", i FROM c""")
def one_timeline_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("all", F.lit(0))
    ranges = scan.long_ranges(ev, ["all"], "t", ROWS_PER_RANGE)
    out = scan.numbered(intervals.cluster_points(ev, ["all"], "t", "event_id", HOUR // 30, ranges), ["all"], ["t", "event_id"], "i", ranges)
    return out.select("event_id", F.col("cluster").cast("long").alias("cluster"), "i")




_SLICES = f"""{_MERGED}, ch AS (SELECT rec, d AS day, d * {DAY} AS cs, (d + 1) * {DAY} AS ce FROM (SELECT DISTINCT rec, t // {DAY} AS d FROM ev)),
sl AS (
  SELECT m.rec, m.idx, c.day, greatest(m.s, cs) - cs AS ls, least(m.e, ce) - greatest(m.s, cs) AS d, row_number() OVER (PARTITION BY m.rec, m.idx ORDER BY c.day) - 1 AS i, count(*) OVER (PARTITION BY m.rec, m.idx) AS n
  FROM merged m JOIN ch c ON m.rec = c.rec AND least(m.e, ce) > greatest(m.s, cs) WHERE m.strategy = 'error')"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = interval_chunk_slices(spark, sf_dir).where("strategy = 'error'").withColumnRenamed("day", "sequence")
    return sinks.clip_manifest(own, ["rec"], F.concat(F.lit("it's "), F.col("sequence").cast("string")))


@query(f"""WITH {_SLICES}, p AS (SELECT *, printf('clip_%03d', idx) AS stem FROM sl)
SELECT rec, idx, CASE WHEN any_value(n) = 1 THEN 'rename' ELSE 'copy' END AS join_by, string_agg(CASE WHEN n = 1 THEN stem || '.mp4' ELSE stem || '_part' || i || '.mp4' END, ',' ORDER BY i) AS part_files,
  CASE WHEN any_value(n) > 1 THEN string_agg('file ''' || stem || '_part' || i || '.mp4''' || chr(10), '' ORDER BY i) END AS file_list FROM p GROUP BY rec, idx""")
def join_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.join_manifest(_clips(spark, sf_dir)).select("rec", "idx", "join_by", F.array_join("part_files", ",").alias("part_files"), "file_list")


@query(f"""WITH RECURSIVE {_SLICES}, t AS (SELECT *, sum(d) OVER (PARTITION BY rec, idx) AS total FROM sl),
share AS (SELECT *, CAST(greatest(1, round_even(7.0::DOUBLE * d / total, 0)) AS BIGINT) AS want FROM t),
al AS (
  SELECT rec, idx, i, n, day, ls, d, CASE WHEN i = n - 1 THEN 7 ELSE least(7, want) END AS got, CASE WHEN i = n - 1 THEN 7 ELSE least(7, want) END AS used FROM share WHERE i = 0
  UNION ALL
  SELECT s.rec, s.idx, s.i, s.n, s.day, s.ls, s.d, greatest(0, CASE WHEN s.i = s.n - 1 THEN 7 - a.used ELSE least(7 - a.used, s.want) END), a.used + greatest(0, CASE WHEN s.i = s.n - 1 THEN 7 - a.used ELSE least(7 - a.used, s.want) END)
  FROM al a JOIN share s ON s.rec = a.rec AND s.idx = a.idx AND s.i = a.i + 1),
st AS (SELECT *, unnest(range(0, got)) AS j FROM al)
SELECT rec, idx, CAST(row_number() OVER (PARTITION BY rec, idx ORDER BY i, j) - 1 AS INTEGER) AS frame, 'it''s ' || day AS source, round(ls + d::DOUBLE / got * (j + 0.5), 0) AS at FROM st""")
def frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stills for a model, over the parts of each clip."""
    return sinks.frame_manifest(_clips(spark, sf_dir), ["rec"], 7, 640).select("rec", "idx", "frame", "source", F.round("at", 0).alias("at"))
