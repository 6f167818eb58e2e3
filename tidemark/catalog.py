"""The registry of queries over the star-schema tables, and the SQL that checks them.

A user is a recording, an event type a strategy, the value of its events a signal, and
purchases are reference events. Times are whole microseconds since 2024-01-01.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clip_name, offset_seconds, safe_caption
from tidemark.operators import cache, golden, intervals, peaks, ranges, scoring, signal, verdicts
from tidemark.package import ship
from tidemark.plans.pipelines import after_warmup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR
BEFORE, AFTER, GAP, WARMUP = 6 * HOUR, 5 * HOUR, 5 * HOUR, DAY
TOTAL = 31 * DAY
WIDTH = 12 * HOUR  # time buckets of range joins
KEYS = ["rec", "strategy"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("event_type").alias("strategy"), "event_id", t.alias("t"), "value", "props")


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pad_peaks(_events(spark, sf_dir).where(F.col("t") >= WARMUP), "t", BEFORE, AFTER)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [F.count(F.lit(1)).alias("n_peaks"), F.max("value").alias("max_value")]
    return intervals.merge_intervals(_padded(spark, sf_dir), KEYS, GAP, 0, ["t", "event_id"], extra)


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("strategy = 'purchase'").select("rec", F.col("t").alias("at"))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _merged(spark, sf_dir).where("strategy != 'purchase'")
    return intervals.merge_intervals(own.select("rec", "start", "end"), ["rec"], 0, 0)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _events(spark, sf_dir).select("rec").distinct().withColumn("total", F.lit(TOTAL).cast("long"))
    return intervals.invert(_union(spark, sf_dir), recs, ["rec"], "total")


_EV = f"""ev AS (
  SELECT user_id AS rec, event_type AS strategy, event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t, value, props
  FROM events)"""
_PAD = f"""{_EV}, pad AS (
  SELECT *, greatest(0, t - {BEFORE}) AS s, t + {AFTER} AS e FROM ev WHERE t >= {WARMUP})"""
_MERGED = f"""{_PAD}, fl AS (
  SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY rec, strategy ORDER BY s, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS nw FROM pad),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY rec, strategy ORDER BY s, t, event_id) AS island FROM fl),
merged AS (
  SELECT rec, strategy, min(s) AS s, max(e) AS e, count(*) AS n_peaks, max(value) AS max_value,
         row_number() OVER (PARTITION BY rec, strategy ORDER BY min(s)) AS idx
  FROM isl GROUP BY rec, strategy, island)"""
_UNION = f"""{_MERGED}, ufl AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS unw
  FROM merged WHERE strategy <> 'purchase'),
uisl AS (SELECT *, sum(unw) OVER (PARTITION BY rec ORDER BY s, e) AS u FROM ufl),
un AS (SELECT rec, min(s) AS s, max(e) AS e FROM uisl GROUP BY rec, u)"""
_GAPS = f"""{_UNION}, cur AS (
  SELECT rec, s, coalesce(max(e) OVER (PARTITION BY rec ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM un),
recs AS (SELECT DISTINCT rec FROM ev),
gaps AS (
  SELECT rec, c AS s, s AS e FROM cur WHERE s > c
  UNION ALL
  SELECT r.rec, coalesce(m.reach, 0), {TOTAL} FROM recs r LEFT JOIN (SELECT rec, max(e) AS reach FROM un GROUP BY rec) m ON r.rec = m.rec
  WHERE coalesce(m.reach, 0) < {TOTAL})"""


@query(f"""WITH {_EV}, days AS (
  SELECT rec, t // {DAY} AS day, min(t) AS first_t, max(t) - min(t) AS duration FROM ev GROUP BY 1, 2)
SELECT rec, CAST(day AS BIGINT) AS day, CAST(duration AS BIGINT) AS duration,
  CAST(coalesce(sum(duration) OVER (PARTITION BY rec ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS global_start
FROM days""")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).groupBy("rec", F.floor(F.col("t") / DAY).alias("day")).agg((F.max("t") - F.min("t")).alias("duration"))
    return intervals.running_offsets(days, ["rec"], ["day"], "duration").select("rec", "day", "duration", "global_start")


@query(f"""WITH {_EV}, days AS (
  SELECT rec, t // {DAY} AS day, min(t) AS first_t, max(t) - min(t) AS duration FROM ev GROUP BY 1, 2),
drift AS (SELECT rec, day, first_t - lag(first_t + duration) OVER (PARTITION BY rec ORDER BY day) AS drift FROM days)
SELECT rec, CAST(day AS BIGINT) AS day, CAST(drift AS BIGINT) AS drift FROM drift WHERE abs(drift) > {6 * HOUR}""")
def dropped_span_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).groupBy("rec", F.floor(F.col("t") / DAY).alias("day")).agg(F.min("t").alias("first_t"), (F.max("t") - F.min("t")).alias("duration"))
    return intervals.dropped_spans(days, ["rec"], ["day"], "first_t", "duration", 6 * HOUR).select("rec", "day", "drift")


@query(f"WITH {_EV} SELECT rec, strategy, event_id, t, value FROM ev WHERE t >= {WARMUP}")
def warmup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after_warmup(_events(spark, sf_dir), "t", WARMUP).select("rec", "strategy", "event_id", "t", "value")


_HALF, _SIGMA, _FLOOR = 12, 2.5, 10.0
_ROLLING = f"""{_EV}, num AS (
  SELECT *, row_number() OVER (PARTITION BY rec, strategy ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY rec, strategy) AS n FROM ev),
p1 AS (
  SELECT rec, strategy, i, value, event_id, t, FALSE AS pad FROM num
  UNION ALL SELECT rec, strategy, 1 - k, value, event_id, t, TRUE FROM num, range(1, {_HALF + 1}) r(k) WHERE i = 1
  UNION ALL SELECT rec, strategy, n + k, value, event_id, t, TRUE FROM num, range(1, {_HALF + 1}) r(k) WHERE i = n),
b AS (SELECT *, median(value) OVER (PARTITION BY rec, strategy ORDER BY i ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS baseline FROM p1),
r AS (SELECT *, abs(value - baseline) AS res, count(*) OVER (PARTITION BY rec, strategy) AS n FROM b WHERE NOT pad),
p2 AS (
  SELECT rec, strategy, i, res, FALSE AS pad FROM r
  UNION ALL SELECT rec, strategy, 1 - k, res, TRUE FROM r, range(1, {_HALF + 1}) x(k) WHERE i = 1
  UNION ALL SELECT rec, strategy, n + k, res, TRUE FROM r, range(1, {_HALF + 1}) x(k) WHERE i = n),
m AS (SELECT *, median(res) OVER (PARTITION BY rec, strategy ORDER BY i ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS mad FROM p2),
trace AS (
  SELECT r.rec, r.strategy, r.event_id, r.t, r.i, r.value, r.baseline, m.mad, r.baseline + {_SIGMA} * m.mad * {signal.MAD_SCALE} AS threshold
  FROM r JOIN m ON r.rec = m.rec AND r.strategy = m.strategy AND r.i = m.i AND NOT m.pad)"""


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).select("rec", "strategy", "event_id", "t", "value")
    return signal.rolling_threshold(ev, KEYS, ["t", "event_id"], "value", 2 * _HALF + 1, _SIGMA)


@query(f"WITH {_ROLLING} SELECT strategy, event_id, round(baseline, 6) AS baseline, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM trace")
def rolling_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).select("strategy", "event_id", *[F.round(c, 6).alias(c) for c in ("baseline", "mad", "threshold")])


@query(ORACLE_SQL["rolling_threshold"])
def rolling_threshold_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).select("rec", "strategy", "event_id", "t", "value")
    out = signal.rolling_threshold_sql(ev, KEYS, ["t", "event_id"], "value", 2 * _HALF + 1, _SIGMA)
    return out.select("strategy", "event_id", *[F.round(c, 6).alias(c) for c in ("baseline", "mad", "threshold")])


_RUNS = """, mk AS (SELECT *, {mask} AS m FROM {source}),
nw AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER (PARTITION BY {keys} ORDER BY t, event_id), FALSE) THEN 1 ELSE 0 END AS nw FROM mk),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY t, event_id) AS run FROM nw),
apex AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, run ORDER BY value DESC, t, event_id) AS r, count(*) OVER (PARTITION BY {keys}, run) AS run_length
  FROM rn WHERE m)"""


@query(f"WITH {_ROLLING}{_RUNS.format(mask=f'(round(value - threshold, 6) >= 0 AND value > {_FLOOR})', source='trace', keys='rec, strategy')} SELECT strategy, event_id, t, run_length, round(value - threshold, 6) AS score FROM apex WHERE r = 1")
def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = (F.round(F.col("value") - F.col("threshold"), 6) >= 0) & (F.col("value") > _FLOOR)
    out = peaks.run_apexes(_trace(spark, sf_dir), KEYS, ["t", "event_id"], mask, "value", "threshold")
    return out.select("strategy", "event_id", "t", "run_length", F.round("score", 6).alias("score"))


@query(f"WITH {_EV}{_RUNS.format(mask='(value - 30.0 >= 5.0)', source='ev', keys='rec, strategy')} SELECT rec, strategy, event_id, t, run_length, round(value - 30.0, 6) AS score FROM apex WHERE r = 1")
def event_mask_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("threshold", F.lit(30.0))
    out = peaks.onset_flux(ev, KEYS, ["t", "event_id"], 5.0)
    return out.select("rec", "strategy", "event_id", "t", "run_length", F.round("score", 6).alias("score"))


_WIN, _HOP = 16, 4


@query(f"""WITH fr AS (
  SELECT vec_id, f AS frame_idx, list_transform(embedding[f * {_HOP} + 1 : f * {_HOP} + {_WIN}], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS sq
  FROM (SELECT vec_id, embedding, unnest(range(0, (len(embedding) - {_WIN}) // {_HOP} + 1)) AS f FROM embeddings))
SELECT vec_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(sqrt(list_sum(sq) / {_WIN}.0 + {signal.EPS}), 6) AS rms,
  round(20 * log10(sqrt(list_sum(sq) / {_WIN}.0 + {signal.EPS}) + {signal.EPS}), 6) AS dbfs FROM fr""")
def rms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.frame_rms(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", _WIN, _HOP)
    return out.select("vec_id", "frame_idx", F.round("rms", 6).alias("rms"), F.round("dbfs", 6).alias("dbfs"))


@query(f"""WITH pd AS (
  SELECT vec_id, list_concat(list_concat(list_transform(range({_WIN // 2}), lambda i: 0.0), list_transform(embedding, lambda x: CAST(x AS DOUBLE))), list_transform(range({_WIN // 2}), lambda i: 0.0)) AS x FROM embeddings),
fr AS (SELECT vec_id, f, x FROM (SELECT vec_id, x, unnest(range(0, (len(x) - {_WIN}) // {_HOP} + 1)) AS f FROM pd)),
spec AS (
  SELECT vec_id, f, k,
    list_sum(list_transform(range({_WIN}), lambda j: x[f * {_HOP} + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / {_WIN})) * cos(2 * pi() * k * j / {_WIN}))) / {_WIN / 2} AS re,
    list_sum(list_transform(range({_WIN}), lambda j: x[f * {_HOP} + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / {_WIN})) * sin(2 * pi() * k * j / {_WIN}))) / {_WIN / 2} AS im
  FROM fr, range(0, {_WIN // 2 + 1}) b(k)),
mag AS (SELECT vec_id, f, k, sqrt(re * re + im * im) AS m FROM spec),
d AS (SELECT vec_id, f, m - coalesce(lag(m) OVER (PARTITION BY vec_id, k ORDER BY f), m) AS d FROM mag)
SELECT vec_id, CAST(f AS INTEGER) AS frame_idx, round(sum(greatest(d, 0)), 6) AS flux FROM d GROUP BY vec_id, f""")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.spectral_flux(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", _WIN, _HOP)
    return out.select("vec_id", "frame_idx", F.round("flux", 6).alias("flux"))


@query(f"""WITH {_EV} SELECT rec, event_id, t FROM ev a WHERE strategy = 'error' AND EXISTS (
  SELECT 1 FROM ev b WHERE b.strategy <> 'error' AND b.rec = a.rec AND b.t BETWEEN a.t - {2 * HOUR} AND a.t + {3 * HOUR})""")
def combined_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    out = peaks.corroborated(ev.where("strategy = 'error'"), ev.where("strategy != 'error'"), ["rec"], "t", 2 * HOUR, 3 * HOUR, WIDTH)
    return out.select("rec", "event_id", "t")


@query(f'WITH {_PAD} SELECT rec, strategy, event_id, s AS "start", e AS "end" FROM pad')
def pad_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select("rec", "strategy", "event_id", "start", "end")


@query(f'WITH {_MERGED} SELECT rec, strategy, idx, s AS "start", e AS "end", n_peaks, max_value FROM merged')
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("rec", "strategy", "idx", "start", "end", "n_peaks", "max_value")


@query(f'WITH {_MERGED} SELECT rec, strategy, s AS "start", e AS "end" FROM merged WHERE e - s >= {12 * HOUR}')
def min_interval_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_padded(spark, sf_dir), KEYS, GAP, 12 * HOUR, ["t", "event_id"]).select("rec", "strategy", "start", "end")


@query(f'WITH {_UNION} SELECT rec, s AS "start", e AS "end" FROM un')
def union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir).select("rec", "start", "end")


@query(f'WITH {_GAPS} SELECT rec, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM gaps')
def invert_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("rec", "start", "end")


_LONG, _SHORT = 2 * DAY, 4 * HOUR


@query(f"""WITH {_GAPS}, g AS (SELECT rec, s, e, greatest(1, CAST(ceil((e - s) / {_LONG}.0) AS BIGINT)) AS n FROM gaps WHERE e - s >= {_SHORT}),
p AS (SELECT *, unnest(range(0, n)) AS i FROM g)
SELECT rec, CAST(i AS INTEGER) AS piece, CAST(s + i * (e - s) // n AS BIGINT) AS "start",
  CAST(CASE WHEN i = n - 1 THEN e ELSE s + (i + 1) * (e - s) // n END AS BIGINT) AS "end" FROM p""")
def split_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_long(_gaps(spark, sf_dir), ["rec"], _LONG, _SHORT).select("rec", "piece", "start", "end")


@query(f"""WITH {_MERGED}, ch AS (SELECT rec, d AS day, d * {DAY} AS cs, (d + 1) * {DAY} AS ce FROM (SELECT DISTINCT rec, t // {DAY} AS d FROM ev))
SELECT m.rec, m.strategy, m.idx, CAST(c.day AS BIGINT) AS day, CAST(greatest(m.s, cs) - cs AS BIGINT) AS local_start, CAST(least(m.e, ce) - cs AS BIGINT) AS local_end
FROM merged m JOIN ch c ON m.rec = c.rec AND least(m.e, ce) > greatest(m.s, cs)""")
def interval_chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).select("rec", F.floor(F.col("t") / DAY).alias("day")).distinct()
    chunks = days.withColumns({"chunk_start": F.col("day") * DAY, "chunk_end": (F.col("day") + 1) * DAY})
    return intervals.slices(_merged(spark, sf_dir), chunks, ["rec"], DAY).select("rec", "strategy", "idx", "day", "local_start", "local_end")


@query(f"""WITH {_MERGED} SELECT rec, strategy, printf('clip_%03d.mp4', idx) AS clip_file, (s // 10000) / 100 AS start_seconds, (e // 10000) / 100 AS end_seconds,
  (e // 10000 - s // 10000) / 100 AS duration_seconds, round(coalesce(max_value, 0.0), 4) AS max_peak_score, '' AS verdict, '' AS notes FROM merged""")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.sinks import review_sheet as sheet

    hundredths = {c: F.floor(F.col(c) / 10000) for c in ("start", "end")}  # so that no engine has halves to round
    return sheet(_merged(spark, sf_dir).withColumns(hundredths), KEYS, 100.0)


_ROUNDS = f"""{_MERGED}, lab AS (
  SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM ev g WHERE g.strategy = 'purchase' AND g.rec = m.rec AND g.t BETWEEN m.s AND m.e) THEN 'TP' ELSE 'FP' END AS verdict,
    (m.s // {7 * DAY}) % 2 AS wk FROM merged m WHERE strategy <> 'purchase')"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _merged(spark, sf_dir).where("strategy != 'purchase'")
    hit = ranges.intervals_with_points(own, _golden(spark, sf_dir), ["rec"], "start", "end", "at", WIDTH)
    yes = hit.select(*KEYS, "idx").withColumn("verdict", F.lit("TP"))
    return own.join(yes, [*KEYS, "idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("FP")))


@query(f"""WITH {_ROUNDS}, new AS (SELECT * FROM lab WHERE strategy = 'error'), old AS (SELECT * FROM lab WHERE strategy <> 'error' AND wk = 0),
hit AS (
  SELECT n.rec, n.idx, bool_and(o.verdict = 'TP') AS a, bool_or(o.verdict = 'TP') AS o1,
    string_agg(o.strategy || '=' || o.verdict || ' (week ' || CAST(o.wk AS VARCHAR) || ')', '; ' ORDER BY o.strategy, o.idx) AS b
  FROM new n JOIN old o ON n.rec = o.rec AND n.s < o.e AND n.e > o.s GROUP BY 1, 2)
SELECT n.rec, n.idx, CASE WHEN h.rec IS NULL THEN '' WHEN a THEN 'TP' WHEN NOT o1 THEN 'FP' ELSE 'AMBIGUOUS' END AS guess,
  coalesce(b, 'no overlapping prior label') AS guess_basis FROM new n LEFT JOIN hit h ON n.rec = h.rec AND n.idx = h.idx""")
def prior_label_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _labelled(spark, sf_dir).withColumn("wk", F.floor(F.col("start") / (7 * DAY)) % 2)
    old = lab.where("strategy != 'error' and wk = 0").select("rec", F.col("strategy").alias("source"), "idx", "start", "end", "verdict", F.concat(F.lit("week "), F.col("wk").cast("string")).alias("notes"))
    out = scoring.prior_guess(lab.where("strategy = 'error'"), old, ["rec"], WIDTH)
    return out.select("rec", "idx", "guess", "guess_basis")


@query(f"""WITH {_ROUNDS}, fn AS (
  SELECT g.rec, g.t AS s, g.t + {HOUR} AS e FROM ev g WHERE g.strategy = 'purchase' AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.rec = g.rec AND g.t BETWEEN l.s AND l.e)),
tp AS (SELECT rec, s, e FROM lab WHERE verdict = 'TP' UNION ALL SELECT rec, s, e FROM fn),
tfl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM tp),
tis AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS u FROM tfl),
truth AS (SELECT rec, u, min(s) AS s, max(e) AS e FROM tis GROUP BY rec, u),
cov AS (SELECT l.strategy, count(DISTINCT (t.rec, t.u)) AS covered FROM truth t JOIN lab l ON l.rec = t.rec AND l.verdict = 'TP' AND t.s < l.e AND t.e > l.s GROUP BY 1),
cnt AS (SELECT strategy, count(*) AS total, count(*) AS labeled, count(*) FILTER (WHERE verdict = 'TP') AS tp, count(*) FILTER (WHERE verdict = 'FP') AS fp FROM lab GROUP BY 1),
sc AS (SELECT c.*, coalesce(v.covered, 0) AS covered, (SELECT count(*) FROM truth) AS truths FROM cnt c LEFT JOIN cov v ON c.strategy = v.strategy)
SELECT strategy, total, labeled, tp, fp, covered, truths, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(covered / nullif(truths, 0), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (covered / truths) / ((tp / (tp + fp)) + (covered / truths)), 6) AS f1 FROM sc""")
def score_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _labelled(spark, sf_dir).select("rec", "strategy", "start", "end", "verdict")
    gold = _golden(spark, sf_dir)
    missed = ranges.points_in_intervals(gold, lab.select("rec", "start", "end"), ["rec"], "at", "start", "end", WIDTH, "left_anti")
    missed = missed.select("rec", F.lit(None).cast("string").alias("strategy"), F.col("at").alias("start"), (F.col("at") + HOUR).alias("end"), F.lit("FN").alias("verdict"))
    out = scoring.score_strategies(lab.unionByName(missed), ["rec"], WIDTH)
    return out.select("strategy", "total", "labeled", "tp", "fp", "covered", "truths", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_EV}, f AS (
  SELECT rec, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t, event_id) <= {12 * HOUR} THEN 0 ELSE 1 END AS nw FROM ev WHERE strategy = 'purchase'),
c AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY t, event_id) AS k FROM f)
SELECT rec, CAST(k AS BIGINT) AS "cluster", round(avg(t), 3) AS at, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS sources FROM c GROUP BY rec, k""")
def golden_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _events(spark, sf_dir).where("strategy = 'purchase'")
    out = golden.build_golden(points, ["rec"], "t", "event_id", 12 * HOUR)
    return out.select("rec", "cluster", F.round("at", 3).alias("at"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


_NOTE = "'missed at ' || CAST(event_id % 90 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '.5 seconds' ELSE ' sec' END"


@query(f"SELECT event_id, CAST(regexp_extract({_NOTE}, '(\\d+(?:\\.\\d+)?)\\s*sec', 1) AS DOUBLE) AS at FROM events WHERE event_type = 'error'")
def fn_offset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("strategy = 'error'").select("event_id", F.lit(0.0).alias("start"), F.expr(_NOTE.replace("VARCHAR", "STRING")).alias("notes"))
    return golden.missed_times(rows, "start", "notes").select("event_id", "at")


_SCORE = """SELECT count(*) AS clips, CAST(sum(e - s) AS BIGINT) AS total_duration, CAST(max(e - s) AS BIGINT) AS max_duration, round(avg(e - s), 3) AS mean_duration,
  count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM c"""


@query(f"""WITH {_MERGED}, c AS (
  SELECT m.*, EXISTS (SELECT 1 FROM ev g WHERE g.strategy = 'purchase' AND g.rec = m.rec AND g.t BETWEEN m.s AND m.e) AS hit FROM merged m WHERE strategy <> 'purchase'),
a AS (SELECT strategy, count(*) AS clips, CAST(sum(e - s) AS BIGINT) AS total_duration, CAST(max(e - s) AS BIGINT) AS max_duration, round(avg(e - s), 3) AS mean_duration, count(*) FILTER (WHERE hit) AS tp FROM c GROUP BY 1),
g AS (SELECT rec, t, row_number() OVER () AS id FROM ev WHERE strategy = 'purchase'),
f AS (SELECT m.strategy, count(DISTINCT g.id) AS found FROM merged m JOIN g ON g.rec = m.rec AND g.t BETWEEN m.s AND m.e WHERE m.strategy <> 'purchase' GROUP BY 1)
SELECT a.*, a.clips - a.tp AS fp, coalesce(found, 0) AS found, (SELECT count(*) FROM g) - coalesce(found, 0) AS fn,
  round(tp / clips, 6) AS "precision", round(coalesce(found, 0) / (SELECT count(*) FROM g), 6) AS recall FROM a LEFT JOIN f ON a.strategy = f.strategy""".replace("a.*,", "a.strategy, a.clips, a.total_duration, a.max_duration, a.mean_duration, a.tp,"))
def golden_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _merged(spark, sf_dir).where("strategy != 'purchase'")
    out = scoring.golden_score(own, _golden(spark, sf_dir), ["rec"], WIDTH, ["strategy"])
    return out.select("strategy", "clips", "total_duration", "max_duration", F.round("mean_duration", 3).alias("mean_duration"), "tp", "fp", "found", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_MERGED}, g AS (SELECT rec, t, value, row_number() OVER () AS id FROM ev WHERE strategy = 'purchase' AND value >= 100),
h AS (SELECT g.id, EXISTS (SELECT 1 FROM merged m WHERE m.strategy <> 'purchase' AND m.rec = g.rec AND g.t BETWEEN m.s AND m.e) AS hit FROM g)
SELECT count(*) AS golden, count(*) FILTER (WHERE hit) AS found, round(count(*) FILTER (WHERE hit) / count(*), 6) AS recall FROM h""")
def must_catch_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _events(spark, sf_dir).where("strategy = 'purchase' and value >= 100").select("rec", F.col("t").alias("at"))
    out = scoring.golden_score(_merged(spark, sf_dir).where("strategy != 'purchase'"), gold, ["rec"], WIDTH)
    return out.select("golden", "found", F.round("recall", 6).alias("recall"))


_SWEEP = [1.01, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50]
_CONF = "CAST((m.s // 1000000) % 101 AS DOUBLE) / 100"


@query(f"""WITH {_MERGED}, cand AS (SELECT m.rec, m.s, m.e, ((m.s // 1000000) % 3 = 0) AS is_event, {_CONF} AS confidence FROM merged m WHERE strategy = 'error'),
th AS (SELECT unnest([{', '.join(map(str, _SWEEP))}])::DOUBLE AS threshold),
k AS (SELECT t.threshold, c.*, (c.is_event OR c.confidence < t.threshold) AS kept FROM cand c, th t),
g AS (SELECT rec, t, row_number() OVER () AS id FROM ev WHERE strategy = 'purchase'),
a AS (SELECT threshold, count(*) AS total, count(*) FILTER (WHERE kept) AS kept FROM k GROUP BY 1),
f AS (SELECT threshold, count(DISTINCT g.id) AS found FROM k JOIN g ON k.kept AND g.rec = k.rec AND g.t BETWEEN k.s AND k.e GROUP BY 1),
tp AS (SELECT threshold, count(*) AS tp FROM k WHERE kept AND EXISTS (SELECT 1 FROM g WHERE g.rec = k.rec AND g.t BETWEEN k.s AND k.e) GROUP BY 1)
SELECT a.threshold, a.total, a.kept, tp.tp, f.found, round(tp.tp / a.kept, 6) AS "precision", round(f.found / (SELECT count(*) FROM g), 6) AS recall
FROM a LEFT JOIN f ON a.threshold = f.threshold LEFT JOIN tp ON a.threshold = tp.threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.floor(F.col("start") / 1_000_000)
    cand = _merged(spark, sf_dir).where("strategy = 'error'").select("rec", "start", "end", (second % 3 == 0).alias("is_event"), ((second % 101).cast("double") / 100).alias("confidence"))
    steps = spark.createDataFrame([(x,) for x in _SWEEP], "threshold double")
    out = scoring.sweep(cand, steps, _golden(spark, sf_dir), ["rec"], WIDTH)
    return out.select("threshold", "total", "kept", "tp", "found", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_EV}, pr AS (SELECT * FROM (VALUES ('loose', 20.0), ('strict', 80.0)) p(preset, least)),
x AS (SELECT p.preset, e.rec, e.t, e.event_id, greatest(0, t - {BEFORE}) AS s, t + {AFTER} AS e FROM ev e, pr p WHERE e.strategy <> 'purchase' AND e.value >= p.least AND t >= {WARMUP}),
fl AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY preset, rec ORDER BY s, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS nw FROM x),
i AS (SELECT *, sum(nw) OVER (PARTITION BY preset, rec ORDER BY s, t, event_id) AS k FROM fl),
m AS (SELECT preset, rec, min(s) AS s, max(e) AS e FROM i GROUP BY preset, rec, k)
SELECT preset, count(*) AS clips, CAST(sum(e - s) AS BIGINT) AS total_duration FROM m GROUP BY 1""")
def strategy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = spark.createDataFrame([("loose", 20.0), ("strict", 80.0)], "preset string, least double")
    ev = _events(spark, sf_dir).where((F.col("strategy") != "purchase") & (F.col("t") >= WARMUP))
    each = ev.crossJoin(F.broadcast(presets)).where("value >= least")  # two presets
    merged = intervals.merge_intervals(intervals.pad_peaks(each, "t", BEFORE, AFTER), ["preset", "rec"], GAP, 0, ["t", "event_id"])
    return merged.groupBy("preset").agg(F.count(F.lit(1)).alias("clips"), F.sum(F.col("end") - F.col("start")).alias("total_duration"))


def _reply(e: str = "event_id"):
    """A model's reply made of an event: fenced for some, malformed for some."""
    event = F.when(F.col(e) % 3 == 0, "true").otherwise("false")
    body = F.concat(F.lit('{"is_event": '), event, F.lit(', "confidence": '), ((F.col(e) % 121).cast("double") / 100).cast("string"), F.lit(', "frame_index": '), (F.col(e) % 7).cast("string"), F.lit(', "caption": "c"}'))
    return F.when(F.col(e) % 11 == 0, "no json").when(F.col(e) % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)


_PARSED = f"""{_EV}, v AS (
  SELECT *, (event_id % 11 <> 0 AND (event_id % 121) / 100.0 <= 1) AS ok, event_id % 3 = 0 AS is_event, round((event_id % 121) / 100.0, 6) AS confidence, event_id % 7 AS frame FROM ev)"""


@query(f"WITH {_PARSED} SELECT event_id, ok AS valid, CASE WHEN ok THEN CAST(is_event AS VARCHAR) ELSE 'none' END AS is_event, CASE WHEN ok THEN CAST(confidence AS DOUBLE) END AS confidence FROM v")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir).withColumn("v", verdicts.parse_verdict(_reply()))
    return v.select("event_id", F.col("v").isNotNull().alias("valid"), F.coalesce(F.col("v.is_event").cast("string"), F.lit("none")).alias("is_event"), F.round("v.confidence", 6).alias("confidence"))


@query(f"WITH {_PARSED} SELECT event_id FROM v WHERE coalesce(CASE WHEN ok THEN is_event OR confidence < 0.75 END, TRUE)")
def confirm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir).withColumn("v", verdicts.parse_verdict(_reply()))
    return v.where(verdicts.keep_confirmed(F.col("v.is_event"), F.round("v.confidence", 6), 0.75)).select("event_id")


@query(f"WITH {_PARSED} SELECT event_id, round(t / 1e6 + 12.0 / 5 * (frame + 0.5), 4) AS at FROM v WHERE ok AND is_event AND confidence >= 0.75 AND frame BETWEEN 0 AND 4")
def scan_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _events(spark, sf_dir).withColumn("v", verdicts.parse_verdict(_reply(), scan=True)).withColumn("s", F.col("t") / 1e6)
    at = verdicts.scan_peak(F.col("s"), F.col("s") + 12.0, F.col("v.is_event"), F.round("v.confidence", 6), F.col("v.frame_index"), 5, 0.75)
    return v.withColumn("at", F.round(at, 4)).where("at is not null").select("event_id", "at")


@query(f"""WITH {_MERGED}, x AS (SELECT rec, strategy, idx, (e - s) / 1e6 AS d, unnest(range(0, 5)) AS i FROM merged)
SELECT rec, strategy, idx, CAST(i AS INTEGER) AS frame, round(d / 5 * (i + 0.5), 4) AS at FROM x""")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = verdicts.frame_offsets((F.col("end") - F.col("start")) / 1e6, 5)
    out = _merged(spark, sf_dir).select("rec", "strategy", "idx", F.posexplode(at).alias("frame", "at"))
    return out.withColumn("at", F.round("at", 4))


@query(f"""WITH {_MERGED}, pk AS (
  SELECT i.rec, i.strategy, m.idx, m.s, m.e, i.t AS p, row_number() OVER (PARTITION BY i.rec, i.strategy, m.idx ORDER BY i.value DESC, i.t, i.event_id) AS r
  FROM isl i JOIN merged m ON i.rec = m.rec AND i.strategy = m.strategy AND i.s >= m.s AND i.e <= m.e)
SELECT rec, strategy, idx, CAST(greatest(s, p - {2 * HOUR}) AS BIGINT) AS "from", CAST(least(e, p + {2 * HOUR}) AS BIGINT) AS "to" FROM pk WHERE r = 1""")
def peak_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max(F.struct("value", (-F.col("t")).alias("t"), (-F.col("event_id")).alias("e"))).alias("top")
    m = intervals.merge_intervals(_padded(spark, sf_dir), KEYS, GAP, 0, ["t", "event_id"], [top])
    low, high = verdicts.peak_window(F.col("start"), F.col("end"), -F.col("top.t"), F.lit(4 * HOUR))
    return m.select("rec", "strategy", "idx", low.cast("long").alias("from"), high.cast("long").alias("to"))


@query(f"""WITH RECURSIVE {_MERGED}, ch AS (SELECT rec, d AS day, d * {DAY} AS cs, (d + 1) * {DAY} AS ce FROM (SELECT DISTINCT rec, t // {DAY} AS d FROM ev)),
sl AS (
  SELECT m.rec, m.strategy, m.idx, least(m.e, ce) - greatest(m.s, cs) AS d,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY m.rec, m.strategy, m.idx) AS n, sum(least(m.e, ce) - greatest(m.s, cs)) OVER (PARTITION BY m.rec, m.strategy, m.idx) AS total
  FROM merged m JOIN ch c ON m.rec = c.rec AND least(m.e, ce) > greatest(m.s, cs) WINDOW w AS (PARTITION BY m.rec, m.strategy, m.idx ORDER BY c.day)),
share AS (SELECT *, CAST(greatest(1, round_even(10.0::DOUBLE * d / total, 0)) AS BIGINT) AS want FROM sl),
al AS (
  SELECT rec, strategy, idx, i, n, CASE WHEN i = n THEN 10 ELSE least(10, want) END AS frames, CASE WHEN i = n THEN 10 ELSE least(10, want) END AS used FROM share WHERE i = 1
  UNION ALL
  SELECT s.rec, s.strategy, s.idx, s.i, s.n, greatest(0, CASE WHEN s.i = s.n THEN 10 - a.used ELSE least(10 - a.used, s.want) END),
    a.used + greatest(0, CASE WHEN s.i = s.n THEN 10 - a.used ELSE least(10 - a.used, s.want) END)
  FROM al a JOIN share s ON s.rec = a.rec AND s.strategy = a.strategy AND s.idx = a.idx AND s.i = a.i + 1)
SELECT rec, strategy, idx, CAST(i - 1 AS INTEGER) AS slice, CAST(frames AS INTEGER) AS frames FROM al""")
def frame_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = interval_chunk_slices(spark, sf_dir).groupBy("rec", "strategy", "idx").agg(F.array_sort(F.collect_list(F.struct("day", (F.col("local_end") - F.col("local_start")).alias("d")))).alias("s"))
    got = verdicts.allocate_frames(F.transform("s", lambda x: x["d"]), 10)
    return parts.select("rec", "strategy", "idx", F.posexplode(got).alias("slice", "frames"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS c FROM documents),
y AS (SELECT doc_id, rtrim(substr(c, 1, 80), '. ') AS c FROM x)
SELECT doc_id, CASE WHEN coalesce(c, '') = '' THEN 'highlight' ELSE c END AS caption FROM y""")
def caption_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", safe_caption(F.col("text")).alias("caption"))


@query("""SELECT doc_id, (quality + toxic * 5 + 1) BETWEEN 1 AND 5 AS valid, CASE WHEN (quality + toxic * 5 + 1) BETWEEN 1 AND 5 THEN CAST(quality + toxic * 5 + 1 AS INTEGER) ELSE 0 END AS score FROM labels""")
def describe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("quality") + F.col("toxic") * 5 + 1
    reply = F.concat(F.lit('{"score": '), n.cast("string"), F.lit(', "caption": "a", "description": "b"}'))
    out = _table(spark, sf_dir, "labels").withColumn("d", verdicts.parse_describe(reply))
    return out.select("doc_id", F.col("d").isNotNull().alias("valid"), F.coalesce("d.score", F.lit(0)).alias("score"))


_JUDGED = """j AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'consistent' WHEN 1 THEN 'ai_likely_wrong' WHEN 2 THEN 'human_likely_wrong' ELSE 'other' END AS a, round((doc_id % 111) / 100.0, 2) AS d FROM labels),
k AS (SELECT doc_id, CASE WHEN a <> 'other' AND d <= 1 THEN a END AS agreement, CASE WHEN a <> 'other' AND d <= 1 THEN CAST(d AS DOUBLE) END AS distance FROM j)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = F.when(F.col("doc_id") % 4 == 0, "consistent").when(F.col("doc_id") % 4 == 1, "ai_likely_wrong").when(F.col("doc_id") % 4 == 2, "human_likely_wrong").otherwise("other")
    reply = F.concat(F.lit('{"agreement": "'), says, F.lit('", "distance_score": '), F.round((F.col("doc_id") % 111) / 100.0, 2).cast("string"), F.lit("}"))
    out = _table(spark, sf_dir, "labels").withColumn("j", verdicts.parse_judge(reply))
    return out.select("doc_id", "j.agreement", F.col("j.distance_score").alias("distance"))


@query(f"WITH {_JUDGED} SELECT doc_id, agreement, distance FROM k")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


@query(f"WITH {_JUDGED} SELECT doc_id FROM k WHERE agreement IS NULL OR agreement <> 'consistent' OR distance >= 0.5")
def audit_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where(verdicts.is_flagged(F.col("agreement"), F.col("distance"), 0.5)).select("doc_id")


@query(f"WITH {_JUDGED} SELECT doc_id, coalesce(distance, 1.0) AS distance FROM k ORDER BY coalesce(distance, 1.0) DESC, doc_id LIMIT 50")
def disagreement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.by_disagreement(_judged(spark, sf_dir), "distance", "doc_id").limit(50)  # a top-50 report
    return out.select("doc_id", F.coalesce("distance", F.lit(1.0)).alias("distance"))


@query("SELECT event_id, event_id % 4 = 0 AS missing FROM events WHERE event_id % 4 = 0 OR event_id % 6 = 1")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    old = rows.where("event_id % 4 != 0").withColumn("result", F.when(F.col("event_id") % 6 != 1, F.col("value")))
    out = cache.todo(cache.resume(rows, old, "event_id", {"event_type": 0, "value": 0.5}, "result"), "result")
    return out.select("event_id", (F.col("event_id") % 4 == 0).alias("missing"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND event_id % 3 <> 0")
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    picks = rows.where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type")
    return cache.outbox(picks, rows.where("event_id % 3 = 0").select("event_id"), ["event_id"])


@query("SELECT event_type AS strategy, count(*) AS total, count(*) FILTER (WHERE event_id % 3 < 2) AS labeled, count(*) FILTER (WHERE event_id % 3 = 0) AS tp, count(*) FILTER (WHERE event_id % 3 = 1) AS fp FROM events GROUP BY 1")
def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("event_id") % 3 == 0, " tp").when(F.col("event_id") % 3 == 1, "Fp ").otherwise("")
    return scoring.strategy_counts(_table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), verdict.alias("verdict")), ["strategy"])


@query(f"""WITH {_EV}, f AS (SELECT rec, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t, event_id) <= {16 * HOUR} THEN 0 ELSE 1 END AS nw FROM ev),
s AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY t, event_id) AS k FROM f)
SELECT rec, CAST(min(t) - {BEFORE} AS BIGINT) AS "start", CAST(max(t) + {AFTER} AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY rec, k""")
def session_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming.sessions import session_intervals as sessions

    ev = _table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"))
    out = sessions(ev, ["rec"], "ts", BEFORE, AFTER, GAP)
    zero = F.unix_micros(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").cast("timestamp"))
    return out.select("rec", (F.unix_micros("start") - zero).alias("start"), (F.unix_micros("end") - zero).alias("end"), "n")


@query(f"""WITH {_MERGED}, g AS (SELECT rec, t, value, event_id, row_number() OVER (PARTITION BY rec, strategy ORDER BY value DESC, t) AS r, strategy FROM ev)
SELECT rec, strategy, event_id, t, value FROM g WHERE r = 1""")
def strongest_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.strongest(_events(spark, sf_dir), KEYS, "value", "t").select("rec", "strategy", "event_id", "t", "value")


@query("SELECT o_orderkey AS idx, printf('clip_%03d.mp4', o_orderkey) AS clip_file FROM orders")
def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), clip_name(F.col("o_orderkey")).alias("clip_file"))


from tidemark import catalog_commands  # noqa: E402, F401  registers the commands' queries
