import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, peaks, scan, signal


@pytest.fixture(scope="module")
def events(spark):
    """A long timeline, a hot null one, ties of time, and short ones."""
    rng = np.random.default_rng(5)
    rows = [("long", int(t)) for t in rng.integers(0, 6000, 2500)] + [(None, int(t)) for t in rng.integers(0, 900, 400)] + [("a", 5), ("b", 1), ("b", 3)]
    rows = [(k, t, i, float(rng.integers(0, 50))) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "k string, t long, id long, v double").cache()


@pytest.fixture(scope="module")
def ranges(events):
    found = scan.long_ranges(events, ["k"], "t", 100)
    cut = {r["k"]: len(r["__splitters"]) for r in found.table.collect()}
    assert set(cut) == {"long", None} and cut["long"] > 15
    return found


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    one, two = (sorted(map(tuple, x.select(*columns).collect()), key=key) for x in (a, b))
    assert len(one) > 0 and one == two


def test_ranges_are_bounded(events, ranges):
    sizes = [r["count"] for r in ranges.of(events, F.col("t")).groupBy("k", scan.RANGE).count().collect()]
    assert max(sizes) < 250 and sum(sizes) == events.count()


def test_scans_equal_plain_windows(events, ranges):
    same(scan.numbered(events, ["k"], ["t", "id"], "i"), scan.numbered(events, ["k"], ["t", "id"], "i", ranges))
    padded = intervals.pad_peaks(events, "t", 2, 1).drop("v")
    for gap, least in ((0, 0), (3, 9)):
        same(intervals.merge_intervals(padded, ["k"], gap, least, ["t", "id"], [F.count(F.lit(1)).alias("n")]), intervals.merge_intervals(padded, ["k"], gap, least, ["t", "id"], [F.count(F.lit(1)).alias("n")], ranges=ranges))
    same(intervals.cluster_points(events, ["k"], "t", "id", 2), intervals.cluster_points(events, ["k"], "t", "id", 2, ranges))
    same(intervals.running_offsets(events, ["k"], ["t", "id"], "v"), intervals.running_offsets(events, ["k"], ["t", "id"], "v", ranges))
    chunks = events.withColumn("d", F.lit(2))
    same(intervals.dropped_spans(chunks, ["k"], ["t", "id"], "t", "d", 1), intervals.dropped_spans(chunks, ["k"], ["t", "id"], "t", "d", 1, ranges))
    merged = intervals.merge_intervals(padded, ["k"], 0, 0)
    totals = events.select("k").distinct().withColumn("total", F.lit(6100).cast("long"))
    same(intervals.invert(merged, totals, ["k"], "total"), intervals.invert(merged, totals, ["k"], "total", ranges))


def test_runs_over_ranges(events, ranges):
    trace = events.withColumn("threshold", F.lit(1.0))
    for least in (0.0, 30.0, 90.0):  # one run of everything, many, none
        mask = peaks.flux_mask("v", "threshold", least - 1)
        a, b = (peaks.run_apexes(trace, ["k"], ["t", "id"], mask, "v", "threshold", r) for r in (None, ranges))
        key = lambda r: (str(r["k"]), r["run"])
        assert sorted((tuple(r[c] for c in sorted(a.columns)) for r in a.collect()), key=str) == sorted((tuple(r[c] for c in sorted(a.columns)) for r in b.collect()), key=str), key
        assert (a.count() > 0) == (least < 90)


def test_long_trace_of_many_blocks(spark, events, ranges):
    a = signal.rolling_threshold(events, ["k"], ["t", "id"], "v", 11, 2.0)
    b = signal.rolling_threshold(events, ["k"], ["t", "id"], "v", 11, 2.0, block=37, ranges=ranges)
    c = signal.rolling_threshold_sql(events, ["k"], ["t", "id"], "v", 11, 2.0)
    round_ = lambda df: df.select("k", "t", "id", "v", *[F.round(x, 9).alias(x) for x in ("baseline", "mad", "threshold")])
    same(round_(a), round_(b)), same(round_(a), round_(c))
    numbered = scan.numbered(events, ["k"], ["t", "id"], "i")
    same(round_(signal.rolling_threshold(numbered, ["k"], ["i"], "v", 11, 2.0, index="i", block=11)), round_(a))
    assert signal.rolling_threshold(events.where("false"), ["k"], ["t"], "v", 11, 2.0).count() == 0


def test_empty_and_short_timelines(spark, events):
    assert scan.long_ranges(events.where("false"), ["k"], "t", 100).table is None
    assert scan.long_ranges(events.where("k = 'b'"), ["k"], "t", 100).table is None
    one = scan.long_ranges(events.where("k = 'long'"), ["k"], "t", 10, max_ranges=50)  # ranges grow instead
    assert len(one.table.first()["__splitters"]) < 50
