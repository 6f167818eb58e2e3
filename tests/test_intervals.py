import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators import peaks as pk
from tidemark.operators import ranges


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def peaks(spark):
    return lambda times: spark.createDataFrame([("a", float(t)) for t in times], "k string, t double")


def test_pad_clamps_the_start_alone(peaks):
    assert rows(iv.pad_peaks(peaks([5]), "t", 45.0, 8.0), "start", "end") == [(0.0, 13.0)]


def test_merge_joins_close_ones(peaks):
    out = iv.merge_intervals(iv.pad_peaks(peaks([100, 110, 500]), "t", 10.0, 5.0), ["k"], 5.0, 0.0)
    assert rows(out, "idx", "start", "end") == [(1, 90.0, 115.0), (2, 490.0, 505.0)]


def test_merge_gap_is_inclusive_and_short_ones_go(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 15.0, 20.0), ("a", 30.0, 31.0)], "k string, start double, end double")
    assert rows(iv.merge_intervals(df, ["k"], 5.0, 5.0), "start", "end") == [(0.0, 20.0)]


def test_merge_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([], "k string, start double, end double")
    assert iv.merge_intervals(df, ["k"], 5.0, 5.0).count() == 0


def test_merge_equals_a_fold(spark):
    rng = random.Random(1)
    data = [(str(k), s, s + rng.randint(0, 9)) for k in range(40) for s in (rng.randint(0, 60) for _ in range(rng.randint(1, 9)))]
    df = spark.createDataFrame(data, "k string, start long, end long")
    for gap in (0, 2, -1):
        want = []
        for k in {d[0] for d in data}:
            cur = None
            for s, e in sorted((s, e) for kk, s, e in data if kk == k):
                if cur and s - cur[1] <= gap:
                    cur[1] = max(cur[1], e)
                else:
                    cur = [s, e]
                    want.append((k, cur))
        assert rows(iv.merge_intervals(df, ["k"], gap, -100), "k", "start", "end") == sorted((k, *c) for k, c in want)


def test_invert_and_split(spark):
    own = spark.createDataFrame([("a", 50.0, 100.0), ("a", 150.0, 180.0)], "k string, start double, end double")
    total = spark.createDataFrame([("a", 200.0), ("b", 250.0)], "k string, total double")
    gaps = iv.invert(own, total, ["k"], "total")
    assert rows(gaps, "k", "start", "end") == [("a", 0.0, 50.0), ("a", 100.0, 150.0), ("a", 180.0, 200.0), ("b", 0.0, 250.0)]
    cut = iv.split_long(gaps, ["k"], 100.0, 25.0)
    assert rows(cut.where("k = 'b'"), "piece", "end") == [(0, 250 / 3), (1, 500 / 3), (2, 250.0)]
    assert cut.where("k = 'a'").count() == 2  # the gap of 20 goes


def test_slices_across_chunks(spark):
    own = spark.createDataFrame([("a", 1, 90.0, 110.0), ("a", 2, 40.0, 60.0)], "k string, idx int, start double, end double")
    chunks = spark.createDataFrame([("a", 1, 0.0, 100.0), ("a", 2, 100.0, 200.0)], "k string, sequence int, chunk_start double, chunk_end double")
    out = iv.slices(own, chunks, ["k"], 30.0)
    assert rows(out, "idx", "sequence", "local_start", "local_end") == [(1, 1, 90.0, 100.0), (1, 2, 0.0, 10.0), (2, 1, 40.0, 60.0)]


def test_range_joins_equal_nested_loops(spark):
    rng = random.Random(2)
    a = [(i % 3, i, s, s + rng.randint(0, 20)) for i, s in enumerate(rng.randint(0, 90) for _ in range(60))]
    b = [(i % 3, i, s, s + rng.randint(0, 20)) for i, s in enumerate(rng.randint(0, 90) for _ in range(60))]
    A = spark.createDataFrame(a, "k int, ia int, start long, end long")
    B = spark.createDataFrame(b, "k int, ib int, s long, e long")
    pairs = ranges.overlapping(A, B, ["k"], ("start", "end"), ("s", "e"), 7)
    assert rows(pairs, "ia", "ib") == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])
    P = spark.createDataFrame([(x[0], x[1], x[2]) for x in b], "k int, ip int, at long")
    inside = ranges.points_in_intervals(P, A, ["k"], "at", "start", "end", 7)
    assert rows(inside, "ip", "ia") == sorted((y[1], x[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[2] <= x[3])
    held = ranges.intervals_with_points(A.unionByName(A), P, ["k"], "start", "end", "at", 7)
    assert rows(held, "ia") == sorted((x[1],) for x in a + a if any(x[0] == y[0] and x[2] <= y[2] <= x[3] for y in b))


def test_offsets_and_drift(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 60.0), ("a", 2, 60.5, 60.0), ("a", 3, 130.0, 10.0)], "k string, sequence int, began double, duration double")
    assert rows(iv.running_offsets(df, ["k"], ["sequence"], "duration"), "sequence", "global_start") == [(1, 0.0), (2, 60.0), (3, 120.0)]
    assert rows(iv.dropped_spans(df, ["k"], ["sequence"], "began", "duration", 2.0), "sequence") == [(3,)]


def test_runs_take_the_first_largest_value(spark):
    data = [(i, v, 1.0) for i, v in enumerate([0.0, 3.0, 5.0, 5.0, 0.0, 2.0])]
    df = spark.createDataFrame([("a", *r) for r in data], "k string, i int, value double, threshold double")
    out = pk.onset_flux(df, ["k"], ["i"], 1.0)
    assert rows(out, "i", "score", "run_length") == [(2, 4.0, 3), (5, 1.0, 1)]


def test_corroboration_window(spark):
    flux = spark.createDataFrame([("a", 10.0), ("a", 40.0), ("a", 70.0)], "k string, t double")
    rms = spark.createDataFrame([("a", 13.0), ("a", 69.0)], "k string, t double")
    assert rows(pk.corroborated(flux, rms, ["k"], "t", 2.0, 5.0, 20.0), "t") == [(10.0,), (70.0,)]
    assert pk.corroborated(flux, rms.limit(0), ["k"], "t", 2.0, 5.0, 20.0).count() == 0


def test_unknown_strategy():
    with pytest.raises(ValueError):
        pk.analyze("nothing")
