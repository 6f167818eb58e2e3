import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    lengths = [0, 1, 3, 9, 70, 600, 5000, 10**6, 10**7]
    key = lambda: rng.choice(["a", "a", "a", "b", "c"])
    ivs = [(key(), i, s := rng.randrange(-500, 3000), s + rng.choice(lengths)) for i in range(150)] + [("a", 900, 10, 5), ("d", 901, 0, 4)]
    ivs.append(ivs[3])  # a repeated row
    pts = [(key(), rng.randrange(-600, 3100), 0.5) for _ in range(200)] + [("e", 1, 0.5), ("a", 10**6, 0.5)]
    pts += pts[:5]
    return ivs, pts, spark.createDataFrame(ivs, "k string, id long, s long, e long"), spark.createDataFrame(pts, "k string, t long, w double")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("width", [1, 10, 400])
def test_points_equal_nested_loops(data, width):
    ivs, pts, i, p = data
    args = (["k"], "t", "s", "e", width)
    inner = ranges.points_in_intervals(p, i, *args)
    assert rows(inner.select("k", "t", "w", "id", "s", "e")) == sorted((*x, *v[1:]) for x in pts for v in ivs if x[0] == v[0] and v[2] <= x[1] <= v[3])
    met = [x for x in pts if any(x[0] == v[0] and v[2] <= x[1] <= v[3] for v in ivs)]
    assert rows(ranges.points_in_intervals(p, i, *args, "left_semi")) == sorted(met)
    assert rows(ranges.points_in_intervals(p, i, *args, "left_anti")) == sorted(x for x in pts if x not in met)
    short = i.where("e - s <= 32")
    few = [x for x in pts if any(x[0] == v[0] and v[2] <= x[1] <= v[3] <= v[2] + 32 for v in ivs)]
    assert rows(ranges.points_in_intervals(p, short, *args, "left_semi", 1)) == sorted(few)
    assert rows(ranges.intervals_with_points(i, p, ["k"], "s", "e", "t", width)) == sorted(v for v in ivs if any(x[0] == v[0] and v[2] <= x[1] <= v[3] for x in pts))


@pytest.mark.parametrize("width", [1, 25])
def test_overlaps_equal_nested_loops(data, width):
    ivs, _, i, _ = data
    other = i.where("id % 3 = 0").select("k", F.col("id").alias("id2"), (F.col("s") + 7).alias("s2"), (F.col("e") + 7).alias("e2"))
    got = ranges.overlapping(i, other, ["k"], ("s", "e"), ("s2", "e2"), width)
    second = [(k, n, s + 7, e + 7) for k, n, s, e in ivs if n % 3 == 0]
    own = [v for v in ivs if v[3] >= v[2]]
    assert rows(got.select("k", "id", "s", "e", "id2", "s2", "e2")) == sorted((*a, *b[1:]) for a in own for b in second if b[3] >= b[2] and a[0] == b[0] and a[2] < b[3] and a[3] > b[2])


def test_copies_are_few_however_long(data):
    _, _, i, _ = data
    per = lambda longer: ranges.bucketed(i.where("e - s <= 1000000").distinct(), "s", "e", 1, longer=longer).groupBy("id").count().agg(F.max("count")).first()[0]
    assert per(False) <= ranges.FACTOR + 1 and per(True) <= ranges.FACTOR + 1 + 2 * ranges.LEVELS
    assert [ranges.levels_for(n, 1) for n in (0, 32, 33, 1024, 1025, 10**12)] == [1, 1, 2, 2, 3, 4]


def test_no_intervals(data):
    _, pts, i, p = data
    none = i.where("false")
    args = (["k"], "t", "s", "e", 10)
    assert ranges.points_in_intervals(p, none, *args).count() == 0 and ranges.points_in_intervals(p, none, *args, "left_anti").count() == len(pts)
    assert ranges.overlapping(i, none.withColumnsRenamed({"id": "x", "s": "s2", "e": "e2"}), ["k"], ("s", "e"), ("s2", "e2"), 10).count() == 0
