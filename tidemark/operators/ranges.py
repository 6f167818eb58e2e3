"""Range joins by time buckets, of a width that fits the interval.

A condition on ranges alone has no equi-key, so a long recording would be one nested
loop. Here intervals are listed under the buckets of time that they touch, and the join is
on (keys, class, bucket) with the range as the rest of the condition. An interval's class
is by its length: buckets of class c are ``width * 32 ** c`` long, and an interval is listed
under those of its own class, 33 at most (beyond a million widths, in the last class, as
many as it takes). A point, or a shorter interval, is listed once or twice under each longer
class. So copies grow with the logarithm of a length, not with the length. A caller that
knows a bound of the lengths gives fewer ``levels``: one is enough up to 32 widths.

Two intervals meet in the class of the longer one, in the bucket in which the later one
starts, so no pair comes twice and nothing need be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of one class that an interval may fill, and the classes.
FACTOR, LEVELS = 32, 4


def levels_for(length, width) -> int:
    """Classes that intervals of at most such a length need."""
    n = 1
    while length > width * FACTOR**n and n < LEVELS:
        n += 1
    return n


def bucket_of(at: Column, width, level: Column | None = None) -> Column:
    """The number of the bucket of a class (of class 0 without one) that holds a time."""
    each = F.lit(width) if level is None else F.lit(width) * F.pow(F.lit(float(FACTOR)), level)
    return F.floor(at / each).cast("long")


def class_of(start: Column, end: Column, width, levels: int = LEVELS) -> Column:
    """0 for lengths up to FACTOR widths; the last class takes whatever is longer."""
    found = F.lit(0)
    for c in range(1, levels):
        found = F.when(end - start > F.lit(width) * F.lit(float(FACTOR**c)), c).otherwise(found)
    return found


def bucketed(intervals: DataFrame, start: str, end: str, width, levels: int = LEVELS, longer: bool = False) -> DataFrame:
    """Each interval under the buckets that it touches, both ends included; none if end < start.

    Under those of its own class (``__level``), or also of each longer one.
    """
    rows = intervals.where(F.col(end) >= F.col(start)).withColumn("__class", class_of(F.col(start), F.col(end), width, levels))
    rows = rows.withColumn("__level", F.explode(F.sequence(F.col("__class"), F.lit(levels - 1))) if longer else F.col("__class"))
    return rows.withColumn("__bucket", F.explode(F.sequence(bucket_of(F.col(start), width, F.col("__level")), bucket_of(F.col(end), width, F.col("__level")))))


def _points(points: DataFrame, at: str, width, levels: int) -> DataFrame:
    rows = points.withColumn("__level", F.explode(F.array(*map(F.lit, range(levels)))) if levels > 1 else F.lit(0))
    return rows.withColumn("__bucket", bucket_of(F.col(at), width, F.col("__level")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width, how: str = "inner", levels: int = LEVELS) -> DataFrame:
    """Pairs with start <= at <= end. how: inner, left_semi or left_anti, of points.

    Semi and anti joins over several classes find the (keys, at) that are met, and keep
    the points by those.
    """
    names = [c for c in intervals.columns if c not in keys]
    right = bucketed(intervals, start, end, width, levels).drop("__class").withColumnsRenamed({c: f"__r_{c}" for c in (*names, *keys)} | {"__level": "__r_level", "__bucket": "__r_bucket"})
    pair = lambda left: _all([*[left[k] == right[f"__r_{k}"] for k in keys], left["__level"] == right["__r_level"], left["__bucket"] == right["__r_bucket"], left[at] >= right[f"__r_{start}"], left[at] <= right[f"__r_{end}"]])
    if how == "inner":
        left = _points(points, at, width, levels)
        out = left.join(right, pair(left))
        return out.select(*[left[c] for c in points.columns], *[F.col(f"__r_{c}").alias(c) for c in names if c not in points.columns])
    if levels == 1:
        left = _points(points, at, width, 1)
        return left.join(right, pair(left), how).drop("__level", "__bucket")
    # Which (keys, at) are met at all, then an equi-join that keeps every row of points.
    left = _points(points.select(*keys, at).distinct(), at, width, levels)
    met = left.join(right, pair(left), "left_semi").select(*keys, at).distinct()
    return points.join(met, [*keys, at], how).select(*points.columns)


def intervals_with_points(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, width, levels: int = LEVELS) -> DataFrame:
    """The intervals that hold a point, each as often as it is there.

    Rows are known by their values, with a count of equal ones: ids by position would
    change when a lost task is run again.
    """
    columns = intervals.columns
    one = intervals.groupBy(*columns).agg(F.count(F.lit(1)).cast("int").alias("__copies"))
    left = bucketed(one, start, end, width, levels)
    right = points.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(at).alias("__at"))
    right = _points(right, "__at", width, levels).withColumnsRenamed({"__level": "__l", "__bucket": "__b"})
    condition = _all([left["__level"] == right["__l"], left["__bucket"] == right["__b"], right["__at"] >= left[start], right["__at"] <= left[end], *[left[k] == right[f"__r_{k}"] for k in keys]])
    hit = left.join(right, condition, "left_semi").select(*columns, "__copies").distinct()
    return hit.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], ends_a: tuple[str, str], ends_b: tuple[str, str], width, levels: int = LEVELS) -> DataFrame:
    """Pairs that overlap strictly (touching is none): a.start < b.end and a.end > b.start.

    Columns of b other than the keys must not be named as columns of a.
    """
    (sa, ea), (sb, eb) = ends_a, ends_b
    left = bucketed(a, sa, ea, width, levels, True)
    right = bucketed(b, sb, eb, width, levels, True).withColumnsRenamed({"__bucket": "__bucket_b", "__level": "__level_b", "__class": "__class_b"} | {k: f"__k_{k}" for k in keys})
    condition = _all([F.col("__level") == F.col("__level_b"), F.col("__bucket") == F.col("__bucket_b"), F.col(sa) < F.col(eb), F.col(ea) > F.col(sb), *[left[k] == right[f"__k_{k}"] for k in keys]])
    once = (F.col("__level") == F.greatest("__class", "__class_b")) & (F.col("__bucket") == bucket_of(F.greatest(F.col(sa), F.col(sb)), width, F.col("__level")))
    return left.join(right, condition & once).drop("__bucket", "__bucket_b", "__level", "__level_b", "__class", "__class_b", *[f"__k_{k}" for k in keys])
