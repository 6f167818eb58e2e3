"""Scans of timelines in two levels, so that a long one is worked on by many tasks.

A window partitioned by timeline alone sorts and walks a timeline in one task. Here long
timelines are cut into ranges of time, at splitters that are quantiles of their rows. A
scan runs within (timeline, range); each range's total (count, sum, largest end, last
row) is carried into the ranges after it. Totals are a row for each range of a long
timeline, at most MAX_RANGES in all, so they are broadcast; timelines of one range carry
nothing and cost nothing more.

Splitters are found once, by ``long_ranges``, and serve every scan of rows whose times
come from the same timelines: they are constants in the plan, so a task that runs again
puts rows into the same ranges. Rows of one instant stay together in one range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of a range, about, and the most ranges that are made beyond one a timeline.
ROWS_PER_RANGE, MAX_RANGES = 1 << 20, 1 << 13
RANGE = "__range"


@dataclass
class Ranges:
    """Splitters of the long timelines, as a small table of keys and ``__splitters``; None where there is none."""

    keys: list[str]
    table: DataFrame | None

    def of(self, df: DataFrame, at: Column) -> DataFrame:
        """Rows with their range of ``at``, 0 in short timelines."""
        if self.table is None:
            return df.withColumn(RANGE, F.lit(0))
        names = {k: f"__s_{k}" for k in self.keys}
        small = F.broadcast(self.table.withColumnsRenamed(names))  # MAX_RANGES splitters at most
        on = None
        for k in self.keys:
            same = df[k].eqNullSafe(small[names[k]])
            on = same if on is None else on & same
        out = df.withColumn("__at", at).join(small, on, "left") if on is not None else df.withColumn("__at", at).crossJoin(small)  # one row
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_RANGES.bit_length()))])
        reached = lambda p, s: (p + s <= F.size("__splitters")) & (F.get("__splitters", p + s - 1) <= F.col("__at"))
        found = F.aggregate(steps, F.lit(0), lambda p, s: F.when(reached(p, s), p + s).otherwise(p))
        return out.withColumn(RANGE, F.when(F.col("__splitters").isNull() | F.col("__at").isNull(), 0).otherwise(found)).drop("__splitters", "__at", *names.values())


def long_ranges(df: DataFrame, keys: list[str], at: str, rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES) -> Ranges:
    """Splitters for timelines of more than ``rows_per_range`` rows.

    One counting pass, and a second one over the long timelines only. The ranges grow
    rather than pass ``max_ranges`` in all.
    """
    spark = df.sparkSession
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    each = max(rows_per_range, -(-2 * total // max_ranges))
    long = counts.where(F.col("__n") > each).collect()  # total / each at most
    if not long:
        return Ranges(keys, None)
    schema = StructType([StructField(k, df.schema[k].dataType) for k in keys])
    pick = spark.createDataFrame([tuple(r[k] for k in keys) for r in long], schema) if keys else None
    rows = df
    if pick is not None:
        on = None
        for k in keys:
            same = df[k].eqNullSafe(pick[k])
            on = same if on is None else on & same
        rows = df.join(F.broadcast(pick), on, "left_semi")
    most = max(2, -(-max(r["__n"] for r in long) // each))
    points = F.array(*[F.lit(k / most) for k in range(1, most)])
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(at, points, F.lit(max(10000, 4 * most))).alias("__q"))
    kind = dict(df.dtypes)[at]
    out = []
    for r in found.collect():
        n = max(2, -(-r["__n"] // each))
        wanted = sorted({r["__q"][min(most - 2, max(0, round(k * most / n) - 1))] for k in range(1, n)})
        out.append((*[r[k] for k in keys], wanted))
    return Ranges(keys, spark.createDataFrame(out, StructType([*schema.fields, StructField("__splitters", _array_of(kind))])))


def _array_of(kind: str):
    return StructType.fromDDL(f"x array<{kind}>")["x"].dataType


def carried(df: DataFrame, keys: list[str], totals: list[Column], carries: dict[str, Column], ranges: Ranges) -> DataFrame:
    """Rows (with their range) and what the ranges before theirs amount to.

    ``totals`` are aggregates of a range, with aliases; ``carries`` name columns made of
    them over ``before_here``'s frame. They are null in the first range of a timeline.
    """
    names = list(carries)
    sums = df.where(F.col(RANGE) >= 0).groupBy(*keys, RANGE).agg(*totals)
    every = sums.withColumns(carries).where(F.col(RANGE) > 0).select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col(RANGE).alias("__c_range"), *names)
    on = df[RANGE] == F.col("__c_range")
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"__c_{k}"))
    return df.join(F.broadcast(every), on, "left").drop("__c_range", *[f"__c_{k}" for k in keys])  # MAX_RANGES rows at most


def before(keys: list[str]):
    """The window of a timeline's ranges before a range, over totals."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: Ranges | None = None) -> DataFrame:
    """Rows numbered from 0 within their timeline."""
    if ranges is None or ranges.table is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    rows = ranges.of(df, F.col(order[0]))
    rows = carried(rows, keys, [F.count(F.lit(1)).alias("__rows")], {"__base": F.sum("__rows").over(before(keys))}, ranges)
    local = F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order))
    return rows.withColumn(name, F.coalesce("__base", F.lit(0)) + local - 1).drop("__base", RANGE)


def running_count(rows: DataFrame, keys: list[str], order: list[str], flag: str, name: str, ranges: Ranges | None = None) -> DataFrame:
    """The running sum of a flag, its own row included; rows have their range where ``ranges`` cut any."""
    if ranges is None or ranges.table is None:
        return rows.withColumn(name, F.sum(flag).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    out = carried(rows, keys, [F.sum(flag).alias("__sum")], {"__base": F.sum("__sum").over(before(keys))}, ranges)
    local = F.sum(flag).over(Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.coalesce("__base", F.lit(0)) + local).drop("__base")


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, ranges: Ranges | None = None) -> DataFrame:
    """The value of the row before; rows keep their range where ``ranges`` cut any."""
    if ranges is None or ranges.table is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    last = F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))).alias("__end_row")
    rows = carried(ranges.of(df, F.col(order[0])), keys, [last], {"__ended": F.last("__end_row").over(before(keys))}, ranges)
    by = Window.partitionBy(*keys, RANGE).orderBy(*order)
    first = F.row_number().over(by) == 1
    return rows.withColumn(name, F.when(first, F.col("__ended.v")).otherwise(F.lag(value).over(by))).drop("__ended")
