"""Peaks to intervals, and the algebra of intervals.

Order is by (start, order columns); ``keys`` name the timeline (recording, strategy ...),
so windows run within a timeline and never over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.ranges import overlapping


def pad_peaks(peaks: DataFrame, at: str, before, after) -> DataFrame:
    """start = max(0, at - before) and end = at + after; the end is not clamped."""
    zero = F.lit(0).cast(dict(peaks.dtypes)[at])
    return peaks.withColumns({"start": F.greatest(zero, F.col(at) - before), "end": F.col(at) + after})


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap, order: list[str], ranges: scan.Ranges | None = None) -> DataFrame:
    """Number runs of intervals whose start is at most ``gap`` past all ends before it.

    ``ranges`` (of the starts, see ``scan``) cut long timelines up.
    """
    if ranges is None or ranges.table is None:
        by = Window.partitionBy(*keys).orderBy(start, *order, end)
        reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(F.col(start) - reach <= gap, 0).otherwise(1)
        return df.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    rows, reach = _reach(df, keys, start, end, [start, *order, end], ranges)
    rows = rows.withColumn("__new", F.when(F.col(start) - reach <= gap, 0).otherwise(1)).drop("__before")
    return scan.running_count(rows, keys, [start, *order, end], "__new", "island", ranges).drop("__new", scan.RANGE)


def _reach(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], ranges: scan.Ranges) -> tuple[DataFrame, Column]:
    """Rows with their range, and the largest end before a row: of ranges before its own, and in it."""
    rows = scan.carried(ranges.of(df, F.col(start)), keys, [F.max(end).alias("__top")], {"__before": F.max("__top").over(scan.before(keys))}, ranges)
    local = F.max(end).over(Window.partitionBy(*keys, scan.RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows, F.greatest("__before", local)  # of both where there are two


def merge_intervals(df: DataFrame, keys: list[str], gap, min_length, order: list[str] = [], aggregates: list[Column] = [], start: str = "start", end: str = "end", ranges: scan.Ranges | None = None) -> DataFrame:  # noqa: B006
    """One row for each run of intervals, without runs shorter than ``min_length``.

    ``idx`` numbers what is left in each timeline from 1.
    """
    found = islands(df, keys, start, end, gap, order, ranges).groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), *aggregates)
    found = found.where(F.col("end") - F.col("start") >= min_length)
    return scan.numbered(found, keys, ["start"], "idx", ranges).withColumn("idx", F.col("idx") + 1).drop("island")


def invert(intervals: DataFrame, timelines: DataFrame, keys: list[str], total: str, ranges: scan.Ranges | None = None) -> DataFrame:
    """The gaps before, between and after intervals; a timeline without any is one gap.

    A gap's end isn't clamped where an interval starts past the total.
    """
    zero = F.lit(0).cast(dict(timelines.dtypes)[total])
    if ranges is None or ranges.table is None:
        by = Window.partitionBy(*keys).orderBy("start", "end")
        rows, reach = intervals, F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    else:
        rows, reach = _reach(intervals, keys, "start", "end", ["start", "end"], ranges)
    between = rows.withColumn("__cursor", F.coalesce(reach, zero)).where(F.col("start") > F.col("__cursor"))
    between = between.select(*keys, F.col("__cursor").alias("start"), F.col("start").alias("end"))
    reach = intervals.groupBy(*keys).agg(F.max("end").alias("__reach"))
    tail = timelines.join(reach, keys, "left").withColumn("__from", F.greatest(zero, F.coalesce("__reach", zero)))
    tail = tail.where(F.col("__from") < F.col(total)).select(*keys, F.col("__from").alias("start"), F.col(total).alias("end"))
    return between.unionByName(tail)


def split_long(gaps: DataFrame, keys: list[str], longest, shortest) -> DataFrame:
    """Gaps of ``shortest`` or more, cut into equal pieces of at most ``longest``; only whole gaps are dropped for length."""
    length = F.col("end") - F.col("start")
    kept = gaps.where(length >= shortest).withColumn("__n", F.greatest(F.lit(1), F.ceil(length / F.lit(longest)).cast("int")))
    kept = kept.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    whole = dict(gaps.dtypes)["start"] in ("bigint", "int")
    at = lambda i: F.col("start") + (F.floor(i * length / F.col("__n")).cast("long") if whole else i * length / F.col("__n"))
    end = F.when(F.col("piece") == F.col("__n") - 1, F.col("end")).otherwise(at(F.col("piece") + 1))
    return kept.select(*keys, F.col("start").alias("gap_start"), "piece", at(F.col("piece")).alias("start"), end.alias("end"))


def slices(intervals: DataFrame, chunks: DataFrame, keys: list[str], width) -> DataFrame:
    """Each interval's part in each chunk (chunk_start, chunk_end), as offsets into the chunk."""
    pairs = overlapping(intervals, chunks, keys, ("start", "end"), ("chunk_start", "chunk_end"), width)
    local = lambda c: c - F.col("chunk_start")
    return pairs.withColumns({"local_start": local(F.greatest("start", "chunk_start")), "local_end": local(F.least("end", "chunk_end"))})


def running_offsets(chunks: DataFrame, keys: list[str], order: list[str], duration: str, ranges: scan.Ranges | None = None) -> DataFrame:
    """Each chunk's start on the common axis: the durations before it, gaps in wall time left out."""
    zero = F.lit(0).cast(dict(chunks.dtypes)[duration])
    if ranges is None or ranges.table is None:
        by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return chunks.withColumn("global_start", F.coalesce(F.sum(duration).over(by), zero))
    rows = scan.carried(ranges.of(chunks, F.col(order[0])), keys, [F.sum(duration).alias("__sum")], {"__before": F.sum("__sum").over(scan.before(keys))}, ranges)
    local = F.sum(duration).over(Window.partitionBy(*keys, scan.RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("global_start", F.coalesce("__before", zero) + F.coalesce(local, zero)).drop("__before", scan.RANGE)


def dropped_spans(chunks: DataFrame, keys: list[str], order: list[str], start: str, duration: str, tolerance, ranges: scan.Ranges | None = None) -> DataFrame:
    """Chunks that don't begin where the one before ended, give or take ``tolerance``."""
    rows = scan.lagged(chunks.withColumn("__end", F.col(start) + F.col(duration)), keys, order, "__end", "__expected", ranges)
    return rows.withColumn("drift", F.col(start) - F.col("__expected")).drop("__end", "__expected", scan.RANGE).where(F.abs("drift") > tolerance)


def cluster_points(points: DataFrame, keys: list[str], at: str, tie: str, window, ranges: scan.Ranges | None = None) -> DataFrame:
    """Single linkage: a new cluster where the gap to the last member is over ``window``."""
    rows = scan.lagged(points, keys, [at, tie], at, "__last", ranges)
    rows = rows.withColumn("__new", F.when(F.col(at) - F.col("__last") <= window, 0).otherwise(1)).drop("__last")
    return scan.running_count(rows, keys, [at, tie], "__new", "cluster", ranges).drop("__new", scan.RANGE)
