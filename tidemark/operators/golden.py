"""Reference events from labelled clips: anchors of true clips and times of missed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import offset_seconds
from tidemark.operators.intervals import cluster_points


def strongest(peaks: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The peak with the largest score of each group, the first of equals."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc(), order)
    return peaks.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def missed_times(rows: DataFrame, start: str, notes: str) -> DataFrame:
    """Start plus the offset in the notes, as in "20 seconds"; a missing offset is an error."""
    found = offset_seconds(F.col(notes))
    known = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no offset in notes: "), F.coalesce(F.col(notes), F.lit(""))))).otherwise(found)
    return rows.withColumn("at", F.col(start) + known)


def build_golden(points: DataFrame, keys: list[str], at: str, source: str, window) -> DataFrame:
    """Clusters of points: their mean time and their sources in order of (time, source)."""
    found = cluster_points(points, keys, at, source, window)
    listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(source).alias("s"))))
    out = found.groupBy(*keys, "cluster").agg(F.avg(at).alias("at"), listed.alias("__m"))
    return out.withColumn("sources", F.transform("__m", lambda x: x["s"])).drop("__m")


def contains(at: Column, start: Column, end: Column) -> Column:
    return (start <= at) & (at <= end)
