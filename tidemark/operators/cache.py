"""Keyed caches of expensive results: what is done, what is to do, and writing it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resume(rows: DataFrame, cached: DataFrame, idx: str, identity: dict[str, float], result: str) -> DataFrame:
    """Rows with ``result`` from the cache, null where it is missing or was null.

    ``identity`` are columns that must agree with the cached row of the same idx, numbers
    within the given tolerance; a row that doesn't is an error.
    """
    old = cached.select(F.col(idx).alias("__idx"), *[F.col(c).alias(f"__{c}") for c in identity], F.col(result))
    both = rows.join(old, rows[idx] == old["__idx"], "left")
    wrong = F.lit(False)
    for c, tolerance in identity.items():
        same = F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance if tolerance else F.col(c).eqNullSafe(F.col(f"__{c}"))
        wrong = wrong | ~same
    checked = F.when(F.col("__idx").isNotNull() & wrong, F.raise_error(F.concat(F.lit("cache doesn't match row "), F.col(idx).cast("string")))).otherwise(F.lit(False))
    return both.where(~checked).drop("__idx", *[f"__{c}" for c in identity])


def todo(resumed: DataFrame, result: str) -> DataFrame:
    return resumed.where(F.col(result).isNull())


def upsert(cached: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with new rows in place of those of the same keys; no other row is lost."""
    return cached.join(new, keys, "left_anti").unionByName(new)


def outbox(picks: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """What hasn't been sent or written yet."""
    return picks.join(sent, keys, "left_anti")


def last_of(rows: DataFrame, key: str, idx: str) -> DataFrame:
    """The last row of each key, as of a mapping filled in order."""
    top = rows.groupBy(key).agg(F.max(F.col(idx)).alias(idx))
    return rows.join(top, [key, idx], "left_semi")


def pick(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted rows; wanted keys without a row are an error."""
    both = wanted.select(F.col(key).alias("__want")).join(rows, F.col("__want") == rows[key], "left")
    gone = F.when(rows[key].isNull(), F.raise_error(F.concat(F.lit("no such clip: "), F.col("__want")))).otherwise(F.lit(False))
    return both.where(~gone).drop("__want")
