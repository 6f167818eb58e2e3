"""Merged intervals over streams, as session windows.

Peaks with equal pads merge when they are at most before + after + gap apart, so a
session window with that gap is the merged interval; its ends are padded afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_intervals(events: DataFrame, keys: list[str], at: str, before: int, after: int, gap: int, watermark: str | None = None) -> DataFrame:
    """start, end and n of each run of events; pads and gap in microseconds.

    ``at`` is a timestamp. Works on batches and streams; a stream in append mode needs a
    watermark and gives sessions once it has passed them.
    """
    if watermark:
        events = events.withWatermark(at, watermark)
    join = before + after + gap
    session = F.session_window(F.col(at), f"{join} microseconds")
    found = events.groupBy(*keys, session.alias("s")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    shift = lambda c, us: F.timestamp_micros(F.unix_micros(c) + us)
    return found.select(*keys, shift("first", -before).alias("start"), shift("last", after).alias("end"), "n")


def stream_intervals(events: DataFrame, keys: list[str], at: str, before: int, after: int, gap: int, watermark: str, path: str, checkpoint: str):
    """Write closed sessions of a stream to Parquet, each once, for all that is there now."""
    out = session_intervals(events, keys, at, before, after, gap, watermark)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
