"""Size-balanced sharding by sampled splitters, in DataFrame operations alone.

Records are ordered by (hash of text, doc_id), so equal texts lie side by side. A sample
of keys is drawn with a chance in proportion to a record's share of the bytes and of the
rows, and its quantiles split the key order into ranges. Every range is then measured
exactly. Ranges that are too full are subdivided by splitters sampled in them alone,
until none is too full or it holds a single key. The shards' ideal borders fall inside a
few ranges; running sums over those ranges find the records at which they are cut. So
shards differ by about one record's size, and a text's copies stay together unless a
border runs through them, however large a group they form.

The sample and the ranges are bounded by the number of ranges, which is chosen so that a
range has about ``rows_per_range`` rows, and is MAX_RANGES (or four a shard) at most; a
range is a task's sort, which can spill. The only rows on the driver are the sample, the
splitters and the ranges' totals.

Nulls and odd input: a null text has 0 bytes and the checksum of the empty text; every
record counts 1 byte more than its text. A null doc_id sorts first. Rows that share text
and doc_id are told apart by a running number only. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.runtime import Workspace, prepare

ROWS_PER_RANGE, MAX_RANGES = 2048, 1 << 14
OVERSAMPLE = 16
KEY = ("h", "id")


def _key(row) -> tuple[int, int]:
    return row["h"], row["id"]


def _longs(values) -> Column:
    """A constant array, built as one literal rather than as an expression a value."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many of the sorted splitters are at or below a row's (h, id), by binary search."""
    if not splitters:
        return F.lit(0)
    high, low, n = _longs(k[0] for k in splitters), _longs(k[1] for k in splitters), len(splitters)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    reached = lambda p: (F.get(high, p - 1) < F.col("h")) | ((F.get(high, p - 1) == F.col("h")) & (F.get(low, p - 1) <= F.col("id")))
    take = lambda p, s: F.when((p + s <= n) & reached(p + s), p + s).otherwise(p)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), take)


def _uniform(salt: str) -> Column:
    return F.pmod(F.xxhash64("h", "id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def _quantiles(keys: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * k // n] for k in range(1, n)} - {keys[0]}) if keys else []


def measure(base: DataFrame, splitters: list[tuple[int, int]]) -> list:
    """Exact bytes, rows and keys of each range, in order."""
    totals = base.groupBy(range_of(splitters).alias("range"))
    return sorted(totals.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last")).collect(), key=lambda r: r["range"])


def split_ranges(base: DataFrame, n_ranges: int, total: int, rows: int) -> list[tuple[int, int]]:
    """Splitters of about n_ranges ranges, none of them overfull unless it is one key."""
    load = F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)  # shares of bytes and rows: 2 in all
    drawn = base.where(_uniform("first") < load * (n_ranges * OVERSAMPLE / 2)).select(*KEY).collect()
    splitters = _quantiles([_key(r) for r in drawn], n_ranges)
    for attempt in range(8):
        share = lambda r: r["bytes"] / total + r["rows"] / rows
        found = measure(base, splitters)
        full = [r for r in found if share(r) > 4 / n_ranges and r["first"] != r["last"]]
        if not full:
            break
        chance = F.least(F.lit(1.0), load * (n_ranges * OVERSAMPLE / 2))
        inside = base.withColumn("range", range_of(splitters)).where(F.col("range").isin([r["range"] for r in full]))
        more: dict[int, list] = {r["range"]: [] for r in full}
        for r in inside.where(_uniform(f"again-{attempt}") < chance).select("range", *KEY).collect():
            more[r["range"]].append(_key(r))
        for r in full:
            more[r["range"]] = _quantiles([_key(r["first"]), *more[r["range"]], _key(r["last"])], max(2, round(share(r) * n_ranges / 2)))
        new = sorted({*splitters, *(k for keys in more.values() for k in keys)})
        if new == splitters:
            break
        splitters = new
    return splitters


def shard(docs: DataFrame, n_shards: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, shards near equal in bytes."""
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = work.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id")),
        "base",
    )
    sums = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()[0]
    total, rows = sums["bytes"], sums["rows"]
    if not rows:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    splitters = split_ranges(base, max(4 * n_shards, min(MAX_RANGES, -(-rows // rows_per_range))), total, rows)
    found = measure(base, splitters)

    # Each border between shards falls into a range; its record is the first at which the
    # running sum of bytes passes the border.
    edges, below = [], 0
    for r in found:
        for s in range(1, n_shards):
            if below < total * s / n_shards <= below + r["bytes"]:
                edges.append((r["range"], s, total * s / n_shards - below))
        below += r["bytes"]
    border: dict[int, tuple[int, int] | None] = {}
    if edges:
        wanted = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(s).alias("shard"), F.lit(float(x)).alias("at")) for r, s, x in edges])
        inside = base.withColumn("range", range_of(splitters)).where(F.col("range").isin(sorted({e[0] for e in edges})))
        order = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
        inside = inside.withColumn("sum", F.sum("size").over(order)).withColumn("edge", F.explode(wanted)).where("edge.range = range and sum - size / 2 >= edge.at")
        for r in inside.groupBy("edge.shard").agg(F.min(F.struct(*KEY)).alias("first")).collect():
            border[r["shard"]] = _key(r["first"])
    tops, later = [], {r["range"]: _key(r["first"]) for r in found}
    ranges = [r["range"] for r in found]
    for r, s, _ in edges:  # a border after a range's last middle is the next range's first key
        after = [later[x] for x in ranges if x > r]
        tops.append(border.get(s) or (after[0] if after else None))
    tops = sorted({t for t in tops if t is not None})
    final = sorted({*splitters, *tops})
    placed = measure(base, final)
    shard_of, start, seen = {}, {}, {}
    for r in placed:
        s = sum(t <= _key(r["first"]) for t in tops)
        shard_of[r["range"]], start[r["range"]] = s, seen.get(s, 0)
        seen[s] = seen.get(s, 0) + r["rows"]
    n = len(final) + 1
    order = Window.partitionBy("range").orderBy(*KEY)
    out = base.withColumn("range", range_of(final)).withColumn("at", F.row_number().over(order) - 1)
    lookup = lambda d: F.get(_longs(d.get(k, 0) for k in range(n)), F.col("range"))
    return out.select("doc_id", "size", "text_crc32", lookup(shard_of).cast("int").alias("shard"), (lookup(start) + F.col("at")).alias("slot"))
