"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document longer than the capacity is cut into full pieces, its first piece taking the
rest. Pieces are then placed in bulk-synchronous rounds, the longest first: a round takes
the lengths of which equally many fit into a sequence, down to short ones by halves.

A round cuts the open sequences' gaps, the smallest first, into slots that hold any piece
of the round, as many as it has pieces, and smaller ones of what is left of a gap. It
sorts slots and pieces together by size, downwards. One sweep over that order gives every
piece its successor, the smallest slot that is large enough and not taken by a longer
piece: counting slots up and pieces down, the two meet at one depth, as brackets do. The
sweep is distributed: counts by size, and running sums of blocks of each size, give every
row its depth; rows are then dealt by depth, of which one holds two rows a size at most.
Many pieces that want the same slots are told apart by their ranks. Pieces without a slot
open sequences, as many in each as fit, also by rank. Gaps are updated, and the next round
begins. What the driver sees are counts by size, capacity of pieces and capacity of gaps.

Nulls and odd input: a null text is empty, and an empty document is the end token alone.
Rows that share a doc_id are packed each on their own; equal rows take each other's place
freely. No text, or an empty table, gives no row.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import Workspace, prepare

CAPACITY, END_ID = 1024, 2
CACHE = 400_000
BLOCK_ROWS = 128  # rows of one size that are ranked together
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_BESIDE = ["  ", *(" " + c for c in _BLANKS), *(c + " " for c in _BLANKS)]
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """A byte-level BPE tokenizer file's ids as little-endian 32-bit bytes.

    Texts are split before every single space that stands between characters which are
    not blanks. The tokenizer's own pattern always splits there, so the parts' ids can be
    looked up one by one. The encoder is itself the table of the parts that follow a
    space; it is emptied when full. A text with other blanks beside a space is encoded
    whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], {x["content"]: x["id"] for x in file.get("added_tokens") or []}
        self._added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        self._encode = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in added}, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        found = self._whole(" " + part)
        if len(part) < 64:
            self[part] = found
        return found

    def ids(self, text: str) -> bytes:
        """A text's ids; the file's added tokens are one id each, and cut the text."""
        if self._cut is not None and any(x in text for x in self._added):
            return b"".join(self._added[x] if x in self._added else self._parts(x) for x in self._cut.split(text) if x)
        return self._parts(text)

    def _parts(self, text: str) -> bytes:
        if any(x in text for x in _BESIDE) or not text.isascii() and any(x in text for x in _WIDE) or text[:1] == " " or text[-1:] == " ":
            return self._whole(text)
        if len(self) > CACHE:
            self.clear()
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self.__getitem__, rest))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: where it starts, its length and its ids' CRC-32."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            ids, which, numbers, starts, lengths, crcs = batch.column("doc_id"), [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                data = encoder.ids(text.as_py() or "") + end
                n = len(data) // 4
                start = 0
                for number in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if number == 0 else capacity
                    which.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(data[4 * start : 4 * (start + length)]))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(which, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def rounds(capacity: int) -> list[int]:
    """The longest length of each round, downwards: capacity / 1, / 2, ... / 6, then halves."""
    out = sorted({capacity // k for k in range(1, 7)} - {0}, reverse=True)
    while out[-1] > 1:
        out.append(max(1, out[-1] // 2))
    return out


def slots(gaps: dict[int, int], low: int, high: int, pieces: int) -> dict[int, list[int]]:
    """By gap, the sizes of its slots: each holds any piece of low + 1 to high, or one up to its own size.

    ``gaps`` says how many there are of each; they are cut up from the smallest on until
    the slots that hold any piece are as many as the pieces.
    """
    out: dict[int, list[int]] = {}
    for gap in sorted(g for g in gaps if g > low):
        if pieces <= 0:
            break
        n, rest = divmod(gap, high)
        sizes = [rest] + [high] * n if rest > low else [high] * (n - 1) + [high + rest]
        out[gap] = sizes[: -(-pieces // gaps[gap]) + (rest > low)]
        pieces -= gaps[gap] * sum(x >= high for x in out[gap])
    return out


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32), of 1 to ``capacity`` tokens."""
    spark = found.sparkSession
    work = Workspace(spark, "packing")
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    found = work.save(found, "pieces")
    lengths = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    gaps, placed, opened, tops = None, None, 0, rounds(capacity)
    for k, high in enumerate(tops):
        low = tops[k + 1] if k + 1 < len(tops) else 0
        if not any(low < n <= high for n in lengths):
            continue
        here = found.where((F.col("length") > low) & (F.col("length") <= high))
        blank = [F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in found.columns]
        rows = here.select("*", F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("slot"))
        counts = Counter({(n, 1): c for n, c in lengths.items() if low < n <= high})
        if gaps is not None:
            held = {r["gap"]: r["count"] for r in gaps.groupBy("gap").count().collect()}  # capacity rows at most
            cut = slots(held, low, high, sum(counts.values()))
            for gap, sizes in cut.items():
                counts.update({(size, 0): n * held[gap] for size, n in Counter(sizes).items()})
            sizes = spark.createDataFrame(list(cut.items()), "gap long, sizes array<long>")
            parts = gaps.join(F.broadcast(sizes), "gap").select("seq", F.posexplode("sizes").alias("slot", "size"))
            rows = parts.select(*blank, "size", F.lit(0).alias("kind"), "seq", "slot").unionByName(rows)
        base, depth, deepest = [], 0, 0
        for size, kind in sorted(counts, key=lambda x: (-x[0], x[1])):
            n = counts[size, kind]
            base.append((size, kind, depth, -(-n // BLOCK_ROWS)))
            depth += -n if kind else n
            deepest = min(deepest, depth)
        ranked = _ranked(rows, spark.createDataFrame(base, "size long, kind int, base long, blocks long"), keys, max(x[3] for x in base) > 1)
        fit = capacity // high
        if any(kind == 0 for _, kind in counts):
            sweep = Window.partitionBy("depth").orderBy(F.desc("size"), "kind")
            ranked = ranked.withColumn("by", F.lag("seq").over(sweep)).where("kind = 1")
        else:
            ranked = ranked.withColumn("by", F.lit(None).cast("long"))
        fresh = opened + F.floor(-F.col("depth") / fit)
        ranked = ranked.withColumns({"sequence_id": F.coalesce("by", fresh), "first": F.col("by").isNull() & (F.pmod(-F.col("depth"), F.lit(fit)) == 0)})
        one = work.save(ranked.select(*found.columns, "sequence_id", "first", F.lit(k).alias("round")), f"placed-{k}")
        opened += -(-(-deepest) // fit)
        placed = one if placed is None else placed.unionByName(one)
        left = [n for n in lengths if n <= low]
        if left:
            change = one.select(F.col("sequence_id").alias("seq"), (F.when(F.col("first"), capacity).otherwise(0) - F.col("length")).alias("gap"))
            change = change if gaps is None else change.unionByName(gaps)
            gaps = work.save(change.groupBy("seq").agg(F.sum("gap").alias("gap")).where(F.col("gap") >= min(left)), f"gaps-{k}")
    if placed is None:
        return found.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    inside = Window.partitionBy("sequence_id").orderBy("round", F.desc("length"), *keys).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return out.select(*found.columns, "sequence_id", "offset")


def _ranked(rows: DataFrame, base: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """Rows with their depth in the order of size, slots before pieces, and rank.

    Rows of one size are ranked in blocks by hash, so that no size is gathered in one
    task; the blocks' running counts are joined where a size has more than one.
    """
    rows = rows.join(F.broadcast(base), ["size", "kind"])  # 2 x capacity rows at most
    rows = rows.withColumn("block", F.pmod(F.xxhash64("seq", "slot", *keys), F.col("blocks")))
    order = Window.partitionBy("size", "kind", "block").orderBy("seq", "slot", *keys)
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if large:
        earlier = Window.partitionBy("size", "kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy("size", "kind", "block").count()
        blocks = blocks.select("size", "kind", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
        ranked = ranked.join(blocks, ["size", "kind", "block"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    return ranked.withColumn("depth", F.when(F.col("kind") == 0, F.col("base") + F.col("rank")).otherwise(F.col("base") - F.col("rank") + 1))
