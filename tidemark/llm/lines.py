"""Incremental, reversible line dedup.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
lower-cased; keys under ``min_chars`` code points don't count. The index has ``refs`` (key,
document, line number), an exact table ``counts`` (key, number of references, smallest and
largest document, level) and, by shards of the keys' hashes, cuckoo filters of the live
keys.

An insertion first probes the filters: keys that they don't know are new. Only those that
they may know are joined with ``counts``; the ones that it doesn't hold either are new as
well. New keys, and no others, then go into the filters, and ``counts`` keeps the table
(level) that took each. A deletion counts a document's references off, looks for new
smallest and largest documents where they went, and takes keys without a reference out of
the table that has them. So every live key has one fingerprint of its own.

Tables grow by what changes: an insertion appends its refs and the new state of its keys,
a deletion appends a tombstone for each document and the state of its keys. The latest
version of a key holds. After COMPACT changes, or when shards have over SHARD_KEYS keys on
average, tables are rewritten and the keys dealt to as many shards as they then need.

Nulls: a null text is one empty line; lines of rows with a null doc_id neither count nor
go. Rows that share a doc_id are one document. Documents that are in the index already
are replaced by an insertion. Columns of the input stay; ``text``, ``n_lines`` and
``n_dropped`` are set by the operator, also where the input has columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cuckoo import CuckooFilter
from tidemark.llm.runtime import Workspace, input_bytes, partitions, prepare

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10

SHARD_KEYS, COMPACT = 400_000, 8
#: A key is hot with more than this part of all references, so there are no more hot keys than that.
HOT_PART = 4096

_KEYS = "h1 long, h2 long, n_refs long, keeper long, last long"
_COUNTS = f"{_KEYS}, level int, version int"
_PROBED = f"{_KEYS}, seen boolean"
_PUT = f"{_KEYS}, level int, shard int, tables array<binary>"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _filter(kept: pa.Table) -> CuckooFilter:
    return CuckooFilter.load(kept["tables"][0].as_py() if len(kept) else [])


def _hashes(keys: pa.Table) -> np.ndarray:
    return keys["h1"].to_numpy().view(np.uint64) if len(keys) else np.zeros(0, np.uint64)


def _shard(kept: pa.Table, keys: pa.Table) -> int:
    return (kept if len(kept) else keys)["shard"][0].as_py()


def _probe(kept: pa.Table, keys: pa.Table) -> pa.Table:
    """One shard: which keys the filter may know."""
    if not len(keys):
        return pa.table({"h1": [], "h2": [], "n_refs": [], "keeper": [], "last": [], "seen": []}, pa.schema([*[(c, pa.int64()) for c in ("h1", "h2", "n_refs", "keeper", "last")], ("seen", pa.bool_())]))
    return keys.select(["h1", "h2", "n_refs", "keeper", "last"]).append_column("seen", pa.array(_filter(kept).contains(_hashes(keys))))


def _put(kept: pa.Table, keys: pa.Table) -> pa.Table:
    """One shard: the filter with new keys put in, and each one's level."""
    own = _filter(kept)
    return _with_filter(keys, own.insert(_hashes(keys)), _shard(kept, keys), own)


def _take(kept: pa.Table, keys: pa.Table) -> pa.Table:
    """One shard: the filter without keys that are dead."""
    own = _filter(kept)
    if len(keys):
        own.delete(_hashes(keys), keys["level"].to_numpy())
    return _with_filter(keys.slice(0, 0), np.zeros(0, np.int32), _shard(kept, keys), own)


def _with_filter(keys: pa.Table, level: np.ndarray, shard: int, own: CuckooFilter) -> pa.Table:
    n = len(keys)
    columns = {c: pa.chunked_array([*(keys[c].cast(pa.int64()).chunks if n else []), pa.nulls(1, pa.int64())], pa.int64()) for c in ("h1", "h2", "n_refs", "keeper", "last")}
    columns["level"] = pa.array([*level.tolist(), None], pa.int32())
    columns["shard"] = pa.array([None] * n + [shard], pa.int32())
    columns["tables"] = pa.array([None] * n + [own.dump()], pa.list_(pa.binary()))
    return pa.table(columns)


def _strike(text: pa.Array, lines: pa.Array) -> pa.Array:
    """The texts without the lines of the given numbers."""

    def one(t, gone):
        if t is None or gone is None:
            return None
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pa.array([one(t.as_py(), g.as_py()) for t, g in zip(text, lines)], pa.string())


class LineIndex:
    """The state of line dedup over documents inserted and deleted in batches."""

    def __init__(self, spark: SparkSession, n_shards: int = 64, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        prepare(spark)
        self.spark, self.n_shards, self.min_chars, self.shard_keys = spark, n_shards, min_chars, shard_keys
        self.work, self.version, self.changes = Workspace(spark, "lines"), 0, 0
        self.refs = self.tombstones = self.counts = self.filters = None

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        return self.work.save(df, f"{name}-{self.version}")

    def _drop(self, *names: str) -> None:
        for name in names:
            self.work.drop(f"{name}-{self.version}")

    def occurrences(self, docs: DataFrame) -> DataFrame:
        """A row for each line with a key: two 64-bit hashes of the key, one of the text, the line's number."""
        text = F.coalesce("text", F.lit(""))
        lines = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
        keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= self.min_chars)
        return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "tag", "at", F.lit(self.version).alias("version"))

    def _step(self, keys: DataFrame, step, schema: str) -> DataFrame:
        """Run a step on each shard's filter and keys."""
        own = keys.withColumn("shard", F.pmod("h1", F.lit(self.n_shards)).cast("int"))
        kept = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, tables array<binary>")
        return kept.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(step, schema)

    def _refit(self, stepped: DataFrame) -> DataFrame:
        """Take the new filters out of a step's result; what is left are the keys."""
        self.filters = stepped.where("tables is not null").select("shard", "tables")
        return stepped.where("tables is null").drop("shard", "tables")

    def _live_refs(self) -> DataFrame:
        if self.tombstones is None:
            return self.refs
        r, t = self.refs, self.tombstones.select(F.col("doc_id").alias("id"), F.col("version").alias("until"))
        return r.join(t, (r["doc_id"] == t["id"]) & (r["version"] < t["until"]), "left_anti")

    def _refs_of(self, keys: DataFrame, *columns: str) -> DataFrame:
        """The live references of some keys (h1, h2, n_refs), with columns of theirs.

        Hot keys, HOT_PART at most, are broadcast; a common line's references stay where they are.
        """
        refs, n = self._live_refs(), keys.agg(F.sum("n_refs")).first()[0] or 0
        is_hot = F.col("n_refs") * HOT_PART > n
        hot, rest = (keys.where(own).select("h1", "h2", *columns) for own in (is_hot, ~is_hot))
        cold = refs.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"])
        return refs.join(F.broadcast(hot), ["h1", "h2"]).unionByName(cold)

    def live(self) -> DataFrame:
        """h1, h2, n_refs, keeper, last, level: each live key's latest state."""
        if self.changes <= 1:
            return self.counts.drop("version")
        state = F.max(F.struct("version", "n_refs", "keeper", "last", "level")).alias("s")
        return self.counts.groupBy("h1", "h2").agg(state).select("h1", "h2", "s.n_refs", "s.keeper", "s.last", "s.level").where("n_refs > 0")

    def _append(self, keys: DataFrame) -> None:
        rows = keys.select("h1", "h2", "n_refs", "keeper", "last", "level", F.lit(self.version).alias("version"))
        self.counts = rows if self.counts is None else self.counts.unionByName(rows)
        self.changes += 1

    def insert(self, docs: DataFrame) -> None:
        """Add documents; those that are in already are replaced."""
        if self.refs is not None:
            ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
            self.delete(self._live_refs().join(ids, "doc_id", "left_semi").select("doc_id"))
        self.version += 1
        new = self._save(self.occurrences(docs), "refs")
        batch = new.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_refs"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        if self.refs is None:
            self._append(self._refit(self._save(self._step(batch, _put, _PUT), "put")))
            self.refs = new
        else:
            rows = self._save(self._step(batch, _probe, _PROBED), "probed")
            old = self.live().select("h1", "h2", *[F.col(c).alias(f"old_{c}") for c in ("n_refs", "keeper", "last")], "level")
            maybe = self._save(rows.where("seen").drop("seen").join(old, ["h1", "h2"], "left"), "maybe")
            fresh = rows.where("not seen").drop("seen").unionByName(maybe.where("level is null").select("h1", "h2", "n_refs", "keeper", "last"))
            put = self._refit(self._save(self._step(fresh, _put, _PUT), "put"))
            more = maybe.where("level is not null").select("h1", "h2", (F.col("n_refs") + F.col("old_n_refs")).alias("n_refs"), F.least("keeper", "old_keeper").alias("keeper"), F.greatest("last", "old_last").alias("last"), "level")
            self._append(self._save(put.unionByName(more), "counts"))
            self._drop("probed", "maybe")
            self.refs = self.refs.unionByName(new)
        self._settle()

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out as if they had never come in; ``doc_ids`` has a column doc_id."""
        if self.refs is None:
            return
        self.version += 1
        ids = self._save(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
        if ids.isEmpty():
            return
        gone = self._live_refs().join(ids, "doc_id", "left_semi").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_gone"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        state = self._save(gone.join(self.live(), ["h1", "h2"]).withColumn("n_refs", F.col("n_refs") - F.col("n_gone")), "state")
        if state.isEmpty():
            return
        dead = ids.withColumn("version", F.lit(self.version))
        self.tombstones = dead if self.tombstones is None else self.tombstones.unionByName(dead)
        # Keys whose smallest or largest document went look for it among the references left.
        ends = state.where("n_refs > 0 and (low = keeper or high = last)").select("h1", "h2", "n_refs")
        ends = self._refs_of(ends).groupBy("h1", "h2").agg(F.min("doc_id").alias("new_keeper"), F.max("doc_id").alias("new_last"))
        found = state.join(ends, ["h1", "h2"], "left").select("h1", "h2", "n_refs", F.coalesce("new_keeper", "keeper").alias("keeper"), F.coalesce("new_last", "last").alias("last"), "level")
        found = self._save(found, "counts")
        self._refit(self._save(self._step(found.where("n_refs = 0"), _take, _PUT), "put"))
        self._append(found)
        self._drop("state")
        self._settle()

    def _settle(self) -> None:
        """Compact the tables when that is due."""
        keys = self.counts.count()
        if self.changes > COMPACT or keys > self.shard_keys * self.n_shards:
            self.compact(max(self.n_shards, 2 * -(-keys // self.shard_keys)))

    def compact(self, n_shards: int) -> None:
        """Rewrite the tables without what is dead, and deal the keys to ``n_shards`` new filters."""
        self.version += 1
        refs, keys = self._save(self._live_refs(), "refs"), self._save(self.live(), "live")
        self.n_shards, self.filters, self.refs, self.tombstones = n_shards, None, refs, None
        self.counts, self.changes = None, 0
        self._append(self._refit(self._save(self._step(keys.drop("level"), _put, _PUT), "put")))

    def repeated(self) -> DataFrame:
        """The lines to drop, by document and text: those of keys in two documents or more, but for the smallest doc_id's."""
        shared = self._save(self.live().where("keeper != last").select("h1", "h2", "n_refs", "keeper"), "shared")
        hits = self._refs_of(shared, "keeper").where("doc_id != keeper")
        return hits.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("gone"))

    def strike(self, docs: DataFrame) -> DataFrame:
        """The documents without their repeated lines, which must be in the index."""
        if self.refs is None:
            self.insert(docs.limit(0))
        gone = self.repeated().select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("gone").alias("__gone"))
        text = F.coalesce("text", F.lit(""))
        both = docs.withColumn("__own", F.xxhash64(text))
        both = both.join(gone, (both["doc_id"] == gone["__id"]) & (both["__own"] == gone["__tag"]), "left")
        struck = F.arrow_udf(_strike, "string")(F.when(F.col("__gone").isNotNull(), text), F.col("__gone"))
        both = both.withColumns({"n_lines": (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
        both = both.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(struck))
        return both.drop("__id", "__tag", "__own", "__gone")


def line_index(docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
    """An empty index with shards for documents like these."""
    spark = docs.sparkSession
    return LineIndex(spark, max(64, partitions(spark, input_bytes(docs), 16 << 20)), min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop every line whose key a document with a smaller doc_id also holds."""
    index = line_index(docs, min_chars)
    index.insert(docs)
    return index.strike(docs)
