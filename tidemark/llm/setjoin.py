"""Jaccard self-join of word-shingle sets by universe partition, and its components.

A document's set is its distinct five-word shingles, as 64-bit hashes. Two sets of sizes
p <= q with Jaccard similarity of at least t differ in at most
k = floor((p + q) * (1 - t) / (1 + t)) members. Sizes fall into bands whose ends grow by
1 / t, so linked sets are in one band or in two adjacent ones; scheme b serves pairs
within band b and between bands b and b + 1. It hashes members into segments, a partition
of the universe. By the pigeonhole principle segments that may each hold v differences,
v + 1 summing to more than k, include one with at most v:

* with v = 0, m = k + 1 + 2s segments leave 2s + 1 equal ones at least, so that each side
  may leave out the s segments that cost most and still share one;
* with v = 1, ceil((k + 1) / 2) segments do; a segment is entered whole and without each
  of its members in turn, so that one deletion on either side meets.

Each scheme takes the cheaper by a cost model: entries made, plus a charge for segments
that will have under two members, which collide most. Segments left out are those with
the fewest members, empty ones first. Each document makes entries for its own scheme and
the one below.

Entries go to shards by hash as packed blocks. A shard sorts its entries into buckets,
drops those with one document and buckets with the same documents as another. Parity
bitmaps of twice a set's size bound the difference of two sets from below; pairs that
they rule out go no further. Links are then verified exactly, on whole sets, in rounds: each bucket has a
hub, members of other components are compared with the hub with which they share most
buckets, components grow, and buckets that lie in one component
are done with. Buckets left after these rounds give all their pairs across components
that no bitmap rules out. So every pair that shares a bucket is compared or known to be connected, and a group of
many near copies costs a comparison with a hub each rather than all pairs.

Nulls and odd input: a null text, and one without words, has no set and links with
nothing. Documents of 1 to 4 words have one shingle, all their words. Texts with equal
sets are one class and are compared once. Rows that share a doc_id are joined through it.
A null doc_id stands for itself and links with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import Workspace, input_bytes, partitions, prepare, settle, shard_labels
from tidemark.llm.textkit import U, blocks, distinct, mix, raw, shingles, unzipped, words, zipped

WIDTH, PERCENT = 5, 80
SPLIT = 256  # a bucket's documents are handed on in lists of this length
FLUSH = 1_000_000  # entries a task gathers before it packs them
HUB_ROUNDS, FEW_PAIRS = 4, 8
CHUNK = 4096  # rows of a bucket that are held against each other at once
GROUP = 64  # comparisons with one hub that are made together
BROADCAST_ROWS = 50_000  # large buckets that may be broadcast; more are joined by shuffle

_ENTRY = np.dtype([("sig", "<u8"), ("id", "<i8")])
_INFO = np.dtype([("id", "<i8"), ("n", "<i8"), ("a", "<u8"), ("b", "<u8"), ("words", "<i4")])


@dataclass(frozen=True)
class Scheme:
    """How sets of a band and the next are entered: segments, deletions, segments left out."""

    segments: int
    deletions: bool
    skip: int


def bands(limit: int, percent: int = PERCENT) -> list[int]:
    """First sizes of the bands up to a size."""
    out = [1]
    while out[-1] <= limit:
        out.append(out[-1] * 100 // percent + 1)
    return out


def scheme(low: int, high: int, percent: int = PERCENT) -> Scheme:
    """The cheaper scheme for pairs whose smaller set has low to high members."""
    k = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    size = (low + high) / 2
    options = []
    for skip in {0 if k == 0 else 1, -(-k // 20), -(-k // 10)}:
        m = k + 1 + 2 * skip if k else 1
        t = size / m
        thin = np.exp(-t) * (1 + t)
        options.append((m - skip + 8 * thin * (m - skip), Scheme(m, False, skip if k else 0)))
    m = (k + 2) // 2
    options.append((m + size, Scheme(m, True, 0)))
    return min(options, key=lambda x: x[0])[1]


def entries(values: np.ndarray, at: np.ndarray, ids: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The index entries (sig, id) of documents' distinct shingles."""
    size = np.diff(at)
    if not len(values):
        return np.zeros(0, _ENTRY)
    starts = bands(int(size.max()), percent)
    own = np.searchsorted(starts, size, "right") - 1
    out = []
    for b in np.unique(np.concatenate([own[size > 0], own[size > 0] - 1])):
        if b < 0:
            continue
        plan = scheme(starts[b], starts[b + 1] - 1 if b + 1 < len(starts) else starts[b] * 100 // percent, percent)
        docs = np.flatnonzero((size > 0) & ((own == b) | (own == b + 1)))
        n = size[docs]
        doc = np.repeat(np.arange(len(docs)), n)
        tokens = values[np.repeat(at[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        spread = mix(tokens ^ mix(np.full(1, int(b) + 1, U)))
        m = plan.segments
        segment = doc * m + (((spread >> U(32)) * U(m)) >> U(32)).astype(np.int64)
        cells = len(docs) * m
        # Sums modulo 2**64 in two exact halves; a segment's members are far under 2**21.
        low = np.bincount(segment, (spread & U(0xFFFFFFFF)).astype(np.float64), cells).astype(U)
        high = np.bincount(segment, (spread >> U(32)).astype(np.float64), cells).astype(U)
        total = low + (high << U(32))
        tag = mix((np.arange(cells) % m).astype(U) + U((int(b) + 1) << 32))
        keep = np.ones(cells, bool)
        if plan.skip:
            count = np.bincount(segment, minlength=cells)
            order = np.lexsort((tag, count, np.arange(cells) // m))
            keep[order.reshape(len(docs), m)[:, : plan.skip].ravel()] = False
        out.append((mix(total[keep]) ^ tag[keep], np.repeat(ids[docs], m)[keep]))
        if plan.deletions:
            out.append((mix(total[segment] - spread) ^ tag[segment], ids[docs][doc]))
    found = np.empty(sum(len(s) for s, _ in out), _ENTRY)
    found["sig"] = mix(np.concatenate([s for s, _ in out]))
    found["id"] = np.concatenate([i for _, i in out])
    return found


def doc_sets(text, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of the texts of an Arrow column, and document offsets."""
    data, offsets = raw(text)
    values, counts = [], []
    for lo, hi in blocks(offsets):
        d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        _, _, h, at = words(d, o)
        v, q = distinct(*shingles(h, at, width))
        values.append(v)
        counts.append(np.diff(q))
    if not values:
        return np.zeros(0, U), np.zeros(len(text) + 1, np.int64)
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def bitmaps(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's parities: bit i is whether an odd number of members fall to i.

    Two sets differ in at least as many members as their bitmaps do in bits. A bitmap has
    a power of two of bits, twice the set's size or more, and halves fold onto each other.
    Returned are all 64-bit words, and how many each set has.
    """
    size = np.diff(at)
    n = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64).clip(0))
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(size)), size)
    spread = mix(values + U(991))
    bit = (spread & (n[doc].astype(U) * U(64) - U(1))).astype(np.int64) + 64 * first[:-1][doc]
    odd = (np.bincount(bit, minlength=64 * first[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), n


def _packed(rows: np.ndarray, key: np.ndarray, kind: int, shards: np.ndarray):
    """Rows cut up by shard, a record batch of (kind, shard, payload)."""
    to = (key >> U(33)) % U(len(shards))
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else np.zeros(1, int)
    parts = [rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array(shards[to[cut[:-1]].astype(int)] if parts else [], pa.int64()), pa.array(parts, pa.binary())], ["kind", "shard", "payload"])


def _with_bitmaps(info: np.ndarray, bits: np.ndarray, shards: np.ndarray):
    """Blocks of set hashes by shard (kind 0), their bitmaps behind them."""
    first = np.concatenate([[0], np.cumsum(info["words"])])
    to = ((info["a"] >> U(33)) % U(len(shards))).astype(np.int64)
    found = []
    for shard in np.unique(to):
        own = np.flatnonzero(to == shard)
        found.append((shard, info[own].tobytes() + b"".join(bits[first[i] : first[i + 1]].tobytes() for i in own), len(own)))
    payload = [n.to_bytes(8, "little") + blob for _, blob, n in found]
    return pa.RecordBatch.from_arrays([pa.array([0] * len(found), pa.int32()), pa.array([int(shards[x]) for x, _, _ in found], pa.int64()), pa.array(payload, pa.binary())], ["kind", "shard", "payload"])


def _scan(width: int, percent: int, shards: np.ndarray):
    def scan(batches):
        held, n = [], 0
        for batch in batches:
            every, text = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("text")
            infos, maps, seen = [], [], set()
            for start, stop in blocks(raw(text)[1]):
                ids = every[start:stop]
                values, at = doc_sets(text.slice(start, stop - start), width)
                info = np.zeros(len(ids), _INFO)
                info["id"], info["n"] = ids, np.diff(at)
                for c, spread in (("a", mix(values)), ("b", mix(values + U(77)))):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(spread)])
                    info[c] = mix(sums[at[1:]] - sums[at[:-1]])
                bits, info["words"] = bitmaps(values, at)
                infos.append(info)
                maps.append(bits)
                first = []  # a set is entered once a batch
                for i, key in enumerate(zip(info["a"].tolist(), info["b"].tolist())):
                    if key not in seen:
                        seen.add(key)
                        first.append(i)
                for lo in range(0, len(first), 256):
                    own = first[lo : lo + 256]
                    take = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
                    held.append(entries(values[take], np.concatenate([[0], np.cumsum(np.diff(at)[own])]), ids[own], percent))
                    n += len(held[-1])
                    if n >= FLUSH:
                        rows = np.concatenate(held)
                        yield _packed(rows, rows["sig"], 1, shards)
                        held, n = [], 0
            if infos:
                yield _with_bitmaps(np.concatenate(infos), np.concatenate(maps), shards)
        if n:
            rows = np.concatenate(held)
            yield _packed(rows, rows["sig"], 1, shards)

    return scan


_SHARD = "id long, n long, a long, b long, bits binary, bucket long, members array<long>"


def _shard(batches):
    """A partition's blocks: documents' set hashes, and the buckets of two documents or more."""
    parts: list[bytes] = []
    for batch in batches:
        kinds, payloads = batch.column("kind").to_numpy(), batch.column("payload")
        for i in np.flatnonzero(kinds == 0):
            blob = payloads[int(i)].as_py()
            info = np.frombuffer(blob, _INFO, int.from_bytes(blob[:8], "little"), 8)
            yield _shard_rows(info=info, bits=blob[8 + info.nbytes :])
        parts += [payloads[int(i)].as_py() for i in np.flatnonzero(kinds == 1)]
    rows = np.frombuffer(b"".join(parts), _ENTRY)
    del parts
    rows = rows[np.argsort(rows["sig"], kind="stable")]
    sig = rows["sig"]
    new = np.ones(len(sig) + 1, bool)
    new[1:-1] = sig[1:] != sig[:-1]
    edge = np.flatnonzero(new)
    many = np.flatnonzero(np.diff(edge) > 1)
    seen, lists, names = set(), [], []
    for k in many:
        ids = np.unique(rows["id"][edge[k] : edge[k + 1]])
        if len(ids) < 2:
            continue
        name = ids.tobytes()
        if name in seen:
            continue
        seen.add(name)
        bucket = int(mix(mix(ids.astype(U)).sum(keepdims=True) + U(len(ids))).view(np.int64)[0])
        for lo in range(0, len(ids), SPLIT):
            lists.append(ids[lo : lo + SPLIT])
            names.append(bucket)
        if len(lists) >= 20_000:
            yield _shard_rows(lists=lists, names=names)
            lists, names = [], []
    yield _shard_rows(lists=lists, names=names)


def _shard_rows(info=None, bits=b"", lists=(), names=()):
    n, m = 0 if info is None else len(info), len(lists)
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())
    own = [long(info[c]) if n else pa.array([], pa.int64()) for c in ("id", "n", "a", "b")]
    own = [pa.concat_arrays([c, pa.nulls(m, pa.int64())]) for c in own]
    edge = np.concatenate([[0], np.cumsum(info["words"].astype(int))]) * 8 if n else [0]
    maps = pa.array([*(bits[x:y] for x, y in zip(edge[:-1], edge[1:])), *[None] * m], pa.binary())
    members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32()), pa.array(np.concatenate(lists) if m else [], pa.int64()))
    return pa.RecordBatch.from_arrays([*own, maps, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(names, pa.int64())]), pa.concat_arrays([pa.nulls(n, members.type), members])], ["id", "n", "a", "b", "bits", "bucket", "members"])


def _fold(words: np.ndarray, n: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def may_link(sizes: np.ndarray, maps: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs whose sizes or bitmaps rule out a link."""
    p, q = sizes[i], sizes[j]
    ok = 100 * np.minimum(p, q) >= percent * np.maximum(p, q)
    width = np.array([len(m) for m in maps])
    narrow = np.minimum(width[i], width[j])
    for w in np.unique(narrow[ok]):
        rows = np.unique(np.concatenate([i[ok & (narrow == w)], j[ok & (narrow == w)]]))
        at = np.zeros(len(maps), np.int64)
        at[rows] = np.arange(len(rows))
        table = np.stack([_fold(maps[r], w) for r in rows])
        own = np.flatnonzero(ok & (narrow == w))
        for lo in range(0, len(own), max(1, (1 << 20) // int(w))):
            k = own[lo : lo + max(1, (1 << 20) // int(w))]
            apart = np.bitwise_count(table[at[i[k]]] ^ table[at[j[k]]]).sum(1, dtype=np.int64)
            ok[k] = apart * (100 + percent) <= (p[k] + q[k]) * (100 - percent)
    return ok


def _bounded(percent: int, mode: str):
    """Rows sorted by bucket part: "any", those with a partner; "hub" and "all", the pairs that may link.

    A part is a bucket, or two chunks x and y of a large one.
    """

    def large(rows, lo, hi):
        """Pairs of one large part that may link, one row against all others at a time; "any": who has a partner."""
        x, y, label, sizes = (rows[c] for c in ("x", "y", "label", "n"))
        width = min(len(m) for m in rows["bits"][lo:hi])
        table = np.stack([_fold(m, width) for m in rows["bits"][lo:hi]])
        size, same = sizes[lo:hi], x[lo] == y[lo]
        left = np.ones(hi - lo, bool) if same else rows["chunk"][lo:hi] == x[lo]
        right = left if same else ~left
        seen, i, j = np.zeros(hi - lo, bool), [], []
        for a in np.flatnonzero(left):
            if mode == "any" and seen[a]:  # who is like an earlier one needs no comparison of its own
                continue
            to = right.copy()
            to[a] = False
            if mode == "all":
                to &= label[lo:hi] != label[lo + a]
                to[: a if same else 0] = False
            to = np.flatnonzero(to & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])))
            apart = np.bitwise_count(table[to] ^ table[a]).sum(1, dtype=np.int64)
            to = to[apart * (100 + percent) <= (size[to] + size[a]) * (100 - percent)]
            if mode == "any":
                seen[to] = True
                seen[a] |= len(to) > 0
            else:
                i.append(np.full(len(to), lo + a))
                j.append(lo + to)
        return i, j, lo + np.flatnonzero(seen)

    def bounded(batches):
        names = ["bucket", "x", "y", "chunk", "class", "label", "n", "order", "bits"]

        def work(rows):
            new = np.ones(len(rows["x"]) + 1, bool)
            new[1:-1] = (rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["x"][1:] != rows["x"][:-1]) | (rows["y"][1:] != rows["y"][:-1])
            edge, i, j, out = np.flatnonzero(new), [], [], []
            first, size = edge[:-1], np.diff(edge)
            if mode == "hub":  # the first row of a part
                i.append(np.repeat(first, size - 1))
                j.append(np.setdiff1d(np.arange(edge[-1]), first, assume_unique=True))
            else:
                small = (size <= 24) & (rows["x"][first] == rows["y"][first])
                for n in np.unique(size[small]):
                    u, v = np.triu_indices(n, 1)
                    i.append((first[small & (size == n)][:, None] + u).ravel())
                    j.append((first[small & (size == n)][:, None] + v).ravel())
                for lo, n in zip(first[~small], size[~small]):
                    a, b, seen = large(rows, lo, lo + n)
                    i += a
                    j += b
                    out.append(seen)
            i, j = (np.concatenate(v).astype(int) if v else np.zeros(0, int) for v in (i, j))
            if mode == "all":
                ok = rows["label"][i] != rows["label"][j]
                i, j = i[ok], j[ok]
            if mode == "hub":
                ok = rows["label"][i] != rows["label"][j]
                i, j = i[ok], j[ok]
            ok = may_link(rows["n"], rows["bits"], i, j, percent)
            i, j = i[ok], j[ok]
            if mode == "any":
                who = np.unique(np.concatenate([i, j, *out]).astype(int))
                a, b = rows["bucket"][who], rows["class"][who]
            else:
                a, b = rows["class"][i], rows["class"][j]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for rows in whole_parts(batches, ("bucket", "x", "y"), 8000):
            yield work(_columns(rows, names))

    return bounded


def whole_parts(batches, keys: tuple[str, ...], least: int):
    """Tables of ``least`` rows or more, of batches sorted by keys, that cut no key's rows apart."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < least:
            continue
        rows = pa.Table.from_batches(held)
        values = np.stack([rows[c].to_numpy() for c in keys])
        last = np.flatnonzero((values != values[:, -1:]).any(0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield rows.slice(0, cut)
        held, n = rows.slice(cut).to_batches(), len(rows) - cut
    if n:
        yield pa.Table.from_batches(held)


def _columns(rows: pa.Table, names: list[str]) -> dict:
    out = {c: rows[c].to_numpy() for c in names[:-1]}
    return out | {"bits": [np.frombuffer(b, "<u8") for b in rows["bits"].to_pylist()]}


def _verify(width: int, percent: int):
    """Rows sorted by (hub, part, who), the hub's own first: the members linked with their hub."""

    def verify(batches):
        hub, own = None, None
        for batch in batches:
            values, at = doc_sets(unzipped(batch.column("text")), width)
            hubs, parts, who = (batch.column(c).to_numpy() for c in ("hub", "part", "who"))
            found = []
            for i in range(len(hubs)):
                x = values[at[i] : at[i + 1]]
                if (hubs[i], parts[i]) != hub:
                    hub, own, hub_id = (hubs[i], parts[i]), x, hubs[i]
                if who[i] == hub_id or not len(x) or not len(own):
                    continue
                common = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(x) - common):
                    found.append((hub_id, who[i]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


class SetJoin:
    """One run over a table of documents; ``labels`` and ``info`` hold its results."""

    along = ("n", "bits")  # columns that rows of buckets need to be compared

    def _hub_rounds(self) -> int:
        """Hubs save comparisons in large buckets alone; small ones give all their pairs at once."""
        n = F.col("count")
        load = self.buckets.groupBy("bucket").count().agg(F.sum(n).alias("rows"), F.sum(n * (n - 1) / 2).alias("pairs")).first()
        return HUB_ROUNDS if (load["pairs"] or 0) > FEW_PAIRS * (load["rows"] or 0) else 0

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, save: bool = False):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        prepare(self.spark)
        self.work = Workspace(self.spark, "setjoin")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
        if save:  # what is costly to compute again
            self.docs = self.work.save(self.docs, "rows")
        self._index()

    def _scanner(self, shards: np.ndarray):
        """From rows to blocks of set hashes (kind 0) and index entries (kind 1)."""
        return _scan(self.width, self.percent, shards)

    def _verifier(self):
        """From rows sorted by hub, the hub's first, to verified links."""
        return _verify(self.width, self.percent)

    def _index(self) -> None:
        n = partitions(self.spark, 2 * input_bytes(self.docs), 32 << 20)
        rows = self.docs.mapInArrow(self._scanner(shard_labels(n)), "kind int, shard long, payload binary")
        found = self.work.save(rows.repartition(n, "shard").mapInArrow(_shard, _SHARD), "index")
        self.info = found.where("id is not null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "a", "b")
        full = self.info.where("n_shingles > 0")
        same = self.work.save(full.groupBy("a", "b").agg(F.min("doc_id").alias("class")), "same")  # apart, so that the join can split a large class
        self.classes = self.work.save(full.join(same, ["a", "b"]).select("doc_id", "class").distinct(), "classes")
        members = found.where("bucket is not null").select("bucket", F.explode("members").alias("doc_id"))
        members = members.distinct().join(self.classes, "doc_id").select("bucket", "class").distinct()
        # Buckets that several shards found, or that are one after copies became one class.
        keyed = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"))
        chosen = keyed.where("n > 1").groupBy("n", "low", "sum").agg(F.min("bucket").alias("bucket")).select("bucket")
        self.buckets = self.work.save(members.join(chosen, "bucket", "left_semi"), "buckets")
        own = found.where("id is not null").join(self.classes, (F.col("id") == F.col("doc_id")) & (F.col("id") == F.col("class")), "left_semi")
        self.maps = self.work.save(own.groupBy(F.col("id").alias("class")).agg(F.max(F.struct("n", "bits")).alias("m")).select("class", "m.n", "m.bits"), "maps")
        self.labels = self.spark.createDataFrame([], "id long, label long")
        self.tested = self.spark.createDataFrame([], "hub long, who long")
        settle(self.spark)
        # What no bitmap rules out: only of these are the texts fetched.
        near = self._bounded(self._chunked(self.buckets.withColumn("label", F.col("class")), "near"), "any")
        self.buckets = self.work.save(near.select(F.col("a").alias("bucket"), F.col("b").alias("class")).distinct(), "near")
        settle(self.spark)
        ids = self.buckets.select(F.col("class").alias("id")).distinct()
        packed = self.docs.mapInArrow(zipped, "doc_id long, text binary")
        one = packed.join(ids, packed["doc_id"] == ids["id"], "left_semi")
        self.texts = self.work.save(one.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")

    def _mapped(self, rows: DataFrame) -> DataFrame:
        """Rows with what goes along to bound their similarity."""
        return rows.join(self.maps, "class")

    def _chunked(self, rows: DataFrame, name: str, salt: int = 0) -> DataFrame:
        """(bucket, class, label) with bitmaps; a bucket of over CHUNK rows as pairs of chunks.

        Only the large buckets' sizes meet the rows, so rows aren't dealt by bucket before they are cut up.
        """
        sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
        sizes = self.work.save(sizes, f"sizes-{name}")
        small = sizes.count() <= BROADCAST_ROWS
        order = F.xxhash64("class", F.lit(salt))
        one = self._mapped(rows.join(F.broadcast(sizes) if small else sizes, "bucket", "left"))
        one = one.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        one = one.withColumns({"order": order, "chunk": F.pmod(order, F.col("chunks")).cast("int")})
        one = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return one.select("bucket", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "class", "label", "order", *self.along)

    def _bounded(self, rows: DataFrame, mode: str) -> DataFrame:
        n = partitions(self.spark, 0)
        parts = rows.where("x = y") if mode == "hub" else rows
        return parts.repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "order").mapInArrow(_bounded(self.percent, mode), "a long, b long")

    def _labelled(self) -> DataFrame:
        """(bucket, class, label) of buckets in more than one component."""
        rows = self.buckets.join(self.labels, self.buckets["class"] == self.labels["id"], "left").select(*self.buckets.columns, F.coalesce("label", "class").alias("label"))
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
        return rows.join(mixed, "bucket", "left_semi")

    def _check(self, pairs: DataFrame, name: str) -> DataFrame:
        """Exactly verified links among distinct (hub, who)."""
        counts = pairs.groupBy("hub").count()
        spread = pairs.join(counts, "hub").select("hub", "who", F.pmod(F.xxhash64("who"), F.ceil(F.col("count") / GROUP)).cast("int").alias("part"))
        rows = spread.unionByName(spread.select("hub", F.col("hub").alias("who"), "part").distinct())
        rows = rows.join(self.texts, rows["who"] == self.texts["doc_id"]).select("hub", "part", "who", (F.col("who") != F.col("hub")).alias("later"), "text")
        n = partitions(self.spark, input_bytes(self.texts), 64 << 20)
        ordered = rows.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "later", "who")
        return self.work.save(ordered.select("hub", "part", "who", "text").mapInArrow(self._verifier(), "a long, b long"), name)

    def _grow(self, links: DataFrame, name: str) -> None:
        """Join components that links connect."""
        if links.isEmpty():
            return
        old = self.labels
        ends = []
        for c in ("a", "b"):
            ends.append(F.coalesce(F.col(f"l{c}.label"), F.col(c)).alias(c))
        edges = links.join(old.alias("la"), F.col("a") == F.col("la.id"), "left").join(old.alias("lb"), F.col("b") == F.col("lb.id"), "left").select(*ends).where("a != b").distinct()
        new = components(self.work, edges, name)
        old = old.unionByName(new.where("id = label").join(old, "id", "left_anti"))  # keeps ids that had no label
        every = old.unionByName(new.join(old, "id", "left_anti"))
        moved = new.select(F.col("id").alias("was"), F.col("label").alias("now"))
        self.labels = self.work.save(every.join(moved, every["label"] == moved["was"], "left").select("id", F.coalesce("now", "label").alias("label")), f"labels-{name}")

    def run(self) -> SetJoin:
        for k in range(self._hub_rounds()):
            rows = self.work.save(self._labelled(), f"mixed-{k}")
            if rows.isEmpty():
                return self
            pairs = self._bounded(self._chunked(rows, str(k), k), "hub").groupBy(F.col("a").alias("hub"), F.col("b").alias("who")).count()
            pairs = pairs.join(self.tested, ["hub", "who"], "left_anti")
            # A document is held against the one hub with which it shares most buckets.
            pairs = pairs.groupBy("who").agg(F.max(F.struct("count", (-F.col("hub")).alias("hub"))).alias("best")).select((-F.col("best.hub")).alias("hub"), "who")
            pairs = self.work.save(pairs, f"pairs-{k}")
            self.work.drop(f"mixed-{k}")
            if pairs.isEmpty():
                break
            self._grow(self._check(pairs, f"links-{k}"), str(k))
            settle(self.spark)
            self.tested = self.tested.unionByName(pairs).unionByName(pairs.select(F.col("who").alias("hub"), F.col("hub").alias("who")))
        rows = self.work.save(self._labelled(), "mixed")
        if not rows.isEmpty():
            pairs = self._bounded(self._chunked(rows, "all"), "all").select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("who")).distinct()
            pairs = self.work.save(pairs.join(self.tested, ["hub", "who"], "left_anti"), "pairs")
            self._grow(self._check(pairs, "links"), "last")
        return self

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row with a doc_id."""
        own = self.classes.join(self.labels, self.classes["class"] == self.labels["id"], "left").select("doc_id", F.coalesce("label", "class").alias("component_id"))
        own = own.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        return self.info.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, label) of all ends of edges (a, b), the label a component's smallest id.

    Each round gives a node the smallest label around it and then that label's own label,
    so paths halve; a round is written before the next, and it ends when none changes.
    """
    both = work.save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"both-{name}")
    labels = work.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"cc-{name}-0")
    for k in count(1):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        step = step.join(jump, step["new"] == jump["via"], "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("changed"))
        step = work.save(step, f"cc-{name}-{k}")
        labels = step.select("id", "label")
        if step.where("changed").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that links lead to."""
    found = SetJoin(docs, width, percent).run().result()
    alone = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(alone)
