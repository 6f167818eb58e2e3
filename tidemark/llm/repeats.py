"""Removal of repeated byte strings by prefix-free parsing with bounded suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts in a document with a
smaller doc_id. Strings never cross documents and are judged on the input.

Parsing. A rolling hash of GRAM bytes triggers wherever it is the least among those
inside some string of ``length`` bytes, the leftmost of equals. So every such string has
a trigger, placed by its content alone, and triggers cut a text into phrases. A phrase
holds the starts of all strings that share a trigger, and its bytes reach to the end of
the last of them; two phrases with the same bytes therefore hold the same strings.

Dictionary. Phrases meet by their trigger's hash, in shards. A trigger of one document
alone holds no repeat. A phrase that an earlier document also has goes as a whole; what
is left are first occurrences whose trigger an earlier document has as well: the ends of
longer repeats, and chance. Only of these are the bytes fetched.

Suffix arrays. The strings that start in those phrases are the dictionary's suffixes cut
at ``length`` bytes. They are sorted by trigger, place and bytes; runs of equal ones give
the smallest document of each. As a repeat is decided by its first ``length`` bytes, no
deeper order is needed, and phrases that the dictionary resolves are never sorted.

Phrases, spans and texts travel as compressed blocks of numpy columns by shard. A shard
sorts what it has in memory: 40 bytes a phrase.

Hot triggers. Before phrases travel, a task settles those that an earlier document of its
own block has too, so copies of a phrase arrive once a block. A short passage that many
documents hold in different surroundings makes different phrases of one trigger; such
triggers are found in a sample of the texts. Phrases of a hot trigger go to shards by their
own bytes, and its strings are compared one by one, by shards of string hashes, settled by
block in the same way. The sample decides where rows travel, never a result.

Nulls and odd input: a null text is empty; texts under ``length`` bytes lose nothing.
Rows that share a doc_id are one document and don't repeat each other. A row with a null
doc_id loses nothing and takes nothing away.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import Workspace, input_bytes, partitions, prepare, settle, shard_labels
from tidemark.llm.textkit import _BYTE, U, blocks, mix, powers, raw

LENGTH, GRAM = 50, 16
FLUSH = 1_500_000
CHUNK = 40_000

_PHRASE = np.dtype([("key", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "u1"), ("off", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "u1")])
_WANT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "u1"), ("off", "u1")])
_STRING = np.dtype([("hash", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4")])
_48 = U((1 << 48) - 1)
#: What a block holds. Rows before texts, which are read last.
SPANS, WANTED, TEXT, PHRASES, STRINGS = range(5)
_ROW = "kind int, shard long, doc_id long, payload binary"


def _bytes_dtype(length: int, gram: int) -> np.dtype:
    return np.dtype([*[(n, _WANT[n]) for n in _WANT.names], ("u", "u1", (2 * length - gram,))])


def pack(rows: np.ndarray) -> bytes:
    """Compressed byte planes, field by field."""
    planes = [np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for f in rows.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = np.zeros(len(data) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize
        own = np.ascontiguousarray(data[at : at + size * len(out)].reshape(size, -1).T)
        out[f] = own.reshape(out[f].shape) if dtype[f].shape else own.view(dtype[f]).ravel()
        at += size * len(out)
    return out


def _sent(rows: np.ndarray, by: np.ndarray, kind: int, shards: np.ndarray) -> pa.RecordBatch:
    """A block of rows for each shard."""
    to = mix(by.astype(U)) % U(len(shards))
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]) if len(to) else np.zeros(1, int)
    blobs = [pack(rows[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(shards[to[cut[:-1]].astype(int)] if n else [], pa.int64()), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "shard", "doc_id", "payload"])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i, from running minima of blocks both ways."""
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    full = full.reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """32 bits of each text, to tell rows of one doc_id apart."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * powers(len(data)))])
    size = np.diff(offsets)
    at = np.minimum(offsets[:-1], max(len(data) - 1, 0))
    return (mix((total[offsets[1:]] - total[offsets[:-1]]) * powers(len(data) + 1, True)[at] + size.astype(U)) >> U(32)).astype(np.uint32)


def phrases(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """All phrases of a block of texts."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, _PHRASE)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * powers(n), out=total[1:])
    inverse = powers(n + 1, True)
    hashes = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    ranked = (hashes & ~U(0xFFFFFFFF)) | np.arange(len(hashes)).astype(U)
    at = (least(ranked, width) & U(0xFFFFFFFF)).astype(np.int64)  # each string's trigger
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= offsets[1:][doc])
    if not len(starts):
        return np.zeros(0, _PHRASE)
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])
    first = np.flatnonzero(new)
    s, count = starts[first], np.diff(np.append(first, len(starts)))
    out = np.empty(len(s), _PHRASE)
    end = s + count - 1 + length
    out["key"] = hashes[at[s]] & _48
    out["text"] = mix((total[end] - total[s]) * inverse[s] + count.astype(U)) & _48
    out["doc"], out["tag"] = ids[doc[s]], tags(data, offsets)[doc[s]]
    out["start"], out["n"], out["off"] = s - offsets[:-1][doc[s]], count, at[s] - s
    return out


def _parsed(batches, length: int, gram: int):
    """All phrases of a task's texts, in blocks."""
    held, n = [], 0
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = raw(batch.column("text"))
        for lo, hi in blocks(offsets):
            held.append(phrases(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids[lo:hi], length, gram))
            n += len(held[-1])
            if n >= FLUSH:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def later(rows: np.ndarray, names: tuple[str, str]) -> np.ndarray:
    """Whether a row of a smaller doc_id has the same two values.

    Rows meet by one hash of both values. Where unlike values share it, some equal ones may
    not meet; they are left for the shard that they travel to.
    """
    a, b = (rows[f] for f in names)
    order = np.argsort(mix(a) ^ b)
    a, b, doc = a[order], b[order], rows["doc"][order]
    new = np.ones(len(rows), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(rows), bool)
    out[order] = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(rows) else False
    return out


def among(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``hot``."""
    if not len(hot):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def hot_triggers(docs: DataFrame, work: Workspace, length: int, gram: int, sampled: int, share: int) -> np.ndarray:
    """Triggers with at least 1 / ``share`` of the distinct phrases of one text in ``sampled``: ``share`` at most.

    A block names triggers with a quarter of that share in it, all triggers if it is small.
    """

    def counted(batches):
        for rows in _parsed(batches, length, gram):
            keys, n = np.unique(rows["key"][~later(rows, ("key", "text"))], return_counts=True)
            many = n * (4 * share) >= n.sum()
            total = int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[many].astype(np.int64), -1)), pa.array(np.append(n[many], total))], ["key", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(sampled)) == 0).mapInArrow(counted, "key long, n long")
    counts = work.save(part.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "triggers")
    total = counts.where("key = -1").agg(F.max("n")).head()[0] or 0
    top = counts.where((F.col("key") >= 0) & (F.col("n") * share >= total)).select("key").collect()  # share rows at most
    return np.sort(np.array([r["key"] for r in top], np.int64)).astype(U)


def _gone(rows: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """Whole phrases as spans, by document."""
    out = np.empty(len(rows), _SPAN)
    for f in _SPAN.names:
        out[f] = rows[f]
    return _sent(out, out["doc"], SPANS, shards)


def _parse(length: int, gram: int, shards: np.ndarray, hot: np.ndarray):
    """Phrases by trigger, or by their own bytes under a hot one; spans of those that an earlier text of the block has."""

    def parse(batches):
        for rows in _parsed(batches, length, gram):
            gone = later(rows, ("key", "text"))
            yield _gone(rows[gone], shards)
            rows = rows[~gone]
            yield _sent(rows, np.where(among(rows["key"], hot), rows["key"] ^ mix(rows["text"]), rows["key"]), PHRASES, shards)

    return parse


def _blocks(batches, kinds: dict[int, np.dtype], held: dict[int, np.ndarray]):
    """Collect the rows of some kinds into ``held`` and pass the other blocks on."""
    parts: dict[int, list] = {k: [np.zeros(0, dtype)] for k, dtype in kinds.items()}
    for batch in batches:
        own = batch.column("kind").to_numpy()
        payload = batch.column("payload")
        for i in np.flatnonzero(np.isin(own, list(kinds))).tolist():
            parts[own[i]].append(unpack(payload[i].as_py(), kinds[own[i]]))
        yield batch.filter(pa.array(~np.isin(own, list(kinds))))
    for k in kinds:
        held[k] = np.concatenate(parts.pop(k))


def _dictionary(shards: np.ndarray, hot: np.ndarray):
    """Phrases that go as a whole, as spans by document, and those to be fetched."""

    def dictionary(batches):
        held: dict[int, np.ndarray] = {}
        yield from _blocks(batches, {PHRASES: _PHRASE}, held)
        rows = held.pop(PHRASES)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["doc"], rows["text"], rows["key"]))]
        key, text, doc = rows["key"], rows["text"], rows["doc"]
        new_key = np.ones(len(rows), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= text[1:] != text[:-1]
        of_key, of_text = np.cumsum(new_key) - 1, np.cumsum(new) - 1
        earliest = doc[np.flatnonzero(new)]  # of each distinct phrase
        whole = doc > earliest[of_text]
        low = np.minimum.reduceat(doc, np.flatnonzero(new_key))
        high = np.maximum.reduceat(earliest[of_text], np.flatnonzero(new_key))
        want = ~whole & ((high > low)[of_key] | among(key, hot))  # a hot trigger's phrases are in many shards
        for lo in range(0, len(rows), FLUSH):
            cut = slice(lo, lo + FLUSH)
            yield _gone(rows[cut][whole[cut]], shards)
            open_ = rows[cut][want[cut]]
            asked = np.empty(len(open_), _WANT)
            for f in _WANT.names:
                asked[f] = open_[f]
            yield _sent(asked, asked["doc"], WANTED, shards)

    return dictionary


def _texts(shards: np.ndarray):
    """Texts as compressed rows, by document."""

    def texts(batches):
        pack_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            at = shards[(mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).astype(U)) % U(len(shards))).astype(int)]
            data, offsets = raw(batch.column("text"))
            blobs = [pack_.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([TEXT] * n, pa.int32()), pa.array(at, pa.int64()), ids, pa.array(blobs, pa.binary())], ["kind", "shard", "doc_id", "payload"])

    return texts


def _with_texts(batches, dtype: np.dtype):
    """From rows sorted by kind: for every text, its id, bytes and the rows that are its own."""
    parts, rows, unpack_ = [], None, zstandard.ZstdDecompressor()
    for batch in batches:
        kinds, ids, payloads = batch.column("kind").to_numpy(), batch.column("doc_id"), batch.column("payload")
        for i in range(len(kinds)):
            blob = payloads[i].as_py()
            if kinds[i] != TEXT:
                parts.append(unpack(blob, dtype))
                continue
            if rows is None:
                rows = np.concatenate(parts) if parts else np.zeros(0, dtype)
                rows = rows[np.argsort(rows["doc"], kind="stable")]
                parts = []
            doc, text = ids[i].as_py(), unpack_.decompress(blob)
            a, b = np.searchsorted(rows["doc"], [doc, doc + 1]) if len(rows) else (0, 0)
            own = rows[a:b]
            if len(own):
                own = own[own["tag"] == tags(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]]
            yield doc, text, own


def _runs(rows: np.ndarray, hit: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """Runs of hit places in phrases as spans, by document."""
    before = np.zeros_like(hit)
    before[:, 1:] = hit[:, :-1]
    after = np.zeros_like(hit)
    after[:, :-1] = hit[:, 1:]
    who, first = np.nonzero(hit & ~before)
    _, last = np.nonzero(hit & ~after)
    gone = np.empty(len(who), _SPAN)
    gone["doc"], gone["tag"] = rows["doc"][who], rows["tag"][who]
    gone["start"], gone["n"] = rows["start"][who] + first, last - first + 1
    return _sent(gone, gone["doc"], SPANS, shards)


def strings(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every string of fetched phrases by its hash, with the phrase and the place in it."""
    width = rows["u"].shape[1]
    total = np.zeros((len(rows), width + 1), U)
    np.cumsum(_BYTE[rows["u"]] * powers(width), 1, out=total[:, 1:])
    hashes = mix((total[:, length:] - total[:, :-length]) * powers(width - length + 1, True))
    who, place = np.nonzero(np.arange(hashes.shape[1]) < rows["n"].astype(int)[:, None])
    out = np.empty(len(who), _STRING)
    out["hash"] = hashes[who, place]
    for f in ("key", "doc", "tag"):
        out[f] = rows[f][who]
    out["start"] = rows["start"][who] + place
    return out, who, place


def _fetch(length: int, gram: int, shards: np.ndarray, hot: np.ndarray):
    wide = _bytes_dtype(length, gram)

    def sent(rows):
        apart = among(rows["key"], hot)
        own = rows[~apart]
        yield _sent(own, own["key"], PHRASES, shards)
        rows = rows[apart]
        for lo in range(0, len(rows), CHUNK):
            own = rows[lo : lo + CHUNK]
            out, who, place = strings(own, length)
            gone = later(out, ("hash", "key"))
            hit = np.zeros((len(own), 256), bool)
            hit[who[gone], place[gone]] = True
            yield _runs(own, hit, shards)
            out = out[~gone]
            yield _sent(out, out["hash"], STRINGS, shards)

    def fetch(batches):
        held, n = [], 0
        for _, text, own in _with_texts(batches, _WANT):
            if not len(own):
                continue
            out = np.zeros(len(own), wide)
            for f in _WANT.names:
                out[f] = own[f]
            data = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(wide["u"].shape[0], np.uint8)])
            cover = own["n"].astype(np.int64)[:, None] + length - 1 > np.arange(wide["u"].shape[0])
            out["u"] = data[own["start"].astype(np.int64)[:, None] + np.arange(wide["u"].shape[0])] * cover
            held.append(out)
            n += len(out)
            if n >= 200_000:
                yield from sent(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from sent(np.concatenate(held))

    return fetch


def repeated_starts(rows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of phrases of whole triggers: phrases x places, whether an earlier document has that string."""
    width = int((rows["off"].astype(int) + 1).max(initial=1))
    hit = np.zeros((len(rows), 256), bool)
    head = rows["key"].astype(">u8").view(np.uint8).reshape(-1, 8)
    for place in range(width):  # of the trigger in the string
        j = rows["off"].astype(np.int64) - place
        own = np.flatnonzero((j >= 0) & (j < rows["n"]))
        if len(own) < 2:
            continue
        strings = np.empty((len(own), 8 + length), np.uint8)
        strings[:, :8] = head[own]
        strings[:, 8:] = rows["u"][own[:, None], j[own][:, None] + np.arange(length)]
        order = np.argsort(strings.view(f"S{8 + length}").ravel(), kind="stable")
        strings = strings[order]
        new = np.ones(len(own), bool)
        new[1:] = (strings[1:] != strings[:-1]).any(1)
        doc = rows["doc"][own[order]]
        low = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        after = own[order][doc > low]
        hit[after, j[after]] = True
    return hit


def _resolve(length: int, gram: int, shards: np.ndarray):
    wide = _bytes_dtype(length, gram)

    def resolve(batches):
        held: dict[int, np.ndarray] = {}
        yield from _blocks(batches, {PHRASES: wide, STRINGS: _STRING}, held)
        rows = held.pop(STRINGS)
        rows = rows[np.lexsort((rows["doc"], rows["key"], rows["hash"]))]
        if len(rows):
            new = np.concatenate([[True], (rows["hash"][1:] != rows["hash"][:-1]) | (rows["key"][1:] != rows["key"][:-1])])
            rows = rows[rows["doc"] > rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]]
            yield _runs(rows, np.ones((len(rows), 1), bool), shards)
        rows = held.pop(PHRASES)
        if not len(rows):
            return
        rows = rows[np.argsort(rows["key"], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        lo = 0
        while lo < len(rows):
            k = np.searchsorted(starts, lo + CHUNK, "left")
            hi = int(starts[k]) if k < len(starts) else len(rows)
            own = rows[lo:hi]
            yield _runs(own, repeated_starts(own, length), shards)
            lo = hi

    return resolve


def merged(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of bytes, in order."""
    if not len(spans):
        return []
    start = np.sort(spans["start"].astype(np.int64))
    order = np.argsort(spans["start"], kind="stable")
    end = np.maximum.accumulate((spans["start"].astype(np.int64) + spans["n"] + length - 1)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist()))


def _strike(length: int, whole: bool):
    def strike(batches):
        held = []

        def out():
            cols = list(zip(*held))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if whole else pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        for doc, text, own in _with_texts(batches, _SPAN):
            runs, at, kept = merged(own, length), 0, []
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            kept = b"".join(kept)
            held.append((doc, len(text), len(text) - len(kept), len(runs), kept if whole else hashlib.sha256(kept).hexdigest()))
            if len(held) >= 500:
                yield out()
                held = []
        if held:
            yield out()

    return strike


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole: bool = True, sampled: int = 64, hot_share: int = 1 << 13) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``: the bytes left, or their SHA-256 if not ``whole``.

    ``sampled`` and ``hot_share`` say which triggers travel as hot ones (``hot_triggers``).
    """
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null")
    n = partitions(spark, 2 * input_bytes(docs), 32 << 20)
    shards = shard_labels(n)
    hot = hot_triggers(known, work, length, gram, sampled, hot_share)

    def by_shard(df: DataFrame) -> DataFrame:
        return df.repartition(n, "shard")

    def by_text(df: DataFrame) -> DataFrame:
        return by_shard(df.unionByName(known.mapInArrow(_texts(shards), _ROW))).sortWithinPartitions("kind")

    parsed = by_shard(known.mapInArrow(_parse(length, gram, shards, hot), _ROW)).mapInArrow(_dictionary(shards, hot), _ROW)
    found = work.save(parsed, "dictionary")
    del parsed
    settle(spark)
    asked = by_text(found.where(F.col("kind") == WANTED)).mapInArrow(_fetch(length, gram, shards, hot), _ROW)
    partial = work.save(by_shard(asked).mapInArrow(_resolve(length, gram, shards), _ROW), "partial")
    del asked
    settle(spark)
    gone = found.where(F.col("kind") == SPANS).unionByName(partial)
    kept = "binary" if whole else "string"
    out = by_text(gone).mapInArrow(_strike(length, whole), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kept}")
    text = F.coalesce("text", F.lit("")).cast("binary")
    alone = rows.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (text if whole else F.sha2(text, 256)).alias("kept"))
    return out.unionByName(alone)
