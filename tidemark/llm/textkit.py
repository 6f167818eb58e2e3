"""Words and shingles of whole Arrow batches in numpy, without a Python loop over words.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. Words are known by 64-bit
hashes: a sum of per-byte random numbers times powers of an odd base, modulo 2**64,
mixed by two multiply-xorshift rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The base's powers 0..n-1 modulo 2**64, or its inverse's; kept for later calls."""
    have = _POW[inverse]
    if len(have) < n:
        full = np.full(max(n, 1 << 16), _INV if inverse else _BASE, U)
        full[0] = 1
        have = _POW[inverse] = np.multiply.accumulate(full)
    return have[:n]


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 1 << 19):
    """Row ranges (lo, hi) of about ``size`` bytes; a longer text is a block of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the n + 1 offsets of documents into them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    edge = offsets[(offsets > 0) & (offsets < n)]
    left = inside & ~before[:n]
    left[edge] = inside[edge]
    starts = np.flatnonzero(left)
    right = before[1:].copy()
    right[:-1] &= ~inside[1:]
    right[edge - 1] = inside[edge - 1]
    ends = np.flatnonzero(right) + 1
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE_LOWER[data] * powers(n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(n, True)[starts] + (ends - starts).astype(U))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within documents, and their document offsets.

    A document of 1 to width - 1 words has one shingle of all its words; one without
    words has none. The shingles are in text order and may repeat.
    """
    n_words = np.diff(at)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    first = at[:-1][doc] + np.arange(to[-1]) - to[:-1][doc]
    size = np.minimum(n_words, width)[doc]
    out = size.astype(U)
    for k in range(width):
        have = size > k
        nxt = hashes[np.where(have, first + k, 0)] if len(hashes) else np.zeros(0, U)
        out = np.where(have, mix(out * U(_BASE) + nxt), out)
    return out, to


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and without repeats, and the new offsets."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(at)))


def zipped(batches):
    """(doc_id, text) with the texts compressed, for shuffles of whole texts; a null is empty."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        blobs = [pack.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "text"])


def unzipped(column) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_py()) for x in column], pa.binary())
