"""Copies among images, cropped or edited, by local binary descriptors.

An image is a row of (image_id, height, width, pixels): gray bytes, row by row. Corners
are maxima of the Harris response at seven scales, a factor of 1.12 apart, placed between
pixels. A corner's orientation is that of its patch's intensity centroid; its descriptor
is 128 comparisons of point pairs around it, turned by the orientation and widened by the
scale. Images of one shape are described together.

TABLES sets of TABLE_BITS of the bits are Hamming tables: corners that agree in one set
come into one bucket, with their other bits. Within a bucket, corners of two images that
are CLOSE bits apart at most make the images candidates; only those pairs leave the
bucket, and no descriptor moves before. The tables don't promise every pair: the README
has the measured recall by kind of edit. Candidates are verified: corners are matched by
Hamming distance, each match proposes a turn, scale and shift, and the images are linked
if the matches that agree with one proposal are enough of the corners in the part that it
says both show. Exact copies are one class and enter the tables once. Members of buckets
are first held against hubs in rounds, as in the set join, so that a group of many edited
copies costs a comparison with a hub each; then all pairs of different components that
are close in a bucket are compared.

An image keeps all corners over the least response, and no partner or candidate is capped.

Nulls and odd input: an image without pixels, or whose pixels don't fill height x width,
links with nothing. An image without corners links with exact copies only. Of rows that
share an image_id all are in one component. Images with a side over TILE are described
tile by tile, with a border that all filters and patches stay within, so that memory is
bounded and corners are those of the whole. Columns besides the four are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import pack, unpack
from tidemark.llm.runtime import Workspace, input_bytes, partitions, prepare, settle, shard_labels
from tidemark.llm.setjoin import FLUSH, SetJoin, whole_parts
from tidemark.llm.textkit import _BYTE, U, mix, powers, raw, unzipped, zipped

SCALES = (1.5, 1.68, 1.89, 2.12, 2.38, 2.67, 3.0)
BITS, NEAR, AGREE, SHARE = 128, 30, 6, 0.2
CHUNK = 1 << 20
PIXELS = 1 << 18  # described at once, or one tile
TILE, BORDER = 512, 96
HUB_ROUNDS = 2
_KEY = np.dtype([("sig", "<u8"), ("id", "<i8"), ("rest", "<u8")])
_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("turn", "<f4"), ("bits", "u1", (BITS // 8,))])
_rng = np.random.default_rng(5)
_TESTS = np.clip(_rng.normal(0, 5.0, (2, BITS, 2)), -11, 11).astype(np.float32)  # point pairs, in units of the scale
TABLES, TABLE_BITS, CLOSE = 8, 64, 4
_SETS = np.stack([_rng.permutation(BITS) for _ in range(TABLES)])  # first a table's bits, then the others
_DISK = np.array([(x, y) for x in range(-4, 5) for y in range(-4, 5) if x * x + y * y <= 16], np.float32)


@lru_cache(64)
def _kernel(n: int, sigma: float) -> np.ndarray:
    d = np.abs(np.arange(n)[:, None] - np.arange(n))
    g = np.exp(-0.5 * (d / sigma) ** 2) * (d <= 4 * sigma)
    return (g / g.sum(1, keepdims=True)).astype(np.float32)


def _blur(images: np.ndarray, sigma: float) -> np.ndarray:
    n, h, w = images.shape
    rows = (images.reshape(n * h, w) @ _kernel(w, sigma).T).reshape(n, h, w)
    return np.matmul(_kernel(h, sigma), rows)


def _at(images: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values, a row of places for each image number in ``which``; the border is carried on."""
    _, h, w = images.shape
    x, y = np.clip(x, 0, np.float32(w - 1.001)), np.clip(y, 0, np.float32(h - 1.001))
    i, j = y.astype(np.int32), x.astype(np.int32)
    a, b = y - i, x - j
    flat, k = images.reshape(-1), (which[:, None] * h + i) * w + j
    return (1 - a) * ((1 - b) * flat[k] + b * flat[k + 1]) + a * ((1 - b) * flat[k + w] + b * flat[k + w + 1])


def describe(images: np.ndarray) -> list[np.ndarray]:
    """Of gray images of one shape (n x height x width), the corners with their descriptors."""
    n, height, width = images.shape
    images = images.astype(np.float32)
    mean, std = images.mean((1, 2), keepdims=True), images.std((1, 2), keepdims=True)
    if min(height, width) < 16:
        return [np.zeros(0, _POINT)] * n
    found, which = [np.zeros(0, _POINT)], [np.zeros(0, np.int64)]
    for y in range(0, height, TILE):
        for x in range(0, width, TILE):
            top, left = max(0, y - BORDER), max(0, x - BORDER)
            cut = slice(top, y + TILE + BORDER), slice(left, x + TILE + BORDER)
            if images[0][cut].shape[0] < 3 or images[0][cut].shape[1] < 3:
                continue
            own, points = _corners((images[:, cut[0], cut[1]] - mean) / np.maximum(std, 1e-6), y - top, x - left)
            points["x"] += left
            points["y"] += top
            found.append(points)
            which.append(own)
    which, found = np.concatenate(which), np.concatenate(found)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(1, n))
    return [p if s >= 1e-6 else p[:0] for p, s in zip(np.split(found[order], cuts), std.ravel())]


def _corners(tiles: np.ndarray, top: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners of tiles that lie in the TILE rows from ``top`` and columns from ``left``, and whose they are."""
    _, h, w = tiles.shape
    parts, whose = [np.zeros(0, _POINT)], [np.zeros(0, np.int64)]
    for scale in SCALES:
        smooth = _blur(tiles, scale)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = (_blur(g, 1.5 * scale) for g in (gx * gx, gx * gy, gy * gy))
        response = (a * c - b * b - np.float32(0.05) * (a + c) ** 2) * np.float32(scale**4)
        edge = int(2 * scale) + 1
        inner = response[:, edge:-edge, edge:-edge]
        if min(inner.shape[1:]) < 3:
            continue
        peak = inner > 1e-4
        for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
            peak &= inner > response[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
        peak[:, : max(0, top - edge)] = peak[:, max(0, top + TILE - edge) :] = False
        peak[:, :, : max(0, left - edge)] = peak[:, :, max(0, left + TILE - edge) :] = False
        i, y, x = np.nonzero(peak)
        if not len(i):
            continue
        y, x = y + edge, x + edge
        middle, sides = response[i, y, x], (response[i, y, x - 1], response[i, y, x + 1], response[i, y - 1, x], response[i, y + 1, x])
        between = lambda low, high: np.clip(0.5 * (low - high) / np.minimum(low - 2 * middle + high, -1e-9), -0.5, 0.5)
        x, y = (x + between(*sides[:2])).astype(np.float32), (y + between(*sides[2:])).astype(np.float32)
        s = np.float32(scale)
        patch = _at(smooth, i, x[:, None] + s * _DISK[:, 0], y[:, None] + s * _DISK[:, 1])
        patch = patch - patch.mean(1, keepdims=True)
        turn = np.arctan2(patch @ _DISK[:, 1], patch @ _DISK[:, 0])
        cos, sin = np.cos(turn)[:, None] * s, np.sin(turn)[:, None] * s
        one, two = (_at(smooth, i, x[:, None] + t[:, 0] * cos - t[:, 1] * sin, y[:, None] + t[:, 0] * sin + t[:, 1] * cos) for t in _TESTS)
        out = np.zeros(len(x), _POINT)
        out["x"], out["y"], out["scale"], out["turn"] = x, y, scale, turn
        out["bits"] = np.packbits(one < two, axis=1)
        parts.append(out)
        whose.append(i)
    return np.concatenate(whose), np.concatenate(parts)


def table_keys(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners x tables: the hashed bits of each table, and the other bits."""
    words = np.packbits(np.unpackbits(points["bits"], axis=1)[:, _SETS], axis=2).view("<u8")
    return mix(words[:, :, 0] ^ mix(np.arange(1, TABLES + 1).astype(U))), words[:, :, 1]


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of corners that are each other's nearest, NEAR bits apart at most."""
    best, least = np.zeros(len(a), int), np.zeros(len(a), int)
    back, low = np.zeros(len(b), int), np.full(len(b), BITS + 1)
    p, q = (np.ascontiguousarray(x["bits"]).view("<u8") for x in (a, b))
    step = max(1, CHUNK // len(b))
    for lo in range(0, len(a), step):
        distance = sum(np.bitwise_count(p[lo : lo + step, None, k] ^ q[None, :, k]).astype(np.int16) for k in range(BITS // 64))
        best[lo : lo + step], least[lo : lo + step] = distance.argmin(1), distance.min(1)
        nearer = distance.min(0) < low
        back[nearer], low[nearer] = lo + distance.argmin(0)[nearer], distance.min(0)[nearer]
    i = np.flatnonzero((least <= NEAR) & (back[best] == np.arange(len(a))))
    return i, best[i]


def linked(a: np.ndarray, b: np.ndarray, a_shape: tuple[int, int], b_shape: tuple[int, int]) -> bool:
    """Whether enough matched corners agree with one turn, scale and shift between two images.

    Enough is AGREE, and SHARE of the corners in the part that both show, of the image that has fewer there.
    """
    if not len(a) or not len(b):
        return False
    i, j = _matches(a, b)
    if len(i) < AGREE:
        return False
    p, q = a[i], b[j]
    turn = q["turn"] - p["turn"]
    z, w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    spin = q["scale"] / p["scale"] * np.exp(1j * turn)
    inside = lambda at, shape: ((at.real >= 0) & (at.real <= shape[1] - 1) & (at.imag >= 0) & (at.imag <= shape[0] - 1)).sum(1)
    step = max(1, CHUNK // max(len(a), len(b)))
    for lo in range(0, len(i), step):
        z0, w0, by, round_ = (v[lo : lo + step, None] for v in (z, w, spin, turn))
        off = np.abs(by * (z - z0) + w0 - w)
        same = np.abs(np.angle(np.exp(1j * (turn - round_)))) < 0.35
        agree = ((off < 3 + 0.05 * np.abs(z - z0)) & same).sum(1)
        k = np.flatnonzero(agree >= AGREE)
        z0, w0, by = z0[k], w0[k], by[k]
        shown = np.minimum(inside(by * (a["x"] + 1j * a["y"] - z0) + w0, b_shape), inside((b["x"] + 1j * b["y"] - w0) / by + z0, a_shape))
        if (agree[k] >= SHARE * shown).any():
            return True
    return False


def _describe(batches):
    for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, len(whole), 1000)):
        ids, pixels = batch.column("image_id"), batch.column("pixels")
        height, width = (batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("height", "width"))
        data, offsets = raw(pixels)
        fills = np.flatnonzero((height > 0) & (width > 0) & (np.diff(offsets) == height * width))
        n, a, b, blob = np.zeros(len(ids), np.int64), np.zeros(len(ids), U), np.zeros(len(ids), U), [None] * len(ids)
        shapes, group = np.unique(np.stack([height[fills], width[fills]], 1), axis=0, return_inverse=True)
        for g, (h, w) in enumerate(shapes.tolist()):
            own, each = fills[group.ravel() == g], max(1, PIXELS // (h * w))
            for lo in range(0, len(own), each):
                rows = own[lo : lo + each]
                flat = data[offsets[rows][:, None] + np.arange(h * w)]
                a[rows], b[rows] = (mix((_BYTE[x] * powers(h * w)).sum(1, dtype=U) + U(h)) for x in (flat, 255 - flat))
                for row, points in zip(rows, describe(flat.reshape(-1, h, w))):
                    n[row], blob[row] = len(points), np.array([h, w], "<u4").tobytes() + points.tobytes()
        empty = np.ones(len(ids), bool)
        empty[fills] = False
        hashes = [pa.array(x.view(np.int64), pa.int64(), mask=empty) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), *hashes, pa.array(blob, pa.binary())], ["doc_id", "n", "a", "b", "text"])


def _points(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, _POINT, offset=8)


def _shape(blob: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(blob, "<u4", 2).tolist())


def _scan(shards: np.ndarray):
    """Images' table keys in packed blocks by shard."""

    def sent(held):
        rows = np.concatenate(held)
        to = (rows["sig"] >> U(33)) % U(len(shards))
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        cut = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
        return pa.RecordBatch.from_arrays([pa.array(shards[to[cut[:-1]].astype(int)], pa.int64()), pa.array([pack(rows[x:y]) for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["shard", "payload"])

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            for who, blob in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                points = _points(blob)
                rows = np.zeros(len(points) * TABLES, _KEY)
                sig, rest = table_keys(points)
                rows["sig"], rows["rest"], rows["id"] = sig.ravel(), rest.ravel(), who
                held.append(rows)
                n += len(rows)
            if n >= FLUSH // 4:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return scan


def _buckets(batches):
    """A shard's table keys that two images or more have, with those images."""
    parts = [unpack(p.as_py(), _KEY) for batch in batches for p in batch.column("payload")]
    if not parts:
        return
    rows = np.concatenate(parts)
    del parts
    rows = np.unique(rows)
    edge = np.flatnonzero(np.concatenate([[True], rows["sig"][1:] != rows["sig"][:-1], [True]]))
    several = rows["id"][edge[:-1]] != rows["id"][edge[1:] - 1]
    rows = rows[np.repeat(several, np.diff(edge))]
    for lo in range(0, len(rows), FLUSH):
        own = rows[lo : lo + FLUSH]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own["sig"]).view(np.int64)), pa.array(own["id"]), pa.array(np.ascontiguousarray(own["rest"]).view(np.int64))], ["bucket", "class", "rest"])


def _emit(mode: str):
    """Pairs of close corners of different components in each part of a bucket: with its first row ("hub"), or all."""

    def ends(rows: dict, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        near = np.bitwise_count(rows["rest"][i] ^ rows["rest"][j]) <= CLOSE
        near &= rows["label"][i] != rows["label"][j]
        return pa.RecordBatch.from_arrays([pa.array(rows["class"][i[near]]), pa.array(rows["class"][j[near]])], ["a", "b"])

    def emit(batches):
        for table in whole_parts(batches, ("bucket", "x", "y"), 50_000):
            rows = {c: table[c].to_numpy() for c in ("bucket", "x", "y", "chunk", "class", "label", "rest")}
            bucket, x, y, chunk = (rows[c] for c in ("bucket", "x", "y", "chunk"))
            new = np.ones(len(x) + 1, bool)
            new[1:-1] = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            edge = np.flatnonzero(new)
            first, size = edge[:-1], np.diff(edge)
            if mode == "hub":
                yield ends(rows, np.repeat(first, size - 1), np.setdiff1d(np.arange(edge[-1]), first, assume_unique=True))
                continue
            small = (size <= 64) & (x[first] == y[first])
            for n in np.unique(size[small]):
                u, v = np.triu_indices(n, 1)
                at = first[small & (size == n)][:, None]
                yield ends(rows, (at + u).ravel(), (at + v).ravel())
            for lo, n in zip(first[~small], size[~small]):
                one, own = x[lo] == y[lo], np.arange(lo, lo + n)
                left, right = (own, own) if one else (own[chunk[own] == x[lo]], own[chunk[own] == y[lo]])
                for k, a in enumerate(left):
                    to = right[k + 1 :] if one else right
                    yield ends(rows, np.full(len(to), a), to)

    return emit


def _verify(batches):
    hub, own, shape = None, None, None
    for batch in batches:
        found = []
        for h, part, who, blob in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "who")), unzipped(batch.column("text")).to_pylist()):
            points = _points(blob)
            if (h, part) != hub:
                hub, own, shape = (h, part), points, _shape(blob)
            if who != h and linked(own, points, shape, _shape(blob)):
                found.append((h, who))
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class CopyJoin(SetJoin):
    """The set join's hubs, rounds and components over the buckets of described images."""

    along = ("rest",)

    def __init__(self, described: DataFrame):
        self.spark, self.percent = described.sparkSession, 0
        self.work = Workspace(self.spark, "copies")
        self.docs = self.work.save(described, "rows")  # what is costly to compute again
        self._index()

    def _index(self) -> None:
        self.info = self.docs.select("doc_id", F.col("n").alias("n_shingles"))
        full = self.docs.where("a is not null").select("doc_id", "a", "b")
        same = full.groupBy("a", "b").agg(F.min("doc_id").alias("class"))
        self.classes = self.work.save(full.join(same, ["a", "b"]).select("doc_id", "class").distinct(), "classes")
        first = self.classes.select(F.col("class").alias("id")).distinct()
        one = self.docs.where("n > 0").join(first, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")
        n = partitions(self.spark, 3 * input_bytes(self.docs), 32 << 20)
        entered = one.mapInArrow(_scan(shard_labels(n)), "shard long, payload binary")
        self.buckets = self.work.save(entered.repartition(n, "shard").mapInArrow(_buckets, "bucket long, class long, rest long"), "buckets")
        settle(self.spark)
        met = self.buckets.select(F.col("class").alias("id")).distinct()
        packed = self.docs.select("doc_id", "text").join(met, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(zipped, "doc_id long, text binary")
        self.texts = self.work.save(packed.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
        self.labels = self.spark.createDataFrame([], "id long, label long")
        self.tested = self.spark.createDataFrame([], "hub long, who long")

    def _verifier(self):
        return _verify

    def _hub_rounds(self) -> int:
        return HUB_ROUNDS

    def _mapped(self, rows: DataFrame) -> DataFrame:
        return rows

    def _bounded(self, rows: DataFrame, mode: str) -> DataFrame:
        parts = rows.where("x = y") if mode == "hub" else rows
        ordered = parts.repartition(partitions(self.spark, 0), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "order")
        return ordered.select("bucket", "x", "y", "chunk", "class", "label", "rest").mapInArrow(_emit(mode), "a long, b long")


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_keypoints and component_id: the smallest image_id that links lead to."""
    prepare(images.sparkSession)
    known = images.where("image_id is not null").select("image_id", "height", "width", "pixels")
    join = CopyJoin(known.mapInArrow(_describe, "doc_id long, n long, a long, b long, text binary"))
    return join.run().result().select(F.col("doc_id").alias("image_id"), F.col("n_shingles").alias("n_keypoints"), "component_id")


def stretched(images: np.ndarray, side: int) -> np.ndarray:
    """Square images of any side, sampled up or down smoothly."""
    n = images.shape[1]
    at = np.linspace(0, n - 1, side)
    low = np.minimum(at.astype(int), n - 2)
    weights = np.zeros((side, n))
    weights[np.arange(side), low], weights[np.arange(side), low + 1] = 1 - (at - low), at - low
    return weights @ images @ weights.T


def edited(images: np.ndarray, edit: int) -> np.ndarray:
    """A crop, a quarter turn, another brightness and a resized version of images, by number."""
    side = images.shape[1]
    if edit == 0:
        return images[:, side // 12 : side - side // 8, side // 8 : side - side // 12]
    if edit == 1:
        return np.rot90(images, axes=(1, 2))
    if edit == 2:
        return np.clip(images * 0.8 + 30, 0, 255)
    return stretched(images, side * 7 // 10)


def render_vectors(vectors: DataFrame, side: int = 64, every: int = 20) -> DataFrame:
    """Images of vectors (vec_id, embedding): a square grid of their values, sampled up smoothly.

    image_id is twice the vec_id. Of each vec_id divisible by ``every`` there is an edited
    copy besides, whose image_id is odd: what a search among all images is to find.
    """
    prepare(vectors.sparkSession)

    def some(ids, vectors_):
        clean = [np.array([x for x in v or [] if x is not None and np.isfinite(x)], float) for v in vectors_]
        grid, out = np.array([int(np.sqrt(len(v))) for v in clean], int), []
        for n in np.unique(grid):
            own = np.flatnonzero(grid == n)
            if n < 2:
                out += [(2 * ids[i], None, None) for i in own]
                continue
            v = np.stack([clean[i][: n * n].reshape(n, n) for i in own])
            v = v - v.min((1, 2), keepdims=True)
            shown = stretched(255 * v / np.maximum(v.max((1, 2), keepdims=True), 1e-9), side)
            for i, image in zip(own, shown):
                out.append((2 * ids[i], side, np.rint(image).astype(np.uint8).tobytes()))
                if ids[i] % every == 0:
                    copy = edited(image[None], ids[i] // every % 4)[0]
                    out.append((2 * ids[i] + 1, len(copy), np.rint(copy).astype(np.uint8).tobytes()))
        image_id, sides, pixels = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(image_id, pa.int64()), pa.array(sides, pa.int32()), pa.array(sides, pa.int32()), pa.array(pixels, pa.binary())], ["image_id", "height", "width", "pixels"])

    def render(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = batch.slice(lo, 256)
                yield some(rows.column("vec_id").to_pylist(), rows.column("embedding").to_pylist())

    known = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return known.mapInArrow(render, "image_id long, height int, width int, pixels binary")
