"""Work over long sample series in segments of blocks, each with its neighbours' borders.

Samples come in blocks, all of one size but the last. A segment is a number of blocks in
a row and whole blocks of its neighbours on both sides, so what reaches over a border
(a frame, a filter) finds its samples, and a series is worked on by many tasks, of which
none holds more than a segment at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.signal import EPS, blocks_of, stft_magnitudes
from tidemark.package import ship

SEGMENT_BLOCKS = 64


@dataclass
class Segment:
    """Samples from ``start`` (a place in the series); its own are those from ``first`` to before ``last``."""

    samples: np.ndarray
    start: int
    first: int
    last: int
    ends: bool  # whether the series ends with it

    @property
    def total(self) -> int:
        """The place after the last sample that is known, the series' length where it ends."""
        return self.start + len(self.samples)


def over_segments(samples: DataFrame, keys: list[str], work: Callable[[Segment], dict[str, np.ndarray]], fields: dict[str, str], halo_blocks: int, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """The rows that ``work`` makes of each segment (columns by name), under the series' keys.

    ``samples`` has ``block_idx`` (from 0, gapless) and ``block``; a null block is empty.
    """
    schema = StructType([samples.schema[k] for k in keys])
    for name, kind in fields.items():
        schema = schema.add(StructType.fromDDL(f"{name} {kind}")[name])
    halo, size = max(1, halo_blocks), max(segment_blocks, halo_blocks)
    own = [f"__k{i}" for i in range(len(keys))]
    rows = samples.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("block_idx").cast("long").alias("__b"), F.coalesce("block", F.array().cast("array<float>")).alias("__x"))
    rows = rows.withColumn("__s", F.explode(blocks_of(F.col("__b"), size, halo))).repartition(*own, "__s").sortWithinPartitions(*own, "__s", "__b")

    def made(key: tuple, at: int, blocks: list[tuple[int, np.ndarray]], like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        each = len(blocks[0][1])  # the size of all blocks but a series' last
        mine = [b for b, _ in blocks if b // size == at]
        if not mine:  # borders alone: the series has ended before
            return
        start, after = blocks[0][0] * each, blocks[-1][0] > mine[-1]
        x = np.concatenate([x for _, x in blocks])
        last = (mine[-1] + 1) * each if after else start + len(x)
        found = work(Segment(x, start, mine[0] * each, last, not after))
        n = len(next(iter(found.values())))
        if n:
            keyed = [pa.array([k] * n, like.schema.field(o).type) for k, o in zip(key, own)]
            values = [pa.array(v.tolist(), f.type) if v.dtype == object else pa.array(v).cast(f.type) for v, f in zip(found.values(), wanted)]
            yield pa.RecordBatch.from_arrays([*keyed, *values], schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = [to_arrow_schema(schema).field(name) for name in fields]

    def run(batches):
        now, blocks, like = None, [], None
        for batch in batches:
            like = batch
            columns = [batch.column(i).to_pylist() for i in range(len(own))]
            b, s, x = batch.column("__b").to_pylist(), batch.column("__s").to_pylist(), batch.column("__x")
            for i in range(batch.num_rows):
                key = (*[c[i] for c in columns], s[i])
                if key != now:
                    if blocks:
                        yield from made(now[:-1], now[-1], blocks, like)
                    now, blocks = key, []
                blocks.append((b[i], x[i].values.to_numpy(zero_copy_only=False)))
        if blocks:
            yield from made(now[:-1], now[-1], blocks, like)

    ship(samples.sparkSession)
    return rows.mapInArrow(run, schema)


def halo_for(samples_needed: int, block_size: int) -> int:
    return -(-samples_needed // max(1, block_size))


def _grid(s: Segment, hop: int) -> np.ndarray:
    """The numbers of the frames whose place (number * hop) is the segment's own."""
    return np.arange(-(-s.first // hop), -(-s.last // hop))


def rms_frames(samples: DataFrame, keys: list[str], window: int, hop: int, block_size: int, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """frame_idx, at (the sample a frame starts with) and value (dBFS) of all whole frames."""

    def work(s: Segment) -> dict[str, np.ndarray]:
        k = _grid(s, hop)
        k = k[k * hop + window <= s.total]
        power = np.concatenate([[0.0], np.cumsum(s.samples.astype(float) ** 2)])
        at = k * hop - s.start
        rms = np.sqrt(np.maximum(power[at + window] - power[at], 0) / window + EPS)
        return {"frame_idx": k, "at": k * hop, "value": 20 * np.log10(rms + EPS)}

    return over_segments(samples, keys, work, {"frame_idx": "long", "at": "long", "value": "double"}, halo_for(window, block_size), segment_blocks)


def flux_frames(samples: DataFrame, keys: list[str], window: int, hop: int, block_size: int, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """frame_idx, at (the sample in a frame's middle) and value (spectral flux).

    A series shorter than the window shortens it, and the hop with it.
    """

    def work(s: Segment) -> dict[str, np.ndarray]:
        n = s.total
        if s.ends and n < window:  # the whole series
            step = hop - (window - n)
            if n < 2 or step < 1:
                return {"frame_idx": np.zeros(0, int), "at": np.zeros(0, int), "value": np.zeros(0)}
            at, magnitude = stft_magnitudes(s.samples, n, step)
            return {"frame_idx": np.arange(len(at)), "at": at, "value": np.maximum(np.diff(magnitude, axis=0, prepend=magnitude[:1]), 0).sum(1)}
        half, odd = window // 2, window - window // 2
        k = _grid(s, hop)
        if s.ends:  # zeros up to whole frames
            k = np.arange(k[0] if len(k) else -(-s.first // hop), (n + (-n) % hop % window) // hop + 1)
        if not len(k):
            return {"frame_idx": k, "at": k, "value": np.zeros(0)}
        first = max(k[0] - 1, 0)  # the frame before the segment's first
        lo, hi = first * hop - half, k[-1] * hop + odd
        x = np.zeros(hi - lo)
        a, b = max(lo, s.start), min(hi, n)
        x[a - lo : b - lo] = s.samples[a - s.start : b - s.start]
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
        flux, before = np.zeros(len(frames)), None
        for i in range(0, len(frames), 4096):  # spectra of some frames at a time
            magnitude = np.abs(np.fft.rfft(frames[i : i + 4096] * win, axis=1)) / win.sum()
            rise = np.diff(magnitude, axis=0, prepend=magnitude[:1] if before is None else before)
            flux[i : i + 4096] = np.maximum(rise, 0).sum(1)
            before = magnitude[-1:]
        return {"frame_idx": k, "at": k * hop, "value": flux[k[0] - first :]}

    return over_segments(samples, keys, work, {"frame_idx": "long", "at": "long", "value": "double"}, halo_for(window + hop, block_size), segment_blocks)


def low_pass(up: int, down: int, zeros: int = 24) -> np.ndarray:
    """A sinc under a Kaiser window, for ``up`` samples in the place of one; odd, symmetric, of gain ``up``."""
    half = zeros * max(up, down)
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.kaiser(2 * half + 1, 8.0)
    return h * up / h.sum()


def resample_all(x: np.ndarray, up: int, down: int, first: int, last: int, start: int, filter_: np.ndarray) -> np.ndarray:
    """Output samples first to before last of a series of which ``x`` is known from ``start``; zeros beyond."""
    half = len(filter_) // 2
    m = np.arange(first, last)
    at = m * down  # on the axis of up times as many samples
    low = -((half - at) // up)  # the first input that the filter reaches
    taps = np.arange(2 * half // up + 2)
    k = low[:, None] + taps
    phase = at[:, None] - k * up + half
    inside = (k >= start) & (k < start + len(x)) & (phase >= 0) & (phase < len(filter_))
    values = np.where(inside, x[np.clip(k - start, 0, max(0, len(x) - 1))] if len(x) else 0.0, 0.0)
    return (values * filter_[np.clip(phase, 0, len(filter_) - 1)]).sum(1)


def resample(samples: DataFrame, keys: list[str], rate: int, to: int, block_size: int, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """Blocks of samples at another rate, each of the time of an input block.

    A polyphase filter: every output sample is the sum of the inputs within the filter's
    reach, each by the tap of its phase, whichever block they lie in. A series of n
    samples becomes ceil(n * to / rate). ``block_size`` times ``to`` must be a multiple of
    ``rate``, so that blocks begin with an output sample.
    """
    up, down = to // gcd(to, rate), rate // gcd(to, rate)
    if up == down:
        return samples.select(*keys, "block_idx", "block")
    if block_size * up % down:
        raise ValueError("a block must hold a whole number of samples at the new rate")
    taps = low_pass(up, down)
    reach = len(taps) // 2 // up + 2
    size = block_size * up // down

    def work(s: Segment) -> dict[str, np.ndarray]:
        first = s.first * up // down
        last = -(-s.last * up // down) if s.ends else s.last * up // down
        blocks = []
        for lo in range(first, last, size):
            blocks.append(resample_all(s.samples.astype(float), up, down, lo, min(last, lo + size), s.start, taps).astype(np.float32))
        out = np.empty(len(blocks), object)
        for i, b in enumerate(blocks):
            out[i] = b
        return {"block_idx": first // size + np.arange(len(blocks)), "block": out}

    return over_segments(samples, keys, work, {"block_idx": "long", "block": "array<float>"}, halo_for(reach, block_size), segment_blocks)
