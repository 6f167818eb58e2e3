"""Peaks of traces that are still arriving: thresholds and runs with carried state.

Frames of a trace come in any number of batches, in any order. A frame's threshold is
final once size - 1 frames after it are known (or the trace has ended), and a run once it
has been left; each is then given out once. The state of a trace is what windows still
reach, frames that wait for one before them, and the run that is open: no more than twice
the window besides what came too early.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.operators.signal import MAD_SCALE, rolling_median
from tidemark.package import ship

FIELDS = "run long, frame_idx long, t double, value double, threshold double, score double, run_length long"


class Trace:
    """What is known of a trace so far."""

    def __init__(self, size: int, sigma: float, mask: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.half, self.size, self.sigma, self.mask = size // 2, size, sigma, mask
        self.start, self.told = 0, 0  # the first frame that is kept, and the first without a final threshold
        self.t, self.v = np.zeros(0), np.zeros(0)
        self.early: dict[int, tuple[float, float]] = {}
        self.total: int | None = None
        self.runs, self.open = 0, None  # runs given numbers; the open one's length and best frame

    @property
    def known(self) -> int:
        return self.start + len(self.v)

    def add(self, idx: np.ndarray, t: np.ndarray, v: np.ndarray) -> None:
        """Take frames in; one that comes again is passed over."""
        order = np.argsort(idx, kind="stable")
        for i in order:
            if idx[i] >= self.known:
                self.early.setdefault(int(idx[i]), (float(t[i]), float(v[i])))
        more = []
        while (at := self.known + len(more)) in self.early:
            more.append(self.early.pop(at))
        if more:
            self.t, self.v = np.append(self.t, [x[0] for x in more]), np.append(self.v, [x[1] for x in more])

    def finished(self) -> bool:
        return self.total is not None and self.known >= self.total

    def peaks(self) -> list[tuple]:
        """The runs that are now over."""
        to = self.known if self.finished() else max(self.told, self.known - 2 * self.half)
        out: list[tuple] = []
        if to > self.told:
            base = rolling_median(self.v, self.size)
            mad = rolling_median(np.abs(self.v - base), self.size)
            own = slice(self.told - self.start, to - self.start)
            t, v, threshold = self.t[own], self.v[own], (base + self.sigma * mad * MAD_SCALE)[own]
            inside = np.concatenate([[self.open is not None], self.mask(v, threshold), [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])  # where a frame differs from the one before
            if not self.finished() and len(inside) > 2 and inside[-2]:
                edges = edges[:-1]  # the last run may go on
            at, state = 0, self.open is not None
            for e in [*edges.tolist(), None]:
                lo, hi = at, len(v) if e is None else e
                if state and hi > lo:
                    best = lo + int(np.argmax(v[lo:hi]))
                    self._extend(hi - lo, (self.told + best, t[best], v[best], threshold[best]))
                if e is not None:
                    if state:
                        out.append(self._close())
                    at, state = e, not state
            self.told = to
            keep = max(self.start, self.told - 2 * self.half)
            self.t, self.v, self.start = self.t[keep - self.start :], self.v[keep - self.start :], keep
        if self.finished() and self.open:
            out.append(self._close())
        return out

    def _extend(self, n: int, best: tuple) -> None:
        if self.open is None:
            self.runs += 1
            self.open = n, best
        else:
            length, old = self.open
            self.open = length + n, best if best[2] > old[2] else old  # the first of equals

    def _close(self) -> tuple:
        length, (idx, t, v, threshold) = self.open
        self.open = None
        return self.runs, int(idx), float(t), float(v), float(threshold), float(v - threshold), int(length)


def stream_peaks(frames: DataFrame, keys: list[str], size: int, sigma: float, min_score: float, floor: float = float("-inf")) -> DataFrame:
    """The apex of each run over its threshold, in append mode; on a batch, of all that is there.

    ``frames`` has frame_idx (from 0, gapless in the end), t and value; a row with a null
    value ends its trace, its frame_idx being the number of frames. A trace without such a
    row stays open.
    """
    schema = StructType([frames.schema[k] for k in keys])
    for field in StructType.fromDDL(FIELDS):
        schema = schema.add(field)

    def mask(v: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        return (v - threshold >= min_score) & (v > floor)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        trace = Trace(size, sigma, mask)
        if state.exists:
            trace.__dict__.update(pickle.loads(state.get[0]))
        rows = pd.concat(list(parts))
        ends = rows[rows["value"].isna()]
        if len(ends):
            trace.total = int(ends["frame_idx"].max())
        own = rows[rows["value"].notna()]
        trace.add(own["frame_idx"].to_numpy(), own["t"].to_numpy(float), own["value"].to_numpy(float))
        found = trace.peaks()
        kept = {k: v for k, v in trace.__dict__.items() if k not in ("mask", "size", "sigma", "half")}
        state.update((pickle.dumps(kept),))
        yield pd.DataFrame([(*key, *r) for r in found], columns=schema.names)

    ship(frames.sparkSession)
    named = frames.select(*keys, "frame_idx", "t", "value")
    return named.groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", "NoTimeout")


def write_peaks(peaks: DataFrame, path: str, checkpoint: str):
    """Write the peaks of all that has arrived; a later call goes on from the checkpoint."""
    return peaks.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
