"""Frame signals of block samples, and their rolling robust threshold.

Rolling medians run over blocks of traces with the rows that their windows reach, many
blocks a pass in numpy and pandas, which is much faster than a percentile over window
frames; ``rolling_threshold_sql`` is the same in expressions alone, for frames of tens of
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.package import ship

#: The normal consistency constant of the MAD, and the floor under powers.
MAD_SCALE, EPS = 1.4826, 1e-10


def odd_size(baseline: float, hop: float) -> int:
    """The rolling window's rows: odd, 3 at least, from the nominal hop."""
    return max(3, int(baseline / hop) | 1)


def frames(block: Column, window: int, hop: int) -> Column:
    """Whole frames of a sample array; a partial one at the end is left out."""
    n = F.floor((F.size(block) - window) / hop) + 1
    ids = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, lambda i: F.slice(block, i * hop + 1, F.lit(window)))


def frame_rms(blocks: DataFrame, keys: list[str], block: str, window: int, hop: int) -> DataFrame:
    """frame_idx, rms and dbfs of each frame; a frame's time is that of its start."""
    found = blocks.select(*keys, F.posexplode(frames(F.col(block), window, hop)).alias("frame_idx", "frame"))
    power = F.aggregate("frame", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.lit(float(window))
    found = found.withColumn("rms", F.sqrt(power + EPS))
    return found.withColumn("dbfs", 20 * F.log10(F.col("rms") + EPS)).drop("frame")


def stft_magnitudes(samples: np.ndarray, nperseg: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Frame-centre sample positions and |STFT|: periodic Hann, zeros of nperseg / 2 on both
    sides and up to whole frames, scaled by one over the window's sum."""
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    x = np.concatenate([np.zeros(nperseg // 2), np.asarray(samples, float), np.zeros(nperseg // 2)])
    x = np.concatenate([x, np.zeros((-(len(x) - nperseg)) % hop % nperseg)])
    at = np.arange(0, len(x) - nperseg + 1, hop)
    spectrum = np.fft.rfft(x[at[:, None] + np.arange(nperseg)] * win, axis=1) / win.sum()
    return at, np.abs(spectrum)


def spectral_flux(blocks: DataFrame, keys: list[str], block: str, nperseg: int, hop: int) -> DataFrame:
    """frame_idx and flux: the sum of the bins' rises since the frame before, 0 in the first."""
    schema = blocks.select(*keys).schema.add("frame_idx", "integer").add("flux", "double")

    def flux(batches):
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                _, magnitude = stft_magnitudes(getattr(row, block), nperseg, hop)
                rise = np.maximum(np.diff(magnitude, axis=0, prepend=magnitude[:1]), 0).sum(1)
                parts.append(pd.DataFrame({**{k: getattr(row, k) for k in keys}, "frame_idx": np.arange(len(rise), dtype=np.int32), "flux": rise}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    ship(blocks.sparkSession)
    return blocks.select(*keys, block).mapInPandas(flux, schema)


def rolling_median(values: np.ndarray, size: int) -> np.ndarray:
    """Centred, the ends padded with the first and last value."""
    half = size // 2
    return pd.Series(np.pad(values, half, mode="edge")).rolling(size).median().to_numpy()[2 * half :]


def rolling_medians(values: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """``rolling_median`` of many groups, laid end to end, in one pass: each is padded on its own."""
    if not len(values):
        return np.zeros(0)
    half, n = size // 2, len(sizes)
    first = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(n), sizes + 2 * half)
    at = np.arange(len(group)) - (np.cumsum(sizes + 2 * half) - (sizes + 2 * half))[group] - half
    wide = values[first[group] + np.clip(at, 0, sizes[group] - 1)]
    return pd.Series(wide).rolling(size).median().to_numpy()[2 * half :][(np.clip(at, 0, sizes[group] - 1) == at)[half : len(group) - half]]


def blocks_of(at: Column, block: int, halo: int) -> Column:
    """The blocks of ``block`` rows that need row ``at``: its own, and those it lies within ``halo`` rows of."""
    own, into = F.floor(at / block).cast("long"), at % block
    before = F.when((into < halo) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))
    after = F.when(into >= block - halo, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(before, F.array(own), after)


def rolling_threshold(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, sigma: float, index: str | None = None, block: int = 1 << 16, ranges=None) -> DataFrame:
    """Add baseline, mad and threshold = baseline + sigma * MAD_SCALE * mad.

    A trace is cut into blocks of ``block`` rows, each with size - 1 rows of its neighbours
    on both sides, which is all that a median of distances to medians reaches. A task takes
    many blocks in one pass, and a long trace goes to many tasks. ``index`` names a column
    that numbers each trace's rows from 0 without gaps; without one they are numbered by
    ``order``, in two levels where ``ranges`` (see ``scan``) are given.

    A null value gives nulls wherever its windows reach. An empty frame stays empty.
    """
    from tidemark.operators import scan

    halo = 2 * (size // 2)
    block = max(block, halo)
    schema = StructType(list(df.schema.fields))  # a copy: add() changes its own
    for name in ("baseline", "mad", "threshold"):
        schema = schema.add(name, "double")
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.withColumn("__i", F.col(index).cast("long")) if index else scan.numbered(df, keys, order, "__i", ranges)
    rows = rows.withColumns({o: F.col(k) for o, k in zip(own, keys)}).withColumn("__block", F.explode(blocks_of(F.col("__i"), block, halo)))
    rows = rows.repartition(*own, "__block").sortWithinPartitions(*own, "__block", "__i")
    names = df.columns

    def medians(table: pa.Table) -> pa.RecordBatch:
        """Whole blocks, sorted."""
        at, to = table.column("__i").to_numpy(), table.column("__block").to_numpy()
        new = np.ones(len(at), bool)
        new[1:] = (to[1:] != to[:-1]) | (at[1:] <= at[:-1])
        for k in own:  # a null key is a key like any other
            codes = table.column(k).combine_chunks().dictionary_encode("encode")
            codes = (codes if isinstance(codes, pa.Array) else codes.combine_chunks()).indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        v = table.column(value).to_numpy().astype(float)
        base = rolling_medians(v, sizes, size)
        mad = rolling_medians(np.abs(v - base), sizes, size)
        found = [pa.array(x, pa.float64(), from_pandas=True) for x in (base, mad, base + sigma * mad * MAD_SCALE)]
        out = table.select(names)
        for name, x in zip(("baseline", "mad", "threshold"), found):
            out = out.append_column(name, x)
        return out.filter(pa.array(at // block == to))

    def run(batches):
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in waiting) < block:
                continue
            table = pa.concat_tables(waiting)
            last = table.slice(table.num_rows - 1).select([*own, "__block"]).to_pylist()[0]
            same = table.num_rows
            lo, hi = 0, table.num_rows - 1  # the first row of the last block, which may go on
            while lo < hi:
                mid = (lo + hi) // 2
                if table.slice(mid, 1).select([*own, "__block"]).to_pylist()[0] == last:
                    hi = mid
                else:
                    lo = mid + 1
            same = lo
            if same:
                yield from medians(table.slice(0, same)).to_batches()
            waiting = [table.slice(same)]
        if waiting:
            yield from medians(pa.concat_tables(waiting)).to_batches()

    ship(df.sparkSession)
    return rows.mapInArrow(run, schema)


def _padded(df: DataFrame, keys: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """Rows with ``half`` copies of the first and last value before and after each group."""
    by = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__i", F.row_number().over(by)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    edge = ranked.where((F.col("__i") == 1) | (F.col("__i") == F.col("__n")))
    first = edge.where("__i = 1").withColumn("__i", F.explode(F.sequence(F.lit(-half + 1), F.lit(0)))).withColumn("__pad", F.lit(True))
    last = edge.where("__i = __n").withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(half)))).withColumn("__i", F.col("__n") + F.col("__k")).drop("__k").withColumn("__pad", F.lit(True))
    return ranked.withColumn("__pad", F.lit(False)).unionByName(first).unionByName(last)


def rolling_threshold_sql(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, sigma: float) -> DataFrame:
    """As ``rolling_threshold``, by percentiles over window frames."""
    half = size // 2
    frame = Window.partitionBy(*keys).orderBy("__i").rowsBetween(-half, half)
    stage = _padded(df, keys, order, value, half).withColumn("baseline", F.percentile(value, F.lit(0.5)).over(frame)).where("not __pad").drop("__i", "__n", "__pad")
    stage = stage.withColumn("__residual", F.abs(F.col(value) - F.col("baseline")))
    out = _padded(stage, keys, order, "__residual", half).withColumn("mad", F.percentile("__residual", F.lit(0.5)).over(frame)).where("not __pad").drop("__i", "__n", "__pad", "__residual")
    return out.withColumn("threshold", F.col("baseline") + sigma * F.col("mad") * MAD_SCALE)
