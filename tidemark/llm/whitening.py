"""Whitening of vectors by a tall-skinny QR decomposition over partitions.

Vectors are taken in whole 256ths. The fit runs over each distinct vector once: their
number and the sums of their entries are exact, so centring costs one rounding. Every task
reduces its centred rows to one triangular factor R, block by block; factors are merged by
QR in a tree of TREE at a time until one is left, whose singular values and right vectors
are those of all centred rows. No covariance is formed. What comes to the driver is one R,
the sums, and a few numbers a component, all bounded by the square of the dimension.

The distinct vectors are a written table, so a lost executor costs its tasks alone, and a
task that runs again reads the same rows.

Nulls and odd input: rows whose vector is null, empty or holds a null or non-finite entry
go. So do vectors of a length other than the most frequent one (of equals the longest).
Repeated rows keep their rows, and count once in the fit. Components are those whose
variance is more than rounding leaves of none: fewer than asked for where the vectors have
a lower rank, none (so no row) for an empty table or a single distinct vector. A deviation
that does not fit a long is null. Only the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.runtime import Workspace, prepare

TREE = 8
BLOCK = 1 << 22  # bytes of rows in a QR step
_LARGE = 1 << 62


def whole_vectors(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and x = floor(256 * entry) of the vectors without a null or non-finite entry."""
    c = F.col(column)
    odd = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.where(c.isNotNull() & (F.size(c) > 0) & ~odd)
    return rows.select(F.col(id_column), F.transform(c, lambda e: F.floor(e.cast("double") * 256).cast("long")).alias("x"))


def _matrix(column) -> np.ndarray:
    """The rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each entry; high and low halves are summed apart, so nothing overflows."""

    def sums(batches):
        n, high, low = 0, None, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                up, down = (x >> 31).astype(object).sum(0) if len(x) >= 1 << 30 else (x >> 31).sum(0), (x & (2**31 - 1)).sum(0)
                n, high, low = n + len(x), up if high is None else high + up, down if low is None else low + down
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], ["n", "high", "low"])

    parts = fit.select("x").mapInArrow(sums, "n long, high array<bigint>, low array<bigint>")
    each = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v"))
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = sorted(each.groupBy("at").agg(F.sum("n").alias("n"), big("v.high").alias("high"), big("v.low").alias("low")).collect())  # a row a dimension
    return (got[0]["n"] if got else 0), [(int(r["high"]) << 31) + int(r["low"]) for r in got]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from whole numbers where they fit."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most * n + max(map(abs, sums), default=0) < _LARGE:
        return (x * n - np.array(sums, np.int64)) / n
    return x.astype(float) - np.array([s / n for s in sums])


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def final_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: one a task, then merged TREE at a time."""
    d = len(sums)
    step = max(2 * d, BLOCK // (8 * d))

    def reduce(batches):
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch.column("x"))
            for lo in range(0, len(x), step):
                r = _triangle(np.concatenate([r, centred(x[lo : lo + step], n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merge(batches):
        for batch in batches:  # at most TREE factors a part
            held: dict[int, np.ndarray] = {}
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("rs").to_pylist()):
                rows = [np.frombuffer(b).reshape(-1, d) for b in blob]
                held[part] = _triangle(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["part", "r"])

    factors, parts = fit.select("x").mapInArrow(reduce, "part int, r binary"), fit.rdd.getNumPartitions()
    while parts > 1:
        grouped = factors.groupBy(F.expr(f"part div {TREE}").cast("int").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "r"))), lambda s: s["r"]).alias("rs"))
        factors, parts = grouped.mapInArrow(merge, "part int, r binary"), -(-parts // TREE)
    found = factors.collect()  # one
    return np.frombuffer(found[0]["r"]).reshape(-1, d) if found else np.zeros((0, d))


@dataclass
class Whitening:
    """What a fit learns: the rows' number and sums, and components by falling variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a row a component
    variances: np.ndarray
    total: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.variances)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over entries of (n * x - S) ** 2, null beyond a long."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums))
        if most * most * len(self.sums) < _LARGE:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit_whitening(fit: DataFrame, components: int) -> Whitening | None:
    """The first components of the distinct vectors x; None where they don't differ."""
    n, sums = exact_sums(fit)
    if n < 2:
        return None
    r = final_factor(fit, n, sums)
    _, s, right = np.linalg.svd(r)
    keep = int((s[:components] > s[0] * np.finfo(float).eps * max(n, len(sums)) ** 0.5 * 4).sum()) if s[0] > 0 else 0
    if not keep:
        return None
    return Whitening(n, sums, right[:keep], s[:keep] ** 2 / n, float((s**2).sum() / n))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, centred before multiplying."""
    k = len(model.variances)

    def sums(batches, centre=None):
        total = None
        for batch in batches:
            w = model.project(_matrix(batch.column("x")))
            own = w.sum(0) if centre is None else ((w - centre).T @ (w - centre)).ravel()
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    def added(f) -> np.ndarray:
        each = fit.select("x").mapInArrow(f, "v array<double>").select(F.posexplode("v").alias("at", "v"))
        return np.array([r["v"] for r in sorted(each.groupBy("at").agg(F.sum("v").alias("v")).collect())])  # k * k rows at most

    centre = added(sums) / model.n
    covariance = added(lambda batches: sums(batches, centre)).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector that remains and each component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    prepare(spark)
    work = Workspace(spark, "whitening")
    every = whole_vectors(vectors, id_column, column)
    # One pass writes the distinct vectors of every length, and the lengths' counts decide.
    counted = work.save(every.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "distinct")
    lengths = counted.groupBy(F.size("x").alias("size")).agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    id_field = vectors.schema[id_column]
    schema = StructType([id_field]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    size = lengths[0]["size"] if lengths else 0
    fit = counted.where(F.size("x") == size)
    model = fit_whitening(fit, components) if size else None
    if model is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(fit, model), len(model.variances)

    def rows(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            m = len(x)
            if not m:
                continue
            ids = batch.column(id_column).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), deviation, pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return every.where(F.size("x") == size).mapInArrow(rows, schema)
