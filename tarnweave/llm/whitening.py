"""Whitening of embeddings by the singular values of the centred distributed rows.

Entries c become integers x = floor(scale * c) + shift. The fit list holds each distinct vector once, so that copies do not weigh. Sums
are exact integers; a centred entry is x less the whole part of its dimension's mean, less the rest of the mean, so that only that
last difference is rounded. MLlib's computeSVD on the centred rows gives the components; a singular value s gives the eigenvalue
s^2 / n. The total variance does not come from these but from the exact deviations, the sums of (n x - S)^2. The covariance of what
the components give is summed up over the fit list once more and compared with the identity.

The driver holds matrices of dimension x dimension only. Rows are whitened where they are, without a shuffle; the one shuffle is that of
the distinct vectors, of which copies are merged before it.

Edge cases: vectors that are null or hold null or non-finite entries take no part, nor do vectors with an entry whose x is no long.
A shorter vector has zeros for the entries it lacks. A null or repeated id stays as it is: a row of the table gives rows of its own.
Components are numbered as long as their standard deviation is above `least` of the largest: others cannot be told from rounding (a
constant table has none), so that fewer than `most` may be returned. Their sign makes the largest entry positive. A deviation outside a
long's range is null. Empty tables give empty results; columns other than the id and the vector are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

SCALE, SHIFT = 64, 1_000_000
#: Components returned; the smallest standard deviation of one, as a share of the largest; rows of a step.
MOST, LEAST, STEP = 16, 1e-5, 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Whitening:
    """whole + rest / n: the mean of each dimension. axes: a column for each component; variances: their eigenvalues; total: the trace."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n x - S)^2, exactly."""
        gap = x - self.whole
        reach = self.n * (int(np.abs(gap).max(initial=0)) + 1)
        if x.shape[1] * reach * reach >= 1 << 63:
            gap = gap.astype(object)
        d = self.n * gap - self.rest
        return (d * d).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """vec_id and x of the rows that take part, and the number of dimensions."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    bound = (2.0**62 - shift) / scale
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < bound)))
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    long = F.transform("x", lambda v: F.floor(v * scale).cast("long") + F.lit(shift).cast("long"))
    short = F.array_repeat(F.lit(shift).cast("long"), F.lit(dim) - F.size("x"))
    return rows.select("vec_id", F.when(F.size("x") < dim, F.concat(long, short)).otherwise(long).alias("x")), dim


def _sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension: a row a dimension and task is shuffled."""

    def run(batches):
        n, total = 0, [0] * dim
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            safe = not len(x) or int(np.abs(x).max()) * len(x) < 1 << 63
            total = [a + int(s) for a, s in zip(total, (x if safe else x.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), type=pa.int32()), pa.array([n] * dim, type=pa.int64()), pa.array([str(t) for t in total])], names=["d", "n", "s"])

    parts = fit_list.mapInArrow(run, "d int, n long, s string")
    got = {r["d"]: r for r in parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # a row a dimension
    return got[0]["n"], [int(got[d]["s"]) for d in range(dim)]


def fit(fit_list: DataFrame, dim: int, most: int = MOST, least: float = LEAST) -> Whitening | None:
    """fit_list: distinct vectors x, in a stored table. None if there is no variance."""
    if not dim or fit_list.isEmpty():
        return None
    n, sums = _sums(fit_list, dim)
    model = Whitening(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64), np.zeros((dim, 0)), np.zeros(0), 0.0)

    def squares(batches):
        yield pa.RecordBatch.from_arrays([pa.array([str(sum(int(d) for b in batches for d in model.deviations(_matrix(b.column(0), dim))))])], names=["s"])

    total = sum(int(r["s"]) for r in fit_list.mapInArrow(squares, "s string").collect())  # a row a task
    if not total:
        return None
    model.total = total / n**3
    whole, rest = (F.lit(v.tolist()) for v in (model.whole, (model.rest / n)))
    centred = F.zip_with(F.zip_with("x", whole, lambda x, m: (x - m).cast("double")), rest, lambda x, m: x - m)
    rows = MLUtils.convertVectorColumnsFromML(fit_list.select(array_to_vector(centred).alias("v")), "v")
    # all dimensions are asked for, as the products of the columns are then solved directly, not by iteration
    svd = RowMatrix(rows, n, dim).computeSVD(dim, rCond=least)
    s, axes = svd.s.toArray()[:most], svd.V.toArray()[:, :most]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    model.axes, model.variances = axes, s * s / n
    return model


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    dim, k = len(model.whole), len(model.variances)

    def run(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = model.whitened(_matrix(b.column(0), dim))
            if len(z):
                own = z.mean(axis=0)
                gap, both = own - mean, n + len(z)
                spread += (z - own).T @ (z - own) + np.outer(gap, gap) * n * len(z) / both
                mean, n = mean + gap * len(z) / both, both
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64()), pa.array([mean.tolist()], type=pa.list_(pa.float64())), pa.array([spread.ravel().tolist()], type=pa.list_(pa.float64()))], names=["n", "mean", "spread"])

    n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
    for r in fit_list.mapInArrow(run, "n long, mean array<double>, spread array<double>").toLocalIterator():  # k^2 numbers a task, one at a time
        if r["n"]:
            gap, both = np.array(r["mean"]) - mean, n + r["n"]
            spread += np.array(r["spread"]).reshape(k, k) + np.outer(gap, gap) * n * r["n"] / both
            mean, n = mean + gap * r["n"] / both, both
    return float(np.abs(spread / n - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, most: int = MOST, least: float = LEAST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """For each row that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, dim = integer_rows(vectors, id_col, vector_col, scale, shift)
    fit_list = store(rows.select("x").distinct(), "fit-list")
    model = fit(fit_list, dim, most, least)
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    error, k = identity_error(fit_list, model), len(model.variances)
    explained = model.variances / model.total

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                b = whole.slice(lo, STEP)
                x, m = _matrix(b.column(1), dim), b.num_rows
                deviations = [d if d < 1 << 63 else None for d in model.deviations(x).tolist()]
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(deviations, type=pa.int64()).take(each), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, RESULT)
