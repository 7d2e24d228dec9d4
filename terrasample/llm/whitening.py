"""Embedding whitening: exact scatter matrices from bit planes, then an eigendecomposition.

Vectors become whole numbers x = floor(scale * c).  A task takes blocks of the fit
list's rows, shifts every dimension to begin at 0 and packs bit b of dimension d
of all rows of a block into 64-bit words: one bit plane.  The cross-product of two
dimensions is the sum over their planes a and b of 2^(a+b) times the ones of the two
planes' AND, an exact whole number; the shift is taken out again with the sums.  Only
these numbers leave a task (one row a pair of dimensions), and Spark adds them as
decimals.  n * P - S * S' centres them as whole numbers, so nothing is rounded before
the eigendecomposition of a dimension x dimension matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasample.llm._session import cut, lean, shared_folder, ship

#: x of this size or more would not leave room for exact sums; such a row is not usable.
LIMIT = 1 << 40
#: Numbers that a block's planes are made of: rows times dimensions.
BLOCK = 1 << 19


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Bits of non-negative whole numbers (rows x dimensions): dimension x bit x word, a word has 64 rows."""
    bits = max(1, int(y.max()).bit_length()) if y.size else 1
    rows = -(-len(y) // 64) * 64
    padded = np.zeros((y.shape[1], rows), np.int64)
    padded[:, : len(y)] = y.T
    planes = [np.packbits(((padded >> b) & 1).astype(bool), axis=1, bitorder="little") for b in range(bits)]
    return np.stack(planes, 1).view(np.uint64)


def plane_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the dimensions of non-negative whole numbers, by weighted counts of ones; exact (Python integers)."""
    planes = bit_planes(y)
    dims, bits, words = planes.shape
    flat = planes.reshape(dims * bits, words)
    ones = np.zeros((len(flat), len(flat)), np.int64)
    some = np.flatnonzero(flat.any(1))  # planes without ones add nothing
    kept = flat[some]
    for k in range(len(kept)):
        ones[some[k], some[k:]] = np.bitwise_count(kept[k:] & kept[k]).sum(1, dtype=np.int64)
    ones = np.maximum(ones, ones.T)
    weight = 1 << np.arange(2 * bits - 1, dtype=object)
    if len(y) << 2 * bits < 1 << 62:  # all sums fit in 64 bits
        weight = weight.astype(np.int64)
    by_bit = ones.astype(weight.dtype).reshape(dims, bits, dims, bits)
    total = np.zeros((dims, dims), weight.dtype)
    for a in range(bits):
        for b in range(bits):
            total = total + by_bit[:, a, :, b] * weight[a + b]
    sums = (np.diagonal(ones).astype(weight.dtype).reshape(dims, bits) * weight[:bits]).sum(1)
    return sums.astype(object), total.astype(object)


def scatter(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products (Python integers) of whole numbers of any sign."""
    low = x.min(0)
    sums, products = plane_products(x - low)
    low = low.astype(object)
    n = len(x)
    return n, sums + n * low, products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


@dataclass
class Fit:
    """What one length of vectors is whitened by."""

    n: int
    sums: np.ndarray  # Python integers
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # dimension x component
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Fit:
        """Components whose eigenvalue is not more than rounding are left out: along these nothing varies."""
        centred = n * products - np.outer(sums, sums)
        v = np.array([[c / (n * n) for c in row] for row in centred], np.float64)  # each quotient rounded once
        value, axes = np.linalg.eigh(v)
        value, axes = value[::-1], axes[:, ::-1]
        trace = sum(int(c) for c in np.diagonal(centred)) / (n * n)
        some = int((value[:components] > len(v) * np.finfo(float).eps * trace).sum())
        return cls(n, sums, value[:some].copy(), axes[:, :some].copy(), value[:some] / trace if trace else value[:0])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where that holds it, else Python integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)

    @staticmethod
    def deviation(centred: np.ndarray) -> list[int | None]:
        """Sum of squares of each row; null where a 64-bit integer can't hold it."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < 1 << 63:
            return np.square(centred.astype(np.int64)).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in (int(sum(c * c for c in row)) for row in centred.astype(object))]


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows' places and their numbers, for each length of vector in a batch and in blocks of bounded size."""
    lists = batch.column(column)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        step = max(64, BLOCK // dim // 64 * 64)
        for i in range(0, len(own), step):
            at = own[i : i + step]
            yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's exact sums: n (i and j null), S (j null), P for i <= j."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch, "x"):
            n, sums, products = scatter(x)
            old = total.get(x.shape[1])
            total[x.shape[1]] = [n, sums, products] if old is None else [old[0] + n, old[1] + sums, old[2] + products]
    for dim, (n, sums, products) in total.items():
        for i in range(-1, dim):  # a batch a dimension: its sum and its products
            j = [-1, *range(i, dim)] if i >= 0 else [-1]
            value = [n] if i < 0 else [sums[i], *products[i, i:]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * len(j), pa.int32()), pa.array([i] * len(j), pa.int32()), pa.array(j, pa.int32()),
                    pa.array([str(int(v)) for v in value])
                ],
                names=["dim", "i", "j", "value"]
            )


def fit(x: DataFrame, components: int = 4) -> dict[int, Fit]:
    """A Fit for each length of the vectors ``x`` (array<bigint>): what comes to the driver is as large as the matrices, whatever the rows."""
    parts = x.select("x").mapInArrow(lean(_scatters), "dim int, i int, j int, value string")
    added = parts.groupBy("dim", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toArrow()
    out = {}
    dims, i, j, value = (added.column(c).to_numpy() for c in ("dim", "i", "j", "value"))
    for dim in np.unique(dims).tolist():
        own = dims == dim
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for a, b, v in zip(i[own].tolist(), j[own].tolist(), value[own].tolist(), strict=True):
            if a < 0:
                n = int(v)
            elif b < 0:
                sums[a] = int(v)
            else:
                products[a, b] = products[b, a] = int(v)
        out[dim] = Fit.of(n, sums, products, components)
    return out


def _whitened_moments(x: DataFrame, fits) -> dict[int, float]:
    """The largest entry of the whitened fit list's covariance minus the identity, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, own in _matrices(batch, "x"):
                dim = own.shape[1]
                w = fits.value[dim].whitened(fits.value[dim].centred(own))
                w = np.concatenate((np.ones((len(w), 1)), w), 1)
                total[dim] = total.get(dim, 0) + w.T @ w
        for dim, m in total.items():
            k = len(m)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * k * k, pa.int32()), pa.array(np.repeat(np.arange(k), k), pa.int32()),
                    pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(m.ravel())
                ],
                names=["dim", "i", "j", "value"]
            )

    parts = x.select("x").mapInArrow(lean(run), "dim int, i int, j int, value double")
    found = parts.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()  # (components + 1)^2 rows a length
    out = {}
    for dim, own in fits.value.items():
        k = len(own.values) + 1
        m = np.zeros((k, k))
        for r in found:
            if r["dim"] == dim:
                m[r["i"], r["j"]] = r["value"]
        mean = m[0, 1:] / own.n
        error = m[1:, 1:] / own.n - np.outer(mean, mean) - np.eye(k - 1)
        out[dim] = float(np.abs(error).max(initial=0.0))
    return out


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, components: int = 4
) -> DataFrame:
    """Each usable row's whitened value along the leading components of the distinct vectors' covariance.

    Returns for each usable row and component (numbered from 1 by falling eigenvalue) ``id_col``,
    component, n (distinct x), deviation (sum over dimensions of (n * x - S)^2, exact; null
    beyond 64 bits), whitened, explained (the eigenvalue's share of the trace) and identity_error
    (measured on the whitened distinct vectors).

    Rows are not usable and give nothing where the vector is null or empty, or an entry is
    null, not finite or so large that x reaches 2^40.  Vectors of each length are whitened by themselves,
    with an n, components and an error of their own.  Repeated rows and ids give rows each but
    count once in the fit; null ids stay null.  Vectors that vary along fewer directions have fewer
    components (a single distinct vector none); among equal eigenvalues the axes are one
    orthonormal choice for all rows.  An empty table gives no rows; extra columns aren't read.

    Eager: the distinct vectors are written once to the shared folder and read twice.
    """
    spark = vectors.sparkSession
    ship(spark)
    number = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    v = F.col("v")
    usable = v.isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(float(LIMIT - 1)))
    )
    rows = vectors.select(F.col(id_col), F.col(vec_col).alias("v")).where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col), F.transform("v", number).alias("x")
    )
    distinct = cut(rows.select("x").distinct(), shared_folder(spark), "distinct")
    fits = fit(distinct, components)
    shared = spark.sparkContext.broadcast(fits)  # a few dimension x dimension numbers
    for dim, error in _whitened_moments(distinct, shared).items():
        fits[dim].identity_error = error
    shared = spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                own = shared.value[x.shape[1]]
                centred = own.centred(x)
                k = len(own.values)
                row = pa.array(np.repeat(at, k))
                deviation = pa.array(own.deviation(centred), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                        pa.array(np.full(k * len(at), own.n), pa.int64()), deviation, pa.array(own.whitened(centred).ravel()),
                        pa.array(np.tile(own.explained, len(at))), pa.array(np.full(k * len(at), own.identity_error))
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
                )

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
