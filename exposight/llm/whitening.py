"""Whitening of embeddings from exact sums of whole numbers.

Entries become whole numbers.  A centred vector n*x - S is a vector of whole numbers too; it is split into limbs of a
few bits, so that products of limbs summed over a block of rows stay below 2**53 and float64 matrix
products are exact.  Products of limbs are merged as decimals, recombined as big integers, and only the finished
covariance is rounded, once for each entry; its eigenvectors give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, tidy

BITS = 20  # of a limb
BLOCK = 1 << 12  # rows whose products are summed in float64: 12 + 2 * 20 bits
FLUSH = 1 << 10  # blocks summed in 64-bit integers before they become big integers
#: Entries of at least this size have no place in a long and their rows are dropped.
LARGEST = 2.0**52


def whole_numbers(vec: Column, scale: int, shift: int) -> Column:
    return F.transform(vec, lambda c: F.floor(c * float(scale)).cast("long") + shift)


def usable(vec: Column, scale: int) -> Column:
    """Not null, not empty, and all entries finite and of a size that a long holds."""
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < LARGEST)), F.lit(False))


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by their length: (row numbers, matrix)."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, flat[starts[rows][:, None] + np.arange(d)]
    return out


def limbs(x: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Digits d0, d1, ... of -2**(bits-1) to 2**(bits-1) with x = sum d_k 2**(k bits), as float64."""
    out, half = [], 1 << (bits - 1)
    while True:
        digit = ((x + half) & ((1 << bits) - 1)) - half
        out.append(digit.astype(float))
        x = (x - digit) >> bits
        if not x.any():
            return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S: 64-bit integers where they hold it, else Python's."""
    s = np.array(sums, object)
    most = max((abs(n * int(v) - t) for row in (x.min(0), x.max(0)) for v, t in zip(row.tolist(), sums)), default=0) if len(x) else 0
    if most < 1 << 62 and n * int(np.abs(x).max(initial=0)) < 1 << 62 and all(abs(t) < 1 << 62 for t in sums):
        return x * n - s.astype(np.int64)
    return x.astype(object) * n - s


def squares(d: np.ndarray) -> list[int]:
    """Sums of squares by row, exactly."""
    if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0**62:
        return (d.astype(object) ** 2).sum(1).tolist()
    return (d * d).sum(1).tolist()


def gram(x: np.ndarray, bits: int = BITS, block: int = BLOCK) -> np.ndarray:
    """x.T @ x of whole numbers as Python integers: limb products by float64 matrix multiplication, recombined."""
    total: dict[int, np.ndarray] = {}
    for a in range(0, len(x), block):
        add_limbs(total, x[a : a + block], bits)
    return recombine(total, x.shape[1], bits)


def add_limbs(total: dict[int, np.ndarray], x: np.ndarray, bits: int = BITS) -> None:
    """Adds products of limbs i and j to total[i + j]; at most 2**53 each, so float64 holds them exactly."""
    parts = limbs(x, bits)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            p = (a.T @ parts[j]).astype(np.int64)
            total[i + j] = total.get(i + j, 0) + (p if i == j else p + p.T)


def recombine(total: dict[int, np.ndarray], d: int, bits: int = BITS) -> np.ndarray:
    out = np.zeros((d, d), object)
    for level, m in total.items():
        out = out + m.astype(object) * (1 << bits * level)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    s: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, (_, x) in matrix(batch.column("x")).items():
            n[d] = n.get(d, 0) + len(x)
            s[d] = s.get(d, 0) + x.astype(object).sum(0) if float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62 else s.get(d, 0) + x.sum(0).astype(object)
    dims = [d for d in n for _ in range(d)]
    values = [Decimal(int(v)) for d in n for v in s[d]]
    yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([j for d in n for j in range(d)], pa.int32()), pa.array([n[d] for d in dims], pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["dim", "j", "n", "s"])


def _products(moments: dict[int, tuple[int, list[int]]]):
    """Batches of x -> rows (dim, level, i, values): the upper half of the sums of limb products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: dict[int, dict[int, np.ndarray]] = {}
        large: dict[int, dict[int, np.ndarray]] = {}
        blocks = 0

        def flush() -> None:
            for d, levels in small.items():
                for level, m in levels.items():
                    large.setdefault(d, {})[level] = large.get(d, {}).get(level, 0) + m.astype(object)
            small.clear()

        for batch in batches:
            for d, (_, x) in matrix(batch.column("x")).items():
                for a in range(0, len(x), BLOCK):
                    add_limbs(small.setdefault(d, {}), centred(x[a : a + BLOCK], *moments[d]))
                    blocks += 1
            if blocks >= FLUSH:
                flush()
                blocks = 0
        flush()
        for d, levels in large.items():
            for level, m in levels.items():
                values = pa.array([[Decimal(int(v)) for v in m[i, i:]] for i in range(d)], pa.list_(pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([level] * d, pa.int32()), pa.array(range(d), pa.int32()), values], names=["dim", "level", "i", "values"])

    return run


@dataclass
class Whitening:
    """Of vectors of one length: n, sums S, components (columns, by falling eigenvalue), eigenvalues, their share of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def apply(self, d: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows n*x - S."""
        return (d.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def decompose(n: int, sums: list[int], gram_centred: np.ndarray, most: int) -> Whitening:
    """From the exact n**2 times n times the covariance; components without variance (beyond double precision) are left out."""
    scale = n**3
    v = np.array([[int(c) / scale for c in row] for row in gram_centred], float)  # true division of integers rounds once
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    trace = sum(int(gram_centred[k, k]) for k in range(len(v))) / scale
    keep = values[:most] > max(values[0], 0.0) * len(v) * 2.0**-44
    k = int(keep.sum())
    values, axes = values[:k].copy(), axes[:, :k].copy()
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0) if k else 1.0
    return Whitening(n, sums, axes, values, values / trace if trace else values)


def fit(distinct: DataFrame, most: int = 16) -> dict[int, Whitening]:
    """A whitening for each length of x in distinct(x)."""
    moments: dict[int, tuple[int, list[int]]] = {}
    sums = distinct.mapInArrow(_sums, "dim int, j int, n long, s decimal(38,0)").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for r in sums.orderBy("dim", "j").collect():  # a row for each dimension
        moments.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    wide = 2 * distinct.sparkSession.sparkContext.defaultParallelism  # a task returns a matrix, so there are few tasks
    products = distinct.coalesce(wide).mapInArrow(tidy(_products(moments)), "dim int, level int, i int, values array<decimal(38,0)>")
    merged = products.select("dim", "level", "i", F.posexplode("values").alias("j", "v")).groupBy("dim", "level", "i", "j").agg(F.sum("v").alias("v"))
    totals = {d: {} for d in moments}
    for r in merged.collect():  # dimension * (dimension + 1) / 2 rows for each level
        m = totals[r["dim"]].setdefault(r["level"], np.zeros((r["dim"], r["dim"]), object))
        m[r["i"], r["i"] + r["j"]] = m[r["i"] + r["j"], r["i"]] = int(r["v"])
    return {d: decompose(*moments[d], recombine(totals[d], d), most) for d in moments}


def _second_moments(models: dict[int, Whitening]):
    """Batches of x -> (dim, i, j, v, m): sums of products of whitened coordinates, and of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, (_, x) in matrix(batch.column("x")).items():
                for a in range(0, len(x), BLOCK):
                    w = models[d].apply(centred(x[a : a + BLOCK], models[d].n, models[d].sums))
                    one = np.hstack((w, np.ones((len(w), 1))))
                    total[d] = total.get(d, 0) + one.T @ one
        for d, m in total.items():
            k = len(m)
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array([d] * (k * k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], names=["dim", "i", "j", "v"])

    return run


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By length: the largest absolute entry of the whitened covariance (over distinct, divisor n, about the whitened mean) minus the identity."""
    found: dict[int, np.ndarray] = {d: np.zeros((len(w.values) + 1,) * 2) for d, w in models.items()}
    for r in distinct.mapInArrow(_second_moments(models), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[r["dim"]][r["i"], r["j"]] = r["v"]
    out = {}
    for d, m in found.items():
        n, mean = models[d].n, m[:-1, -1] / models[d].n
        out[d] = float(np.abs(m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return out


def _rows(models: dict[int, Whitening], errors: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (rows, x) in matrix(batch.column("x")).items():
                model = models[d]
                k = len(model.values)
                for a in range(0, len(x), BLOCK):
                    c = centred(x[a : a + BLOCK], model.n, model.sums)
                    w, m = model.apply(c), len(c)
                    deviation = [Decimal(v) if v < 10**38 else None for v in squares(c)]
                    columns = [
                        batch.column("id").take(pa.array(np.repeat(rows[a : a + m], k))),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n), pa.int64()),
                        pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w.ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, errors[d])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to `most` rows for each usable row of df.

    x is floor(scale * entry) + shift.  The covariance is that of the different x, each once.  Rows are left out whose vector is
    null or empty or holds a null, a non-finite number or one too large for a long (2**52 and more after scaling).
    Vectors of different lengths are fitted apart.  Components without variance, as when all vectors are equal,
    have no rows.  deviation, the sum of (n*x - S)**2, is a decimal, null past 38 digits.  Rows that repeat an id, or have none,
    are answered one by one.  Other columns are ignored; an empty table gives an empty one.
    """
    vec = F.col("v")
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(usable(vec, scale))
    base = base.select("id", whole_numbers(vec, scale, shift).alias("x"))
    distinct = materialize(base.select("x").distinct(), "vectors")
    models = fit(distinct, most)
    errors = identity_errors(distinct, models)
    return base.mapInArrow(_rows(models, errors), "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
