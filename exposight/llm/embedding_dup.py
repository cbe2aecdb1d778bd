"""Near-duplicate vectors: PCA-ordered tiled comparison with exact bounds.

Vectors are turned into the order of their principal axes (a rotation keeps products).  A tile first adds
up products over the leading axes; what the rest can still add is at most the product of both suffix norms,
so pairs that cannot reach the threshold are left, and the rest go on.  Equal vectors collapse first, and a tile
returns link counts and a spanning forest, not links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import materialize
from .components import connected_components

CELLS = 1024


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in column])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        groups: dict[int, list] = {}
        for x in batch.column("v").to_pylist():
            groups.setdefault(len(x), []).append(x)
        for d, rows in groups.items():
            x = np.array(rows, float)
            x /= np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(1, keepdims=True)
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "sums": pa.array(m.tolist(), pa.list_(pa.float64()))})


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x and y with a cosine of at least `least`; within one block only i < j."""
    a, b = unit(x) @ axes, unit(y) @ axes
    d, slack = a.shape[1], 1e-9
    suffix = lambda z, k: np.sqrt(np.maximum(0, (z[:, k:] ** 2).sum(1)))
    steps = [k for k in (d // 8, d // 4, d // 2) if k] + [d]
    k = steps[0]
    part = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(part + np.outer(suffix(a, k), suffix(b, k)) >= least - slack)
    if same:
        i, j = i[i < j], j[i < j]
    part = part[i, j]
    for k, nxt in zip(steps, steps[1:]):
        keep = []
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            part[s : s + (1 << 16)] += np.einsum("ij,ij->i", a[p, k:nxt], b[q, k:nxt])
            keep.append(part[s : s + (1 << 16)] + suffix(a, nxt)[p] * suffix(b, nxt)[q] >= least - slack)
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j, part = i[ok], j[ok], part[ok]
    keep = []
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    ux, uy = unit(x), unit(y)
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        with np.errstate(all="ignore"):
            plain = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q])
        keep.append(np.where(np.isfinite(plain) & (nx[p] * ny[q] > 1e-200), plain, np.einsum("ij,ij->i", ux[p], uy[q])) >= least)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links between nodes."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _tile(axes: dict[int, np.ndarray], least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
        same = bool((pdf["side"] == 2).any())
        x, y = matrix(left["v"]), matrix(right["v"])
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        i, j = linked_pairs(x, y, axes[x.shape[1]], least, same)
        ra, rb, ma, mb = left["rep"].to_numpy(), right["rep"].to_numpy(), left["m"].to_numpy(), right["m"].to_numpy()
        ca, cb = np.bincount(i, mb[j], len(ra)), np.bincount(j, ma[i], len(rb))
        pairs = forest(i, len(ra) + j if not same else j)
        ids = np.concatenate((ra, rb)) if not same else ra
        out = [(r, None, int(c)) for r, c in zip(ra, ca) if c] + [(r, None, int(c)) for r, c in zip(rb, cb) if c] + [(ids[p], ids[q], 0) for p, q in pairs]
        return pd.DataFrame({"a": pd.array([r for r, _, _ in out], "Int64"), "b": pd.array([b for _, b, _ in out], "Int64"), "n": pd.array([n for *_, n in out], "Int64")})

    return run


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df.

    Vectors of one label (not null) and length are linked if their cosine, in double precision, is at least
    `least`.  n_links counts the other vectors linked directly, component_id is the least id reachable.
    Vectors that are null, empty, zero or hold a null or a non-finite number link with nothing, nor do rows with a
    null id.  Rows that repeat an id and vector are one vector and get the same answer; other columns are ignored.
    An empty table gives an empty one.
    """
    spark = df.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = base.filter("id is not null and label is not null and v is not null").filter(fine)
    classes = valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("m"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "vectors")
    sums = classes.select("v").mapInArrow(_moments, "dim int, i int, sums array<double>").select("dim", "i", F.posexplode("sums").alias("j", "s")).groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    axes: dict[int, np.ndarray] = {}
    for r in sums.collect():  # the square of each vector length
        axes.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["s"]
    axes = {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in axes.items()}
    shared = spark.sparkContext.broadcast(axes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = [float((unit(np.array([x], float)) @ shared.value[len(x)][:, :1])[0, 0]) for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.float64())], names=[*batch.schema.names, "lead"])

    placed = materialize(classes.mapInArrow(first, T.StructType([*classes.schema, T.StructField("lead", T.DoubleType())])), "placed")
    quantiles = placed.groupBy("label", "dim").agg(F.expr(f"percentile_approx(lead, array({', '.join(f'{k / CELLS}D' for k in range(1, CELLS))}), 10000)").alias("cuts"), F.count("*").alias("n"))
    cell = F.size(F.filter("cuts", lambda c: c < F.col("lead")))
    cells = F.least(F.lit(CELLS), F.ceil(F.col("n") / block))
    placed = placed.join(quantiles, ["label", "dim"]).withColumn("cell", F.floor(cell * cells / CELLS).cast("int")).drop("cuts", "n")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("in_cell"))
    placed = placed.join(sizes, ["label", "dim", "cell"])
    placed = materialize(placed.withColumn("sub", F.pmod(F.xxhash64("rep"), F.ceil(F.col("in_cell") / block)).cast("int")).drop("in_cell"), "blocks")
    blocks = materialize(placed.groupBy("label", "dim", "cell", "sub").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi")), "tiles")
    one = blocks.select("label", "dim", *[F.col(c).alias(f"{c}_a") for c in ("cell", "sub", "lo", "hi")])
    two = blocks.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("cell", "sub", "lo", "hi")])
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9  # unit vectors further apart on an axis are less alike
    near = one.join(two, ["label", "dim"]).filter((F.struct("cell_a", "sub_a") <= F.struct("cell_b", "sub_b")) & (F.col("lo_b") - F.col("hi_a") <= reach) & (F.col("lo_a") - F.col("hi_b") <= reach))
    near = near.select("label", "dim", "cell_a", "sub_a", "cell_b", "sub_b", F.concat_ws("/", "label", "dim", "cell_a", "sub_a", "cell_b", "sub_b").alias("pair"))
    diagonal = (F.col("cell_a") == F.col("cell_b")) & (F.col("sub_a") == F.col("sub_b"))
    own = near.select("label", "dim", F.col("cell_a").alias("cell"), F.col("sub_a").alias("sub"), "pair", F.when(diagonal, 2).otherwise(0).alias("side"))
    other = near.filter(~diagonal).select("label", "dim", F.col("cell_b").alias("cell"), F.col("sub_b").alias("sub"), "pair", F.lit(1).alias("side"))
    sent = placed.select("label", "dim", "cell", "sub", "rep", "m", "v").join(own.unionByName(other), ["label", "dim", "cell", "sub"]).select("pair", "side", "rep", "m", "v")
    found = materialize(sent.groupBy("pair").applyInPandas(_tile(axes, least), "a long, b long, n long"), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    members = valid.join(classes.filter("m > 1").select("label", "v", "rep"), ["label", "v"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(found.filter("b is not null").select("a", "b").unionByName(members))
    by_class = classes.join(counts, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    return (
        base.join(by_class, ["label", "v"], "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"))
    )
