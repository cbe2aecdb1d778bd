"""Kernel density by sums over cells: rows never meet the points of the curve.

Rows are gathered in cells an eighth of a bandwidth wide; a cell keeps its count and the first powers of its rows' distances
from its middle.  A cell's part of the curve is the Taylor series of the Gaussian kernel about the middle (with
Hermite polynomials), which with six powers is right to about 1e-10 of the kernel's height.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import join_groups

POWERS = 6
CELLS = 8  # in a bandwidth
REACH = 8.5  # bandwidths, past which a kernel is below 1e-15 of its height


def bandwidth(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, bw): 0.9 n^(-1/5) times the least of the standard deviation and the quartile range over 1.34; where that is 0, of what is left, at last 1."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    s = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd"), q.alias("q"), F.abs(F.first(value)).alias("one"))
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    width = F.coalesce(F.nullif(F.least("sd", iqr), F.lit(0.0)), F.nullif("sd", F.lit(0.0)), F.nullif("one", F.lit(0.0)), F.lit(1.0))
    return s.select(*by, (0.9 * width * F.pow(F.col("n"), F.lit(-0.2))).alias("bw"))


def density(df: DataFrame, value: str, by: list[str], bw: float | None = None, points: int = 512, cut: float = 3.0) -> DataFrame:
    """(by, x, density): a Gaussian kernel density at `points` places from `cut` bandwidths below the least value to as many above the greatest.

    bw is one bandwidth for all groups, or by default that of `bandwidth` for each.  Null values are left out; a group without values has no
    rows.  A null in by is a group of its own.
    """
    v = df.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    spans = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = join_groups(spans, bandwidth(v, "v", by), by) if bw is None else spans.withColumn("bw", F.lit(float(bw)))
    spans = spans.select(*by, "n", "bw", (F.col("lo") - cut * F.col("bw")).alias("from"), ((F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (points - 1)).alias("step"))
    rows = join_groups(v, spans, by)
    u = (F.col("v") - F.col("from")) / F.col("bw")
    rows = rows.withColumn("cell", F.floor(u * CELLS)).withColumn("d", u - (F.col("cell") + 0.5) / CELLS)
    power = lambda k: F.lit(1.0) if not k else F.pow("d", F.lit(float(k)))
    cells = rows.groupBy(*by, "cell").agg(*[F.sum(power(k)).alias(f"m{k}") for k in range(POWERS + 1)], *[F.first(c).alias(c) for c in ("bw", "from", "step", "n")])
    middle = (F.col("cell") + 0.5) / CELLS  # in bandwidths from the first point
    near = [F.ceil((middle - REACH) * F.col("bw") / F.col("step")), F.floor((middle + REACH) * F.col("bw") / F.col("step"))]
    at = cells.withColumn("point", F.explode(F.sequence(F.greatest(near[0], F.lit(0)), F.least(near[1], F.lit(points - 1)))))
    z = F.col("point") * F.col("step") / F.col("bw") - middle
    part = F.exp(-z * z / 2) * _series(z)
    sums = at.groupBy(*by, "point").agg(F.sum(part).alias("s"))
    grid = spans.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    height = F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return join_groups(grid, sums, [*by, "point"], "left").select(*by, (F.col("from") + F.col("point") * F.col("step")).alias("x"), height.alias("density"))


def _series(z: Column) -> Column:
    """sum over k of m_k He_k(z) / k!, where exp(-(z - d)^2 / 2) = exp(-z^2 / 2) sum He_k(z) d^k / k!."""
    before, here = F.lit(0.0), F.lit(1.0)
    total = F.col("m0")
    for k in range(1, POWERS + 1):
        before, here = here, z * here - (k - 1) * before
        total = total + F.col(f"m{k}") * here / math.factorial(k)
    return total
