"""Statistics in closed form, as columns or aggregates, and those that need a special function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running
from .tails import t_two_sided, t_upper

Z95 = 1.959963984540054


def gini(df: DataFrame, value: str, by: list[str], tie: str | None = None, n: Column | None = None) -> DataFrame:
    """(by, gini, n): Gini coefficient of each group, (2 sum(i * y_i) / sum(y) - (n + 1)) / n with values in ascending order.

    With n, a column over by, each group is filled up with zeros to n values.  Values alike are counted first: k of them after
    `before` others have ranks that add up to k * before + k (k + 1) / 2.  Running counts go through ranges, so no task holds a group.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__k")).filter(F.col(value).isNotNull())
    ranked = running(counts, [F.col(value)], {"__before": F.col("__k")}, by)
    k, v = F.col("__k").cast("double"), F.col(value).cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("__k").alias("__len"), F.sum(k * v).alias("__total"), F.sum((k * F.col("__before") + k * (k + 1) / 2) * v).alias("__weighed"))
    out = sums.withColumn("n", F.greatest(n.cast("long"), "__len") if n is not None else F.col("__len"))
    weighed = F.col("__weighed") + (F.col("n") - F.col("__len")) * F.col("__total")  # zeros come first: every rank moves up by their number
    return out.select(*by, ((2 * weighed / F.nullif("__total", F.lit(0.0)) - (F.col("n") + 1)) / F.col("n")).alias("gini"), "n")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = x / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def agresti_coull(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    m = n + z * z
    p = (x + z * z / 2) / m
    half = z * F.sqrt(p * (1 - p) / m)
    return p - half, p + half


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= hi2) & (lo2 <= hi1)


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Chi-square of two proportions with Yates' correction."""
    p = (x1 + x2) / (n1 + n2)
    d = F.abs(x1 / n1 - x2 / n2)
    fix = F.least(F.lit(0.5) * (1 / n1 + 1 / n2), d)
    return (d - fix) * (d - fix) / (p * (1 - p) * (1 / n1 + 1 / n2))


def welch(df: DataFrame, value: str, test: Column) -> DataFrame:
    """t, degrees of freedom and p (two-sided, and for a greater mean) for the mean of value where test holds against where it does not."""
    g = [F.avg(F.when(c, F.col(value))).alias(f"m{i}") for i, c in ((1, test), (0, ~test))]
    g += [F.var_samp(F.when(c, F.col(value))).alias(f"v{i}") for i, c in ((1, test), (0, ~test))] + [F.count(F.when(c, F.col(value))).alias(f"n{i}") for i, c in ((1, test), (0, ~test))]
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    out = df.agg(*g).select(((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("dof"))
    return out.select("t", "dof", t_two_sided(F.col("t"), F.col("dof")).alias("p"), t_upper(F.col("t"), F.col("dof")).alias("p_greater"))


def krippendorff_nominal(df: DataFrame, a: str, b: str) -> DataFrame:
    """Alpha of two raters, nominal, no missing values, from the coincidence table."""
    pairs = df.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    table = both.groupBy("x", "y").agg(F.count("*").alias("o"))
    margins = both.groupBy("x").agg(F.count("*").alias("nx"))
    observed = table.agg(F.sum("o").alias("n"), F.sum(F.when(F.col("x") != F.col("y"), F.col("o")).otherwise(0)).alias("do"))
    same = margins.agg(F.sum(F.col("nx") * (F.col("nx") - 1)).alias("same"))
    n = F.col("n")
    return observed.crossJoin(same).select((1 - F.col("do") * (n - 1) / (n * (n - 1) - F.col("same"))).alias("alpha"))


def confusion(label: Column, predicted: Column) -> list[Column]:
    return [F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"), F.count_if(label & ~predicted).alias("fn"), F.count_if(~label & ~predicted).alias("tn")]


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums; ties have mean ranks.  Scores are counted first, and running counts go through ranges."""
    by_score = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    won = F.col("pos") * (F.col("__below") + F.col("neg") / 2)
    return running(by_score, [F.col(score)], {"__below": F.col("neg")}).withColumn("won", won).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def survey_mean(df: DataFrame, value: Column, weight: str, by: list[str]) -> DataFrame:
    """Weighted mean, its linearised standard error, and mean -+ 2 SE."""
    v = df.withColumn("__v", value.cast("double"))
    means = v.groupBy(*by).agg(weighted_mean(F.col("__v"), F.col(weight)).alias("mean"), F.sum(weight).alias("__w"), F.count("*").alias("__n"))
    terms = v.join(means, by).withColumn("__u", F.col(weight) * (F.col("__v") - F.col("mean")) / F.col("__w"))
    se = terms.groupBy(*by).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("__u") * F.col("__u")) * F.first("__n") / F.nullif(F.first("__n") - 1, F.lit(0))).alias("se"))
    return se.select(*by, "mean", "se", (F.col("mean") - 2 * F.col("se")).alias("lo"), (F.col("mean") + 2 * F.col("se")).alias("hi"))


def tolerance(diff: Column, steps: list[int]) -> list[Column]:
    return [F.avg((F.abs(diff) <= k).cast("double")).alias(f"within_{k}") for k in steps]


def five_numbers(column: str) -> Column:
    return F.percentile(column, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))


def bootstrap_mean(df: DataFrame, value: str, by: list[str], times: int = 1000, seed: int = 1) -> DataFrame:
    """Mean and a 95 % interval by the Poisson bootstrap: each row weighs a Poisson(1) draw in each replicate.

    Rows spread to replicates as partial sums inside tasks: a task keeps `times` sums a group, and only those are shuffled.
    """
    schema = df.select(*by).schema

    def run(batches):
        rng = np.random.default_rng(seed)
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                v = part[value].to_numpy(float)
                v = v[~np.isnan(v)]
                acc = sums.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((2, times)))
                for s in range(0, len(v), 2000):
                    w = rng.poisson(1.0, (len(v[s : s + 2000]), times))
                    acc += np.stack([v[s : s + 2000] @ w, w.sum(0)])
        rows = [(*key, r, float(a[0, r]), float(a[1, r])) for key, a in sums.items() for r in range(times)]
        yield pd.DataFrame(rows, columns=[*by, "rep", "s", "w"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    reps = df.select(*by, value).mapInPandas(run, f"{fields}, rep int, s double, w double").groupBy(*by, "rep").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ci = reps.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(ci, by)
