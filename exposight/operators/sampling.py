"""Sampling in a fixed order: rows are ordered by md5 of a key and a salt, so samples repeat on any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import running


def order_key(salt: str | Column, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], salt if isinstance(salt, Column) else F.lit(salt)))


def sample_rows(df: DataFrame, n: int, salt: str, *keys: str) -> DataFrame:
    return df.orderBy(order_key(salt, *keys), *keys).limit(n)


def stratified_cap(df: DataFrame, by: list[str], cap: int, salt: str, *keys: str) -> DataFrame:
    """At most cap rows of each stratum."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(order_key(salt, *keys), *keys))).filter(F.col("__n") <= cap).drop("__n")


def balanced(df: DataFrame, label: str, salt: str, *keys: str) -> DataFrame:
    """All positives and as many negatives, the first by hash."""
    pos, neg = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    n = pos.count()
    ranked = running(neg.withColumn("__key", order_key(salt, *keys)), [F.col("__key"), *map(F.col, keys)], {"__n": F.lit(1)})
    return pos.unionByName(ranked.filter(F.col("__n") < n).drop("__n", "__key"))


def folds(df: DataFrame, k: int, salt: str, *keys: str) -> DataFrame:
    """A fold from 0 to k-1 by hash."""
    return df.withColumn("fold", F.conv(F.substring(order_key(salt, *keys), 1, 7), 16, 10).cast("long") % k)


def random_units(df: DataFrame, unit: str, n: int, replicates: int) -> DataFrame:
    """(unit, rep, and the other columns): n random units for each replicate, the first by hash."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))))
    key = F.md5(F.concat_ws("|", F.col(unit).cast("string"), F.col("rep").cast("string")))
    return reps.withColumn("__n", F.row_number().over(W.partitionBy("rep").orderBy(key, unit))).filter(F.col("__n") <= n).drop("__n")


def random_ginis(df: DataFrame, unit: str, value: str, n: int, replicates: int) -> DataFrame:
    """Gini of the values of n random units, for each replicate: ranks by hash, then one grouped Gini."""
    from .stats import gini

    return gini(random_units(df.select(unit, value), unit, n, replicates), value, ["rep"], unit)


def cap_expected(daily: DataFrame, caps: list[int], total: str = "n", fake: str = "fake") -> DataFrame:
    """Expected fake and other posts kept if each person may post `cap` a day in random order: min(n, cap) * fake / n."""
    c = daily.withColumn("cap", F.explode(F.array(*[F.lit(x).cast("long") for x in caps])))
    kept = F.least(F.col(total), F.col("cap")) / F.nullif(F.col(total), F.lit(0))
    return c.groupBy("cap").agg(F.sum(kept * F.col(fake)).alias("kept_fake"), F.sum(kept * (F.col(total) - F.col(fake))).alias("kept_other"), F.sum(fake).alias("all_fake"), F.sum(F.col(total) - F.col(fake)).alias("all_other"))


def cap_trials(posts: DataFrame, person: list[str], fake: Column, caps: list[int], trials: int, *keys: str) -> DataFrame:
    """Fake and other posts kept in each trial under each cap; the order of a day's posts is a hash of trial and key."""
    t = posts.withColumn("__fake", fake).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    key = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("trial").cast("string")))
    ranked = t.withColumn("__r", F.row_number().over(W.partitionBy("trial", *person).orderBy(key, *keys)))
    aggs = [F.count_if((F.col("__r") <= c) & (F.col("__fake") == x)).alias(f"{n}_{c}") for c in caps for n, x in (("fake", True), ("other", False))]
    wide = ranked.groupBy("trial").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("cap"), F.col(f"fake_{c}").alias("kept_fake"), F.col(f"other_{c}").alias("kept_other")) for c in caps])
    return wide.select(F.col("trial").cast("long").alias("trial"), F.explode(rows).alias("r")).select("trial", "r.*")


def restored(trials: DataFrame, totals: DataFrame, by: list[str], kept: list[str], times: int = 1000) -> DataFrame:
    """(by, and for each kept column c: c_share, c_lo, c_hi): the mean over trials as a share of the original total, with a 95 % bootstrap interval.

    totals has one row with a column of the same name for each kept column.
    """
    from .stats import bootstrap_mean

    out = None
    total = totals.first()
    for c in kept:
        ci = bootstrap_mean(trials, c, by, times)
        part = ci.select(*by, *[(F.col(x) / F.nullif(F.lit(float(total[c])), F.lit(0.0))).alias(f"{c}_{n}") for x, n in (("mean", "share"), ("lo", "lo"), ("hi", "hi"))])
        out = part if out is None else out.join(part, by)
    return out
