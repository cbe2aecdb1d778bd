"""Panel filters, fills, look-ups and summaries by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import level_order


def panel_data(df: DataFrame, with_trolls: bool = False, with_bots: bool = False, scores: bool = False) -> DataFrame:
    """People of a panel without compromised accounts and without bots.

    is_bot stays as it is given; with scores it is set anew from bot_score (0.7 and more) and ntweets_total (50 and more).  Who
    is compromised, or a bot, by a null is not known not to be and goes too.
    """
    out = df if with_trolls else df.filter(~F.col("is_compromised"))
    if scores:
        out = out.withColumn("is_bot", (F.col("bot_score") >= 0.7) & (F.col("ntweets_total") >= 50))
    return out if with_bots else out.filter(~F.col("is_bot"))


def fill_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """Nulls of all numeric columns become value; others stay."""
    return df.fillna(value, [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])


def row_mean(*cols: str) -> Column:
    """Mean of columns of a row; null if any of them is."""
    total = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        total = total + F.col(c)
    return total / len(cols)


def resolve(rows: DataFrame, parsed: DataFrame, key: str, target: str, *choices: str) -> DataFrame:
    """rows with target overwritten by the first non-empty choice of their parse; rows without a parse are dropped."""
    first = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in choices], F.col(key))
    found = parsed.withColumn("__to", first).select(key, "__to").dropDuplicates([key])
    return rows.join(found, key).withColumn(target, F.col("__to")).drop("__to")


def first_seen(rows: DataFrame, key: str, day: str, seen: DataFrame | None = None) -> DataFrame:
    """(key, day): keys that were not seen before, under the first day that has them."""
    fresh = rows if seen is None else rows.join(seen.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(day).alias(day))


def pending(done: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys are not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def summary(df: DataFrame, by: str, levels: list[str], columns: list[str], digits: int = 2) -> DataFrame:
    """Count, and mean, median, standard deviation, minimum and maximum of each column, rounded, in the order of levels."""
    stats = (("mean", F.avg), ("median", F.median), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))
    out = df.groupBy(by).agg(F.count("*").alias("n"), *[F.round(f(c), digits).alias(f"{c}_{name}") for c in columns for name, f in stats])
    return out.withColumn("level", level_order(by, levels)).orderBy("level")


def labels(df: DataFrame, by: str) -> DataFrame:
    """(by, label): how many rows and which share, as N=12, 34%."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(df.agg(F.count("*").alias("of"))).select(by, F.format_string("N=%d, %2.0f%%", "n", 100.0 * F.col("n") / F.col("of")).alias("label"))


def coverage(df: DataFrame, covered: Column, left_out: Column) -> DataFrame:
    """Share of rows that are covered, among those not left out."""
    return df.filter(~left_out).agg((F.count_if(covered) / F.nullif(F.count("*"), F.lit(0))).alias("coverage"))


def krippendorff_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Alpha of two raters on a ratio scale, no missing values, from value counts."""
    d2 = lambda x, y: F.when((F.col(x) + F.col(y)) != 0, ((F.col(x) - F.col(y)) / (F.col(x) + F.col(y))) * ((F.col(x) - F.col(y)) / (F.col(x) + F.col(y)))).otherwise(0.0)
    pairs = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    observed = pairs.agg((2 * F.sum(d2("x", "y"))).alias("do"), (2 * F.count("*")).alias("n"))
    margins = pairs.select(F.col("x").alias("v")).unionByName(pairs.select(F.col("y").alias("v"))).groupBy("v").agg(F.count("*").alias("k"))
    expected = margins.select(F.col("v").alias("x"), F.col("k").alias("kx")).crossJoin(margins.select(F.col("v").alias("y"), F.col("k").alias("ky"))).agg(F.sum(F.col("kx") * F.col("ky") * d2("x", "y")).alias("de"))
    return observed.crossJoin(expected).select((1 - F.col("do") * (F.col("n") - 1) / F.nullif("de", F.lit(0.0))).alias("alpha"))
