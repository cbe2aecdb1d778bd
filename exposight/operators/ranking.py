"""Ranking, cumulative shares, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import keep


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null groups meet; with no columns in by, right is one row for all."""
    if not by:
        return left.join(right, how="cross" if how == "inner" else how)
    named = right.select(*[F.col(c).alias(f"__right_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in by]
    return left.join(named, on, how).drop(*[f"__right_{c}" for c in by])


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """df with a column for each of sums: the sum over the rows before, in order, of its group (0 for the first); totals adds sums over whole groups.

    Rows are dealt by ranges of group and order, each range is summed alone, and the totals of the ranges before, a few for
    each group, are added in front.  So no task holds a group, however large; rows alike in all order columns may come
    in any order.  The ranges are written first: they are the same for whatever reads them.
    """
    by, totals = by or [], totals or {}
    values = {f"__{k}": v for k, v in sums.items()}
    part = ["__range", *by]
    dealt = keep(df.withColumns(values).repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    ends = dealt.groupBy(*part).agg(*[F.sum(f"__{k}").alias(f"__sum_{k}") for k in sums], *[F.sum(v).alias(f"__all_{k}") for k, v in totals.items()])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    front = group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    ends = ends.select(*part, *[F.coalesce(F.sum(f"__sum_{k}").over(front), F.lit(0)).alias(f"__sum_{k}") for k in sums], *[F.sum(f"__all_{k}").over(group).alias(k) for k in totals])
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = join_groups(dealt, ends, part)
    out = joined.withColumns({k: F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) + F.col(f"__sum_{k}") for k in sums})
    return out.drop("__range", *values, *[f"__sum_{k}" for k in sums])


def rank_by(df: DataFrame, value: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """rank (from 1, greatest value first, ties by the tie column) and cumperc, the running share of the total, over all rows or each group."""
    out = running(df, [F.desc_nulls_last(value), F.col(tie)], {"__rank": F.lit(1), "__cum": F.col(value)}, by, {"__of": F.col(value)})
    cum = F.coalesce(F.col(value), F.lit(0)) + F.col("__cum")
    return out.withColumn("rank", (F.col("__rank") + 1).cast("long")).withColumn("cumperc", cum / F.nullif("__of", F.lit(0))).drop("__rank", "__cum", "__of")


def responsible(df: DataFrame, value: str, tie: str, share: float = 0.8) -> DataFrame:
    """Those who together make up to `share` of the total; who crosses it is left out."""
    return rank_by(df, value, tie).filter(F.col("cumperc") <= share)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_and_rest(df: DataFrame, value: str, tie: str, n: int, sums: list[str]) -> DataFrame:
    """Sums for each of the first n and, as number n+1, for everyone else."""
    top = df.orderBy(F.desc(value), tie).limit(n).withColumn("ind", F.row_number().over(W.orderBy(F.desc(value), tie)).cast("long"))
    some = top.select(tie, "ind")
    return df.join(F.broadcast(some), tie, "left").withColumn("ind", F.coalesce("ind", F.lit(n + 1).cast("long"))).groupBy("ind").agg(*[F.sum(c).alias(c) for c in sums])


def first_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an explicit order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def level_order(column: str, levels: list[str]) -> Column:
    """A sort key by an external list of levels."""
    return F.array_position(F.array(*map(F.lit, levels)), F.col(column))
