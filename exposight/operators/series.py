"""Days, weeks and months around a date; daily roll-ups; changepoints and trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (without: as UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def post_time(text: Column) -> Column:
    """`Tue Nov 08 00:00:00 -0500 2016` as an instant."""
    return F.to_timestamp(F.substring(text, 5, 40), "MMM dd HH:mm:ss Z yyyy")


def offset_hours(text: Column) -> Column:
    sign = F.when(F.substring(text, 21, 1) == "-", -1).otherwise(1)
    return sign * (F.substring(text, 22, 2).cast("int") + F.substring(text, 24, 2).cast("int") / 60)


def local_month(text: Column) -> Column:
    """The month on the writer's clock."""
    return F.month(F.to_date(F.concat(F.substring(text, 5, 6), F.substring(text, 26, 5)), "MMM dd yyyy"))


def relative_days(ts: Column, ref_micros: int, per: int = 1) -> Column:
    """Whole periods of `per` days since the reference, rounded down also before it."""
    return F.floor((micros(ts) - F.lit(ref_micros)) / F.lit(float(DAY * per))).cast("long")


def daily_percents(df: DataFrame, day: str, color: str, colors: list[str]) -> DataFrame:
    """Counts by day of each colour and of all, and their shares; pct_fake is the sum of the shares."""
    low = [c.lower() for c in colors]
    out = df.groupBy(day).agg(F.count("*").alias("N"), *[F.count_if(F.col(color) == c).alias(n) for c, n in zip(colors, low)])
    for n in low:
        out = out.withColumn(f"pct_{n}", F.col(n) / F.col("N"))
    return out.withColumn("pct_fake", sum((F.col(f"pct_{n}") for n in low[1:]), F.col(f"pct_{low[0]}")))


def segments(values: np.ndarray, penalty: float) -> list[int]:
    """Ends of the segments of least cost: squares around each mean, plus a penalty a changepoint (PELT pruning)."""
    s, q = np.concatenate(([0], np.cumsum(values))), np.concatenate(([0], np.cumsum(values**2)))
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    best, last, live = [-penalty], [0], [0]
    for t in range(1, len(values) + 1):
        c = [best[a] + cost(a, t) + penalty for a in live]
        k = int(np.argmin(c))
        best.append(c[k])
        last.append(live[k])
        live = [a for a, v in zip(live, c) if v - penalty <= best[t]] + [t]
    out, t = [], len(values)
    while t:
        out.append(t)
        t = last[t]
    return out[::-1]


def changepoints(df: DataFrame, by: list[str], order: str, value: str, penalty: float) -> DataFrame:
    """Each row's segment (from 1) and the segment's mean.  A series is one group: days, not rows, make its length."""
    schema = df.select(*by, order, value).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        ends = segments(pdf[value].to_numpy(float), penalty)
        seg = np.searchsorted(ends, np.arange(len(pdf)), "right") + 1
        return pdf[[*by, order, value]].assign(segment=seg, segment_mean=pdf.groupby(seg)[value].transform("mean").to_numpy())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{fields}, segment long, segment_mean double")


def segment_of(df: DataFrame, position: str, cuts: list[int]) -> DataFrame:
    """Segment number by cuts: intervals (c[i-1], c[i]], the first is 1."""
    n = F.lit(1)
    for c in cuts:
        n = n + (F.col(position) > c).cast("int")
    return df.withColumn("segment", n.cast("long"))


def linear_trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def running_cap(df: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= cap).drop("__n")


def age(birth_date: Column, year: int) -> Column:
    """Years from the year of a date as text (YYYY-MM-DD) to `year`; null for anything else."""
    return F.lit(year) - F.regexp_extract(birth_date, r"^(\d{4})-\d{2}-\d{2}$", 1).try_cast("int")


def days_between(ts: Column, start: str, first: int, last: int) -> Column:
    """Whole days from start, null outside first to last."""
    day = F.date_diff(F.to_date(ts), F.lit(start).cast("date")).cast("long")
    return F.when(day.between(first, last), day)
