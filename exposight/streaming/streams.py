"""Streaming forms: daily counts, first-seen dedup, sessions, a running cap."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def daily_counts(stream: DataFrame, ts: str, kind: str, late: str = "2 days") -> DataFrame:
    """Counts by day and kind; rows later than `late` are dropped once their day has closed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), kind, "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def capped(stream: DataFrame, by: list[str], cap: int, schema: str) -> DataFrame:
    """At most cap rows of each key pass, counted in state."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in pdfs:
            yield pdf.iloc[: max(0, cap - n)]
            n += len(pdf)
        state.update((n,))

    return stream.groupBy(*by).applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.NoTimeout)


class _DayCap(StatefulProcessor):
    """Counts of the people of a bucket and day, with a timer at the day's end; when the watermark passes it they are dropped."""

    def __init__(self, given: list[str], columns: list[str], ts: str, order: list[str], cap: int):
        self.given, self.columns, self.ts, self.order, self.cap = given, columns, ts, order, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "who array<string>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = pd.Series(dtype="int64")
        if self.seen.exists():
            who, n = self.seen.get()
            before = pd.Series(list(n), index=list(who), dtype="int64")
        else:
            self.handle.registerTimer(int(pd.Timestamp(key[-1]).timestamp() * 1000) + 86_400_000)
        pdf = pd.concat(list(rows)).set_axis(self.given, axis=1).sort_values([self.ts, *self.order])  # Spark names made columns by place
        at = pdf.groupby("__who").cumcount() + pdf["__who"].map(before).fillna(0).astype("int64")
        now = before.add(pdf["__who"].value_counts(), fill_value=0).astype("int64")
        self.seen.update((now.index.tolist(), now.tolist()))
        yield pdf[self.columns][(at < self.cap).to_numpy()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


#: The state store that arbitrary state with timers needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def capped_daily(stream: DataFrame, by: str, ts: str, order: list[str], cap: int, late: str = "1 day", buckets: int = 64) -> DataFrame:
    """At most cap rows of each person and day pass, by time within a batch; columns of stream.

    The count of a day is state until the watermark, `late` behind the newest row, has passed the day's end.  Rows that come
    later are dropped and counted by Spark as dropped by watermark.  The people of a day are dealt to buckets, each of which is
    one group, so that a call of Python handles many people and not a few rows of one.  Needs the state store ROCKS, which `drain` sets.
    """
    rows = stream.withWatermark(ts, late).withColumn("__day", F.to_date(ts))
    rows = rows.withColumn("__bucket", F.pmod(F.hash(by), F.lit(buckets))).withColumn("__who", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))  # as text: pandas would turn ids beside nulls to floats
    columns = [c for c in stream.columns if c != by]
    schema = T.StructType([*(stream.schema[c] for c in columns), T.StructField("__who", T.StringType())])
    out = rows.groupBy("__bucket", "__day").transformWithStateInPandas(_DayCap(rows.columns, schema.names, ts, order, cap), schema, "append", "eventTime")
    who = F.when(F.col("__who") != "", F.substring("__who", 2, 1_000_000)).cast(stream.schema[by].dataType)
    return out.select(*[who.alias(by) if c == by else F.col(c) for c in stream.columns])


def drain(spark: SparkSession, out: DataFrame, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a stream over what is there now and return its result as a table; timers uses the state store that `capped_daily` needs."""
    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        if timers:
            return _with_timers(spark, out, run)
        out.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{run}/out")

    def save(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{run}/out")

    out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{run}/out")


def _with_timers(spark: SparkSession, out: DataFrame, run: str) -> DataFrame:
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        out.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])
    return spark.read.schema(out.schema).parquet(f"{run}/out")
