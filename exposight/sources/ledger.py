"""Daily stages with a ledger: what is done is skipped, and a day that is run again replaces only itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = tuple[str, Callable[["Ledger", str], DataFrame]]


class Ledger:
    """Tables of daily stages under a folder: base/stage/ds=day, and a ledger of (stage, day, rows, at).

    A stage's entry is written after its day's table, so a run that is killed in between does the day again.  A stage reads
    what other stages wrote for its day with `day`, and what came earlier with `before`; as it never sees later days, a day that is
    run again gives the same rows.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def entries(self) -> DataFrame:
        found = self._read(f"{self.base}/_ledger/*")
        empty = self.spark.createDataFrame([], "stage string, day string, rows long, at timestamp")
        return empty if found is None else found.select("stage", F.col("day").cast("string").alias("day"), "rows", "at")

    def done(self) -> set[tuple[str, str]]:
        return {(r["stage"], r["day"]) for r in self.entries().select("stage", "day").collect()}  # a row for each stage and day

    def day(self, stage: str, day: str) -> DataFrame:
        """What a stage wrote for a day."""
        return self.spark.read.parquet(f"{self.base}/{stage}/ds={day}")

    def before(self, stage: str, day: str) -> DataFrame | None:
        """What a stage wrote for earlier days, with ds; None if there is nothing."""
        found = self._read(f"{self.base}/{stage}")
        return None if found is None else found.withColumn("ds", F.col("ds").cast("string")).filter(F.col("ds") < day)

    def table(self, stage: str) -> DataFrame:
        """What a stage wrote for all days, with ds."""
        return self.spark.read.parquet(f"{self.base}/{stage}").withColumn("ds", F.col("ds").cast("string"))

    def run(self, stages: list[Stage], days: list[str], again: set[str] | None = None) -> list[tuple[str, str]]:
        """Runs stages in order, day by day, but for what the ledger has; `again` names stages to run in any case.  Returns what ran."""
        done, ran = self.done(), []
        for day in sorted(days):
            fresh = False
            for name, make in stages:
                if (name, day) in done and name not in (again or ()) and not fresh:
                    continue
                fresh = True  # what follows a stage that ran is out of date
                make(self, day).write.mode("overwrite").parquet(f"{self.base}/{name}/ds={day}")
                entry = self.day(name, day).agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), F.lit(day).alias("day"), "rows", F.current_timestamp().alias("at"))
                entry.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/_ledger/{name}-{day}")
                ran.append((name, day))
        return ran
