"""Readers and writers of delimited, JSON-lines and word-list files, and repair of broken records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import running


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """A tab-separated file with a header, gzip or plain.  gzip cannot be split: partitions deals its rows out."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return df.repartition(partitions) if partitions else df


def read_raw_tsv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """All columns as text, no quoting, short lines filled; an empty field is "" and not null."""
    df = spark.read.csv(path, sep="\t", header=header, quote="", mode="PERMISSIVE", schema=", ".join(f"`{c}` string" for c in columns))
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_quoted_tsv(spark: SparkSession, path: str, columns: list[str], from_id: int | None = None) -> DataFrame:
    """All columns as text with quotes taken off; from_id resumes after that id (first column)."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"', schema=", ".join(f"`{c}` string" for c in columns))
    return df.filter(F.col(columns[0]).cast("long") > from_id) if from_id is not None else df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased words, blanks dropped, right-trimmed, each with a copy without apostrophes."""
    lines = spark.read.text(path).select(F.lower(F.rtrim("value")).alias("word")).filter("word <> ''")
    return lines.unionByName(lines.select(F.replace("word", F.lit("'"), F.lit("")).alias("word"))).distinct()


def read_tables(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base}/{n}.parquet") for n in names}


def write_tsv(df: DataFrame, path: str, gzip: bool = False, quoted: bool = True, mode: str = "overwrite") -> None:
    """Tab-separated with a header; null is an empty field.  quoted=False escapes with a backslash instead."""
    opts = {"sep": "\t", "header": True, "nullValue": "", "emptyValue": ""} | ({"compression": "gzip"} if gzip else {}) | ({} if quoted else {"quote": "", "escape": "\\"})
    df.write.mode(mode).options(**opts).csv(path)


def write_daily(df: DataFrame, path: str, day_col: str = "ds") -> None:
    """Parquet by day; a day that is written again replaces only itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)


def fold_lines(lines: list[str]) -> list[str]:
    """Joins a line to the record before it where it does not start one.

    A line starts a record if its first field is a number that, as text, is not below the last accepted one and whose
    leading digit is the same or one more.
    """
    out: list[str] = []
    last = ""
    for line in lines:
        first = line.rstrip("\r").split("\t", 1)[0]
        starts = first.isdigit() and (not last or first >= last and int(first[0]) - int(last[0]) in (0, 1))
        if starts or not out:
            out.append(line.rstrip("\r"))
            last = first if starts else last
        else:
            out[-1] += line.rstrip("\r")
    return out


def repair_records(df: DataFrame, file_col: str = "file", line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """(file, record_no, record) of physical lines: the exact fold, one file at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fold_lines(pdf.sort_values(line_col)[text_col].tolist())
        return pd.DataFrame({"file": [pdf[file_col].iloc[0]] * len(got), "record_no": range(1, len(got) + 1), "record": got})

    return df.groupBy(file_col).applyInPandas(run, "file string, record_no long, record string")


def repair_by_start(df: DataFrame, starts, order: list[str], text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """Records where a line alone tells whether it starts one: a running count of starts, over ranges of lines, numbers the records."""
    by = by or []
    numbered = running(df.withColumn("__start", starts.cast("int")), [F.col(c) for c in order], {"__before": F.col("__start")}, by)
    numbered = numbered.withColumn("record_no", F.col("__before") + F.col("__start"))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("t"))))
    return numbered.groupBy(*by, "record_no").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("record"))
