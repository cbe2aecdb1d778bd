"""A corpus pipeline: each stage takes the documents that the one before kept.

All stages but the last return the columns of their documents, whatever those are besides doc_id and text; names of
the operators' own results may be among them.  A null text stays null and is kept, as an empty one is: it is not toxic,
has no lines to drop, no copies and no passage.  A row with a null id is judged by its text in the first and fourth stage
and kept whole by the other two.  Rows that repeat an id are one document to line dedup and near duplicates, which keep or drop
them together.  Empty documents, labels or benchmark tables are allowed; without labels of both kinds the
toxicity score is a constant.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposight.llm import contamination, line_dedup, near_dup, packing, toxicity
from exposight.llm._spark import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, score_col="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of a smaller id has; n_chars, where there is one, follows the text."""
    out = line_dedup.line_dedup(docs, lines_col="__lines", dropped_col="__dropped").drop("__lines", "__dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike to 0.8 over five-word shingles: the least id."""
    gone = near_dup.near_duplicates(docs, share=80, bands=30).filter("not kept and component_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks_col="__leaks")
    return found.filter(F.size("__leaks") == 0).drop("__leaks")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity, decontamination and packing cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
