"""A stored inverted index: postings bucketed by word, appended in batches, terms intersected rarest first."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import fulltext_index

BUCKETS = 64


class TextIndex:
    """Tables under a folder: postings (word, id), partitioned by batch and by bucket of the word, the ids of each batch, and a row for each complete batch.

    Adding rows writes a new batch; earlier files are not touched, and rows whose id is there already are left out.  A batch
    counts once it is complete.  A search reads only the buckets of its words.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _batches(self, name: str, schema: str) -> DataFrame:
        whole = [r["batch"] for r in self._table("complete", "n long, batch string").select("batch").collect()]  # a row for each batch
        return self._table(name, f"{schema}, batch string").filter(F.col("batch").isin(whole))

    def postings(self) -> DataFrame:
        return self._batches("postings", "word string, id long, bucket int").select("word", "id", "bucket")

    def ids(self) -> DataFrame:
        return self._batches("ids", "id long").select("id")

    def add(self, df: DataFrame, id_col: str, text_col: str) -> str:
        """Adds the rows whose id is new; returns the batch's name."""
        name = F.lit(batch := f"b{uuid.uuid4().hex}").alias("batch")
        fresh = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null").join(self.ids(), "id", "left_anti")
        rows = fulltext_index(fresh, "id", "text").distinct().withColumn("bucket", self._bucket())
        rows.repartition("bucket").sortWithinPartitions("bucket", "word").select("*", name).write.mode("append").partitionBy("batch", "bucket").parquet(f"{self.path}/postings")
        fresh.select("id", name).distinct().write.mode("append").partitionBy("batch").parquet(f"{self.path}/ids")
        self.spark.range(1).select(F.col("id").alias("n"), name).write.mode("append").partitionBy("batch").parquet(f"{self.path}/complete")
        return batch

    def search(self, terms: DataFrame, term_id: str, words: str, most_buckets: int = 10_000) -> DataFrame:
        """(term_id, id): ids that have all words of a term.  The rarest word of a term leads; the others are asked only about its ids.

        Terms without words match nothing; a term's words are lower-case.
        """
        t = terms.select(F.col(term_id).alias("term"), F.explode(F.array_distinct(words)).alias("word")).withColumn("bucket", self._bucket())
        wanted = [r["bucket"] for r in t.select("bucket").distinct().limit(most_buckets).collect()]  # `buckets` at most
        posts = self.postings().filter(F.col("bucket").isin(wanted))
        often = posts.join(t.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
        ranked = t.join(often, "word", "left")
        all_there = ranked.groupBy("term").agg(F.min_by("word", F.struct("n", "word")).alias("lead"), F.count("*").alias("need"), F.count("n").alias("have")).filter("need = have")
        hits = all_there.join(posts.select(F.col("word").alias("lead"), "id"), "lead").select("term", "lead", "need", "id")
        others = t.join(all_there.select("term", "lead"), "term").filter("word <> lead").select("term", "word")
        met = hits.join(others, "term").join(posts.select("word", "id"), ["word", "id"]).groupBy("term", "id").agg((F.count("*") + 1).alias("met"))
        full = hits.join(met, ["term", "id"], "left").filter(F.coalesce("met", F.lit(1)) == F.col("need"))
        return full.select(F.col("term").alias(term_id), "id")
