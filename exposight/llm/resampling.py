"""Importance resampling towards a target: hashed n-gram features, gains by bucket, a draw without replacement.

Words stand in a position table (a row for each word and its place); for longer features lead() over a document's
words adds the words that follow.  Features are counted by bucket in the corpus and in the target; a bucket's
gain is the logarithm of its smoothed ratio.  A document's weight is its mean gain, and adding Gumbel noise made
from its id turns the highest scores into a weighted draw without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import materialize

#: A word: letters and digits of ASCII, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1))


def positions(df: DataFrame, text: Column, order: int, keys: list[str]) -> DataFrame:
    """keys, feature: a row for each run of 1 to `order` words; rows of df without words give one row with a null feature."""
    table = df.select(*keys, F.posexplode_outer(_words(text)).alias("place", "word"))
    if order == 1:  # no words follow: nothing is moved
        return table.select(*keys, F.col("word").alias("feature"))
    inside = W.partitionBy(*keys).orderBy("place")
    follow = [F.lead("word", k).over(inside) for k in range(1, order)]
    runs = [F.when(follow[k - 1].isNotNull(), F.concat_ws(" ", "word", *follow[:k])) if k else F.col("word") for k in range(order)]
    features = table.select(*keys, F.filter(F.array(*runs), lambda x: x.isNotNull()).alias("runs"))
    return features.select(*keys, F.explode_outer("runs").alias("feature"))


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(F.encode(feature, "UTF-8")) % buckets


def bucket_counts(features: DataFrame, buckets: int, name: str) -> DataFrame:
    return features.filter("feature is not null").groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    both = corpus.select("bucket", "s", F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), "t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = materialize(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")  # read twice, counted once
    S, T = sums.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1.0) * (S + float(buckets)) / ((d("s") + 1.0) * (T + float(buckets)))
    return sums.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, share: int) -> DataFrame:
    """df with rank: from 1 by falling score, then rising doc_id (null last), for the first floor(share * N / 100) of the N eligible rows; null for others.

    Counts by score say which scores are drawn and how many rows stand before each; only rows of one score are
    ordered among themselves, in parts by ranges of doc_id so that a score that many rows have is not one group.
    """
    eligible = df.filter("eligible")
    drawn = eligible.count() * share // 100
    scores = eligible.groupBy("score").agg(F.count("*").alias("n"))
    spread = scores.repartitionByRange(F.col("score").desc()).withColumn("range", F.spark_partition_id())
    spread = materialize(spread, "scores")
    totals = spread.groupBy("range").agg(F.sum("n").alias("m"))  # a row for each partition
    totals = totals.withColumn("front", F.coalesce(F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = W.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = spread.join(F.broadcast(totals), "range").select("score", (F.col("front") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))
    before = F.broadcast(before.filter(F.col("before") < drawn))  # weights and noise are of about 113,000 different sums at most
    some = eligible.join(before, "score").select("uid", "score", "doc_id", "before")
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid")]
    dealt = materialize(some.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("score", "range").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("front", F.coalesce(F.sum("k").over(W.partitionBy("score").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")  # a row for each partition a score lies in
    own = F.row_number().over(W.partitionBy("score", "range").orderBy(F.col("doc_id").asc_nulls_last(), "uid"))
    at = dealt.withColumn("own", own).join(sizes, ["score", "range"]).select("uid", (F.col("before") + F.col("front") + F.col("own")).cast("long").alias("rank")).filter(F.col("rank") <= drawn)
    return df.join(at, "uid", "left")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", order: int = 1, buckets: int = 10_000, least_words: int = 20, share: int = 10, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each row of df.

    Features are all runs of 1 to `order` words with their repeats, in `buckets` buckets; `share` in a hundred of the
    documents with at least `least_words` words are drawn.  A null or empty text has no features and weight 0, and
    with an empty target all gains are of the corpus's own counts.  Rows that repeat an id are documents of their own with the
    same noise; a null id draws its noise from the empty id and comes last among ties.  Other columns are
    ignored; an empty table gives an empty one.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("uid", F.monotonically_increasing_id())
    corpus = bucket_counts(positions(docs, F.col("text"), order, ["uid"]), buckets, "s")
    goal = bucket_counts(positions(target.select(F.col(target_text).alias("text")).withColumn("uid", F.monotonically_increasing_id()), F.col("text"), order, ["uid"]), buckets, "t")
    table = F.broadcast(gains(corpus, goal, buckets))  # `buckets` rows
    features = positions(docs, F.col("text"), order, ["uid", "doc_id"])
    joined = features.withColumn("bucket", bucket(F.col("feature"), buckets)).join(table, "bucket", "left")
    n = F.count("feature")
    per = joined.groupBy("uid", "doc_id").agg(n.alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    words = F.col("n_features") if order == 1 else _word_count("n_features", order)
    per = per.withColumn("n_words", words.cast("long")).withColumn("weight", F.expr("CASE WHEN n_features > 0 THEN (total - pmod(total, n_features)) div n_features ELSE 0 END"))
    per = per.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    scored = materialize(per.drop("total"), "scored")
    return ranked(scored, share).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def _word_count(n_features: str, order: int) -> Column:
    """Words from the number of features: w words have w + (w-1) + ... down to `order` addends."""
    n = F.col(n_features)
    full = order * (order - 1) // 2
    short = F.lit(0)
    for w in range(1, order):
        short = F.when(n == w * (w + 1) // 2, w).otherwise(short)
    return F.when(n >= full + order, (n + full) / order).otherwise(short)
