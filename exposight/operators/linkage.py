"""Record linkage: people of a voter file to profiles by name words and place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.location import STATES, location, update_location
from ..functions.names import name_handle_words
from ..functions.text import clean_name


def index_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with their name and handle words."""
    w = name_handle_words(F.col("name"), F.col("screen_name"))
    return profiles.withColumn("w", w).withColumn("words", F.array_union("w.words", "w.handle_words")).drop("w")


def candidates(voters: DataFrame, profiles: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts, pairs).  A count is -99 where a name has no word of two letters, -98 where the name is not unique in its state, most + 1 where more match.

    Voters of the same words share one search.  Words of a name must all be among a profile's; the rarest word leads
    the join, so common first names do not.
    """
    v = voters.withColumn("first", F.split(clean_name(F.col("first_name")), " ")).withColumn("last", F.split(clean_name(F.col("last_name")), " "))
    ok = F.exists("first", lambda w: F.length(w) >= 2) & F.exists("last", lambda w: F.length(w) >= 2)
    v = v.withColumn("gate", F.when(~ok, -99).when(F.col("state_count").cast("int") > 1, -98))
    v = v.withColumn("terms", F.array_sort(F.array_distinct(F.filter(F.concat("first", "last"), lambda w: F.length(w) >= 2))))
    names = v.filter("gate is null").select("terms").distinct()
    index = profiles.select("id", F.explode(F.array_distinct("words")).alias("word"))
    often = index.groupBy("word").agg(F.count("*").alias("n"))
    lead = names.select("terms", F.explode("terms").alias("word")).join(often, "word", "left").groupBy("terms").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    hits = lead.join(index, "word").join(profiles.select("id", "words"), "id").filter(F.forall("terms", lambda t: F.array_contains(F.col("words"), t))).select("terms", "id")
    n = hits.groupBy("terms").agg(F.count("*").alias("hits"))
    counts = v.join(n, "terms", "left").withColumn("num_candidates", F.coalesce("gate", F.least(F.coalesce("hits", F.lit(0)), F.lit(most + 1))).cast("long"))
    few = counts.filter((F.col("num_candidates") >= 1) & (F.col("num_candidates") <= most)).select("voter_id", "city", "state", "terms")
    pairs = few.join(hits, "terms").join(profiles.select("id", F.col("location").alias("place")), "id").select("voter_id", "city", "state", F.col("id").alias("profile_id"), "place")
    return counts.select("voter_id", "num_candidates"), pairs


def locate(pairs: DataFrame) -> DataFrame:
    """Pairs with the place as parsed and as revised by the voter's city and state."""
    names = {v: k for k, v in STATES.items()}

    @F.pandas_udf("string")
    def revised(loc: pd.Series, text: pd.Series, city: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([update_location(a, b, c, d, names.get(d)) for a, b, c, d in zip(loc, text, city, state)])

    return pairs.withColumn("loc2", F.coalesce(location(F.col("place")), F.lit(""))).withColumn("loc_new", revised("loc2", "place", "city", "state"))


def adjudicate(pairs: DataFrame) -> DataFrame:
    """Voters with exactly one candidate left that is neither abroad nor in another state, whose state agrees, and whose profile no other voter has."""
    left = pairs.filter((F.col("loc_new") != "foreign") & (F.col("loc_new").isin("", "USA", "unparsed") | (F.col("loc_new") == F.col("state"))))
    one = left.withColumn("n", F.count("*").over(W.partitionBy("voter_id"))).filter("n = 1 and loc_new = state")
    return one.withColumn("m", F.count("*").over(W.partitionBy("profile_id"))).filter("m = 1").select("voter_id", "profile_id", "state")
