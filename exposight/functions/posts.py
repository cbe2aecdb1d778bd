"""Post JSON: flattening, links, tags of whom a post addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINKS = "urls: array<struct<url: string, expanded_url: string>>, media: array<struct<url: string, expanded_url: string>>, user_mentions: array<struct<id: bigint, screen_name: string>>"
_BASE = f"id_str: string, created_at: string, full_text: string, text: string, user: struct<id_str: string, screen_name: string>, entities: struct<{_LINKS}>, extended_tweet: struct<full_text: string, entities: struct<{_LINKS}>>"
_QUOTED = f"struct<{_BASE}>"
_RETWEETED = f"struct<{_BASE}, quoted_status: {_QUOTED}>"
SCHEMA = f"struct<{_BASE}, in_reply_to_status_id_str: string, in_reply_to_user_id_str: string, in_reply_to_screen_name: string, quoted_status_id_str: string, retweeted_status: {_RETWEETED}, quoted_status: {_QUOTED}>".replace(": ", ":")


def _text(at: str) -> Column:
    p = f"{at}." if at else ""
    return F.coalesce(f"{p}extended_tweet.full_text", f"{p}full_text", f"{p}text")


def flatten(posts: DataFrame) -> DataFrame:
    """A row for each post: its kind's ids, prefix, text and quoted text.  A retweet's own text stands for the cut copy."""
    is_rt = F.col("retweeted_status").isNotNull()
    return posts.select(
        F.col("id_str").alias("tweet_id"), F.col("user.id_str").alias("user_id"), F.col("created_at").alias("tweet_date"),
        F.when(is_rt, F.concat(F.lit("RT @"), F.col("retweeted_status.user.screen_name"), F.lit(":"))).otherwise(F.lit("")).alias("retweet_prefix"),
        F.when(is_rt, _text("retweeted_status")).otherwise(_text("")).alias("tweet_text"),
        F.coalesce(_text("retweeted_status.quoted_status"), _text("quoted_status"), F.lit("")).alias("quoted_text"),
        F.coalesce("retweeted_status.id_str", F.lit("")).alias("retweet_of_tweet_id"), F.coalesce("retweeted_status.user.id_str", F.lit("")).alias("retweet_of_user_id"),
        F.coalesce("retweeted_status.quoted_status.id_str", "quoted_status.id_str", "quoted_status_id_str", F.lit("")).alias("quote_of_tweet_id"),
        F.coalesce("retweeted_status.quoted_status.user.screen_name", "quoted_status.user.screen_name", F.lit("")).alias("quote_of_user_name"), F.coalesce("in_reply_to_status_id_str", F.lit("")).alias("reply_to_tweet_id"),
    )


def _links(at: str, source: str) -> Column:
    p = f"{at}." if at else ""
    empty = F.array().cast("array<struct<url:string,expanded_url:string>>")
    both = [F.coalesce(f"{p}extended_tweet.entities.{k}", f"{p}entities.{k}", empty) for k in ("urls", "media")]

    def as_rows(kind: str):
        return lambda x: F.struct(x["url"].alias("shortened_url"), x["expanded_url"].alias("canonical_url"), F.lit(source).alias("where_url_found"), F.lit(kind).alias("kind"))

    return F.concat(*[F.transform(c, as_rows(k)) for c, k in zip(both, ("url", "media"))])


def links(posts: DataFrame) -> DataFrame:
    """A row for each link: a retweet's links in place of its own, quoted links added; links to the post itself left out."""
    own = F.when(F.col("retweeted_status").isNotNull(), _links("retweeted_status", "retweeted")).otherwise(_links("", "orig"))
    quoted = F.when(F.col("retweeted_status.quoted_status").isNotNull(), _links("retweeted_status.quoted_status", "quoted")).otherwise(_links("quoted_status", "quoted"))
    rows = posts.select(F.col("id_str").alias("tweet_id"), F.col("user.id_str").alias("user_id"), F.explode(F.concat(own, quoted)).alias("l")).select("tweet_id", "user_id", "l.*")
    status = F.col("canonical_url").rlike(r"https?://(?:www\.|mobile\.)?twitter\.com/.+/status/")
    kind = F.when(F.col("kind") == "media", "twitter_media").when(status, "twitter_status").otherwise("external")
    return rows.filter(~F.coalesce(F.contains("canonical_url", F.concat(F.lit("/status/"), F.col("tweet_id"))), F.lit(False))).withColumn("link_type", kind).drop("kind").withColumn("website", F.regexp_extract("canonical_url", r"https?://([^/]+)", 1))


def external(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("link_type") == "external") & F.col("canonical_url").isNotNull() & (F.length("canonical_url") >= 7))


def interaction_tags(posts: DataFrame, people: dict[str, int]) -> DataFrame:
    """(tweet_id, tags): whom of `people` (name -> user id) a post retweets, quotes or answers; else whom it mentions."""
    rt, qt, rp = F.col("retweeted_status.user.id_str"), F.col("quoted_status.user.id_str"), F.col("in_reply_to_user_id_str")
    acts = [F.when(c == str(i), F.lit(f"{n}_{kind}")) for n, i in people.items() for c, kind in ((rt, "RT"), (qt, "QT"), (rp, "reply"))]
    empty = F.array().cast("array<struct<id:bigint,screen_name:string>>")
    ids = F.transform(F.coalesce("entities.user_mentions", empty), lambda m: m["id"])
    mentions = [F.when(F.array_contains(ids, i), F.lit(f"{n}_mention")) for n, i in people.items()]
    done = F.array_compact(F.array(*acts))
    tags = F.when(F.size(done) > 0, done).otherwise(F.array_compact(F.array(*mentions)))
    return posts.select(F.col("id_str").alias("tweet_id"), F.array_join(F.array_sort(F.array_distinct(tags)), "||").alias("tags"))
