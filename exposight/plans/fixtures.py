"""Small literal rows for queries whose inputs the driver's tables do not have."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import posts

PLACES = ["Atlanta", "California", "Big Bear City, Ca.", "De Pere, WI", "pennsville, nj", "Dayton, Nevada", "Birmingham, England", "lebanon", "UK", "westfield", "Weston WV", "NYC", "USA", "Bay Area", "Washington", "Jakarta, ID", "東京", "", "LA", "somewhere in"]
PROFILES = [
    (1, "Maria Lopez", "MariaLopezTX", "Austin, TX"), (2, "John Q. Smith", "johnqsmith", "Dayton, Nevada"), (3, "sam undercuffler", "samunder34", ""), (4, "*bibin*", "binarbibinwiyar", "bandung"),
    (5, "Maria Lopez", "mlopez", "Birmingham, England"), (6, "Ann-Marie O'Neil", "amoneil", "Ohio"), (7, "Nadia Fradita", "NadiaFradita", ""),
]
VOTERS = [("v1", "Maria", "Lopez", "Austin", "TX", "1"), ("v2", "John", "Smith", "Dayton", "NV", "1"), ("v3", "J", "Doe", "Salem", "OR", "1"), ("v4", "Nadia", "Fradita", "Reno", "NV", "2"), ("v5", "Zed", "Nobody", "Reno", "NV", "1")]
LINES = ["101000000\t2015-01-06\tbib\tx\tbandung", "101000001\t2015-01-06\tname.", " sabir", "\tsab\t", "101000002\t2015-01-06\tsam\tunder\t"]


def _post(i: int, text: str, **more) -> dict:
    return {"id_str": str(i), "created_at": "Tue Nov 08 00:00:00 -0500 2016", "full_text": text, "user": {"id_str": "7", "screen_name": "me"}, "entities": {"urls": [], "media": [], "user_mentions": []}} | more


POSTS = [
    _post(1, "look", entities={"urls": [{"url": "https://t.co/a", "expanded_url": "https://news.example.com:8080/x"}], "media": [], "user_mentions": [{"id": 12, "screen_name": "beta"}]}),
    _post(2, "RT cut", retweeted_status=_post(9, "whole text", user={"id_str": "11", "screen_name": "alpha"}, entities={"urls": [{"url": "https://t.co/b", "expanded_url": "http://site.example.org/b"}], "media": [{"url": "https://t.co/m", "expanded_url": "https://twitter.com/a/status/9/photo/1"}], "user_mentions": []})),
    _post(3, "see", quoted_status=_post(8, "quoted words", user={"id_str": "5", "screen_name": "who"}, entities={"urls": [{"url": "https://t.co/q", "expanded_url": "https://q.example.net/p"}], "media": [], "user_mentions": []}), entities={"urls": [{"url": "https://t.co/s", "expanded_url": "https://twitter.com/me/status/3"}], "media": [], "user_mentions": []}),
]


def places(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(enumerate(PLACES)), "id long, raw string")


def profiles(s: SparkSession) -> DataFrame:
    return s.createDataFrame(PROFILES, "id long, name string, screen_name string, location string")


def voters(s: SparkSession) -> DataFrame:
    return s.createDataFrame(VOTERS, "voter_id string, first_name string, last_name string, city string, state string, state_count string")


def raw_lines(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("f", i, x) for i, x in enumerate(LINES)], "file string, line_no long, text string")


def post_json(s: SparkSession) -> DataFrame:
    rows = s.createDataFrame([(json.dumps(p),) for p in POSTS], "j string")
    return rows.select(F.from_json("j", posts.SCHEMA).alias("p")).select("p.*")
