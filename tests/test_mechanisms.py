"""Patterns, the daily ledger, the stored index and state by day against plain versions."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposight.operators import patterns
from exposight.sources import files, ledger, textindex
from exposight.streaming import streams


# Patterns
def plain(text, words):
    out = set()
    for w, at in words:
        for a in range(len(text) if text else 0):
            b = a + len(w)
            if text[a:b].lower() != w:
                continue
            edge = lambda i: (0 < i and (text[i - 1].isalnum() or text[i - 1] == "_")) != (i < len(text) and (text[i].isalnum() or text[i] == "_"))
            if edge(a) and edge(b) and (at == "any" or at in ("start", "either") and a == 0 or at in ("end", "either") and b == len(text)):
                out.add((w, a, b))
    return out


@pytest.mark.parametrize("most", [16_000_000, 9])
def test_find_patterns(spark, most):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice(["ab", "a", "b", " ", "é", "-", "New ", "york", "_"]) for _ in range(rng.randint(0, 14)))) for k in range(300)] + [(900, None), (901, ""), (902, "New York"), (902, "İ new york")]
    words = [("ab", "any"), ("a", "start"), ("b", "end"), ("new york", "any"), ("york", "either"), ("é", "any"), ("b-a", "any"), ("ab", "any"), ("  ", "any"), ("aé", "start"), ("aé", "end")]
    got = patterns.find_patterns(spark.createDataFrame(texts, "id long, text string").repartition(3), "id", "text", spark.createDataFrame(words, "pattern string, at string"), at_col="at", most_chars=most).collect()
    effective = [("ab", "any"), ("a", "start"), ("b", "end"), ("new york", "any"), ("york", "either"), ("é", "any"), ("b-a", "any"), ("aé", "either")]
    want = sorted((k, *m) for k, t in texts for m in plain(t, effective))
    assert sorted(tuple(r) for r in got) == want
    assert patterns.find_patterns(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([], "pattern string")).count() == 0


def test_word_list_file(spark, tmp_path):
    """A list of lines as it is read from a file, and a regular expression of all of it."""
    names = ["o'fallon  ", "St. Louis", "", "Reno", "new york"]
    (tmp_path / "list.txt").write_text("\n".join(names) + "\n")
    listed = files.read_word_list(spark, f"file://{tmp_path}/list.txt")
    texts = [(1, "from OFallon to st. louis"), (2, "renos"), (3, "New York, reno")]
    got = {(r.id, r.pattern) for r in patterns.find_patterns(spark.createDataFrame(texts, "id long, text string"), "id", "text", listed, "word").collect()}
    words = [r.word for r in listed.collect()]
    assert got == {(i, w) for i, t in texts for w in words if re.search(rf"(?i)(?<!\w){re.escape(w)}(?!\w)", t)} and len(got) == 4


def test_has_word(spark):
    rows = [("Springfield, IL", "springfield", True), ("springfields", "Springfield", False), ("a\\E.b c", "a\\E.b", True), ("x", "", False), ("x", None, False), (None, "x", False), ("St. Paul", "st.", True), ("a$b", "$", False), ("a $ b", "$", True)]
    df = spark.createDataFrame([(t, w) for t, w, _ in rows], "t string, w string")
    assert [r[0] for r in df.select(patterns.has_word(F.col("t"), F.col("w"))).collect()] == [x for *_, x in rows]


def test_state_patterns(spark):
    names = spark.createDataFrame([("WA", "Washington"), ("VA", "Virginia"), ("IN", "Indiana"), ("NY", "New York"), ("NY", "new york state")], "code string, name string")
    rows = [("Washington DC", "WA", False), ("seattle, washington state", "WA", True), ("West Virginia", "VA", False), ("virginia beach", "VA", True), ("live in peace", "IN", False), ("gary, indiana", "IN", True), ("nyc", "NY", False), ("n.y.", "NY", True), ("Buffalo NY", "NY", True), (None, "NY", False), ("x", "ZZ", False)]
    df = spark.createDataFrame([(k, t, c) for k, (t, c, _) in enumerate(rows)], "k int, place string, code string")
    got = {r.k: r.in_state for r in patterns.in_state(df, "place", "code", patterns.state_patterns(names)).collect()}
    assert [got[k] for k in range(len(rows))] == [x for *_, x in rows]


# Ledger
class Killed(Exception):
    pass


def stages(rows, fail=None):
    def links(b, day):
        return rows.filter(F.col("day") == day).select("user", "n")

    def fresh(b, day):
        if fail == day:
            raise Killed
        seen = b.before("fresh", day)
        now = b.day("links", day).select("user").distinct()
        return now if seen is None else now.join(seen.select("user"), "user", "left_anti")

    return [("links", links), ("fresh", fresh)]


def content(book):
    return {s: sorted(map(str, book.table(s).collect())) for s in ("links", "fresh")}


def test_ledger_resumes(spark, tmp_path):
    rows = spark.createDataFrame([("2016-01-01", 1, 5), ("2016-01-01", 2, 1), ("2016-01-02", 2, 3), ("2016-01-02", 3, 1), ("2016-01-03", 1, 9)], "day string, user long, n long")
    days = ["2016-01-01", "2016-01-02", "2016-01-03"]
    whole = ledger.Ledger(spark, f"file://{tmp_path}/whole")
    assert len(whole.run(stages(rows), days)) == 6 and whole.run(stages(rows), days) == []
    killed = ledger.Ledger(spark, f"file://{tmp_path}/killed")
    with pytest.raises(Killed):
        killed.run(stages(rows, fail="2016-01-02"), days)
    assert killed.done() == {("links", "2016-01-01"), ("fresh", "2016-01-01"), ("links", "2016-01-02")}
    again = ledger.Ledger(spark, f"file://{tmp_path}/killed")
    assert again.run(stages(rows), days) == [("fresh", "2016-01-02"), ("links", "2016-01-03"), ("fresh", "2016-01-03")]
    assert content(again) == content(whole)
    assert again.run(stages(rows), days[:2], again={"links"}) == [("links", days[0]), ("fresh", days[0]), ("links", days[1]), ("fresh", days[1])]
    assert content(again) == content(whole)
    assert {r.rows for r in again.entries().filter("stage = 'links'").collect()} == {1, 2}


def test_ledger_table_without_entry_is_done_again(spark, tmp_path):
    """A run that died after the table and before its entry."""
    rows = spark.createDataFrame([("2016-01-01", 1, 5)], "day string, user long, n long")
    book = ledger.Ledger(spark, f"file://{tmp_path}/b")
    rows.select("user", "n").unionByName(rows.select("user", "n")).write.parquet(f"file://{tmp_path}/b/links/ds=2016-01-01")
    assert book.run(stages(rows), ["2016-01-01"]) == [("links", "2016-01-01"), ("fresh", "2016-01-01")]
    assert book.table("links").count() == 1


# Stored index
def test_text_index(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "it's", "x"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for k in range(80)] + [(90, None), (None, "alpha beta")]
    df = spark.createDataFrame(docs, "id long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", buckets=4)
    terms = spark.createDataFrame([(1, ["alpha"]), (2, ["alpha", "beta", "alpha"]), (3, ["gamma", "delta", "it's"]), (4, ["nowhere", "alpha"]), (5, [])], "t int, w array<string>")
    assert index.search(terms, "t", "w").count() == 0
    index.add(df.filter("id < 40"), "id", "text")
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    index.add(df, "id", "text")
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())  # nothing is written again
    got = {tuple(r) for r in index.search(terms, "t", "w").collect()}
    split = {k: set(re.findall(r"[\w']+", t or "")) for k, t in docs if k is not None}
    assert got == {(r.t, k) for r in terms.collect() for k, s in split.items() if r.w and set(r.w) <= s}
    assert index.ids().count() == 81 and index.postings().count() == index.postings().distinct().count()
    unfinished = spark.createDataFrame([(500, "torn")], "id long, batch string")
    unfinished.write.mode("append").partitionBy("batch").parquet(f"file://{tmp_path}/index/ids")
    assert index.ids().count() == 81 and index.ids().filter("id = 500").count() == 0


# State by user and day
def cap_batch(rows, cap):
    p = pd.DataFrame(rows, columns=["user_id", "ts", "event_id"])
    p = p.sort_values(["ts", "event_id"])
    return set(p[p.groupby(["user_id", p["ts"].dt.date]).cumcount() < cap]["event_id"])


def test_cap_by_day_with_restart(spark, tmp_path):
    rng = random.Random(2)
    t0 = dt.datetime(2024, 3, 1)
    rows = sorted((rng.randint(1, 4), t0 + dt.timedelta(hours=rng.uniform(0, 24 * 8)), k) for k in range(160))
    rows.sort(key=lambda r: r[1])
    schema, src, out, state = "user_id long, ts timestamp, event_id long", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    spark.conf.set(*streams.ROCKS)
    try:
        sizes = []
        for part in range(4):  # the query is stopped and started from its checkpoint for each part
            spark.createDataFrame(rows[40 * part : 40 * part + 40], schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
            stream = spark.readStream.schema(schema).parquet(f"file://{src}")
            q = streams.capped_daily(stream, "user_id", "ts", ["event_id"], 2, "1 day").writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(max((p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators), default=0))
        got = {r.event_id for r in spark.read.schema(schema).parquet(f"file://{out}").collect()}
        late = spark.createDataFrame([(1, t0, 999)], schema)
        late.coalesce(1).write.mode("append").parquet(f"file://{src}")
        q = streams.capped_daily(spark.readStream.schema(schema).parquet(f"file://{src}"), "user_id", "ts", ["event_id"], 2, "1 day").writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped = sum(p.stateOperators[0].numRowsDroppedByWatermark for p in q.recentProgress if p.stateOperators)
    finally:
        spark.conf.unset(streams.ROCKS[0])
    assert got == cap_batch(rows, 2)
    assert dropped == 1 and 999 not in {r.event_id for r in spark.read.schema(schema).parquet(f"file://{out}").collect()}
    assert sizes[-1] <= 2 * 4 * 5  # counts and timers of the open days, not of all eight


def test_cap_by_day_of_many_people(spark, tmp_path):
    """Two batches, people without an id among them; a day's people share a few groups of state."""
    rng = random.Random(7)
    t0 = dt.datetime(2024, 3, 1)
    rows = [(rng.choice([None, *range(100)]), t0 + dt.timedelta(seconds=k * 150), k) for k in range(800)]
    schema, src, out, state = "user_id long, ts timestamp, event_id long", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    spark.conf.set(*streams.ROCKS)
    try:
        for part in (rows[:300], rows[300:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
            stream = streams.capped_daily(spark.readStream.schema(schema).parquet(f"file://{src}"), "user_id", "ts", ["event_id"], 3, buckets=2)
            q = stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start()
            q.awaitTermination()
            size = max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators)
    finally:
        spark.conf.unset(streams.ROCKS[0])
    got, seen, want = {(r.user_id, r.event_id) for r in spark.read.schema(schema).parquet(f"file://{out}").collect()}, {}, set()
    for who, at, k in rows:
        seen[who, at.date()] = seen.get((who, at.date()), 0) + 1
        if seen[who, at.date()] <= 3:
            want.add((who, k))
    assert got == want
    assert size <= 4 * 3 * 4  # people and nobody, by day


def test_naive_bayes_shuffles_no_pairs(spark):
    """Pairs of documents and words meet a small vocabulary where they are; the scores are those of the plain form."""
    from exposight.operators import models
    from exposight.plans import catalogue

    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["b"]), (4, ["d"]), (5, [])], "doc long, words array<string>")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (9, 0)], "doc long, y int")
    got = models.naive_bayes_sets(sets, labels, "doc", "words", "y")
    want = models.naive_bayes_scores(sets.selectExpr("doc", "explode(words) as word"), labels, "doc", "word", "y")
    rounded = lambda df: {(r["doc"], round(r["llr"], 9)) for r in df.collect()}
    assert rounded(got) == rounded(want) and got.count() == 4
    plan = catalogue.queries()["nb_llr_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan
