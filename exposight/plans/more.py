"""More queries of the catalogue: panel filters, look-ups, summaries, texts and small literal rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import articles, location, text
from ..operators import patterns, ranking, relational, sampling, series, stats, summaries
from ..session import shared_dir
from ..sources import ledger, roles, textindex
from ..streaming import streams
from . import catalogue
from .catalogue import T, query, r6


def _panel(s, d):
    c, k = T(s, d, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("user_id"), F.when(k % 13 != 0, k % 17 == 0).alias("is_compromised"), F.when(k % 11 != 0, k % 7 == 0).alias("is_bot"), F.when(k % 19 != 0, F.abs("c_acctbal") / 10000).alias("bot_score"), F.when(k % 23 != 0, k % 200).alias("ntweets_total")
    )


_PANEL = """WITH p AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 17 = 0 END AS is_compromised, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 7 = 0 END AS is_bot,
CASE WHEN c_custkey % 19 <> 0 THEN abs(c_acctbal) / 10000 END AS bot_score, CASE WHEN c_custkey % 23 <> 0 THEN c_custkey % 200 END AS ntweets_total FROM customer)"""


@query(_PANEL + " SELECT user_id, is_bot FROM p WHERE is_compromised = false AND is_bot = false", shared=False)
def panel_without_bots(s, d):
    return summaries.panel_data(_panel(s, d)).select("user_id", "is_bot")


@query(_PANEL + ", n AS (SELECT user_id, bot_score >= 0.7 AND ntweets_total >= 50 AS is_bot FROM p WHERE is_compromised = false) SELECT user_id, is_bot FROM n WHERE is_bot = false", shared=False)
def panel_without_scored_bots(s, d):
    return summaries.panel_data(_panel(s, d), scores=True).select("user_id", "is_bot")


@query(_PANEL + " SELECT user_id, bot_score >= 0.7 AND ntweets_total >= 50 AS is_bot FROM p", shared=False)
def panel_with_all(s, d):
    return summaries.panel_data(_panel(s, d), with_trolls=True, with_bots=True, scores=True).select("user_id", "is_bot")


@query("SELECT c_custkey AS user_id, coalesce(o.n, 0) AS n, coalesce(o.spent, 0) AS spent, o.last_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent, max(o_orderstatus) AS last_status FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey", shared=False)
def numeric_nulls_to_zero(s, d):
    o = T(s, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.max("o_orderstatus").alias("last_status"))
    return summaries.fill_numeric(T(s, d, "customer").select(F.col("c_custkey").alias("user_id")).join(o, "user_id", "left"))


@query("SELECT doc_id, (quality + toxic) / 2.0 AS mean FROM labels UNION ALL SELECT -1, NULL", shared=False)
def row_means(s, d):
    lone = s.createDataFrame([(-1, 3, None)], "doc_id long, quality int, toxic int")
    return T(s, d, "labels").select("doc_id", "quality", "toxic").unionByName(lone).select("doc_id", summaries.row_mean("quality", "toxic").alias("mean"))


@query("SELECT url, CASE page_id % 3 WHEN 0 THEN split_part(url, '?', 1) WHEN 1 THEN 'http://landing/' || page_id ELSE url END AS canonical_url, page_id FROM pages WHERE page_id % 5 <> 0", shared=False)
def resolve_urls(s, d):
    rows = T(s, d, "pages").select("page_id", F.concat_ws("#", "page_id", "url").alias("key"), "url", F.lit(None).cast("string").alias("canonical_url"))
    k = F.col("page_id") % 3
    parsed = T(s, d, "pages").filter("page_id % 5 <> 0").select(F.concat_ws("#", "page_id", "url").alias("key"), F.when(k == 0, F.split_part("url", F.lit("?"), F.lit(1))).when(k == 1, F.lit(" ")).alias("canonical"), F.when(k == 1, F.concat(F.lit("http://landing/"), "page_id")).when(k == 0, F.lit("unused")).otherwise(F.col("url")).alias("landing"))
    return summaries.resolve(rows, parsed, "key", "canonical_url", "canonical", "landing").select("url", "canonical_url", "page_id")


@query(", f AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM ev WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_id % 50 = 0) GROUP BY 1) SELECT user_id, CAST(day AS VARCHAR) AS day FROM f")
def first_seen_batch(s, d):
    ev = roles.event_views(s, d).withColumn("day", F.to_date("ts"))
    return summaries.first_seen(ev, "user_id", "day", ev.filter("event_id % 50 = 0")).select("user_id", F.col("day").cast("string").alias("day"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", shared=False)
def pending_work(s, d):
    return summaries.pending(T(s, d, "labels"), T(s, d, "documents"), ["doc_id"]).select("doc_id")


_LEVELS = ["view", "click", "purchase", "signup", "error"]


@query("SELECT event_type, count(*) AS n, round(avg(value), 2) AS value_mean, round(median(value), 2) AS value_median, round(stddev_samp(value), 2) AS value_sd, round(min(value), 2) AS value_min, round(max(value), 2) AS value_max, list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS level FROM events GROUP BY 1 ORDER BY 8", shared=False)
def group_summary(s, d):
    return summaries.summary(T(s, d, "events"), "event_type", _LEVELS, ["value"])


@query("SELECT event_type, printf('N=%d, %2.0f%%', count(*), 100.0 * count(*) / (SELECT count(*) FROM events)) AS label FROM events GROUP BY 1", shared=False)
def group_labels(s, d):
    return summaries.labels(T(s, d, "events"), "event_type")


@query("SELECT event_type, median(value) FILTER (WHERE user_id % 2 = 0) AS median FROM events GROUP BY 1", shared=False)
def filtered_median(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.median(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("median"))


@query(" SELECT count(*) FILTER (WHERE domain_color IS NOT NULL) / count(*) AS coverage FROM urls JOIN domains USING (website) WHERE website NOT IN (1, 2)")
def coverage_ratio(s, d):
    return summaries.coverage(roles.urls(s, d).join(roles.domains(s, d), "website"), F.col("domain_color").isNotNull(), F.col("website").isin(1, 2))


@query(", c AS (SELECT where_url_found AS kind, user_id, count(*) AS v FROM urls GROUP BY ALL), m AS (SELECT count(*) AS n FROM customer), k AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY v) + n - count(*) OVER (PARTITION BY kind) AS i, n FROM c, m) "
       "SELECT kind, any_value(n) AS n, round((2 * sum(i * v) / sum(v) - (any_value(n) + 1)) / any_value(n), 6) AS gini FROM k GROUP BY 1")
def gini_zero_padded(s, d):
    c = roles.urls(s, d).groupBy(F.col("where_url_found").alias("kind"), "user_id").agg(F.count("*").alias("v"))
    return stats.gini(c, "v", ["kind"], n=F.lit(T(s, d, "customer").count())).select("kind", "n", r6("gini", "gini"))


@query("WITH p AS (SELECT l_linenumber AS x, CAST(l_quantity AS INT) % 7 + 1 AS y FROM lineitem), d AS (SELECT x, y, ((x - y) / (x + y)) ** 2 AS d2 FROM p), o AS (SELECT 2 * sum(d2) AS o, 2 * count(*) AS n FROM d), v AS (SELECT v, count(*) AS k FROM (SELECT x AS v FROM p UNION ALL SELECT y FROM p) GROUP BY 1), "
       "e AS (SELECT sum(a.k * b.k * ((a.v - b.v) / (a.v + b.v)) ** 2) AS e FROM v a, v b) SELECT round(1 - o * (n - 1) / e, 6) AS alpha FROM o, e", shared=False)
def krippendorff_ratio(s, d):
    p = T(s, d, "lineitem").select(F.col("l_linenumber").alias("x"), (F.col("l_quantity").cast("int") % 7 + 1).alias("y"))
    return summaries.krippendorff_ratio(p, "x", "y").select(r6("alpha", "alpha"))


@query("SELECT CAST(date_diff('day', DATE '2024-01-10', CAST(ts AS DATE)) AS BIGINT) AS day, count(*) AS n FROM events WHERE date_diff('day', DATE '2024-01-10', CAST(ts AS DATE)) BETWEEN -32 AND 6 GROUP BY 1", shared=False)
def days_in_window(s, d):
    return T(s, d, "events").select(series.days_between(F.col("ts"), "2024-01-10", -32, 6).alias("day")).dropna().groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 > 1 THEN 2017 - year(o_orderdate) END AS age, CASE WHEN o_orderkey % 10 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' is ' || (2017 - year(o_orderdate)) END AS label FROM orders", shared=False)
def ages(s, d):
    k = F.col("o_orderkey") % 10
    rows = T(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k > 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/yyyy")).alias("birth"))
    age = series.age(F.col("birth"), 2017)
    return rows.select("id", age.alias("age"), F.when(age.isNotNull(), F.format_string("%s is %d", "birth", age)).alias("label"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') > 0 AS answered, bool_or(coalesce(contains(lower(text), 'zheit') OR contains(lower(text), 'on that'), false)) AS named FROM conversations GROUP BY 1", shared=False)
def any_of_lists(s, d):
    c = T(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.collect_list("text").alias("texts"))
    return c.select("conv_id", F.arrays_overlap("roles", F.array(F.lit("assistant"), F.lit("helper"))).alias("answered"), text.any_term(F.col("texts"), ["Zheit", "on that"]).alias("named"))


_RATINGS = ["FALSE", "Mostly True", "a mixture of true and false", "Legend", "incorrect", "untrue", None, "x" * 101]


@query("SELECT p_partkey AS id, ['false', 'true', 'both', 'none', 'false', 'true', 'none', NULL][p_partkey % 8 + 1] AS truth FROM part", shared=False)
def verdicts(s, d):
    rating = F.element_at(F.array(*map(F.lit, _RATINGS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return T(s, d, "part").select(F.col("p_partkey").alias("id"), text.verdict(rating).alias("truth"))


@query("SELECT p_partkey AS id, regexp_replace(p_name, '[aeiou]', '') AS once, array_to_string(list_filter(regexp_split_to_array(p_brand || p_type, '[0-9#]+'), lambda x: x <> ''), '|') AS around, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '_' || p_type END AS joined FROM part", shared=False)
def text_parts(s, d):
    around = F.array_join(text.between_matches(F.concat("p_brand", "p_type"), "[0-9#]+"), "|")
    second = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), "p_type")).when(F.col("p_partkey") % 2 == 0, F.lit(" "))
    return T(s, d, "part").select(F.col("p_partkey").alias("id"), text.replace_first(F.col("p_name"), "[aeiou]").alias("once"), around.alias("around"), text.paste_tolerant(F.col("p_name"), second).alias("joined"))


@query("SELECT event_id, user_id, CASE WHEN event_id > 500 THEN 3 WHEN event_id > 100 THEN 2 ELSE 1 END AS segment FROM events", shared=False)
def segments_by_cuts(s, d):
    return series.segment_of(T(s, d, "events").select("event_id", "user_id"), "event_id", [100, 500])


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3", shared=False)
def capped_batch(s, d):
    return series.running_cap(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1", shared=False)
def first_of_group(s, d):
    return ranking.first_per(T(s, d, "events"), ["user_id"], F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, CAST('0x' || substr(md5(doc_id || '|f'), 1, 7) AS BIGINT) % 5 AS fold FROM labels", shared=False)
def hash_folds(s, d):
    return sampling.folds(T(s, d, "labels").select("doc_id"), 5, "f", "doc_id")


# Patterns
_WORDS3 = "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}]+')[1:3], ' ') AS p FROM benchmark"


@query(f"WITH p AS ({_WORDS3}), c AS MATERIALIZED (SELECT doc_id, item_id, p, lower(text) AS t FROM documents, p WHERE contains(lower(text), p)) SELECT doc_id, item_id FROM c WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || p || '($|[^\\p{{L}}\\p{{N}}_])')", shared=False)
def pattern_automaton(s, d):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)), 1, 3)
    items = T(s, d, "benchmark").select("item_id", F.array_join(words, " ").alias("pattern"))
    found = patterns.find_patterns(T(s, d, "documents"), "doc_id", "text", items).select("doc_id", "pattern").distinct()
    return found.join(items, "pattern").select("doc_id", "item_id")


@query("SELECT doc_id, regexp_matches(lower(d.text), '^' || w || '($|[^\\p{L}\\p{N}_])') AS starts, regexp_matches(lower(d.text), '(^|[^\\p{L}\\p{N}_])' || w || '($|[^\\p{L}\\p{N}_])') AS has FROM documents d JOIN (SELECT item_id, regexp_extract(lower(text), '[\\p{L}]+') AS w FROM benchmark) ON item_id = doc_id", shared=False)
def pattern_of_the_row(s, d):
    word = F.regexp_extract(F.lower("text"), r"(\p{L}+)", 1)
    items = T(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), word.alias("w"))
    docs = T(s, d, "documents").select("doc_id", "text")
    first = patterns.find_patterns(docs, "doc_id", "text", items.select("w", F.lit("start").alias("at")), "w", "at").select("doc_id", F.col("pattern").alias("w"), F.lit(True).alias("s")).distinct()
    return docs.join(items, "doc_id").join(first, ["doc_id", "w"], "left").select("doc_id", F.coalesce("s", F.lit(False)).alias("starts"), patterns.has_word(F.col("text"), F.col("w")).alias("has"))


_STATES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(location.STATES.items()))
_STATE_LIST = sorted(location.STATES.items())


@query(f"WITH st AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS k FROM (VALUES {_STATES}) t(name, code)), c AS (SELECT c_custkey AS id, code, c_custkey // (SELECT count(*) FROM st) % 4 AS v FROM customer JOIN st ON k = c_custkey % (SELECT count(*) FROM st)) "
       "SELECT id, code, CASE WHEN v IN (1, 2) THEN code NOT IN ('IN', 'OR', 'OH', 'DE') WHEN v = 0 THEN code <> 'WA' ELSE code NOT IN ('WA', 'VA') END AS in_state FROM c", shared=False)  # fmt: skip
def state_of_place(s, d):
    n = len(_STATE_LIST)
    at = (F.col("c_custkey") % n + 1).cast("int")
    name, code = (F.element_at(F.array(*[F.lit(x[k]) for x in _STATE_LIST]), at) for k in (0, 1))
    v = F.floor(F.col("c_custkey") / n) % 4
    dotted = F.concat(F.substring(code, 1, 1), F.lit("."), F.substring(code, 2, 1), F.lit("."))
    place = F.when(v == 0, F.concat(F.upper(name), F.lit(", usa"))).when(v == 1, F.concat(F.lit("some town, "), F.lower(code))).when(v == 2, F.concat(F.lit("some town "), dotted)).otherwise(F.concat(F.lit("in west "), name))
    known = s.createDataFrame([(c, x) for x, c in _STATE_LIST], "code string, name string")
    rows = T(s, d, "customer").select(F.col("c_custkey").alias("id"), code.alias("code"), place.alias("place"))
    return patterns.in_state(rows, "place", "code", patterns.state_patterns(known)).select("id", "code", "in_state")


# A stored index, a daily ledger, state by day
def _base(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query(r"WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{2,}')[1:2] AS w FROM benchmark), x AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_'']+'), lambda v: length(v) >= 2)) AS ws FROM documents) SELECT item_id, doc_id FROM t JOIN x ON list_has_all(ws, w) WHERE len(w) > 0", shared=False)
def text_index_search(s, d):
    index = textindex.TextIndex(s, _base(s, "index"))
    docs = T(s, d, "documents").select("doc_id", "text")
    index.add(docs.filter("doc_id % 2 = 0"), "doc_id", "text")
    index.add(docs, "doc_id", "text")  # the rest: what is there is left out
    terms = T(s, d, "benchmark").select("item_id", F.slice(text.extract_all(F.lower("text"), "[a-z]{2,}"), 1, 2).alias("w"))
    return index.search(terms, "item_id", "w").select("item_id", F.col("id").alias("doc_id"))


@query("WITH e AS (SELECT strftime(ts, '%Y-%m') AS ds, user_id, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT user_id, min(ds) AS ds FROM e GROUP BY 1) SELECT ds, sum(n)::BIGINT AS events, count(*) AS people, count(f.user_id) AS fresh FROM e LEFT JOIN f USING (ds, user_id) GROUP BY ds", shared=False)
def ledger_by_month(s, d):
    ev = T(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("ds"))
    months = sorted(r["ds"] for r in ev.select("ds").distinct().collect())
    book = ledger.Ledger(s, _base(s, "ledger"))

    def fresh(b, day):
        now, seen = b.day("people", day).select("user_id"), b.before("fresh", day)
        return now if seen is None else now.join(seen.select("user_id"), "user_id", "left_anti")

    stages = [("people", lambda b, day: ev.filter(F.col("ds") == day).groupBy("user_id").agg(F.count("*").alias("n"))), ("fresh", fresh)]
    book.run(stages, months)
    book.run(stages, months)  # nothing is left to do
    n = book.table("fresh").groupBy("ds").agg(F.count("*").alias("fresh"))
    return book.table("people").groupBy("ds").agg(F.sum("n").alias("events"), F.count("*").alias("people")).join(n, "ds", "left").fillna(0, ["fresh"])


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3", shared=False)
def stream_cap_by_day(s, d):
    rows = catalogue._stream(s, d).select("user_id", "event_id", "ts")
    return streams.drain(s, streams.capped_daily(rows, "user_id", "ts", ["event_id"], 3, "40 days"), timers=True).select("user_id", "event_id")


# Lists, answers, flags, restored shares, articles
@query("SELECT s_suppkey AS website, lower(s_name) AS domain, CASE s_suppkey % 4 WHEN 0 THEN 'Satire' WHEN 1 THEN 'Orange' ELSE 'Black' END AS color FROM supplier", shared=False)
def list_recode(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["Parody site", "Some fake stories", "Fake news", None])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return T(s, d, "supplier").select(F.col("s_suppkey").alias("website"), F.lower("s_name").alias("domain"), relational.recode(kind, {"Parody site": "Satire", "Some fake stories": "Orange"}, "Black").alias("color"))


@query("SELECT o_orderkey AS id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_urgent FROM orders WHERE o_orderpriority <> '5-LOW'", shared=False)
def annotation_labels(s, d):
    return relational.answered(T(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "o_orderpriority", ["5-LOW"], ["1-URGENT", "2-HIGH"], "is_urgent").drop("o_orderpriority")


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, CASE l_returnflag WHEN 'N' THEN false WHEN 'R' THEN true END AS flag FROM lineitem", shared=False)
def flags_and_names(s, d):
    rows = relational.short_names(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "^l_")
    return rows.select("orderkey", "linenumber", relational.as_flag(F.col("returnflag"), "RN").alias("flag"))


@query(", t AS (SELECT *, row_number() OVER (PARTITION BY trial, user_id, CAST(ts AS DATE) ORDER BY md5(event_id || '|' || trial), event_id) AS r FROM ev, range(1, 21) x(trial) WHERE kind = 'share'), c AS (SELECT *, unnest([1, 2, 5]) AS cap FROM t), k AS (SELECT trial, cap, count(*) FILTER (WHERE r <= cap AND url < 3) AS f, count(*) FILTER (WHERE r <= cap AND url >= 3) AS o FROM c GROUP BY ALL) "
       "SELECT CAST(cap AS BIGINT) AS cap, round(avg(f) / (SELECT count(*) FROM ev WHERE kind = 'share' AND url < 3), 6) AS kept_fake_share, round(avg(o) / (SELECT count(*) FROM ev WHERE kind = 'share' AND url >= 3), 6) AS kept_other_share FROM k GROUP BY 1")  # fmt: skip
def restored_shares(s, d):
    e = roles.event_views(s, d).filter("kind = 'share'").withColumn("day", F.to_date("ts"))
    totals = e.agg(F.count_if(F.col("url") < 3).alias("kept_fake"), F.count_if(F.col("url") >= 3).alias("kept_other"))
    out = sampling.restored(sampling.cap_trials(e, ["user_id", "day"], F.col("url") < 3, [1, 2, 5], 20, "event_id"), totals, ["cap"], ["kept_fake", "kept_other"], 100)
    return out.select("cap", r6("kept_fake_share", "kept_fake_share"), r6("kept_other_share", "kept_other_share"))


_VERDICTS = ["FALSE", "Mostly True", "Legend"]


@query("SELECT page_id, CASE WHEN page_id % 6 < 5 THEN 'about ' || url END AS claim, CASE WHEN page_id % 6 < 5 THEN ['FALSE', 'Mostly True', 'Legend'][page_id % 3 + 1] END AS result, CASE WHEN page_id % 6 < 5 THEN 'ok' ELSE 'no_result' END AS parse_result, CASE WHEN page_id % 2 = 0 THEN 'Home|Politics' ELSE '' END AS categories FROM pages", shared=False)
def article_claims(s, d):
    """The given pages' addresses as claims, set in the forms that such articles take."""
    k, verdict = F.col("page_id") % 6, F.element_at(F.array(*map(F.lit, _VERDICTS)), (F.col("page_id") % 3 + 1).cast("int"))
    claim = F.concat(F.lit("about "), F.replace("url", F.lit("&"), F.lit("&amp;")))
    forms = [
        F.concat(F.lit('<p itemprop="claimReviewed"> '), claim, F.lit(' </p><div class="box claim">'), verdict, F.lit("</div>")), F.concat(F.lit("<p><span>Claim</span>: "), claim, F.lit("</p><p>"), verdict, F.lit("</p>")),
        F.concat(F.lit('<p><span>Claim:</span> '), claim, F.lit('</p><div class="claim-old">'), verdict, F.lit("</div><p>x</p>")), F.concat(F.lit("<p><strong>Claim:</strong> "), claim, F.lit("<p>"), verdict),
        F.concat(F.lit("<p><font>Claim:</font> "), claim, F.lit("</p><p>Status: "), verdict, F.lit("</p>")), F.concat(F.lit("<p>"), claim, F.lit("</p>")),
    ]
    body = F.element_at(F.array(*forms), (k + 1).cast("int"))
    trail = F.when(F.col("page_id") % 2 == 0, '<div class="breadcrumb-nav"><a href="/">Home</a><a href="/p">Politics</a></div>').otherwise("")
    html = T(s, d, "pages").select("page_id", F.concat(F.lit("<html><body>"), trail, F.lit("<article>"), body, F.lit("</article></body></html>")).alias("html"))
    found = articles.articles(html, "page_id", "html")
    return found.select("page_id", "claim", "result", "parse_result", F.array_join("categories", "|").alias("categories"))
