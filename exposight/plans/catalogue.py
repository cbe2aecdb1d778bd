"""All queries by name, bound to the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import location, pages, posts, text
from ..operators import graph, linkage, models, ranking, relational, sampling, series, stats
from ..sources import files, roles
from ..streaming import streams
from . import fixtures

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
T = roles.table


def query(sql: str | None = None, shared: bool = True):
    """Registers a query under its function's name; sql may use the common tables of roles.SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH RECURSIVE {roles.SQL}{sql}" if shared else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import inference, more  # noqa: F401  register the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import inference, more  # noqa: F401

    return dict(_SQL)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _fake_counts(s: SparkSession, d: str) -> DataFrame:
    fake = roles.domains(s, d).filter("domain_color_num <= 3").select("website")
    return roles.urls(s, d).join(fake, "website").groupBy("user_id").agg(F.count("*").alias("n"))


_FAKE = ", f AS (SELECT user_id, count(*) AS n FROM urls JOIN domains USING (website) WHERE domain_color_num <= 3 GROUP BY 1)"
_RANKED = _FAKE + ", k AS (SELECT user_id, n, row_number() OVER w AS rank, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cumperc FROM f WINDOW w AS (ORDER BY n DESC, user_id))"


# Ranking and cumulative shares
@query(_RANKED + " SELECT user_id, n, rank, round(cumperc, 6) AS cumperc FROM k WHERE cumperc <= 0.8")
def top80_fake_sharers(s, d):
    return ranking.responsible(_fake_counts(s, d), "n", "user_id").select("user_id", "n", "rank", r6("cumperc", "cumperc"))


@query(_RANKED + " SELECT user_id, n, rank, round(cumperc, 6) AS cumperc FROM k")
def rank_people_cumshare(s, d):
    return ranking.rank_by(_fake_counts(s, d), "n", "user_id").select("user_id", "n", "rank", r6("cumperc", "cumperc"))


_EXP_FAKE = ", x AS (SELECT panel_uid AS user_id, count(*) AS n FROM urls_exp JOIN domains USING (website) WHERE domain_color_num <= 3 GROUP BY 1)"


@query(_EXP_FAKE + ", k AS (SELECT user_id, n, sum(n) OVER (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS c FROM x) SELECT user_id, n, round(c, 6) AS cumperc FROM k WHERE c <= 0.8")
def top80_fake_consumers(s, d):
    fake = roles.domains(s, d).filter("domain_color_num <= 3").select("website")
    shares = roles.shares_by_site(s, d).join(fake, "website").withColumn("any", F.lit(True))
    per = roles.exposures_of(shares, "any", d).select(F.col("panel_uid").alias("user_id"), "n")
    return ranking.responsible(per, "n", "user_id").select("user_id", "n", r6("cumperc", "cumperc"))


@query(", c AS (SELECT user_id, domain_color, count(*) AS n FROM urls JOIN domains USING (website) WHERE domain_color IS NOT NULL GROUP BY ALL) "
       "SELECT domain_color, user_id, round(row_number() OVER w / count(*) OVER (PARTITION BY domain_color), 6) AS percentage_of_total, round(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY domain_color), 6) AS cumulative_percentage "
       "FROM c WINDOW w AS (PARTITION BY domain_color ORDER BY n DESC, user_id)")  # fmt: skip
def lorenz_points(s, d):
    c = roles.urls(s, d).join(roles.domains(s, d), "website").filter("domain_color is not null").groupBy("user_id", "domain_color").agg(F.count("*").alias("n"))
    k = ranking.rank_by(c, "n", "user_id", ["domain_color"])
    return k.select("domain_color", "user_id", r6(F.col("rank") / F.count("*").over(W.partitionBy("domain_color")), "percentage_of_total"), r6("cumperc", "cumulative_percentage"))


@query(_FAKE + " SELECT user_id, n FROM f ORDER BY n DESC, user_id LIMIT 25")
def topk_sharers(s, d):
    return ranking.top_k(_fake_counts(s, d), 25, F.desc("n"), F.asc("user_id"))


@query(", c AS (SELECT user_id, count(*) FILTER (WHERE domain_color_num <= 3) AS fake, count(*) FILTER (WHERE domain_color_num > 3) AS other FROM urls JOIN domains USING (website) GROUP BY 1), "
       "k AS (SELECT *, least(row_number() OVER (ORDER BY fake DESC, user_id), 16) AS ind FROM c), g AS (SELECT ind, sum(fake) AS fake, CASE WHEN ind = 16 THEN 0 ELSE sum(other) END AS other FROM k GROUP BY ind) "
       "SELECT CAST(ind AS BIGINT) AS ind, kind, CAST(n AS BIGINT) AS n FROM (SELECT ind, 'fake' AS kind, fake AS n FROM g UNION ALL SELECT ind, 'other', other FROM g)")  # fmt: skip
def top_n_everyone_else_pivot(s, d):
    c = roles.urls(s, d).join(roles.domains(s, d), "website").groupBy("user_id").agg(F.count_if(F.col("domain_color_num") <= 3).alias("fake"), F.count_if(F.col("domain_color_num") > 3).alias("other"))
    g = ranking.top_and_rest(c, "fake", "user_id", 15, ["fake", "other"]).withColumn("other", F.when(F.col("ind") == 16, 0).otherwise(F.col("other")).cast("long"))
    return g.unpivot("ind", ["fake", "other"], "kind", "n")


_GROUPS = (
    _RANKED + ", shares AS (SELECT user_id, count(*) AS n FROM urls GROUP BY 1), top1 AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS r, count(*) OVER () AS c FROM shares) WHERE r <= c * 0.01), "
    "spend AS (SELECT user_id, row_number() OVER (ORDER BY weight DESC, user_id) AS r, count(*) OVER () AS c FROM panel), top2 AS (SELECT user_id FROM spend WHERE r <= c * 0.01), ga AS (SELECT user_id FROM k WHERE cumperc <= 0.2) "
)


def _groups(s, d):
    a = ranking.responsible(_fake_counts(s, d), "n", "user_id", 0.2).select("user_id")
    shares = roles.urls(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    p = roles.panel(s, d)

    def first_percent(df, value):
        n = F.broadcast(df.agg(F.count("*").alias("c")))
        return ranking.rank_by(df, value, "user_id").join(n, F.col("rank") <= F.col("c") * 0.01).select("user_id")

    return p, a, first_percent(shares, "n"), first_percent(p.select("user_id", "weight"), "weight")


@query(_GROUPS + "SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM ga) THEN 'A' WHEN user_id IN (SELECT user_id FROM top1) THEN 'B' WHEN user_id IN (SELECT user_id FROM top2) THEN 'C' ELSE 'normal' END AS grp FROM panel")
def people_partition(s, d):
    p, a, b, c = _groups(s, d)
    return relational.people_partition(p, a, b, c)


@query(_GROUPS + "SELECT user_id, 'both' AS part FROM (SELECT user_id FROM ga INTERSECT SELECT user_id FROM top1) UNION ALL SELECT user_id, 'only_a' FROM (SELECT user_id FROM ga EXCEPT SELECT user_id FROM top1) UNION ALL SELECT user_id, 'any' FROM (SELECT user_id FROM ga UNION SELECT user_id FROM top1)")
def set_operations(s, d):
    _, a, b, _ = _groups(s, d)
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("only_a"))).unionByName(a.union(b).distinct().withColumn("part", F.lit("any")))


# Exposure joins and counts
@query(" SELECT panel_uid, website, count(*) AS n FROM urls_exp GROUP BY ALL")
def exposure_counts(s, d):
    return roles.exposures_by_site(s, d)


@query(", e AS (SELECT panel_uid, count(*) AS n_exp, count(*) FILTER (WHERE domain_color_num <= 3) AS n_fn_exp FROM urls_exp JOIN domains USING (website) GROUP BY 1) "
       "SELECT user_id, party, coalesce(n_exp, 0) AS n_exp, coalesce(n_fn_exp, 0) AS n_fn_exp FROM panel LEFT JOIN e ON user_id = panel_uid WHERE is_member")  # fmt: skip
def exposure_wide_left(s, d):
    shares = roles.shares_by_site(s, d).join(roles.domains(s, d), "website").withColumn("fake", F.col("domain_color_num") <= 3)
    n = roles.exposures_of(shares, "fake", d).groupBy("panel_uid").agg(F.sum("n").alias("n_exp"), F.sum(F.when(F.col("fake"), F.col("n")).otherwise(0)).alias("n_fn_exp"))
    p = roles.panel(s, d).filter("is_member")
    return p.join(n, p["user_id"] == n["panel_uid"], "left").select("user_id", "party", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exp", "n_fn_exp")])


@query(" SELECT website, count(*) FILTER (WHERE where_url_found = 'orig') AS orig, count(*) FILTER (WHERE where_url_found = 'retweeted') AS retweeted, count(*) FILTER (WHERE where_url_found = 'quoted') AS quoted FROM urls GROUP BY 1")
def share_type_counts(s, d):
    return roles.urls(s, d).groupBy("website").agg(*[F.count_if(F.col("where_url_found") == k).alias(k) for k in ("orig", "retweeted", "quoted")])


@query(" SELECT website, count(DISTINCT user_id) AS people, count(DISTINCT canonical_url) AS links FROM urls GROUP BY 1")
def count_distinct_people(s, d):
    return roles.urls(s, d).groupBy("website").agg(F.count_distinct("user_id").alias("people"), F.count_distinct("canonical_url").alias("links"))


@query(", c AS (SELECT DISTINCT website, user_id, canonical_url FROM urls) SELECT website, user_id, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 2")
def distinct_then_count(s, d):
    return roles.urls(s, d).select("website", "user_id", "canonical_url").distinct().groupBy("website", "user_id").agg(F.count("*").alias("n")).filter("n > 2")


# People and recoding
_EDGES, _LABELS = [-1.0, -0.7142857, -0.3, 0.3, 0.7142857, 1.0], ["extreme left", "left", "center", "right", "extreme right"]


@query(", n AS (SELECT user_id, count(*) AS n FROM urls GROUP BY 1) SELECT p.user_id, CASE WHEN pol_affl > -1 AND pol_affl <= -0.7142857 THEN 'extreme left' WHEN pol_affl > -0.7142857 AND pol_affl <= -0.3 THEN 'left' WHEN pol_affl > -0.3 AND pol_affl <= 0.3 THEN 'center' "
       "WHEN pol_affl > 0.3 AND pol_affl <= 0.7142857 THEN 'right' WHEN pol_affl > 0.7142857 AND pol_affl <= 1 THEN 'extreme right' END AS bucket, round(log10(1 + coalesce(n, 0)), 6) AS log_shares, "
       "CASE WHEN coalesce(n, 0) > 60 THEN 'supersharer' WHEN weight > 9900 THEN 'superconsumer' WHEN state = 7 THEN 'bot' WHEN coalesce(n, 0) < 20 THEN 'apolitical' ELSE 'bucket' END AS kind FROM panel p LEFT JOIN n USING (user_id)")  # fmt: skip
def panel_features(s, d):
    n = roles.urls(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    p = roles.panel(s, d).join(n, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = relational.last_wins(F.lit("bucket"), (F.col("n") < 20, "apolitical"), (F.col("state") == 7, "bot"), (F.col("weight") > 9900, "superconsumer"), (F.col("n") > 60, "supersharer"))
    return p.select("user_id", relational.cut(F.col("pol_affl"), _EDGES, _LABELS).alias("bucket"), r6(F.log10(1 + F.col("n")), "log_shares"), kind.alias("kind"))


@query("SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS party, CASE WHEN c_nationkey = 3 THEN NULL WHEN c_nationkey > 10 THEN 'hi' ELSE 'lo' END AS half FROM customer", shared=False)
def recode_values(s, d):
    p = roles.panel(s, d)
    half = relational.if_else(F.nullif("state", F.lit(3)) > 10, F.lit("hi"), F.lit("lo"))
    return p.select("user_id", relational.map_values("party", {"BUILDING": "B", "MACHINERY": "M"}).alias("party"), half.alias("half"))


@query(", a AS (SELECT website AS domain, 'snopes' AS color FROM domains WHERE website % 4 < 2), b AS (SELECT website AS domain, 'Black' AS color FROM domains WHERE website % 3 = 0), c AS (SELECT website AS domain, CASE WHEN website % 2 = 0 THEN 'Satire' ELSE 'Orange' END AS color FROM domains WHERE website % 5 > 1) "
       "SELECT domain, coalesce(a.color, b.color, c.color) AS color FROM a FULL JOIN b USING (domain) FULL JOIN c USING (domain)")  # fmt: skip
def domains_merge_full_outer(s, d):
    k = roles.domains(s, d).select(F.col("website").alias("domain"))
    return relational.merge_lists(k.filter("domain % 4 < 2").withColumn("color", F.lit("snopes")), k.filter("domain % 3 = 0").withColumn("color", F.lit("Black")), k.filter("domain % 5 > 1").withColumn("color", F.when(F.col("domain") % 2 == 0, "Satire").otherwise("Orange")))


@query(", o AS (SELECT canonical_url FROM urls GROUP BY 1 HAVING count(*) = 1) SELECT tweet_id, line_no, canonical_url FROM urls JOIN o USING (canonical_url)")
def occurs_once_semi(s, d):
    return relational.occurs_once(roles.urls(s, d), "canonical_url").select("tweet_id", "line_no", "canonical_url")


@query(" SELECT website, count(*) AS n FROM urls WHERE website NOT IN (SELECT website FROM domains WHERE domain_color_num <= 3) GROUP BY 1")
def blacklist_anti(s, d):
    black = roles.domains(s, d).filter("domain_color_num <= 3").select("website")
    return roles.urls(s, d).join(black, "website", "left_anti").groupBy("website").agg(F.count("*").alias("n"))


@query(_RANKED + ", t AS (SELECT min(n) AS least FROM k WHERE cumperc <= 0.3) SELECT user_id, n FROM f, t WHERE n >= least")
def tail_threshold_join(s, d):
    n = _fake_counts(s, d)
    return relational.at_least_tail(n, "n", ranking.responsible(n, "n", "user_id", 0.3), "n")


# Time
_REF = 1_704_949_200_000_000  # 2024-01-11T05:00:00Z


@query(f"SELECT event_id, CAST(floor((epoch_us(ts) - {_REF}) / 86400e6) AS BIGINT) AS rel_day, CAST(floor((epoch_us(ts) - {_REF}) / 604800e6) AS BIGINT) AS rel_week FROM events", shared=False)
def relative_day_week(s, d):
    return T(s, d, "events").select("event_id", series.relative_days(F.col("ts"), _REF).alias("rel_day"), series.relative_days(F.col("ts"), _REF, 7).alias("rel_week"))


@query(", c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS \"N\", count(*) FILTER (WHERE domain_color = 'Black') AS black, count(*) FILTER (WHERE domain_color = 'Red') AS red, count(*) FILTER (WHERE domain_color = 'Orange') AS orange FROM urls JOIN domains USING (website) GROUP BY 1) "
       "SELECT CAST(day AS VARCHAR) AS day, \"N\", black, red, orange, round(black / \"N\", 6) AS pct_black, round(red / \"N\", 6) AS pct_red, round(orange / \"N\", 6) AS pct_orange, round(black / \"N\" + red / \"N\" + orange / \"N\", 6) AS pct_fake FROM c")  # fmt: skip
def daily_color_pcts(s, d):
    u = roles.urls(s, d).join(roles.domains(s, d), "website").withColumn("day", F.to_date("ts").cast("string"))
    c = series.daily_percents(u, "day", "domain_color", ["Black", "Red", "Orange"])
    return c.select("day", "N", "black", "red", "orange", *[r6(x, x) for x in ("pct_black", "pct_red", "pct_orange", "pct_fake")])


# Shares by group and alignment
@query(", c AS (SELECT panel_uid, website, count(*) AS n FROM urls_exp GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY panel_uid) AS total FROM c) SELECT panel_uid, website, n, round(n / total, 6) AS pct FROM t WHERE total >= 100 AND n / total > 0.01")
def user_site_pct(s, d):
    shares = graph.keep(roles.shares_by_site(s, d))
    total = roles.exposures_of(shares.withColumn("any", F.lit(True)), "any", d).select("panel_uid", F.col("n").alias("total"))
    c = roles.exposures_of(shares, "website", d, above=0.01).join(total, "panel_uid")
    return c.filter("total >= 100 and n / total > 0.01").select("panel_uid", "website", "n", r6(F.col("n") / F.col("total"), "pct"))


_ALIGN = (
    ", m AS (SELECT user_id, pol_affl < 0 AS dem FROM panel), n AS (SELECT count(*) FILTER (WHERE dem) AS nd, count(*) FILTER (WHERE NOT dem) AS nr FROM m), v AS (SELECT website, count(DISTINCT user_id) FILTER (WHERE dem) AS d, count(DISTINCT user_id) FILTER (WHERE NOT dem) AS r FROM urls JOIN m USING (user_id) GROUP BY 1), "
    "a AS (SELECT website, 2 * (0.5 * (nd + nr) / nr * r) / (0.5 * (nd + nr) / nd * d + 0.5 * (nd + nr) / nr * r) - 1 AS align FROM v, n WHERE d + r > 5) "
)


def _site_alignment(s, d):
    m = roles.panel(s, d).select("user_id", (F.col("pol_affl") < 0).alias("dem"))
    n = m.agg(F.count_if("dem").alias("nd"), F.count_if(~F.col("dem")).alias("nr"))
    v = roles.urls(s, d).select("website", "user_id").distinct().join(m, "user_id").groupBy("website").agg(F.count_if("dem").alias("d"), F.count_if(~F.col("dem")).alias("r")).filter("d + r > 5").join(F.broadcast(n))
    wd, wr = 0.5 * (F.col("nd") + F.col("nr")) / F.col("nd"), 0.5 * (F.col("nd") + F.col("nr")) / F.col("nr")
    return v.select("website", (2 * (wr * F.col("r")) / (wd * F.col("d") + wr * F.col("r")) - 1).alias("align"))


@query(_ALIGN + "SELECT website, round(align, 6) AS align FROM a")
def site_alignment_balanced(s, d):
    return _site_alignment(s, d).select("website", r6("align", "align"))


@query(_ALIGN + ", c AS (SELECT user_id, website, count(*) AS n FROM urls GROUP BY ALL) SELECT user_id, round(sum(align * n) / sum(n), 6) AS align FROM c JOIN a USING (website) GROUP BY 1".replace(" , c", ", c"))
def user_alignment_weighted(s, d):
    c = roles.urls(s, d).groupBy("user_id", "website").agg(F.count("*").alias("n"))
    return c.join(_site_alignment(s, d), "website").groupBy("user_id").agg(r6(stats.weighted_mean(F.col("align"), F.col("n")), "align"))


_SQL["user_alignment_weighted"] = _SQL["user_alignment_weighted"].replace(") , c AS", "), c AS")


@query(_ALIGN + ", b AS (SELECT website, domain_color_num, CASE WHEN align > -0.2 THEN 'conservative' ELSE 'liberal' END AS lean FROM a JOIN domains USING (website)) SELECT lean, count(*) AS sites, count(*) FILTER (WHERE domain_color_num <= 3) AS fake FROM b GROUP BY 1")
def fake_site_alignment_bins(s, d):
    lean = F.when(F.col("align") > -0.2, "conservative").otherwise("liberal")
    return _site_alignment(s, d).join(roles.domains(s, d), "website").groupBy(lean.alias("lean")).agg(F.count("*").alias("sites"), F.count_if(F.col("domain_color_num") <= 3).alias("fake"))


@query(_ALIGN + ", l AS (SELECT website, CASE WHEN abs(align) > 0.142857 THEN CASE WHEN align > 0 THEN 'right' ELSE 'left' END END AS lean FROM a), p AS (SELECT user_id, CASE WHEN pol_affl > 0.3 THEN 'right' WHEN pol_affl < -0.3 THEN 'left' END AS lean FROM panel) "
       "SELECT CASE WHEN l.lean = p.lean THEN 'congruent' WHEN l.lean <> p.lean THEN 'incongruent' END AS congruence, count(*) AS n FROM urls JOIN l USING (website) JOIN p USING (user_id) GROUP BY 1")  # fmt: skip
def congruence_counts(s, d):
    site = _site_alignment(s, d).select("website", F.when(F.abs("align") > 0.142857, F.when(F.col("align") > 0, "right").otherwise("left")).alias("a"))
    user = roles.panel(s, d).select("user_id", F.when(F.col("pol_affl") > 0.3, "right").when(F.col("pol_affl") < -0.3, "left").alias("b"))
    both = roles.urls(s, d).join(site, "website").join(user, "user_id")
    return both.groupBy(F.when(F.col("a") == F.col("b"), "congruent").when(F.col("a") != F.col("b"), "incongruent").alias("congruence")).agg(F.count("*").alias("n"))


for _k in ("site_alignment_balanced", "user_alignment_weighted", "fake_site_alignment_bins", "congruence_counts"):
    _SQL[_k] = _SQL[_k].replace("WHERE d + r > 5) , ", "WHERE d + r > 5), ")


# Concentration
@query(", c AS (SELECT website, sum(n) AS n FROM (SELECT website, count(*) AS n FROM urls_exp GROUP BY 1) GROUP BY 1), g AS (SELECT domain_color_num <= 3 AS fake, website, n, row_number() OVER (PARTITION BY domain_color_num <= 3 ORDER BY n, website) AS i FROM c JOIN domains USING (website)) "
       "SELECT fake, round((2 * sum(i * n) / sum(n) - (count(*) + 1)) / count(*), 6) AS gini, count(*) AS n FROM g GROUP BY 1")  # fmt: skip
def gini_fake_vs_rest(s, d):
    seen = roles.shares_by_site(s, d).join(roles.followers(s, d), "user_id").groupBy("website").agg(F.sum(F.col("k") * F.col("n")).alias("v"))
    c = seen.join(roles.domains(s, d), "website").withColumn("fake", F.col("domain_color_num") <= 3)
    return stats.gini(c, "v", ["fake"], "website").select("fake", r6("gini", "gini"), "n")


@query(", c AS (SELECT p_type AS topic, user_id, count(*) AS n FROM urls JOIN part ON canonical_url = p_partkey GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n, user_id) AS i FROM c) SELECT topic, round((2 * sum(i * n) / sum(n) - (count(*) + 1)) / count(*), 6) AS gini, count(*) AS n FROM g GROUP BY 1")
def gini_by_topic(s, d):
    u = roles.urls(s, d).join(T(s, d, "part").select(F.col("p_partkey").alias("canonical_url"), F.col("p_type").alias("topic")), "canonical_url")
    return stats.gini(u.groupBy("topic", "user_id").agg(F.count("*").alias("v")), "v", ["topic"], "user_id").select("topic", r6("gini", "gini"), "n")


@query(", c AS (SELECT website, count(*) AS v FROM urls GROUP BY 1), t AS (SELECT website, v, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(website || '|' || rep), website) AS k FROM c, range(1, 201) x(rep)), g AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY v, website) AS i FROM t WHERE k <= 20) "
       "SELECT rep, round((2 * sum(i * v) / sum(v) - (count(*) + 1)) / count(*), 6) AS gini FROM g GROUP BY 1")  # fmt: skip
def hash_sampled_gini(s, d):
    c = roles.urls(s, d).groupBy("website").agg(F.count("*").alias("v"))
    return sampling.random_ginis(c, "website", "v", 20, 200).select("rep", r6("gini", "gini"))


# Caps and samples
@query(", dly AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE url < 3) AS fake FROM ev WHERE kind = 'share' GROUP BY ALL), c AS (SELECT *, unnest([1, 2, 5, 10, 50]) AS cap FROM dly) "
       "SELECT CAST(cap AS BIGINT) AS cap, round(sum(least(n, cap) / n * fake), 6) AS kept_fake, round(sum(least(n, cap) / n * (n - fake)), 6) AS kept_other, CAST(sum(fake) AS BIGINT) AS all_fake, CAST(sum(n - fake) AS BIGINT) AS all_other FROM c GROUP BY 1")  # fmt: skip
def cap_closed_form(s, d):
    daily = roles.event_views(s, d).filter("kind = 'share'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("url") < 3).alias("fake"))
    return sampling.cap_expected(daily, [1, 2, 5, 10, 50]).select("cap", r6("kept_fake", "kept_fake"), r6("kept_other", "kept_other"), "all_fake", "all_other")


@query(", t AS (SELECT *, row_number() OVER (PARTITION BY trial, user_id, CAST(ts AS DATE) ORDER BY md5(event_id || '|' || trial), event_id) AS r FROM ev, range(1, 21) x(trial) WHERE kind = 'share'), c AS (SELECT *, unnest([1, 2, 5]) AS cap FROM t) "
       "SELECT trial, CAST(cap AS BIGINT) AS cap, count(*) FILTER (WHERE r <= cap AND url < 3) AS kept_fake, count(*) FILTER (WHERE r <= cap AND url >= 3) AS kept_other FROM c GROUP BY ALL")  # fmt: skip
def cap_hash_order(s, d):
    e = roles.event_views(s, d).filter("kind = 'share'").withColumn("day", F.to_date("ts"))
    return sampling.cap_trials(e, ["user_id", "day"], F.col("url") < 3, [1, 2, 5], 20, "event_id")


@query(", k AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|strata'), event_id) AS r FROM events) SELECT event_id, event_type FROM k WHERE r <= 100")
def stratified_cap_sample(s, d):
    return sampling.stratified_cap(T(s, d, "events").select("event_id", "event_type"), ["event_type"], 100, "strata", "event_id")


@query("SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY md5(doc_id || '|train'), doc_id) AS r FROM labels WHERE toxic = 0) WHERE r <= (SELECT count(*) FROM labels WHERE toxic = 1)", shared=False)
def balanced_training_set(s, d):
    return sampling.balanced(T(s, d, "labels").select("doc_id", "toxic"), "toxic", "train", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '|rows'), doc_id LIMIT 50", shared=False)
def row_sample(s, d):
    return sampling.sample_rows(T(s, d, "documents").select("doc_id"), 50, "rows", "doc_id")


# Attribution
_CLOSE = (
    ", e AS (SELECT * FROM ev WHERE kind = 'exposure'), sh AS (SELECT user_id, url, ts AS ts_share FROM ev WHERE kind = 'share'), j AS (SELECT e.event_id, e.user_id, e.url, e.ts, sh.ts_share, epoch_us(sh.ts_share) - epoch_us(e.ts) AS diff FROM e LEFT JOIN sh USING (user_id, url)), "
    "k AS (SELECT *, min(diff) OVER (PARTITION BY user_id, url, ts_share) AS least FROM j WHERE ts_share IS NULL OR diff > 0), c AS (SELECT event_id, user_id, url, ts_share, diff FROM k WHERE ts_share IS NULL OR diff = least) "
)


def _closest(s, d):
    e = roles.event_views(s, d)
    return relational.closest_preceding(e.filter("kind = 'share'").select("user_id", "url", "ts"), e.filter("kind = 'exposure'").select("event_id", "user_id", "url", "ts"), ["user_id", "url"])


@query(_CLOSE + "SELECT event_id, user_id, url, diff AS ts_diff FROM c")
def closest_exposure(s, d):
    return _closest(s, d).select("event_id", "user_id", "url", "ts_diff")


@query(_CLOSE + ", n AS (SELECT user_id, url, count(ts_share) AS shares, count(DISTINCT event_id) AS exposures FROM c GROUP BY ALL) SELECT * FROM n WHERE NOT shares >= 1 + exposures".replace(") , n", "), n"))
def oversharing_guard(s, d):
    return _closest(s, d).groupBy("user_id", "url").agg(F.count("ts_share").alias("shares"), F.count_distinct("event_id").alias("exposures")).filter("not shares >= 1 + exposures")


@query(_CLOSE + ", n AS (SELECT url, count(ts_share) AS shares, count(*) AS rows FROM c GROUP BY 1) SELECT url, shares, rows, round(shares / rows, 6) AS rate FROM n")
def share_rates(s, d):
    return _closest(s, d).groupBy("url").agg(F.count("ts_share").alias("shares"), F.count("*").alias("rows")).withColumn("rate", F.round(F.col("shares") / F.col("rows"), 6))


for _k in ("oversharing_guard", "share_rates"):
    _SQL[_k] = _SQL[_k].replace("diff = least) , ", "diff = least), ")

# Co-exposure graph
_PAIRS = ", du AS (SELECT DISTINCT user_id, website FROM urls), pr AS (SELECT a.website AS i, b.website AS j, count(*) AS x FROM du a JOIN du b USING (user_id) GROUP BY ALL)"
_BB = _PAIRS + ", w AS (SELECT i, sum(x) AS w FROM pr GROUP BY 1), q AS (SELECT sum(x) / 2 AS q FROM pr), bb AS (SELECT pr.i, pr.j, pr.x, a.w AS w_i, b.w AS w_j, q, least(1.0, a.w / q * b.w / q / 2) AS p FROM pr JOIN w a ON a.i = pr.i JOIN w b ON b.i = pr.j, q WHERE pr.i <= pr.j)"


def _pairs(s, d, both=True, weights=False):
    return relational.pair_counts(roles.urls(s, d), "user_id", "website", both=both, weights=weights)


@query(_PAIRS + " SELECT i, j, x FROM pr")
def coexposure_pairs(s, d):
    return _pairs(s, d)


@query(_BB + " SELECT i, j, x, CAST(w_i AS BIGINT) AS w_i, CAST(w_j AS BIGINT) AS w_j, round(q, 6) AS q, round(p, 9) AS p FROM bb")
def backbone_expected(s, d):
    return graph.backbone(_pairs(s, d, both=False, weights=True)).select("i", "j", "x", "w_i", "w_j", r6("q", "q"), F.round("p", 9).alias("p"))


_THR = _BB + ", th AS (SELECT i, j, x FROM bb WHERE x > (SELECT quantile_cont(x, 0.96) FROM bb) AND i <> j)"


def _strong(s, d):
    return graph.threshold(graph.keep(_pairs(s, d, both=False)), "x")  # the weights of a backbone neither add nor drop a pair


@query(_THR + " SELECT i, j, x FROM th")
def backbone_threshold_p96(s, d):
    return _strong(s, d)


@query(_THR + ", e AS (SELECT i AS a, j AS b FROM th UNION SELECT j, i FROM th), rc(node, x) AS (SELECT DISTINCT a, a FROM e UNION SELECT rc.node, e.b FROM rc JOIN e ON e.a = rc.x) SELECT node, min(x) AS component FROM rc GROUP BY 1")
def connected_components(s, d):
    return graph.components(_strong(s, d))


@query()
def label_propagation(s, d):
    return graph.label_propagation(_strong(s, d), "x")


@query(", c AS (SELECT panel_uid, website % 4 AS cluster, count(*) AS k FROM urls_exp GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY panel_uid) AS total FROM c) SELECT panel_uid, cluster, round(k / total, 6) AS share FROM t WHERE total > 100")
def cluster_share_per_person(s, d):
    shares = roles.shares_by_site(s, d).withColumn("cluster", F.col("website") % 4)
    return graph.share_of_total(roles.exposures_of(shares, "cluster", d).withColumnRenamed("n", "k")).select("panel_uid", "cluster", r6("share", "share"))


# Closed-form statistics
_LANG = ", g AS (SELECT lang, sum(toxic) AS x, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)"
_Z = stats.Z95


def _by_lang(s, d):
    return T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("x"), F.count("*").alias("n"))


def _interval(sql_lo, sql_hi):
    return f"{_LANG} SELECT lang, CAST(x AS BIGINT) AS x, n, round({sql_lo}, 6) AS lo, round({sql_hi}, 6) AS hi FROM g"


_WM, _WH = f"(x / n + {_Z}*{_Z} / (2*n))", f"({_Z} * sqrt(x / n * (1 - x / n) / n + {_Z}*{_Z} / (4*n*n)))"


@query(_interval(f"({_WM} - {_WH}) / (1 + {_Z}*{_Z} / n)", f"({_WM} + {_WH}) / (1 + {_Z}*{_Z} / n)"))
def wilson_ci(s, d):
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    return _by_lang(s, d).select("lang", "x", "n", r6(lo, "lo"), r6(hi, "hi"))


_AP, _AM = f"((x + {_Z}*{_Z} / 2) / (n + {_Z}*{_Z}))", f"(n + {_Z}*{_Z})"


@query(_interval(f"{_AP} - {_Z} * sqrt({_AP} * (1 - {_AP}) / {_AM})", f"{_AP} + {_Z} * sqrt({_AP} * (1 - {_AP}) / {_AM})"))
def agresti_coull_ci(s, d):
    lo, hi = stats.agresti_coull(F.col("x"), F.col("n"))
    return _by_lang(s, d).select("lang", "x", "n", r6(lo, "lo"), r6(hi, "hi"))


@query(f"{_LANG}, i AS (SELECT lang, ({_WM} - {_WH}) / (1 + {_Z}*{_Z} / n) AS lo, ({_WM} + {_WH}) / (1 + {_Z}*{_Z} / n) AS hi FROM g) SELECT a.lang AS lang_a, b.lang AS lang_b, a.lo <= b.hi AND b.lo <= a.hi AS overlaps FROM i a JOIN i b ON a.lang < b.lang")
def ci_overlap(s, d):
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    i = _by_lang(s, d).select("lang", lo.alias("lo"), hi.alias("hi"))
    a, b = i.select(F.col("lang").alias("lang_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")), i.select(F.col("lang").alias("lang_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    return F.broadcast(a).join(b, F.col("lang_a") < F.col("lang_b")).select("lang_a", "lang_b", stats.overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")).alias("overlaps"))


@query(f"{_LANG}, t AS (SELECT max(x) FILTER (WHERE lang = 'en') AS x1, max(n) FILTER (WHERE lang = 'en') AS n1, sum(x) FILTER (WHERE lang <> 'en') AS x2, sum(n) FILTER (WHERE lang <> 'en') AS n2 FROM g), "
       "u AS (SELECT *, (x1 + x2) / (n1 + n2) AS p, abs(x1 / n1 - x2 / n2) AS dd FROM t), v AS (SELECT *, dd - least(0.5 * (1 / n1 + 1 / n2), dd) AS e FROM u) SELECT round(e * e / (p * (1 - p) * (1 / n1 + 1 / n2)), 6) AS chi2 FROM v")  # fmt: skip
def two_prop_stat(s, d):
    en = F.col("lang") == "en"
    t = _by_lang(s, d).agg(*[F.sum(F.when(c, F.col(v))).alias(f"{v}{k}") for k, c in ((1, en), (2, ~en)) for v in ("x", "n")])
    return t.select(r6(stats.two_proportions(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")), "chi2"))


@query(", o AS (SELECT o_totalprice AS v, o_orderpriority LIKE '1%' AS t FROM orders), g AS (SELECT avg(v) FILTER (WHERE t) AS m1, avg(v) FILTER (WHERE NOT t) AS m0, var_samp(v) FILTER (WHERE t) / count(*) FILTER (WHERE t) AS a, var_samp(v) FILTER (WHERE NOT t) / count(*) FILTER (WHERE NOT t) AS b, count(*) FILTER (WHERE t) AS n1, count(*) FILTER (WHERE NOT t) AS n0 FROM o) "
       "SELECT round((m1 - m0) / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 3) AS dof FROM g")  # fmt: skip
def welch_t_stat(s, d):
    return stats.welch(T(s, d, "orders"), "o_totalprice", F.col("o_orderpriority").like("1%")).select(r6("t", "t"), F.round("dof", 3).alias("dof"))


@query(", n AS (SELECT user_id, count(*) AS n FROM urls GROUP BY 1) SELECT round(corr(pol_affl, n), 6) AS r FROM panel JOIN n USING (user_id)")
def pearson_r(s, d):
    n = roles.urls(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return roles.panel(s, d).join(n, "user_id").agg(r6(F.corr("pol_affl", "n"), "r"))


@query("SELECT o_orderpriority AS grp, round(min(o_totalprice), 4) AS q0, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS q4 FROM orders GROUP BY 1", shared=False)
def five_number(s, d):
    f = T(s, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(stats.five_numbers("o_totalprice").alias("q"))
    return f.select("grp", *[F.round(F.col("q")[k], 4).alias(f"q{k}") for k in range(5)])


@query("SELECT round(avg(CAST(abs(l_quantity - 25) <= 0 AS INT)), 6) AS within_0, round(avg(CAST(abs(l_quantity - 25) <= 5 AS INT)), 6) AS within_5, round(avg(CAST(abs(l_quantity - 25) <= 10 AS INT)), 6) AS within_10 FROM lineitem", shared=False)
def tolerance_fracs(s, d):
    t = T(s, d, "lineitem").agg(*stats.tolerance(F.col("l_quantity") - 25, [0, 5, 10]))
    return t.select(*[r6(c, c) for c in t.columns])


@query("WITH p AS (SELECT quality AS x, toxic AS y FROM labels UNION ALL SELECT toxic, quality FROM labels), n AS (SELECT count(*) AS n, sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS od FROM p), m AS (SELECT sum(c * (c - 1)) AS same FROM (SELECT x, count(*) AS c FROM p GROUP BY 1)) SELECT round(1 - od * (n - 1) / (n * (n - 1) - same), 6) AS alpha FROM n, m", shared=False)
def krippendorff_nominal(s, d):
    return stats.krippendorff_nominal(T(s, d, "labels"), "quality", "toxic").select(r6("alpha", "alpha"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 1500) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 1500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars <= 1500) AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars <= 1500) AS tn FROM labels JOIN documents USING (doc_id)", shared=False)
def confusion_matrix(s, d):
    return T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "n_chars"), "doc_id").agg(*stats.confusion(F.col("quality") == 1, F.col("n_chars") > 1500))


@query("WITH g AS (SELECT n_chars, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM w", shared=False)
def auc_ranksum(s, d):
    return stats.auc(T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality").select(r6("auc", "auc"))


@query(", v AS (SELECT party, weight + 1000 AS w, CASE WHEN pol_affl > 0 THEN 1.0 ELSE 0.0 END AS v FROM panel), m AS (SELECT party, sum(v * w) / sum(w) AS mean, sum(w) AS sw, count(*) AS n FROM v GROUP BY 1), e AS (SELECT party, any_value(mean) AS mean, sqrt(sum((w * (v - mean) / sw) ** 2) * any_value(n) / (any_value(n) - 1)) AS se FROM v JOIN m USING (party) GROUP BY 1) "
       "SELECT party, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 2 * se, 6) AS lo, round(mean + 2 * se, 6) AS hi FROM e")  # fmt: skip
def survey_weighted_prop(s, d):
    p = roles.panel(s, d).withColumn("w", F.col("weight") + 1000)
    return stats.survey_mean(p, (F.col("pol_affl") > 0).cast("double"), "w", ["party"]).select("party", *[r6(c, c) for c in ("mean", "se", "lo", "hi")])


# Texts
_TERMS = ["the it", "anesea", "trash", "moron"]


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_@#À-ÿ])(the[ -]it|anesea|trash|moron)(e?s)?($|[^A-Za-z0-9_À-ÿ])') AS label FROM documents", shared=False)
def whitelist_label(s, d):
    return T(s, d, "documents").select("doc_id", text.whitelisted(F.col("text"), _TERMS).alias("label"))


@query()
def whitelist_strip(s, d):
    docs = T(s, d, "documents")
    found, rest = text.strip_whitelist(F.col("text"), _TERMS)
    return docs.filter(text.whitelisted(F.col("text"), _TERMS)).select("doc_id", found.alias("matched"), rest.alias("rest"))


_TOK = "tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def _tokens(s, d):
    return T(s, d, "documents").select("doc_id", F.explode(text.extract_all(F.lower("text"), "[a-z]+")).alias("word"))


@query(f"WITH {_TOK} SELECT word, count(*) AS n FROM tk GROUP BY 1", shared=False)
def tokens_freq(s, d):
    return _tokens(s, d).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {_TOK}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tk), c AS (SELECT word, count(DISTINCT doc_id) AS docs FROM tk GROUP BY 1) SELECT word, docs FROM c, n WHERE docs >= 0.005 * n AND docs <= 0.9 * n", shared=False)
def vocab_prune(s, d):
    return models.vocabulary(_tokens(s, d), "doc_id", "word", 0.005, 0.9)


@query(f"WITH {_TOK}, v AS (SELECT word FROM tk GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20), p AS (SELECT DISTINCT doc_id, word FROM tk JOIN v USING (word)), n AS (SELECT count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM labels), "
       "c AS (SELECT word, count(*) FILTER (WHERE toxic = 1) AS c1, count(*) FILTER (WHERE toxic = 0) AS c0 FROM p JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT word, ln((c1 + 1) / (n1 + 2)) - ln((c0 + 1) / (n0 + 2)) AS pr, ln(1 - (c1 + 1) / (n1 + 2)) - ln(1 - (c0 + 1) / (n0 + 2)) AS ab, ln(n1) - ln(n0) AS prior FROM c, n), "
       "b AS (SELECT sum(ab) + any_value(prior) AS base FROM w), o AS (SELECT doc_id, sum(pr - ab) AS s FROM p JOIN w USING (word) GROUP BY 1) SELECT doc_id, round(coalesce(s, 0) + base, 4) AS llr FROM (SELECT DISTINCT doc_id FROM p) LEFT JOIN o USING (doc_id), b", shared=False)  # fmt: skip
def nb_llr_scores(s, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    docs = T(s, d, "documents").select("doc_id", words.alias("words"))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # rows that repeat an id are one document
        docs = docs.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    return models.naive_bayes_sets(docs, T(s, d, "labels"), "doc_id", "words", "toxic", 20).select("doc_id", F.round("llr", 4).alias("llr"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS thread, arg_min(text, turn) AS opening, count(*) AS turns FROM conversations GROUP BY 1", shared=False)
def thread_text_first_row(s, d):
    c = T(s, d, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("thread"), F.min_by("text", "turn").alias("opening"), F.count("*").alias("turns"))


@query("SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages", shared=False)
def url_host(s, d):
    return T(s, d, "pages").select("page_id", text.host_with_port(F.col("url")).alias("host"))


@query(r"SELECT page_id, regexp_extract(regexp_extract(url, 'https?://([^/:]+)', 1), '[^.]+\.[^.]+$') AS site FROM pages", shared=False)
def url_clean(s, d):
    return T(s, d, "pages").select("page_id", pages.canonical_site(F.col("url")).alias("site"))


@query()
def page_title_links(s, d):
    p = T(s, d, "pages").select("page_id", pages.page_anchors(F.col("html")).alias("m"))
    return p.select("page_id", "m.title", F.explode_outer("m.links").alias("l")).select("page_id", "title", "l.href", F.col("l.text").alias("anchor"), F.col("l.parent").alias("parent"))


@query("SELECT s_suppkey AS id, trim(regexp_replace(lower(replace(s_name, '#', ' ')), '[^a-z]+', ' ', 'g')) AS name FROM supplier", shared=False)
def voter_name_clean(s, d):
    n = F.regexp_replace("s_name", "#", " ")
    return T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.trim(F.regexp_replace(F.regexp_replace(text.clean_name(F.translate(n, "0123456789", "          ")), "[^a-z]+", " "), " +", " ")).alias("name"))


@query("SELECT p_partkey AS id, list_transform(regexp_extract_all(p_name, '[A-Z][a-z]*|[a-z]+'), lambda x: lower(x)) AS words FROM part", shared=False)
def name_words_camel(s, d):
    return T(s, d, "part").select(F.col("p_partkey").alias("id"), text.camel_words(F.col("p_name")).alias("words"))


_SQL["name_words_camel"] = "SELECT p_partkey AS id, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Z][a-z]*|[a-z]+'), lambda x: lower(x)), ' ') AS words FROM part"
_QUERIES["name_words_camel"] = lambda s, d: name_words_camel(s, d).withColumn("words", F.array_join("words", " "))


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']{2,}')) AS word FROM documents), t AS (SELECT item_id, list_distinct(list_transform(string_split(lower(text), ' ')[1:2], lambda x: x)) AS ws FROM benchmark), u AS (SELECT item_id, unnest(ws) AS word FROM t), "
       "m AS (SELECT item_id, doc_id FROM u JOIN w USING (word) JOIN t USING (item_id) GROUP BY item_id, doc_id, len(ws) HAVING count(*) = len(ws)) SELECT item_id, least(count(*), 11) AS n FROM m GROUP BY 1", shared=False)  # fmt: skip
def fulltext_match_counts(s, d):
    index = relational.fulltext_index(T(s, d, "documents"), "doc_id", "text")
    terms = T(s, d, "benchmark").select("item_id", F.slice(F.split(F.lower("text"), " "), 1, 2).alias("w"))
    return relational.match_all(index, "doc_id", terms, "item_id", "w").groupBy("item_id").agg(F.least(F.count("*"), F.lit(11)).cast("long").alias("n"))


# Built on embedded rows
@query("SELECT * FROM (VALUES (0, 'Atlanta', 'GA'), (1, 'California', 'CA'), (2, 'Big Bear City, Ca.', 'CA'), (3, 'De Pere, WI', 'WI'), (4, 'pennsville, nj', 'NJ'), (5, 'Dayton, Nevada', 'NV'), (6, 'Birmingham, England', 'foreign'), (7, 'lebanon', 'foreign'), (8, 'UK', 'foreign'), (9, 'westfield', 'unparsed'), (10, 'Weston WV', 'WV'), (11, 'NYC', 'NY'), (12, 'USA', 'USA'), (13, 'Bay Area', 'CA'), (14, 'Washington', 'WA'), (15, 'Jakarta, ID', 'foreign'), (16, '東京', 'foreign'), (17, '', NULL), (18, 'LA', 'USA'), (19, 'somewhere in', 'unparsed')) t(id, raw, place)", shared=False)
def location_classify(s, d):
    return fixtures.places(s).withColumn("place", location.location(F.col("raw")))


@query()
def handle_align(s, d):
    from ..functions.names import name_handle_words

    return fixtures.profiles(s).select("id", name_handle_words(F.col("name"), F.col("screen_name")).alias("w")).select("id", "w.*")


@query("SELECT * FROM (VALUES ('v1', 1, 'TX'), ('v2', 2, 'NV')) t(voter_id, profile_id, state)", shared=False)
def linkage_e2e(s, d):
    _, pairs = linkage.candidates(fixtures.voters(s), linkage.index_profiles(fixtures.profiles(s)))
    return linkage.adjudicate(linkage.locate(pairs))


@query("SELECT row_number() OVER (ORDER BY conv_id) AS record_no, conv_id || chr(9) || string_agg(coalesce(text, ''), '' ORDER BY turn) AS record FROM conversations GROUP BY conv_id", shared=False)
def record_repair(s, d):
    first = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) == 1
    lines = T(s, d, "conversations").withColumn("text", F.concat(F.when(first, F.concat("conv_id", F.lit("\t"))).otherwise(F.lit("")), F.coalesce("text", F.lit(""))))
    return files.repair_by_start(lines, F.col("text").rlike("^[0-9]+\t"), ["conv_id", "turn"])


@query("SELECT * FROM (VALUES ('f', 1, '101000000\t2015-01-06\tbib\tx\tbandung'), ('f', 2, '101000001\t2015-01-06\tname. sabir\tsab\t'), ('f', 3, '101000002\t2015-01-06\tsam\tunder\t')) t(file, record_no, record)", shared=False)
def record_repair_fold(s, d):
    return files.repair_records(fixtures.raw_lines(s))


def _posts(s, d):
    """Events as post JSON: clicks are retweets, purchases quote a post, errors link to themselves."""
    e = T(s, d, "events").select(F.col("event_id").cast("string").alias("i"), F.col("user_id").cast("string").alias("u"), "event_type")
    lists = lambda url, to: F.concat(F.lit('"entities":{"urls":[{"url":"'), url, F.lit('","expanded_url":"'), to, F.lit('"}],"media":[],"user_mentions":[]}'))
    post = lambda kind, to: F.concat(F.lit('{"id_str":"'), F.lit(kind), "i", F.lit('","full_text":"t","user":{"id_str":"'), "u", F.lit('","screen_name":"n"},'), lists(F.concat(F.lit("https://t.co/" + kind), "i"), to))
    own = F.when(F.col("event_type") == "error", F.concat(F.lit("https://twitter.com/n/status/"), "i")).otherwise(F.concat(F.lit("https://site.example.com:8080/"), "i"))
    inner = lambda name, kind, host: F.concat(F.lit(f',"{name}":'), post(kind, F.concat(F.lit(f"http://{host}/"), "i")), F.lit("}"))
    more = F.when(F.col("event_type") == "click", inner("retweeted_status", "r", "r.example.org")).when(F.col("event_type") == "purchase", inner("quoted_status", "q", "q.example.net")).otherwise(F.lit(""))
    return e.select(F.from_json(F.concat(post("", own), more, F.lit("}")), posts.SCHEMA).alias("p")).select("p.*")


@query("WITH e AS (SELECT CAST(event_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS t FROM events), l AS (SELECT tweet_id, user_id, 'https://t.co/' || tweet_id AS shortened_url, 'https://site.example.com:8080/' || tweet_id AS canonical_url, 'orig' AS where_url_found FROM e WHERE t NOT IN ('click', 'error') "
       "UNION ALL SELECT tweet_id, user_id, 'https://t.co/r' || tweet_id, 'http://r.example.org/' || tweet_id, 'retweeted' FROM e WHERE t = 'click' UNION ALL SELECT tweet_id, user_id, 'https://t.co/q' || tweet_id, 'http://q.example.net/' || tweet_id, 'quoted' FROM e WHERE t = 'purchase') "
       "SELECT *, 'external' AS link_type, split_part(split_part(canonical_url, '//', 2), '/', 1) AS website FROM l", shared=False)  # fmt: skip
def post_links(s, d):
    return posts.external(posts.links(_posts(s, d)))


@query()
def post_texts(s, d):
    f = posts.flatten(fixtures.post_json(s))
    return f.select("tweet_id", series.post_time(F.col("tweet_date")).alias("ts"), text.tweet_text(F.col("retweet_prefix"), F.col("tweet_text"), F.col("quote_of_user_name"), F.col("quoted_text")).alias("full_text")).join(posts.interaction_tags(fixtures.post_json(s), {"alpha": 11, "beta": 12}), "tweet_id")


# Resampling, series and models
@query()
def bootstrap_mean_ci(s, d):
    return stats.bootstrap_mean(T(s, d, "events").select("event_type", "value"), "value", ["event_type"], 200)


@query()
def changepoints_pelt(s, d):
    daily = T(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return series.changepoints(daily.withColumn("g", F.lit("all")), ["g"], "month", "v", 1e12)


@query("SELECT event_type, round(regr_slope(value, event_id), 6) AS slope, round(regr_intercept(value, event_id), 4) AS intercept FROM events GROUP BY 1", shared=False)
def linear_trend(s, d):
    return series.linear_trend(T(s, d, "events"), ["event_type"], "event_id", "value").select("event_type", r6("slope", "slope"), F.round("intercept", 4).alias("intercept"))


def _model_rows(s, d):
    return T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("y", F.col("quality").cast("double")).withColumn("log_chars", F.log10(F.col("n_chars") + 1.0)).withColumn("is_en", (F.col("lang") == "en").cast("double"))


@query()
def lr_scores(s, d):
    t = T(s, d, "documents").join(T(s, d, "labels"), "doc_id").select("doc_id", F.col("toxic").cast("double").alias("y"), text.extract_all(F.lower("text"), "[a-z]+").alias("words"))
    vec, model = models.lasso_text(t, "words", "y", 5.0, (0.01,), 2)
    return model.transform(vec.transform(t)).select("doc_id", vector_to_array("probability")[1].alias("p"))


@query()
def glm_offset(s, d):
    rows = _model_rows(s, d).withColumn("off", F.lit(0.5))
    return models.alignment(models.ridge_logit(rows, ["log_chars", "is_en"], "y", "off"), rows, "off").select("doc_id", "score")


# Streams, each with a batch equivalent
def _stream(s, d):
    """The events table as a file stream; a table in one file is picked out of its folder by name."""
    src = T(s, d, "events")
    one = all(f.rstrip("/").endswith("events.parquet") for f in src.inputFiles())
    read = s.readStream.schema(src.schema)
    stream = read.option("pathGlobFilter", "events.parquet").parquet(d) if one else read.parquet(f"{d}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", shared=False)
def stream_daily_counts(s, d):
    out = streams.drain(s, streams.daily_counts(_stream(s, d), "ts", "event_type"), "complete")
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n")


@query("SELECT user_id, event_type FROM events GROUP BY ALL", shared=False)
def stream_dedup(s, d):
    return streams.drain(s, streams.first_seen(_stream(s, d), ["user_id", "event_type"], "ts").select("user_id", "event_type"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, count(*) AS n FROM k GROUP BY user_id, sid", shared=False)
def stream_session(s, d):
    return streams.drain(s, streams.sessions(_stream(s, d), "ts", "user_id"), "complete").select("user_id", "n")


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, least(n, 3) AS n FROM c", shared=False)
def stream_running_cap(s, d):
    out = streams.drain(s, streams.capped(_stream(s, d).select("user_id", "event_id"), ["user_id"], 3, "user_id long, event_id long"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


# Built-in extras
@query("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", shared=False)
def cube_counts(s, d):
    c = T(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("SELECT user_id, event_id, lag(value) OVER w AS before, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", shared=False)
def lag_ntile(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return T(s, d, "events").select("user_id", "event_id", F.lag("value").over(w).alias("before"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click FROM events GROUP BY 1", shared=False)
def pivot_counts(s, d):
    p = T(s, d, "events").groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.count(F.lit(1)))
    return p.select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c}") for c in ("view", "click")])
