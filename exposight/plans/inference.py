"""Queries of communities, matching, densities, tails and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities, density, graph, irls, matching, stats, tails
from ..sources import roles
from .catalogue import _BB, _LANG, _SQL, T, _by_lang, _pairs, _strong, query, r6

_Z = stats.Z95


# Communities.  A planted graph: customers in blocks of thirty, all of a block linked, and the end of a block with the start of the next.
def _planted(s, d):
    c = T(s, d, "customer").select(F.col("c_custkey").alias("i"), F.floor(F.col("c_custkey") / 30).alias("block"))
    inside = c.join(c.select(F.col("i").alias("j"), "block"), "block").filter("i < j").select("i", "j")
    across = c.filter("i % 30 = 29").select("i", (F.col("i") + 1).alias("j")).join(c.select(F.col("i").alias("j")), "j", "left_semi")
    return inside.unionByName(across).withColumn("w", F.lit(1.0))


_BLOCKS = "WITH c AS (SELECT c_custkey AS i, c_custkey // 30 AS b FROM customer), e AS (SELECT x.i, y.i AS j FROM c x JOIN c y ON x.b = y.b AND x.i < y.i UNION ALL SELECT x.i, x.i + 1 FROM c x JOIN c y ON y.i = x.i + 1 WHERE x.i % 30 = 29)"
_PLANTED_Q = (
    _BLOCKS + ", m AS (SELECT count(*) AS m FROM e), g AS (SELECT i // 30 AS b, count(*) AS n FROM (SELECT i FROM e UNION ALL SELECT j FROM e) GROUP BY 1), k AS (SELECT i // 30 AS b, count(*) AS n FROM e WHERE i // 30 = j // 30 GROUP BY 1) "
    "SELECT round(sum(coalesce(k.n, 0) / m - (g.n / (2 * m)) ** 2), 6) AS modularity FROM g LEFT JOIN k USING (b), m"
)


@query(_PLANTED_Q, shared=False)
def louvain_planted(s, d):
    e = graph.keep(_planted(s, d))
    return communities.modularity(e, communities.louvain(e, "w"), "w").select(r6("modularity", "modularity"))


@query(_PLANTED_Q, shared=False)
def walktrap_planted(s, d):
    e = graph.keep(_planted(s, d))
    return communities.modularity(e, communities.walktrap(e, "w"), "w").select(r6("modularity", "modularity"))


@query(_BLOCKS + ", n AS (SELECT i FROM e UNION SELECT j FROM e) SELECT i AS node, CASE i // 30 WHEN 1 THEN 'first' WHEN 3 THEN 'second' ELSE 'other' END AS name FROM n", shared=False)
def consensus_planted(s, d):
    e = graph.keep(_planted(s, d))
    found = [communities.louvain(e, "w"), graph.label_propagation(e, "w"), communities.walktrap(e, "w")]
    return graph.consensus_names([graph.keep(c) for c in found], {35: "first", 95: "second"})


@query()
def modularity_clusters(s, d):
    return communities.louvain(graph.largest_edges(_strong(s, d)), "x")


@query()
def walktrap_clusters(s, d):
    return communities.walktrap(graph.largest_edges(_strong(s, d)), "x")


# Matching
_NEWTON = """
, {n}(it, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT it + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT it, b0, b1, sum(p * (1 - p)) AS h00, sum(x * p * (1 - p)) AS h01, sum(x * x * p * (1 - p)) AS h11, sum(y - p) AS g0, sum(x * (y - p)) AS g1
        FROM (SELECT it, b0, b1, x, y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM {n}, {data} WHERE it < 25) GROUP BY it, b0, b1))
"""
_MATCH = (
    ", u AS (SELECT website, CAST(domain_color_num <= 3 AS INT) AS y, log10(count(*) + 1.0) AS x FROM urls JOIN domains USING (website) GROUP BY ALL)"
    + _NEWTON.format(n="nt", data="u")
    + ", sc AS (SELECT website, y, 1 / (1 + exp(-b0 - b1 * x)) AS s FROM u, nt WHERE it = 25), tr AS (SELECT website, s, row_number() OVER (ORDER BY s DESC, website) AS k FROM sc WHERE y = 1), "
    "ct AS (SELECT list({'w': website, 's': s}) AS c FROM sc WHERE y = 0), "
    "gr(k, used, website, got) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT, []::BIGINT[] UNION ALL SELECT k, list_concat(used, new), website, new FROM ("
    "SELECT tr.k, gr.used, tr.website, list_transform(list_sort(list_transform(list_filter(c, lambda v: NOT list_contains(gr.used, v.w)), lambda v: {'d': abs(v.s - tr.s), 'w': v.w}))[1:2], lambda v: v.w) AS new FROM gr JOIN tr ON tr.k = gr.k + 1, ct)), "
    "mt AS (SELECT website AS treated_unit, unnest(got) AS matched_unit FROM gr WHERE k > 0)"
)


def _matched(s, d):
    c = roles.urls(s, d).groupBy("website").agg(F.log10(F.count("*") + 1.0).alias("x")).join(roles.domains(s, d), "website").select("website", (F.col("domain_color_num") <= 3).cast("int").alias("t"), "x")
    return matching.match_nearest(matching.propensity(graph.keep(c), "t", ["x"]), "website", "t", "score", 2)


@query(_MATCH + " SELECT treated_unit, matched_unit FROM mt")
def propensity_match(s, d):
    return _matched(s, d)


@query(_MATCH + ", dr AS (SELECT matched_unit AS website, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(matched_unit || '|' || rep), matched_unit) AS k FROM mt, range(1, 51) r(rep)), "
       "pv AS (SELECT rep, user_id, count(*) AS v FROM urls JOIN dr USING (website) WHERE k <= 10 GROUP BY ALL), gi AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY v) AS i FROM pv) "
       "SELECT rep, round((2 * sum(i * v) / sum(v) - (count(*) + 1)) / count(*), 6) AS gini, count(*) AS n FROM gi GROUP BY 1")  # fmt: skip
def matched_control_gini(s, d):
    chosen = _matched(s, d).select(F.col("matched_unit").alias("website"))
    return matching.matched_ginis(roles.urls(s, d).select("website", "user_id"), "website", "user_id", F.lit(1), chosen, 10, 50).select("rep", r6("gini", "gini"), "n")


# Densities
@query("WITH v AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL), s AS (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * count(*) ** -0.2 AS bw FROM v GROUP BY 1), "
       "x AS (SELECT *, lo - 3 * bw + p * (hi - lo + 6 * bw) / 511 AS x FROM s, range(512) r(p)) SELECT x.g AS event_type, round(x, 6) AS x, round(sum(exp(-((x - v) ** 2) / (2 * bw * bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) AS density FROM x JOIN v ON x.g = v.g GROUP BY x.g, x", shared=False)  # fmt: skip
def value_density(s, d):
    return density.density(T(s, d, "events"), "value", ["event_type"]).select("event_type", r6("x", "x"), F.round("density", 8).alias("density"))


# Tails: Student's t by Simpson's rule over its density, binomials by sums of lgamma terms
def _t_tail(t: str, dof: str) -> str:
    f = f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi()) * (1 + ({t} * k / 4000) ** 2 / {dof}) ** (-({dof} + 1) / 2)"
    return f"(1 - 2 * (SELECT sum({f} * CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {t} / 12000 FROM range(4001) r(k)))"


@query("WITH o AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS t FROM lineitem WHERE l_orderkey % 7 = l_linenumber), g AS (SELECT avg(v) FILTER (WHERE t) AS m1, avg(v) FILTER (WHERE NOT t) AS m0, var_samp(v) FILTER (WHERE t) / count(*) FILTER (WHERE t) AS a, var_samp(v) FILTER (WHERE NOT t) / count(*) FILTER (WHERE NOT t) AS b, count(*) FILTER (WHERE t) AS n1, count(*) FILTER (WHERE NOT t) AS n0 FROM o), "
       "z AS (SELECT (m1 - m0) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) AS dof FROM g), y AS (SELECT *, abs(t) AS u FROM z) "
       f"SELECT round(t, 6) AS t, round({_t_tail('u', 'dof')}, 6) AS p, round(CASE WHEN t >= 0 THEN {_t_tail('u', 'dof')} / 2 ELSE 1 - {_t_tail('u', 'dof')} / 2 END, 6) AS p_greater FROM y", shared=False)  # fmt: skip
def welch_p(s, d):
    rows = T(s, d, "lineitem").filter("l_orderkey % 7 = l_linenumber")
    return stats.welch(rows, "l_extendedprice", F.col("l_returnflag") == "R").select(r6("t", "t"), r6("p", "p"), r6("p_greater", "p_greater"))


@query(", n AS (SELECT user_id, count(*) AS n FROM urls GROUP BY 1), c AS (SELECT corr(pol_affl, n) AS r, count(*) AS n FROM panel JOIN n USING (user_id)), y AS (SELECT *, n - 2 AS dof, abs(r * sqrt((n - 2) / (1 - r * r))) AS u FROM c) "
       f"SELECT round(r, 6) AS r, n, round({_t_tail('u', 'dof')}, 6) AS p, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 6) AS hi FROM y")  # fmt: skip
def pearson_interval(s, d):
    n = roles.urls(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return tails.correlation(roles.panel(s, d).join(n, "user_id"), "pol_affl", "n").select(r6("r", "r"), "n", *[r6(c, c) for c in ("p", "lo", "hi")])


@query(f"{_LANG}, t AS (SELECT max(x) FILTER (WHERE lang = 'en') AS x1, max(n) FILTER (WHERE lang = 'en') AS n1, sum(x) FILTER (WHERE lang <> 'en') AS x2, sum(n) FILTER (WHERE lang <> 'en') AS n2 FROM g), "
       "u AS (SELECT *, (x1 + x2) / (n1 + n2) AS p, abs(x1 / n1 - x2 / n2) AS dd FROM t), v AS (SELECT *, dd - least(0.5 * (1 / n1 + 1 / n2), dd) AS e FROM u), w AS (SELECT e / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z FROM v) "
       "SELECT round(z * z, 6) AS chi2, round(1 - 2 * (SELECT sum(exp(-((z * k / 4000) ** 2) / 2) * CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * z / 12000 / sqrt(2 * pi()) FROM range(4001) r(k)), 6) AS p FROM w")  # fmt: skip
def two_prop_p(s, d):
    en = F.col("lang") == "en"
    t = _by_lang(s, d).agg(*[F.sum(F.when(c, F.col(v))).alias(f"{v}{k}") for k, c in ((1, en), (2, ~en)) for v in ("x", "n")])
    chi = t.select(stats.two_proportions(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")).alias("chi"))
    return chi.select(r6("chi", "chi2"), r6(tails.chi_square(F.col("chi"), F.lit(1.0)), "p"))


_SQL["backbone_pvalue"] = (
    f"WITH RECURSIVE {roles.SQL}{_BB}, tm AS (SELECT i, j, x, m, p, unnest(range(x, CAST(least(m, ceil(greatest(x, m * p) + 14 * sqrt(m * p) + 80)) AS BIGINT) + 1)) AS k FROM (SELECT i, j, CAST(x AS BIGINT) AS x, CAST(round_even(q, 0) AS BIGINT) AS m, p FROM bb)), "
    "lt AS (SELECT i, j, x, lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p) AS l FROM tm), mx AS (SELECT i, j, max(l) AS top FROM lt GROUP BY ALL) "
    "SELECT i, j, any_value(x) AS x, round(-(any_value(top) + ln(sum(exp(l - top)))), 5) AS significance FROM lt JOIN mx USING (i, j) GROUP BY i, j"
)


@query(_SQL["backbone_pvalue"], shared=False)
def backbone_pvalue(s, d):
    return graph.significance(graph.backbone(_pairs(s, d, both=False, weights=True))).select("i", "j", "x", F.round("significance", 5).alias("significance"))


# Regressions
def _toxic_rows(s, d):
    return T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("y"), F.log10(F.col("n_chars") + 1.0).alias("x"))


_TOXIC = "WITH RECURSIVE dt AS (SELECT toxic AS y, log10(n_chars + 1.0) AS x FROM labels JOIN documents USING (doc_id))" + _NEWTON.format(n="nt", data="dt")


@query(_TOXIC + ", f AS (SELECT b0, b1 FROM nt WHERE it = 25), h AS (SELECT sum(p * (1 - p)) AS a, sum(x * p * (1 - p)) AS b, sum(x * x * p * (1 - p)) AS c FROM (SELECT x, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM dt, f)) "
       "SELECT '1' AS term, round(b0, 6) AS estimate, round(sqrt(c / (a * c - b * b)), 6) AS se FROM f, h UNION ALL SELECT 'x', round(b1, 6), round(sqrt(a / (a * c - b * b)), 6) FROM f, h", shared=False)  # fmt: skip
def logit_coefficients(s, d):
    m = irls.fit(_toxic_rows(s, d), "y", ["x"])
    rows = [(t, b, float(v) ** 0.5) for t, b, v in zip(m.terms, m.beta.tolist(), m.cov.diagonal())]
    return s.createDataFrame(rows, "term string, estimate double, se double").select("term", r6("estimate", "estimate"), r6("se", "se"))


@query(_TOXIC + " SELECT x, round(1 / (1 + exp(-b0 - b1 * x)), 6) AS mean, (SELECT count(*) FROM dt) AS n FROM nt, (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE)) g(x) WHERE it = 25", shared=False)
def effect_grid(s, d):
    rows = _toxic_rows(s, d)
    return irls.marginal_effects(irls.fit(rows, "y", ["x"]), rows, {"x": [2.0, 3.0, 4.0]}).select("x", r6("mean", "mean"), "n")


@query("WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d FROM r) "
       "SELECT 'quantity' AS term, round((1 - bc * bc) / d, 6) AS gvif, 1 AS df, round(sqrt((1 - bc * bc) / d), 6) AS scaled FROM d UNION ALL SELECT 'price', round((1 - ac * ac) / d, 6), 1, round(sqrt((1 - ac * ac) / d), 6) FROM d UNION ALL SELECT 'discount', round((1 - ab * ab) / d, 6), 1, round(sqrt((1 - ab * ab) / d), 6) FROM d", shared=False)  # fmt: skip
def variance_inflation(s, d):
    found = irls.gvif(T(s, d, "lineitem"), {"quantity": ["l_quantity"], "price": ["l_extendedprice"], "discount": ["l_discount"]})
    return found.select("term", r6("gvif", "gvif"), "df", r6("scaled", "scaled"))
