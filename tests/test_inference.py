"""Running totals, communities, matching, densities, tails and regressions against plain versions."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposight.operators import communities, density, graph, irls, matching, ranking, stats, tails


# Running totals
def test_running_totals(spark):
    rng = np.random.default_rng(0)
    rows = [(k, None if k % 7 == 0 else f"g{k % 3}", int(rng.integers(0, 5)), None if k % 11 == 0 else int(rng.integers(0, 9))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, o int, v int").repartition(6)
    got = ranking.running(df, [F.col("o"), F.col("id")], {"before": F.col("v"), "rank": F.lit(1)}, ["g"], {"total": F.col("v")}).toPandas().sort_values("id")
    p = pd.DataFrame(rows, columns=["id", "g", "o", "v"]).sort_values(["o", "id"])
    p["v"] = p["v"].fillna(0)
    by = p.groupby("g", dropna=False)
    p["before"], p["rank"], p["total"] = by["v"].cumsum() - p["v"], by.cumcount(), by["v"].transform("sum")
    p = p.sort_values("id")
    for c in ("before", "rank", "total"):
        assert got[c].tolist() == p[c].tolist(), c
    whole = ranking.running(df, [F.col("id")], {"n": F.lit(1)}).toPandas().sort_values("id")
    assert whole["n"].tolist() == list(range(400))
    assert ranking.running(df.limit(0), [F.col("id")], {"n": F.lit(1)}).count() == 0


def test_gini_ties_nulls_zeros(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", None), ("b", 0.0), ("b", 0.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")

    def plain(y, n=None):
        y, n = sorted(y), n or len(y)
        i = range(n - len(y) + 1, n + 1)
        return (2 * sum(a * b for a, b in zip(i, y)) / sum(y) - (n + 1)) / n if sum(y) else None

    got = {r.g: (r.gini, r.n) for r in stats.gini(df, "v", ["g"]).collect()}
    assert got["a"] == (pytest.approx(plain([1, 1, 4])), 3) and got["b"] == (None, 2) and got[None][1] == 1
    padded = {r.g: r.gini for r in stats.gini(df, "v", ["g"], n=F.lit(10)).collect()}
    assert padded["a"] == pytest.approx(plain([1, 1, 4], 10))


@pytest.mark.parametrize("per", [2000, 3])
def test_pair_counts_of_busy_people(spark, per):
    from collections import Counter
    from exposight.operators.relational import pair_counts

    rows = [("busy", k) for k in range(20)] + [("a", 3), ("a", 4), ("a", 4), ("b", 4)]
    want = Counter((i, j) for p in {p for p, _ in rows} for i in {s for q, s in rows if q == p} for j in {s for q, s in rows if q == p})
    got = pair_counts(spark.createDataFrame(rows, "p string, s long"), "p", "s", per).collect()
    assert {(r.i, r.j): r.x for r in got} == dict(want) and len(got) == len(want)


# Communities
def q_of(edges, of):
    total = 2 * sum(w for *_, w in edges)
    deg, inside = {}, 0.0
    for a, b, w in edges:
        deg[of[a]] = deg.get(of[a], 0) + w
        deg[of[b]] = deg.get(of[b], 0) + w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - sum(d * d for d in deg.values()) / total**2


def planted(seed, groups=4, size=12, inside=0.7, across=0.03):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(a, b, float(rng.integers(1, 4))) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else across)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "i long, j long, w double")


def test_modularity(spark):
    edges = [(0, 1, 2.0), (1, 2, 1.0), (2, 2, 3.0), (0, 1, 1.0)]
    of = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "node long, cluster long")
    assert communities.modularity(frame(spark, edges), of, "w").first()[0] == pytest.approx(q_of(edges, {0: 0, 1: 0, 2: 2}))


def test_louvain(spark, monkeypatch):
    seen = []
    real = communities._modularity

    def spy(*a):
        out = real(*a)
        seen.append(out.first()[0])
        return out

    monkeypatch.setattr(communities, "_modularity", spy)
    edges = planted(1, 3, 8)
    of = {r.node: r.cluster for r in communities.louvain(frame(spark, edges), "w").collect()}
    assert {frozenset(k for k in of if of[k] == c) for c in of.values()} == {frozenset(range(8 * g, 8 * g + 8)) for g in range(3)}
    assert all(min(k for k in of if of[k] == c) == c for c in of.values())
    assert max(seen) == pytest.approx(q_of(edges, of)) and seen[0] == pytest.approx(q_of(edges, {k: k for k in of}))
    assert communities.louvain(frame(spark, []).limit(0), "w").count() == 0


def test_louvain_settles(spark):
    """Without clear groups: levels do not lose modularity, and after the first no single move improves it."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 16, 45), rng.integers(0, 16, 45), rng.integers(1, 5, 45)) if a != b]
    one = {r.node: r.cluster for r in communities.louvain(frame(spark, edges), "w", levels=1, least_gain=1e-9).collect()}
    assert q_of(edges, one) > max(q_of(edges, {k: k for k in one}), 0.0)
    for a in one:
        for c in set(one.values()):
            assert q_of(edges, {**one, a: c}) <= q_of(edges, one) + 1e-8


def walktrap_plain(edges, steps):
    """The method one join at a time, with dense matrices."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[at[a], at[b]] += w
        m[at[b], at[a]] += w
    plain = m.sum(1)
    m += np.diag(plain / (m > 0).sum(1))
    d = m.sum(1)
    x = np.linalg.matrix_power(m / d[:, None], steps) / np.sqrt(d)
    w = {(a, b): m[a, b] for a in range(n) for b in range(a + 1, n) if m[a, b]}
    total = plain.sum()
    size, tot, vec, of = {k: 1 for k in range(n)}, dict(enumerate(plain)), dict(enumerate(x)), {k: k for k in range(n)}
    q = best = -sum(t * t for t in plain) / total**2
    found = dict(of)
    while w:
        delta = {(a, b): (round(size[a] * size[b] / (size[a] + size[b]) * float(((vec[a] - vec[b]) ** 2).sum()) / n, 14), hashlib.md5(f"{nodes[a]}-{nodes[b]}".encode()).hexdigest(), a, b) for a, b in w}
        a, b = min(delta, key=delta.get)
        q += 2 * (w[a, b] / total - tot[a] * tot[b] / total**2)
        vec[a] = (size[a] * vec[a] + size[b] * vec[b]) / (size[a] + size[b])
        size[a], tot[a] = size[a] + size[b], tot[a] + tot[b]
        of = {k: a if c == b else c for k, c in of.items()}
        new: dict = {}
        for (u, v), y in w.items():
            u, v = (a if u == b else u), (a if v == b else v)
            if u != v:
                new[min(u, v), max(u, v)] = new.get((min(u, v), max(u, v)), 0) + y
        w = new
        if q > best + 1e-12:
            best, found = q, dict(of)
    return {nodes[k]: nodes[c] for k, c in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_walktrap_equals_one_by_one(spark, seed):
    edges = planted(seed, 4, 8, 0.6, 0.06)
    got = {r.node: r.cluster for r in communities.walktrap(frame(spark, edges), "w").collect()}
    assert got == walktrap_plain(edges, 4)


def test_consensus(spark):
    make = lambda of: spark.createDataFrame(list(of.items()), "node long, cluster long")
    out = graph.consensus_names([make({1: 1, 2: 1, 3: 1, 4: 4}), make({1: 7, 2: 7, 3: 8, 4: 8})], {1: "left", 4: "right"})
    assert {r.node: r.name for r in out.collect()} == {1: "left", 2: "left", 3: "other", 4: "right"}


def test_largest_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "i long, j long")
    assert {(r.i, r.j) for r in graph.largest_edges(e).collect()} == {(1, 2), (2, 3)}


# Matching
def match_plain(rows, k):
    treated = sorted((r for r in rows if r[1] == 1), key=lambda r: (-r[2], r[0]))
    free = {r[0]: r[2] for r in rows if r[1] == 0}
    out = set()
    for u, _, s in treated:
        for _, c in sorted((abs(v - s), c) for c, v in free.items())[:k]:
            out.add((u, c))
            del free[c]
    return out


@pytest.mark.parametrize("seed,share,k,per", [(0, 0.2, 2, 25), (1, 0.5, 3, 20), (2, 0.05, 5, 60), (3, 0.3, 1, 1000)])
def test_matching_equals_greedy(spark, seed, share, k, per):
    rng = np.random.default_rng(seed)
    score = np.round(rng.beta(2, 5, 500), 2) if seed % 2 else rng.random(500)  # many ties, or none
    rows = [(int(u), int(t), float(s)) for u, t, s in zip(rng.permutation(500), rng.random(500) < share, score)]
    df = spark.createDataFrame(rows + [(None, 1, 0.5), (900, None, 0.5), (901, 1, None), (902, 0, float("nan"))], "u long, t int, s double").repartition(5)
    got = matching.match_nearest(df, "u", "t", "s", k, per=per).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == match_plain(rows, k)


def test_matching_one_score(spark):
    rows = [(u, int(u % 3 == 0), 0.5) for u in range(60)]
    got = {tuple(r) for r in matching.match_nearest(spark.createDataFrame(rows, "u long, t int, s double"), "u", "t", "s", 3, per=8).collect()}
    assert got == match_plain(rows, 3)
    none = spark.createDataFrame([(1, 0, 0.1)], "u long, t int, s double")
    assert matching.match_nearest(none, "u", "t", "s").count() == 0


# Densities
def test_density_against_direct_sums(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(0, 3, 300)] + [("b", float(v)) for v in rng.exponential(1e6, 50)] + [("b", 5e7), ("c", 2.0), ("d", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for bw in (None, 0.5):
        got = density.density(df, "v", ["g"], bw, points=64).toPandas()
        for g in ("a", "b", "c", None):
            v = np.array([y for x, y in rows if x == g])
            part = got[got["g"].isna() if g is None else got["g"] == g].sort_values("x")
            sd, n = (v.std(ddof=1) if len(v) > 1 else 0.0), len(v)
            iqr = (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34
            h = bw or 0.9 * (min(sd, iqr) or sd or abs(v[0]) or 1) * n**-0.2
            x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 64)
            want = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
            assert np.allclose(part["x"], x, rtol=1e-9, atol=1e-9 * h) and np.allclose(part["density"], want, rtol=1e-6, atol=1e-9 * want.max())
        assert "d" not in set(got["g"].dropna())
    assert density.density(df, "v", [], points=16).count() == 16


# Tails
def test_binomial_tail_against_exact_sums():
    for n in (1, 2, 7, 60, 300):
        for p in (Fraction(1, 1000), Fraction(1, 7), Fraction(1, 2), Fraction(93, 100)):
            for x in sorted({1, n // 3, n // 2, n} - {0}):
                upper = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))
                want = math.log(upper.denominator) - math.log(upper.numerator) if upper < Fraction(1, 2) else -math.log1p(-float(1 - upper))
                got = float(tails._binomial(np.array([float(x)]), np.array([float(n)]), np.array([float(p)]))[0])
                assert got == pytest.approx(want, rel=1e-9, abs=1e-14), (n, p, x)
    odd = tails._binomial(np.array([0.0, 3, np.nan, 2, 2]), np.array([5.0, 2, 5, 5, 5]), np.array([0.1, 0.1, 0.1, 0.0, 1.0]))
    assert odd[0] == 0 and odd[1] == np.finfo(float).max and np.isnan(odd[2]) and odd[3] == np.finfo(float).max and odd[4] == 0
    deep = float(tails._binomial(np.array([5000.0]), np.array([1e6]), np.array([0.001]))[0])
    terms = [math.lgamma(1e6 + 1) - math.lgamma(k + 1) - math.lgamma(1e6 - k + 1) + k * math.log(0.001) + (1e6 - k) * math.log1p(-0.001) for k in range(5000, 5400)]
    assert deep == pytest.approx(-(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))), rel=1e-9)


def test_gamma_and_beta():
    for a, x in ((3, 2.5), (10, 40), (1, 0.3), (40, 35)):
        want = sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(a))
        assert math.exp(tails.log_gamma_upper(a, x)) == pytest.approx(want, rel=1e-11)
    for x in (0.01, 1.0, 9.0):
        assert math.exp(tails.log_gamma_upper(0.5, x / 2)) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-11)
    assert np.exp(tails.log_beta(2.5, 4.0, 0.3)) + np.exp(tails.log_beta(4.0, 2.5, 0.7)) == pytest.approx(1, rel=1e-13)
    assert tails.log_beta(1.0, 1.0, np.array([0.0, 0.25, 1.0])).tolist() == [-np.inf, pytest.approx(math.log(0.25)), 0.0]


def test_tail_columns(spark):
    df = spark.createDataFrame([(2.228138851986273, 10.0), (-1.0, 1.0), (0.0, 5.0), (None, 3.0)], "t double, v double")
    got = df.select(tails.t_two_sided(F.col("t"), F.col("v")).alias("two"), tails.t_upper(F.col("t"), F.col("v")).alias("up")).collect()
    assert [r.two for r in got] == [pytest.approx(0.05, rel=1e-9), pytest.approx(0.5), pytest.approx(1.0), None]
    assert [r.up for r in got] == [pytest.approx(0.025, rel=1e-9), pytest.approx(0.75), pytest.approx(0.5), None]
    one = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    r = tails.correlation(one, "x", "y").first()
    assert r.n == 3 and r.lo is None and r.p is not None


# Regressions
def dense(x, y, w, o, ridge):
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ beta + o)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
    return beta, np.linalg.inv(h)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        a, b, f = float(rng.normal()), float(rng.normal()), "xyz"[int(rng.integers(3))]
        rows.append((k, a, b, f, float(rng.integers(1, 4)), 0.3 * a, int(rng.random() < 1 / (1 + math.exp(-(0.4 * a - 0.7 * b * (f == "y") + 0.2))))))
    return rows, spark.createDataFrame(rows + [(900, None, 1.0, "x", 1.0, 0.0, 1), (901, 1.0, 1.0, "x", 1.0, 0.0, None)], "id long, a double, b double, f string, w double, o double, y int").repartition(4)


@pytest.mark.parametrize("penalty", [0.0, 1.5, {"b:f=y": 4.0}])
def test_logit_equals_dense_solve(spark, people, penalty, tmp_path):
    rows, df = people
    terms = ["a", "b", *irls.factor_terms(df, "f"), "b:f=y"]
    m = irls.fit(df, "y", terms, penalty, weight="w", offset="o")
    x = np.array([[1, a, b, f == "y", f == "z", b * (f == "y")] for _, a, b, f, *_ in rows], float)
    ridge = np.array([0.0] + [penalty.get(t, 0.0) if isinstance(penalty, dict) else penalty for t in terms])
    beta, cov = dense(x, np.array([r[6] for r in rows], float), np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), ridge)
    assert m.settled and m.n == 300 and np.allclose(m.beta, beta, atol=1e-9) and np.allclose(m.cov, cov, atol=1e-9)
    m.save(spark, f"file://{tmp_path}/model")
    again = irls.Logit.load(spark, f"file://{tmp_path}/model")
    assert again.terms == m.terms and (again.beta == m.beta).all() and again.settled
    shown = irls.marginal_effects(again, df.filter("id < 300"), {"f": ["x", "y"], "b": [0.0, 1.0]}, F.col("o")).collect()
    assert len(shown) == 4
    for r in shown:
        z = np.array([[1, a, r.b, r.f == "y", r.f == "z", r.b * (r.f == "y")] for _, a, *_ in rows], float)
        assert r.n == 300 and r["mean"] == pytest.approx(float((1 / (1 + np.exp(-(z @ beta + [q[5] for q in rows])))).mean()), rel=1e-9)


def test_logit_edges(spark):
    empty = spark.createDataFrame([], "x double, y int")
    assert irls.fit(empty, "y", ["x"]).n == 0
    apart = spark.createDataFrame([(float(k), int(k > 4)) for k in range(10)], "x double, y int")
    assert not irls.fit(apart, "y", ["x"], rounds=12).settled and irls.fit(apart, "y", ["x"], 1.0).settled
    with pytest.raises(ValueError):
        irls.factor_terms(apart, "x", most=5)


def test_gvif(spark, people):
    rows, df = people
    x = {"a": [[a] for _, a, *_ in rows], "b": [[b] for _, _, b, *_ in rows], "f": [[f == "y", f == "z"] for _, _, _, f, *_ in rows]}
    got = {r.term: r for r in irls.gvif(df.filter("id < 300"), {"a": ["a"], "b": ["b"], "f": ["f=y", "f=z"]}).collect()}
    r = np.corrcoef(np.hstack([np.array(v, float) for v in x.values()]).T)
    for name, own in (("a", [0]), ("b", [1]), ("f", [2, 3])):
        rest = [k for k in range(4) if k not in own]
        want = np.linalg.det(r[np.ix_(own, own)]) * np.linalg.det(r[np.ix_(rest, rest)]) / np.linalg.det(r)
        assert got[name].gvif == pytest.approx(want) and got[name].df == len(own) and got[name].scaled == pytest.approx(want ** (1 / (2 * len(own))))


@pytest.mark.parametrize("cells,pairs,chunk,per", [(1 << 30, 50, 7, 6), (0, 50, 7, 6), (0, 10**9, 5, 50), (1 << 30, 10**9, 5, 50)])
def test_pair_counts_by_tiles(spark, monkeypatch, cells, pairs, chunk, per):
    import random
    from collections import Counter
    from exposight.operators import relational

    for k, v in (("_CELLS", cells), ("_PAIRS", pairs), ("_CHUNK", chunk)):
        monkeypatch.setattr(relational, k, v)
    r = random.Random(3)
    rows = [(r.randrange(12), f"s{r.randrange(40)}") for _ in range(250)] + [(None, "s1"), (99, "s39")]
    of = {}
    for p, v in rows:
        if p is not None:
            of.setdefault(p, set()).add(v)
    want = Counter((i, j) for s in of.values() for i in s for j in s)
    df = spark.createDataFrame(rows, "p long, s string")
    assert {(x.i, x.j): x.x for x in relational.pair_counts(df, "p", "s", per).collect()} == dict(want)
    half = relational.pair_counts(df, "p", "s", per, both=False).collect()
    assert {(x.i, x.j): x.x for x in half} == {k: x for k, x in want.items() if k[0] <= k[1]}


def test_pair_counts_shuffle_no_pairs(spark):
    """300 people of the same 120 values: 2 million pairs, no step but the counts makes more rows than the input has."""
    from exposight.operators.relational import pair_counts

    df = spark.range(36_000).selectExpr("id % 300 p", "id div 300 s")
    out = pair_counts(df, "p", "s")
    assert {r.x for r in out.collect()} == {300}
    sizes = []

    def walk(p):
        if p.metrics().contains("numOutputRows"):
            sizes.append(p.metrics().apply("numOutputRows").value())
        for k in range(p.children().size()):
            walk(p.children().apply(k))
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(p.plan())

    walk(out._jdf.queryExecution().executedPlan())
    assert sizes and max(sizes) <= 36_000


def test_walktrap_joins_twins_first(spark, monkeypatch):
    """Cliques: walks are followed from one node of each class of twins, and no pair of twins meets."""
    seen = []
    real = communities.walk_vectors

    def spy(links, nodes, *more):
        seen.append((nodes.count(), links.count()))
        return real(links, nodes, *more)

    monkeypatch.setattr(communities, "walk_vectors", spy)
    edges = [(12 * g + a, 12 * g + b, 1.0) for g in range(4) for a in range(12) for b in range(a + 1, 12)] + [(12 * g + 11, 12 * g + 12, 1.0) for g in range(3)]
    got = {r.node: r.cluster for r in communities.walktrap(frame(spark, edges), "w").collect()}
    assert got == walktrap_plain(edges, 4) == {k: k - k % 12 for k in range(48)}
    assert seen == [(10, 22)]  # of 48 nodes and 534 links in both directions
