"""Exposures without follow edges, against the edges themselves, with people whose rows repeat, null keys and busy people."""

import random

import duckdb
import pytest

from exposight.plans import catalogue
from exposight.sources import roles


@pytest.fixture
def odd(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(roles, "_MEMBERS", 3)  # several slices of a group
    r, d = random.Random(5), str(tmp_path)
    people = [(k, f"n{k}", r.choice([1, 2, None]), r.choice(["A", "B", None]), 1.0) for k in range(60)]
    people += [(10, "twice", people[10][2], people[10][3], 1.0), (20, "elsewhere", 1, "A", 1.0), (20, "elsewhere", 2, "B", 1.0), (None, "nobody", 1, "A", 1.0)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k,) for k in range(1, 90)] + [(7,)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    orders = [(k, r.choice([*range(60), 10, 20, 30, 30, None])) for k in range(500)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    lines = [(o, n, 1, r.choice([None, 1, 2, 3, *range(90)]), "A", None) for o, _ in orders for n in range(r.randint(0, 4))]
    lines += [(next(k for k, u in orders if u == 30), n, 1, n, "A", None) for n in range(90)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([], "event_id long, user_id long, ts timestamp, event_type string, props string, value double").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["exposure_counts", "exposure_wide_left", "top80_fake_consumers", "cluster_share_per_person", "user_site_pct", "gini_fake_vs_rest"])
def test_odd_people(spark, odd, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, odd)
    got = sorted(str(tuple(r)) for r in df.collect())
    want = sorted(str(r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert got == want and want


@pytest.mark.parametrize("name", ["exposure_counts", "gini_fake_vs_rest"])
def test_no_follow_edges(spark, tmp_path, name):
    """One group of 2,000 people: no step of the plan makes a row for each of its 400,000 follow edges but the result."""
    d, n = str(tmp_path), 2000
    spark.range(n).selectExpr("id c_custkey", "1L c_nationkey", "'A' c_mktsegment", "0D c_acctbal").write.parquet(f"{d}/customer.parquet")
    spark.range(4).selectExpr("id s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(n).selectExpr("id o_orderkey", "id o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(n).selectExpr("id l_orderkey", "1 l_linenumber", "1L l_partkey", "id % 4 l_suppkey", "'A' l_returnflag", "current_timestamp() l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    df = catalogue.queries()[name](spark, d)
    df.collect()
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

    walk(df._jdf.queryExecution().executedPlan())
    assert sizes and max(sizes) < 20_000
