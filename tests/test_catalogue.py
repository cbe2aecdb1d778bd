"""Every query with SQL gives DuckDB's rows over the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from exposight.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df, cols):
    clean = lambda v: None if pd.isna(v) else bool(v) if type(v).__name__.startswith("bool") else v if isinstance(v, str) else round(float(v), 5) if isinstance(v, (int, float)) else v
    return sorted((tuple(str(clean(v)) for v in r) for r in df[cols].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) & set(catalogue.queries())))
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", ["url_clean", "page_title_links", "location_classify", "handle_align", "linkage_e2e", "post_links", "post_texts", "bootstrap_mean_ci", "changepoints_pelt", "propensity_match"])
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "n", "rank", "cumperc"]
