"""Readers and writers give back what was written."""

import pytest

from exposight.sources import files

ROWS = [(1, "a b", None), (2, 'say "x"', "2020"), (3, "back\\slash", "y")]
SCHEMA = "id long, t string, u string"


@pytest.mark.parametrize("gzip", [False, True])
def test_tsv_round_trip(spark, tmp_path, gzip):
    path = f"file://{tmp_path}/t"
    files.write_tsv(spark.createDataFrame(ROWS, SCHEMA), path, gzip=gzip)
    assert sorted(map(tuple, files.read_tsv(spark, path, SCHEMA, 3).collect())) == ROWS


def test_raw_and_quoted_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tname\tplace\n1\t"q"\t\n2\tx\n')
    raw = files.read_raw_tsv(spark, f"file://{tmp_path}/a.tsv", ["id", "name", "place"]).collect()
    assert [tuple(r) for r in raw] == [("1", '"q"', ""), ("2", "x", "")]
    got = files.read_quoted_tsv(spark, f"file://{tmp_path}/a.tsv", ["id", "name", "place"], from_id=0).collect()
    assert got[0]["name"] == "q" and len(files.read_quoted_tsv(spark, f"file://{tmp_path}/a.tsv", ["id", "name", "place"], from_id=1).collect()) == 1


def test_json_lines_words_and_days(spark, tmp_path):
    (tmp_path / "j").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in files.read_json_lines(spark, f"file://{tmp_path}/j", "a long, b string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "w").write_text("Coeur d'Alene  \n\nBoise\n")
    assert {r["word"] for r in files.read_word_list(spark, f"file://{tmp_path}/w").collect()} == {"coeur d'alene", "coeur dalene", "boise"}
    days = f"file://{tmp_path}/days"
    for rows in ([(1, "d1"), (2, "d2")], [(3, "d2")]):
        files.write_daily(spark.createDataFrame(rows, "id long, ds string"), days)
    assert sorted((r["id"], str(r["ds"])) for r in spark.read.parquet(days).collect()) == [(1, "d1"), (3, "d2")]


def test_p_value(spark):
    import math

    from pyspark.sql import functions as F

    from exposight.operators.tails import chi_square

    p = spark.range(1).select(chi_square(F.lit(3.841458820694124), F.lit(1)).alias("p")).first()["p"]
    assert math.isclose(p, 0.05, rel_tol=1e-9)
