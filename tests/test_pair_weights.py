"""Weights that come with the pairs against sums over all pairs, and rows that are not shuffled to find their block."""

import random

import pytest

from exposight.operators import graph, relational


@pytest.mark.parametrize("pairs, per, kind", [(100_000_000, 4096, "long"), (100_000_000, 7, "long"), (300, 7, "long"), (100_000_000, 7, "string")])
def test_weights_come_with_pairs(spark, monkeypatch, pairs, per, kind):
    monkeypatch.setattr(relational, "_PAIRS", pairs)
    r = random.Random(4)
    rows = [(r.randrange(30), r.choice([None, *range(25), 1, 2, 3])) for _ in range(300)] + [(None, 3), (31, 99)]
    df = spark.createDataFrame(rows, "p long, s long").withColumn("s", graph.F.col("s").cast(kind))
    plain = graph.backbone(graph.keep(relational.pair_counts(df, "p", "s", per)))
    with_weights = graph.backbone(relational.pair_counts(df, "p", "s", per, both=False, weights=True))
    cols = ["i", "j", "x", "w_i", "w_j", "q", "p"]
    got = {tuple(x) for x in with_weights.select(cols).collect()}
    assert got == {tuple(x) for x in plain.select(cols).collect()} and len(got) > 250
    both = relational.pair_counts(df, "p", "s", per, weights=True).select("i", "j", "w_i", "w_j").collect()
    assert {(x.j, x.i, x.w_j, x.w_i) for x in both} == {tuple(x) for x in both}


def test_rows_are_gathered_once(spark, monkeypatch):
    """Before lists go to their tiles one table is written that has a row for each person; none has one for each share."""
    written, real = [], relational.keep
    monkeypatch.setattr(relational, "keep", lambda df: written.append(real(df).count()) or real(df))
    df = spark.range(4000).selectExpr("id % 40 p", "cast(id / 40 as long) s")
    assert {x.x for x in relational.pair_counts(df, "p", "s", both=False).collect()} == {40}
    assert max(written) == 100 and 40 in written  # 100 sites, 40 people, 4,000 shares
