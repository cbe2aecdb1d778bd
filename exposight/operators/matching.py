"""Matching on a score: each treated unit gets its k nearest controls, none of them twice, the greatest treated score first.

Taken one by one this is an order of choices that decides everything after it.  Here the score line is cut into ranges that
are solved side by side.  A choice can only be upset by a treated unit that comes earlier, so ranges tell each
other which controls they took, a control goes to whoever comes first, and only ranges whose view
changed are solved again.  When no claim changes, every choice is the one the one-by-one order makes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from . import irls
from .ranking import running


def propensity(df: DataFrame, treated: str, terms: list[str], name: str = "score") -> DataFrame:
    """df with the chance of being treated, from a logistic regression on terms."""
    return irls.fit(df, treated, terms).predict(df, name)


class _Free:
    """Free places of a line of n: the nearest at or after a place (n if none), and at or before it (-1 if none)."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down[i + 1] stands for place i

    @staticmethod
    def _find(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    def after(self, i: int) -> int:
        return self._find(self.up, i)

    def before(self, i: int) -> int:
        return self._find(self.down, i + 1) - 1

    def take(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i


def greedy(treated: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> list[list[int]]:
    """For each treated score, in turn, places of its k nearest free controls.  Controls are sorted by (score, id); of equally near ones the least id is taken."""
    n = len(scores)
    first = np.searchsorted(scores, scores, "left") if n else np.zeros(0, int)
    free, out = _Free(n), []
    for s, start in zip(treated.tolist(), np.searchsorted(scores, treated, "left").tolist()):
        got: list[int] = []
        while len(got) < k:
            right, left = free.after(start), free.before(start - 1)
            if left >= 0:
                left = free.after(int(first[left]))  # the least id of that score
            near = [(abs(float(scores[c]) - s), ids[c], c) for c in (left, right) if 0 <= c < n]
            if not near:
                break
            c = min(near)[2]
            free.take(c)
            got.append(c)
        out.append(got)
    return out


def _solve(k: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Claims of one range's treated units on the controls it sees; wider is set where a nearer control could lie beyond them."""
        t = pdf[pdf["own"]].sort_values(["score", "unit"], ascending=[False, True])
        c = pdf[~pdf["own"]].sort_values(["score", "unit"])
        scores, ids = c["score"].to_numpy(float), c["unit"].to_numpy()
        lo, hi = float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0])
        rows = []
        for unit, s, got in zip(t["unit"], t["score"], greedy(t["score"].to_numpy(float), scores, ids, k)):
            far = max((abs(float(scores[x]) - s) for x in got), default=0.0) if len(got) == k else np.inf
            wider = bool(s - far <= lo > -np.inf or s + far >= hi < np.inf)
            rows += [(key[0], unit, float(s), ids[x], wider) for x in got] or [(key[0], unit, float(s), None, wider)]
        out = pd.DataFrame(rows, columns=["range", "unit", "score", "control", "wider"])
        return out.astype({"range": "int32", "unit": "int64", "control": "Int64"})

    return run


def match_nearest(df: DataFrame, unit: str, treated: str, score: str, ratio: int = 5, per: int = 20_000, rounds: int = 200) -> DataFrame:
    """(treated unit, matched unit): the `ratio` nearest controls of each treated unit, without replacement.

    Treated units choose by falling score, then by unit; among equally near controls the least unit is chosen.  A treated
    unit that finds fewer free controls keeps those it found.  Units with a null unit, treatment or score are left
    out; units must not repeat.  A range holds about `per` units.  Raises if claims have not settled after `rounds`.
    """
    spark = df.sparkSession
    base = df.select(F.col(unit).cast("long").alias("unit"), (F.col(treated).cast("int") == 1).alias("is_treated"), F.col(score).cast("double").alias("score")).dropna().filter(~F.isnan("score"))
    placed = running(base, [F.col("score").desc(), F.col("unit")], {"place": F.lit(1)})
    units = keep(placed.withColumn("range", F.floor(F.col("place") / per).cast("int")).drop("place"))
    spans = {r["range"]: (r["lo"], r["hi"], r["t"]) for r in units.groupBy("range").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_if("is_treated").alias("t")).collect()}  # a row for each `per` units
    if not any(t for *_, t in spans.values()):
        return spark.createDataFrame([], "treated_unit long, matched_unit long")
    last = max(spans)
    controls, own = units.filter(~F.col("is_treated")), units.filter("is_treated")
    reach = {r: 1 for r, (_, _, t) in spans.items() if t}
    todo, claims = set(reach), None
    schema = "range int, unit long, score double, control long, wider boolean"
    for _ in range(rounds):
        views, edges = [], []
        for r in todo:  # which ranges' controls go to which; range 0 has the greatest scores
            a, b = max(0, r - reach[r]), min(last, r + reach[r])
            views += [(s, r) for s in range(a, b + 1)]
            edges.append((r, -np.inf if b == last else spans[b][0], np.inf if a == 0 else spans[a][1]))
        view = spark.createDataFrame(views, "range int, to int")
        edge = spark.createDataFrame([(r, float(lo), float(hi)) for r, lo, hi in edges], "to int, lo double, hi double")
        seen = controls.join(F.broadcast(view), "range").select("to", "unit", "score")  # a row for each pair of ranges in reach
        if claims is not None:  # a control that an earlier range claims is not there
            owner = claims.filter("control is not null").groupBy(F.col("control").alias("unit")).agg(F.min("range").alias("by"))
            seen = seen.join(owner, "unit", "left").filter(F.col("by").isNull() | (F.col("by") >= F.col("to"))).drop("by")
        mine = own.join(F.broadcast(view.filter("range = to")), "range").select("to", "unit", "score", F.lit(True).alias("own"))
        both = mine.unionByName(seen.withColumn("own", F.lit(False))).join(F.broadcast(edge), "to")
        new = keep(both.groupBy("to").applyInPandas(_solve(ratio), schema))
        old, claims = claims, new if claims is None else keep(claims.filter(~F.col("range").isin(sorted(todo))).unionByName(new))
        wide = {r["range"] for r in new.filter("wider").select("range").distinct().collect()}
        changed = _changed(old, claims)
        again = {r for r in wide if reach[r] <= last}
        for r in again:
            reach[r] *= 2
        todo = {r for r in reach if r in again or any(c < r for c in changed)}
        if not todo:
            pairs = claims.filter("control is not null").select(F.col("unit").alias("treated_unit"), F.col("control").alias("matched_unit"))
            return pairs
    raise RuntimeError(f"claims have not settled after {rounds} rounds")


def _changed(old: DataFrame | None, new: DataFrame) -> set[int]:
    """Ranges whose claims are not what they were."""
    have = new.filter("control is not null").select("range", "control")
    if old is None:
        return {r["range"] for r in have.select("range").distinct().collect()}
    had = old.filter("control is not null").select("range", "control")
    diff = have.withColumn("d", F.lit(1)).unionByName(had.withColumn("d", F.lit(-1))).groupBy("range", "control").agg(F.sum("d").alias("d")).filter("d <> 0")
    return {r["range"] for r in diff.select("range").distinct().collect()}


def matched_ginis(values: DataFrame, unit: str, person: str, value: Column, chosen: DataFrame, n: int, replicates: int) -> DataFrame:
    """(rep, gini, n): concentration over people of what `n` random units of `chosen`, drawn by hash in each replicate, bring them."""
    from .sampling import random_units
    from .stats import gini

    drawn = random_units(chosen, unit, n, replicates)
    per = values.join(F.broadcast(drawn) if n * replicates <= 1_000_000 else drawn, unit).groupBy("rep", person).agg(F.sum(value).alias("v"))
    return gini(per, "v", ["rep"], person)
