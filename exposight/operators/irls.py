"""Logistic regression by reweighted least squares: Gram matrices are summed in tasks, only k x k numbers reach the driver.

A model is a list of terms over columns: "x", a product "x:y", or a factor's level "f=level" (also within products).
Each term may carry a ridge penalty, which is what a normal prior of variance 1/penalty about 0 comes to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term(name: str) -> Column:
    """The column of a term."""
    out = F.lit(1.0)
    for part in name.split(":") if name != "1" else []:
        column, _, level = part.partition("=")
        out = out * (F.coalesce((F.col(column).cast("string") == level).cast("double"), F.lit(0.0)) if "=" in part else F.col(part).cast("double"))
    return out


def factor_terms(df: DataFrame, column: str, most: int = 100) -> list[str]:
    """Terms of a factor but for its first level, levels in order; more than `most` levels are an error."""
    levels = [r[0] for r in df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has over {most} levels")
    return [f"{column}={x}" for x in levels[1:]]


def design(df: DataFrame, terms: list[str], **more: Column) -> DataFrame:
    """(x: array of the terms' values, and more); rows with a null in any are left out."""
    out = df.select(F.array(*map(term, terms)).alias("x"), *[c.cast("double").alias(k) for k, c in more.items()])
    return out.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).dropna()


def matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def summed(df: DataFrame, k: int, step) -> np.ndarray:
    """The sum over batches of step(x, columns), a vector of numbers: summed in each task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = step(matrix(batch, k), {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "x"})
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    rows = df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # the square of the number of terms
    out = np.zeros(max((r["i"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _chance(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(eta / 2))


@dataclass
class Logit:
    """A fitted model: coefficients by term, their covariance, log likelihood, rows, rounds; settled is false where it did not converge (as with separated classes)."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    rounds: int
    settled: bool

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.terms, self.beta.tolist()))

    def linear(self, offset: Column | None = None) -> Column:
        out = F.lit(0.0) if offset is None else offset
        for t, b in self.coefficients().items():
            out = out + F.lit(float(b)) * term(t)
        return out

    def predict(self, df: DataFrame, name: str = "prediction", offset: Column | None = None) -> DataFrame:
        """df with the fitted chance; null where a term is."""
        return df.withColumn(name, 1 / (1 + F.exp(-self.linear(offset))))

    def save(self, df_or_spark, path: str) -> None:
        """One row of JSON under path, replaced if there."""
        spark = getattr(df_or_spark, "sparkSession", df_or_spark)
        row = json.dumps({"terms": self.terms, "beta": self.beta.tolist(), "cov": self.cov.tolist(), "loglik": self.loglik, "n": self.n, "rounds": self.rounds, "settled": self.settled})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> Logit:
        d = json.loads(spark.read.text(path).first()[0])
        return Logit(d["terms"], np.array(d["beta"]), np.array(d["cov"]), d["loglik"], d["n"], d["rounds"], d["settled"])


def fit(df: DataFrame, label: str, terms: list[str], penalty: float | dict[str, float] = 0.0, weight: str | None = None, offset: str | None = None, rounds: int = 50, tol: float = 1e-11) -> Logit:
    """Logistic regression of label (0 to 1) on terms and an intercept "1", which is not penalised.

    penalty is one number or one by term.  Steps that lower the penalised likelihood are halved.  Rows with a null
    in the label, a term, the weight or the offset are left out; without rows the coefficients are 0.
    """
    names = ["1", *terms]
    k = len(names)
    ridge = np.array([0.0] + [float(penalty.get(t, 0.0) if isinstance(penalty, dict) else penalty) for t in terms])
    data = design(df, names, y=F.col(label), w=F.col(weight) if weight else F.lit(1.0), o=F.col(offset) if offset else F.lit(0.0)).persist()

    def sums(beta: np.ndarray):
        def step(x, c):
            eta = x @ beta + c["o"]
            p = _chance(eta)
            loglik = c["w"] * (c["y"] * eta - np.logaddexp(0, eta))
            return np.concatenate(((x * (c["w"] * p * (1 - p))[:, None]).T.dot(x).ravel(), x.T @ (c["w"] * (c["y"] - p)), [loglik.sum(), len(x)]))

        got = summed(data, k, step)
        if not len(got):
            return np.zeros((k, k)), np.zeros(k), 0.0, 0
        return got[: k * k].reshape(k, k) + np.diag(ridge), got[k * k : k * k + k] - ridge * beta, got[-2] - 0.5 * ridge @ beta**2, int(got[-1])

    try:
        beta = np.zeros(k)
        hess, grad, value, n = sums(beta)
        settled, done = n == 0, 0
        while not settled and done < rounds:
            done += 1
            move = np.linalg.lstsq(hess, grad, rcond=1e-14)[0]
            for _ in range(30):
                new = sums(beta + move)
                if new[2] >= value - 1e-12 * abs(value):
                    break
                move = move / 2
            beta = beta + move
            hess, grad, value, n = new
            settled = float(np.abs(move).max()) <= tol * (1 + float(np.abs(beta).max()))
        return Logit(names, beta, np.linalg.pinv(hess), value + 0.5 * float(ridge @ beta**2), n, done, settled)
    finally:
        data.unpersist()


def marginal_effects(model: Logit, df: DataFrame, grid: dict[str, list], offset: Column | None = None) -> DataFrame:
    """Mean predicted chance at each point of a grid: the grid's columns are set for all rows, the others stay as observed.

    Predictions are summed in the tasks, so only the grid is shuffled.
    """
    points = [{}]
    for column, values in grid.items():
        points = [{**p, column: v} for p in points for v in values]
    kinds = dict(df.dtypes)
    at = F.array(*[F.struct(*[F.lit(p[c]).cast(kinds[c]).alias(c) for c in grid]) for p in points])
    wide = df.withColumn("__at", F.explode(at)).withColumns({c: F.col(f"__at.{c}") for c in grid})
    return model.predict(wide, "__p", offset).groupBy(*grid).agg(F.avg("__p").alias("mean"), F.count("__p").alias("n"))


def correlations(df: DataFrame, terms: list[str]) -> np.ndarray:
    """Correlation matrix of terms, from sums about the means."""
    data, k = design(df, terms), len(terms)
    mean = summed(data, k, lambda x, c: np.append(x.sum(0), len(x)))
    mean = mean[:-1] / mean[-1]
    gram = summed(data, k, lambda x, c: ((x - mean).T @ (x - mean)).ravel()).reshape(k, k)
    sd = np.sqrt(np.diag(gram))
    return gram / np.outer(sd, sd)


def gvif(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """(term, gvif, df, scaled): generalised variance inflation of each block of terms: det(own) det(others) / det(all) of the correlation
    matrix, and its 1/(2 df) power, which compares blocks of different sizes."""
    names = [t for ts in blocks.values() for t in ts]
    r = correlations(df, names)
    log_det = lambda idx: np.linalg.slogdet(r[np.ix_(idx, idx)])[1] if idx else 0.0
    rows, every = [], list(range(len(names)))
    for block, ts in blocks.items():
        own = [names.index(t) for t in ts]
        g = float(np.exp(log_det(own) + log_det([i for i in every if i not in own]) - log_det(every)))
        rows.append((block, g, len(own), g ** (1 / (2 * len(own)))))
    return df.sparkSession.createDataFrame(rows, "term string, gvif double, df int, scaled double")
