"""Classifiers and regressions: Bernoulli naive Bayes as SQL, and models of Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, RFormula, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import keep


def vocabulary(tokens: DataFrame, doc: str, word: str, low: float = 1 / 5000, high: float = 0.9) -> DataFrame:
    """(word, docs): words in a share of documents between low and high."""
    pairs = tokens.select(doc, word).distinct()
    n = tokens.select(doc).distinct().agg(F.count("*").alias("__n"))
    return pairs.groupBy(word).agg(F.count("*").alias("docs")).join(F.broadcast(n)).filter((F.col("docs") >= low * F.col("__n")) & (F.col("docs") <= high * F.col("__n"))).select(word, "docs")


def naive_bayes_scores(tokens: DataFrame, labels: DataFrame, doc: str, word: str, label: str) -> DataFrame:
    """(doc, llr): log likelihood ratio of a Bernoulli model with Laplace smoothing, over the vocabulary.

    Absent words count too; their sum is a constant plus a correction for each present word, so each document only
    meets its own words.
    """
    pairs = tokens.select(doc, word).distinct()
    n = F.broadcast(labels.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")))
    counts = pairs.join(labels.select(doc, label), doc).groupBy(word).agg(F.count_if(F.col(label) == 1).alias("c1"), F.count_if(F.col(label) == 0).alias("c0"))
    p1, p0 = (F.col("c1") + 1) / (F.col("n1") + 2), (F.col("c0") + 1) / (F.col("n0") + 2)
    w = counts.join(n).select(word, (F.ln(p1) - F.ln(p0)).alias("present"), (F.ln(1 - p1) - F.ln(1 - p0)).alias("absent"), (F.ln("n1") - F.ln("n0")).alias("prior"))
    base = F.broadcast(w.agg((F.sum("absent") + F.first("prior")).alias("base")))
    own = pairs.join(w, word).groupBy(doc).agg(F.sum(F.col("present") - F.col("absent")).alias("s"))
    return tokens.select(doc).distinct().join(own, doc, "left").join(base).select(doc, (F.coalesce("s", F.lit(0.0)) + F.col("base")).alias("llr"))


def naive_bayes_sets(sets: DataFrame, labels: DataFrame, doc: str, words: str, label: str, least: int = 1) -> DataFrame:
    """(doc, llr) as naive_bayes_scores gives, from one row for each document with its distinct words; words in fewer than `least` documents are left out.

    The labels meet the documents and not their words, and a document's sum is begun where its words are, so pairs are shuffled
    only where the vocabulary is too large for Spark to broadcast.
    """
    both = labels.select(doc, label).groupBy(doc).agg(F.count_if(F.col(label) == 1).alias("l1"), F.count_if(F.col(label) == 0).alias("l0"))
    known = keep(sets.select(doc, words).join(both, doc, "left").fillna(0, ["l1", "l0"]))
    n = F.broadcast(labels.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")))
    counts = known.select("l1", "l0", F.explode(words).alias("word")).groupBy("word").agg(F.sum("l1").alias("c1"), F.sum("l0").alias("c0"), F.count("*").alias("k"))
    p1, p0 = (F.col("c1") + 1) / (F.col("n1") + 2), (F.col("c0") + 1) / (F.col("n0") + 2)
    w = counts.filter((F.col("k") >= least) & (F.col("c1") + F.col("c0") > 0)).join(n)
    w = keep(w.select("word", (F.ln(p1) - F.ln(p0)).alias("present"), (F.ln(1 - p1) - F.ln(1 - p0)).alias("absent"), (F.ln("n1") - F.ln("n0")).alias("prior")))
    often = keep(counts.filter((F.col("k") >= least) & (F.col("c1") + F.col("c0") == 0)).select("word", F.lit(0.0).alias("s")))  # words of unlabelled documents only: they say nothing, but their documents have a row
    base = F.broadcast(w.agg((F.sum("absent") + F.first("prior")).alias("base")))
    weight = w.select("word", (F.col("present") - F.col("absent")).alias("s")).unionByName(often)
    own = known.select(doc, F.explode(words).alias("word")).join(weight, "word").groupBy(doc).agg(F.sum("s").alias("s"))
    return own.join(base).select(doc, (F.col("s") + F.col("base")).alias("llr"))


def lasso_text(df: DataFrame, words: str, label: str, min_df: float = 2.0, reg: tuple[float, ...] = (0.001, 0.01), folds: int = 3, seed: int = 1):
    """A fitted pipeline: document-term matrix and logistic regression with an L1 penalty, chosen by cross-validation."""
    lr = LogisticRegression(labelCol=label, elasticNetParam=1.0, maxIter=30)
    vec = CountVectorizer(inputCol=words, outputCol="features", minDF=min_df, maxDF=0.9, binary=True)
    data = vec.fit(df)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(reg)).build(), evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed)
    return data, cv.fit(data.transform(df).select("features", label)).bestModel


def score_and_override(scored: DataFrame, score: str, known: str, least: float = 0.8) -> DataFrame:
    """Known positives score 1; rows of at least `least` stay."""
    return scored.withColumn(score, F.when(F.col(known) == 1, F.lit(1.0)).otherwise(F.col(score))).filter(F.col(score) >= least)


def ridge_logit(df: DataFrame, features: list[str], label: str, offset: str | None = None, reg: float = 0.01):
    """Binomial regression with a ridge penalty and an optional offset."""
    glr = GeneralizedLinearRegression(family="binomial", labelCol=label, regParam=reg, **({"offsetCol": offset} if offset else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), glr]).fit(df)


def alignment(fitted, df: DataFrame, offset: str | None = None) -> DataFrame:
    """score = 2p - 1, predicted with an offset of 0."""
    ready = df.withColumn(offset, F.lit(0.0)) if offset else df
    return fitted.transform(ready).withColumn("score", 2 * F.col("prediction") - 1)


def quasi_binomial(df: DataFrame, formula: str, trials: str) -> dict:
    """Coefficients, AIC, BIC and dispersion (Pearson chi-square by degrees of freedom) of a binomial model of proportions."""
    ready = RFormula(formula=formula).fit(df).transform(df)
    model = GeneralizedLinearRegression(family="binomial", weightCol=trials).fit(ready)
    pearson = model.transform(ready).agg(F.sum(F.col(trials) * (F.col("label") - F.col("prediction")) ** 2 / (F.col("prediction") * (1 - F.col("prediction"))))).first()[0]
    n, k, s = ready.count(), len(model.coefficients) + 1, model.summary
    import math

    return {"coefficients": [float(model.intercept), *map(float, model.coefficients)], "aic": s.aic, "bic": s.aic + k * (math.log(n) - 2), "dispersion": pearson / (n - k)}


def vif(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    import numpy as np
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(VectorAssembler(inputCols=features, outputCol="features").transform(df).select("features"), "features").first()[0].toArray()
    return dict(zip(features, np.diag(np.linalg.inv(m)).tolist()))


def effect_curve(fitted, df: DataFrame, vary: str, points: list[float], features: list[str]) -> DataFrame:
    """Predictions over a grid of one feature, the others at their medians."""
    med = df.agg(*[F.median(c).alias(c) for c in features if c != vary])
    grid = df.sparkSession.createDataFrame([(float(x),) for x in points], f"{vary} double")
    return fitted.transform(grid.join(F.broadcast(med))).select(vary, "prediction")
