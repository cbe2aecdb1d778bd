"""Toxicity: noisy-channel deobfuscation, then a logistic model over the restored words.

A token that looks disguised (digits or symbols among letters, letters three times in a row, letters apart)
becomes a lattice: each character stands for the letters it may mean, or for nothing.  Viterbi decoding
under a character trigram model picks the likeliest reading.  Words, their prefixes and the restored
readings are then features of a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import materialize, tidy

# Letters that digits and symbols stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
# Marks put between letters.
MARKS = set(".-_*~'`^,:;/\\#")
PREFIXES = (3, 4, 5, 6)
_EDGE = re.compile(r"^[^\w@$€£]+|[^\w]+$")
_WORD = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
CACHE = 200_000


class CharModel:
    """Interpolated character trigrams of words, ^ before and $ after."""

    def __init__(self, counts: dict[str, float]):
        self.tri, bi, uni = counts, defaultdict(float), defaultdict(float)
        self.ctx = defaultdict(float)
        for g, c in counts.items():
            self.ctx[g[:2]] += c
            bi[g[1:]] += c
            uni[g[2]] += c
        self.bi, self.uni = bi, uni
        self.bctx = defaultdict(float)
        for g, c in bi.items():
            self.bctx[g[0]] += c
        self.total = sum(uni.values()) or 1.0
        self.memo: dict[str, float] = {}

    def logp(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if key not in self.memo:
            if len(self.memo) > CACHE:
                self.memo.clear()
            p1 = (self.uni.get(c, 0.0) + 0.5) / (self.total + 64)
            p2 = self.bi.get(b + c, 0.0) / self.bctx[b] if self.bctx.get(b) else p1
            p3 = self.tri.get(key, 0.0) / self.ctx[a + b] if self.ctx.get(a + b) else p2
            self.memo[key] = math.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1)
        return self.memo[key]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for ("" is nothing) and the channel's cost of that."""
    out, run = [], 0
    for i, ch in enumerate(token):
        run = run + 1 if i and ch == token[i - 1] else 1
        inner = 0 < i < len(token) - 1
        if ch.isalpha():
            options = [(ch, 0.0)]
            if run > 1:
                options = [(ch, 2.0 if run > 2 else 0.7), ("", 0.2)]
        elif ch in LEET:
            options = [(x, 0.5) for x in LEET[ch]]
            if run > 1 or not inner:
                options.append(("", 0.5))
        else:
            options = [("", 0.3)]
            if ch in "*#" and inner:
                options += [(x, 2.0) for x in "aeiou"]
        out.append(options)
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a token.  States are the last two letters read."""
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    per = 2.5  # a letter's usual cost: keeps readings of different lengths comparable
    for options in lattice(token):
        step: dict[str, tuple[float, str]] = {}
        for state, (score, read) in best.items():
            for x, cost in options:
                s = score - cost + (model.logp(state[0], state[1], x) + per if x else 0.0)
                to = state[1] + x if x else state
                if to not in step or s > step[to][0]:
                    step[to] = s, read + x
        best = step
    return max(((s + model.logp(st[0], st[1], "$"), r) for st, (s, r) in best.items()), default=(0.0, ""))[1]


def disguised(token: str) -> bool:
    """Whether a token (edges stripped) has a letter and a sign that may hide another, or a letter three times."""
    if token.isalpha():
        return bool(_THRICE.search(token))
    return any(c.isalpha() for c in token) and any(c in LEET or c in MARKS for c in token) or bool(_THRICE.search(token))


def spaced(tokens: list[str]) -> Iterator[str]:
    """Runs of three or more tokens of one letter or sign each, joined."""
    run: list[str] = []
    for t in tokens:
        if len(t) == 1 and (t.isalpha() or t in LEET and t != "|"):
            run.append(t)
            continue
        if len(run) >= 3:
            yield "".join(run)
        run = []
    if len(run) >= 3:
        yield "".join(run)


def features(word: str) -> Iterator[str]:
    """A word and its prefixes."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "~"


class Reader:
    """text -> indices of the features it has."""

    def __init__(self, index: dict[str, int], model: CharModel | None):
        self.index, self.model, self.cache = index, model, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        get = self.index.get
        return tuple(i for f in features(word) if (i := get(f)) is not None)

    def of_token(self, raw: str) -> tuple[int, ...]:
        token = raw if raw.isalpha() else _EDGE.sub("", raw)
        found = [i for w in ((token,) if token.isalpha() else _WORD.findall(token)) for i in self.of_word(w)]
        if self.model is not None and token and disguised(token):
            for form in {token, raw.strip(".,;:?\"'")}:
                found += self.of_word(decode(form, self.model))
        return tuple(found)

    def __call__(self, text: str | None) -> set[int]:
        tokens = (text or "").lower().split()
        out: set[int] = set()
        cache = self.cache
        for t in set(tokens):
            f = cache.get(t)
            if f is None:
                if len(cache) >= CACHE:
                    cache.clear()
                f = cache[t] = self.of_token(t)
            if f:
                out.update(f)
        if self.model is not None:
            for run in spaced(tokens):
                word = decode(run, self.model)
                out.update(self.of_word(word))
                for k in range(len(word) - 2):  # several words may have been spaced out together
                    for n in range(3, 16):
                        if word[k : k + n] in self.index:
                            out.update(self.of_word(word[k : k + n]))
        return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature the rows that have it, by label; for each character trigram its count."""
    made: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        pos, neg, tri, seen = Counter(), Counter(), Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) <= 40}
            seen.update(words)
            for w in words:
                if w not in made:
                    made[w] = tuple(features(w))
            (pos if y else neg).update(set().union(*[made[w] for w in words]))
        for w, n in seen.items():
            if len(w) > 2:
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    tri[w[i : i + 3]] += n
        if len(made) > CACHE:
            made.clear()
        keys = list({*pos, *neg})
        yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * len(keys) + [1] * len(tri), pa.int32()), "f": keys + list(tri), "pos": pa.array([pos[k] for k in keys] + list(tri.values()), pa.int64()), "neg": pa.array([neg[k] for k in keys] + [0] * len(tri), pa.int64())})


def _logistic(rows: DataFrame, width: int, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over sparse 0/1 features of rows(y, x, n), x their indices as text, by Spark ML."""
    n = rows.agg(F.sum("n")).first()[0]
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], inputCol="x", outputCol="v").setBinary(True).transform(rows)
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="n", regParam=ridge / n, maxIter=60, standardization=False).fit(vectors.select("v", F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n")))
    return model.coefficients.toArray(), float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", width: int = 2048, trigrams: int = 50_000, least: int = 5, lift: float = 8.0) -> dict:
    """A model from all labelled documents.

    width bounds the features, trigrams the character model.  A feature needs `least` toxic documents and must be
    `lift` times as frequent in toxic as in other ones.  Labels that are null, or of unknown documents, are ignored;
    an id with several labels has the greatest.  Without labels of both kinds the score is a constant.  Documents with the
    same features and label are one weighted row of the regression, which runs on the executors.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id")  # two numbers for each label, so that texts are not shuffled
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = totals.get(1, 0), sum(c for y, c in totals.items() if y != 1)
    if not n_pos or not n_neg:
        return {"index": {}, "weights": np.zeros(0), "bias": 4.0 if n_pos else -4.0, "tri": {}}
    counts = rows.select("text", "y").mapInArrow(tidy(_count_features), "kind int, f string, pos long, neg long").groupBy("kind", "f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = materialize(counts.filter(f"kind = 1 or pos >= {least}"), "features")
    tri_rows = counts.filter("kind = 1").orderBy(F.desc("pos"), "f").limit(trigrams)
    rate = (F.col("pos") / n_pos) / ((F.col("neg") + 1) / n_neg)
    feats = counts.filter("kind = 0").filter(rate >= lift).orderBy(F.desc(F.col("pos") - F.col("neg") * n_pos / n_neg), "f").limit(width)
    picked = [r["f"] for r in feats.collect()]
    tri = Counter({r["f"]: float(r["pos"]) for r in tri_rows.collect()})
    boost = max(10.0, sum(tri.values()) / 5000)
    for f in picked:  # words that decide must be readings the decoder finds likely
        if not f.endswith("~"):
            w = f"^^{f}$"
            for i in range(len(w) - 2):
                tri[w[i : i + 3]] += boost
    index = {f: i for i, f in enumerate(picked)}
    if not picked:
        return {"index": {}, "weights": np.zeros(0), "bias": math.log(n_pos / n_neg), "tri": dict(tri)}
    shared = spark.sparkContext.broadcast((index, dict(tri)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value[0], CharModel(shared.value[1]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array([list(map(str, sorted(read(t)))) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], names=["y", "x"])

    got = rows.select("text", "y").mapInArrow(tidy(vectors), "y int, x array<string>").groupBy("y", "x").agg(F.count("*").alias("n"))
    weights, bias = _logistic(materialize(got.select(F.when(F.col("y") == 1, 1).otherwise(0).alias("y"), "x", "n"), "vectors"), len(picked))
    return {"index": index, "weights": weights, "bias": bias, "tri": dict(tri)}


def score(df: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col, 0 to 1, from the whole text (null: empty).  A column so named is replaced; all rows stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema if f.name != score_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        read, w = Reader(m["index"], CharModel(m["tri"])), m["weights"]
        for batch in batches:
            out = [1 / (1 + math.exp(-max(-30.0, min(30.0, m["bias"] + float(w[sorted(read(t))].sum()))))) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, score_col])

    return df.select(*[F.col(f"`{n}`") for n in names], F.col(text_col).alias("__text")).mapInArrow(tidy(run), T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))
