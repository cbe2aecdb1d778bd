"""Resampling against a plain version in Python."""

import hashlib
import math
import random
import re
import zlib

import pytest

from exposight.llm import resampling as R

SCHEMA = "doc_id long, text string, word string, bucket long, score string, uid string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "w", 3, None, "u") for i, t in texts], SCHEMA)


def features(text, order):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(docs, goal, order, buckets, least, share, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, goal)):
        for x in texts:
            for f in features(x, order)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x, order)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share * len(fit) // 100]):
        r[5] = k + 1
    return out


EDGE = [(1, None), (2, ""), (3, " ...\n"), (4, "Ünï Ćode ßtraße 日本 a_b-c'd 12x " * 9), (None, "no id but words " * 8), (None, None), (5, "wörd " * 30_000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    rng = random.Random(order)
    words = "The a tree of words, and Numbers 12 für das Haus".split()
    docs = EDGE + [(10 + k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 19, 20, 40])))) for k in range(120)]
    docs += [(500, "same text again " * 9)] * 40  # rows that repeat an id tie
    goal = ["Haus und tree of words", None, "", "words"]
    target = spark.createDataFrame([(x, 1) for x in goal], "text string, bucket int")
    got = R.resample(frame(spark, docs).repartition(6), target, order=order, buckets=97, least_words=20, share=30).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute(docs, goal, order, 97, 20, 30)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    assert R.resample(frame(spark, []).limit(0), none).count() == 0
    got = R.resample(frame(spark, EDGE), none, share=100).collect()
    assert sorted(map(str, (list(r) for r in got))) == sorted(map(str, brute(EDGE, [], 1, 10_000, 20, 100)))
    assert {r.rank for r in R.resample(frame(spark, EDGE), none, share=0).collect()} == {None}
