"""Cutting-stock packing against the tokenizer itself and against bounds that any packing obeys."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposight.llm import cutting_stock as C
from exposight.llm import pattern_packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 9000), (5, "Don't they've 12½ naïve ÀÉ"), (5, "Don't they've 12½ naïve ÀÉ"), (6, "İstanbul ΣΑΣ é  x y \x1cz"), (7, "<|endoftext|> a <|startoftext|>b"),
    (8, "日本語 привет ﬁ İ ŉ ǆ"), (9, "a's 'sb 're'll ''d _x_ 1a2b"), (None, "no id"), (None, None), (10, "x" * 5000), (11, "\x85a\x0bb\x1fc’s"),
]


def check(rows, capacity, texts, tok, end_id=2):
    """Every id lies in one piece; sequences are gapless, fit, and are not padded."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    want: dict = {}
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    assert {k: len(v) for k, v in want.items()} == {k: sum(r.length for r in v) // k[1] for k, v in by_doc.items()}
    for key, many in want.items():
        if all((x == many[0]).all() for x in many):
            got = sorted((r.start, r.length) for r in by_doc[key])
            for r in by_doc[key]:
                assert zlib.crc32(many[0][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            covered = np.zeros(key[1], int)
            for a, n in got:
                covered[a : a + n] += 1
            assert (covered == len(many)).all()


def test_encoder_equals_tokenizer():
    tok, encode = tokenizer(), P.encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    letters = "abcABC äßŸſ'’stvedmrl 0½²_-.\n\t\x0b\x1c\x85\xa0éİΣ日"
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    texts = TEXTS + [(100 + k, " ".join(rng.choice("the cat sat on mats".split()) for _ in range(rng.choice([3, 7, 7, 7, 31, 60, 200])))) for k in range(150)]
    df = spark.createDataFrame([(i, t, 9, 9, "x") for i, t in texts], "doc_id long, text string, length long, rank long, part string").repartition(5)
    rows = P.pack_by_patterns(df, capacity=capacity, rows=16).collect()
    check(rows, capacity, texts, tokenizer())
    assert P.pack_by_patterns(df.limit(0)).count() == 0
    assert P.pack_by_patterns(df.filter("doc_id = 2")).select("start", "length", "offset").collect() == [(0, 1, 0)]


def test_only_long_alike_documents(spark):
    """No pattern fits: all are cut, and still nothing is padded."""
    texts = [(k, "cat " * 41) for k in range(70)]
    for few in (0, 1000):
        rows = P.pack_by_patterns(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), capacity=64, few_cuts=few).collect()
        check(rows, 64, texts, tokenizer())


def test_table_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(P.pack_by_patterns(docs).collect(), 4096, [tuple(r) for r in docs.collect()], tokenizer())


def test_program_against_enumeration():
    """The least left over equals the best over all patterns found by enumeration (solved by the same simplex, with every pattern at hand)."""
    rng = np.random.default_rng(2)
    for _ in range(8):
        lengths = sorted(rng.choice(np.arange(2, 16), 4, replace=False).tolist())
        histogram = {int(n): int(rng.integers(1, 60)) for n in lengths}
        every, stack = [], [((0,) * 4, 0, 0)]
        while stack:
            p, k, total = stack.pop()
            if k == 4:
                if total in (1, 2, 4, 8, 16):
                    every.append(p)
                continue
            stack += [(p[:k] + (c,) + p[k + 1 :], k + 1, total + c * lengths[k]) for c in range((16 - total) // lengths[k] + 1)]
        n = np.array([histogram[x] for x in lengths], float)
        whole = C.Simplex(np.eye(4), np.array(lengths, float), n)
        if every:
            whole.add(np.array(every, float).T, np.ones(len(every)))
        whole.run()
        best = whole.cost[whole.basis] @ whole.x
        solved = C.solve_block(histogram, 16, gap=0.0)
        placed = sum(x * sum(a * k for a, k in p) for p, x in solved)
        got = float((n * lengths).sum()) - placed + sum(x for _, x in solved)
        assert got <= best * (1 + 1e-3) + 1e-3, (histogram, got, best)


def test_plan_is_whole():
    rng = np.random.default_rng(4)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 512), 200, replace=False), rng.integers(1, 500, 200))}
    histogram[300] = 40_000  # one length holds most tokens
    solved = [x for b in C.deal(histogram, 32) for x in C.solve_block(b, 512)]
    plan = C.round_patterns(histogram, solved, 512)
    for n, c in histogram.items():
        ranges = sorted((e[1], e[2]) for e in plan.whole + plan.stream if e[0] == n)
        assert ranges[0][0] == 0 and ranges[-1][1] == c and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum(n * c for n, c in C.deal(histogram, 32)[0].items()) > 0
    assert plan.streamed == sum(n * (b - a) for n, a, b, _ in plan.stream)


def test_cut():
    for streamed in (1, 100, 1000, 1023, 64 * 5):
        seen: dict = {}
        for place in range(0, streamed, 7):
            n = min(7, streamed - place)
            parts = C.cut(place, n, streamed, 64)
            assert sum(p[1] for p in parts) == n and [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1])
            for _, take, seq, offset in parts:
                seen.setdefault(seq, []).append((offset, take))
        for parts in seen.values():
            total = sum(t for _, t in parts)
            assert sorted(parts)[0][0] == 0 and (total == 64 or total & (total - 1) == 0)


def test_columns(spark):
    out = P.pack_by_patterns(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert dict(out.dtypes) == dict.fromkeys(P.OUT, "bigint") and out.filter(F.col("ids_crc32") < 0).count() == 0
