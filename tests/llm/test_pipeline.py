"""Each stage of the pipeline against brute force on its own input, and the whole of it."""

import numpy as np
import pytest

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, leaks string, kept boolean, id long"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall trees beside a river"
FOOTER = "All rights reserved by the makers of this page"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    out = lower(text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def lines_left(rows):
    """doc_id and text without the lines that a smaller doc_id holds."""
    key = lambda x: lower(x.strip(" \t\n\r\x0b\x0c"))
    holders: dict[str, set] = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if i is None or min(holders.get(key(x), {i})) == i)) for i, t in rows]


def copies(rows):
    """Ids that are alike to 0.8, by links, with a smaller id."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i for i, r in root.items() if r != i}


@pytest.fixture(scope="module")
def corpus():
    """Rows and the ids planted as toxic and as leaks; among them near copies, excerpts, repeats, nulls and long texts."""
    rng = np.random.default_rng(12)
    clean = [f"{a}{b}" for a in ("man", "tor", "lin", "pel", "sor", "gam", "huv") for b in ("da", "vi", "ko", "ste", "ru", "ne")]
    rows, toxic = [], set()
    for i in range(200):
        w = list(rng.choice(clean, 60))
        if i % 4 == 0:
            w[int(rng.integers(60))] = str(rng.choice(["idiot", "loser", "trash"]))
            toxic.add(i)
        rows.append((i, " ".join(w)))
    for k, i in enumerate((1, 2, 3, 5, 6, 7)):  # near copies, then excerpts
        w = rows[i][1].split(" ")
        rows.append((300 + k, " ".join(w[:-1] + ["end"])))
        rows.append((310 + k, " ".join(w[:30])))
    rows += [(400 + k, f"{' '.join(rng.choice(clean, 20))}\n{'  ' * k}{FOOTER.upper() if k % 2 else FOOTER}\nshort") for k in range(6)]
    leaks = {500, 501}
    rows += [(500, f"{' '.join(rng.choice(clean, 20))} {PASSAGE}"), (501, f"{PASSAGE.replace('lazy', 'tired')} {' '.join(rng.choice(clean, 9))}")]
    rows += [(600, None), (601, ""), (602, "  \n "), (603, "manda " * 5_000), (604, "one two"), (604, "one two"), (None, rows[1][1]), (None, None)]
    return rows, toxic, leaks


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rows, toxic, _ = corpus
    table = [(i, t, None, "a" if i else None, None if t is None else len(t), 0.5, "x", None, 1) for i, t in rows]
    spark.createDataFrame(table, DOC).write.parquet(f"{path}/documents.parquet")
    labels = [(i, None, int(i in toxic)) for i in range(200)] + [(None, 1, 1), (400, 1, None), (9999, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def test_stages(spark, corpus, folder, tmp_path):
    rows, toxic, leaks = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pairs(docs)
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == names
            after = pairs(out)
        if name == "toxicity":
            assert same(after, [r for r in before if r[0] not in toxic])
        elif name == "line dedup":
            assert same(after, lines_left(before)) and not same(after, before)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
        elif name == "near duplicates":
            gone = copies(before)
            assert {300, 301, 302, 303, 304, 305} <= gone and not gone & set(range(310, 316))
            assert same(after, [r for r in before if r[0] not in gone])
        elif name == "decontamination":
            assert same(after, [r for r in before if r[0] not in leaks])
        else:
            assert sorted({(r["doc_id"] is None, r["doc_id"]) for r in out.collect()}, key=repr) == sorted({(i is None, i) for i, _ in before}, key=repr)
            assert out.filter("length > 1024 or offset + length > 1024").count() == 0
        docs = out
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == docs.columns
    facts = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert same(whole.select(facts).collect(), docs.select(facts).collect())


def test_empty_tables_and_no_count_of_characters(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{t}.parquet").limit(0)
        (df.drop("n_chars") if t == "documents" else df).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
