"""Packing by cutting-stock patterns: documents whole wherever a pattern without padding holds them, cut where none does.

Texts become token ids once and are written with their ids.  Documents longer than the capacity give full sequences and a
rest; the histogram of rests is all that the plan is made from, so the plan's size depends on the capacity
alone.  Pieces then find their places by their rank among pieces of their length: the rank in their own
task plus what earlier tasks hold, so no task gathers a length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cutting_stock
from ._spark import materialize, tidy

#: A task's share of text that goes through Python at a time.
CHUNK = 1 << 21
_SPACE = r" \t\n\v\f\r"
#: Characters on which all Unicode tables agree and that no normalisation changes: Latin letters in one code point and common signs.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ſ–—‘-„…]")
_PLAIN_LETTERS, _PLAIN_DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_PLAIN_LETTERS}]+|[{_PLAIN_DIGITS}]|[^{_SPACE}{_PLAIN_LETTERS}{_PLAIN_DIGITS}]+")
_BYTE_CHARS = [b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else 0 for b in range(256)]


class Pieces(dict):
    """Ids of a word as bytes, looked up or made by the model and remembered; at most `most` words are kept."""

    def __init__(self, model, most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most
        spare = iter(range(256, 512))
        self.chars = [chr(b) if _BYTE_CHARS[b] else chr(next(spare)) for b in range(256)]  # byte-level alphabet: printable bytes as they are

    def __missing__(self, word: str) -> bytes:
        chars = self.chars
        ids = np.array([t.id for t in self.model.tokenize("".join([chars[b] for b in word.encode()]))], "<u4").tobytes()
        if len(self) < self.most:
            self[word] = ids
        return ids


_cache: dict[str, Callable[[str], bytes]] = {}


def encoder(tokenizer: str) -> Callable[[str], bytes]:
    """A function from a text to its ids (little-endian 32 bits), the same as the tokenizer's own.

    A tokenizer that lower-cases, drops white space and encodes words by themselves is run word by word with a memory of
    words; texts with characters whose handling is not plain, and other tokenizers, go through the tokenizer whole.
    """
    if tokenizer in _cache:
        return _cache[tokenizer]
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer)
    whole = lambda text: np.array(made.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    part = lambda x: json.loads(x.__getstate__()) if x is not None else {}
    steps = [x.get("type") for x in part(made.normalizer).get("normalizers", [])]
    split = part(made.pre_tokenizer).get("pretokenizers", [])
    by_word = (
        steps == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and type(made.model).__name__ == "BPE"
        and not made.model.dropout
    )
    if by_word:
        special = [t.content for t in made.get_added_tokens_decoder().values()]
        get, odd, words = Pieces(made.model).__getitem__, _PLAIN.search, _PLAIN_WORDS.findall

        def encode(text: str) -> bytes:
            if odd(text) or any(s in text for s in special):
                return whole(text)
            return b"".join(map(get, words(text.lower())))
    else:
        encode = whole
    _cache[tokenizer] = encode
    return encode


def token_rows(tokenizer: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, text) -> a row for each full sequence of a long document and for each rest, with its rank in the task among rests of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity, np.int64)
        end, row = np.array([end_id], "<u4").tobytes(), 0
        names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids"]
        out: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array([part] * len(out[0]), pa.int32()), *(pa.array(x, t) for x, t in zip(out, types))], names=["part", *names])
            for x in out:
                x.clear()
            return batch

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("id"), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length, rank = len(piece) // 4, None
                    if length < capacity:
                        rank = int(seen[length])
                        seen[length] += 1
                    for column, value in zip(out, (doc.as_py(), row, start, length, zlib.crc32(piece), tokens, rank, piece if length < capacity else None)):
                        column.append(value)
                    row += 1
                    size += len(piece)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if out[0]:
            yield flush()

    return run


def plan_lengths(rests: DataFrame, capacity: int, rows: int) -> cutting_stock.Plan:
    """The plan for rests(length): blocks of the histogram, at most `capacity` rows, are solved in tasks."""
    spark = rests.sparkSession
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = cutting_stock.deal(histogram, rows)
    if not blocks:
        return cutting_stock.Plan()

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        found = cutting_stock.solve_block(dict(zip(block["length"].tolist(), block["n"].tolist())), capacity)
        lists = [pd.Series([[x[k] for x in p] for p, _ in found], dtype=object) for k in (0, 1)]
        return pd.DataFrame({"lengths": lists[0], "counts": lists[1], "often": pd.Series([x for _, x in found], dtype=float)})

    dealt = spark.createDataFrame([(b, n, c) for b, block in enumerate(blocks) for n, c in block.items()], "block int, length long, n long")
    solved = dealt.repartition(len(blocks), "block").groupBy("block").applyInPandas(solve, "lengths array<long>, counts array<long>, often double").collect()
    patterns = sorted((tuple(zip(r["lengths"], r["counts"])), r["often"]) for r in solved)
    return cutting_stock.round_patterns(histogram, patterns, capacity)


def places(plan: cutting_stock.Plan, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rests with rank (over all tasks) -> their places; a row for each part of a piece that is cut, without its checksum."""
    far = 1 << 48
    whole = sorted((n * far + r0, r0, seq, each, offset) for n, r0, _, seq, each, offset in plan.whole)
    stream = [(n * far + r0, r0, at, 0, -1) for n, r0, _, at in plan.stream]
    table = np.array(sorted(whole + stream), np.int64).reshape(-1, 5)
    base, streamed = plan.sequences, plan.streamed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            found = table[np.searchsorted(table[:, 0], length * far + rank, "right") - 1]
            local, each = rank - found[:, 1], found[:, 3]
            cut = each == 0
            one = np.maximum(each, 1)
            seq, offset = found[:, 2] + local // one, found[:, 4] + local % one * length
            take, begin, size = [np.flatnonzero(~cut)], [np.zeros((~cut).sum(), np.int64)], [length[~cut]]
            seqs, offsets = [seq[~cut]], [offset[~cut]]
            parts = [(i, *p) for i in np.flatnonzero(cut).tolist() for p in cutting_stock.cut(int(found[i, 2] + local[i] * length[i]), int(length[i]), streamed, capacity)]
            if parts:
                i, a, n, s, o = np.array(parts, np.int64).T
                for column, value in zip((take, begin, size, seqs, offsets), (i, a, n, s + base, o)):
                    column.append(value)
            take, begin, size, seqs, offsets = map(np.concatenate, (take, begin, size, seqs, offsets))
            rows = batch.take(pa.array(take))
            crc = rows.column("ids_crc32").to_numpy()
            crc = pa.array(crc, mask=size != rows.column("length").to_numpy())
            start = pa.array(rows.column("start").to_numpy() + begin)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("part"), rows.column("row"), start, pa.array(begin), pa.array(size), crc, rows.column("doc_tokens"), pa.array(seqs), pa.array(offsets)],
                names=["doc_id", "part", "row", "start", "begin", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = zip(batch.column("ids"), batch.column("begin").to_pylist(), batch.column("length").to_pylist())
        crc = pa.array([zlib.crc32(x.as_py()[4 * a : 4 * (a + n)]) for x, a, n in spans], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c) if c != "ids_crc32" else crc for c in OUT], names=OUT)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts go to Python in batches of fewer rows than usual while tables are written within, so that an executor's buffers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_by_patterns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, tokenizer: str | None = None, rows: int = 128, few_cuts: int = 100_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id; a null or empty text is end_id alone.  Sequences are padded to
    the capacity but for those whose length is a power of two, so that none of these is padded: documents go whole into
    patterns that fill a sequence, long ones and what fits no pattern are cut.  Rows that repeat an id, or have
    none, are packed once each, under that id.  Other columns of df are ignored; an empty table gives an empty
    one.  tokenizer is a file of the `tokenizers` library, by default the public BPE with word ends.  rows bounds
    the lengths of one linear program; up to few_cuts parts of cut pieces are broadcast to the ids, more are joined by a shuffle.
    """
    if tokenizer is None:
        import public_tokenizers as P

        tokenizer = P.path("word_bpe_49k.json")
    made = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(token_rows(tokenizer, capacity, end_id)), "part int, doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, rank long, ids binary"
    )
    with small_batches(df.sparkSession):
        items = materialize(made, "token-rows")
    rests = items.filter(F.col("length") < capacity).drop("ids")
    plan = plan_lengths(rests, capacity, rows)
    counts = rests.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = rests.join(firsts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first")
    placed = materialize(ranked.mapInArrow(tidy(places(plan, capacity)), "doc_id long, part int, row long, start long, begin long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), "places")
    kept = placed.filter("ids_crc32 is not null").select(OUT)
    cut = placed.filter("ids_crc32 is null")
    cut = F.broadcast(cut) if cut.count() <= few_cuts else cut  # else ids are shuffled to their cuts
    cut = items.select("part", "row", "ids").join(cut, ["part", "row"]).mapInArrow(tidy(_checksums), kept.schema)
    own = -1 - (F.col("part").cast("long") * F.lit(1 << 36) + F.col("row"))  # a full sequence of one document needs no place
    full = items.filter(F.col("length") == capacity).withColumn("sequence_id", own).withColumn("offset", F.lit(0).cast("long")).select(OUT)
    return kept.unionByName(cut).unionByName(full)
