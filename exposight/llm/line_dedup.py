"""Line dedup: two Bloom filters pick suspected repeats; only those are shuffled for exact confirmation.

A first pass puts the key of every line into the filter of keys seen in one document, or, where that has
it, into the filter of keys seen in two.  Filters of all tasks are folded shard by shard (a key in two
tasks' first filters has all its bits in both, so no repeat is missed).  A second pass sends on only keys
that the second filter has, as 128-bit digests; a group-by finds those really in two documents and the least
document that holds each.  A third pass drops lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import tidy

#: Bits for each line, positions for each key, bits in a shard.
BITS_PER_LINE, POSITIONS, SHARD_BITS = 12, 4, 1 << 20
_EDGE = b" \t\n\r\x0b\x0c"


def _keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    lines = text.split(b"\n")
    out = []
    for line in lines:
        key = line.strip(_EDGE).lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, out


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _digests(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def _bits(digests: np.ndarray, n_bits: int) -> np.ndarray:
    """Positions of each key: a shard by the first half, places in it by both halves."""
    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    shard = (a % np.uint64(n_bits // SHARD_BITS)) * np.uint64(SHARD_BITS)
    return np.stack([shard + ((a >> np.uint64(20)) + b * np.uint64(k + 1) >> np.uint64(24)) % np.uint64(SHARD_BITS) for k in range(POSITIONS)], 1).astype(np.int64)


class _Filter:
    def __init__(self, n_bits: int, data: bytes | None = None):
        self.data = np.zeros(n_bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def has(self, at: np.ndarray) -> np.ndarray:
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    def add(self, at: np.ndarray) -> None:
        at = at.ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _build(text_col: str, id_col: str, min_chars: int, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = _Filter(n_bits), _Filter(n_bits)
        for batch in batches:
            found = [(k, i) for i, t in zip(batch.column(id_col).to_pylist(), _texts(batch, text_col)) if i is not None for k in set(_keys(t, min_chars)[1]) if k]
            found = list(dict.fromkeys(found))  # a document in several rows counts once in a batch
            if not found:
                continue
            keys, counts = np.unique(np.array([k for k, _ in found], "V16"), return_counts=True)
            at = _bits(keys.view("<u8").reshape(-1, 2), n_bits)
            twice.add(at[(counts > 1) | once.has(at)])
            once.add(at)
        step = SHARD_BITS // 8
        for k in range(n_bits // SHARD_BITS):
            o, t = (f.data[k * step : (k + 1) * step] for f in (once, twice))
            if o.any():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "once": [zlib.compress(o.tobytes(), 1)], "twice": [zlib.compress(t.tobytes(), 1)]})

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            o, t = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice"))
            if row["shard"] in kept:
                o0, t0 = kept[row["shard"]]
                o, t = o0 | o, t0 | t | (o0 & o)
            kept[row["shard"]] = o, t
    for k, (_, t) in kept.items():
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "twice": [zlib.compress(t.tobytes(), 1)]})


def _suspects(text_col: str, id_col: str, min_chars: int, n_bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = _Filter(n_bits, shared.value) if shared is not None else None
        for batch in batches:
            found = [(k, i) for i, t in zip(batch.column(id_col).to_pylist(), _texts(batch, text_col)) if i is not None for k in set(_keys(t, min_chars)[1]) if k]
            if not found:
                continue
            digests, ids = _digests([k for k, _ in found]), np.array([i for _, i in found], np.int64)
            if twice is not None:
                hit = twice.has(_bits(digests, n_bits))
                digests, ids = digests[hit], ids[hit]
            yield pa.RecordBatch.from_pydict({"k1": digests[:, 0].view("<i8"), "k2": digests[:, 1].view("<i8"), "holder": ids})

    return run


def _rewrite(id_col: str, text_col: str, min_chars: int, names: list[str], schema: pa.Schema, counts: tuple[str, str], shared=None, drops: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {k: i for k, i in zip(*shared.value)} if shared is not None else {}
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            lists = batch.column(drops).to_pylist() if drops else [None] * len(batch)
            for text, doc, own, null in zip(_texts(batch, text_col), batch.column(id_col).to_pylist(), lists, batch.column(text_col).is_null().to_pylist()):
                lines, keys = _keys(text, min_chars)
                out_of = {x["k1"].to_bytes(8, "little", signed=True) + x["k2"].to_bytes(8, "little", signed=True) for x in own or ()}
                kept = [x for x, k in zip(lines, keys) if k is None or (k not in out_of and first.get(k, doc) == doc) or doc is None]
                texts.append(None if null else b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            made = {text_col: pa.array(texts, pa.large_binary()).cast(pa.large_string()), counts[0]: pa.array(n_lines, pa.int64()), counts[1]: pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([(made[n] if n in made else batch.column(n)).cast(schema.field(n).type) for n in names], names=names)

    return run


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, lines_col: str = "n_lines", dropped_col: str = "n_dropped", filter_bytes: int = 32 << 20, table_rows: int = 1_000_000
) -> DataFrame:
    """df with repeated lines taken out of text_col, and the counts lines_col and dropped_col.

    Lines end at \\n; a line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased.
    A key of min_chars code points or more that at least two documents (distinct ids) hold stays only in the
    least id; there all its lines stay.  A null text is one empty line and stays null.  A row with a null id
    keeps all its lines and counts as no document.  Rows that repeat an id count as one document.  Columns
    of df named as the counts are replaced; all others pass through.  An empty table gives an empty one.

    Each filter takes 12 bits a line.  Where that would exceed filter_bytes, no filter is used and every
    key is confirmed by the shuffle; where more than table_rows keys repeat, lines to drop reach their
    documents by a join and not by a broadcast.  Neither changes the result.
    """
    spark = df.sparkSession
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = slim.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    n_bits = (n * BITS_PER_LINE // SHARD_BITS + 1) * SHARD_BITS
    shared = None
    if n_bits // 8 <= filter_bytes:
        parts = slim.mapInArrow(tidy(_build("text", "id", min_chars, n_bits)), "shard int, once binary, twice binary")
        rows = parts.repartition("shard").mapInArrow(tidy(_fold), "shard int, twice binary").collect()  # filter_bytes at most
        data = bytearray(n_bits // 8)
        for r in rows:
            data[r["shard"] * SHARD_BITS // 8 : (r["shard"] + 1) * SHARD_BITS // 8] = zlib.decompress(r["twice"])
        shared = spark.sparkContext.broadcast(bytes(data))
    suspects = slim.mapInArrow(tidy(_suspects("text", "id", min_chars, n_bits, shared)), "k1 long, k2 long, holder long")
    repeated = suspects.groupBy("k1", "k2").agg(F.min("holder").alias("first"), F.max("holder").alias("last")).filter("first < last").select("k1", "k2", "first")
    fields = [f for f in df.schema if f.name not in (lines_col, dropped_col)] + [T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType())]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    names, arrow = [f.name for f in fields], to_arrow_schema(schema)
    head = repeated.limit(table_rows + 1).toArrow()
    if head.num_rows <= table_rows:
        pairs = np.stack([head.column(k).to_numpy().view("<u8") for k in ("k1", "k2")], 1)
        table = spark.sparkContext.broadcast(([p.tobytes() for p in pairs], head.column("first").to_pylist()))
        return df.mapInArrow(tidy(_rewrite(id_col, text_col, min_chars, names, arrow, (lines_col, dropped_col), shared=table)), schema)
    drops = suspects.join(repeated, ["k1", "k2"]).filter("holder <> first").groupBy("holder").agg(F.collect_set(F.struct("k1", "k2")).alias("__drops"))
    joined = df.join(drops, F.col(id_col).cast("long") == F.col("holder"), "left").drop("holder")
    return joined.mapInArrow(tidy(_rewrite(id_col, text_col, min_chars, names, arrow, (lines_col, dropped_col), drops="__drops")), schema)
