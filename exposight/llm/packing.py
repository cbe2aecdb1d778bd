"""Best-fit packing with large-item matching.

Lengths are whole numbers up to the capacity, so the multiset of pieces is a histogram with at most
capacity entries.  The plan is made on that histogram: pieces above a third of the capacity pair at most
twice a bin (greedy matching of the largest with the largest that fits), smaller ones go best-fit, by
decreasing length, into the gaps.  Pieces then find their place by their rank among pieces of their length,
which is counted in buckets, so no task holds all pieces of a length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, tidy

BUCKETS = 64


@dataclass
class Bin:
    """count bins alike: their pieces as (length, how many) in order, and the room left in each."""

    parts: tuple[tuple[int, int], ...]
    count: int
    room: int


def plan(histogram: dict[int, int], capacity: int) -> list[Bin]:
    """Bins for so many pieces of each length (1 to capacity)."""
    left = {n: c for n, c in histogram.items() if c}
    third = capacity // 3
    bins: list[Bin] = []
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                take, parts = left[n], ((n, 1),)
            elif mate == n:
                take, parts = left[n] // 2, ((n, 2),)
            else:
                take, parts = min(left[n], left[mate]), ((n, 1), (mate, 1))
            for m, k in parts:
                left[m] -= k * take
            bins.append(Bin(parts, take, capacity - sum(m * k for m, k in parts)))
    by_room: dict[int, list[Bin]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    for n in sorted((n for n in left if n <= third), reverse=True):
        need = left[n]
        for room in sorted(r for r in by_room if r >= n):
            group, by_room[room], k = by_room[room], [], room // n
            for b in group:
                full = min(b.count, need // k)
                rest = need - full * k if full < b.count and need - full * k < k else 0
                for count, each in ((full, k), (1 if rest else 0, rest)):
                    if count:
                        by_room.setdefault(room - each * n, []).append(Bin((*b.parts, (n, each)), count, room - each * n))
                        need -= count * each
                        b = replace(b, count=b.count - count)
                if b.count:
                    by_room[room].append(b)
            if not need:
                break
        k = capacity // n
        for count, each in ((need // k, k), (1 if need % k else 0, need % k)):
            if count:
                by_room.setdefault(capacity - each * n, []).append(Bin(((n, each),), count, capacity - each * n))
    return [b for r in sorted(by_room) for b in by_room[r] if b.count]


def places(bins: list[Bin]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, how many a sequence, offset): where ranks of a length go."""
    rank: dict[int, int] = {}
    out, seq = [], 0
    for b in bins:
        offset = 0
        for n, k in b.parts:
            r = rank.get(n, 0)
            rank[n] = r + k * b.count
            out.append((n, r, rank[n], seq, k, offset))
            offset += n * k
        seq += b.count
    return out


def token_pieces(tokenizer: str, ranks: str | None, pattern: str | None, capacity: int, end_id: int):
    """Batches of (id, text) -> pieces.  With ranks, the vocabulary's rank file, a faster encoder of the same ids is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        encode = lambda t: slow.encode(t, add_special_tokens=False).ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            whole = encode
            encode = lambda t: whole(t) if any(s in t for s in special) else fast.encode_ordinary(t)
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(5)]
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end_id; a null or empty text is end_id alone.  Only documents longer
    than the capacity are cut, into pieces of the capacity, of which the first may be shorter.  Rows that
    repeat an id are packed once each, under that id.  Other columns of df are ignored; an empty table gives
    an empty one.  tokenizer is the file of the `tokenizers` library; by default the public byte-level BPE.
    """
    if tokenizer is None:
        import public_tokenizers as P

        tokenizer, ranks, pattern = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    pieces = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(token_pieces(tokenizer, ranks, pattern, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack_lengths(materialize(pieces, "pieces"), capacity)


def pack_lengths(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    from pyspark.sql import Window as W

    spark = pieces.sparkSession
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).toArrow()  # capacity * BUCKETS rows at most
    length, bucket, n = (counts.column(k).to_numpy() for k in ("length", "bucket", "n"))
    histogram = {int(k): int(n[length == k].sum()) for k in np.unique(length)}
    order = np.lexsort((bucket, length))
    before, last, total = [], None, 0
    for i in order:
        total = 0 if length[i] != last else total
        before.append((int(length[i]), int(bucket[i]), total))
        last, total = length[i], total + int(n[i])
    firsts = F.broadcast(spark.createDataFrame(before or [(0, 0, 0)], "length long, bucket int, before long"))
    table = F.broadcast(spark.createDataFrame(places(plan(histogram, capacity)) or [(0, 0, 0, 0, 1, 0)], "length long, r0 long, r1 long, seq0 long, each long, offset0 long"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank.cast("long")).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.join(table, (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).drop(table["length"])
    local = F.col("rank") - F.col("r0")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq0") + F.floor(local / F.col("each"))).alias("sequence_id"), (F.col("offset0") + local % F.col("each") * F.col("length")).alias("offset")
    )
