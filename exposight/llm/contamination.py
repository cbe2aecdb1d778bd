"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Every n-gram of an item is a seed, and so are n words with one word between two of them, in the item or in the text: an
edited copy may keep only such ones, or only those that are common elsewhere, so none is left out for its count.  An alignment of m
matched words with fewer than m - 2 edits between them has three matches in a row with one edit at most, which is a
seed; with matches of 1 and edits of -0.5 a score of 0.5 leaves more edits only where words are put in after nearly every word.  Around seeds the text is aligned only where the item's words found there allow the
score.  Documents are read once and their texts never shuffled; the benchmark comes to them, in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._spark import tidy

MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAK = "array<struct<item_id:bigint,score:double,seeds:bigint,start_word:bigint,end_word:bigint>>"
_MASK = np.uint64((1 << 20) - 1)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, and the words of text it covers (end exclusive).

    One row of the table at a time, and with each cell the place where its alignment begins: memory grows with the text alone.
    """
    places = np.arange(len(text) + 1)
    slope = places * -GAP
    above, begins = np.zeros(len(text) + 1), places
    best, start, end = 0.0, 0, 0
    for w in item:
        row, begin = above + GAP, begins.copy()
        diagonal = above[:-1] + np.where(text == w, MATCH, MISMATCH)
        row[1:] = np.maximum(row[1:], diagonal)
        begin[1:] = np.where(diagonal >= row[1:], begins[:-1], begin[1:])
        fresh = row <= 0
        row[fresh], begin[fresh] = 0.0, places[fresh]
        raised = row + slope  # a cell's best way from the left: a running maximum
        highest = np.maximum.accumulate(raised)
        above, begins = highest - slope, begin[np.maximum.accumulate(np.where(raised >= highest, places, 0))]
        k = int(above.argmax())
        if above[k] > best:
            best, start, end = float(above[k]), int(begins[k]), k
    return best, start, end


def most(item: np.ndarray, text: np.ndarray) -> float:
    """No alignment scores more: each word of the item that the text lacks costs a mismatch or a gap."""
    total = np.cumsum(np.where(np.isin(item, text), MATCH, max(MISMATCH, GAP)))
    return float((total - np.minimum.accumulate(np.append(0, total[:-1]))).max(initial=0))


def shapes(n: int) -> list[tuple[int, ...]]:
    """Places of n words in a row, and with one word left out between two of them."""
    return [tuple(range(n)), *[tuple(k + (k >= gap) for k in range(n)) for gap in range(1, n)]]


def spaced(hashes: np.ndarray, bounds: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at these places from each word on, and their bounds by row; equal words in any shape have equal hashes."""
    size = np.maximum(np.diff(bounds) - shape[-1], 0)
    out = np.concatenate(([0], np.cumsum(size)))
    if len(hashes) <= shape[-1]:
        return np.zeros(0, np.uint64), out
    last = len(hashes) - shape[-1]
    h = np.zeros(last, np.uint64)
    for k in shape:
        h = _words.mix(h + hashes[k : k + last])
    return h[np.repeat(bounds[:-1] - out[:-1], size) + np.arange(out[-1])], out


class Items:
    """A block of test items: their words, and their n-grams (shorter items: the whole item)."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.ids, self.words, self.n = ids, [], n
        grams: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for chunk in _words.words(pa.array(texts, pa.string())):
            for k in range(len(chunk)):
                self.words.append(chunk.hashes[chunk.bounds[k] : chunk.bounds[k + 1]].copy())
        for k, w in enumerate(self.words):
            size = min(n, len(w))
            for shape in shapes(size) if size else ():
                for place, g in enumerate(spaced(w, np.array([0, len(w)]), shape)[0]):
                    grams[size][int(g)].append((k, place))
        self.grams = {s: dict(g) for s, g in grams.items()}

    def lookups(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By n-gram size: sorted hashes, and a bitmap of their low bits that turns most others away."""
        out = {}
        for size, g in self.grams.items():
            keys = np.sort(np.array(list(g), np.uint64))
            bits = np.zeros(int(_MASK) + 1, bool)
            bits[keys & _MASK] = True
            out[size] = keys, bits
        return out


def _hits(hashes: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of hashes that are among keys."""
    at = np.flatnonzero(bits[hashes & _MASK])
    k = np.searchsorted(keys, hashes[at])
    return at[(k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == hashes[at])]


def _find(shared, least: float, names: list[str], leaks: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        lookups = items.lookups()
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for chunk in _words.words(batch.column("__text")):
                seeds: dict[tuple[int, int], list[int]] = defaultdict(list)
                for shape, (keys, bits) in ((x, found) for size, found in lookups.items() for x in shapes(size)):
                    hashes, bounds = spaced(chunk.hashes, chunk.bounds, shape)
                    at = _hits(hashes, keys, bits)
                    rows = np.searchsorted(bounds, at, "right") - 1
                    for r, p, h in zip(rows.tolist(), (at - bounds[rows]).tolist(), hashes[at].tolist()):
                        for k, place in items.grams[len(shape)][h]:
                            seeds[r, k].append(p - place)
                for (r, k), starts in seeds.items():
                    item, doc = items.words[k], chunk.hashes[chunk.bounds[r] : chunk.bounds[r + 1]]
                    slack, best = len(item), (0.0, 0, 0)  # as many words more or fewer as a score of 0.5 bears
                    spans: list[list[int]] = []
                    for s in sorted(set(starts)):
                        a, b = max(0, s - slack), min(len(doc), s + len(item) + slack)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        else:
                            spans.append([a, b])
                    for a, b in spans:
                        # Long runs of seeds are aligned in overlapping windows, so memory stays small.
                        for x in range(a, b, 4096):
                            text = doc[x : min(b, x + 4096 + 2 * len(item))]
                            if most(item, text) < least * MATCH * len(item):
                                continue
                            s, i, j = align(item, text)
                            best = max(best, (s, x + i, x + j), key=lambda v: v[0])
                    score = best[0] / (MATCH * len(item))
                    if score >= least:
                        out[chunk.first + r].append({"item_id": items.ids[k], "score": score, "seeds": len(starts), "start_word": best[1], "end_word": best[2]})
            found = pa.array([sorted(x, key=lambda v: v["item_id"]) for x in out], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, leaks])

    return run


def find_leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least: float = 0.5, leaks_col: str = "leaks", block_chars: int = 16 << 20
) -> DataFrame:
    """df with leaks_col: the test items found in each whole text, by item id, with score, seeds and the words covered.

    The score is the best local alignment over words (match 1, mismatch and gap -0.5) as a share of the item's
    length; items of at least `least` are listed.  Words as everywhere: outside [\\x20\\x09-\\x0D], A-Z lower-cased.
    Null or empty texts have no leaks; items that are null, empty or without an id are never found; items that
    share an id are found under it one by one.  An empty benchmark finds nothing.  All rows of df stay; a column of
    df named leaks_col is replaced.  A benchmark of more than block_chars characters is taken in blocks, one pass each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    kept = [f for f in df.schema if f.name != leaks_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *T._parse_datatype_string(f"__found {LEAK}").fields])
    kind = to_arrow_schema(schema).field("__found").type
    tests = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).filter("id is not null and text is not null").distinct()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__text"))
    out = source.select(*names, F.lit(None).cast(LEAK).alias(leaks_col), "__text")
    for b in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()  # about block_chars
        items = Items([r["id"] for r in rows], [r["text"] for r in rows], n)
        seeds = spark.sparkContext.broadcast(items)
        carry = [*names, leaks_col, "__text"]
        both = T.StructType([*kept, *T._parse_datatype_string(f"`{leaks_col}` {LEAK}, __text string, __found {LEAK}").fields])
        out = out.mapInArrow(tidy(_find(seeds, least, carry, "__found", kind)), both)
        merged = F.array_sort(F.concat(F.coalesce(leaks_col, F.array().cast(LEAK)), "__found"))
        out = out.select(*names, merged.alias(leaks_col), "__text")
    return out.drop("__text")
