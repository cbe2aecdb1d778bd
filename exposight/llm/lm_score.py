"""Language-model scores from a weighted backoff automaton.

Smoothed n-grams are states; where a state has no arc for a word, its failure arc leads to the state of its longest
proper suffix at the cost of a backoff weight.  Interpolated absolute discounting gives the weights:

    p(w) = (c(w) - D) / N, and D * V / N for an unknown word
    p(w|h) = max(c(hw) - D, 0) / c(h) + g(h) * p(w|h'), g(h) = 1 - sum over kept hw of (c(hw) - D) / c(h)

An n-gram of two words or more is kept if it occurs `least` times.  One traversal from left to right adds up arc
and failure weights.  The weights are pushed so that each state on the suffix chain adds its own share: `delta` when it is
entered and `bow` when a word follows, which telescopes to log10 p.  The total is then a sum of lookups that
can be made for all words of a batch at once.  A small automaton is broadcast.  A larger one is joined: chunks of texts ask
the parts of its key space for their n-grams, each part answers, and the answers meet their chunk; so a text is read a fixed
number of times at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._spark import crc_text, drop, materialize, tidy

_U = np.uint64
END = _words.mix(np.array([0xE0D], np.uint64))[0]
HOLD = 2_000_000
#: Bits of the filter of kept n-grams: 64 MB at most, at any size of the input; others it lets by are only joined for nothing.
FILTER_BITS, FILTER_PART = 1 << 29, 1 << 15
#: Entries of the automaton that are broadcast where the others are joined: the most frequent ones, which most words meet.
HOT = 1_500_000
#: Shuffle files go when the job that wrote them ends; every job here writes its result to the shared folder or collects it.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of a chunk of texts and of texts for each part of the automaton.
CHUNK_CHARS, PART_CHARS = 4_000_000, 16_000_000


def sequence(chunk: _words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end."""
    n = len(chunk)
    return np.insert(chunk.hashes, chunk.bounds[1:], np.full(n, END)), chunk.bounds + np.arange(n + 1)


class Table:
    """Sorted keys with a bitmap of their top bits that turns most other keys away."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.shift = _U(64 - max(8, min(25, int(len(keys)).bit_length() + 3)))
        self.near = np.zeros(1 << (64 - int(self.shift)), bool)
        self.near[self.keys >> self.shift] = True

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in q that are found, and where."""
        at = np.flatnonzero(self.near[q >> self.shift])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        some, back = np.unique(q[at], return_inverse=True)
        k = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        ok = (self.keys[k] == some)[back]
        return at[ok], self.order[k][back][ok]


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """One bit for each low end of a key, packed: about 16 bits a key up to FILTER_BITS."""
    size = min(FILTER_BITS, max(FILTER_PART, 1 << (16 * max(n, 1) - 1).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(size - 1))
    parts = keys.select(F.floor(slot / FILTER_PART).alias("part"), (slot % FILTER_PART).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS / FILTER_PART rows at most
        out[r["part"] * FILTER_PART // 8 : (r["part"] + 1) * FILTER_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _may(bits: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the filter; all that are, and some others."""
    slot = (q & _U(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _blobs(columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Arrays as one binary row for each part of the key space; columns[0] are the keys."""
    part = (columns[0] % _U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(ends))
    for s in range(0, len(some), 64):
        rows = some[s : s + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), *(pa.array([c[order[ends[r] : ends[r + 1]]].tobytes() for r in rows], pa.binary()) for c in columns)], names=["part", *"abc"[: len(columns)]]
        )


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _count(order: int, shared, parts: int):
    """Counts of n-grams of one order in a task; with shared, a filter, only of those whose two shorter n-grams may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in _words.words(batch.column("text")):
                hashes, bounds = sequence(chunk)
                key, at = _words.ngrams(hashes, bounds, order)
                if shared is not None:
                    short, sb = _words.ngrams(hashes, bounds, order - 1)
                    left = np.repeat(sb[:-1] - at[:-1], np.diff(at)) + np.arange(at[-1])
                    known = _may(shared.value, short)
                    key = key[known[left] & known[left + 1]]
                held.append(key)
                size += len(key)
                if size > HOLD:
                    some, n = np.unique(np.concatenate(held), return_counts=True)
                    yield from _blobs([some, n.astype(np.uint32)], parts)
                    held, size = [], 0
        if size:
            some, n = np.unique(np.concatenate(held), return_counts=True)
            yield from _blobs([some, n.astype(np.uint32)], parts)

    return run


def _merge(least: int):
    def run(table: pa.Table) -> pa.Table:
        some, back = np.unique(_joined(table, "a", np.uint64), return_inverse=True)
        n = np.bincount(back, _joined(table, "b", np.uint32), len(some)).astype(np.int64)
        keep = n >= least
        return pa.table({"key": some[keep].view(np.int64), "c": n[keep]})

    return run


def _links(order: int, shared, parts: int):
    """Of each n-gram met that may be kept, which a filter says: itself, its context and its suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, given = [], 0, np.zeros(0, np.uint64)

        def rows() -> Iterator[pa.RecordBatch]:
            """What is held and was not given before; `given` stops growing at 2 * HOLD keys, then repeats are given."""
            nonlocal given
            key, left, right = (np.concatenate(c) for c in zip(*held))
            key, first = np.unique(key, return_index=True)
            if len(given):
                fresh = given[np.minimum(np.searchsorted(given, key), len(given) - 1)] != key
                key, first = key[fresh], first[fresh]
            if len(given) < 2 * HOLD:
                given = np.sort(np.concatenate((given, key)))
            return _blobs([key, left[first], right[first]], parts)

        for batch in batches:
            for chunk in _words.words(batch.column("text")):
                hashes, bounds = sequence(chunk)
                key, at = _words.ngrams(hashes, bounds, order)
                short, sb = _words.ngrams(hashes, bounds, order - 1)
                place = np.flatnonzero(_may(shared.value, key))
                row = np.searchsorted(at, place, "right") - 1
                left = sb[row] + place - at[row]
                if len(place):
                    some, first = np.unique(key[place], return_index=True)
                    held.append((some, short[left[first]], short[left[first] + 1]))
                    size += len(some)
                if size > HOLD:
                    yield from rows()
                    held, size = [], 0
        if size:
            yield from rows()

    return run


def _one_link(table: pa.Table) -> pa.Table:
    key, first = np.unique(_joined(table, "a", np.uint64), return_index=True)
    return pa.table({"key": key.view(np.int64), "ctx": _joined(table, "b", np.int64)[first], "low": _joined(table, "c", np.int64)[first]})


def _sum(order: int, discount: float, shared, singles: bool):
    """Adds up, for each row, what the n-grams of a broadcast automaton give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        table = Table(value["key"])
        for batch in batches:
            for chunk in _words.words(batch.column("text")):
                hashes, bounds = sequence(chunk)
                n = len(chunk)
                found, base, score = np.zeros(n), np.zeros(n), np.zeros(n)
                for k in range(1, (1 if singles else order) + 1):
                    key, at = _words.ngrams(hashes, bounds, k)
                    if not len(key):
                        continue
                    place, where = table.find(key)
                    row = np.searchsorted(at, place, "right") - 1
                    if singles:
                        found += np.bincount(row, minlength=n)
                        continue
                    follows = place + 1 < at[row + 1]
                    if k == 1:
                        c = value["c"][where]
                        found += np.bincount(row, minlength=n)
                        base += np.bincount(row, np.log10(c + 1.0), n)
                        score += np.bincount(row, np.log10(c - discount), n)
                    else:
                        score += np.bincount(row, value["delta"][where], n)
                    score += np.bincount(row[follows], value["bow"][where][follows], n)
                ids = batch.column("id").slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column("mark").slice(chunk.first, n), pa.array([2 if singles else 0] * n, pa.int32()), pa.array(np.diff(bounds)), pa.array(found.astype(np.int64)), pa.array(base), pa.array(score)],
                    names=["id", "mark", "pass", "n_tokens", "found", "base", "score"],
                )

    return run


def _hot(model: DataFrame, most: int) -> int:
    """The least count from which on at most `most` entries of the automaton are as frequent; one that no entry has if there is none."""
    n, often = 0, model.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().orderBy(F.desc("c")).collect()  # 10,000 rows at most
    least = 1 << 31
    for r in often:
        n += r["count"]
        if n > most:
            break
        least = r["c"]
    return least


def _wanted(text: pa.ChunkedArray, order: int, shared, parts: int, places: bool):
    """A chunk's bounds by row and the keys it asks for: distinct, by part of the key space, and the bounds of the parts.

    With places also, for each order, the distinct keys that the filter lets by, where each n-gram has them, its place and the bounds by row."""
    bits, hot = shared.value["bits"], shared.value["key"]
    hashes, bounds = [], [np.zeros(1, np.int64)]
    for chunk in _words.words(text):
        h, b = sequence(chunk)
        hashes.append(h)
        bounds.append(b[1:] + bounds[-1][-1])
    hashes, bounds = np.concatenate(hashes), np.concatenate(bounds)
    met = []
    for k in range(1, order + 1):
        key, at = _words.ngrams(hashes, bounds, k)
        place = np.flatnonzero(_may(bits, key))
        met.append((*np.unique(key[place], return_inverse=True), place, at) if places else (np.unique(key[place]),))
    keys = np.sort(np.concatenate([m[0] for m in met]), kind="stable")  # runs that are sorted already
    if len(hot):
        keys = keys[hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] != keys]
    part = (keys % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
    by = np.argsort(part, kind="stable")
    return bounds, met, keys, by, np.searchsorted(part[by], np.arange(parts + 1))


def _ask(order: int, shared, parts: int):
    """The keys that a chunk of texts asks each part of the automaton for."""

    def run(table: pa.Table) -> pa.Table:
        _, _, keys, by, ends = _wanted(table.column("text"), order, shared, parts, False)
        some = np.flatnonzero(np.diff(ends))
        blobs = [keys[by[ends[r] : ends[r + 1]]].tobytes() for r in some]
        return pa.table({"part": some.astype(np.int32), "chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "a": pa.array(blobs, pa.binary())})

    return run


_ANSWER = "chunk long, part int, found binary, first binary, more binary, bow binary"


def _values(model: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, c (one word) or the bits of delta (more), and bow."""
    key = _key_array(model)
    by = np.argsort(key)
    first = np.where(model.column("k").to_numpy() == 1, model.column("c").to_numpy().astype(np.int32), model.column("delta").to_numpy().astype(np.float32).view(np.int32))
    return key[by], first[by], model.column("bow").to_numpy().astype(np.float32)[by]


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each chunk that asks this part: which keys are found, of these c (one word) or delta (more), and the bows that are not 0."""
    key, first, bow = _values(model)
    out = []
    for r in range(len(asked)):
        q = np.frombuffer(asked.column("a")[r].as_py(), np.uint64)
        at = np.minimum(np.searchsorted(key, q), max(len(key) - 1, 0))
        found = key[at] == q if len(key) else np.zeros(len(q), bool)
        at = at[found]
        out.append([np.packbits(found), first[at], np.packbits(bow[at] != 0), bow[at][bow[at] != 0]])
    columns = {n: pa.array([x[k].tobytes() for x in out], pa.binary()) for k, n in enumerate(("found", "first", "more", "bow"))}
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), **columns})


def _score(order: int, discount: float, shared, parts: int):
    """A chunk's rows with their sums, from the answers of all parts."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        n = len(table)
        if not n:
            return pa.table({"id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "known": pa.array([], pa.int64()), "base": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        bounds, met, keys, by, ends = _wanted(table.column("text"), order, shared, parts, True)
        found, first, bow = np.zeros(len(keys), bool), np.zeros(len(keys), np.int32), np.zeros(len(keys), np.float32)
        for r in range(len(answers)):
            part = answers.column("part")[r].as_py()
            mine = by[ends[part] : ends[part + 1]]
            get = lambda c, kind: np.frombuffer(answers.column(c)[r].as_py(), kind)  # noqa: B023, E731
            mine = mine[np.unpackbits(get("found", np.uint8), count=len(mine)).astype(bool)]
            found[mine], first[mine] = True, get("first", np.int32)
            bow[mine[np.unpackbits(get("more", np.uint8), count=len(mine)).astype(bool)]] = get("bow", np.float32)
        keys, first, bow = keys[found], first[found], bow[found]
        known, base, score = np.zeros(n), np.zeros(n), np.zeros(n)
        value = shared.value
        tables = [(keys, first, bow), (value["key"], value["first"], value["bow"])]
        for k, (some, back, place, at) in enumerate(met, 1):  # sorted keys are looked up much faster
            rows = np.repeat(np.arange(n), np.diff(at))[place]
            for keys, first, bow in tables:
                if not len(keys):
                    continue
                where = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
                mine = np.flatnonzero((keys[where] == some)[back])
                row, where = rows[mine], where[back[mine]]
                follows = place[mine] + 1 < at[row + 1]
                if k == 1:
                    c = first[where]
                    known += np.bincount(row, minlength=n)
                    base += np.bincount(row, np.log10(c + 1.0), n)
                    score += np.bincount(row, np.log10(c - discount), n)
                else:
                    score += np.bincount(row, first.view(np.float32)[where], n)
                score += np.bincount(row[follows], bow[where][follows], n)
        return pa.table({"id": table.column("id"), "n_tokens": np.diff(bounds).astype(np.int64), "known": known.astype(np.int64), "base": base, "score": score})

    return run


def _key_array(table: pa.Table) -> np.ndarray:
    return table.column("key").combine_chunks().to_numpy().view(np.uint64)


def train(docs: DataFrame, order: int = 3, least: int = 3, discount: float = 0.75) -> tuple[DataFrame, int, int]:
    """(automaton, N, V) from documents(text).  automaton: key, k (order), c, delta, bow; unigrams all, longer n-grams kept.

    An n-gram can only be kept if both n-grams one shorter are, so only those are counted, and others that a filter of
    fixed size lets by.  Each order is two passes over the texts, whatever their size.  Counts are merged in parts of the key space
    whose number follows the corpus, so a part's size does not.
    """
    spark = docs.sparkSession
    parts = 16 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 8_000_000
    blob = "part int, a binary, b binary"

    def counted(k: int, shared, floor: int) -> DataFrame:
        return materialize(docs.mapInArrow(tidy(_count(k, shared, parts)), blob).groupBy("part").applyInArrow(_merge(floor), "key long, c long"), f"counts{k}")

    counts = counted(1, None, 1)
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    level = counts.select("key", F.lit(1).alias("k"), "c", ((F.col("c") - discount) / max(total, 1)).alias("p"), F.lit(0.0).alias("delta"))
    done, kept, used = [], counts.filter(F.col("c") >= least), [counts]
    for k in range(2, order + 1):
        shared = spark.sparkContext.broadcast(_filter(kept, kept.count()))
        grams = counted(k, shared, least)
        shared.destroy()
        shared = spark.sparkContext.broadcast(_filter(grams, grams.count()))
        links = docs.mapInArrow(tidy(_links(k, shared, parts)), f"{blob}, c binary").groupBy("part").applyInArrow(_one_link, "key long, ctx long, low long")
        used.append(grams)
        grams = materialize(grams.join(links, "key"), f"grams{k}")  # also drops what only the filter let by
        shared.destroy()
        below = level.filter(F.col("c") >= least)
        left = grams.groupBy("ctx").agg(F.sum(F.col("c") - discount).alias("used")).join(below.select(F.col("key").alias("ctx"), F.col("c").alias("of")), "ctx")
        left = materialize(left.select("ctx", "of", (1 - F.col("used") / F.col("of")).alias("g")), f"left{k}")
        bows = left.select(F.col("ctx").alias("key"), F.log10("g").alias("bow"))
        done.append(below.join(bows, "key", "left").withColumn("bow", F.coalesce("bow", F.lit(0.0))).unionByName(level.filter(F.col("c") < least).withColumn("bow", F.lit(0.0))))
        p = (F.col("c") - discount) / F.col("of") + F.col("g") * F.col("p_low")
        level = grams.join(left, "ctx").join(below.select(F.col("key").alias("low"), F.col("p").alias("p_low")), "low").withColumn("p", p)
        level = materialize(level.select("key", F.lit(k).alias("k"), "c", "p", (F.log10("p") - F.log10("g") - F.log10("p_low")).alias("delta")), f"level{k}")
        kept = grams
        used += [grams, left, level]
    out = level.withColumn("bow", F.lit(0.0))
    for x in done:
        out = out.unionByName(x)
    out = materialize(out.select("key", "k", "c", "delta", "bow"), "automaton")
    for table in used:  # nothing reads them any more
        drop(table)
    return out, total, distinct


def lm_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold_mod: int = 7, held: int = 2, order: int = 3, least: int = 3, discount: float = 0.75, block_keys: int = 1_000_000, single_keys: int = 4_000_000
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    Tokens are words (outside [\\x20\\x09-\\x0D], A-Z lower-cased) and one end; a null or empty text is its end.
    Rows whose crc32(id as text) mod hold_mod is held are not learned from (nor are rows with a null id).  base_score adds
    log10((c+1)/(N+V+1)), score the automaton's log10 probabilities.  Rows that repeat an id and text are learned from
    and scored each.  With nothing to learn from both scores are 0.  Other columns are ignored.  Words and n-grams are told
    apart by 64-bit hashes.  An automaton of up to block_keys entries is broadcast, with up to single_keys words
    that occur once; a larger one is joined (see above), with the same sums.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return _lm_scores(df, id_col, text_col, hold_mod, held, order, least, discount, block_keys, single_keys)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def _lm_scores(df: DataFrame, id_col: str, text_col: str, hold_mod: int, held: int, order: int, least: int, discount: float, block_keys: int, single_keys: int) -> DataFrame:
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out_of = F.coalesce(F.pmod(crc_text("id"), F.lit(hold_mod)) == held, F.lit(True))
    model, total, distinct = train(base.filter(~out_of).select("text"), order, least, discount)
    marked = base.select("id", "text", F.xxhash64("text").alias("mark"))
    names = "id long, mark long, pass int, n_tokens long, found long, base double, score double"
    main, single = model.filter("k > 1 or c > 1"), model.filter("k = 1 and c = 1")
    n_main, n_single = main.count(), single.count()
    if n_main > block_keys or n_single > single_keys:
        got = _joined_sums(base, model, order, discount).withColumn("held_out", F.coalesce(F.pmod(crc_text("id"), F.lit(hold_mod)) == held, F.lit(False)))
        base_score = F.col("base") - F.col("n_tokens") * math.log10(total + distinct + 1)
        score = F.col("score") + (F.col("n_tokens") - F.col("known")) * math.log10(max(discount * distinct, 1e-300)) - F.col("n_tokens") * math.log10(max(total, 1))
        return got.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), score.alias("score"))
    sums = None
    for singles, keys in ((False, main), (True, single)):
        part = keys.select("key", F.col("c").cast("int"), F.col("delta").cast("float"), F.col("bow").cast("float")).toArrow() if not singles else keys.select("key").toArrow()  # block_keys or single_keys rows at most
        value = {"key": _key_array(part)} | ({} if singles else {c: part.column(c).to_numpy() for c in ("c", "delta", "bow")})
        rows = marked.filter(out_of) if singles else marked
        shared = spark.sparkContext.broadcast(value)
        # A pass is written before the next one, so the driver holds one table at a time.
        rows = materialize(rows.mapInArrow(tidy(_sum(order, discount, shared, singles)), names), "pass")
        shared.destroy()
        del part, value, shared
        sums = rows if sums is None else sums.unionByName(rows)
    first = F.col("pass") == 0
    n = F.sum(first.cast("int"))
    each = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))) / n, F.lit(0))
    got = sums.groupBy("id", "mark").agg(
        n.alias("rows"), F.max("n_tokens").alias("n_tokens"), each("found", F.col("pass") < 2).cast("long").alias("common"), each("found", F.col("pass") == 2).cast("long").alias("single"), each("base", F.lit(True)).alias("base"), each("score", F.lit(True)).alias("score")
    )
    got = got.withColumn("held_out", F.coalesce(F.pmod(crc_text("id"), F.lit(hold_mod)) == held, F.lit(False))).withColumn("rare", F.when(out_of, F.col("single")).otherwise(F.col("n_tokens") - F.col("common")))
    unknown = F.col("n_tokens") - F.col("common") - F.col("rare")
    base_score = F.col("base") + F.col("rare") * math.log10(2) - F.col("n_tokens") * math.log10(total + distinct + 1)
    score = F.col("score") + F.col("rare") * math.log10(1 - discount) + unknown * math.log10(max(discount * distinct, 1e-300)) - F.col("n_tokens") * math.log10(max(total, 1))
    return got.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("common") + F.col("rare")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (base_score if total else F.lit(0.0)).alias("base_score"), (score if total else F.lit(0.0)).alias("score"),
    )


def _joined_sums(base: DataFrame, model: DataFrame, order: int, discount: float) -> DataFrame:
    """(id, n_tokens, known, base, score) of base(id, text), the automaton joined by parts of its key space.  Both uses of the texts are one shuffle."""
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, parts = 1 + chars // CHUNK_CHARS, 16 + chars // PART_CHARS
    hot = F.col("c") >= _hot(model, HOT)
    key, first, bow = _values(model.filter(hot).toArrow())  # HOT rows at most
    shared = base.sparkSession.sparkContext.broadcast({"bits": _filter(model, model.count()), "key": key, "first": first, "bow": bow})
    texts = base.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    asked = texts.groupBy("chunk").applyInArrow(_ask(order, shared, parts), "part int, chunk long, a binary")
    entries = model.filter(~hot).withColumn("part", _unsigned_mod("key", parts).cast("int"))
    answers = asked.groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(_answer, _ANSWER)
    sums = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, discount, shared, parts), "id long, n_tokens long, known long, base double, score double")
    sums = materialize(sums, "sums")
    shared.destroy()
    return sums


def _unsigned_mod(col: str, n: int):
    """A 64-bit key, read as unsigned, mod n."""
    return F.pmod(F.pmod(F.col(col), F.lit(n)) + F.when(F.col(col) < 0, F.lit((1 << 64) % n)).otherwise(0), F.lit(n))


class Automaton:
    """The same model as an explicit automaton, for one text at a time: states, arcs, failure arcs."""

    def __init__(self, rows: list[dict], total: int, distinct: int, order: int, discount: float = 0.75):
        self.at = {r["key"] & (2**64 - 1): r for r in rows}
        self.total, self.distinct, self.order, self.discount = total, distinct, order, discount

    def _key(self, words: tuple[int, ...]) -> int:
        return int(_words.ngrams(np.array(words, np.uint64), np.array([0, len(words)]), len(words))[0][0])

    def step(self, state: tuple[int, ...], word: int) -> tuple[float, tuple[int, ...]]:
        """log10 p of word in a state, and the next state."""
        logp, h = 0.0, state
        while h and self._key((*h, word)) not in self.at:
            logp += self.at[self._key(h)]["bow"]
            h = h[1:]
        entry = self.at.get(self._key((*h, word)))
        if entry is None:
            return logp + math.log10(self.discount * self.distinct / self.total), ()
        logp += self._arc((*h, word))
        nxt = (*h, word)[-(self.order - 1) :] if self.order > 1 else ()
        while nxt and self._key(nxt) not in self.at:
            nxt = nxt[1:]
        return logp, nxt

    def _arc(self, words: tuple[int, ...]) -> float:
        entry = self.at[self._key(words)]
        if len(words) == 1:
            return math.log10((entry["c"] - self.discount) / self.total)
        return entry["delta"] + self.at[self._key(words[:-1])]["bow"] + self._arc(words[1:])

    def score(self, words: list[int]) -> float:
        out, state = 0.0, ()
        for w in words:
            logp, state = self.step(state, w)
            out += logp
        return out
