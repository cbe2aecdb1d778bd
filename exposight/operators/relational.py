"""Joins, set operations and recoding that reach beyond one built-in call."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import keep
from .series import micros

#: Pairs of a task at least before a tile is dealt to parts; cells that a tile of counts may have; pairs or values, and pairs of lists, made at a time.
_PAIRS, _CELLS, _CHUNK, _MEETINGS = 100_000_000, 40_000_000, 4_000_000, 1_000_000


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (a, b]; what lies outside, and the lowest edge itself, is null."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def last_wins(default: Column, *rules: tuple[Column, str]) -> Column:
    """Conditional updates in order: of the rules that hold the last one counts."""
    out = default
    for cond, label in rules:
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Null where the test is null."""
    return F.when(test.isNull(), None).when(test, yes).otherwise(no)


def map_values(column: str, mapping: dict[str, str]) -> Column:
    """Values by a map; others pass through."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))


def recode(value: Column, mapping: dict[str, str], default: str) -> Column:
    """Values by a map, all others (and null) the default."""
    out = F.lit(default)
    for old, new in mapping.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def answered(df: DataFrame, answer: str, unsure: list[str], positive: list[str], name: str) -> DataFrame:
    """Rows with an answer that is not one of `unsure`, and whether it is one of `positive`."""
    return df.filter(F.col(answer).isNotNull() & ~F.col(answer).isin(unsure)).withColumn(name, F.col(answer).isin(positive))


def short_names(df: DataFrame, pattern: str) -> DataFrame:
    """Columns renamed without what the pattern matches; names that would meet keep theirs."""
    import re

    new = [re.sub(pattern, "", c) for c in df.columns]
    return df.toDF(*[n if n and new.count(n) == 1 else c for c, n in zip(df.columns, new)])


def as_flag(value: Column, letters: str = "YN") -> Column:
    """A yes letter as true, a no letter as false, anything else null."""
    return F.translate(value, letters, "TF").try_cast("boolean")


def occurs_once(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    once = df.groupBy(key).agg(F.count("*").alias("__n")).filter("__n = 1").select(key)
    return df.join(once, key, "left_semi")


def at_least_tail(df: DataFrame, value: str, other: DataFrame, other_value: str) -> DataFrame:
    """Rows with at least the least value of the other relation."""
    least = other.agg(F.min(other_value).alias("__least"))
    return df.join(F.broadcast(least), F.col(value) >= F.col("__least")).drop("__least")


def merge_lists(first: DataFrame, second: DataFrame, third: DataFrame, key: str = "domain", color: str = "color") -> DataFrame:
    """Full outer merge of three lists; the first that knows a site gives its colour."""
    out = first.select(key, F.col(color).alias("c1")).join(second.select(key, F.col(color).alias("c2")), key, "full").join(third.select(key, F.col(color).alias("c3")), key, "full")
    return out.select(key, F.coalesce("c1", "c2", "c3").alias(color)).dropDuplicates([key])


def people_partition(everyone: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, grp): A; B without A; C without both; the others are normal."""
    marks = a.select(key, F.lit("A").alias("g")).unionByName(b.select(key, F.lit("B").alias("g"))).unionByName(c.select(key, F.lit("C").alias("g"))).groupBy(key).agg(F.min("g").alias("grp"))
    return everyone.select(key).distinct().join(marks, key, "left").withColumn("grp", F.coalesce("grp", F.lit("normal")))


def closest_preceding(shares: DataFrame, exposures: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Exposures, each with the share it is the nearest earlier exposure of.

    For each share only the exposures of least positive distance stay (ties all); exposures whose keys nobody shared stay
    with a null share; others are dropped.  Each share looks back along its keys' line of times for the last exposure
    before it, so no share meets all exposures of its keys.
    """
    s = shares.select(*keys, F.col(ts).alias("ts_share"))
    line = s.select(*keys, F.col("ts_share").alias("__at"), F.lit(None).cast(dict(exposures.dtypes)[ts]).alias(ts)).unionByName(exposures.select(*keys, F.col(ts).alias("__at"), ts))
    before = W.partitionBy(*keys).orderBy("__at", F.col(ts).isNotNull()).rowsBetween(W.unboundedPreceding, 0)  # of equal times shares come first
    nearest = line.withColumn("__last", F.last(ts, ignorenulls=True).over(before)).filter(F.col(ts).isNull() & F.col("__last").isNotNull() & F.col("__at").isNotNull())
    nearest = nearest.select(*keys, F.col("__last").alias(ts), F.col("__at").alias("ts_share"))
    met = exposures.join(nearest, [*keys, ts]).withColumn("ts_diff", micros(F.col("ts_share")) - micros(F.col(ts)))
    lone = exposures.join(s.select(*keys).distinct(), keys, "left_anti").withColumn("ts_share", F.lit(None).cast(dict(s.dtypes)["ts_share"])).withColumn("ts_diff", F.lit(None).cast("long"))
    return met.unionByName(lone)


def pair_counts(df: DataFrame, left: str, right: str, per: int = 4096, both: bool = True, weights: bool = False) -> DataFrame:
    """(i, j, x): how many `left` two `right` values share; both orders and the diagonal, or without `both` only i <= j.

    The `right` values are dealt to blocks of about `per` by ranges, and each `left` sends, for two blocks it has values in, its
    values in both: a pair of blocks is a tile, whose counts are one array in a task.  So lists are shuffled and not pairs, and a
    pair has one row whoever shares it.  A tile of very many pairs is dealt to parts by `left`, whose counts are added.

    Rows are shuffled once to gather the values of a `left`, and once as lists to their tiles: blocks are told by their ends, and
    tiles number their values as they come.  With `weights` there are also w_i and w_j, the sums of x over all pairs of i
    and of j, and q, half the sum over all pairs: a value's weight is the number of values of all who have it.
    """
    kind = dict(df.dtypes)[right]
    rows = df.select(left, right).filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    own = keep(rows.repartition(left).groupBy(left).agg(F.array_sort(F.collect_set(right)).alias("v")))
    found = keep(own.select(F.explode("v").alias(right), F.size("v").cast("long").alias("w")).groupBy(right).agg(F.sum("w").alias("w")))
    values, total = found.agg(F.count("*"), F.sum("w")).first()
    blocks = max(1, min(256, -(-values // per)))
    ranged = found.repartitionByRange(blocks, right).groupBy(F.spark_partition_id().alias("part"))
    named = keep(ranged.agg(F.array_sort(F.collect_list(F.struct(F.col(right).alias("v"), "w"))).alias("s")).select(F.col("s.v").alias("v"), F.col("s.w").alias("w")))
    least = named.select(F.col("v")[0].alias("least")).orderBy("least").toArrow().column("least").combine_chunks()
    sizes = own.mapInArrow(functools.partial(_sizes, least=least), "a int, b int, pairs long, rows long").groupBy("a", "b").agg(F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows"))
    named = keep(named.withColumn("block", F.row_number().over(W.orderBy(F.col("v")[0])) - 1).withColumn("n", F.size("v")))  # a row for each block
    side = lambda b: named.select(F.col("block").alias(b), F.col("n").alias(f"n{b}"))
    cells = F.col("na").cast("long") * F.col("nb")
    dense = (cells <= _CELLS) & (cells <= 16 * F.col("pairs") + 65536)
    most = F.when(dense, F.greatest(F.lit(_PAIRS), 20 * cells)).otherwise(_PAIRS / 5)
    tiles = sizes.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b")
    tiles = keep(tiles.select("a", "b", "na", "nb", dense.alias("dense"), F.ceil(F.greatest((F.col("pairs") + 20 * F.col("rows")) / most, F.lit(1))).cast("int").alias("parts")))
    met = own.mapInArrow(functools.partial(_lists, least=least), f"{left} {dict(df.dtypes)[left]}, a int, b int, one array<{kind}>, two array<{kind}>")
    schema = f"i {kind}, j {kind}, x long" + (", w_i long, w_j long" if weights else "")

    def counted(some: DataFrame) -> DataFrame:
        key = ["a", "b", "part", "na", "nb", "dense"]
        lists = met.join(F.broadcast(some), ["a", "b"]).withColumn("part", F.pmod(F.hash(left), "parts")).select(*key, "one", "two")
        if weights:
            head = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            for b in ("a", "b"):
                head = head.join(named.select(F.col("block").alias(b), F.col("v").alias(f"v{b}"), F.col("w").alias(f"w{b}")), b)
            lists = lists.unionByName(head.select(*key, "va", "wa", "vb", "wb"), allowMissingColumns=True)
        return lists.groupBy(*key).applyInArrow(_tile, schema)

    half = counted(tiles.filter("parts = 1"))
    if not (large := tiles.filter("parts > 1")).isEmpty():
        half = half.unionByName(counted(large).groupBy("i", "j").agg(F.sum("x").alias("x"), *[F.first(c).alias(c) for c in ("w_i", "w_j") if weights]))
    if both:
        columns = ("i", "j", "w_i", "w_j") if weights else ("i", "j")
        there, back = F.struct(*columns), F.struct(*[F.col(b).alias(a) for a, b in zip(columns, ("j", "i", "w_j", "w_i"))])
        half = half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))).alias("p"), "x").select("p.i", "p.j", "x", *[f"p.{c}" for c in columns[2:]])
    return half.withColumn("q", F.lit((total or 0) / 2)) if weights else half


def _dealt(batch: pa.RecordBatch, least: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted lists v of a batch cut where blocks begin: for each piece its row, its block and its ends among all values."""
    lists = batch.column("v")
    length = pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(len(length)), length)
    block = np.searchsorted(least.to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False), "right") - 1
    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[start], block[start], start, np.r_[start[1:], len(row)] if len(start) else start


def _meetings(row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of pieces of a row, each with itself and those after it, a bounded number at a time."""
    after = np.searchsorted(row, row, "right") - np.arange(len(row))
    ends = np.cumsum(after)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(_MEETINGS, ends[-1] if len(ends) else 0, _MEETINGS)), len(row)])
    for s, e in zip(cuts, cuts[1:]):
        one = np.repeat(np.arange(s, e), after[s:e])
        yield one, one + np.arange(len(one)) - np.repeat(ends[s:e] - after[s:e] - (ends[s] - after[s]), after[s:e])


def _sizes(batches: Iterator[pa.RecordBatch], least: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of each tile, how many pairs and lists a task has for it."""
    n = len(least)
    pairs, rows = np.zeros(n * n), np.zeros(n * n)
    for batch in batches:
        row, block, start, end = _dealt(batch, least)
        for one, two in _meetings(row):
            tile = block[one] * n + block[two]
            pairs += np.bincount(tile, (end - start)[one].astype(float) * (end - start)[two], n * n)
            rows += np.bincount(tile, minlength=n * n)
    a, b = np.divmod(at := np.flatnonzero(rows), n)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(pairs[at].astype(np.int64)), pa.array(rows[at].astype(np.int64))], names=["a", "b", "pairs", "rows"])


def _lists(batches: Iterator[pa.RecordBatch], least: pa.Array) -> Iterator[pa.RecordBatch]:
    """For each two blocks that a row has values in, the values in both; `two` is null where the blocks are one."""
    for batch in batches:
        row, block, start, end = _dealt(batch, least)
        if not len(row):
            continue
        pieces = pa.ListArray.from_arrays(pa.array(np.r_[start, end[-1]], pa.int32()), batch.column("v").flatten())
        for first, second in _meetings(row):
            size = np.cumsum((end - start)[first] + (end - start)[second])
            cuts = np.unique([0, *np.searchsorted(size, np.arange(_CHUNK, size[-1], _CHUNK)), len(first)])
            for s, e in zip(cuts, cuts[1:]):
                one, two = first[s:e], second[s:e]
                columns = [batch.column(0).take(pa.array(row[one])), pa.array(block[one], pa.int32()), pa.array(block[two], pa.int32()), pieces.take(pa.array(one)), pieces.take(pa.array(two, mask=one == two))]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "a", "b", "one", "two"])


class _Places:
    """Values numbered in the order they come."""

    def __init__(self) -> None:
        self.sorted: np.ndarray | None = None

    def of(self, values: pa.Array) -> np.ndarray:
        some, back = np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)
        if self.sorted is None:
            self.sorted, self.place = some[:0], np.zeros(0, np.int64)
        at = np.searchsorted(self.sorted, some)
        new = np.ones(len(some), bool)
        inner = at < len(self.sorted)
        new[inner] = self.sorted[at[inner]] != some[inner]
        if new.any():
            self.sorted = np.insert(self.sorted, at[new], some[new])
            self.place = np.insert(self.place, at[new], len(self.place) + np.arange(new.sum()))
            at = np.searchsorted(self.sorted, some)
        return self.place[at][back]

    def rank(self) -> np.ndarray:
        """By place, the value's number in order."""
        out = np.empty(len(self.place), np.int64)
        out[self.place] = np.arange(len(out))
        return out


def _tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a tile, from lists of values (one, two); a row may bring the weights of the values (va, wa, vb, wb)."""
    a, b, _, na, nb, dense = (k.as_py() for k in key)
    counts = np.zeros(na * nb if dense else 0, np.int64)
    some, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size, heads = [], 0, {}
    rows = _Places()
    columns = rows if a == b else _Places()
    kind = None

    def added(some: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([some, *held]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([times, np.ones(size, np.int64)]), len(codes)).astype(np.int64)

    for batch in batches:
        for c in ("va", "wa", "vb", "wb"):
            if c in batch.schema.names and len(got := batch.column(c).drop_null()):
                heads[c] = got.flatten().to_numpy(zero_copy_only=False)
        batch = batch.filter(pc.is_valid(batch.column("one")))
        kind = batch.schema.field("one").type.value_type
        names = ["one", "one" if a == b else "two"]
        la, lb = (pc.list_value_length(batch.column(c)).to_numpy() for c in names)
        one = rows.of(batch.column("one").flatten())
        two = one if a == b else columns.of(batch.column("two").flatten())
        row = np.repeat(np.arange(len(la)), la)
        reps = lb[row].astype(np.int64)
        first = (np.cumsum(lb, dtype=np.int64) - lb)[row]
        if a == b:  # each value with itself and those after it in its list: half of the pairs, the others are the same
            first, reps = np.arange(len(row)), first + reps - np.arange(len(row))
        ends = np.cumsum(reps)
        cuts = [0, *np.searchsorted(ends, np.arange(_CHUNK, ends[-1] if len(ends) else 0, _CHUNK)), len(reps)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            r = reps[s:e]
            at = np.arange(r.sum()) + np.repeat(first[s:e] - (np.cumsum(r) - r), r)
            u, v = np.repeat(one[s:e], r), two[at]
            held.append(u * nb + v if a != b else np.minimum(u, v) * nb + np.maximum(u, v))
            size += len(at)
            if size >= _CHUNK:
                if dense:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                else:
                    some, times = added(some, times)
                held, size = [], 0
    if size:
        if dense:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        else:
            some, times = added(some, times)
    codes = np.flatnonzero(counts) if dense else some
    if not len(codes):
        return
    ranks = rows.rank(), columns.rank()
    weigh = [heads[w][np.searchsorted(heads[v], p.sorted)] for v, w, p in (("va", "wa", rows), ("vb", "wb", columns)) if v in heads]
    for s in range(0, len(codes), 500_000):
        code = codes[s : s + 500_000]
        x = counts[code] if dense else times[s : s + 500_000]
        i, j = np.divmod(code, nb)
        i, j = ranks[0][i], ranks[1][j]
        if a == b:
            i, j = np.minimum(i, j), np.maximum(i, j)
        out = {"i": pa.array(rows.sorted[i], kind), "j": pa.array(columns.sorted[j], kind), "x": pa.array(x)}
        if weigh:
            out |= {"w_i": pa.array(weigh[0][i]), "w_j": pa.array(weigh[1][j])}
        yield pa.RecordBatch.from_pydict(out)


def fulltext_index(df: DataFrame, id_col: str, text_col: str, least: int = 2) -> DataFrame:
    """An inverted index of distinct lower-case words of at least `least` characters."""
    words = F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}_']+"), lambda w: F.length(w) >= least))
    return df.select(id_col, F.explode(words).alias("word"))


def match_all(index: DataFrame, id_col: str, terms: DataFrame, term_id: str, words: str) -> DataFrame:
    """(term_id, id) where the row has all words of the term: equi-join on words, then a count."""
    t = terms.select(term_id, F.explode(F.array_distinct(words)).alias("word"))
    need = t.groupBy(term_id).agg(F.count("*").alias("__need"))
    return t.join(index, "word").groupBy(term_id, id_col).agg(F.count("*").alias("__n")).join(need, term_id).filter("__n = __need").select(term_id, id_col)
