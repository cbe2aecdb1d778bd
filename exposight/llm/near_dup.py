"""Near-duplicate documents: min-max hashing, banding, exact confirmation, connected components.

Each permutation (multiply-add of the 64-bit shingle hash) gives both its minimum and its maximum, so 40 permutations make a
signature of 80 values; bands of 4 values find candidates.  Documents with equal sets are one class, known by the set's digest.
Within a bucket classes meet one pivot, and confirmed links merge components.  What then lies in different components is
compared pair by pair in small buckets.  In a larger one two members can only be linked if what they have of its core (the
pivot and the shingles most members have) suffices, which is checked from counts, or if they share one of their first
shingles outside it, which makes them a bucket of the next round.  So a group of copies costs about its size and no link between
different texts is lost.  A pair's sets are only fetched where its signatures agree as linked ones do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._spark import materialize, tidy
from .components import connected_components

_U = np.uint64


#: Members of a group that are asked for its core, about so many.
SOME = 64


def shingles(chunk: _words.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and bounds by row; short rows have their whole sequence."""
    hashes, bounds = chunk.ngrams(n)
    size = np.diff(chunk.bounds)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        at = bounds[short]
        hashes = np.insert(hashes, at, [_words.whole(chunk.hashes[chunk.bounds[i] : chunk.bounds[i + 1]]) for i in short])
        add = np.zeros(len(size), np.int64)
        add[short] = 1
        bounds = bounds + np.concatenate(([0], np.cumsum(add)))
    row = np.repeat(np.arange(len(size)), np.diff(bounds))
    for a, b in zip(bounds[:-1], bounds[1:]):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], np.concatenate(([0], np.cumsum(np.bincount(row[fresh], minlength=len(size)))))


def _permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = -(-bands * rows // 2)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def min_max(hashes: np.ndarray, bounds: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Signatures of non-empty sets: for each permutation its minimum, then for each its maximum."""
    start = bounds[:-1]
    lows, highs = [], []
    for a, b in zip(mult, add):
        x = hashes * a + b
        x ^= x >> _U(29)
        lows.append(np.minimum.reduceat(x, start))
        highs.append(np.maximum.reduceat(x, start))
    return np.stack(lows + highs, 1)


def _digest(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two columns."""
    return tuple(np.add.reduceat(_words.mix(hashes + _U(salt)), start).view(np.int64) for salt in (3, 5))


def _sketch(n: int, bands: int, rows: int):
    mult, add = _permutations(bands, rows)
    spread = np.random.default_rng(8).permutation(2 * len(mult))[: bands * rows].reshape(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _words.words(batch.column("text")):
                hashes, bounds = shingles(chunk, n)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                ids = batch.column("id").slice(chunk.first, len(size))
                keys, sig = np.zeros((len(size), bands), np.int64), np.zeros((len(size), bands * rows), np.int16)
                digest = np.zeros((2, len(size)), np.int64)
                if len(full):
                    start = bounds[:-1][full]
                    values = min_max(hashes, np.append(start, len(hashes)), mult, add)
                    for k in range(bands):
                        h = np.full(len(full), k, np.uint64)
                        for j in spread[k]:
                            h = _words.mix(h * _U(0x9E3779B97F4A7C15) + values[:, j])
                        keys[full, k] = h.view(np.int64)
                    sig[full] = (_words.mix(values[:, spread.ravel()]) >> _U(48)).astype(np.uint16).view(np.int16)
                    digest[:, full] = _digest(hashes, start)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), lists(keys), lists(sig)], names=["id", "n_shingles", "d1", "d2", "keys", "sig"])

    return run


#: Slots of the filter of ids whose sets are wanted: 2 MB at any size of the input; a slot shared by other ids only lets them by to the join.
SLOTS, SLOT_PART = 1 << 24, 1 << 15


def _slots(ids: DataFrame) -> np.ndarray:
    """A bit for each slot that an id falls in."""
    slot = F.pmod(F.col("id"), F.lit(SLOTS))
    parts = ids.select(F.floor(slot / SLOT_PART).alias("part"), (slot % SLOT_PART).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in parts.collect():  # SLOTS / SLOT_PART rows at most
        out[r["part"] * SLOT_PART // 8 : (r["part"] + 1) * SLOT_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sets(n: int, shared):
    """Digest and set of the rows whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            slot = batch.column("id").to_numpy() % SLOTS
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            for chunk in _words.words(batch.column("text")):
                hashes, bounds = shingles(chunk, n)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                start = bounds[:-1][full]
                d1, d2 = _digest(hashes, start)
                lists = pa.ListArray.from_arrays(np.append(start, len(hashes)).astype(np.int32), hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(size[full].astype(np.int64)), lists], names=["d1", "d2", "n_shingles", "set"])

    return run


def reaches(common, one, other, share: int, whole: int):
    """Whether sets of these sizes with so much in common are linked."""
    return whole * common >= share * (one + other - common)


def may_link(common, least, size, share: int, whole: int):
    """Whether a set with `common` of a core can be linked by that alone to any set of `least` elements or more.

    The best partner has all of `common` and nothing else, or is the smallest there is."""
    return reaches(common, F.greatest(common, least), size, share, whole)


def first_of(extras, short):
    """All but the last short - 1 of a set in order: two sets that have as many in common as either's `short` share one of these."""
    return F.slice(F.array_sort(extras), F.lit(1), F.size(extras) - short + 1)


def fewest_alike(values: int, share: int, whole: int, risk: float = 1e-9) -> int:
    """The number of equal signature values that a pair of this similarity falls short of with a probability of `risk` at most."""
    p, total = share / whole, 0.0
    for k in range(values + 1):
        total += math.comb(values, k) * p**k * (1 - p) ** (values - k)
        if total > risk:
            return k
    return values


def _joined(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) with links(a, b) between nodes added.  Only links between different components are gone through."""
    if components is None:
        return materialize(connected_components(links), "comps")
    if links.isEmpty():
        return components
    of = components.withColumnRenamed("component", "c")
    ends = links.join(of.withColumnRenamed("node", "a"), "a", "left").withColumn("a", F.coalesce("c", "a")).drop("c")
    ends = ends.join(of.withColumnRenamed("node", "b"), "b", "left").withColumn("b", F.coalesce("c", "b")).drop("c")
    new = materialize(connected_components(ends), "new").select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = components.join(new, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = new.select(F.col("component").alias("node"), F.col("root").alias("component")).join(components, "node", "left_anti")
    return materialize(moved.unionByName(fresh), "comps")


def _merged(groups: DataFrame) -> DataFrame:
    """groups(p, m, comp, n_shingles, least) with those that share members made one, about the pivot of most of them.

    That pivot stays a member, as it has met its own groups only."""
    of = materialize(connected_components(groups.select(F.col("p").alias("a"), F.col("m").alias("b"))), "merging")
    sizes = groups.groupBy("p").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    middle = sizes.join(of.withColumnRenamed("node", "p"), "p").groupBy("component").agg(F.max_by("p", F.struct("n", -F.col("p"))).alias("p"), F.min("least").alias("least"))
    members = groups.groupBy("m").agg(F.first("comp").alias("comp"), F.first("n_shingles").alias("n_shingles"))
    return members.join(of.withColumnRenamed("node", "m"), "m").join(middle, "component").select("p", "m", "comp", "n_shingles", "least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, share: int = 85, whole: int = 100, bands: int = 20, rows: int = 4, direct: int = 32, rounds: int = 8, few: int = 100_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of df.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lower-cased; a set is the distinct n-word shingles, or the
    whole sequence where there are fewer words.  Rows with whole * intersection >= share * union are linked; component_id
    is the least id reachable.  A null or empty text, or one without words, has an empty set and no links.
    Rows with a null id are returned without links (component_id null, kept false).  Rows that repeat an id are one
    document with several texts: each is linked for itself, and what either is linked with is one component.  Other
    columns are ignored; an empty table gives an empty one.

    Shingles are compared as 64-bit hashes, sets of equal digests (128 bits and the size) are one.  At a similarity of
    share/whole = 0.85 a pair is no candidate with a probability of 4e-7 (20 bands of 4), and every further member of
    a group adds chances; `fewest_alike` adds 1e-9.  Buckets of up to `direct` classes are compared pair by pair,
    larger ones by pivot and core; both are exact, `direct` only trades comparisons for rounds.  Up to `few` pairs, the
    numbers of their classes (twice as many) are broadcast to narrow a table before it is shuffled; the result is the same.
    """
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = materialize(slim.mapInArrow(tidy(_sketch(n, bands, rows)), "id long, n_shingles long, d1 long, d2 long, keys array<long>, sig array<short>"), "sketch")
    digest = ["d1", "d2", "n_shingles"]
    full = docs.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy(*digest).agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    posts = classes.select("node", "n_shingles", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("in_key")).filter("in_key > 1")
    posts = materialize(posts.join(shared, "key"), "posts")
    wanted = materialize(classes.drop("keys").join(posts.select("node").distinct(), "node", "left_semi"), "wanted")
    slots = slim.sparkSession.sparkContext.broadcast(_slots(wanted.select(F.col("rep").alias("id"))))
    sets = slim.filter("id is not null").mapInArrow(tidy(_sets(n, slots)), "d1 long, d2 long, n_shingles long, set array<long>")
    sets = materialize(sets.join(wanted.select("node", *digest), digest).groupBy(*digest, "node").agg(F.first("set").alias("set")).select("node", "set"), "sets")
    alike = fewest_alike(bands * rows, share, whole)

    def both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        """pairs(p, m), a written table, with columns of either.  Where the pairs are few, rows of others are left before the shuffle."""
        if pairs.count() <= few:
            ends = pairs.select(F.col("p").alias("node")).unionByName(pairs.select(F.col("m").alias("node"))).distinct()
            table = table.join(F.broadcast(ends), "node", "left_semi")
        for side in ("p", "m"):
            pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links (a, b) among pairs(p, m): by size, by signature, then on the full sets."""
        sized = both(materialize(pairs, "pairs"), wanted, "n_shingles", "sig")
        n_p, n_m = F.col("n_shingles_p"), F.col("n_shingles_m")
        same = F.size(F.filter(F.zip_with("sig_p", "sig_m", lambda x, y: x == y), lambda x: x))
        likely = materialize(sized.filter(reaches(F.least(n_p, n_m), n_p, n_m, share, whole) & (same >= alike)).select("p", "m", "n_shingles_p", "n_shingles_m"), "likely")
        common = F.size(F.array_intersect("set_p", "set_m"))
        return materialize(both(likely, sets, "set").filter(reaches(common, n_p, n_m, share, whole)).select(F.col("p").alias("a"), F.col("m").alias("b")), "links")

    def crossing(members: DataFrame, by: str) -> DataFrame:
        """Pairs of members(by, m, comp) in one group but not in one component."""
        one, two = members.select(by, F.col("m").alias("p"), F.col("comp").alias("cp")), members.select(by, "m", F.col("comp").alias("cm"))
        return one.join(two, by).filter("p < m and cp <> cm").select("p", "m").distinct()

    comps, left = None, 0
    for first in [True] + [False] * (rounds - 1):
        # The member that meets most others is the pivot: in a group of edited copies, the text they were made from.
        weights = posts.groupBy("node").agg(F.sum("in_key").alias("weight"))
        pivots = posts.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("p"), F.min("n_shingles").alias("least"))
        placed = materialize(posts.join(pivots, "key").select("key", "p", F.col("node").alias("m"), "n_shingles", "least", "in_key"), "placed")
        comps = _joined(comps, confirm(placed.filter("p <> m").select("p", "m").distinct()))
        state = placed.join(comps.withColumnRenamed("node", "m"), "m", "left").withColumn("comp", F.coalesce("component", "m")).drop("component")
        open_ = state.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key")
        live = materialize(state.join(open_, "key").filter("p <> m"), "live")
        comps = _joined(comps, confirm(crossing(live.filter(F.col("in_key") <= direct), "key")))
        # Groups beyond that: what each member has of its pivot, and what besides.
        groups = live.filter(F.col("in_key") > direct).groupBy("p", "m").agg(F.first("comp").alias("comp"), F.first("n_shingles").alias("n_shingles"), F.min("least").alias("least"))
        groups = materialize(groups, "groups")
        left = groups.count()
        if not left:
            break
        if first:  # groups that share members are one, so that a member in many of them is compared, and makes rows, once
            groups = materialize(_merged(groups), "merged")
        met = both(groups, sets, "set").join(groups.groupBy("p").agg(F.count("*").alias("of")), "p").withColumn("common", F.size(F.array_intersect("set_m", "set_p"))).withColumn("extras", F.array_except("set_m", "set_p")).drop("set_m", "set_p")
        met = materialize(met, "compared")
        # Any core gives exact bounds; the shingles that most of about `SOME` members have are found without going through all of a group's.
        asked = met.filter(F.pmod(F.xxhash64("m"), F.ceil(F.col("of") / SOME)) == 0)
        often = asked.select("p", F.explode("extras").alias("x")).groupBy("p", "x").agg(F.count("*").alias("often"))
        core = often.join(asked.groupBy("p").agg(F.count("*").alias("n")), "p").filter(2 * F.col("often") > F.col("n")).groupBy("p").agg(F.collect_list("x").alias("core"))
        met = met.join(core, "p", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
        met = met.withColumn("common", F.col("common") + F.size(F.array_intersect("extras", "core"))).withColumn("extras", F.array_except("extras", "core")).drop("core")
        met = materialize(met, "met")
        # Inside the core: only a member whose count of it suffices for some partner, with those whose count suffices too.
        some = met.filter(may_link(F.col("common"), F.col("least"), F.col("n_shingles"), share, whole))
        some = some.select("p", F.col("m").alias("b"), F.col("comp").alias("cb"), F.col("n_shingles").alias("nb"), F.col("common").alias("xb"))
        close = met.join(some, "p").filter(F.col("comp") != F.col("cb")).filter(reaches(F.least("common", "xb"), F.col("n_shingles"), F.col("nb"), share, whole))
        comps = _joined(comps, confirm(close.select(F.least("m", "b").alias("p"), F.greatest("m", "b").alias("m")).distinct()))
        # Outside it a member needs `short` shingles in common with a partner; with shingles in one order two partners then
        # share one among all but the last short - 1 of each.  Only those become rows: the further a member is from the core, the fewer.
        partner = F.greatest(F.col("least"), F.ceil(F.col("n_shingles") * share / whole))
        short = F.greatest(F.lit(1), F.ceil((F.col("n_shingles") + partner) * share / (share + whole)) - F.col("common"))
        met = met.withColumn("short", short.cast("int")).filter(F.size("extras") >= F.col("short")).drop("comp").join(comps.withColumnRenamed("node", "m"), "m", "left").withColumn("comp", F.coalesce("component", "m"))
        outside = materialize(met.select("p", "m", "comp", "n_shingles", F.explode(first_of(F.col("extras"), F.col("short"))).alias("x")), "outside").select(F.xxhash64("p", "x").alias("key"), F.col("m").alias("node"), "comp", "n_shingles")
        again = outside.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("in_key")).filter("c0 <> c1").select("key", "in_key")
        posts = materialize(outside.join(again, "key").select("key", "node", "n_shingles", "in_key", "comp"), "posts")
        left, pairs = posts.agg(F.count("*"), F.sum(F.col("in_key") - 1) / 2).first()
        if not left or pairs <= direct * left:  # pair by pair is in proportion to the rows
            break
    if left:  # pair by pair, as is what `rounds` have not settled
        comps = _joined(comps, confirm(crossing(posts.withColumnRenamed("node", "m"), "key")))
    # An id with several texts joins their classes.
    member = materialize(full.select("id", *digest).join(classes.select("node", *digest), digest).select("id", "node", *digest), "members")
    several = materialize(member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("id", "a"), "several")
    comps = _joined(comps, member.join(several, "id").filter("node <> a").select("a", F.col("node").alias("b")))
    of = member.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("id").alias("least_id"))
    by_class = of.select(*digest, "component").distinct().join(least, "component").select(*digest, "least_id")
    out = docs.select("id", *digest).join(by_class, digest, "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("least_id", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))
