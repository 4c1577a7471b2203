"""Near-duplicate detection by Order MinHash with verification by banded alignment.

A text's k-mers are its shingles of ``SHINGLE`` words, each labelled with how often it occurred
before. A sketch takes the ``SMALLEST`` labelled k-mers with the least hashes under a function of its
own and keeps them in text order, so it is sensitive to order as the edit distance is. A band is ``ROWS``
minima over the set of shingles, whatever their order and number. Texts with a sketch or a band in
common are candidates; of pairs whose shingle sets are ``SIMILAR`` (0.8), 2 in 10,000 have no band in common,
and of those that also keep their order 5 in 10^8 have nothing in common.
A candidate pair is linked if the Jaccard similarity of the shingle sets is at least ``SIMILAR``, or
if the shingles aligned inside the band that this leaves room for are that share of all of both.

Equal texts are one node, so copies cost nothing more. Candidates are compared in two steps, each with
rows in proportion to the members of the buckets:

1. Every node is compared with one leader: of the bucket leaders, the nodes that are in the most and largest
   buckets, the one that it has most buckets in common with.
2. Nodes in buckets that still hold several components get prefix buckets: under one order of all shingles,
   rare ones first, two texts as similar as ``SIMILAR`` share one of their first shingles, as many as may
   be missing and one more. From a common shingle on, what is left of both texts bounds their similarity.
   Members that, by this bound, fit no size that another component has in the bucket are left out; what
   remains is compared, all but pairs inside a component. This loses no pair, neither of sets nor of
   labelled shingles, and takes the place of comparing all members of a bucket. Where many pairs remain,
   leaders are compared first as in step 1, until that no longer helps.

Null texts are empty, and all texts without a word that are equal are copies. A document's class
is the smallest id in its component (null if all are null).
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bitmaps, fresh, in_bitmaps, maybe, text_of, trim
from .shingles import Shingled, mix, shingled, words

SHINGLE, SIMILAR = 5, 0.8
SKETCHES, SMALLEST = 16, 4
BANDS, ROWS = 16, 4
#: Counters of how often shingles occur, for the order of prefix filtering.
COUNTERS = 1 << 20
#: Pairs left per member of the prefix buckets from which on leaders are compared first.
CROWDED = 16
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 32, SKETCHES, np.uint32) | np.uint32(1)
_BAND_SEEDS = np.random.default_rng(20240301).integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_FOLD, _GONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFFFFFFFFFF)


def _of(w: list[str]) -> Shingled | None:
    return next(shingled([" ".join(w)], SHINGLE), None)


def distinct(w: list[str]) -> np.ndarray:
    """Hashes of the set of shingles."""
    s = _of(w)
    return np.empty(0, np.uint64) if s is None else s.distinct()[0]


def kmers(w: list[str]) -> np.ndarray:
    """Hashes of the shingles, each labelled with its number of earlier occurrences."""
    s = _of(w)
    return np.empty(0, np.uint64) if s is None else s.labelled


def _ordered(h: np.ndarray, seed: np.uint32) -> np.ndarray:
    """The hashes under a function of their own."""
    own = (h >> np.uint64(32)).astype(np.uint32) * seed
    own ^= own >> np.uint32(15)
    return own * np.uint32(0x9E3779B1)


def sketches(h: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """A row of keys for each text, whose labelled k-mers lie end to end, ``n`` of each; for a single text just its keys, none without words."""
    if n is None:
        return sketches(h, np.array([len(h)]))[0] if len(h) else np.empty(0, np.int64)
    starts = np.cumsum(n) - n
    position = (np.arange(len(h)) - np.repeat(starts, n)).astype(np.uint64)
    out = np.empty((len(n), SKETCHES), np.uint64)
    for i, seed in enumerate(_SEEDS):
        own = (_ordered(h, seed).astype(np.uint64) << np.uint64(32)) | position
        places = np.empty((len(n), SMALLEST), np.int64)
        for j in range(SMALLEST):
            least = np.minimum.reduceat(own, starts)
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            there = least != _GONE  # else the text has fewer k-mers
            own[(starts + at)[there]] = _GONE
            places[:, j] = np.where(there, at, 1 << 40)
        places.sort(axis=1)
        key = np.full(len(n), i, np.uint64)
        for j in range(SMALLEST):
            there = places[:, j] < 1 << 40
            key[there] = key[there] * _FOLD + h[(starts + places[:, j])[there]]
        out[:, i] = key
    return mix(out).view(np.int64)


def bands(h: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """The same for bands of sets of shingles."""
    if n is None:
        return bands(h, np.array([len(h)]))[0] if len(h) else np.empty(0, np.int64)
    starts = np.cumsum(n) - n
    out = np.empty((len(n), BANDS), np.uint64)
    for i in range(BANDS):
        key = np.full(len(n), SKETCHES + i, np.uint64)
        for seed in _BAND_SEEDS[i * ROWS : (i + 1) * ROWS]:
            key = key * _FOLD + np.minimum.reduceat(_ordered(h, seed), starts)
        out[:, i] = key
    return mix(out).view(np.int64)


@lru_cache(32)
def _parts(text: str) -> tuple[list[str], Counter, set[tuple]]:
    w = words(text)
    k = min(SHINGLE, len(w))
    return w, Counter(w), set(zip(*[w[i:] for i in range(k)], strict=False))


@lru_cache(32)
def _shingles(text: str) -> tuple[list[tuple], Counter]:
    w = words(text)
    k = min(SHINGLE, len(w))
    s = list(zip(*[w[i:] for i in range(k)], strict=False))
    return s, Counter(s)


def banded_lcs(a: list, b: list, band: int) -> int:
    """Longest common subsequence over matches at most ``band`` off the diagonal, a row of bits for each item of b."""
    begin, stop = 0, min(len(a), len(b))
    while begin < stop and a[begin] == b[begin]:
        begin += 1
    back = 0
    while back < stop - begin and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[begin : len(a) - back], b[begin : len(b) - back]
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    every = (1 << len(a)) - 1
    row = every
    for j, y in enumerate(b):
        match = 0
        for i in places.get(y, ()):
            if -band <= i - j <= band:
                match |= 1 << i
        if match:
            use = row & match
            row = ((row + use) | (row - use)) & every
    return begin + back + len(a) - row.bit_count()


def similarity(x: str, y: str, least: float = SIMILAR) -> float:
    """Aligned share of the longer text's words; of pairs that cannot reach ``least``, an upper bound below it.

    Texts whose shingle sets are similar although their order differs get the sets' Jaccard similarity.
    Looser than ``shingle_similarity``, which decides the links.
    """
    (a, in_a, set_a), (b, in_b, set_b) = _parts(x), _parts(y)
    if not a or not b:
        return float(not a and not b and x == y)
    longer = max(len(a), len(b))
    aligned = sum((in_a & in_b).values()) / longer
    if aligned >= least:
        aligned = banded_lcs(a, b, int((1 - least) * longer) + 1) / longer
    if aligned < least:
        common = len(set_a & set_b)
        aligned = max(aligned, common / (len(set_a) + len(set_b) - common))
    return aligned


def shingle_similarity(x: str, y: str, least: float = SIMILAR) -> float:
    """Jaccard similarity of the shingle sets or, if that is below ``least``, the aligned share of all shingles of both where it is more."""
    (a, in_a), (b, in_b) = _shingles(x), _shingles(y)
    if not a or not b:
        return float(not a and not b and x == y)
    common = len(in_a.keys() & in_b.keys())
    found = common / (len(in_a) + len(in_b) - common)
    if found < least and (len(a) > len(in_a) or len(b) > len(in_b)):  # else no more can be aligned
        common = sum((in_a & in_b).values())
        if common / (len(a) + len(b) - common) >= least:
            band = int((1 - least) / (1 + least) * (len(a) + len(b))) + 1  # indels that `least` leaves room for
            common = banded_lcs(a, b, band)
            found = max(found, common / (len(a) + len(b) - common))
    return found


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Nodes of edges (a, b) and ``component``, the smallest node that they reach: labels spread and jump until none changes.

    ``edges`` is read in every step: pass a written table. Joins on nodes that most edges meet in are left
    to sort-merge, whose large partitions adaptive execution splits.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy(F.col("a").alias("_a")).agg(F.min("component").alias("_near"))
        spread = labels.join(near, F.col("node") == F.col("_a")).select("node", "component", F.least("component", "_near").alias("next"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c")).hint("merge")
        moved = work.table(spread.join(jump, F.col("next") == F.col("_n")).select("node", F.least("next", "_c").alias("component"), (F.least("next", "_c") != F.col("component")).alias("moved")))
        work.drop(labels)
        labels = moved
        if moved.where("moved").isEmpty():
            return moved.select("node", "component")


def shared(members: DataFrame, work: Workspace) -> DataFrame:
    """Rows of ``members`` (h, node, ...) whose key h several nodes have, and ``size``, the number of those.

    A filter of bounded size keeps keys that only one node has out of the shuffle, as far as it goes.
    """
    own = F.xxhash64("node")
    often = members.groupBy("h").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo != hi").select("h")
    near = work.table(maybe(members, bitmaps(often, work)).distinct())
    sizes = near.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("size")).where("size > 1")
    return near.join(sizes.hint("merge"), F.col("h") == F.col("_h")).drop("_h")


def first_shingles(h: np.ndarray, n: np.ndarray, often: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of hashes, end to end and ``n`` of each, those that cannot all be missing in a set that is ``least`` similar, rare ones first:
    the hashes, the numbers of their sets and their places in the order."""
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, often[counters(h)], doc))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    keep = place < np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)
    return h[order[keep]], doc[keep], place[keep]


def counters(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(COUNTERS)).astype(np.int64)


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """Members (h, node, component, total, most) of a bucket for each first shingle of the texts' sets and, where shingles repeat, of the labelled ones.

    ``total`` is the number of shingles, ``most`` the largest one of a partner with which the shingles from this one on are enough.
    """
    spark, slots = texts.sparkSession, COUNTERS

    def counted(batches):
        often = np.zeros(slots, np.int64)
        for batch in batches:
            for s in shingled(batch["text"], SHINGLE):
                often += np.bincount(counters(s.labelled), minlength=slots)
        at = np.flatnonzero(often)
        yield pd.DataFrame({"slot": at, "n": often[at]})

    # any order does for all texts alike, so shingles may share a counter
    found = texts.select("text").mapInPandas(counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(slots, np.int64)
    often[found["slot"].to_numpy()] = found["n"].to_numpy()
    handle = spark.sparkContext.broadcast(often)

    def firsts(batches):
        for batch in batches:
            nodes, parts = batch["node"].to_numpy(), batch["component"].to_numpy()
            for s in shingled(batch["text"], SHINGLE):
                h, kinds = s.distinct()
                again = s.n > kinds  # a pair can only align more than its sets share if both repeat shingles
                both = [(h, kinds, s.rows), (s.labelled[np.repeat(again, s.n)], s.n[again], s.rows[again])]
                for family, (h, n, rows) in enumerate(both):
                    h, doc, place = first_shingles(h, n, handle.value, least)
                    total = n[doc]
                    most = np.floor((1 + least) / least * (total - place) - total + 1e-6)
                    yield pd.DataFrame({"h": mix(h + np.uint64(family)).view(np.int64), "node": nodes[rows[doc]], "component": parts[rows[doc]], "total": total, "most": most.astype(np.int64)})

    return texts.select("node", "component", "text").mapInPandas(firsts, "h bigint, node bigint, component bigint, total bigint, most bigint")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """Rows id, node (binary digest of the text), component (a number) and class_id of all documents; component is null for texts like no other."""
    spark = docs.sparkSession
    work = Workspace(spark, "near")

    @F.arrow_udf("struct<keys: array<bigint>, n: int, kinds: int>")
    def sketched(texts: pa.Array) -> pa.Array:
        kinds_of = texts.dictionary_encode()
        which, distinct_texts = kinds_of.indices.to_numpy(), kinds_of.dictionary.to_pylist()
        width = SKETCHES + BANDS
        keys, n, kinds = np.zeros((len(distinct_texts), width), np.int64), np.zeros(len(distinct_texts), np.int32), np.zeros(len(distinct_texts), np.int32)
        for s in shingled(distinct_texts, SHINGLE):
            h, sizes = s.distinct()
            keys[s.rows] = np.concatenate((sketches(s.labelled, s.n), bands(h, sizes)), axis=1)
            n[s.rows], kinds[s.rows] = s.n, sizes
        # of equal texts in a batch one gets the keys
        first = np.zeros(len(which), bool)
        first[np.unique(which, return_index=True)[1]] = True
        first &= n[which] > 0
        trim()
        offsets = np.concatenate(([0], np.cumsum(first * width))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[which[first]].ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(n[which]), pa.array(kinds[which])], names=["keys", "n", "kinds"])

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([shingle_similarity(x, y, least) >= least for x, y in zip(a, b, strict=True)], dtype=bool)
        _shingles.cache_clear()
        trim()
        return out

    keyed = docs.select(F.col(id).alias("id"), F.unhex(F.md5(text_of(text))).alias("digest"), text_of(text).alias("text"))
    rows = work.table(keyed.select("id", "digest", sketched.asNondeterministic()("text").alias("s")))
    kinds_of_text = rows.groupBy("digest").agg(F.min("id").alias("id"), F.max("s.n").alias("n"), F.max("s.kinds").alias("kinds"))
    keys = work.table(shared(rows.select(F.explode("s.keys").alias("h"), F.col("digest").alias("node")), work))

    # nodes with a bucket in common with others get a number, and their texts are fetched
    weight = keys.groupBy(F.col("node").alias("_n")).agg(F.sum(F.log2("size")).alias("weight"))
    own = kinds_of_text.join(weight, F.col("digest") == F.col("_n")).drop("_n")
    own = work.table(own.withColumn("node", F.monotonically_increasing_id()))
    number = own.select(F.col("digest").alias("_d"), F.col("id").alias("_i"), F.col("node"))
    there = bitmaps(own.select(F.xxhash64("digest").alias("h")), work)
    held = maybe(keyed.withColumn("h", F.xxhash64("digest")), there).join(number, (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i")))
    texts = work.table(held.select("node", "text").dropDuplicates(["node"]))
    members = work.table(keys.select("h", F.col("node").alias("_d")).join(own.drop("id"), F.col("_d") == F.col("digest")).select("h", "node", "n", "kinds", "weight"))
    work.drop(keys, there)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) that are similar. They come ordered by a, so the same text is there many times in a row."""
        one = pairs.join(texts.select(F.col("node").alias("_nb"), F.col("text").alias("tb")).hint("merge"), F.col("b") == F.col("_nb"))
        both = one.join(texts.select(F.col("node").alias("_na"), F.col("text").alias("ta")).hint("merge"), F.col("a") == F.col("_na"))
        return both.where(similar("ta", "tb")).select(*pairs.columns)

    def led(pairs: DataFrame) -> DataFrame:
        """For each b of the pairs (a, b, weight) the a that it is paired with most often, of several the one with the most weight."""
        often = pairs.groupBy("b", "a").agg(F.count("*").alias("times"), F.max("weight").alias("weight"))
        return often.groupBy("b").agg(F.max(F.struct("times", "weight", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")

    # step 1
    fits = lambda x, y: F.least(x, y) >= F.lit(least - 1e-9) * F.greatest(x, y)
    tops = members.groupBy(F.col("h").alias("_h")).agg(F.max(F.struct("weight", "node", "n", "kinds")).alias("top"))
    star = members.join(tops.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("node") != F.col("top.node")) & (fits(F.col("n"), F.col("top.n")) | fits(F.col("kinds"), F.col("top.kinds"))))
    pairs = work.table(led(star.select(F.col("top.node").alias("a"), F.col("node").alias("b"), F.col("top.weight").alias("weight"))))
    linked = work.table(verified(pairs))
    component_of = components(linked, work)
    work.drop(pairs, linked)

    def label(df: DataFrame) -> DataFrame:
        found = component_of.select(F.col("node").alias("_l"), F.col("component").alias("_c"))
        return df.join(found, F.col("node") == F.col("_l"), "left").withColumn("component", F.coalesce("_c", "node")).drop("_l", "_c")

    def link(pairs: DataFrame) -> None:
        """Verifies pairs (a, b, ca, cb) of nodes and their components and joins the components of those that are similar."""
        nonlocal component_of
        pairs = work.table(pairs)
        new = work.table(verified(pairs).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if not new.isEmpty():
            moves = components(new, work)
            to = moves.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
            old = component_of.join(to.hint("merge"), F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component"))
            component_of = work.table(old.unionByName(moves.join(component_of.select("node"), "node", "left_anti")))
        work.drop(pairs, new)

    # step 2
    labelled = label(members.select("h", "node"))
    mixed = labelled.groupBy(F.col("h").alias("_h")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("_h")
    some = work.table(labelled.join(mixed.hint("merge"), F.col("h") == F.col("_h")).select("node", "component").distinct())
    work.drop(members)
    if not some.isEmpty():
        made = work.table(prefixes(texts.join(some, "node"), least))
        left = work.table(shared(made, work).drop("size"))
        work.drop(made)
        before = None
        while True:
            again = work.table(fitting(left))
            work.drop(left)
            per = again.groupBy("h").agg(F.count("*").alias("n")).agg(F.sum("n").alias("members"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()
            count, pairs = per["members"] or 0, per["pairs"] or 0
            if not count:
                break
            crowded = pairs > CROWDED * count and (before is None or pairs < before / 2)
            link(led_pairs(again, led) if crowded else other_pairs(again))
            if not crowded:
                break
            # components only grow, so a member that fits no other one now never will
            before, left = pairs, work.table(label(again.drop("component")))
            work.drop(again)

    classes = component_of.join(own.select("node", "id"), "node").groupBy(F.col("component").alias("_c")).agg(F.min("id").alias("_class"))
    named = component_of.join(classes.hint("merge"), F.col("component") == F.col("_c")).join(own.select("node", F.col("digest").alias("_d")), "node").select("_d", "component", "_class")
    every = kinds_of_text.join(named, F.col("digest") == F.col("_d"), "left").select(F.col("digest").alias("_digest"), "component", F.coalesce("_class", "id").alias("class_id"))
    every = work.table(every)  # so that the next join stands alone and a digest of many copies is split
    out = rows.select("id", "digest").join(every.hint("merge"), F.col("digest") == F.col("_digest")).select("id", F.col("digest").alias("node"), "component", "class_id")
    return work.only(out)


def fitting(members: DataFrame) -> DataFrame:
    """Members (h, node, component, total, most) that fit, by size, a member of another component in their bucket.

    ``most`` is the largest total that the bound allows a partner. So a member needs a partner of at most that
    total whose own ``most`` is at least the member's total. Each bucket is summed up by component and these by
    the least total and the largest ``most`` of all components and of all but the one that has it.
    """
    part = members.groupBy("h", "component").agg(F.min("total").alias("lo"), F.max("most").alias("hi"))
    best = part.groupBy(F.col("h").alias("_h")).agg(F.min(F.struct("lo", "component")).alias("l"), F.max(F.struct("hi", "component")).alias("u"), F.count("*").alias("kinds")).where("kinds > 1")
    rest = part.join(best.hint("merge"), F.col("h") == F.col("_h"))
    other = lambda x, end: F.when(F.col("component") != F.col(f"{x}.component"), F.col(end))
    second = rest.groupBy("_h").agg(F.first("l").alias("l"), F.first("u").alias("u"), F.min(other("l", "lo")).alias("lo2"), F.max(other("u", "hi")).alias("hi2"))
    lo = F.when(F.col("component") == F.col("l.component"), F.col("lo2")).otherwise(F.col("l.lo"))
    hi = F.when(F.col("component") == F.col("u.component"), F.col("hi2")).otherwise(F.col("u.hi"))
    return members.join(second.hint("merge"), F.col("h") == F.col("_h")).where((lo <= F.col("most")) & (hi >= F.col("total"))).select(*members.columns)


def other_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) of different components in a bucket that the bound allows."""
    a = members.select(*[F.col(c).alias(f"_{c}") for c in members.columns])
    on = (F.col("h") == F.col("_h")) & (F.col("_node") < F.col("node")) & (F.col("_component") != F.col("component"))
    on = on & (F.col("total") <= F.col("_most")) & (F.col("_total") <= F.col("most"))
    return members.join(a, on).select(F.col("_node").alias("a"), F.col("node").alias("b"), F.col("_component").alias("ca"), F.col("component").alias("cb")).distinct()


def led_pairs(members: DataFrame, led) -> DataFrame:
    """Pairs (a, b, ca, cb) of each node and the bucket leader that it meets most often; leaders have the largest ``most`` beyond their total."""
    tops = members.groupBy(F.col("h").alias("_h")).agg(F.max(F.struct((F.col("most") - F.col("total")).alias("room"), "node", "component")).alias("top"))
    star = members.join(tops.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("top.component") != F.col("component")))
    best = led(star.select(F.col("top.node").alias("a"), F.col("node").alias("b"), F.col("top.room").alias("weight")))
    known = members.select(F.col("node").alias("_n"), "component").distinct()
    for node, component in (("a", "ca"), ("b", "cb")):
        best = best.join(known.select("_n", F.col("component").alias(component)).hint("merge"), F.col(node) == F.col("_n")).drop("_n")
    return best.select("a", "b", "ca", "cb")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id (nulls last), of equal ids that with the smallest digest.

    Of the documents only those that go, and as many others as the filter lets through, are shuffled.
    """
    work = Workspace(docs.sparkSession, "near")
    near = near_duplicates(docs, text, id, least)
    alone = F.when(F.col("component").isNull(), F.col("node"))
    found = near.select("id", "node", F.xxhash64("component", alone).alias("k"), "component", alone.alias("alone"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))
    kept = found.groupBy(*[F.col(c).alias(f"_{c}") for c in ("k", "component", "alone")]).agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    same = (F.col("k") == F.col("_k")) & F.col("component").eqNullSafe(F.col("_component")) & F.col("alone").eqNullSafe(F.col("_alone"))
    extra = work.table(found.join(kept.hint("merge"), same).select("id", "node", (order == F.col("o")).alias("is_first")))
    work.drop(near)
    gone = work.table(extra.where("not is_first").select(F.col("id").alias("_i"), F.col("node").alias("_n")).distinct())
    twice = not extra.where("is_first").groupBy("id", "node").count().where("count > 1").isEmpty()
    work.drop(extra)
    i, n, digest, key, flag = fresh(docs, "_i", "_n", "_digest", "_key", "_flag")
    there = bitmaps(gone.select(F.xxhash64("_i", "_n").alias("h")), work)
    gone = gone.withColumnsRenamed({"_i": i, "_n": n})
    named = docs.withColumn(digest, F.unhex(F.md5(text_of(text)))).withColumn(key, F.xxhash64(id, digest))
    flagged = in_bitmaps(named, there, key, flag)
    some = flagged.where(F.col(flag))
    some = some.join(gone.hint("merge"), some[id].eqNullSafe(gone[i]) & (some[digest] == gone[n]), "left_anti")
    out = flagged.where(~F.col(flag)).unionByName(some).select(*docs.columns)
    return out.dropDuplicates([id, text]) if twice else out  # rows that repeat a kept one
