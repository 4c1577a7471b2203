"""Benchmark decontamination by winnowing.

Both sides keep, of every window of consecutive word k-grams, the smallest hash. A span of
``WINDOW`` words that a document shares with an item has the same window of k-grams on both
sides, hence a common fingerprint, so no shared span is missed. Documents are scanned once: of
their fingerprints those go on that a filter of bounded size does not rule out. These are joined with the
items' by fingerprint, and each hit is extended to the window of words, which is compared as well, so no hit is
false. Equal texts go through the join once, and hits are put together per text.

A benchmark may have any size: its windows are a table like others. Null and empty texts have
no words and no hits. Repeated rows are judged alike. Items of equal id are one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, Workspace, bitmaps, fresh, in_bitmaps, text_of, trim
from .shingles import word_hashes

WINDOW, KGRAM = 10, 5
#: Bytes of text that are handled at once in a worker, and the power of two of bits that the filter of fingerprints has at most (16 MB).
CHUNK_BYTES, FILTER_BITS = 2 << 20, 27

#: A-Z in lower case, other ASCII but digits and letters to spaces; bytes from 0x80 up stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return _mixed(out)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    out, width = h, 1
    while width < w and len(out):
        step = min(width, w - width)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The winnowed fingerprint of each window of ``size`` words: its smallest k-gram hash."""
    k = min(KGRAM, size)
    return window_minima(kgrams(hashes, k), size - k + 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(texts: list[str]):
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Rows (h, size, words, item) of the windows of items (i, t): fingerprint, number of words, and the words themselves."""

    def cut(frames):
        for frame in frames:
            for item, text in zip(frame["i"], frame["t"], strict=True):
                w = words(text)
                if not w:
                    continue
                size = min(window, len(w))
                prints = fingerprints(word_hashes(b" ".join(w)), size).view(np.int64)
                for at in range(0, len(prints), 10_000):
                    own = [b" ".join(w[p : p + size]) for p in range(at, min(at + 10_000, len(prints)))]
                    yield pd.DataFrame({"h": prints[at : at + 10_000], "size": size, "words": own, "item": item})

    return items.mapInPandas(cut, "h bigint, size int, words binary, item string")


def _scanner(sizes: list[int], handle, bits: int):
    """UDF of a text's windows that the filter lets through: array of (h, size, words, start)."""

    @F.pandas_udf("array<struct<h: bigint, size: int, words: binary, start: int>>")
    def scan(texts: pd.Series) -> pd.Series:
        there, out = handle.value, []
        for chunk in _chunks(texts.fillna("").tolist()):
            lists = [words(t) for t in chunk]
            flat = [x for one in lists for x in one]
            hashes, ends = word_hashes(b" ".join(flat)), np.cumsum([len(x) for x in lists])
            found: list[list] = [[] for _ in lists]
            for size in sizes:
                mine = fingerprints(hashes, size)
                place = (mine & np.uint64((1 << bits) - 1)).astype(np.int64)
                at = np.flatnonzero((there[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                doc = np.searchsorted(ends, at, side="right")
                inside = at + size <= ends[doc] if len(at) else np.zeros(0, bool)
                for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                    found[d].append({"h": int(mine[p].view(np.int64)), "size": size, "words": b" ".join(flat[p : p + size]), "start": p - int(ends[d]) + len(lists[d])})
            out += found
        trim()
        return pd.Series(out)

    return scan.asNondeterministic()


def _n_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words(t)) for t in texts.fillna("")], dtype="int64")


def _merged(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in one])] for one in spans])


def hits(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, work: Workspace) -> DataFrame:
    """Rows (digest, spans, items) of the texts with windows of the benchmark."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), text_of(item_text).alias("t"))
    every = work.table(item_windows(items, window).distinct())
    sizes = sorted(r[0] for r in every.select("size").distinct().collect())  # ``window`` values at most
    filter = bitmaps(every.select("h"), work, FILTER_BITS)
    bits = np.zeros((1 << (filter._filter_bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for r in filter.collect():  # 2^FILTER_BITS bits at most
        own = np.frombuffer(r["_bits"], np.uint8)
        bits[r["_bucket"], : len(own)] = own
    scan = _scanner(sizes, docs.sparkSession.sparkContext.broadcast(bits.ravel()), filter._filter_bits)
    scanned = docs.select(F.unhex(F.md5(text_of(text))).alias("digest"), scan(text_of(text)).alias("found")).where(F.size("found") > 0)
    once = work.table(scanned).groupBy("digest").agg(F.first("found").alias("found"))
    each = once.select("digest", F.explode("found").alias("f")).select("digest", "f.*")
    # a window that most texts have stays a split join: sort-merge, with its items in one row
    owned = every.groupBy(*[F.col(c).alias(f"_{c}") for c in ("h", "size", "words")]).agg(F.collect_list("item").alias("items"))
    joined = each.join(owned.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("size") == F.col("_size")) & (F.col("words") == F.col("_words")))
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    found = joined.groupBy("digest").agg(F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = work.table(found.select("digest", F.pandas_udf(_merged, "array<struct<start: int, end: int>>")("spans").alias("spans"), "items"))
    work.drop(every, filter)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, info: str = "contamination") -> DataFrame:
    """``docs`` and a struct ``info`` of n_words, spans (hit word ranges), items (ids as strings) and n_hit.

    Only texts with hits, and as many others as a filter lets through, are shuffled.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    docs = docs.drop(info)
    found = hits(docs, benchmark, text, item_id, item_text, window, work)
    there = bitmaps(found.select(F.xxhash64("digest").alias("h")), work)
    digest, key, flag, mine, spans, items = fresh(docs, "_digest", "_key", "_flag", "_mine", "_spans", "_items")
    found = found.select(F.col("digest").alias(mine), F.col("spans").alias(spans), F.col("items").alias(items))
    named = docs.withColumn(digest, F.unhex(F.md5(text_of(text)))).withColumn(key, F.xxhash64(digest))
    flagged = in_bitmaps(named, there, key, flag)
    some = flagged.where(F.col(flag)).join(found.hint("merge"), F.col(digest) == F.col(mine), "left")
    none = flagged.where(~F.col(flag)).withColumns({spans: F.lit(None).cast(found.schema[spans].dataType), items: F.lit(None).cast("array<string>")})
    both = none.unionByName(some.drop(mine))
    out = both.withColumns({spans: F.coalesce(spans, F.expr("cast(array() as array<struct<start: int, end: int>>)")), items: F.coalesce(items, F.expr("cast(array() as array<string>)"))})
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.select(*docs.columns, F.struct(F.pandas_udf(_n_words, "bigint")(text_of(text)).alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items"), n_hit.alias("n_hit")).alias(info))


def sql() -> str:
    """The query over documents and benchmark in DuckDB."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select doc_id, {words('text')} w from documents), b as (select cast(item_id as varchar) item, {words('text')} w from benchmark),
i as (select distinct item, size, array_to_string(w[p:p + size - 1], ' ') x from (select item, w, least(len(w), {WINDOW}) size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) p from b where len(w) > 0)),
s as (select distinct size from i),
h as (select doc_id, p, i.size, item from (select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') x from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) p from d, s where len(w) >= size)) v join i on i.size = v.size and i.x = v.x),
n as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + size)) q from (select distinct doc_id, p, size from h)) group by doc_id),
m as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join m using (doc_id)"""
