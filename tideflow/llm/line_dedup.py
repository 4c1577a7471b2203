"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of the last ``WIDTH`` lines chooses boundary lines, so these
depend on nearby lines alone and resynchronise after insertions; a line equal to the one before it is one as well, so
no run of a line is one long chunk. A chunk is what lies between two boundary lines, with both of them: neighbours
share a line, so every chunk has two lines or more and a short repeated passage holds whole chunks. A chunk of at least
``LEAST_LINES`` lines with a word whose bytes occur earlier in the corpus (smaller id, or
earlier in the same document) is removed, that is, all its lines go. Hashes only choose candidates: texts whose hash
repeats are grouped by their bytes, and where all bytes of a hash are equal, it stands for them.

Null texts count as empty and stay null if nothing is removed from them. Rows with equal id and
text are one document to the operator and come out alike. Documents that lose every line
stay, with an empty text. Nulls come before all ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bitmaps, fresh, maybe, text_of
from .secrets import let

#: Lines in the rolling hash, mean lines between boundaries, least lines with a word of a chunk that can go.
WIDTH, MEAN, LEAST_LINES = 2, 2, 2
#: Power of two of bits that the filter of repeated hashes has at most (128 MB). It only spares shuffling texts: a full one lets all through.
FILTER_BITS = 30
BASE, PRIME = 131, 2_147_483_647


def line_hashes(lines: Column) -> Column:
    """28-bit hashes."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint"))


def ends(hashes: Column) -> Column:
    """Indices of the boundary lines, the last line included."""

    def rolling(i: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for back in range(WIDTH - 1, -1, -1):
            out = (out * BASE + F.coalesce(F.when(i >= back, F.get(hashes, i - back)), F.lit(0))) % PRIME
        return out

    last = F.size(hashes) - 1
    again = lambda i: (i > 0) & (F.get(hashes, i) == F.get(hashes, i - 1))
    return F.filter(F.sequence(F.lit(0), last), lambda i: (rolling(i) % MEAN == 0) | again(i) | (i == last))


def flags(places: Column) -> Column:
    """Array that is true at the given places (ascending, from 0) and ends with the last one; built and read in linear work."""

    def upto(k: Column) -> Column:
        before = F.when(k > 0, F.get(places, k - 1)).otherwise(-1)
        return F.concat(F.array_repeat(F.lit(False), F.get(places, k) - before - 1), F.array(F.lit(True)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - 1), upto))


def chunk_hash(text: Column) -> Column:
    return F.xxhash64(text)


def lined(text: Column, body) -> Column:
    """``body`` of a struct of the text's lines and its boundary lines' indices (ends)."""
    with_ends = lambda lines: F.struct(lines.alias("lines"), let(line_hashes(lines), ends).alias("ends"))
    return let(let(F.split(text, "\n", -1), with_ends), body)


def chunks(text: Column) -> Column:
    """Array of (hash, text) of the chunks; hash is null where a chunk has too few lines with a word."""

    def cut(x: Column) -> Column:
        lines, e = x["lines"], x["ends"]

        def one(j: Column) -> Column:
            first = F.when(j > 0, F.get(e, j - 1)).otherwise(0)
            own = F.slice(lines, first + 1, F.get(e, j) - first + 1)
            return let(own, lambda o: let(F.array_join(o, "\n"), lambda t: F.struct(
                F.when(F.size(F.filter(o, lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))) >= LEAST_LINES, chunk_hash(t)).alias("hash"), t.alias("text"))))

        return F.transform(F.sequence(F.lit(0), F.size(e) - 1), one)

    return lined(text, cut)


def repeated(hashes: DataFrame, work: Workspace) -> DataFrame:
    """A filter of the values of ``h`` that occur twice or more, sized by their number."""
    often = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return bitmaps(often, work, FILTER_BITS)


def dedup_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", info: str = "line_dedup") -> DataFrame:
    """``docs`` with the text that is left, and a struct ``info`` of n_lines, n_chunks, removed_lines, removed_chunks."""
    work = Workspace(docs.sparkSession, "lines")
    numbered = F.transform(chunks(text_of(text)), lambda x, j: F.struct(j.alias("j"), x["hash"].alias("h"), x["text"].alias("t")))
    whole = F.filter(numbered, lambda x: x["h"].isNotNull())
    key = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("hash"), whole.alias("_chunks"))
    light = F.transform("_chunks", lambda x: F.struct(x["j"].alias("j"), x["h"].alias("h")))
    each = work.table(key.select("id", "hash", F.explode(light).alias("c")).select(F.struct("id", "hash", "c.j").alias("at"), F.col("c.h").alias("h")))
    bitmaps = repeated(each, work)

    def compared(candidates: DataFrame) -> DataFrame:
        """Per hash and bytes the first and last place; equal rows have equal places."""
        return candidates.groupBy("h", "t").agg(F.min("at").alias("first"), F.max("at").alias("last"))

    texts = maybe(key.select("id", "hash", F.explode("_chunks").alias("c")).select(F.struct("id", "hash", "c.j").alias("at"), F.col("c.h").alias("h"), F.col("c.t").alias("t")), bitmaps)
    groups = work.table(compared(texts).select("h", "first", "last"))
    owners = work.table(groups.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("first"), F.max("last").alias("last")))
    later = ~F.col("at").eqNullSafe(F.col("first"))
    # all bytes with such a hash are equal, so the hash stands for them
    alone = owners.where((F.col("kinds") == 1) & ~F.col("first").eqNullSafe(F.col("last"))).select("h", "first")
    extra = maybe(each, bitmaps).join(alone, "h").where(later).select("at.*")
    clashes = owners.where("kinds > 1").select("h")
    if not clashes.isEmpty():
        clashing = work.table(texts.join(clashes, "h", "left_semi"))
        extra = extra.unionByName(clashing.join(compared(clashing), ["h", "t"]).where(later).select("at.*"))
    gone = work.table(extra.groupBy("id", "hash").agg(F.sort_array(F.collect_set("j")).alias("_gone")).withColumnsRenamed({"id": "_i3", "hash": "_h3"}))
    work.drop(each, bitmaps, groups, owners)

    columns = [c for c in docs.columns if c != info]
    own, new, left_out, i3, h3 = fresh(docs, "_hash", "_new", "_gone", "_i3", "_h3")
    gone = gone.withColumnsRenamed({"_gone": left_out, "_i3": i3, "_h3": h3})
    out = docs.select(*columns, F.xxhash64(text).alias(own))
    # gone grows with the input: a join that can spill
    out = out.join(gone.hint("merge"), out[id].eqNullSafe(gone[i3]) & (out[own] == gone[h3]), "left")

    def rebuilt(x: Column) -> Column:
        return let(F.when(F.col(left_out).isNotNull(), flags(F.col(left_out))), lambda f: without(x["lines"], x["ends"], f))

    def without(lines: Column, e: Column, gone_at: Column) -> Column:
        goes = lambda j: F.coalesce(F.get(gone_at, j), F.lit(False))

        def kept_lines(j: Column) -> Column:
            """Of chunk j the lines after the boundary line that the chunk before it has, and without its own if that or the next one goes."""
            first, end = F.when(j > 0, F.get(e, j - 1) + 1).otherwise(0), F.get(e, j)
            n = end - first + F.when(goes(j + 1), 0).otherwise(1)
            return F.when(goes(j), F.slice(lines, 1, 0)).otherwise(F.slice(lines, first + 1, n))

        def told(kept: Column) -> Column:
            n, gone_chunks = F.size(lines).cast("bigint"), F.when(F.col(left_out).isNull(), 0).otherwise(F.size(left_out)).cast("bigint")
            return F.struct(F.array_join(kept, "\n").alias("text"), n.alias("n_lines"), F.size(e).cast("bigint").alias("n_chunks"), (n - F.size(kept)).alias("removed_lines"), gone_chunks.alias("removed_chunks"))

        return let(F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 1), kept_lines)), told)

    out = out.withColumn(new, lined(text_of(text), rebuilt))
    kept = F.when(F.col(left_out).isNull(), F.col(text)).otherwise(F.col(f"{new}.text"))
    return out.select(*[kept.alias(c) if c == text else F.col(c) for c in columns], F.struct(*[f"{new}.{x}" for x in ("n_lines", "n_chunks", "removed_lines", "removed_chunks")]).alias(info))


def sql() -> str:
    """The query over documents in DuckDB, for distinct ids."""
    rolled = "h"
    for back in range(1, WIDTH):
        rolled += f" + coalesce(lag(h, {back}) over w, 0) * {BASE ** back}"
    return rf"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
h as (select doc_id, i, line, ('0x' || substr(md5(line), 1, 7))::bigint h from l),
b as (select doc_id, i, line, case when (({rolled}) % {PRIME}) % {MEAN} = 0 or h = lag(h) over w then 1 else 0 end e, lead(i) over w is null last from h window w as (partition by doc_id order by i)),
c as (select doc_id, i, line, e, last, coalesce(sum(e) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) j from b),
x as (select doc_id, i, line, j from c union all select doc_id, i, line, j + 1 from c where e = 1 and not last),
k as (select doc_id, j, string_agg(line, chr(10) order by i) t, count(*) filter (regexp_matches(line, '[^\x20\x09-\x0D]')) words from x group by doc_id, j),
o as (select doc_id, j, words >= {LEAST_LINES} and row_number() over (partition by t order by doc_id, j) > 1 gone from k),
g as (select doc_id, i, any_value(line) line, bool_or(gone) gone from x join o using (doc_id, j) group by doc_id, i),
n as (select doc_id, count(*) n_chunks, count(*) filter (gone) removed_chunks from o group by doc_id)
select doc_id, count(*) n_lines, any_value(n_chunks) n_chunks, count(*) filter (gone) removed_lines, any_value(removed_chunks) removed_chunks,
sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from g join n using (doc_id) group by doc_id"""
