"""Quality rules: fixed base rules and thresholds that follow each language and source.

Every metric is a count ratio in thousandths. A group's metrics go into quantile sketches of
counts per bucket: exactly mergeable by addition, the same in whatever order partitions are
merged, and off by less than one bucket. A bucket is a number's first ``BITS`` bits: numbers of
no more are buckets of their own, and larger ones, without a top, are off by 1 in 16,384 at most. A group's fence is its upper
quartile plus ``SPREAD`` times the interquartile range, with a least distance. A language's
quartiles are blended with those of all documents, and a language and source's with its language's:
of n documents, own quartiles weigh n / (n + ``PRIOR``), so no size of a group switches its fence.
Documents above a fence of theirs are rejected by the joined filter.

Null and empty texts have no words and fail the base rules. Null languages and sources are
groups of their own. Rows that repeat are judged alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, text_of, trim

BITS, SPREAD = 15, 4
#: Documents that a group's parent counts as in its quartiles.
PRIOR = 50
#: Metric (thousandths) to the least distance between the upper quartile and the fence.
METRICS = {"symbols": 100, "marks": 400, "capitals": 120, "chars": 2_500, "dup_lines": 300, "repeats": 150}
GROUP, WINDOW, LEAST_WORDS, MOST_REPEATS = ("lang", "source"), 5, 10, 20

_SPACE = bytes([32, *range(9, 14)])
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?.,;:"
_CAPITALS = bytes(range(65, 91))


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside n-word windows that occur twice or more, first occurrences included."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    base, key, most = len(number), ids[:count], len(number)
    for i in range(1, n):
        if most >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max()) + 1
        key = key * base + ids[i : i + count]
        most *= base
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(count + 1, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    b = text.encode()
    words = b.split()
    seen: set[bytes] = set()
    dup = lines = 0
    if b"\n" in b:
        for line in b.split(b"\n"):
            if line.strip(_SPACE):
                lines += 1
                dup += line in seen
                seen.add(line)
    else:
        lines = 1 if words else 0
    lacking = lambda chars: len(b) - len(b.translate(None, chars))
    chars = len(b.translate(None, _SPACE + _CONTINUATION))
    return len(words), chars, lacking(_SYMBOLS), dup, repeated_words(words), lines, lacking(_MARKS), lacking(_CAPITALS)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def _measured(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([measure(t) for t in texts.fillna("")], columns=MEASURES)
    trim()
    return out


def measures(text: Column) -> Column:
    """Struct of the measures; evaluated once, however many of its fields are used."""
    return F.pandas_udf(_measured, ", ".join(f"{name} bigint" for name in MEASURES)).asNondeterministic()(text)


def base_failed(m: str) -> Column:
    c = lambda name: F.col(f"{m}.{name}")
    return (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATS * c("n_words"))


def buckets(m: str) -> Column:
    """Array of the metrics' buckets (their least values), in the order of METRICS; of documents with words only."""
    def ratio(a: str, b: str) -> Column:
        x = f"({m}.{a} * 1000 div greatest({m}.{b}, 1))"
        return F.expr(f"{x} - {x} % shiftleft(1L, greatest(length(bin({x})) - {BITS}, 0))")

    by = {
        "symbols": ratio("n_symbols", "n_words"), "marks": ratio("n_marks", "n_words"), "capitals": ratio("n_capitals", "word_chars"),
        "chars": ratio("word_chars", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"),
    }
    return F.array(*[by[name] for name in METRICS])


def fences(measured: DataFrame, m: str, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Columns of ``group`` (renamed g0, g1, ...) and ``fence``: array of limits in the order of METRICS."""
    keys = [f"g{i}" for i in range(len(group))]
    rows = measured.where(~base_failed(m)).select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], F.posexplode(buckets(m)).alias("metric", "bucket"))
    sketch = rows.groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))

    def quartiles(by: list[str]) -> DataFrame:
        merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*by, "metric")
        upto = merged.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("all", F.sum("n").over(whole))
        at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
        level = f"q{len(by)}"
        return upto.groupBy(*by, "metric").agg(F.struct(F.max("all").alias("n"), at(25).alias("lo"), at(75).alias("hi")).alias(level))

    levels = [quartiles(keys[:n]) for n in range(len(keys) + 1)]
    out = levels[-1]
    for n in range(len(keys) - 1, -1, -1):
        up, on = levels[n], F.col("metric") == F.col("_m")
        up = up.select(*[F.col(k).alias(f"_{k}") for k in keys[:n]], F.col("metric").alias("_m"), f"q{n}")
        for k in keys[:n]:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(up, on).drop("_m", *[f"_{k}" for k in keys[:n]])
    blended = {end: F.col(f"q0.{end}").cast("double") for end in ("lo", "hi")}
    for n in range(1, len(keys) + 1):
        q = F.col(f"q{n}")
        blended = {end: (q["n"] * q[end] + PRIOR * up) / (q["n"] + PRIOR) for end, up in blended.items()}
    margin = F.element_at(F.array(*[F.lit(x) for x in METRICS.values()]), F.col("metric") + 1)
    limit = F.col("q.hi") + F.greatest(SPREAD * (F.col("q.hi") - F.col("q.lo")), margin)
    per = out.withColumn("q", F.struct(*[x.alias(end) for end, x in blended.items()])).select(*keys, "metric", limit.alias("limit"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("metric", "limit"))), lambda x: x["limit"]).alias("fence"))


def judged(measured: DataFrame, limits: DataFrame, m: str, group: tuple[str, ...] = GROUP) -> DataFrame:
    """``measured`` and columns base_failed, kept."""
    on = F.lit(True)
    keys = [f"g{i}" for i in range(len(group))]
    columns = [c for c in measured.columns if c not in ("base_failed", "kept")]
    fence, *names = fresh(measured, "_fence", *[f"_fence_{k}" for k in keys])
    limits = limits.select(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)], F.col("fence").alias(fence))
    for c, name in zip(group, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(name))
    joined = measured.join(limits, on, "left")
    over = F.exists(F.arrays_zip(buckets(m).alias("b"), F.col(fence).alias("f")), lambda x: x["b"] > x["f"])
    kept = ~base_failed(m) & ~F.coalesce(over, F.lit(False))
    return joined.select(*columns, base_failed(m).alias("base_failed"), kept.alias("kept"))


def quality(docs: DataFrame, text: str = "text", group: tuple[str, ...] = GROUP, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text), the measures, base_failed and kept: one pass over the texts."""
    names = (*MEASURES, "base_failed", "kept")
    keep = [c for c in docs.columns if c != text and c not in names] if keep is None else keep
    work = Workspace(docs.sparkSession, "quality")
    (m,) = fresh(docs, "_m")
    measured = work.table(docs.select(*dict.fromkeys([*keep, *group]), measures(text_of(text)).alias(m)))
    return judged(measured, fences(measured, m, group), m, group).select(*keep, f"{m}.*", "base_failed", "kept")


def filter_quality(docs: DataFrame, text: str = "text", group: tuple[str, ...] = GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept. The texts are measured twice and never shuffled while the fences are small."""
    work = Workspace(docs.sparkSession, "quality")
    (m,) = fresh(docs, "_m")
    first = work.table(docs.select(*group, measures(text_of(text)).alias(m)))
    limits = work.table(fences(first, m, group))
    measured = docs.withColumn(m, measures(text_of(text)))
    mine = {c: name for c, name in zip(("base_failed", "kept"), fresh(measured, "_base_failed", "_kept"), strict=True) if c in docs.columns}
    out = judged(measured.withColumnsRenamed(mine), limits, m, tuple(mine.get(c, c) for c in group)).where("kept").drop("base_failed", "kept")
    return out.withColumnsRenamed({name: c for c, name in mine.items()}).select(*docs.columns)


def sql() -> str:
    """The query over documents in DuckDB, for distinct ids."""
    word = r"[^\x20\x09-\x0D]"
    taken = lambda chars: f"length(t) - length(translate(t, '{chars.decode()}', ''))"
    ratios = {
        "symbols": ("n_symbols", "n_words"), "marks": ("n_marks", "n_words"), "capitals": ("n_capitals", "word_chars"),
        "chars": ("word_chars", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    }
    ratio = ", ".join(f"{a} * 1000 // greatest({b}, 1)" for a, b in (ratios[name] for name in METRICS))
    levels, blended, joins = [], {end: f"q0.{end}::double" for end in ("lo", "hi")}, []
    for n in range(len(GROUP) + 1):
        by = "".join(f"{c}, " for c in GROUP[:n])
        part = f"partition by {by}metric"
        levels.append(f"""q{n} as (select {by}metric, max(total) n, min(case when 100 * upto >= 25 * total then bucket end) lo, min(case when 100 * upto >= 75 * total then bucket end) hi
from (select {by}metric, bucket, sum(sum(c)) over ({part} order by bucket) upto, sum(sum(c)) over ({part}) total from sketch group by {by}metric, bucket) group by {by}metric)""")
        if n:
            blended = {end: f"((q{n}.n * q{n}.{end} + {PRIOR} * {up}) / (q{n}.n + {PRIOR}))" for end, up in blended.items()}
        if n < len(GROUP):
            on = "".join(f" and q{n}.{c} is not distinct from q{len(GROUP)}.{c}" for c in GROUP[:n])
            joins.append(f"join q{n} on q{n}.metric = q{len(GROUP)}.metric{on}")
    last, names = f"q{len(GROUP)}", ", ".join(GROUP)
    margin = f"list_extract([{', '.join(map(str, METRICS.values()))}], {last}.metric)"
    same = " and ".join(f"b.{c} is not distinct from l.{c}" for c in GROUP)
    return rf"""with d as (select doc_id, {names}, coalesce(text, '') t from documents),
w as (select doc_id, unnest(regexp_extract_all(t, '{word}+')) word, generate_subscripts(regexp_extract_all(t, '{word}+'), 1) i from d),
x as (select doc_id, i, word{"".join(f" || ' ' || lead(word, {k}) over p" for k in range(1, WINDOW))} g from w window p as (partition by doc_id order by i)),
y as (select doc_id, i, case when g is not null and count(*) over (partition by doc_id, g) > 1 then 1 else 0 end twice from x),
z as (select doc_id, max(twice) over (partition by doc_id order by i rows {WINDOW - 1} preceding) hit from y),
r as (select doc_id, sum(hit)::bigint n_repeat_words from z group by doc_id),
f as (select *, regexp_extract_all(t, '{word}+') words, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{word}')) lines from d),
m as (select doc_id, {names}, len(words) n_words, length(array_to_string(words, '')) word_chars, {taken(_SYMBOLS)} n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines,
coalesce(n_repeat_words, 0) n_repeat_words, len(lines) n_lines, {taken(_MARKS)} n_marks, {taken(_CAPITALS)} n_capitals from f left join r using (doc_id)),
e as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATS} * n_words base_failed, [{ratio}] ratios from m),
b as (select *, list_transform(ratios, lambda x: x - x % (1::bigint << greatest(length(bin(x)) - {BITS}, 0)::bigint)) buckets from e),
u as (select {names}, unnest(buckets) bucket, generate_subscripts(buckets, 1) metric from b where not base_failed),
sketch as (select {names}, metric, bucket, count(*) c from u group by {names}, metric, bucket),
{(","+chr(10)).join(levels)},
l as (select {", ".join(f"{last}.{c}" for c in GROUP)}, {last}.metric, {blended["lo"]} lo, {blended["hi"]} hi, {margin} margin from {last} {" ".join(joins)}),
o as (select distinct doc_id from b join l on {same} where list_extract(buckets, metric) > hi + greatest({SPREAD} * (hi - lo), margin))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from o) kept from b"""
