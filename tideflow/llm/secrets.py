"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each text is cut at the matches of a pattern; the lengths of matches and pieces give the spans.
Every candidate value is then counted over distinct repositories and owners: a value that several
owners have in several repositories is a copied example, one that a single owner has is live-looking, others
are shared (a repository that owners mirror makes no example). Strings without a
tell-tale name (``opaque``) are reported unless the frequencies say that they are examples.

Null texts are empty. Null repositories and owners count as one of their own. Rows that repeat
are judged each on its own; the same owner counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_of

#: Fixed values of the task: kind, pattern, group of the value, least length of that group; in the order of kinds.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The same matches as the patterns above, given the least lengths; they skip hopeless starts sooner.
FAST = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
OPAQUE = r"[A-Za-z0-9_+/=-]{24,}"
#: Owners and repositories from which on a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 2
#: Numbers that are summed up at once, so that the arrays that grow stay short.
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(lengths: Column) -> Column:
    """Sums of the lengths before each place of the array, in blocks: the work grows with the number of places."""
    none = F.expr("cast(array() as array<int>)")

    def upto(items: Column, zero: Column, size) -> Column:
        first = F.struct(zero.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, first, step, lambda acc: acc["out"])

    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, upto(bs, F.lit(0), total), lambda b, at: upto(b, at, lambda x: x))))


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, kind, end, value) of a pattern's matches; code points, ends exclusive."""
    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string>>)")

    def collect(f: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            begin = x["at"] + F.length(F.get(f["pieces"], i))
            return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (begin + F.length(x["match"])).alias("end"), x["value"].alias("value"))

        places = starts(F.zip_with(F.slice(f["pieces"], 1, F.size(f["all"])), f["all"], lambda p, m: F.length(p) + F.length(m)))
        found = F.transform(F.arrays_zip(places.alias("at"), f["all"].alias("match"), f["values"].alias("value")), one)
        return F.filter(found, lambda s: F.length(s["value"]) >= least)

    return F.when(F.rlike(text, F.lit(pattern)), let(found, collect)).otherwise(none)


def looks_random(value: Column) -> Column:
    """Upper case, lower case and a digit."""
    return F.rlike(value, F.lit("[A-Z]")) & F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[0-9]"))


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", repository: Column | None = None, owner: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, base (spans of the fixed patterns) and found (all spans with verdict, owners and repositories).

    The texts are read once and never shuffled: what is found is written and only that is counted.
    """
    work = Workspace(docs.sparkSession, "secrets")
    repository = F.col("source") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    t = text_of(text)
    base = F.concat(*[spans(t, kind, i, FAST.get(kind, pattern), group, least) for i, (kind, pattern, group, least) in enumerate(BASE)])
    opaque = F.filter(spans(t, "opaque", len(BASE), OPAQUE, 0, 24), lambda s: looks_random(s["value"]))
    clear = lambda o, all_base: ~F.exists(all_base, lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))
    hashed = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))
    both = let(F.struct(base.alias("b"), opaque.alias("o")), lambda x: F.transform(F.array_sort(F.concat(x["b"], F.filter(x["o"], lambda o: clear(o, x["b"])))), hashed))
    rows = work.table(docs.select(*keep, F.monotonically_increasing_id().alias("_row"), repository.alias("_repository"), owner.alias("_owner"), both.alias("_spans")))

    each = rows.where(F.size("_spans") > 0).select("_row", "_repository", "_owner", F.explode("_spans").alias("s"))
    known = F.coalesce(F.col("_owner"), F.lit("\0null")).alias("owner"), F.coalesce(F.col("_repository"), F.lit("\0null")).alias("repository")
    held = each.select(F.col("s.hash").alias("hash"), *known).distinct()
    counts = held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    verdict = F.when(copied, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    judged = each.join(counts, F.col("s.hash") == counts["hash"]).select(
        "_row", F.struct(F.col("s.start"), F.col("s.rank"), F.col("s.kind"), F.col("s.end"), F.col("s.hash"), verdict.alias("verdict"), "owners", "repositories").alias("f"))
    shown = judged.where((F.col("f.kind") != "opaque") | (F.col("f.verdict") != "example"))
    per_row = shown.groupBy("_row").agg(F.array_sort(F.collect_list("f")).alias("_found"))
    empty = F.filter(F.col("_found"), lambda f: F.lit(True))
    out = rows.join(per_row, "_row", "left").withColumn("_found", F.coalesce(empty, F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,hash:string,verdict:string,owners:bigint,repositories:bigint>>)")))
    return out.select(*keep, F.filter("_spans", lambda s: s["kind"] != "opaque").alias("base"), F.col("_found").alias("found"))


def sql() -> str:
    """The query over documents in DuckDB (the source is the owner; documents of one text are one repository)."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate([*BASE, ("opaque", OPAQUE, 0, 24)]):
        p = FAST.get(kind, pattern).replace("'", "''")
        parts.append(f"""select doc_id, source, repo, {i} rank, '{kind}' kind,
cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) s, cast(length(m[i]) as bigint) n, v[i] v
from (select doc_id, source, repo, p, m, v, unnest(range(1, len(m) + 1)) i from (select doc_id, source, repo, string_split_regex(t, '{p}') p,
regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {group}) v from d where regexp_matches(t, '{p}')))
where length(v[i]) >= {least}""" + (" and regexp_matches(v[i], '[A-Z]') and regexp_matches(v[i], '[a-z]') and regexp_matches(v[i], '[0-9]')" if kind == "opaque" else ""))
    return f"""with d as (select doc_id, source, coalesce(text, '') t, md5(coalesce(text, '')) repo from documents),
a as ({" union all ".join(parts)}),
k as (select * from a where kind != 'opaque' or not exists (select 1 from a b where b.doc_id = a.doc_id and b.kind != 'opaque' and b.s < a.s + a.n and a.s < b.s + b.n)),
f as (select v, count(distinct coalesce(source, chr(1))) owners, count(distinct repo) repos from k group by v),
c as (select v, owners, owners >= {EXAMPLE_OWNERS} and repos >= {EXAMPLE_REPOSITORIES} copied from f),
r as (select k.*, owners, copied from k join c using (v) where kind != 'opaque' or not copied),
g as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, rank) filter (kind != 'opaque') b,
string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, rank) spans,
count(*) filter (owners = 1) n_live, count(*) filter (copied) n_example from r group by doc_id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256,
coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example from documents left join g using (doc_id)"""
