"""URL filters by a bit-parallel wildcard automaton.

Every glob is a run of bits in one multiword Shift-And state. One pass over the bytes of a
canonical URL moves the states of all globs at once, and numpy moves a whole batch of URLs
with each step. A canonical URL is host, a separator, path.

Null URLs and those without ``://`` have an empty host and path and get the default verdict.
Rows that repeat are judged alike; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Stands between host and path in canonical URLs; the same character inside a URL is replaced.
SEPARATOR, REPLACEMENT = "\x1f", "\x1e"

_ANY = None


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains for paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        host, path = escape(self.host), escape(self.path)
        return [f"{host}{SEPARATOR}{path}*", f"*.{host}{SEPARATOR}{path}*"]


#: Fixed values of the task: longest fitting rule wins.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: (action, host glob, path glob) for URLs that no rule fits; a fitting allow outweighs a block.
GLOBS = (
    ("block", "*spam-farm*", "*"), ("block", "*cheap-pills*", "*"), ("block", "*casino*", "*"), ("block", "*", "*/ads/*"),
    ("block", "*", "*.exe"), ("block", "*", "*/wp-login*"), ("allow", "*.edu", "*"), ("allow", "*.gov", "*"),
)


def escape(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?\\" else c for c in text)


def parse_glob(glob: str) -> tuple[list[int | None], bool, set[int]]:
    """Items (a byte, or None for any), whether a star leads, and the items that a star follows."""
    items: list[int | None] = []
    leading, stars, escaped = False, set(), False
    for c in glob:
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c == "*":
            if items:
                stars.add(len(items) - 1)
            else:
                leading = True
        else:
            items += [_ANY] if c == "?" and not escaped else list(c.encode())
            escaped = False
    return items, leading, stars


class GlobSet:
    """Globs (``*`` any bytes, ``?`` one byte, backslash escapes) that must match whole strings."""

    def __init__(self, globs: Sequence[str]):
        parsed = [parse_glob(g) for g in globs]
        bits = sum(len(items) for items, _, _ in parsed)
        words = max(1, -(-bits // 64))
        self.words, self.size = words, len(parsed)
        self.by_byte = np.zeros((256, words), np.uint64)
        self.first, self.always, self.stay = (np.zeros(words, np.uint64) for _ in range(3))
        #: (word, bit) of each glob's last item; globs without items match the empty string, or anything.
        self.last: list[tuple[int, int] | None] = []
        self.bare = []
        at = 0
        for items, leading, stars in parsed:
            self.bare.append(None if items else ("any" if leading else "empty"))
            for i, item in enumerate(items):
                word, bit = divmod(at + i, 64)
                mask = np.uint64(1 << bit)
                if item is _ANY:
                    self.by_byte[:, word] |= mask
                else:
                    self.by_byte[item, word] |= mask
                if i == 0:
                    self.first[word] |= mask
                    if leading:
                        self.always[word] |= mask
                if i in stars:
                    self.stay[word] |= mask
            at += len(items)
            self.last.append(divmod(at - 1, 64) if items else None)

    def matches(self, strings: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix, a row for each string and a column for each glob."""
        n = len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        state = np.zeros((n, self.words), np.uint64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        live = n
        sorted_lengths = lengths[order]
        one, top, keep = np.uint64(1), np.uint64(63), ~self.first
        for pos in range(int(lengths.max()) if n else 0):
            while sorted_lengths[live - 1] <= pos:
                live -= 1
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            moved &= keep
            moved |= self.first if pos == 0 else self.always
            moved &= self.by_byte[data[starts[:live] + pos]]
            moved |= s & self.stay
            state[:live] = moved
        out = np.zeros((n, self.size), bool)
        for k, (last, bare) in enumerate(zip(self.last, self.bare, strict=True)):
            if last is None:
                out[:, k] = True if bare == "any" else lengths == 0
            else:
                out[order, k] = (state[:, last[0]] >> np.uint64(last[1])) & one != 0
        return out


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def glob_hits(globs: Iterable[str]):
    """Pandas UDF: array of the indices of the globs that match."""
    table = tuple(globs)

    @F.pandas_udf("array<int>")
    def hits(urls: pd.Series) -> pd.Series:
        matrix = GlobSet(table).matches([u.encode() for u in urls.fillna("")])
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in matrix], dtype=object)

    return hits


def judge(pages: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, globs: Sequence[tuple[str, str, str]] = GLOBS) -> DataFrame:
    """``pages`` and host, path, rule (the longest fitting one's name, or null) and verdict (allow or block).

    Without a shuffle. Existing columns of these names are replaced.
    """
    patterns, allow, block, by_length = [], [], [], []
    for action, host, path in globs:
        (allow if action == "allow" else block).append(len(patterns))
        patterns.append(f"{host}{SEPARATOR}{path}")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        by_length.append((rule, [len(patterns), len(patterns) + 1]))
        patterns += rule.globs()
    (u,) = fresh(pages, "_url")
    hits = F.col(f"{u}.hits")
    fits = lambda ids: F.arrays_overlap(hits, F.array(*[F.lit(i) for i in ids])) if ids else F.lit(False)
    canonical = F.concat(F.translate(F.col(f"{u}.host"), SEPARATOR, REPLACEMENT), F.lit(SEPARATOR), F.translate(F.col(f"{u}.path"), SEPARATOR, REPLACEMENT))
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    out = pages.withColumn(u, F.struct(host_of(address).alias("host"), path_of(address).alias("path")))
    out = out.withColumn(u, F.col(u).withField("hits", glob_hits(patterns)(canonical)))
    rule, verdict = F.lit(None).cast("string"), F.when(fits(allow), "allow").when(fits(block), "block").otherwise("allow")
    for r, ids in reversed(by_length):
        rule, verdict = F.when(fits(ids), r.name).otherwise(rule), F.when(fits(ids), r.action).otherwise(verdict)
    return out.withColumns({"host": F.col(f"{u}.host"), "path": F.col(f"{u}.path"), "rule": rule, "verdict": verdict}).drop(u)


def sql(rules: Sequence[Rule] = RULES, globs: Sequence[tuple[str, str, str]] = GLOBS) -> str:
    """The same for the pages table in DuckDB, with GLOB for the automaton."""
    fit = lambda r: f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"
    any_of = lambda action: " or ".join(f"(host glob '{h}' and path glob '{p}')" for a, h, p in globs if a == action) or "false"
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"when {fit(r)} then '{r.name}'" for r in ordered)
    verdict = " ".join(f"when {fit(r)} then '{r.action}'" for r in ordered)
    return f"""with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a)
select page_id, host, path, case {rule} else null end as rule,
case {verdict} when {any_of('allow')} then 'allow' when {any_of('block')} then 'block' else 'allow' end verdict from b"""
