"""Exact substring dedup by prefix-free parsing and suffix order.

Rolling-hash triggers cut every text into phrases: the trigger of a position is the smallest
k-gram hash among the ``LENGTH`` bytes from there, so it depends on those bytes alone, and a
phrase is the positions in a row that have one trigger. A phrase is taken with the bytes its last position
reaches, so each string of ``LENGTH`` bytes lies inside one phrase, and equal strings lie
inside phrases of equal trigger.

* The parse: phrases are dealt by trigger and ordered by content hash and place in the corpus.
  All but the first of equal phrases are repeats as a whole. Tasks leave equal phrases of their
  own out before the shuffle, so one passage that most texts have is a row per batch. A trigger
  of more than ``GROUP`` phrases is hot: its phrases are dealt by trigger and content.
* The dictionary: distinct phrases of one trigger are fetched and the suffixes that start in
  them are sorted by their first ``LENGTH`` bytes and then by corpus order; every suffix that is not
  the first of its string is a repeat. A phrase of a hot trigger is cut into pieces: equal strings
  have their trigger equally far from their start, so strings with that distance in one range of
  ``CLASS`` lie inside pieces that share all bytes which the range has in common, 88 or more, and
  pieces are dealt by those. Of equal pieces, tasks pass on one of a batch. Where more than ``GROUP`` pieces
  still share these bytes, they are dealt by content and sorted in batches; the first suffix of each
  string in a batch is dealt by its bytes and compared with those of the other batches, so one string
  that most texts have is a row per batch.

Hot triggers are counted in a pass of its own over the texts, hot bytes of pieces over the fetched
ones, and both are known by filters of bounded size; one that a filter takes for hot by mistake is treated
alike in all places, hence rightly.

Only hashes, places and the distinct phrases of repeated triggers are shuffled, next to one
join with the texts for each of the two passes over them.

Null texts are empty. Null ids come first. Rows with equal id and text are one document to the
operator and come out alike; rows with equal id and other text are ordered by a hash of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, bitmaps, fresh, in_bitmaps, text_of

LENGTH, KGRAM = 100, 24
#: Distances of a string's trigger from its start that a piece of a hot trigger's phrase takes together.
CLASS = 13
#: Bytes parsed at once, phrases combined at once, phrases of a trigger that is not hot, phrases sorted at once.
CHUNK, PHRASES, GROUP, BATCH = 1 << 20, 250_000, 1_000, 4_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NO_ID = -(1 << 63)

_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, CHUNK + 2 * LENGTH)
        _tables[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _tables[0], _tables[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def phrases(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts laid end to end: first and last position, trigger position, trigger hash, content hash."""
    n = len(data)
    starts = n - LENGTH + 1
    if starts < 1:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    power, inverse = _powers(n + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])))
    h = _mix((total[KGRAM:] - total[:-KGRAM]) * inverse[: n - KGRAM + 1])
    low = np.uint64((1 << 21) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    width, window = 1, LENGTH - KGRAM + 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    trigger = (least & low).astype(np.int64)
    edge = np.zeros(starts + 1, np.int64)
    long = lengths >= LENGTH
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, begins[long] + lengths[long] - LENGTH + 1, -1)
    inside = np.cumsum(edge)[:-1] > 0
    cut = np.ones(starts, bool)
    cut[1:] = (trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(cut)
    last = np.concatenate((first[1:], [starts])) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    at = trigger[first]
    content = (total[last + LENGTH] - total[first]) * inverse[first]
    layout = ((at - first) * 256 + (last - first)).astype(np.uint64)
    return first, last, at, h[at].view(np.int64), _mix(content + _mix(layout + np.uint64(1))).view(np.int64)


def _pack(position: np.ndarray, back: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Place of a phrase in its text, distance of the trigger from there, and positions after the first."""
    return (position << 14) | (back << 7) | more


def _unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return loc >> 14, (loc >> 7) & 127, loc & 127


class _Pieces:
    """Texts of a batch laid end to end in chunks; longer texts continue with an overlap."""

    def __init__(self):
        self.parts, self.rows, self.base, self.size = [], [], [], 0

    def add(self, row: int, b: bytes):
        """Yields full chunks as (data, begins, lengths, rows, bases)."""
        at = 0
        while len(b) - at >= LENGTH:
            part = b[at : at + CHUNK]
            if self.size + len(part) > CHUNK and self.parts:
                yield self.take()
            self.parts.append(part)
            self.rows.append(row)
            self.base.append(at)
            self.size += len(part)
            if at + len(part) == len(b):
                break
            at += len(part) - LENGTH + 1

    def take(self):
        lengths = np.array([len(p) for p in self.parts], np.int64)
        out = np.frombuffer(b"".join(self.parts), np.uint8), np.cumsum(lengths) - lengths, lengths, np.array(self.rows), np.array(self.base)
        self.__init__()
        return out


PARSED = "kind tinyint, trigger bigint, content bigint, id bigint, hash bigint, loc bigint"


def _parse(frames):
    """Texts to rows of kind 0 (phrases; equal ones of a batch once) and 1 (repeats: content and loc are a byte range)."""
    for frame in frames:
        ids, hashes = frame["id"].to_numpy(np.int64), frame["hash"].to_numpy(np.int64)
        found, pieces, held = [], _Pieces(), 0
        for i, b in enumerate(frame["b"]):
            for c in pieces.add(i, b):
                found.append(_placed(*c))
                held += len(found[-1][0])
            if held >= PHRASES:
                yield from _combined(found, ids, hashes)
                found, held = [], 0
        if pieces.parts:
            found.append(_placed(*pieces.take()))
        if found:
            yield from _combined(found, ids, hashes)


def _counted(frames):
    """Texts to triggers and their numbers of phrases, equal phrases of a batch once."""
    for frame in frames:
        found, pieces, held = [], _Pieces(), 0
        for b in frame["b"]:
            for c in pieces.add(0, b):
                found.append(phrases(*c[:3])[3:])
                held += len(found[-1][0])
            if held >= PHRASES:
                yield _per_trigger(found)
                found, held = [], 0
        if pieces.parts:
            found.append(phrases(*pieces.take()[:3])[3:])
        if found:
            yield _per_trigger(found)


def _per_trigger(found) -> pd.DataFrame:
    trigger, content = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((content, trigger))
    trigger, content = trigger[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1])
    trigger, n = np.unique(trigger[new], return_counts=True)
    return pd.DataFrame({"trigger": trigger, "n": n})


def _placed(data, begins, lengths, rows, base):
    first, last, at, trigger, content = phrases(data, begins, lengths)
    part = np.searchsorted(begins, first, side="right") - 1
    return trigger, content, rows[part], _pack(first - begins[part] + base[part], at - first, last - first)


def _combined(found, ids, hashes):
    trigger, content, row, loc = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(row):
        return
    ids, hashes = ids[row], hashes[row]
    order = np.lexsort((loc, hashes, ids, content, trigger))
    trigger, content, ids, hashes, loc = (x[order] for x in (trigger, content, ids, hashes, loc))
    new = np.ones(len(order), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1])
    yield pd.DataFrame({"kind": np.int8(0), "trigger": trigger[new], "content": content[new], "id": ids[new], "hash": hashes[new], "loc": loc[new]})
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = ~new & ~((ids == ids[head]) & (hashes == hashes[head]) & (loc == loc[head]))
    if again.any():
        ids, hashes, (start, _, more) = ids[again], hashes[again], _unpack(loc[again])
        ids, hashes, start, stop = union(ids, hashes, start, start + more + LENGTH)
        yield pd.DataFrame({"kind": np.int8(1), "trigger": hashes ^ ids, "content": start, "id": ids, "hash": hashes, "loc": stop})


def union(ids, hashes, start, stop):
    """Byte ranges of each document, overlapping and touching ones joined."""
    if not len(ids):
        return ids, hashes, start, stop
    order = np.lexsort((start, hashes, ids))
    ids, hashes, start, stop = ids[order], hashes[order], start[order], stop[order]
    out_first = np.zeros(len(ids), bool)
    new_doc = np.ones(len(ids), bool)
    new_doc[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    # running maximum of the stops inside each document
    shift = np.cumsum(new_doc) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift) - shift
    out_first[:] = new_doc
    out_first[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(out_first)
    end = np.concatenate((at[1:], [len(ids)])) - 1
    return ids[at], hashes[at], start[at], reach[end]


MARKED = "kind tinyint, id bigint, hash bigint, a bigint, b bigint, salt bigint"


def _marked(kind: int, ids, hashes, a, b, salt=None) -> pa.RecordBatch:
    salt = np.zeros(len(ids), np.int64) if salt is None else salt
    arrays = [np.full(len(ids), kind, np.int8), ids, hashes, a, b, salt]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", "id", "hash", "a", "b", "salt"])


def _distinct(batches):
    """Sorted phrases to repeats (kind 1: byte range a to b) and distinct phrases of shared or hot triggers (kind 2: trigger a, place b)."""
    before = None  # the last phrase's first occurrence: trigger, content, id, hash, loc, salt (of hot triggers, else 0)
    pending, shared = None, False  # a first occurrence whose successor is not known; whether its trigger is its predecessor's
    for batch in batches:
        kind, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        passed = kind == 1
        if passed.any():
            _, content, ids, hashes, loc, _ = (c[passed] for c in columns)
            yield _marked(1, ids, hashes, content, loc)
        rows = np.stack([c[~passed] for c in columns])
        if not rows.shape[1]:
            continue
        if before is not None:
            rows = np.concatenate((before[:, None], rows), 1)
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & (rows[2:] != rows[2:, head]).any(0)
        if again.any():
            start, _, more = _unpack(rows[4, again])
            yield _marked(1, *union(rows[2, again], rows[3, again], start, start + more + LENGTH))
        firsts = rows[:, new]
        if before is not None:
            firsts = firsts[:, 1:]
        before = rows[:, head[-1]].copy()
        if not firsts.shape[1]:
            continue
        if pending is not None:
            firsts = np.concatenate((pending[:, None], firsts), 1)
        follows = np.concatenate(([shared], firsts[0, 1:] == firsts[0, :-1]))
        multi = follows[:-1] | follows[1:] | (firsts[5, :-1] != 0)
        if multi.any():
            done = firsts[:, :-1][:, multi]
            yield _marked(2, done[2], done[3], done[0], done[4], done[5])
        pending, shared = firsts[:, -1].copy(), bool(follows[-1])
    if pending is not None and (shared or pending[5]):
        yield _marked(2, pending[2:3], pending[3:4], pending[0:1], pending[4:5], pending[5:6])


FETCHED = "trigger bigint, salt bigint, id bigint, hash bigint, start bigint, bytes binary"


def pieces_of(b: bytes, back: int, more: int):
    """Pieces of a phrase, by distance of the trigger from the start of a string: a hash of the bytes that all such strings share, place in the phrase, bytes."""
    for at in range((back - more) // CLASS * CLASS, back + 1, CLASS):
        far = min(at + CLASS - 1, LENGTH - KGRAM)
        key = hashlib.blake2b(b[back - at : back + LENGTH - far], digest_size=8, salt=bytes([at])).digest()
        begin, end = back - min(far, back), back - max(at, back - more) + LENGTH
        yield int.from_bytes(key, "little", signed=True), begin, b[begin:end]


def _fetch(frames):
    """Phrases' bytes from their texts, those of hot triggers in pieces, equal ones of a batch once; repeats have no bytes, and the trigger is their end."""
    columns = ["trigger", "salt", "id", "hash", "start", "bytes"]
    for frame in frames:
        out, first = [], {}
        for id, hash, b, places in zip(frame["id"], frame["hash"], frame["b"], frame["places"], strict=True):
            for p in places:
                start, back, more = p["b"] >> 14, (p["b"] >> 7) & 127, p["b"] & 127
                phrase = b[start : start + more + LENGTH]
                if not p["salt"]:
                    out.append((p["a"], 0, id, hash, start, phrase))
                else:
                    for key, begin, piece in pieces_of(phrase, back, more):
                        place = id, hash, start + begin
                        known = first.setdefault((key, piece), place)
                        if place != known:
                            first[key, piece] = min(place, known)
                            again = max(place, known)
                            out.append((again[2] + len(piece), 0, *again, None))
                if len(out) + len(first) >= 50_000:
                    yield pd.DataFrame(out + [(key, 1, *place, piece) for (key, piece), place in first.items()], columns=columns)
                    out, first = [], {}
        if out or first:
            yield pd.DataFrame(out + [(key, 1, *place, piece) for (key, piece), place in first.items()], columns=columns)


RESOLVED = "id bigint, hash bigint, a bigint, b bigint, suffix binary"


def suffixes(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Suffixes of phrases (id, hash, start, bytes): their first LENGTH bytes, ids, hashes and starts."""
    lengths = np.array([len(r[3]) for r in rows], np.int64)
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    begins = np.cumsum(lengths) - lengths
    counts = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    heads = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begins[row] + within]
    ids, hashes, starts = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return heads, ids[row], hashes[row], starts[row] + within


def ordered(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Suffixes of phrases in suffix order, then corpus order: as of ``suffixes``, whether each is the first of its LENGTH bytes, whether it repeats them."""
    heads, ids, hashes, starts = suffixes(rows)
    order = np.lexsort((starts, hashes, ids))
    heads, ids, hashes, starts = heads[order], ids[order], hashes[order], starts[order]
    ranked = np.argsort(np.ascontiguousarray(heads).view(f"V{LENGTH}")[:, 0], kind="stable")
    heads, ids, hashes, starts = heads[ranked], ids[ranked], hashes[ranked], starts[ranked]
    head = np.concatenate(([True], (heads[1:] != heads[:-1]).any(1)))
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    again = ~head & ~((ids == ids[first]) & (hashes == hashes[first]) & (starts == starts[first]))
    return heads, ids, hashes, starts, head, again


def _found(rows: list[tuple], hot: bool):
    """Repeats among the suffixes of phrases as byte ranges; of hot ones also the suffixes that others may repeat or come before."""
    heads, ids, hashes, starts, head, again = ordered(rows)
    i, h, a, b = union(ids[again], hashes[again], starts[again], starts[again] + LENGTH)
    yield pd.DataFrame({"id": i, "hash": h, "a": a, "b": b, "suffix": pd.Series([None] * len(i), dtype=object)})
    if hot:
        heads, ids, hashes, starts = heads[head], ids[head], hashes[head], starts[head]
        yield pd.DataFrame({"id": ids, "hash": hashes, "a": starts, "b": starts + LENGTH, "suffix": [x.tobytes() for x in heads]})


def _resolve(frames):
    """Phrases sorted by trigger. Whole triggers are collected and sorted, hot ones in batches as they come.

    A lone phrase repeats nothing, since no two of its strings have the trigger equally far from their start.
    """
    held, current, trigger, hot = [], [], None, []
    for frame in frames:
        for t, salt, *row in zip(frame["trigger"], frame["salt"], frame["id"], frame["hash"], frame["start"], frame["bytes"], strict=True):
            if salt:
                hot.append(tuple(row))
                if len(hot) >= BATCH:
                    yield from _found(hot, True)
                    hot = []
                continue
            if t != trigger:
                held += current if len(current) > 1 else []
                trigger, current = t, []
                if len(held) >= BATCH:
                    yield from _found(held, False)
                    held = []
            current.append(tuple(row))
    held += current if len(current) > 1 else []
    if held:
        yield from _found(held, False)
    if hot:
        yield from _found(hot, True)


def _later(batches):
    """Suffixes sorted by bytes and corpus order to those that are not first."""
    before = None
    for batch in batches:
        keep = []
        for i, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("suffix", "id", "hash", "a")), strict=True)):
            if before is None or now[0] != before[0]:
                before = now
            elif now != before:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select(["id", "hash", "a", "b"])


def number_of(docs: DataFrame, id: str) -> Column:
    """The id as a long, the least one for null. Ids that are no whole numbers are ordered by a hash of theirs."""
    whole = isinstance(docs.schema[id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(id).cast("bigint") if whole else F.when(F.col(id).isNotNull(), F.xxhash64(id)), F.lit(_NO_ID))


def repeated_ranges(docs: DataFrame, text: str, id: str, work: Workspace, group_limit: int = GROUP) -> DataFrame:
    """Byte ranges id, hash, a, b (null ids as the least long) of strings that also start earlier; they may overlap."""
    keyed = docs.select(
        number_of(docs, id).alias("id"), F.xxhash64(text_of(text)).alias("hash"), text_of(text).cast("binary").alias("b"))
    counts = keyed.select("b").mapInPandas(_counted, "trigger bigint, n bigint").groupBy("trigger").agg(F.sum("n").alias("n"))
    hot = bitmaps(counts.where(F.col("n") > group_limit).select(F.col("trigger").alias("h")), work)
    parsed = in_bitmaps(keyed.mapInPandas(_parse, PARSED), hot, "trigger", "hot")
    parsed = parsed.withColumn("salt", F.when(F.col("hot"), F.col("content").bitwiseOR(1)).otherwise(0)).drop("hot")
    order = ["kind", "trigger", "content", "id", "hash", "loc"]
    dealt = parsed.select(*order, "salt").repartition("trigger", "salt").sortWithinPartitions(*order)
    marked = work.table(dealt.mapInArrow(_distinct, MARKED))
    places = marked.where("kind = 2").groupBy("id", "hash").agg(F.collect_list(F.struct("a", "b", "salt")).alias("places"))
    fetched = work.table(keyed.join(places, ["id", "hash"]).mapInPandas(_fetch, FETCHED))
    shared = fetched.where("salt <> 0").groupBy("trigger").count().where(F.col("count") > group_limit)
    still = in_bitmaps(fetched.where("bytes is not null"), bitmaps(shared.select(F.col("trigger").alias("h")), work), "trigger", "hot")
    salt = F.when(F.col("hot") & (F.col("salt") != 0), F.xxhash64("bytes").bitwiseOR(1)).otherwise(0)
    dealt = still.withColumn("salt", salt).drop("hot").repartition("trigger", "salt").sortWithinPartitions("trigger")
    resolved = work.table(dealt.mapInPandas(_resolve, RESOLVED))
    out = marked.where("kind = 1").select("id", "hash", "a", "b").union(resolved.where("suffix is null").select("id", "hash", "a", "b"))
    out = out.union(fetched.where("bytes is null").select("id", "hash", F.col("start").alias("a"), F.col("trigger").alias("b")))
    if not resolved.where("suffix is not null").isEmpty():
        spread = resolved.where("suffix is not null").repartition("suffix").sortWithinPartitions("suffix", "id", "hash", "a")
        out = out.union(spread.mapInArrow(_later, "id bigint, hash bigint, a bigint, b bigint"))
    return out


def dedup_substrings(docs: DataFrame, text: str = "text", id: str = "doc_id", info: str = "repeats", group_limit: int = GROUP) -> DataFrame:
    """``docs`` and a struct ``info`` of n_bytes, spans (maximal removed byte ranges) and kept (the bytes that are left)."""
    work = Workspace(docs.sparkSession, "substrings")
    ranges = repeated_ranges(docs, text, id, work, group_limit)
    per = work.only(ranges.groupBy("id", "hash").agg(F.collect_list(F.struct("a", "b")).alias("_ranges")).withColumnsRenamed({"id": "_id", "hash": "_hash"}))
    own_id, own_hash, own_ranges = fresh(docs, "_id", "_hash", "_ranges")
    per = per.withColumnsRenamed({"_id": own_id, "_hash": own_hash, "_ranges": own_ranges})

    @F.pandas_udf("n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for b, r in zip(texts, ranges, strict=True):
            if r is None or not len(r):
                out.append((len(b), [], b))
                continue
            a, e = (np.array([x[k] for x in r], np.int64) for k in ("a", "b"))
            zero = np.zeros(len(a), np.int64)
            _, _, a, e = union(zero, zero, a, e)
            spans = list(zip(a.tolist(), e.tolist(), strict=True))
            edges = [0, *(x for s in spans for x in s), len(b)]
            kept = b"".join(b[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            out.append((len(b), [{"start": x, "end": y} for x, y in spans], kept))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    columns = [c for c in docs.columns if c != info]
    i, h = fresh(docs.select(*columns), "_i", "_h")
    out = docs.select(*columns, number_of(docs, id).alias(i), F.xxhash64(text_of(text)).alias(h))
    out = out.join(per, (F.col(i) == F.col(own_id)) & (F.col(h) == F.col(own_hash)), "left")
    return out.select(*columns, cut.asNondeterministic()(text_of(text).cast("binary"), F.col(own_ranges)).alias(info))
