"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Best fit decreasing depends on the piece lengths alone, and there are at most ``CAPACITY`` of
those. So the lengths are counted, and the driver packs counts: bins of equal remaining
capacity form ranges of consecutive numbers, and a segment tree over the capacities finds the
tightest open one in logarithmic time. That gives exactly the sequences that placing the
pieces one by one would, in time and memory that do not depend on the corpus. The placements
(a few thousand ranges) go back to the executors, where each piece looks up its place by its
rank among the pieces of its length.

Null texts are empty; an empty document is the end token alone. Rows that repeat are packed
each on its own.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, text_of, trim

CAPACITY, END_ID = 4096, 1
#: Chunks and words whose ids a worker remembers in a generation, and pieces of a length that one task ranks.
REMEMBERED, WORDS, RANKED = 200_000, 100_000, 1 << 20

#: The normalizer and the pre-tokenizer that ``WordTokenizer`` follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Chunks of visible ASCII and Latin letters that are letters in every version of Unicode, in normal form, with one-letter lower case.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9]|[^a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: visible Latin-1 bytes stand for themselves, the others take the code points from 256 on in order."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class Memory(dict):
    """Results of a function by key. Of two generations with at most ``size`` entries each, the older one goes when
    the younger is full; what is still in use moves on, so common keys are not worked out again."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Ids of a tokenizer whose tokens never span white space, chunk by chunk with a memory.

    Ids are bytes (little-endian unsigned 32-bit). ASCII white space separates chunks for the tokenizer as well, so a
    text's ids are those of its chunks in a row. If its normalizer and pre-tokenizer are the ones above, plain
    chunks are cut into pre-tokens here, and only pre-tokens not met before go through the merges of its model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, config = self.tokenizer.model, json.loads(self.tokenizer.to_str())
        self.simple = config["normalizer"] == NORMALIZER and config["pre_tokenizer"] == PRE_TOKENIZER and config["model"]["type"] == "BPE"
        self.letters = _byte_letters()
        self.chunks, self.words = Memory(self._chunk, REMEMBERED), Memory(self._word, WORDS)

    def _word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not self.simple or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _PARTS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        b = text.encode()
        # ASCII lower case is what the tokenizer does as well, after it has looked for special tokens
        if self.simple and b"<|" not in b:
            b = b.lower()
        return b"".join(map(self.chunks.__getitem__, b.split()))

    def forget(self) -> None:
        for memory in (self.chunks, self.words):
            memory.clear()
            memory.old = {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The columns of ``docs`` without the text, and piece, start, length, ids_crc32 (and ids): a row per piece."""
    path, end = path or default_tokenizer(), np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    schema = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<bigint>" if with_ids else "") + ">>"

    @F.pandas_udf(schema)
    def cut(texts: pd.Series) -> pd.Series:
        out, own = [], tokenizer(path)
        for text in texts.fillna(""):
            ids, rows = own.encode(text) + end, []
            for i in range(0, len(ids), step):
                part = ids[i : i + step]
                row = {"piece": i // step, "start": i // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                rows.append(row | {"ids": np.frombuffer(part, "<u4").astype(np.int64)} if with_ids else row)
            out.append(rows)
        own.forget()  # else a worker would hold it as long as the executor lives
        trim()
        return pd.Series(out)

    made = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    keep = [docs[c] for c in docs.columns if c != text and c not in made]
    (p,) = fresh(docs, "_p")
    return docs.select(*keep, F.explode(cut(text_of(text))).alias(p)).select(*[F.col(c) for c in docs.columns if c != text and c not in made], f"{p}.*")


class CapacityTree:
    """Which remaining capacities have open bins; the smallest one of at least n in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, c: int, value: bool) -> None:
        i = c + self.leaves
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = n + self.leaves
        if self.any[i]:
            return n
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass(frozen=True)
class Placement:
    """Pieces ``rank`` .. ``rank + count - 1`` of a length, ``each`` to a sequence from ``sequence`` on, at ``offset`` in it."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements for so many pieces of each length, and the number of sequences."""
    open_bins: dict[int, list[tuple[int, int]]] = {}
    tree, sequences, out = CapacityTree(capacity), 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError("lengths are 1 to the capacity")
        rank, left = 0, counts[length]
        while left:
            c = tree.tightest(length)
            if c is None:
                each = capacity // length
                first, n, c = sequences, -(-left // each), capacity
                sequences += n
            else:
                first, n = open_bins[c].pop()
                if not open_bins[c]:
                    tree.set(c, False)
            each = c // length
            full = min(n, left // each)
            if full:
                out.append(Placement(length, rank, full * each, first, each, capacity - c))
                put(c - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if left and rest:  # the pieces that are left share one bin
                out.append(Placement(length, rank, left, first + full, left, capacity - c))
                put(c - left * length, first + full, 1)
                full, rest, rank, left = full + 1, rest - 1, rank + left, 0
            put(c, first + full, rest)
    return out, sequences


def pack(items: DataFrame, order_by: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` and sequence_id, offset.

    Ranks inside a length come from salted windows, so a length that most pieces have is spread
    over tasks. ``items`` is read several times: pass a written table.
    """
    spark = items.sparkSession
    counts = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}  # at most `capacity` rows
    placements, _ = best_fit_decreasing(counts, capacity)
    salts = max(16, sum(counts.values()) // RANKED)
    salt, rank, before, own_length, own_salt = fresh(items, "_salt", "_rank", "_before", "_l", "_s")
    salted = items.withColumn(salt, F.pmod(F.xxhash64(*order_by), F.lit(salts)))
    sizes = salted.groupBy(length, salt).count()
    ahead = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(length).alias(own_length), F.col(salt).alias(own_salt), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(length, salt).orderBy(*order_by)).cast("bigint") - 1)
    ranked = ranked.join(sizes, (F.col(length) == F.col(own_length)) & (F.col(salt) == F.col(own_salt)))
    table = spark.sparkContext.broadcast(np.array([(p.length, p.rank, p.sequence, p.each, p.offset) for p in sorted(placements, key=lambda p: (p.length, p.rank))], np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        t, n, r = table.value, lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(t[:, 0] * (1 << 48) + t[:, 1], n * (1 << 48) + r, side="right") - 1
        own, within = t[at], r - t[at, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + within // own[:, 3], "offset": own[:, 4] + within % own[:, 3] * n})

    (p,) = fresh(ranked, "_place")
    placed = ranked.withColumn(p, place.asNondeterministic()(F.col(length).cast("bigint"), F.col(rank) + F.col(before)))
    return placed.select(*[c for c in items.columns if c not in ("sequence_id", "offset")], f"{p}.*")


def pack_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    work = Workspace(docs.sparkSession, "pack")
    cut = work.table(pieces(docs.select(id, text), text, path, capacity))
    return pack(cut, [id, "piece", "start", "length", "ids_crc32"], capacity=capacity)
