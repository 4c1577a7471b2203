"""Hashes of words and of word shingles for many texts at once, in numpy.

The words of a text are what white space separates in its lower case. A word's hash comes from prefix sums of its
bytes times powers of a base, so there is no table of words and no work per word in Python. Shingles are runs of
``size`` words (all words of shorter texts), each labelled with the number of its earlier occurrences in the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are hashed at once; a longer text is hashed in pieces that end between words.
AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL, _LABEL, _DOC = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)

_powers: list[np.ndarray] = []


def words(text: str) -> list[str]:
    return text.lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept up to the usual size."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, AT_ONCE + 1)
        made = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (_BASE, _INVERSE)]
        if size > 2 * AT_ONCE:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words in ``data``, which single spaces separate."""
    out, begin = [], 0
    while begin < len(data):
        stop = len(data)
        if stop - begin > AT_ONCE:
            stop = data.rfind(b" ", begin, begin + AT_ONCE)
            if stop <= begin:  # one word longer than that
                stop = data.find(b" ", begin)
                stop = len(data) if stop < 0 else stop
        b = np.frombuffer(data, np.uint8, stop - begin, begin)
        power, inverse = powers(len(b) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))
        out.append(mix((total[ends] - total[starts]) * inverse[starts]))
        begin = stop + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@dataclass
class Shingled:
    """Shingles of several texts with words, end to end: ``rows`` are the texts' numbers, ``n`` the numbers of their shingles."""

    rows: np.ndarray
    n: np.ndarray
    labelled: np.ndarray
    label: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the sets of shingles, and their sizes."""
        first = self.label == 0
        return self.labelled[first], np.add.reduceat(first, self.starts, dtype=np.int64)


def rolled(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside texts of so many words each, and the numbers of runs."""
    total = len(hashes)
    h = np.zeros(total, np.uint64)
    whole = total - size + 1
    for i in range(size if whole > 0 else 0):
        h[:whole] = h[:whole] * _ROLL + hashes[i : i + whole]
    ends = np.cumsum(counts)
    starts = ends - counts
    valid = np.ones(total, bool)
    for back in range(1, size):
        valid[np.maximum(ends - back, 0)] = False
    for d in np.flatnonzero(counts < size).tolist():
        own = 0
        for x in hashes[starts[d] : ends[d]].tolist():
            own = (own * int(_ROLL) + x) & 0xFFFFFFFFFFFFFFFF
        h[starts[d]], valid[starts[d]] = own, True
    return h[valid], np.maximum(counts - size + 1, 1)


def labels(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Number of earlier occurrences of each hash in its text."""
    out = np.zeros(len(h), np.uint64)
    own = mix(h + doc * _DOC)
    order = np.argsort(own)
    s = own[order]
    again = s[1:] == s[:-1]
    if again.any():
        some = np.zeros(len(h), bool)
        some[order[1:][again]] = some[order[:-1][again]] = True
        at = np.flatnonzero(some)
        order = at[np.argsort(own[at], kind="stable")]
        s = own[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
    return out


def shingled(texts: Iterable[str], size: int) -> Iterator[Shingled]:
    """Shingles of the texts, about ``AT_ONCE`` bytes at a time; texts without words are left out."""
    parts: list[bytes] = []
    rows: list[int] = []
    held = 0

    def take() -> Shingled:
        counts = np.array([p.count(b" ") + 1 for p in parts], np.int64)
        h, n = rolled(word_hashes(b" ".join(parts)), counts, size)
        label = labels(h, np.repeat(np.arange(len(parts), dtype=np.uint64), n))
        return Shingled(np.array(rows, np.int64), n, mix(h + label * _LABEL), label)

    for row, text in enumerate(texts):
        part = " ".join(words(text)).encode("utf-8", "surrogatepass")
        if not part:
            continue
        if parts and held + len(part) > AT_ONCE:
            yield take()
            parts, rows, held = [], [], 0
        parts.append(part)
        rows.append(row)
        held += len(part)
    if parts:
        yield take()
