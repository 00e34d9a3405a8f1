"""Words of many texts as 64-bit hashes, in numpy, without a loop over words.

A text's bytes get A-Z lower-cased; words are runs of bytes other than
``[\\x20\\x09-\\x0D]``.  The hash of a word is a polynomial over random byte values,
read from prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = [_RNG.integers(1, 2**63, 256, dtype=np.uint64)]
_BASE = [int(_RNG.integers(1, 2**63, dtype=np.uint64)) | 1]
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
# a second polynomial, for fingerprints of 128 bits
_BYTE.append(_RNG.integers(1, 2**63, 256, dtype=np.uint64))
_BASE.append(int(_RNG.integers(1, 2**63, dtype=np.uint64)) | 1)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``n`` of each."""
    if len(_powers[which][0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (_BASE[which], pow(_BASE[which], -1, 2**64)):
            p = np.full(n, np.uint64(b % 2**64), np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[which] = (both[0], both[1])
    return _powers[which]


def prefix_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums that span_hashes reads; one longer than ``raw``."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[which][raw] * powers(len(raw) + 1, which)[0][: len(raw)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of raw[start:end] for all pairs."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), which)[1][starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in b" ".join(texts) and the words' count by text.

    ``texts`` are lower-cased by the caller if that is wanted.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    gap = _IS_SPACE[raw]
    before = np.concatenate([[True], gap[:-1]]) if len(raw) else gap
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    hashes = span_hashes(prefix_sums(raw), starts, ends)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(np.searchsorted(starts, edges))
    return hashes, starts, ends, counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one text."""
    m = len(words) - n + 1
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * _PLACE[j]
    return mix(total, n)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles, sorted; a shorter text is one shingle; no words, none."""
    if len(words) == 0:
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


def pieces(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, bytes of the texts) in groups of about ``limit`` bytes, null as empty."""
    first, held, group = 0, 0, []
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if group and held + len(data) > limit:
            yield first, group
            first, held, group = i, 0, []
        group.append(data)
        held += len(data)
    if group:
        yield first, group
