"""Suffix arrays of one shard in numpy: Larsson-Sadakane refinement and Kasai common prefixes.

Both stop at a depth: repeated substrings of ``depth`` bytes are what is looked
for, so suffixes equal that far need no further order.
"""

from __future__ import annotations

import numpy as np

DEPTH = 50
#: Doubling steps from an order by 8 bytes to one by 50.
STEPS = (8, 16, 18)
PAD = 64
BLOCK = 64


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first DEPTH bytes, rank of every suffix): equal ranks are equal that far.

    Suffixes start in groups by their first 8 bytes.  A round sorts only groups of
    more than one by the rank of the suffix as far on as the order reaches, which
    doubles that reach; a suffix alone in its group is never touched again.
    Suffixes that end before DEPTH bytes are ordered as if zeros followed.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(PAD, np.uint8)])
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    sa = np.argsort(key)
    key = key[sa]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.full(n + PAD, -1, np.int64)  # what lies behind the end comes first
    slots = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(first, slots, 0))
    for step in STEPS:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(slots):
            break
        at = sa[slots]
        both = (rank[at].astype(np.uint64) << np.uint64(32)) | (rank[at + step] + 1).astype(np.uint64)
        o = np.argsort(both)
        at, both = at[o], both[o]
        sa[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = both[1:] != both[:-1]
        first[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every place in ``sa`` the bytes it shares with the one before, at most DEPTH.

    Kasai's walk in text order, many blocks of the text at a time: a suffix shares
    at least one byte less than the suffix before it in the text did, so the count
    goes on from there.  Suffixes of one rank share DEPTH bytes without looking.
    """
    n = len(text)
    padded = np.concatenate([text, np.arange(1, PAD + 1, dtype=np.uint8)])
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)
    starts = np.arange(0, n, BLOCK)
    have = np.zeros(len(starts), np.int64)
    for j in range(BLOCK):
        i = starts + j
        inside = i < n
        i, have = i[inside], have[inside]
        starts = starts[inside]
        b = before[i]
        real = b >= 0
        tied = real & (rank[i] == rank[np.maximum(b, 0)])
        have = np.where(have >= DEPTH, 0, np.maximum(have - 1, 0))
        have[~real] = 0
        have[tied] = DEPTH
        go = np.flatnonzero(real & ~tied)
        while len(go):
            same = (padded[i[go] + have[go]] == padded[b[go] + have[go]]) & (have[go] < DEPTH) & (i[go] + have[go] < n) & (b[go] + have[go] < n)
            go = go[same]
            have[go] += 1
        shared[i] = have
    return shared[sa]


def substring_classes(text: np.ndarray) -> np.ndarray:
    """For every place the number of the class of its DEPTH-byte substring."""
    if not len(text):
        return np.empty(0, np.int64)
    sa, rank = suffix_order(text)
    lcp = common_prefixes(text, sa, rank)
    out = np.empty(len(text), np.int64)
    out[sa] = np.cumsum(lcp < DEPTH)
    return out
