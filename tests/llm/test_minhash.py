import random

import numpy as np
from pyspark.sql import functions as F

from sparkassay.llm import minhash
from sparkassay.llm._components import components
from sparkassay.llm._store import Scratch
from sparkassay.llm._words import LOWER, shingle_set, word_hashes
from sparkassay.llm.minhash import dedup_near


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    s = sets_of(rows)
    parent = {i: i for i in s}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in s}


def variants(seed=1, n=160):
    """Copies with edits at many places, chains of edits and unrelated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(words) for _ in range(90)] for _ in range(6)]
    for i in range(n):
        text = list(rng.choice(base)) if i % 4 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(text).upper() if i % 7 == 0 else "\n ".join(text)))
    return rows


def test_against_brute_force(llm):
    rows = variants()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup_near(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_ids_with_several_texts(llm):
    """What any text of an id is linked with, all are; equal rows and string ids too."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    new = lambda: [rng.choice(words) for _ in range(60)]
    near = lambda t: [*t[:30], "changed", *t[31:]]
    a, b, c, d = new(), new(), new(), new()
    rows = [(1, a), (1, b), (12, near(b)), (7, near(a)), (30, c), (30, c), (31, near(c)), (40, d), (41, near(d)), (41, near(c)), (50, new())]
    rows = [(i, " ".join(t)) for i, t in rows]
    want = {1: 1, 12: 1, 7: 1, 30: 30, 31: 30, 40: 30, 41: 30, 50: 50}
    got = dedup_near(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    named = [(f"d{i:03d}", t) for i, t in rows]
    got = dedup_near(llm.createDataFrame(named, "doc_id string, text string").withColumn("kept", F.lit(5)).withColumn("n", F.lit("x"))).collect()
    assert all(r.component_id == f"d{want[int(r.doc_id[1:])]:03d}" for r in got)


def test_pairs_of_exactly_three_quarters(llm):
    """60 shingles of which 45 are shared, beside one pair just below."""
    rng = random.Random(6)
    word = iter(f"x{i}" for i in range(10_000))
    rows = []
    for k in range(30):
        common = [next(word) for _ in range(49 + 4)]  # 49 shingles shared
        left, right = ([next(word) for _ in range(m)] for m in (8, 8 if k % 2 else 9))  # 49 of 65, 49 of 66
        rows += [(2 * k, common + left), (2 * k + 1, common + right)]
    common = [next(word) for _ in range(46)]  # 42 shared shingles, 7 + 7 of their own: 75 of 100
    rows += [(1000, common + [next(word) for _ in range(7)]), (1001, common + [next(word) for _ in range(7)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup_near(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[1001][1] == 1000


def test_blocks_by_shingles(llm, monkeypatch):
    """Blocks of a few rows and bytes give the same classes."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    rows = variants(seed=11, n=90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup_near(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_blocks_inside_a_band_lose_nothing(llm, monkeypatch):
    import pandas as pd

    rows = variants(seed=9, n=80)
    ids = [i for i, _ in rows]
    sets = {i: shingle_set(word_hashes([t.encode().translate(LOWER)])[0], 5) for i, t in rows}
    sig = {i: minhash.signature(s).tobytes() for i, s in sets.items()}
    found = set()
    for band in range(minhash.BANDS):
        keys = {}
        for i in ids:
            keys.setdefault(minhash.band_keys(np.frombuffer(sig[i], np.uint32).reshape(1, -1))[0][band], []).append(i)
        for members in keys.values():
            frame = pd.DataFrame([(band, 0, 0, 0, m, i, i, sets[i].tobytes(), sig[i]) for i in members for m in (True, False)],
                                 columns=["band", "key", "i", "j", "minor", "node", "component", "shingles", "sig"])
            found |= {tuple(sorted(map(int, p))) for p in minhash.join_block(frame).itertuples(index=False, name=None)}
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    want = brute(rows)
    assert {i: top(i) for i in ids if len(sets[i])} == {i: c for i, (n, c) in want.items() if n}


def test_pruning_keeps_similar_pairs():
    need = minhash.needed_matches()
    assert need == sorted(need) and need[-1] < 0.75 * minhash.HASHES
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (2000, minhash.HASHES)).astype(np.uint32)
    b = np.where(rng.random(a.shape) < 0.75, a, rng.integers(0, 2**32, a.shape)).astype(np.uint32)
    c = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 2**32, a.shape)).astype(np.uint32)
    assert len(minhash.unpruned(a, b)[0]) == 2000 and len(minhash.unpruned(a, c)[0]) == 0


def test_odd_rows(llm, odd_docs, no_docs):
    rows = [tuple(r) for r in dedup_near(odd_docs).collect()]
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r[0], set()).add(r[1:])
    n = len(sets_of([(0, "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood for good")])[0])
    assert by[1] == {(n, 1, True)} and by[2] == {(n, 1, False)}
    assert by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)} and by[6] == {(0, 6, True)}
    assert by[None] == {(n, None, True)} and by[9] == {(1, 9, True)}
    assert all(c == 8 for _, c, _ in by[8])
    assert dedup_near(no_docs).count() == 0


def test_words_match_the_definition():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé") for _ in range(rng.randint(0, 30))).encode() for _ in range(200)]
    hashes, starts, ends, counts = word_hashes(texts)
    joined = b" ".join([*texts, b""])
    words = [w for t in texts for w in t.split(None)]
    import re

    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert [joined[a:b] for a, b in zip(starts, ends)] == words and counts.sum() == len(words)
    assert len({int(h) for h in hashes}) == len(set(words))


def test_components_of_chains_and_stars(llm):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(50)] + [(rng.randint(400, 520), rng.randint(400, 520)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    df = llm.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(llm, "cc")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {x: top(x) for x in parent if x in got} and set(parent) - set(got) <= loops
