import hashlib
import random

import numpy as np

from sparkassay.llm.suffix import DEPTH, common_prefixes, substring_classes, suffix_order
from sparkassay.llm.suffix_dedup import remove_repeats


def brute(rows):
    order = lambda i: (1, 0) if i is None else (0, i)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - DEPTH + 1):
            w = b[p : p + DEPTH]
            first[w] = min(first.get(w, (1, 0)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - DEPTH + 1):
            if first[b[p : p + DEPTH]] < order(i):
                gone[p : p + DEPTH] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def spark_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_order_and_prefixes():
    rng = np.random.default_rng(3)
    for text in (rng.integers(97, 99, 800), np.tile(rng.integers(97, 123, 130), 5), np.full(400, 97), rng.integers(0, 256, 300)):
        text = text.astype(np.uint8)
        sa, rank = suffix_order(text)
        raw = text.tobytes()
        assert sorted(sa.tolist()) == list(range(len(raw)))
        head = lambda i: (raw[i : i + DEPTH] + bytes(DEPTH))[:DEPTH]
        assert [head(i) for i in sa] == sorted(head(i) for i in range(len(raw)))
        lcp = common_prefixes(text, sa, rank)
        for k in range(1, len(sa)):
            a, b = raw[sa[k - 1] :][:DEPTH], raw[sa[k] :][:DEPTH]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n or min(len(a), len(b)) < DEPTH
        classes = substring_classes(text)
        full = range(max(0, len(raw) - DEPTH + 1))
        assert len({(raw[i : i + DEPTH], classes[i]) for i in full}) == len({raw[i : i + DEPTH] for i in full}) == len({classes[i] for i in full})


def passages(seed=2, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mé", "ur") for b in ("ta", "ri", "no", "ß")]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 40))) for _ in range(9)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 5))]
        text = rng.choice(["", " ", "\n"]).join(parts)
        if i % 10 == 3:
            text = rows[rng.randrange(len(rows))][1]
        if i % 10 == 6:
            text = "na " * rng.randint(10, 60) + text
        rows.append((n - i, text))
    return rows


def test_against_brute_force_in_shards_of_any_size(llm):
    rows = passages()
    df = llm.createDataFrame(rows, "doc_id long, text string")
    for size in (2_000, 1 << 20):
        assert spark_rows(remove_repeats(df, shard_bytes=size)) == brute(rows)


def test_spans_and_kept_bytes(llm):
    rows = passages(seed=5, n=30)
    for r in remove_repeats(llm.createDataFrame(rows, "doc_id long, text string"), shard_bytes=4_000).collect():
        raw = dict(rows)[r.doc_id].encode()
        cut = b"".join(raw[a:b] for a, b in zip([0, *r.spans[1::2]], [*r.spans[0::2], len(raw)]))
        assert bytes(r.kept) == cut and hashlib.sha256(cut).hexdigest() == r.kept_sha256


def test_ids_of_any_size_beside_nulls(llm):
    """Longs beyond 2**53, the greatest and the least one, one id with two texts, and a null in every shard."""
    top = 2**63 - 1
    a, b, c = ("".join(random.Random(s).choice("abcdefgh ") for _ in range(400)) for s in (1, 2, 3))
    rows = [(2**60 + 1, a), (2**60 + 3, a), (2**60 + 2, a + b), (top, b), (top, b + "x"), (-(2**63), c), (top - 1, c + a), (None, b + c), (None, b + c), (None, "only here " * 9)]
    rows += [(2**61 + i, random.Random(50 + i).choice([a, b, c])[: 100 + i]) for i in range(30)] + [(None, f"{i} " * 60 + a[i : i + 80]) for i in range(30)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    for size in (500, 3_000, 1 << 20):
        assert spark_rows(remove_repeats(df, shard_bytes=size)) == brute(rows)


def test_scratch_is_gone(llm):
    before = {t.name for t in llm.catalog.listTables()}
    remove_repeats(llm.createDataFrame(passages(n=20), "doc_id long, text string")).count()
    assert {t.name for t in llm.catalog.listTables()} == before


def test_clashing_columns(llm):
    df = llm.createDataFrame([(1, "abc " * 30, "x", 5), (2, "abc " * 30, "y", 6)], "doc_id long, text string, kept_sha256 string, n_bytes int")
    assert spark_rows(remove_repeats(df)) == brute([(1, "abc " * 30), (2, "abc " * 30)])


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert spark_rows(remove_repeats(odd_docs, shard_bytes=3_000)) == brute(rows)
    assert remove_repeats(no_docs).count() == 0
