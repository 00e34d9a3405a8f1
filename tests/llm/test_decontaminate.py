import random

import numpy as np

from sparkassay.llm.decontaminate import MATCH, align, drop_contaminated, find_contamination, plain_words


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_against_full_table():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 15))], np.uint64)
        b = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 25))], np.uint64)
        score, end = align(a, b)
        assert score == smith_waterman(a, b)
        assert score == 0 or a[-1] == b[end] or b[end] in a


def setting():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50)))) for i in range(12)]
    docs, want = [], set()
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if i % 5 == 0:
            item = rng.choice(items)
            copy = item[1].split()
            if i % 10 == 0:
                for _ in range(len(copy) // 10):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = copy
            want.add((i, item[0]))
        docs.append((i, " ".join(text)))
    return docs, items, want


def test_copies_are_found_and_clean_texts_left(llm):
    docs, items, want = setting()
    d, b = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 60):  # one block, or many
        got = {(r.doc_id, r.item_id): r for r in find_contamination(d, b, block_grams=block).collect()}
        assert set(got) == want
        for (doc, item), r in got.items():
            full = smith_waterman(plain_words(dict(items)[item]), plain_words(dict(docs)[doc])) / (MATCH * r.item_words)
            assert abs(r.score - full) < 1e-9
        left = {r.doc_id for r in drop_contaminated(d, b, block_grams=block).collect()}
        assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_an_item_that_leaked_everywhere_is_still_found(llm):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(i, f"begin {i} {item} end") for i in range(60)] + [(99, "nothing of it is here")]
    got = find_contamination(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(60))


def test_odd_rows(llm, odd_docs, no_docs):
    bench = llm.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, " ,. "), (4, "你好"), (1, "the deep dark wood")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_contamination(odd_docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (7, 1), (None, 1), (9, 4)}
    assert find_contamination(no_docs, bench).count() == 0 and drop_contaminated(no_docs, bench).count() == 0
    assert find_contamination(odd_docs, bench.where("false")).count() == 0
    kept = drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8}


def edited_copies():
    """Copies with 10 to 33 % of words replaced, halves, words put in, words left out, among common words."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(1500)]
    usual = ["the", "of", "and", "to", "in", "a", "is", "that"]

    def prose(n):
        return [rng.choice(usual) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]

    items = [prose(rng.randint(3, 50)) for _ in range(24)] + [["alone"], ["two", "words"]]
    docs = []
    for i in range(240):
        item = rng.choice(items)
        copy = list(item)
        if i % 4 == 0:
            share = rng.choice([0.1, 0.2, 0.25, 0.33])
            copy = [rng.choice(words) if rng.random() < share else w for w in copy]
        elif i % 4 == 1:
            at = rng.randint(0, len(copy) // 2)
            copy = copy[at : at + (len(copy) + 1) // 2]
        elif i % 4 == 2:
            every = rng.randint(1, 3)
            copy = [x for j, w in enumerate(copy) for x in ([w, rng.choice(words)] if j % every == 0 else [w])]
        else:
            copy = [w for w in copy if rng.random() > 0.25]
        text = prose(rng.randint(0, 200))
        at = rng.randint(0, len(text))
        text[at:at] = copy
        docs.append((i, " ".join(text)))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)]


def test_edited_copies_as_without_seeds(llm):
    docs, items = edited_copies()
    d, b = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")
    for threshold in (0.5, 0.65):
        want = {}
        for i, text in docs:
            for j, item in items:
                t, w = plain_words(text), plain_words(item)
                score = align(w, t)[0] / (MATCH * len(w))
                if score >= (threshold if len(w) > 2 else 1):  # one or two words must stand whole
                    want[i, j] = score
        got = {(r.doc_id, r.item_id): r.score for r in find_contamination(d, b, threshold=threshold).collect()}
        assert got == want
    assert len(want) > 100
    left = {r.doc_id for r in drop_contaminated(d, b, threshold=threshold).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_long_texts_in_parts(monkeypatch):
    from sparkassay.llm import decontaminate as op

    docs, items = edited_copies()
    block = [(i, plain_words(t)) for i, t in items]
    words = plain_words(" ".join(t for _, t in docs))
    known = op.Filter(np.concatenate([w for _, w in block]))
    seeds = op.Seeds(block, known, np.bincount(known.find(words)[1], minlength=len(known.wanted)), 0.5)
    whole = op.find_leaks(words, seeds)
    monkeypatch.setattr(op, "PLACES", 50)
    assert op.find_leaks(words, seeds) == whole and len(whole) == len(items)


def test_clashing_columns(llm):
    item = "one two three four five six seven eight nine ten"
    docs = llm.createDataFrame([(1, f"before {item} after", 7, "x", "y"), (2, "nothing of it", 7, "x", "y")], "doc_id long, text string, score int, item_id string, id string")
    bench = llm.createDataFrame([(5, item, 3)], "item_id long, text string, row_hash int")
    assert [(r.doc_id, r.item_id, r.score) for r in find_contamination(docs, bench).collect()] == [(1, 5, 1.0)]
    kept = drop_contaminated(docs, bench).collect()
    assert [(r.doc_id, r.score, r.item_id, r.id) for r in kept] == [(2, 7, "x", "y")]
