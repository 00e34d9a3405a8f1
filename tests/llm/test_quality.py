import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkassay.llm.quality import CHUNK, Network, chunk_starts, classify_quality, cut_chunks, score_batch, training_texts


def corpus(n=240):
    rng = random.Random(2)
    words = "the of and river stone house garden water light road under over green small".split()
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = i % 3 > 0
        text = " ".join(body) + "." if good else " ".join(w.upper() + rng.choice(["!!", "$$$"]) for w in body)
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(llm):
    docs, labels = corpus()
    d = llm.createDataFrame(docs, "doc_id long, text string")
    got = classify_quality(d, llm.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_chunks_cover_every_byte():
    for n in (0, 1, 64, 511, 512, 513, 960, 961, 5000, 100_003):
        starts = chunk_starts(n)
        seen = np.zeros(n, bool)
        for s in starts:
            seen[s : s + CHUNK] = True
        assert seen.all() and len(starts) >= 1
        assert cut_chunks(b"x" * n, starts).shape == (len(starts), CHUNK)


def test_score_of_a_text_does_not_depend_on_its_batch():
    net = Network()
    texts = [None, "", "abc", "long text " * 9000, "äöü" * 300]
    together = score_batch(net, texts)
    assert np.allclose(together, [score_batch(net, [t])[0] for t in texts], atol=1e-6)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 257, (3, CHUNK)).astype(np.int16)
    counts, y, w = np.array([2, 1]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = np.clip(net.probabilities(_hidden(net, x), counts), 1e-12, 1 - 1e-12)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = net.gradients(x, counts, y, w)
    for k, at in (("embed", (int(x[0, 9]), 2)), ("conv", (3, 5)), ("hid", (2, 1)), ("out", (4,)), ("out_b", (0,)), ("conv_b", (7,))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-5
        up = loss()
        net.p[k][at] = keep - 1e-5
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 + 0.05 * abs(g[k][at])


def test_gradients_do_not_depend_on_blocks():
    """A document of many blocks has the gradient of its chunks taken one by one."""
    rng = np.random.default_rng(1)
    net = Network()
    x = rng.integers(0, 257, (600, CHUNK)).astype(np.int16)
    counts, y, w = np.array([590, 10]), np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    g = net.gradients(x, counts, y, w)
    swapped = net.gradients(np.concatenate([x[590:], x[:590]]), counts[::-1], y[::-1], w)
    assert all(np.allclose(g[k], swapped[k], rtol=1e-3, atol=1e-5) for k in g)


def test_label_in_the_middle_of_long_texts(llm):
    """What marks a text may stand in any part of it."""
    rng = random.Random(9)
    words = "the of and river stone house garden water light road under over green small".split()
    docs, labels = [], []
    for i in range(200):
        body = [rng.choice(words) for _ in range(900)]
        if i % 2:
            at = rng.randrange(750)
            body[at : at + 120] = [w.upper() + "$$$" for w in body[at : at + 120]]
        docs.append((f"d{i}", " ".join(body)))
        labels.append((f"d{i}", 1 - i % 2, 0))
    got = classify_quality(llm.createDataFrame(docs, "doc_id string, text string"), llm.createDataFrame(labels, "doc_id string, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == 1 - int(r.doc_id[1:]) % 2 for r in held) >= 0.9 * len(held)


def test_sample_is_bounded_and_without_repeats(llm):
    docs, labels = corpus(60)
    d = llm.createDataFrame(docs + docs[:30] * 5 + [(docs[1][0], "another text of this id")], "doc_id long, text string")
    marks = llm.createDataFrame(labels * 3, "doc_id long, quality int, toxic int")
    chunks, y = training_texts(d, marks, "doc_id", "text", "quality", 4000, 1 << 25)
    free = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5]
    assert len(y) == len(chunks) == len(free) + (docs[1][0] in free)
    assert len(training_texts(d, marks, "doc_id", "text", "quality", 7, 1 << 25)[1]) == 7
    few = training_texts(d, marks, "doc_id", "text", "quality", 4000, 3000)[0]
    assert 0 < len(few) < len(free) and sum(int((c != 256).sum()) for c in few) <= 3000 * 1.2


def _hidden(net, x):
    z = net._unfold(x) @ net.p["conv"]
    z = z.reshape(len(x), -1, z.shape[1]).max(1) + net.p["conv_b"]
    return np.maximum(np.maximum(z, 0) @ net.p["hid"] + net.p["hid_b"], 0)


def test_odd_rows(llm, odd_docs, no_docs):
    labels = llm.createDataFrame([(1, 1, 0), (4, 0, 0), (7, None, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = classify_quality(odd_docs.withColumn("score", F.lit("x")).withColumn("y", F.lit(1)), labels)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and dict(out.dtypes)["score"] == "double"
    assert all(r.held_out for r in rows if r.doc_id is None)
    none = classify_quality(odd_docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert classify_quality(no_docs, labels).count() == 0
