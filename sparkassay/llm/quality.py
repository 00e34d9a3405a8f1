"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into chunks of ``CHUNK`` bytes that overlap by a
filter's reach and cover the whole text.  Each byte has a learned vector; learned
filters run over every chunk, rectified and max-pooled to one vector a chunk; a
hidden layer reads that vector; mean and maximum over all chunks of the document
feed one logistic output.

Fitting is bounded: labelled documents are taken in the order of a hash, whole,
until there are ``max_docs`` of them or the next one would pass ``max_bytes`` of
text in all; that is what reaches the driver, whatever the size of the tables.  A
document longer than ``max_bytes`` is not learned from.  Scoring reads every byte of every document and runs in
Arrow batches; memory is one batch and one block of chunks.

Labels, language, source and id are never inputs.  Defined results: null or empty
text is one chunk of padding and gets that chunk's score; without any usable label
every score is 0.5; rows with a null id count as held out, as no remainder can be
shown for them; repeated rows get equal scores and are learned from once; of rows
that share an id each different text is a document of its own; ids are of any type
that has an order and a text form; input columns named like a result are replaced
by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 12, 3, 40, 24
STEP = CHUNK - OVERLAP
PLACES = (CHUNK - WIDTH) // STRIDE + 1
PAD = 256
THRESHOLD = 0.3


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover ``n`` bytes; at least one chunk."""
    return np.arange(max(1, -(-(n - OVERLAP) // STEP)), dtype=np.int64) * STEP


def cut_chunks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) of byte values, PAD after the end."""
    out = np.full((len(starts), CHUNK), PAD, np.int16)
    raw = np.frombuffer(data, np.uint8)
    for i, s in enumerate(starts):
        part = raw[s : s + CHUNK]
        out[i, : len(part)] = part
    return out


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        k = WIDTH * EMBED
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBED)),
            "conv": r.normal(0, np.sqrt(2 / k), (k, FILTERS)),
            "conv_b": np.zeros(FILTERS),
            "hid": r.normal(0, np.sqrt(2 / FILTERS), (FILTERS, HIDDEN)),
            "hid_b": np.zeros(HIDDEN),
            "out": r.normal(0, 0.1, 2 * HIDDEN),
            "out_b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _unfold(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]  # chunks, CHUNK, EMBED
        n = len(x)
        a, b, c = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, PLACES, WIDTH * EMBED), (a, STRIDE * b, c))
        return np.ascontiguousarray(view).reshape(n * PLACES, WIDTH * EMBED)

    def chunk_vectors(self, x: np.ndarray) -> np.ndarray:
        """Hidden vectors of chunks, in blocks that bound memory."""
        out = np.empty((len(x), HIDDEN), np.float32)
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            z = (self._unfold(part) @ self.p["conv"]).reshape(len(part), PLACES, FILTERS).max(1) + self.p["conv_b"]
            out[i : i + 256] = np.maximum(np.maximum(z, 0) @ self.p["hid"] + self.p["hid_b"], 0)
        return out

    def probabilities(self, hidden: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One probability a document from its chunks' vectors, which stand together."""
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(hidden, first, 0) / counts[:, None]
        top = np.maximum.reduceat(hidden, first, 0)
        z = np.concatenate([mean, top], 1) @ self.p["out"] + self.p["out_b"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
        """Of the weighted log loss; whole documents of any length, block by block of chunks."""
        p, n = self.p, len(x)
        best, pooled = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), p["conv"].dtype)
        for i in range(0, n, 256):
            part = x[i : i + 256]
            z = (self._unfold(part) @ p["conv"]).reshape(len(part), PLACES, FILTERS)
            best[i : i + 256] = z.argmax(1)
            pooled[i : i + 256] = np.take_along_axis(z, best[i : i + 256][:, None], 1)[:, 0] + p["conv_b"]
        act = np.maximum(pooled, 0)
        h = np.maximum(act @ p["hid"] + p["hid_b"], 0)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        doc = np.repeat(np.arange(len(counts)), counts)
        mean = np.add.reduceat(h, first, 0) / counts[:, None]
        top = np.maximum.reduceat(h, first, 0)
        both = np.concatenate([mean, top], 1)
        prob = 1 / (1 + np.exp(-np.clip(both @ p["out"] + p["out_b"][0], -30, 30)))
        dz = ((prob - y) * w / w.sum()).astype(np.float32)
        g = {"out": both.T @ dz, "out_b": np.array([dz.sum()])}
        dboth = dz[:, None] * p["out"]
        is_top = (h == top[doc]).astype(np.float32)
        is_top /= np.maximum(np.add.reduceat(is_top, first, 0), 1)[doc]
        dh = (dboth[:, :HIDDEN] / counts[:, None])[doc] + dboth[:, HIDDEN:][doc] * is_top
        dh *= h > 0
        g["hid"], g["hid_b"] = act.T @ dh, dh.sum(0)
        dpool = (dh @ p["hid"].T) * (pooled > 0)
        g["conv_b"] = dpool.sum(0)
        conv, demb = np.zeros(p["conv"].shape), np.zeros(p["embed"].shape)
        for i in range(0, n, 256):
            # only the pooled places carry gradient
            d = dpool[i : i + 256]
            starts = np.arange(len(d))[:, None] * CHUNK + best[i : i + 256] * STRIDE
            seen = x[i : i + 256].ravel()[starts[:, :, None] + np.arange(WIDTH)]  # chunks, FILTERS, WIDTH
            conv += np.einsum("cfk,cf->kf", p["embed"][seen].reshape(len(d), FILTERS, -1), d)
            back = (d[:, :, None] * p["conv"].T).reshape(-1, EMBED)
            for e in range(EMBED):
                demb[:, e] += np.bincount(seen.ravel(), back[:, e], len(demb))
        g["conv"], g["embed"] = conv, demb
        return g

    def fit(self, chunks: list[np.ndarray], y: np.ndarray, steps: int = 1000, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> Network:
        """Adam on batches that hold both classes in equal numbers; weights undo most of that."""
        r = np.random.default_rng(seed)
        classes = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
        if not all(map(len, classes)):
            return self
        share = len(classes[1]) / len(y)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(c, batch // 2) for c in classes])
            x = np.concatenate([chunks[i] for i in pick])
            counts = np.array([len(chunks[i]) for i in pick])
            w = np.where(y[pick] == 1, np.sqrt(share), np.sqrt(1 - share)).astype(np.float32)
            g = self.gradients(x, counts, y[pick].astype(np.float32), w)
            lr = rate * min(1, t / 20) * (1 if t < steps * 0.6 else 0.2)
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.01 * (g[k] ** 2 - v2[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def _fold(id_col):
    return F.crc32(id_col.cast("string")) % 5


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int, max_bytes: int):
    """Chunks and labels of a bounded, hash-chosen sample outside the held-out fold."""
    ident = F.col(id_col)
    marked = (
        labels.select(ident, F.col(label_col).cast("int").alias("__q_y"))
        .where(ident.isNotNull() & F.col("__q_y").isin(0, 1) & (_fold(ident) != 0))
        .distinct().orderBy(F.md5(ident.cast("string")), ident, "__q_y").limit(max_docs)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    # at most max_docs rows of two values: a proven bound for the broadcast
    found = docs.select(ident, text.alias("__q_text")).join(F.broadcast(marked), id_col)
    found = found.withColumn("__q_h", F.xxhash64("__q_text"))
    order = [F.md5(ident.cast("string")), ident, F.col("__q_h"), F.col("__q_y")]
    kinds = found.groupBy(id_col, "__q_h", "__q_y").agg(F.max(F.octet_length("__q_text").cast("long")).alias("__q_n"))
    before = W.Window.orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    # a window over max_docs rows of four values
    chosen = kinds.orderBy(*order).limit(max_docs).withColumn("__q_sum", F.sum("__q_n").over(before)).where(F.col("__q_sum") <= max_bytes)
    chosen = F.broadcast(chosen.select(id_col, "__q_h", "__q_y"))
    taken = found.join(chosen, [id_col, "__q_h", "__q_y"]).groupBy(id_col, "__q_h", "__q_y").agg(F.first("__q_text").alias("__q_text"))
    rows = taken.select(F.col(id_col).cast("string").alias("i"), F.col("__q_y").alias("y"), F.col("__q_text").alias("t")).collect()
    rows.sort(key=lambda r: (r.i, r.y, r.t))
    texts = [r.t.encode("utf-8", "surrogatepass") for r in rows]
    return [cut_chunks(t, chunk_starts(len(t))) for t in texts], np.array([r.y for r in rows], np.int64)


def score_batch(net: Network | None, texts: list) -> list[float]:
    if net is None:
        return [0.5] * len(texts)
    scores: list[float] = []
    hidden, counts, waiting = [], [], []

    def flush() -> None:
        if waiting:
            hidden.append(net.chunk_vectors(np.concatenate(waiting)))
            waiting.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        starts = chunk_starts(len(data))
        counts.append(len(starts))
        for i in range(0, len(starts), 1024):
            waiting.append(cut_chunks(data, starts[i : i + 1024]))
            if sum(map(len, waiting)) >= 1024:
                flush()
    flush()
    if counts:
        scores = net.probabilities(np.concatenate(hidden), np.array(counts)).tolist()
    return scores


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = 4000,
    max_bytes: int = 32 << 20,
    threshold: float = THRESHOLD,
    keep_text: bool = True,
) -> DataFrame:
    """Input columns (the text only if ``keep_text``) plus ``held_out``, ``score`` and ``predicted``."""
    chunks, y = training_texts(docs, labels, id_col, text_col, label_col, max_docs, max_bytes)
    net = Network().fit(chunks, y) if len(y) and 0 < y.sum() < len(y) else None
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")])
    at = base.columns.index(text_col)
    sent = [i for i in range(len(base.columns)) if keep_text or i != at]
    schema = ", ".join([*(f"`{base.schema[i].name}` {base.schema[i].dataType.simpleString()}" for i in sent), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = pa.array(score_batch(net, part.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.columns[j] for j in sent), got], names=[*(part.schema.names[j] for j in sent), "score"])

    return (
        base.mapInArrow(run, schema)
        .withColumn("held_out", F.coalesce(_fold(F.col(id_col)) == 0, F.lit(True)))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
