"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

The benchmark is the stated query set; it is taken in blocks of at most
``block_grams`` words, so what a block sends to the tasks has a proven bound and
a benchmark of any size works.  For a block:

1. One pass over all texts counts in how many documents each of the block's words
   stands; tasks send one count a word and batch.
2. Each item leaves out its most common words, as many as fill a quarter of the
   score it needs; all others are seeds, so an item that leaked into a third of all
   documents keeps seeds too.
3. A second pass finds the seeds in every text.  A run of text words scores at most
   2 for each that stands in the item and -1 for each other one, and the words left
   out add at most 3 each, so only items whose seeds reach the rest of the score are
   looked at, and of the text only what can be part of a run that reaches all of it
   with each word matched no more often than the item has it.
   There words are aligned with the item by Smith-Waterman (match 2, mismatch and
   gap -1).  The score is the best local score over that of a full copy.

Pairs with a score of at least ``threshold`` are reported, one row for each text
row and item.  The bounds hold for every alignment, so no such pair is missed.
Nothing is shuffled but counts.

Defined results: null or empty texts and items without words match nothing; items
of fewer than ``WHOLE`` words must stand whole; rows that share an id are
aligned apart and reported apart, equal rows once each; an empty benchmark gives
no rows; items that share an id are aligned apart and the best one is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm._words import pieces, word_hashes

WHOLE, LEFT_OUT, PLACES = 3, 4, 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
SCHEMA = "score double, first_word long, last_word long, item_words long"

#: Words are runs of letters, digits and bytes from 0x80, lower-cased: punctuation does not hide a copy.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: str | None) -> np.ndarray:
    return word_hashes([(text or "").encode("utf-8", "surrogatepass").translate(PLAIN)])[0]


class Filter:
    """Which hashes are in a fixed set: a bit table first, then binary search."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = np.unique(wanted)
        bits = max(12, min(26, int(np.ceil(np.log2(len(self.wanted) + 1))) + 6))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.wanted & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in hashes, index in wanted) of all hits."""
        near = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        at = np.searchsorted(self.wanted, hashes[near])
        at[at == len(self.wanted)] = 0
        hit = self.wanted[at] == hashes[near] if len(self.wanted) else np.zeros(len(near), bool)
        return near[hit], at[hit]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local score and the last word of that alignment."""
    places = np.arange(1, len(words) + 1, dtype=np.int32) * -GAP
    above = np.zeros(len(words) + 1, np.int32)
    best, end = 0, -1
    for w in item:
        row = np.maximum(above[:-1] + np.where(words == w, np.int32(MATCH), np.int32(MISMATCH)), above[1:] + GAP)
        row = np.maximum.accumulate(np.maximum(row, 0) + places) - places
        above = np.concatenate([[np.int32(0)], row])
        top = int(row.argmax()) if len(row) else 0
        if len(row) and row[top] > best:
            best, end = int(row[top]), top
    return best, end


def texts_words(texts: list) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of every text."""
    for first, group in pieces(texts):
        hashes, _, _, counts = word_hashes([t.translate(PLAIN) for t in group])
        edges = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(group)):
            yield first + i, hashes[edges[i] : edges[i + 1]]


class Seeds:
    """A block's words, which of them are seeds of which items, and the score each item needs."""

    def __init__(self, block: list[tuple[int, np.ndarray]], words: Filter, counts: np.ndarray, threshold: float):
        self.block, self.words = block, words
        sizes = np.array([len(w) for _, w in block], np.int64)
        self.need = np.where(sizes < WHOLE, 1.0, threshold) * (MATCH * sizes)
        self.reach = int(3 * sizes.max())  # no alignment has more text words
        self.rest = self.need.copy()  # what the seeds must bring
        of_word, of_item = [], []
        for number, (_, item) in enumerate(block):
            own, times = np.unique(np.searchsorted(words.wanted, item), return_counts=True)
            o = np.argsort(-counts[own], kind="stable")
            total = np.cumsum(times[o])
            out = int(np.searchsorted(total, self.need[number] // LEFT_OUT, "right"))
            self.rest[number] -= 3 * (total[out - 1] if out else 0)
            of_word.append(own[o[out:]])
            of_item.append(np.full(len(own) - out, number, np.int64))
        of_word, of_item = np.concatenate(of_word), np.concatenate(of_item)
        self.items = of_item[np.argsort(of_word, kind="stable")]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(of_word, minlength=len(words.wanted)))])

    def candidates(self, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Items that can align, from the places (ascending) of the block's words in a text."""
        many = self.edges[which + 1] - self.edges[which]
        if (total := int(many.sum())) == 0:
            return self.items[:0]
        lo, hi = int(at[0]), int(at[-1]) + 1
        if total > PLACES and hi - lo > 4 * self.reach:
            mid = (lo + hi) // 2
            l, r = np.searchsorted(at, [mid, mid + self.reach])
            return np.union1d(self.candidates(at[:r], which[:r]), self.candidates(at[l:], which[l:]))
        first = np.cumsum(many) - many
        item = self.items[np.arange(total) + np.repeat(self.edges[which] - first, many)]
        item, place = np.divmod(np.sort(item * hi + np.repeat(at, many)), hi)
        # 3 a seed less 1 a word, best run that ends at each seed; every item begins below all before it
        height = 3 * np.arange(total) - place - item * (3 * total + hi)
        best = height - np.minimum.accumulate(height) + 2
        return np.unique(item[best >= self.rest[item]])


def find_leaks(words: np.ndarray, seeds: Seeds) -> list[tuple]:
    """(item id, score, first word, last word, item words) of one text."""
    at, which = seeds.words.find(words)
    found: dict[int, tuple] = {}
    for number in seeds.candidates(at, which).tolist():
        item_id, item = seeds.block[number]
        m, need = len(item), seeds.need[number]
        full = MATCH * m
        own, times = np.unique(np.searchsorted(seeds.words.wanted, item), return_counts=True)
        places = at[hit := np.isin(which, own)]
        kinds = np.searchsorted(own, which[hit])
        sums = np.full(len(words) + 1, MISMATCH, np.int64)
        sums[0] = 0
        sums[places + 1] = MATCH
        sums = np.cumsum(sums)
        after = np.maximum.accumulate(sums[:0:-1])[::-1]
        can = np.concatenate([[False], after - np.minimum.accumulate(sums[:-1]) >= need, [False]])
        for lo, hi in np.flatnonzero(can[1:] != can[:-1]).reshape(-1, 2).tolist():
            l, r = np.searchsorted(places, [lo, hi])
            # a word is matched at most as often as it stands in the item
            if MATCH * np.minimum(np.bincount(kinds[l:r], minlength=len(own)), times).sum() < need:
                continue
            score, end = align(item, words[lo:hi])
            if score >= need:
                back, first = align(item[::-1], words[lo : lo + end + 1][::-1])
                row = (item_id, score / full, lo + end - first, lo + end, m)
                if item_id not in found or row[1] > found[item_id][1]:
                    found[item_id] = row
    return [found[k] for k in sorted(found)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    block_grams: int = 500_000,
) -> DataFrame:
    """One row for each text row and item that align: ids, ``row_hash``, score, words from and to."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("row_hash"))
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, row_hash long, `{item_col}` long, {SCHEMA}"
    out = None
    for block in benchmark_blocks(benchmark, item_col, item_text, block_grams):
        part = _scan_block(texts, block, schema, threshold)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    block_grams: int = 500_000,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item aligns; filtered batch by batch, without a shuffle."""
    texts, schema = docs.select(docs[text_col].alias("text")), docs.schema
    at = docs.columns.index(text_col)
    for block in benchmark_blocks(benchmark, item_col, item_text, block_grams):
        seeds = _choose_seeds(texts, block, threshold)

        def clean(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [i for i, words in texts_words(b.column(at).to_pylist()) if not find_leaks(words, seeds)]
                yield b.take(pa.array(keep, pa.int64()))

        docs = docs.mapInArrow(clean, schema)
    return docs


def benchmark_blocks(benchmark: DataFrame, item_col: str, item_text: str, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item id, words) in blocks of about ``limit`` words; the query set streams through the driver."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    for r in rows.toLocalIterator():
        words = plain_words(r.t)
        if not len(words):
            continue
        if held and size + len(words) > limit:
            yield held
            held, size = [], 0
        held.append((r.i, words))
        size += len(words)
    if held:
        yield held


def _choose_seeds(texts: DataFrame, block, threshold: float) -> Seeds:
    """The block's seeds, from document counts over all texts."""
    wanted = Filter(np.concatenate([w for _, w in block]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.wanted), np.int64)
        for b in batches:
            for _, words in texts_words(b.column(0).to_pylist()):
                total[np.unique(wanted.find(words)[1])] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["g", "n"])

    df = np.zeros(len(wanted.wanted), np.int64)
    for r in texts.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        df[r.g] = r.n
    return Seeds(block, wanted, df, threshold)


def _scan_block(texts: DataFrame, block, schema: str, threshold: float) -> DataFrame:
    seeds = _choose_seeds(texts, block, threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, take = [], []
            for i, words in texts_words(b.column(1).to_pylist()):
                got = find_leaks(words, seeds)
                rows += got
                take += [i] * len(got)
            at = pa.array(take, pa.int64())
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(2).take(at), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["id", "row_hash", "item", "score", "first_word", "last_word", "item_words"],
            )

    return texts.mapInArrow(scan, schema)
