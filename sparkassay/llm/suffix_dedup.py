"""Removal of repeated 50-byte substrings: suffix arrays per shard, merged across shards by binary search.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id.  Documents are dealt by id to shards of about ``shard_bytes`` (``best_shard``), stored
once as a table bucketed by shard; every later pass reads a shard in one task.

Only places that can matter are sorted.  Each 50-byte string names one of its
20-byte grams, the one of smallest hash, so equal strings name equal grams.  The
strings in a row that name the same gram are a run; its text is the run's context.

1. Shards send the distinct grams they name, 4 bytes each, to tasks by hash.  A
   task merges the sorted lists by binary search and answers which grams stand in
   at least two documents.
2. Of the text of those runs each shard builds a suffix array by Larsson-Sadakane
   refinement with Kasai's common prefixes, and from it the classes of equal
   50-byte strings: repeats within a shard are settled, exactly.
3. Across shards, distinct contexts with the smallest id that holds them are merged
   the same way: a context known to a smaller id is a repeat as a whole.
4. Left are contexts that differ but share a gram.  Their first holders send
   fingerprints of single strings, which are merged once more.

What moves is about 4 bytes for every 16 of text, and more only for repeated text.
A gram, context or string found in a third of all documents is sent once a shard.
Across shards a context or string is known by 96 bits of two polynomials with
independent bases: among 2**42 different strings, a false match anywhere has a
chance of about 2**-13.  Grams only choose what is compared.

Ids are whole numbers of any size a long holds.  Defined results: null or empty
text has no bytes and stays; texts below 50 bytes lose nothing; rows that share an
id are no smaller than one another, so they lose nothing to each other, and may
stand in different shards; a null id comes after all ids, the greatest long too;
rows without an id lose nothing to each other; repeated rows give equal rows; an
empty table gives no rows.  A document that is itself longer than a shard is one
shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm._store import Scratch, partitions
from sparkassay.llm._words import mix, powers, prefix_sums, span_hashes
from sparkassay.llm.suffix import DEPTH, substring_classes

GRAM = 20
SPAN = DEPTH - GRAM + 1
PIECE = 1 << 17
LOW = np.uint64(0xFFFFFFFF)
ROWS = "kind string, bucket int, shard int, data binary, docs binary"
SETTLED = ["id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
#: At most this many partitions for answers; beyond it a partition holds several buckets.
MOST_PARTITIONS = 20_000


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after the other."""
    size = hi - lo
    total = int(size.sum())
    out = np.ones(total, np.int64)
    first = np.cumsum(size)[:-1]
    keep = size > 0
    lo, size = lo[keep], size[keep]
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(size)[:-1]
    out[0] = lo[0]
    out[first] = lo[1:] - (lo[:-1] + size[:-1]) + 1
    return np.cumsum(out)


def _sliding_min(x: np.ndarray) -> np.ndarray:
    """Least of every SPAN values in a row."""
    width = 1
    while 2 * width <= SPAN:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (SPAN - width)], x[SPAN - width :])


def piece_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the documents raw[start:end]: (document, first place, last place, gram hash, context hash)."""
    sums = prefix_sums(raw)
    n = len(raw) - GRAM + 1
    gram = mix((sums[GRAM:] - sums[:n]) * powers(len(sums))[1][:n])
    named = _sliding_min((gram & ~LOW) | np.arange(n, dtype=np.uint64)) & LOW
    long = np.flatnonzero(ends - starts >= DEPTH)
    lo, hi = starts[long], ends[long] - DEPTH + 1
    places = _ranges(lo, hi)
    doc = np.repeat(long, hi - lo)
    named = named[places]
    change = np.ones(len(places), bool)
    change[1:] = (named[1:] != named[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(change)
    first = places[at]
    last = places[np.append(at[1:], len(places)) - 1] if len(at) else first
    return doc[at], first, last, gram[named[at].astype(np.int64)], span_hashes(sums, first, last + DEPTH)


class Shard:
    """A shard's documents in id order, as one buffer, and their runs.

    ``ids`` is 0 where ``none`` says that there is no id; ``rank`` numbers the
    shard's different ids in order, rows without one last and together.
    """

    def __init__(self, pdf: pd.DataFrame, buckets: int):
        ids, none = pdf["id"].to_numpy(np.int64), pdf["no_id"].to_numpy(bool)  # neither holds nulls
        texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
        order = sorted(range(len(texts)), key=lambda i: (none[i], ids[i], texts[i]))
        self.ids, self.none = ids[order], none[order]
        new = (self.ids[1:] != self.ids[:-1]) | (self.none[1:] != self.none[:-1])
        self.rank = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)[: len(texts)]
        texts = [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.buckets = np.uint64(buckets)
        parts, lo = [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + PIECE, "right")))
            a, b = self.starts[lo], self.ends[hi - 1]
            if b - a >= DEPTH:
                d, f, l, g, c = piece_runs(self.raw[a:b], self.starts[lo:hi] - a, self.ends[lo:hi] - a)
                parts.append((d + lo, f + a, l + a, g, c))
            lo = hi
        empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        self.doc, self.first, self.last, gram, self.context = (np.concatenate(x) for x in zip(*(parts or [empty]), strict=True))
        self.gram = ((gram % self.buckets) << np.uint64(32)) | (gram >> np.uint64(32))  # bucket, then 32 bits

    def __len__(self) -> int:
        return len(self.doc)

    def keep(self, mask: np.ndarray) -> None:
        self.doc, self.first, self.last, self.gram, self.context = (x[mask] for x in (self.doc, self.first, self.last, self.gram, self.context))

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, run) of every 50-byte string of the chosen runs."""
        lo, hi = self.first[runs], self.last[runs] + 1
        return _ranges(lo, hi), np.repeat(runs, hi - lo)

    def second(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes by the second polynomial of raw[lo:hi], with ``lo`` ascending."""
        out = np.empty(len(lo), np.uint64)
        a = 0
        while a < len(lo):
            b = int(np.searchsorted(lo, lo[a] + PIECE, "left"))
            sums = prefix_sums(self.raw[lo[a] : hi[a:b].max()], 1)
            out[a:b] = span_hashes(sums, lo[a:b] - lo[a], hi[a:b] - lo[a], 1)
            a = b
        return out

    def holders(self, docs: np.ndarray) -> bytes:
        """Ids of documents: how many different ones, these, a bit each for having none, and a number for each document."""
        own, at = np.unique(docs, return_inverse=True)
        kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
        return np.uint32(len(own)).tobytes() + self.ids[own].tobytes() + np.packbits(self.none[own]).tobytes() + at.astype(kind).tobytes()

    def by_bucket(
        self, kind: str, shard: int, keys: np.ndarray, data: np.ndarray, beside: np.ndarray | None = None, docs: np.ndarray | None = None
    ) -> Iterator[tuple]:
        """One row for each bucket (the high half of sorted ``keys``) that has entries; ``docs`` are sent as their ids."""
        if not len(keys):
            return
        bucket = (keys >> np.uint64(32)).astype(np.int64) if kind in "gm" else (keys % self.buckets).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        bucket = bucket[o]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True):
            part = o[a:b]
            more = beside[part].tobytes() if beside is not None else b""
            yield kind, int(bucket[a]), shard, data[part].tobytes() + more, None if docs is None else self.holders(docs[part])

    def answers(self, rows: pd.DataFrame, kind: str, keys: np.ndarray) -> np.ndarray:
        """Bits for the entries of sorted ``keys``, from the answers to what by_bucket sent."""
        out = np.zeros(len(keys), bool)
        bucket = (keys >> np.uint64(32)).astype(np.int64) if kind in "gm" else (keys % self.buckets).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        ordered = bucket[o]
        mine = rows[rows.kind == kind]
        for b, data in zip(mine.bucket, mine.data, strict=True):
            lo, hi = np.searchsorted(ordered, [b, b + 1])
            out[o[lo:hi]] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo).astype(bool)
        return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "shard", "data", "docs"])


# ---- what a shard sends and settles ----


def name_grams(shard: Shard, number: int) -> list[tuple]:
    """Distinct grams, and which of them stand in two documents of the shard."""
    keys, where = np.unique(shard.gram, return_inverse=True)
    ranks = shard.rank[shard.doc]
    low, high = np.full(len(keys), len(shard.rank)), np.full(len(keys), -1)
    np.minimum.at(low, where, ranks)
    np.maximum.at(high, where, ranks)
    return list(shard.by_bucket("g", number, keys, (keys & LOW).astype(np.uint32), (low != high).astype(np.uint8)))


def use_grams(shard: Shard, rows: pd.DataFrame) -> None:
    """Drop the runs whose gram no two documents have."""
    keys, where = np.unique(shard.gram, return_inverse=True)
    shard.keep(shard.answers(rows, "g", keys)[where])


def local_repeats(shard: Shard) -> np.ndarray:
    """Of all strings of the kept runs: whether a smaller id of this shard has it too."""
    place, run = shard.windows(np.arange(len(shard)))
    if not len(place):
        return np.empty(0, bool)
    lo, hi = shard.first, shard.last + DEPTH
    doc = shard.doc
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])])
    at = np.flatnonzero(new)
    seg_lo, seg_hi = lo[at], np.append(hi[at[1:] - 1], hi[-1]) if len(at) > 1 else hi[-1:]
    classes = substring_classes(shard.raw[_ranges(seg_lo, seg_hi)])
    offset = np.concatenate([[0], np.cumsum(seg_hi - seg_lo)])[:-1]
    seg = np.searchsorted(at, run, "right") - 1
    mine = classes[place - seg_lo[seg] + offset[seg]]
    # documents stand in id order, so a class's first string is its smallest id's: written last, it stays
    ranks = shard.rank[shard.doc[run]]
    least = np.empty(len(classes) + 1, np.int64)
    least[mine[::-1]] = ranks[::-1]
    return ranks > least[mine]


def contexts(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct contexts, first run of each, each run's context number)."""
    return np.unique(shard.context, return_index=True, return_inverse=True)


def send_contexts(shard: Shard, number: int) -> list[tuple]:
    keys, first, _ = contexts(shard)
    at = np.sort(first)
    second = np.empty(len(shard.doc), np.uint64)
    second[at] = shard.second(shard.first[at], shard.last[at] + DEPTH)
    out = list(shard.by_bucket("c", number, keys, keys, (second[first] & LOW).astype(np.uint32), shard.doc[first]))
    grams, where = np.unique(shard.gram, return_inverse=True)
    low, high = np.full(len(grams), LOW, np.uint64), np.zeros(len(grams), np.uint64)
    np.minimum.at(low, where, shard.context >> np.uint64(32))
    np.maximum.at(high, where, shard.context >> np.uint64(32))
    both = np.stack([(grams & LOW).astype(np.uint32), low.astype(np.uint32), high.astype(np.uint32)], 1)
    return out + list(shard.by_bucket("m", number, grams, both))


def open_runs(shard: Shard, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(whether a smaller id elsewhere has a run's context, whether single strings have to be compared)."""
    keys, _, where = contexts(shard)
    known = shard.answers(rows, "c", keys)[where]
    grams, of = np.unique(shard.gram, return_inverse=True)
    return known, ~known & shard.answers(rows, "m", grams)[of]


def send_strings(shard: Shard, number: int, rows: pd.DataFrame) -> list[tuple]:
    place, run, marks = open_strings(shard, open_runs(shard, rows)[1])
    keys, first = np.unique(marks, return_index=True)
    at = np.sort(first)
    second = np.empty(len(place), np.uint64)
    second[at] = shard.second(place[at], place[at] + DEPTH)
    return list(shard.by_bucket("w", number, keys, keys, (second[first] & LOW).astype(np.uint32), shard.doc[run[first]]))


def open_strings(shard: Shard, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, run, fingerprint) of the strings of open runs, document by document."""
    place, run = shard.windows(np.flatnonzero(open_))
    marks = np.empty(len(place), np.uint64)
    lo = 0
    while lo < len(place):
        a = place[lo]
        hi = int(np.searchsorted(place, a + PIECE, "left"))
        sums = prefix_sums(shard.raw[a : place[hi - 1] + DEPTH])
        marks[lo:hi] = span_hashes(sums, place[lo:hi] - a, place[lo:hi] - a + DEPTH)
        lo = hi
    return place, run, marks


def settle(shard: Shard, rows: pd.DataFrame, keep_text: bool) -> pd.DataFrame:
    """Spans and digests of every document."""
    use_grams(shard, rows)
    place, run = shard.windows(np.arange(len(shard)))
    local = rows[rows.kind == "s"]
    gone = np.unpackbits(np.frombuffer(local.data.iloc[0], np.uint8), count=len(place)).astype(bool) if len(local) and len(place) else np.zeros(len(place), bool)
    known, open_ = open_runs(shard, rows)
    gone |= known[run]
    at, _, marks = open_strings(shard, open_)
    keys, back = np.unique(marks, return_inverse=True)
    seen = shard.answers(rows, "w", keys)[back]
    edge = np.zeros(len(shard.raw) + 1, np.int32)
    for start in (place[gone], at[seen]):
        np.add.at(edge, start, 1)
        np.add.at(edge, start + DEPTH, -1)
    covered = np.cumsum(edge[:-1]) > 0
    out = []
    for i, none, a, b in zip(shard.ids.tolist(), shard.none.tolist(), shard.starts, shard.ends, strict=True):
        off = covered[a:b]
        raw = shard.raw[a:b]
        step = np.diff(np.concatenate([[0], off.astype(np.int8), [0]]))
        spans = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)
        kept = raw[~off].tobytes() if len(spans) else raw.tobytes()
        out.append((
            i, none, len(raw), int(off.sum()), len(spans), hashlib.sha256(kept).hexdigest(),
            spans.ravel().tolist(), kept if keep_text else None,
        ))
    return pd.DataFrame(out, columns=SETTLED)


# ---- merging what shards sent ----


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers for one bucket: a bit for each entry of each shard; a shard's own state passes through."""
    kind = pdf.kind.iloc[0]
    if kind == "s":
        return _frame(list(pdf[["kind", "bucket", "shard", "data", "docs"]].itertuples(index=False, name=None)))
    if kind == "g":
        lists = [np.frombuffer(d, np.uint32, len(d) // 5) for d in pdf.data]
        twice = [np.frombuffer(d, np.uint8, offset=4 * len(x)).astype(bool) for d, x in zip(pdf.data, lists, strict=True)]
        every = np.sort(np.concatenate(lists))
        again = every[1:][every[1:] == every[:-1]]
        shared = np.unique(np.concatenate([again, *(x[t] for x, t in zip(lists, twice, strict=True))]))
        bits = [_found(shared, x) for x in lists]
    elif kind == "m":
        lists = [np.frombuffer(d, np.uint32).reshape(-1, 3) for d in pdf.data]
        every = np.concatenate(lists)
        grams, where = np.unique(every[:, 0], return_inverse=True)
        low, high = np.full(len(grams), np.iinfo(np.uint32).max, np.uint32), np.zeros(len(grams), np.uint32)
        np.minimum.at(low, where, every[:, 1])
        np.maximum.at(high, where, every[:, 2])
        mixed = grams[low != high]
        bits = [_found(mixed, x[:, 0]) for x in lists]
    else:
        lists = [np.frombuffer(d, np.uint64, len(d) // 12) for d in pdf.data]
        seconds = [np.frombuffer(d, np.uint32, offset=8 * len(x)) for d, x in zip(pdf.data, lists, strict=True)]
        docs, none = zip(*(_read_holders(d) for d in pdf.docs), strict=True)
        every, beside, ids, no_id = (np.concatenate(x) for x in (lists, seconds, docs, none))
        o = np.lexsort((ids, no_id, beside, every))
        every, beside, ids, no_id = every[o], beside[o], ids[o], no_id[o]
        first = np.ones(len(every), bool)
        first[1:] = (every[1:] != every[:-1]) | (beside[1:] != beside[:-1])
        keys, second, least, unheld = every[first], beside[first], ids[first], no_id[first]
        bits = []
        for x, y, d, n in zip(lists, seconds, docs, none, strict=True):
            at = np.searchsorted(keys, x)
            while len(off := np.flatnonzero(second[at] != y)):  # keys that agree in 64 bits only
                at[off] += 1
            bits.append(~unheld[at] & (n | (d > least[at])))
    return _frame([(kind, b, s, np.packbits(x).tobytes(), None) for b, s, x in zip(pdf.bucket, pdf.shard, bits, strict=True)])


def _read_holders(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whether there is none) as Shard.holders packed them."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    bits = -(-n // 8)
    ids = np.frombuffer(data, np.int64, n, 4)
    none = np.unpackbits(np.frombuffer(data, np.uint8, bits, 4 + 8 * n), count=n).astype(bool)
    at = np.frombuffer(data, np.uint16 if n <= 1 << 16 else np.uint32, offset=4 + 8 * n + bits)
    return ids[at], none[at]


def merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``merge`` of each bucket in rows sorted by kind and bucket; one bucket is held at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        change = (b.kind != b.kind.shift()) | (b.bucket != b.bucket.shift())
        for _, part in b.groupby(change.cumsum(), sort=False):
            if held and (held[0].kind.iloc[0], held[0].bucket.iloc[0]) != (part.kind.iloc[0], part.bucket.iloc[0]):
                yield merge(pd.concat(held))
                held = []
            held.append(part)
    if held:
        yield merge(pd.concat(held))


def _found(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted keys, by binary search."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def best_shard(total: int) -> int:
    """Bytes of a shard: 4 MB up to 256 GB of text, then growing with its root up to 64 MB at 64 TB.

    Every shard has something for nearly every bucket, so small shards of a large
    corpus would send rows of a few bytes.  A shard needs about 60 times its
    repeated text in memory.
    """
    return int(min(64 << 20, max(4 << 20, (4 << 20) * (total / (256 << 30)) ** 0.5)))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int | None = None, keep_text: bool = True
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (start, stop, ...) and ``kept`` bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    ident = docs[id_col].cast("long")
    # a null among longs would reach Python as a float: the id and its absence travel apart
    one = docs.select(F.coalesce(ident, F.lit(0).cast("long")).alias("id"), ident.isNull().alias("no_id"), docs[text_col].alias("text"))
    total = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // (shard_bytes or best_shard(total))))
    files, buckets = min(shards, 20_000), max(1, -(-shards // 4))
    # by id and text, so that an id with many texts is spread
    number = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")
    at = scratch.path("shards")
    name = "suffix_" + at.rsplit("/", 2)[-2].replace("-", "_")
    (
        one.withColumn("shard", number).repartition(files, "shard").write.bucketBy(files, "shard").sortBy("shard")
        .option("path", at).saveAsTable(name)
    )
    table = spark.table(name)
    scratch.forget()

    def with_answers(rows: DataFrame, step, schema: str) -> DataFrame:
        rows = rows.select(*(F.col(c).alias(f"a_{c}" if c == "shard" else c) for c in rows.columns))
        return table.groupBy("shard").cogroup(rows.groupBy("a_shard")).applyInPandas(step, schema)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(name_grams(Shard(pdf, buckets), int(pdf["shard"].iloc[0])))

    def second(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _frame([])
        shard, no = Shard(pdf, buckets), int(pdf["shard"].iloc[0])
        use_grams(shard, rows)
        state = ("s", no, no, np.packbits(local_repeats(shard)).tobytes(), None)
        return _frame([state, *send_contexts(shard, no)])

    def third(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _frame([])
        shard = Shard(pdf, buckets)
        use_grams(shard, rows)
        return _frame(send_strings(shard, int(pdf["shard"].iloc[0]), rows))

    def last(pdf: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=SETTLED)
        return settle(Shard(pdf, buckets), rows, keep_text)

    # partitions by the number of buckets, so that a task's share does not grow with the table; never fewer than the session's
    wide = max(partitions(spark), min(buckets, MOST_PARTITIONS))

    def merged(rows: DataFrame, label: str) -> DataFrame:
        # dealt by number and not by hash: no partition has two buckets of a kind while another has none
        rows = rows.repartitionById(wide, F.pmod("bucket", F.lit(wide))).sortWithinPartitions("kind", "bucket", "shard")
        out = scratch.cut(rows.mapInPandas(merge_runs, ROWS), label)
        del rows
        scratch.forget()
        return out

    grams = merged(table.groupBy("shard").applyInPandas(first, ROWS), "grams")
    known = merged(with_answers(grams, second, ROWS), "contexts")
    strings = merged(with_answers(grams.union(known), third, ROWS), "strings")
    out = with_answers(
        grams.union(known).union(strings), last,
        "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary",
    )
    out = scratch.cut(out.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id"), "settled")
    scratch.drop([grams, known, strings])
    spark.sql(f"DROP TABLE {name}")
    scratch.remove(at)
    return out.withColumnRenamed("id", id_col)
