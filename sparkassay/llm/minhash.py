"""Near-duplicate classes: banded MinHash, sequential Bayesian pruning, exact confirmation.

1. One pass over the texts gives each document its set of 5-word shingles as
   64-bit hashes, of which only a 128-bit fingerprint, the size and a signature of
   ``BANDS * ROWS`` minima are kept.  Rows with equal sets are one numbered node
   from here on.  An id with several sets links their nodes.
2. Nodes that share a band are candidates.  At a similarity of 0.75 a pair shares
   no band with probability (1 - 0.75**4)**32, about 5e-6.
3. Candidates are compared a batch of hash values at a time.  After n values with
   m equal, the posterior of the similarity under a uniform prior is Beta(m+1,
   n-m+1); a pair is dropped once P(similarity >= 0.75) falls below ``MISS``.
4. Survivors are confirmed on full sets: 100 * intersection >= 75 * union.

Pairs are never spelled out inside a group.  First each member of a band meets
only the band's smallest node; confirmed links make components.  Members of one
component need no more comparisons.  Bands whose members lie in several components
then compare members of different components, in blocks of bounded rows and bytes inside a
task, which holds their full sets: unpruned pairs are confirmed there, likeliest
first, until a member has a link to each component or has met all its members.
Only links that join components leave the task, so no link between components is
lost and what is sent grows with a group's size and not with its square.

Defined results: null or empty text, or text without words, has an empty set,
is linked with nothing and is its own component; fewer than five words are one
shingle; rows that share an id are one document, so what one of their texts is
linked with is linked with all; a row without an id is linked with nothing, has a
null component and is kept; ids are of any type that has an order; an empty table
gives no rows; input columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm._components import components
from sparkassay.llm._store import Scratch
from sparkassay.llm._words import LOWER, mix, pieces, shingle_set, word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
PERCENT = 75
MISS = 1e-6
BATCH = 16
#: A block holds about so many members, and shingles of 8 bytes.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20
SALTS = 16

_FACTOR = np.random.default_rng(77).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(78).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def needed_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """For n = BATCH, 2 BATCH, ...: the fewest equal values that keep a pair."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below = 0.0  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return out


def unpruned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two signature arrays: places that survive every batch, and their equal values."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, need in enumerate(needed_matches()):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES multiplicative hashes, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _FACTOR).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, BANDS) of 64-bit keys."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    return mix((mix(parts) * _BAND).sum(2, dtype=np.uint64)).view(np.int64)


def _text_sets(texts: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first, shingle sets) of groups of texts."""
    for first, group in pieces(texts):
        hashes, _, _, counts = word_hashes([t.translate(LOWER) for t in group])
        edges = np.concatenate([[0], np.cumsum(counts)])
        yield first, [shingle_set(hashes[edges[i] : edges[i + 1]], SHINGLE) for i in range(len(group))]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s, 3).sum(dtype=np.uint64).view(np.int64)), int(mix(s, 4).sum(dtype=np.uint64).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0)
        for first, sets in _text_sets(b.column(1).to_pylist()):
            f1, f2 = zip(*(fingerprint(s) for s in sets), strict=True)
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                    pa.array(sigs, pa.binary()),
                ],
                names=["id", "n", "f1", "f2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, f1, f2, text) to the node's set; texts of the node's id that are not the node's own are left out."""
    for b in batches:
        nodes, f1, f2 = (b.column(i).to_pylist() for i in (0, 2, 3))
        for first, sets in _text_sets(b.column(4).to_pylist()):
            own = [(nodes[i], s) for i, s in enumerate(sets, first) if fingerprint(s) == (f1[i], f2[i])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()),
                    pa.array([s.tobytes() for _, s in own], pa.binary()), pa.array([signature(s).tobytes() for _, s in own], pa.binary()),
                ],
                names=["node", "n", "shingles", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sigs))), pa.array(band_keys(sigs).ravel()),
                    pa.array(np.repeat(part.column(0).to_numpy(), BANDS)),
                ],
                names=["band", "key", "node"],
            )


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        a, b = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
        alive, _ = unpruned(a, b)
        yield t.take(pa.array(alive)).select([0, 1])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        keep = [i for i in range(t.num_rows) if linked(*(np.frombuffer(t.column(c)[i].as_buffer(), np.uint64) for c in (2, 3)))]
        yield t.take(pa.array(keep, pa.int64())).select([0, 1])


class NearDuplicates:
    """The steps for one table; ``classes`` gives one row a document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        self.scratch = Scratch(docs.sparkSession, "minhash")

    def _with(self, pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        """Pairs (a, b) with ``value`` of both nodes."""
        one = table.select(F.col("node").alias("a"), F.col(value).alias("va"))
        two = table.select(F.col("node").alias("b"), F.col(value).alias("vb"))
        return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "va", "vb")

    def classes(self) -> DataFrame:
        """id, n_shingles, component: a row for every input row."""
        cut = self.scratch.cut
        kind = self.texts.schema["id"].dataType.simpleString()
        rows = cut(self.texts.mapInArrow(_sketch, f"id {kind}, n long, f1 long, f2 long, sig binary"), "sketch")
        held = rows.where("n > 0 AND id IS NOT NULL")
        nodes = held.groupBy("n", "f1", "f2").agg(F.min("id").alias("least"), F.first("sig").alias("sig"))
        nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed by the write
        bands = cut(nodes.select("node", "sig").mapInArrow(_bands, "band int, key long, node long"), "bands")
        shared = cut(
            bands.groupBy("band", "key").agg(F.min("node").alias("leader"), F.max("node").alias("most"))
            .where("leader <> most").select("band", "key", "leader"), "shared",
        )
        members = cut(bands.join(shared.hint("merge"), ["band", "key"]), "members")
        self.scratch.drop([bands, shared])
        sets = self._full_sets(nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi"))
        sigs = nodes.select("node", "sig")
        stars = members.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        stars = cut(self._with(stars, sigs, "sig").mapInArrow(_prune, "a long, b long"), "stars")
        # first each node with its smallest leader; the rest only where that left components apart
        nearest = stars.groupBy("a").agg(F.min("b").alias("b"))
        links = self._with(nearest, sets, "shingles").mapInArrow(_confirm, "a long, b long")
        found = components(cut(links.unionByName(self._same_ids(held, nodes)), "links"), self.scratch)
        rest = cut(self._apart(stars, found), "apart")
        new = cut(self._with(rest, sets, "shingles").mapInArrow(_confirm, "a long, b long"), "links")
        found = self._joined(found, new)
        found = self._joined(found, cut(self._across(members, sets, found), "across"))
        self.scratch.drop([members, stars])
        found = self._named(found, nodes)
        named = nodes.select(F.col("n").alias("rn"), F.col("f1").alias("r1"), F.col("f2").alias("r2"), "node", "least")
        named = cut(named.join(found, F.col("node") == F.col("fn"), "left").select("rn", "r1", "r2", F.coalesce("name", "least").alias("component")), "named")
        one = rows.select("id", "n", "f1", "f2")
        return one.join(
            named.hint("merge"), (F.col("n") == F.col("rn")) & (F.col("f1") == F.col("r1")) & (F.col("f2") == F.col("r2")) & F.col("id").isNotNull(), "left"
        ).select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))

    def _full_sets(self, chosen: DataFrame) -> DataFrame:
        """node, n, shingles, sig of the chosen nodes, read from the texts of their smallest ids."""
        texts = chosen.select("node", "n", "f1", "f2", "least").hint("merge").join(self.texts, F.col("least") == F.col("id"))
        sets = self.scratch.cut(
            texts.select("node", "n", "f1", "f2", "text").mapInArrow(_sets, "node long, n long, shingles binary, sig binary"), "sets"
        )
        if sets.groupBy("node").count().where("count > 1").isEmpty():
            return sets
        return self.scratch.cut(sets.dropDuplicates(["node"]), "sets")  # equal rows

    def _same_ids(self, held: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links between the nodes of ids that have several texts."""
        none = nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
        texts = F.struct("n", "f1", "f2")
        many = self.scratch.cut(held.groupBy("id").agg(F.min(texts).alias("x"), F.max(texts).alias("y")).where("x <> y").select("id"), "many")
        if many.isEmpty():
            return none
        own = held.select("id", "n", "f1", "f2").join(many.hint("merge"), "id").distinct()
        own = self.scratch.cut(own.join(nodes.select("n", "f1", "f2", "node").hint("merge"), ["n", "f1", "f2"]).select("id", "node"), "own")
        first = own.groupBy("id").agg(F.min("node").alias("b"))
        return own.join(first.hint("merge"), "id").where("node <> b").select(F.col("node").alias("a"), "b")

    def _named(self, found: DataFrame, nodes: DataFrame) -> DataFrame:
        """fn (node) and name, the smallest id of its component; salted, as one component may hold most nodes."""
        known = self.scratch.cut(found.join(nodes.select("node", "least").hint("merge"), "node"), "known")
        names = known.groupBy("component").agg(F.min("least").alias("name"))
        names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        return salted.join(names.hint("merge"), ["component", "salt"]).select(F.col("node").alias("fn"), "name")

    def _apart(self, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs whose nodes lie in different components, smaller node second, once each."""
        one = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        two = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        both = pairs.join(one.hint("merge"), "a", "left").join(two.hint("merge"), "b", "left")
        apart = both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def _joined(self, found: DataFrame, new: DataFrame) -> DataFrame:
        """Components after more links; those so far are edges to their smallest nodes."""
        if new.isEmpty():
            return found
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new), self.scratch)

    def _across(self, members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
        """Confirmed links between different components within a band."""
        known = sets.select("node", "n").join(found.select("node", "component").hint("merge"), "node", "left")
        known = known.select("node", "n", F.coalesce("component", "node").alias("component"))
        m = self.scratch.cut(members.where("node <> leader").select("band", "key", "node").join(known.hint("merge"), "node"), "placed")
        # members of each band's commonest component meet only those outside it
        sizes = m.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
        bands = sizes.groupBy("band", "key").agg(
            F.sum("c").alias("total"), F.sum("w").alias("words"), F.max(F.struct("c", "component", "w")).alias("top"), F.count(F.lit(1)).alias("parts")
        )
        blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
        bands = bands.where("parts > 1").select(
            "band", "key", F.col("top.component").alias("main"), blocks(F.col("total"), F.col("words")).alias("nb"),
            blocks(F.col("total") - F.col("top.c"), F.col("words") - F.col("top.w")).alias("nm"),
        )
        m = m.join(bands.hint("merge"), ["band", "key"])
        spot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
        minor = m.where("component <> main").withColumn("j", (spot % F.col("nm")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("minor", F.lit(True))
        every = m.withColumn("i", (spot % F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nm") - 1))).withColumn("minor", F.lit(False))
        cols = ["band", "key", "i", "j", "minor", "node", "component"]
        blocks = minor.select(*cols).union(every.select(*cols)).join(sets.select("node", "shingles", "sig").hint("merge"), "node")
        return blocks.groupBy("band", "key", "i", "j").applyInPandas(join_block, "a long, b long")


def join_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the block's minor members and its members of other components."""
    pdf = pdf.sort_values("node")
    few, every = pdf[pdf.minor], pdf[~pdf.minor]
    out = []
    if len(few) and len(every):
        band = int(pdf.band.iloc[0])
        mine, sigs = (np.frombuffer(b"".join(x.sig), np.uint32).reshape(-1, HASHES) for x in (few, every))
        nodes, home = every.node.to_numpy(), every.component.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in every.shingles]
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        for k, (node, component, raw) in enumerate(zip(few.node, few.component, few.shingles, strict=True)):
            other = np.flatnonzero(home != component)
            alive, matches = unpruned(np.broadcast_to(mine[k], (len(other), HASHES)), sigs[other])
            # a pair is compared in the first band it shares
            first = (mine[k].reshape(BANDS, ROWS) == sigs[other[alive]].reshape(-1, BANDS, ROWS)).all(2).argmax(1) == band
            alive, matches = other[alive[first]], matches[first]
            own = np.frombuffer(raw, np.uint64)
            for i in alive[np.lexsort((nodes[alive], -matches))]:
                a, b = top(component), top(home[i])
                if a != b and linked(own, sets[i]):
                    out.append((node, nodes[i]))
                    root[max(a, b)] = min(a, b)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for every input row."""
    out = NearDuplicates(docs, id_col, text_col).classes()
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
