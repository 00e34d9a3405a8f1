"""Approximate nearest neighbours: an NN-descent graph by Spark joins, searched greedily.

Build.  Equal vectors are one node, named by the smallest id.  Nodes are dealt to
shards of about ``shard_rows`` by hash; neighbours start inside a shard and so stay
there, which keeps recall the same at every size.  A round joins every node with
its neighbours and with nodes it is a neighbour of (at most ``REVERSE``, drawn by
hash each round), brings all vectors of one such list together and sends each
member the best of the others that beat its worst neighbour.  Then every node keeps
its ``NEIGHBOURS`` best.  Rounds end when few lists change.  Vectors travel as one
byte a component here; they only steer the graph.

Search.  The stated queries meet every shard in blocks: a task holds one shard's
graph and one block of queries and follows edges both ways.  Pivots are chosen so
that every node is one or next to one, so no part of the graph is without; a query
starts at its best ``ENTRIES`` pivots and at its own neighbours, and expands the
best ``BEAM`` nodes until none is new.  Where the nodes found are so close that bytes
do not tell them apart, lists of the graph say nothing, and the query is held against
all nodes of the shard instead, as it is where the nodes wanted are a large part
of the shard.  A shard gives ``spare`` nodes more than ``k``.  Nodes rank by squared distance of the unit vectors,
which does not tie where products do (``sim`` is its negative).  The best of
all shards are scored again on the original vectors in double precision, and the
copies of a node take their places by id.

Every row is indexed.  Defined results: vectors that are null, empty, zero or hold
null or non-finite components take no part, as query or candidate; vectors of other
dimensions are never compared; fewer candidates than ``k`` give all of them; an
empty table gives no rows; rows that share an id and vector are one candidate; ids are
whole numbers; columns other than id and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkassay.llm._store import Scratch, partitions

NEIGHBOURS, REVERSE, SENT = 24, 16, 5
ROUNDS, CHANGED = 12, 0.02
BEAM, ENTRIES = 128, 48
#: A task takes so many queries at most, and so few where there are cores to spare.
QUERY_BLOCK, SMALL_BLOCK = 16_384, 500
BLURS, SCAN_BLOCK, SLACK = 25, 64, 1e-5


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors: id, dimension, the original doubles, unit floats and unit bytes."""
    for b in batches:
        ids, full, unit, small, dims = [], [], [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if i is None or not v.is_valid or not len(v) or v.values.null_count:
                continue
            x = np.array(v.values, dtype=np.float64)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or top == 0:
                continue
            u = x / top
            u /= np.sqrt(u @ u)
            ids.append(i)
            dims.append(len(x))
            full.append((x + 0.0).tobytes())  # -0.0 and 0.0 are equal
            unit.append(u.astype(np.float32).tobytes())
            small.append(np.rint(u * (127 / np.abs(u).max())).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), *(pa.array(c, pa.binary()) for c in (full, unit, small))],
            names=["id", "dim", "full", "unit", "small"],
        )


def _unit_rows(raw: list[bytes]) -> np.ndarray:
    """Unit rows; shorter vectors get zeros, which change no product with their like."""
    width = max(map(len, raw), default=1)
    raw = [r if len(r) == width else r + bytes(width - len(r)) for r in raw]
    x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that never end within a run of equal first-column values; the rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))  # keys ascend within a partition
        if last == 0 and (not held or held[-1].column(0)[-1].as_py() == keys[0]):
            held.append(b)
            continue
        yield pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (pivot, member, worst, vector): what each member should hear of the others."""
    for t in _by_key(batches):
        pivots = t.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1]]))
        ends = np.append(starts[1:], len(pivots))
        members, worst = t.column(1).to_numpy(), t.column(2).to_numpy()
        vectors = _unit_rows(t.column(3).to_pylist())
        for g in range(0, len(starts), 256):
            s, e = starts[g : g + 256], ends[g : g + 256]
            width = int((e - s).max())
            at = s[:, None] + np.arange(width)
            real = at < e[:, None]
            at = np.where(real, at, s[:, None])
            x = vectors[at]
            sims = x @ x.transpose(0, 2, 1)
            same = members[at][:, :, None] == members[at][:, None, :]
            sims[~real[:, None, :] | same] = -2
            k = min(SENT, width)
            best = np.argpartition(-sims, k - 1, 2)[:, :, :k]
            value = np.take_along_axis(sims, best, 2)
            to = np.broadcast_to(members[at][:, :, None], value.shape)
            who = np.take_along_axis(np.broadcast_to(members[at][:, None, :], sims.shape), best, 2)
            ok = real[:, :, None] & (value > worst[at][:, :, None]) & (value > -2)
            yield pa.RecordBatch.from_arrays([pa.array(to[ok]), pa.array(who[ok]), pa.array(value[ok].astype(np.float32))], names=["u", "v", "sim"])


def _keep_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, sim, old) sorted by u: the best distinct v of each u, and whether v was there before."""
    for t in _by_key(batches):
        u, v, sim, old = (t.column(i).to_numpy() for i in range(4))
        o = np.lexsort((-sim, ~old, v, u))
        u, v, sim, old = u[o], v[o], sim[o], old[o]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v, sim, old = u[first], v[first], sim[first], old[first]
        o = np.lexsort((v, -sim, u))
        u, v, sim, old = u[o], v[o], sim[o], old[o]
        start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
        keep = rank < NEIGHBOURS
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (u, v, sim, old)], names=["u", "v", "sim", "old"])


class NeighbourGraph:
    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, shard_rows: int):
        self.scratch = Scratch(rows.sparkSession, "ann")
        cut = self.scratch.cut
        packed = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("x")).mapInArrow(
            _pack, "id long, dim int, full binary, unit binary, small binary"
        )
        self.rows = cut(packed.withColumn("h1", F.xxhash64("full")).withColumn("h2", F.xxhash64(F.lit(1), "full")), "rows")
        one = self.rows.groupBy("h1", "h2").agg(
            F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("dim", "full", "unit", "small"))
        )
        # shards must not depend on one another's sizes: about shard_rows each, by hash
        count = self.rows.select("h1", "h2").distinct().groupBy().count().first()[0]
        self.shards = max(1, -(-count // shard_rows))
        self.nodes = cut(one.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(self.shards))), "nodes")

    def start(self) -> DataFrame:
        """Neighbours to begin with: mates in slices of two shuffles of the shard."""
        half = NEIGHBOURS // 2 + 1
        out = None
        for seed in (1, 2):
            order = W.Window.partitionBy("dim", "shard").orderBy(F.xxhash64("node", F.lit(seed)), "node")
            mates = self.nodes.select("node", "dim", "shard", F.floor((F.row_number().over(order) - 1) / half).alias("slice"))
            pairs = mates.join(mates.withColumnRenamed("node", "mate"), ["dim", "shard", "slice"]).where("node <> mate")
            pairs = pairs.select(F.col("node").alias("u"), F.col("mate").alias("v"))
            out = pairs if out is None else out.union(pairs)
        # worst possible, so that every real similarity replaces it
        return self.scratch.cut(out.distinct().select("u", "v", F.lit(-1.5).cast("float").alias("sim"), F.lit(False).alias("old")), "start")

    def build(self) -> DataFrame:
        """Edges (u, v, sim)."""
        edges = self.start()
        small = self.nodes.select(F.col("node").alias("m"), "small")
        for turn in range(ROUNDS):
            near = edges.select(F.col("u").alias("p"), F.col("v").alias("m"))
            draw = W.Window.partitionBy("v").orderBy(F.xxhash64("u", F.lit(turn)), "u")
            back = edges.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= REVERSE).select(F.col("v").alias("p"), F.col("u").alias("m"))
            selves = self.nodes.select(F.col("node").alias("p"), F.col("node").alias("m"))
            lists = near.union(back).union(selves).distinct()
            worst = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) < NEIGHBOURS, F.lit(-1.5)).otherwise(F.min("sim")).cast("float").alias("worst"))
            full = small.join(worst, F.col("m") == F.col("u"), "left").select("m", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst"), "small")
            met = lists.join(full.hint("merge"), "m").select("p", "m", "worst", "small").repartition("p").sortWithinPartitions("p")
            heard = met.mapInArrow(_meet, "u long, v long, sim float").withColumn("old", F.lit(False))
            merged = heard.union(edges.select("u", "v", "sim", F.lit(True))).repartition("u").sortWithinPartitions("u")
            after = self.scratch.cut(merged.mapInArrow(_keep_best, "u long, v long, sim float, old boolean"), "edges")
            n, old = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("old").cast("int")), F.lit(0))).first()
            self.scratch.drop([edges])
            edges = after
            if turn > 1 and n - old <= CHANGED * n:
                break
        return edges

    def search(self, edges: DataFrame, queries: DataFrame, wanted: int) -> DataFrame:
        """For each query node (``node``): the best nodes of every shard, (query, node)."""
        lists = edges.groupBy("u").agg(F.collect_list("v").alias("near"))
        graph = self.nodes.select("shard", "dim", "node", "unit").join(lists, F.col("node") == F.col("u"), "left").select(
            "shard", "dim", "node", "unit", "near"
        )
        asked = queries.select(F.col("node").alias("query")).distinct().join(
            self.nodes.select(F.col("node").alias("query"), "dim", F.col("unit").alias("ask")), "query"
        )
        # every block meets every shard, so a shard's graph is sent once a block: blocks are as large as a
        # shard, unless there are too few shards for the cores
        count = asked.count()
        spread = min(-(-count // SMALL_BLOCK), -(-2 * partitions(self.nodes.sparkSession) // self.shards))
        blocks = max(1, -(-count // QUERY_BLOCK), spread)
        block = F.pmod(F.xxhash64("query", F.lit(9)), F.lit(blocks)).cast("int")
        asked = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.shards - 1).cast("long"))))
        graph = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["dim", "shard", "block"]
        graph = graph.select(*(F.col(c).alias(f"g_{c}") for c in graph.columns))
        def run(asks: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            return greedy_search(asks, part, wanted)

        return asked.groupBy(*keys).cogroup(graph.groupBy(*(f"g_{c}" for c in keys))).applyInPandas(run, "query long, node long, sim float")


def _both_ways(ids: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray]:
    """The shard's edges in both directions: where each node's list begins, and the lists."""
    n = len(ids)
    lists = [np.empty(0, np.int64) if v is None else np.asarray(v, np.int64) for v in near]
    u = np.repeat(np.arange(n), [len(v) for v in lists])
    v = np.searchsorted(ids, np.concatenate(lists))
    pairs = np.unique(np.concatenate([u * n + v, v * n + u]))
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n


def _pivots(starts: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Nodes such that every other one is next to one of them."""
    covered = np.zeros(len(starts) - 1, bool)
    out = []
    for i in range(len(covered)):
        if not covered[i]:
            out.append(i)
            covered[lists[starts[i] : starts[i + 1]]] = True
    return np.array(out)


def greedy_search(asked: pd.DataFrame, graph: pd.DataFrame, wanted: int = 12) -> pd.DataFrame:
    """The ``wanted`` best nodes of one shard for each query, by beam search over its graph."""
    out: list[tuple] = []
    if len(asked) and len(graph):
        graph = graph.sort_values("g_node")
        ids = graph.g_node.to_numpy()
        x = np.frombuffer(b"".join(graph.g_unit), np.float32).reshape(len(ids), -1)
        starts, lists = _both_ways(ids, graph.g_near.tolist())
        pivots = _pivots(starts, lists)
        asks = np.frombuffer(b"".join(asked["ask"]), np.float32).reshape(len(asked), -1)
        # squared distance that rounding to bytes adds between two vectors like the query
        blur = x.shape[1] / 6 * np.square(np.abs(asks).max(1) / 127)
        width = max(BEAM, 2 * wanted)
        wanted = min(wanted, len(ids))
        dense = list(range(len(asks))) if 4 * wanted >= len(ids) else []
        entries = np.argpartition(-(asks @ x[pivots].T), ENTRIES - 1, 1)[:, :ENTRIES] if len(pivots) > ENTRIES else None
        for turn, (query, q) in enumerate(zip(asked["query"], asks, strict=True)) if not dense else ():
            seen = np.zeros(len(ids), bool)
            own = np.searchsorted(ids, query)
            fresh = pivots if entries is None else pivots[entries[turn]]
            if own < len(ids) and ids[own] == query:
                fresh = np.unique(np.concatenate([fresh, lists[starts[own] : starts[own + 1]], [own]]))
            beam = np.empty(0, np.int64)
            sims = np.empty(0, np.float32)
            done = np.zeros(len(ids), bool)
            while len(fresh):
                seen[fresh] = True
                beam = np.concatenate([beam, fresh])
                sims = np.concatenate([sims, x[fresh] @ q])
                if len(beam) > width:
                    top = np.argpartition(-sims, width - 1)[:width]
                    beam, sims = beam[top], sims[top]
                grow = beam[~done[beam]]
                done[grow] = True
                fresh = np.unique(np.concatenate([lists[starts[i] : starts[i + 1]] for i in grow])) if len(grow) else grow
                fresh = fresh[~seen[fresh]]
            far = np.square(x[beam] - q).sum(1)
            top = np.lexsort((ids[beam], far))[:wanted]
            if len(top) < wanted or far[top[-1]] <= BLURS * blur[turn]:
                dense.append(turn)
                continue
            out += [(query, ids[beam[i]], -float(far[i])) for i in top]
        for turn in range(0, len(dense), SCAN_BLOCK):
            block = dense[turn : turn + SCAN_BLOCK]
            for one, sims in zip(block, asks[block] @ x.T, strict=True):
                # products of near copies tie in floats, differences do not
                near = np.flatnonzero(sims >= np.partition(sims, -wanted)[-wanted] - SLACK)
                far = np.square(x[near] - asks[one]).sum(1)
                top = np.lexsort((ids[near], far))[:wanted]
                out += [(asked["query"].iloc[one], ids[near[i]], -float(far[i])) for i in top]
    return pd.DataFrame(out, columns=["query", "node", "sim"]).astype({"query": "int64", "node": "int64", "sim": "float32"})


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i in range(b.num_rows):
            p, q = (np.frombuffer(b.column(c)[i].as_buffer(), np.float64) for c in (2, 3))
            tp, tq = np.abs(p).max(), np.abs(q).max()
            p, q = p / tp, q / tq
            out.append(float((p @ q) / (np.sqrt(p @ p) * np.sqrt(q @ q))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["query", "node", "score"])


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = 16_384, spare: int = 7
) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score`` for the ids of ``queries`` (one column, ``id_col``)."""
    g = NeighbourGraph(rows, id_col, vector_col, shard_rows)
    cut = g.scratch.cut
    names = g.rows.select("id", "h1", "h2").join(g.nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node")
    names = cut(names.distinct(), "names")
    wanted = queries.select(queries[id_col].cast("long").alias("id")).distinct()
    asked = cut(names.join(wanted, "id").select(F.col("id").alias("query_id"), F.col("node")), "asked")
    found = cut(g.search(g.build(), asked, k + spare), "found")
    best = W.Window.partitionBy("query").orderBy(F.col("sim").desc(), "node")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + spare).select("query", "node")
    vectors = g.nodes.select("node", "full")
    pairs = found.join(vectors, "node").join(vectors.select(F.col("node").alias("query"), F.col("full").alias("ask")), "query")
    scored = cut(pairs.select("query", "node", "full", "ask").mapInArrow(_score, "query long, node long, score double"), "scored")
    # a node's k + 1 smallest ids are enough, the query itself being one of them; salted, as one vector may be common
    low = W.Window.partitionBy("node", "salt").orderBy("id")
    few = names.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(W.Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("node", F.array(F.struct("r", "id")).alias("one"))
    few = few.groupBy("node").agg(F.transform(F.array_sort(F.flatten(F.collect_list("one"))), lambda s: s["id"]).alias("ids"))
    # per query node the answer once; queries that are copies of one node differ only by leaving themselves out
    filled = scored.join(few, "node").select("query", "score", F.explode("ids").alias("id"))
    order = W.Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    answers = filled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("query", "score", "id")
    asked = asked.withColumnRenamed("node", "query")
    lists = answers.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")).alias("got"))
    whole = asked.join(lists, "query").withColumn("got", F.slice(F.filter(F.array_sort("got"), lambda s: s["id"] != F.col("query_id")), 1, k))
    return whole.select("query_id", F.posexplode("got").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.minus")).alias("score")
    )
