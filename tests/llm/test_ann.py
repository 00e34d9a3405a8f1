import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkassay.llm.ann import NEIGHBOURS, greedy_search, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, np.float64))
    out = {}
    for (q, qv), a in good.items():
        if q in queries:
            near = [(-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 12), i) for (i, v), b in good.items() if i != q and len(b) == len(a)]
            out[q] = sorted(near)[:k]
    return out


def run(llm, rows, queries, **kw):
    df = llm.createDataFrame(rows, SCHEMA)
    out = nearest_neighbours(df, llm.createDataFrame([(q,) for q in queries], "vec_id long"), **kw)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_recall_and_scores(llm):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[400:430] = x[7]  # a group of copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    queries = set(range(0, 900, 25)) | {401}
    want, got = brute(rows, queries), run(llm, rows, queries, shard_rows=500)
    assert set(got) == queries
    hits = 0
    for q in queries:
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(got[q][i][2] >= got[q][i + 1][2] for i in range(4)) and q not in [v for _, v, _ in got[q]]
        for _, v, s in got[q]:
            a, b = x[q].astype(np.float64), x[v].astype(np.float64)
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
        hits += len({v for _, v, _ in got[q]} & {i for _, i in want[q]})
    assert hits >= 0.9 * 5 * len(queries)
    assert [v for _, v, _ in got[401]] == [7, 400, 402, 403, 404]


def test_any_number_of_neighbours(llm):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(600, 16)).astype(np.float32))]
    df = llm.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit(0)).withColumn("node", F.lit(1))
    for k in (30, 150, 1000):
        got = {}
        for r in nearest_neighbours(df, df.where("vec_id % 100 = 0"), k=k, shard_rows=350).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = brute(rows, set(range(0, 600, 100)), k)
        assert all(len(got[q]) == min(k, 599) for q in want)
        assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_odd_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 1.0]),
            (10, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (11, [-1.0, 0.0])]
    got = run(llm, rows, [1, 3, 4, 9, 10, 12])
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == {1: [2, 9, 11], 9: [1, 2, 11]}
    assert got[1][0][2] == 1.0 and got[1][2][2] == -1.0
    empty = llm.createDataFrame([], SCHEMA)
    assert nearest_neighbours(empty, empty.select("vec_id")).count() == 0


def shard(x):
    """One shard's graph as a finished build leaves it: the nearest by bytes, equal ones in any order."""
    rng = np.random.default_rng(5)
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    s = np.rint(u * (127 / np.abs(u).max(1))[:, None])
    s /= np.linalg.norm(s, axis=1)[:, None]
    sims = s @ s.T + rng.random((len(x), len(x))) * 1e-9
    np.fill_diagonal(sims, -2)
    near = list(np.argsort(-sims, 1)[:, :NEIGHBOURS])
    return pd.DataFrame({"g_node": np.arange(len(x)), "g_unit": [r.tobytes() for r in u], "g_near": near}), u


def five_nearest(found, x, asks):
    """Share of the true five nearest of each query that the shard's answers hold."""
    hits = 0
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    for query, a in asks.items():
        far = ((unit - a / np.linalg.norm(a)) ** 2).sum(1)
        hits += len(set(np.argsort(far, kind="stable")[:5].tolist()) & set(found.node[found["query"] == query]))
    return hits / 5 / len(asks)


def test_groups_apart_are_reached_from_other_shards():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(80, 16))
    x = (np.repeat(centres, 30, 0) + 0.05 * rng.normal(size=(2400, 16))).astype(np.float32)
    graph, _ = shard(x)
    asks = {10_000 + i: c + 0.05 * rng.normal(size=16) for i, c in enumerate(centres)}
    asked = pd.DataFrame({"query": list(asks), "ask": [(a / np.linalg.norm(a)).astype(np.float32).tobytes() for a in asks.values()]})
    assert five_nearest(greedy_search(asked, graph), x, asks) > 0.98


def test_near_copies_that_bytes_do_not_tell_apart():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 32))
    for noise in (1e-5, 1e-3):
        x = (np.repeat(centres, 700, 0) + noise * rng.normal(size=(2100, 32))).astype(np.float32)
        graph, unit = shard(x)
        asks = {i: x[i].astype(np.float64) for i in range(0, 2100, 50)}
        asked = pd.DataFrame({"query": list(asks), "ask": [unit[i].tobytes() for i in asks]})
        assert five_nearest(greedy_search(asked, graph), x, asks) > 0.98
