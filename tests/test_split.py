import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkassay.operators import similarity, split


def test_folds_cover_and_are_disjoint(spark):
    for n in (3, 5, 103):
        f = split.random_folds(spark.range(n).withColumnRenamed("id", "k"), "k")
        sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and len(sizes) == min(5, n)
        parts = split.fold_parts(f, "k").groupBy("cv", "part").count().collect()
        by = {(r.cv, r.part): r["count"] for r in parts}
        for cv in range(5):
            test = by.get((cv, "test"), 0)
            assert test + by.get((cv, "valid"), 0) + by.get((cv, "train"), 0) == n
            assert by.get((cv, "valid"), 0) == max(1, round(0.1 * (n - test)))


def test_groups_never_straddle_folds(spark):
    rng = random.Random(1)
    rows = [(i, f"g{min(rng.randint(0, 12), 9)}" if i > 50 else "giant") for i in range(200)]
    out = split.group_folds(spark.createDataFrame(rows, "i int, g string"), "g")
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert out.count() == 200 and split.balance(out, "fold").first().n_folds == 5


def test_lpt_breaks_ties_by_the_first_bin():
    assert split.lpt([("a", 4), ("b", 4), ("c", 3), ("d", 3), ("e", 1)], 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}
    assert split.merge_size_chunks([(1, 5), (2, 5), (3, 9), (4, 1)], 8) == {1: 0, 2: 0, 3: 1, 4: 1}


def test_packing_is_one_group_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_GROUPS", 3)  # no limit here
    rng = random.Random(8)
    for _ in range(60):
        sizes = sorted(((i, rng.choice([1, 1, 1, 2, 3, 7, 40])) for i in range(rng.randint(1, 90))), key=lambda x: (-x[1], x[0]))
        load, got = [0] * 5, {}
        for n in sorted({n for _, n in sizes}, reverse=True):
            same = [i for i, m in sizes if m == n]
            runs = split.lpt_runs(load, n, len(same))
            for place, i in enumerate(same):
                start, bins = [r for r in runs if r[0] <= place][-1]
                got[i] = bins[(place - start) % len(bins)]
        assert got == split.lpt(sizes, 5)
    for names in ([f"g{i:03d}" for i in range(90)], list(range(-40, 50))):
        rows = [(g,) for i, g in enumerate(names) for _ in range(60 if i == 0 else rng.choice([1, 2, 5]))]
        df = spark.createDataFrame([*rows, (None,), (None,)], f"g {'string' if isinstance(names[0], str) else 'long'}").repartition(4)
        count = {}
        for (g,) in [*rows, (None,), (None,)]:
            count[g] = count.get(g, 0) + 1
        want = split.lpt(sorted(count.items(), key=lambda x: (-x[1], x[0] is None, x[0] or "" if isinstance(names[0], str) else x[0] or 0)), 5)
        out = split.group_folds(df, "g")
        assert {r.g: r.fold for r in out.collect()} == want and out.count() == len(rows) + 2


def test_balance_of_more_groups_than_the_driver_may_hold(spark, monkeypatch, tmp_path):
    from sparkassay.plans.splits import lpt_fold

    monkeypatch.setattr(split, "MAX_GROUPS", 3)
    rows = [(i, p) for p, n in ((1, 4), (2, 4), (3, 3), (4, 3), (5, 3), (None, 3), (6, 1)) for i in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert tuple(lpt_fold(spark, str(tmp_path)).first()) == (5, 3, 6, 2.0)  # 4 4 3+3 3+1 3


def test_group_limit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_GROUPS", 3)
    with pytest.raises(ValueError):
        split.group_sizes(spark.range(5).withColumnRenamed("id", "g"), "g")


def brute_butina(ids, pairs):
    near = {i: {i} for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    free, out = set(ids), {}
    while free:
        c = min(free, key=lambda i: (-len(near[i] & free), i))
        for j in near[c] & free:
            out[j] = c
        free -= near[c]
    return out


def test_butina_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 40)
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 80))} if n > 1 else set()
        assert split.butina(range(n), pairs) == brute_butina(range(n), pairs)


def test_butina_on_disk_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 6))
    x[60:75], x[80:84], x[90] = x[3], x[7], 0  # equal vectors, one without a direction
    rows = [(i * 3, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    pairs = [(3 * i, 3 * j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.6, 1)), strict=True)]
    want = brute_butina([i for i, _ in rows], pairs)
    for held in (20, 300, 10**6):  # neighbours that the driver may hold
        monkeypatch.setattr(split, "MAX_NEAR", held)
        got = split.butina_clusters(df, "id", "v", 0.6).collect()
        assert {r.id: r.centroid for r in got} == want and len(got) == len(rows)


def test_balancing_never_gets_worse():
    rng = np.random.default_rng(5)
    for _ in range(10):
        x = np.abs(rng.normal(size=(30, 6)))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        d, sizes = 1 - unit @ unit.T, rng.integers(1, 30, 30).astype(float)
        seeds = split.maxmin_seeds(sizes, d, 4)
        assert len(set(seeds)) == 4 and seeds[0] == int(np.argmax(sizes))
        fold = split.voronoi(d, seeds)
        assert all(fold[s] == i for i, s in enumerate(seeds))
        even = split.rebalance(fold, sizes, 4)
        ratio = lambda f: np.bincount(f, sizes, 4).max() / max(1, np.bincount(f, sizes, 4).min())
        assert ratio(even) <= ratio(fold) + 1e-9
        better = split.swap_search(even, sizes, d, 4)
        assert split.separation(better, sizes, d) >= split.separation(even, sizes, d) - 1e-9
        assert set(split.hybrid(x, sizes, d, 4)) <= set(range(4))


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(130, 8))
    x[50] = x[20]
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in similarity.neighbours(df, df, "id", "v", 4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.neighbour))
    for i in range(130):
        want = sorted(range(130), key=lambda j: (-round(s[i, j], 12), j))[:4]
        assert [j for _, j in sorted(got[i])] == want
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(df, "id", "v", 0.6).collect()}
    assert pairs == {(i, j) for i in range(130) for j in range(i + 1, 130) if s[i, j] >= 0.6}
    far = {r.query: r.distance for r in similarity.leakage_distance(df, "id", "v", "g").collect()}
    assert all(abs(far[i] - (1 - max(s[i, j] for j in range(130) if j % 3 != i % 3))) < 1e-9 for i in range(130))


def test_knn_residual_needs_enough_rows(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], float(i)) for i in range(5)], "id long, v array<double>, y double")
    assert similarity.knn_residual(df, "id", "v", "y", k=20).where("flagged").isEmpty()


def test_bit_similarity(spark):
    df = spark.createDataFrame([([3, 0], [1, 0]), ([0, 0], [0, 0])], "a array<long>, b array<long>")
    assert [r.s for r in df.select(similarity.tanimoto_bits(F.col("a"), F.col("b")).alias("s")).collect()] == [0.5, 0.0]
