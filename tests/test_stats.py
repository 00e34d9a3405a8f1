import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from sparkassay.operators import metrics, stats
from sparkassay.operators.order import (
    best_of_last, cost_batches, patience, prefix_offsets, rank_quartiles, ranked, running_sum, shuffled, z_score,
)


def test_nan_is_missing_in_every_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0), ("b", -0.0)], "g string, x double")
    r = stats.column_profile(df, ["x"], {"a": F.col("g") == "a"}).collect()
    assert [(x.subset, x.n, x.n_null, x.mean) for x in r] == [("all", 3, 2, 4 / 3), ("a", 2, 2, 2.0)]
    five = {x.g: x for x in stats.five_numbers(df, "x", ["g"]).collect()}
    assert five["a"].std == 1.0 and five["a"].median == 2.0 and five["b"].n == 1


def test_quantiles_of_small_groups(spark):
    for n in range(1, 6):
        values = [float(i * i) for i in range(n)]
        r = stats.five_numbers(spark.createDataFrame([("g", v) for v in values], "g string, x double"), "x", ["g"]).first()
        assert np.allclose([r.q1, r.median, r.q3], np.quantile(values, [0.25, 0.5, 0.75]))
        q = rank_quartiles(spark.createDataFrame([("g", v) for v in values], "g string, x double"), ["g"], "x").first()
        assert (q.q1, q.q3) == (values[n // 4], values[3 * n // 4])


def test_histogram_of_a_constant_and_of_spread_values(spark):
    same = stats.histogram(spark.createDataFrame([(4.0,)] * 5, "x double"), "x").collect()
    assert [(r.bin, r.n) for r in same] == [(1, 5)]
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(2000)]
    rows = stats.histogram(spark.createDataFrame([(v,) for v in x], "x double"), "x").collect()
    assert sum(r.n for r in rows) == 2000 and max(r.bin for r in rows) == 40


def test_wasserstein_against_sorted_samples(spark):
    rng = random.Random(2)
    a, b = [rng.gauss(0, 1) for _ in range(800)], [rng.gauss(0.7, 1.3) for _ in range(800)]
    mk = lambda v, k="k": spark.createDataFrame([(k, x) for x in v], "k string, x double")
    got = {r.key: r for r in stats.wasserstein(mk(a).union(mk([1.0], "once")), mk(b).union(mk([2.0, 3.0], "once")).union(mk([1.0], "gone")), "k", "x").collect()}
    exact = float(np.abs(np.sort(a) - np.sort(b)).mean())
    assert abs(got["k"].w1 - exact) < 0.02 * exact + 0.01
    assert got["once"].w1 == got["gone"].w1 == 0 and abs(sum(r.weight for r in got.values()) - 1) < 1e-12


def test_conditional_and_edge_types(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2)], "a string, c int")
    got = {(r.a, r.c): (r.p, r.prior) for r in stats.conditional(df, "a", "c").collect()}
    assert math.isclose(got["x", 1][0], 2 / 3) and math.isclose(got["y", 2][1], 0.5)
    g = spark.createDataFrame([(3, [1, 1, 2, 2]), (1, [])], "n int, t array<int>")
    assert {r.type: r.n for r in stats.edge_type_histogram(g, "n", "t").collect()} == {0: 2, 1: 2, 2: 2}


def test_metrics_and_their_guards(spark):
    rows = [("d", f, t, t + e) for f in (0, 1) for t, e in ((1.0, 0.5), (2.0, -0.5), (4.0, 1.0 + f))] + [("one", 0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "ds string, fold int, t double, p double")
    r = {x.ds: x for x in metrics.pooled_and_averaged(df, "ds", "fold", "t", "p").collect()}
    t, p = np.array([x[2] for x in rows[:-1]]), np.array([x[3] for x in rows[:-1]])
    assert math.isclose(r["d"].mae_pooled, np.abs(p - t).mean()) and math.isclose(r["d"].r2_pooled, 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    folds = [np.abs(p[:3] - t[:3]).mean(), np.abs(p[3:] - t[3:]).mean()]
    assert math.isclose(r["d"].mae_std, statistics.stdev(folds)) and r["one"].r2_pooled is None and r["one"].mae_std == 0
    f = spark.createDataFrame([("d", 3, 1.0, None), ("d", 1, 2.0, 5.0)], "ds string, n int, mae double, opt double")
    assert metrics.fold_rollup(f, ["ds"], ["mae"], ["opt"]).first().opt_mean is None
    w = metrics.weighted_fallback(f.withColumn("rmse", F.col("mae")), "ds").first()
    assert w.mae == 1.25 and math.isclose(w.rmse, math.sqrt((3 + 4) / 4))
    m = metrics.masked_means(spark.createDataFrame([(1.0, float("nan")), (3.0, None)], "a double, b double"), ["a", "b"]).first()
    assert (m.a, m.b) == (2.0, 0.0)


def test_ensemble_of_one_replica_has_no_spread(spark):
    df = spark.createDataFrame([(1, 1.0, 1.5), (2, 2.0, 2.0), (2, 2.0, 3.0)], "g int, t double, p double")
    e = metrics.ensemble(df, "g", "t", "p").first()
    assert (e.ens_n, e.row_n) == (2, 3) and math.isclose(e.ens_mae, 0.5) and math.isclose(e.std_mean, 0.25)


def test_order_without_one_task(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 40)), rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, n int").repartition(7)
    got = {r.id: (r.rank_no, r.rank_n) for r in ranked(df, "x", "id", descending=True).collect()}
    want = {r[0]: (k + 1, 500) for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    run = {r.id: r.running for r in running_sum(df, ["x", "id"], F.col("n")).collect()}
    total, expect = 0, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        total += r[2]
        expect[r[0]] = total
    assert run == expect
    import hashlib

    key = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    order = {r.id: r.shuffle_no for r in shuffled(df, "id").collect()}
    assert order == {i: k for k, i in enumerate(sorted(range(500), key=lambda i: (key(i), i)))}
    offs = {r.id: (r.start, r.stop) for r in prefix_offsets(df, "id", "n").collect()}
    assert offs[0] == (0, rows[0][2]) and offs[499][1] == sum(r[2] for r in rows)
    batches = cost_batches(df, "n", "id", 200.0).groupBy("batch").agg(F.sum(F.col("n") * F.col("n")).alias("c")).collect()
    assert all(b.c <= 200 + 81 for b in batches) and sum(b.c for b in batches) == sum(r[2] ** 2 for r in rows)


def test_window_operators(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 3.0, 3.5])], "g string, o int, v double")
    p = patience(df, ["g"], ["o"], "v", 2).orderBy("o").collect()
    assert [(r.best, r.waited, r.stopped) for r in p] == [(5, 0, False), (4, 0, False), (4, 1, False), (4, 2, True), (3, 0, True), (3, 1, True)]
    assert best_of_last(df, ["g"], ["o"], "v", 2).first().v == 3.0 and best_of_last(df.where("o < 4"), ["g"], ["o"], "v", 2).first().v == 4.2
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, v double")
    assert [r.z for r in z_score(flat, ["g"], "v", F.lit(True)).collect()] == [0.0, 0.0]


def test_smallest_value_weighs_keys_and_skips_missing(spark, tmp_path):
    from sparkassay.plans.metrics import argmin_where

    rows = [(1, 150_000, "O", 10.0), (1, 2, "F", 10.05), (2, 3, "O", None), (2, 4, "O", 7.0), (3, 5, "O", None), (4, 9, "F", 1.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_custkey: (r.best, r.best_flagged) for r in argmin_where(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 150_000), 2: (4, 4), 3: (None, None), 4: (9, None)}


def test_equal_residuals_rank_by_key(spark, tmp_path):
    from sparkassay.plans.metrics import noise_rank

    rng = random.Random(6)
    # two orders a customer: their residuals have the same size
    rows = [(2 * i + j, i, round(rng.uniform(900, 500_000), 2)) for i in range(300) for j in range(2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r.rank_no, r.o_orderkey, abs(r.residual)) for r in noise_rank(spark, str(tmp_path)).collect())
    assert len(got) >= 30 and [(no, k) for no, k, _ in got] == [(i + 1, k) for i, (_, k, _) in enumerate(sorted(got, key=lambda x: (-x[2], x[1])))]
    # a ratio that rounds to the cut is on it
    df = spark.createDataFrame([(1, 0.0, 1.4999996), (2, 2.0, 2.0)], "k long, t double, p double")
    assert [r.k for r in metrics.noise_rank(df, "k", "t", "p", top=0, digits=6).collect()] == [1]
