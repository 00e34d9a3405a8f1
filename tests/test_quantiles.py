import random

import numpy as np

from sparkassay.operators.quantiles import exact_quantiles, robust_bounds


def test_against_numpy_with_ties_and_missing_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abbb"), rng.choice([7.0, 7.0, rng.gauss(0, 1), float("nan"), None])) for _ in range(900)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for accuracy, small in ((20, 0), (10_000, 0), (20, 1 << 40)):
        got = {r.g: (r.n, r.q) for r in exact_quantiles(df, ["g"], "x", shares, accuracy, small).collect()}
        check(rows, got, shares)


def check(rows, got, shares):
    for g in ("a", "b", "one"):
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, shares))
    assert "none" not in got


def test_large_groups_and_a_group_of_null(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25), np.arange(500.0)])
    rows = [(None if i % 3 else "g", float(v)) for i, v in enumerate(x)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "x", shares, 200, 0).collect()}
    for g in ("g", None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], shares))
    assert np.allclose(exact_quantiles(df, [], "x", shares, 200, 0).first().q, np.quantile(x, shares))


def test_bounds_against_numpy(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.gauss(0, 1)) for _ in range(500)]
    got = {r.g: (r.med, r.sigma, r.lo, r.hi) for r in robust_bounds(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    for g in "ab":
        v = np.array([x for k, x in rows if k == g])
        med = np.median(v)
        sigma = 1.4826 * np.median(np.abs(v - med))
        assert np.allclose(got[g], (med, sigma, med - 6 * sigma, med + 6 * sigma))


def test_order_with_a_hot_value(spark):
    """A value that most rows have is cut by its tie-breaker; ranks stay exact."""
    from sparkassay.operators.order import ranked, running_sum

    rng = random.Random(7)
    rows = [(i, 5.0 if i % 3 else float(rng.randint(0, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(4)
    for down in (False, True):
        want = [i for i, _ in sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))]
        assert [r.id for r in sorted(ranked(df, "x", "id", down).collect(), key=lambda r: r.rank_no)] == want
    total = {r.id: r.running for r in running_sum(df, ["x", "id"], df["id"]).collect()}
    s = 0
    for i, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        s += i
        assert total[i] == s
