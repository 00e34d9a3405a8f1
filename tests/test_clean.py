import pytest
from pyspark.sql import functions as F

from sparkassay.operators import checks, clean


def test_cascade_counts_the_first_reason_and_adds_up(spark):
    rows = [(1, None, 5.0), (2, " NaN ", 5.0), (3, "x", -1.0), (4, "x", 200.0), (5, "", -1.0), (6, "ok", 7.0), (7, "ok", None)]
    df = spark.createDataFrame(rows, "id int, t string, v double")
    tests = [("empty", clean.is_missing("t")), ("negative", F.col("v") < 0), ("high", F.col("v") > 100)]
    kept, bad, counts = clean.reject_cascade(df, tests)
    got = {r.reason: r.n for r in counts.collect()}
    assert got == {"empty": 3, "negative": 1, "high": 1, "kept": 2}
    assert {r.id for r in kept.collect()} == {6, 7}
    assert {r.id: r.reject_reason for r in bad.collect()}[5] == "empty"
    assert sum(got.values()) == len(rows)


def test_consensus_around_the_threshold(spark):
    rows = [("one", 1.0, 0), ("same", 5.0, 1), ("same", 5.0, 2), ("near", 10.0, 3), ("near", 10.5, 4), ("far", 0.0, 5), ("far", 50.0, 6), ("edge", 0.0, 7), ("edge", 4.0, 8)]
    df = spark.createDataFrame(rows, "k string, v double, o int")
    import statistics

    sigma = statistics.stdev(v for _, v, _ in rows)
    got = {r.k: r for r in clean.consensus(df, ["k"], "v", "o", factor=(4.0 + 1e-9) / sigma).collect()}
    assert {k: r.status for k, r in got.items()} == {"one": "kept", "same": "aggregated", "near": "aggregated", "far": "rejected", "edge": "aggregated"}
    assert got["near"].value == 10.25 and got["far"].value is None and got["edge"].first_order == 7
    assert abs(got["one"].threshold - 4.0) < 1e-8
    single = clean.consensus(df.where("k = 'one'"), ["k"], "v", "o").first()
    assert single.threshold == pytest.approx(0.3) and single.status == "kept"
    again = clean.consensus(df.where("k = 'near'").groupBy("k").agg(F.avg("v").alias("v"), F.min("o").alias("o")), ["k"], "v", "o").first()
    assert again.status == "kept" and again.value == 10.25


def test_consensus_within_datasets(spark):
    rows = [("a", "k", 0.0, 0), ("a", "k", 1.0, 1), ("a", "z", 100.0, 2), ("b", "k", 0.0, 3), ("b", "k", 1.0, 4)]
    got = {r.ds: r.status for r in clean.consensus(spark.createDataFrame(rows, "ds string, k string, v double, o int"), ["k"], "v", "o", within_cols=["ds"]).where("k = 'k'").collect()}
    assert got == {"a": "aggregated", "b": "rejected"}


def test_blacklist_rounds_both_sides_alike(spark):
    df = spark.createDataFrame([("a", 0.1234565), ("b", 1.0), ("c", None)], "k string, v double")
    bad = spark.createDataFrame([("a", 0.1234565, "R2"), ("a", 0.1234565, "R1"), ("b", 1.0, "KEEP"), ("c", 1.0, "R1")], "k string, v double, rule string")
    got = {r.k: r.blocked_by for r in clean.blacklist(df, bad, "k", "v", "rule", exempt=["KEEP"]).collect()}
    assert got == {"a": "R1|R2", "b": None, "c": None}


def test_first_and_last_wins(spark):
    rows = [("a", "p", 1.0, 2), ("a", "p", 9.0, 1), ("a", "q", 5.0, 0), ("b", "p", 3.0, 7)]
    df = spark.createDataFrame(rows, "k string, n string, v double, o int")
    assert {r.k: r.v for r in clean.first_per_key(df, ["k"], ["o"]).collect()} == {"a": 5.0, "b": 3.0}
    wide = clean.pivot_last(df, "k", "n", "v", F.col("o"), ["p", "q"]).collect()
    assert [(r.k, r.p, r.q, r.n_overwritten) for r in wide] == [("a", 1.0, 5.0, 1)]
    assert clean.pivot_last(df, "k", "n", "v", F.col("o"), ["p", "q"], complete=False).count() == 2
    assert {r.o for r in clean.cap_per_key(df, ["k"], ["o"], 2).collect()} == {0, 1, 7}


def test_union_and_upsert(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert {(r.k, r.v) for r in clean.upsert(a, b, "k").collect()} == {(1, "y"), (2, "z")}
    assert {(r.k, r.v, r.part) for r in clean.union_distinct({"a": a, "b": b}, ["k"], ["v"]).collect()} == {(1, "x", "a"), (2, "z", "b")}
    assert clean.same_rows(b, b.orderBy(F.desc("k"))) and not clean.same_rows(a, b)


def test_rules_and_limits(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", None), ("b", 5.0), ("c", 5.0)], "ds string, x double")
    assert [r.h for r in df.select(clean.rule_case({"a": "x > 1", "b": "x > 10"}, "ds").alias("h")).collect()] == [True, False, False, False]
    cat = spark.createDataFrame([("a", 6.0, None), ("b", None, 6.0)], "ds string, lo double, hi double")
    assert sorted((r.ds, r.x) for r in clean.limit_by_catalogue(df, cat, "ds", "x").collect() if r.x) == [("b", 5.0), ("c", 5.0)]
    assert [r.x for r in spark.createDataFrame([("1e3",), ("abc",), ("nan",), (None,)], "s string").select(clean.to_number("s").alias("x")).collect()] == [1000.0, None, None, None]
    assert spark.createDataFrame([(0.0,), (100.0,)], "v double").select(clean.guarded_log10("v").alias("l")).collect()[0].l is None


def test_constraint_report(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, 200.0)], "k int, v double")
    got = {r.check: (r.n_bad, r.status) for r in checks.constraint_report(df, {"v": F.col("v") < 100, "k": F.col("k") > 0, "w": F.col("v").isNotNull()}, {"w": 5}).collect()}
    assert got == {"v": (2, "FAIL"), "k": (0, "PASS"), "w": (1, "WARN")}
    assert checks.unique_check(df, ["k"]).first().n_bad == 1
    assert checks.schema_check(df, {"k": "int", "x": "string"}) == ["missing x", "extra v"]
    assert checks.schema_check(df, {"v": "double", "k": "int"}) == ["columns are out of order"]
    with pytest.raises(ValueError):
        checks.require_rows(df, 4)
