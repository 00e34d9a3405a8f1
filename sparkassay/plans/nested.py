"""Segments, lists, replication, relaxation and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkassay.functions import geometry
from sparkassay.operators import nested, relax
from sparkassay.plans.catalog import query, table
from sparkassay.plans.stats import rounded


@query(
    "segment_softmax",
    """SELECT event_id, round(exp(value / 100 - max(value / 100) OVER w) / sum(exp(value / 100)) OVER w * exp(max(value / 100) OVER w), 9) AS softmax
    FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def segment_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 100).alias("x"))
    return rounded(nested.segment_softmax(e, ["user_id"], "x").select("event_id", "softmax"), 9)


@query(
    "merge_lists",
    """SELECT l_partkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS numbers, count(*) AS n FROM lineitem GROUP BY 1""",
)
def merge_lists(spark, sf_dir):
    part = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.collect_list("l_linenumber").alias("numbers"))
    out = nested.merge_lists(part, ["l_partkey"], "numbers")
    return out.select("l_partkey", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), "n")


@query("key_component", "SELECT l_linenumber AS component, count(*) AS n, sum(l_suppkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def key_component(spark, sf_dir):
    part = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_partkey").cast("int"), "l_linenumber").alias("key"), F.array("l_suppkey").alias("v"))
    out = nested.by_component(part, "key", 1, "v")
    return out.select("component", "n", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(
    "weighted_difference",
    """WITH a AS (SELECT event_type AS k, avg(value) AS ma FROM events WHERE user_id < 75 GROUP BY 1), b AS (SELECT event_type AS k, avg(value) AS mb, count(value) AS n FROM events WHERE user_id >= 75 GROUP BY 1)
    SELECT round(sum(coalesce(abs(ma - mb), 0) * n) / sum(n), 6) AS difference, count(*) AS n_keys FROM b LEFT JOIN a USING (k)""",
)
def weighted_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(nested.weighted_difference(e.where("user_id < 75"), e.where("user_id >= 75"), "event_type", "value"))


@query("replicate", "SELECT c_custkey, unnest(range(c_nationkey % 4 + 1))::INT AS replica FROM customer")
def replicate(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return nested.replicate(c, F.col("c_nationkey") % 4 + 1).select("c_custkey", "replica")


@query(
    "explode_first",
    """SELECT p_partkey, (i - 1)::INT AS pos, w AS item FROM (SELECT p_partkey, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT p_partkey, string_split(p_name || ' a b c d e f', ' ') AS a FROM part)) WHERE i <= 5""",
)
def explode_first(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat("p_name", F.lit(" a b c d e f")), " ").alias("words"))
    return nested.explode_first(p, "words", 5)


@query("gather_back", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS states FROM orders GROUP BY 1")
def gather_back(spark, sf_dir):
    out = nested.gather_back(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    return out.select("o_custkey", F.array_join("o_orderstatus", "").alias("states"))


@query(
    "materialise_split",
    """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT k, o_orderkey FROM s JOIN orders ON o_custkey = k UNION ALL SELECT k, NULL FROM s WHERE k NOT IN (SELECT o_custkey FROM orders)""",
)
def materialise_split(spark, sf_dir):
    s = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    hit, lost = nested.materialise_split(s, table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "k", "o_custkey")
    return hit.select("k", "o_orderkey").unionByName(lost.withColumn("o_orderkey", F.lit(None).cast("long")))


@query("by_cardinality", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 10 THEN 64 ELSE 16 END AS setting FROM orders GROUP BY 1")
def by_cardinality(spark, sf_dir):
    return nested.by_cardinality(table(spark, sf_dir, "orders"), ["o_custkey"], 10, 16, 64)


@query(
    "parameter_sweep",
    """SELECT k, z, count(*) FILTER (WHERE value > k * z) AS n_out FROM events, (VALUES (1.0), (2.0)) a(k), (VALUES (10), (20), (30)) b(z) GROUP BY 1, 2""",
)
def parameter_sweep(spark, sf_dir):
    s = nested.sweep(table(spark, sf_dir, "events").select("value"), k=[1.0, 2.0], z=[10, 20, 30])
    return s.groupBy(F.col("k").cast("decimal(2,1)").alias("k"), "z").agg(F.count_if(F.col("value") > F.col("k") * F.col("z")).alias("n_out"))


@query("prefix_choice", "SELECT 'Supplier#' AS prefix")
def prefix_choice(spark, sf_dir):
    return nested.first_matching_prefix(table(spark, sf_dir, "supplier"), "s_name", ["Customer#", "Supplier#", "S"])


@query("layer_count", "SELECT (max(TRY_CAST(regexp_extract(s_name, '#0*(\\d+)$', 1) AS INT)) + 1)::INT AS n FROM supplier")
def layer_count(spark, sf_dir):
    return nested.layers_of(table(spark, sf_dir, "supplier"), "s_name", r"#0*(\d+)$")


@query(
    "bond_geometry",
    """WITH p AS (SELECT l_orderkey AS m, l_linenumber AS i, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) AS r FROM lineitem)
    SELECT a.m, a.i, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS d FROM p a JOIN p b ON a.m = b.m AND b.i = a.i + 1 WHERE a.r = 1 AND b.r = 1""",
)
def bond_geometry(spark, sf_dir):
    from sparkassay.operators.clean import first_per_key

    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("m"), F.col("l_linenumber").alias("i"), "l_partkey", "l_extendedprice",
        F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z")).alias("p"),
    )
    p = first_per_key(li, ["m", "i"], ["l_partkey", "l_extendedprice"])
    q = p.select("m", (F.col("i") - 1).alias("i"), F.col("p").alias("q"))
    return p.join(q, ["m", "i"]).select("m", "i", F.round(geometry.distance(F.col("p"), F.col("q")), 6).alias("d"))


@query(
    "topology_check",
    "SELECT l_orderkey, bool_and(abs(l_extendedprice - l_quantity * 1500) <= 0.4 * (l_quantity * 1500)) AS ok FROM lineitem GROUP BY 1",
)
def topology_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("expected", F.col("l_quantity") * 1500)
    return geometry.topology_ok(li, "l_orderkey", "l_extendedprice", "expected")


@query("circular_difference", "SELECT event_id, round(least(abs(value * 7 - user_id * 3) % 360, 360 - abs(value * 7 - user_id * 3) % 360), 6) AS d FROM events")
def circular_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(geometry.circular(F.col("value") * 7, F.col("user_id") * 3), 6).alias("d"))


@query("relaxed_points")
def relaxed_points(spark, sf_dir):
    """Each user's events as points in a harmonic well, relaxed to its bottom."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: F.array(s["value"], F.lit(1.0))).alias("points"))
    return relax.relax(e, "user_id", "points", lambda x: -(x - 3.0)).select("user_id", "rounds", "converged")


@query(
    "isolated_labels",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value * 2, 6) END AS label, event_type = 'error' AS failed FROM events",
)
def isolated_labels(spark, sf_dir):
    def model(x: pd.Series) -> pd.Series:
        if (x < 0).any():
            raise ValueError("out of domain")
        return x * 2

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value")).alias("x"))
    return relax.label(e, "event_id", "x", model).select("event_id", F.round("label", 6).alias("label"), F.col("error").isNotNull().alias("failed"))


@query("projection")
def projection(spark, sf_dir):
    return relax.project(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 2)


@query("aligned_rmsd", "SELECT vec_id, 0.0::DOUBLE AS rmsd FROM embeddings")
def aligned_rmsd(spark, sf_dir):
    """Every vector as points in space against itself turned and shifted: the distance is 0."""
    turn = geometry.quaternion_matrix(np.array([1.0, 2.0, 3.0, 4.0])).tolist()
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, F.lit(3)), lambda v: v.cast("double"))).alias("a"))
    dot = lambda v, row: v[0] * row[0] + v[1] * row[1] + v[2] * row[2] + 5.0
    p = p.withColumn("b", F.transform("a", lambda v: F.array(*[dot(v, row) for row in turn])))
    return geometry.aligned_rmsd(p, "vec_id", "a", "b").withColumn("rmsd", F.round("rmsd", 9))
