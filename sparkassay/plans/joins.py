"""Joins and graph walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions.geometry import palindrome_key
from sparkassay.operators import joins
from sparkassay.plans.catalog import query, table


@query(
    "fallback_join",
    """SELECT p_partkey, CASE WHEN a.s_suppkey IS NOT NULL THEN 0 WHEN b.s_suppkey IS NOT NULL THEN 1 END AS matched_key,
    CASE WHEN a.s_suppkey IS NOT NULL THEN a.s_name ELSE b.s_name END AS s_name, CASE WHEN a.s_suppkey IS NOT NULL THEN a.s_acctbal ELSE b.s_acctbal END AS s_acctbal
    FROM part LEFT JOIN supplier a ON a.s_suppkey = p_partkey LEFT JOIN supplier b ON b.s_suppkey = p_partkey - 100 * p_size""",
)
def fallback_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    keys = [F.col("p_partkey"), F.col("p_partkey") - 100 * F.col("p_size")]
    return joins.fallback_join(parts, table(spark, sf_dir, "supplier"), "s_suppkey", keys, ["s_name", "s_acctbal"]).drop("p_size")


@query(
    "alias_expand",
    """WITH l AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), i AS (SELECT p_partkey AS a, p_partkey - 50 AS t FROM part)
    SELECT * FROM l UNION ALL SELECT a, v FROM i JOIN l ON t = k WHERE a NOT IN (SELECT k FROM l)""",
)
def alias_expand(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 50).alias("t"))
    return joins.expand_aliases(labels, index, "k", "a", "t")


@query(
    "alias_closure",
    """WITH l0 AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), i AS (SELECT p_partkey AS a, p_partkey - 50 AS t FROM part),
    l1 AS (SELECT * FROM l0 UNION ALL SELECT a, v FROM i JOIN l0 ON t = k WHERE a NOT IN (SELECT k FROM l0))
    SELECT * FROM l1 UNION ALL SELECT a, v FROM i JOIN l1 ON t = k WHERE a NOT IN (SELECT k FROM l1)""",
)
def alias_closure(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 50).alias("t"))
    return joins.close_aliases(labels, index, "k", "a", "t")


@query(
    "fan_out_join",
    "SELECT o_orderkey, o_custkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'",
)
def fan_out_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    "semi_anti_check",
    """SELECT count(*) AS n_keys, count(*) FILTER (WHERE k NOT IN (SELECT l_orderkey FROM lineitem)) AS n_missing FROM (SELECT DISTINCT o_orderkey AS k FROM orders)""",
)
def semi_anti_check(spark, sf_dir):
    return joins.reference_check(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "novelty",
    """WITH k AS (SELECT DISTINCT text AS k FROM documents), s AS (SELECT count(*) AS n_unique, count(*) FILTER (WHERE k NOT IN (SELECT text FROM benchmark)) AS n_novel FROM k)
    SELECT *, n_novel / n_unique AS novelty FROM s""",
)
def novelty(spark, sf_dir):
    return joins.novelty(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text", "text")


@query(
    "range_join",
    """WITH r AS (SELECT event_id AS lo_id, value AS lo, value + 0.05 AS hi FROM events WHERE event_type = 'error')
    SELECT e.event_id, lo_id FROM events e JOIN r ON e.value BETWEEN lo AND hi WHERE event_type = 'signup'""",
)
def range_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.where("event_type = 'error'").select(F.col("event_id").alias("lo_id"), F.col("value").alias("lo"), (F.col("value") + 0.05).alias("hi"))
    points = e.where("event_type = 'signup'").select("event_id", "value")
    return joins.range_join(points, r, "value", "lo", "hi", 0.1).select("event_id", "lo_id")


@query(
    "positional_join",
    """SELECT coalesce(a.i, b.i) AS ordinal, c_name, s_name FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_name FROM customer) a
    FULL JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_name FROM supplier) b ON a.i = b.i""",
)
def positional_join(spark, sf_dir):
    from sparkassay.operators.order import ranked

    c = ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_custkey").select("rank_no", "c_name")
    s = ranked(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_suppkey").select("rank_no", "s_name")
    return joins.positional_join(c, s, "rank_no", "rank_no")


_BONDS = "SELECT DISTINCT l_orderkey AS mol, l_linenumber AS src, l_linenumber % 7 + 1 AS dst FROM lineitem WHERE l_linenumber <> l_linenumber % 7 + 1"


def _bonds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("src"), (F.col("l_linenumber") % 7 + 1).alias("dst"))
    return joins.symmetrise(li.where("src <> dst"), "src", "dst")


_BOTH = f"WITH h AS ({_BONDS}), b AS (SELECT mol, src, dst FROM h UNION SELECT mol, dst, src FROM h)"


@query("angle_paths", f"{_BOTH} SELECT x.mol, x.dst AS i, x.src AS j, y.dst AS k FROM b x JOIN b y ON x.mol = y.mol AND x.src = y.src AND x.dst < y.dst")
def angle_paths(spark, sf_dir):
    return joins.angles(_bonds(spark, sf_dir))


@query(
    "triangle_paths",
    f"""{_BOTH} SELECT m.mol, least([l.dst, m.src, m.dst, r.dst], [r.dst, m.dst, m.src, l.dst])::VARCHAR AS path FROM b m JOIN b l ON l.mol = m.mol AND l.src = m.src AND l.dst <> m.dst
    JOIN b r ON r.mol = m.mol AND r.src = m.dst AND r.dst <> m.src AND r.dst <> l.dst WHERE m.src < m.dst""",
)
def triangle_paths(spark, sf_dir):
    t = joins.torsions(_bonds(spark, sf_dir))
    key = palindrome_key(F.array("a", "b", "c", "d"))
    return t.select("mol", F.concat(F.lit("["), F.array_join(F.transform(key, lambda x: x.cast("string")), ", "), F.lit("]")).alias("path"))


@query(
    "complete_graph",
    """WITH n AS (SELECT DISTINCT l_orderkey AS mol, l_linenumber AS i FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS mol, l_linenumber AS i, l_linenumber + 1 AS j FROM lineitem),
    u AS (SELECT a.mol, a.i, c.i AS j, 0 AS type FROM n a JOIN n c ON a.mol = c.mol AND a.i <> c.i UNION ALL SELECT mol, i, j, 1 FROM b)
    SELECT mol, i, j, max(type) AS type FROM u GROUP BY 1, 2, 3""",
)
def complete_graph(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("i")).distinct()
    bonds = li.select("mol", F.col("i").alias("src"), (F.col("i") + 1).alias("dst"), F.lit(1).alias("type"))
    return joins.complete_graph(li, bonds, "mol", "i")


@query(
    "ragged",
    """SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS rows FROM lineitem GROUP BY 1""",
)
def ragged(spark, sf_dir):
    r = joins.ragged(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"])
    return r.select("l_orderkey", F.array_join(F.transform("rows", lambda s: F.concat(s["l_linenumber"], F.lit(":"), s["l_partkey"])), ",").alias("rows"))


@query(
    "valency_hist",
    """WITH v AS (SELECT l_orderkey, l_suppkey, sum(CASE WHEN l_linenumber = 4 THEN 1.5 ELSE l_linenumber END)::DOUBLE AS valency FROM lineitem GROUP BY 1, 2)
    SELECT valency, count(*) AS n FROM v GROUP BY 1""",
)
def valency_hist(spark, sf_dir):
    from sparkassay.functions.chem import valency

    v = valency(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")
    return v.groupBy("valency").agg(F.count(F.lit(1)).alias("n"))


@query(
    "subgraph",
    """WITH k AS (SELECT l_orderkey AS mol, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS new
      FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <> 2),
    e AS (SELECT DISTINCT l_orderkey AS mol, l_linenumber AS src, l_linenumber + 1 AS dst FROM lineitem)
    SELECT e.mol, a.new::INT AS new_src, b.new::INT AS new_dst FROM e JOIN k a ON a.mol = e.mol AND a.i = src JOIN k b ON b.mol = e.mol AND b.i = dst""",
)
def subgraph(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("i")).distinct()
    e = n.select("mol", F.col("i").alias("src"), (F.col("i") + 1).alias("dst"))
    return joins.subgraph(n, e, "mol", "i", F.col("i") != 2)[1].select("mol", "new_src", "new_dst")
