"""Cleaning: cascades, consensus, rule tables, first and last wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import clean
from sparkassay.plans.catalog import query, table
from sparkassay.plans.stats import rounded

_CASE = """CASE WHEN text IS NULL OR lower(trim(text, ' ')) IN ('', 'nan', 'none') THEN 'empty'
  WHEN n_chars < 50 THEN 'short' WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'language'
  WHEN contains(lower(text), 'license') THEN 'licence' END"""


def _document_checks():
    return [
        ("empty", clean.is_missing("text")), ("short", F.col("n_chars") < 50),
        ("language", ~F.coalesce(F.col("lang").isin("en", "de", "fr"), F.lit(False))), ("licence", F.contains(F.lower("text"), F.lit("license"))),
    ]


@query("reject_cascade", f"SELECT coalesce({_CASE}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def reject_cascade(spark, sf_dir):
    return clean.reject_cascade(table(spark, sf_dir, "documents"), _document_checks())[2]


@query("reject_rows", f"SELECT doc_id, {_CASE} AS reject_reason FROM documents WHERE {_CASE} IS NOT NULL")
def reject_rows(spark, sf_dir):
    return clean.reject_cascade(table(spark, sf_dir, "documents"), _document_checks())[1].select("doc_id", "reject_reason")


@query(
    "outside_vocabulary",
    """SELECT element, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS element FROM part)
    WHERE element NOT IN ('red', 'blue', 'small', 'ring', 'bolt') GROUP BY 1""",
)
def outside_vocabulary(spark, sf_dir):
    return clean.outside_vocabulary(table(spark, sf_dir, "part"), F.split("p_name", " "), ["red", "blue", "small", "ring", "bolt"])


@query(
    "parse_numbers",
    """SELECT event_id, TRY_CAST(regexp_extract(props, ': *([^}]*)', 1) AS DOUBLE) AS x,
    round(CASE WHEN value > 0 THEN log10(value) END, 9) AS log_value FROM events""",
)
def parse_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("raw", F.regexp_extract("props", r": *([^}]*)", 1))
    return rounded(e.select("event_id", clean.to_number("raw").alias("x"), clean.guarded_log10("value").alias("log_value")), 9)


@query(
    "catalogue_limits",
    """WITH c(event_type, lo, hi) AS (VALUES ('click', 5.0, 50.0), ('view', NULL, 20.0), ('error', 10.0, NULL))
    SELECT event_id, e.event_type, value FROM events e LEFT JOIN c USING (event_type)
    WHERE coalesce(value >= lo, true) AND coalesce(value <= hi, true)""",
)
def catalogue_limits(spark, sf_dir):
    cat = spark.createDataFrame([("click", 5.0, 50.0), ("view", None, 20.0), ("error", 10.0, None)], "event_type string, lo double, hi double")
    return clean.limit_by_catalogue(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), cat, "event_type", "value")


_RULES = {"ECONOMY": "p_size > 40 OR p_retailprice < 950", "PROMO": "p_retailprice > 1500", "SMALL": "p_size < 5"}


@query(
    "rule_predicates",
    "SELECT p_partkey, p_type, coalesce(CASE p_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RULES.items())
    + " ELSE false END, false) AS hit FROM part",
)
def rule_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", clean.rule_case(_RULES, "p_type").alias("hit"))


@query(
    "blacklist",
    """WITH bad AS (SELECT l_orderkey % 1500 AS k, round_even(l_discount, 6) AS v, 'RULE_' || l_linenumber AS rule FROM lineitem WHERE 'RULE_' || l_linenumber NOT IN ('RULE_7')),
    b AS (SELECT k, v, string_agg(DISTINCT rule, '|' ORDER BY rule) AS blocked_by FROM bad GROUP BY 1, 2)
    SELECT c_custkey, blocked_by FROM (SELECT c_custkey, round_even((c_custkey % 11) / 100.0, 6) AS v FROM customer) c LEFT JOIN b ON k = c_custkey AND b.v = c.v""",
)
def blacklist(spark, sf_dir):
    bad = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1500).alias("k"), F.col("l_discount").alias("v"), F.concat(F.lit("RULE_"), F.col("l_linenumber")).alias("rule"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 11).alias("m")).select(F.col("c_custkey").alias("k"), (F.col("m") / F.lit(100.0)).alias("v"))
    return clean.blacklist(c, bad, "k", "v", "rule", exempt=["RULE_7"]).select(F.col("k").alias("c_custkey"), "blocked_by")


@query(
    "consensus_dedup",
    """WITH s AS (SELECT 0.3 * stddev_samp(l_extendedprice) AS threshold FROM lineitem),
    g AS (SELECT l_partkey, l_suppkey, count(*) AS n, avg(l_extendedprice) AS m, max(l_extendedprice) - min(l_extendedprice) AS spread, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2)
    SELECT l_partkey, l_suppkey, n, round(spread, 6) AS spread, first_order, round(threshold, 6) AS threshold,
    CASE WHEN n = 1 THEN 'kept' WHEN spread > threshold THEN 'rejected' ELSE 'aggregated' END AS status,
    CASE WHEN n = 1 OR spread <= threshold THEN round(m, 6) END AS value FROM g, s""",
)
def consensus_dedup(spark, sf_dir):
    return rounded(clean.consensus(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", "l_orderkey"))


@query(
    "first_wins",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
)
def first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return clean.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    "cap_per_key",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 8""",
)
def cap_per_key(spark, sf_dir):
    return clean.cap_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id")


@query(
    "last_wins_pivot",
    """SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS view,
    arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS purchase,
    (greatest(0, count(*) FILTER (WHERE event_type = 'click') - 1) + greatest(0, count(*) FILTER (WHERE event_type = 'view') - 1) + greatest(0, count(*) FILTER (WHERE event_type = 'purchase') - 1))::BIGINT AS n_overwritten
    FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1
    HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'view') AND bool_or(event_type = 'purchase')""",
)
def last_wins_pivot(spark, sf_dir):
    return clean.pivot_last(table(spark, sf_dir, "events"), "user_id", "event_type", "value", F.col("event_id"), ["click", "view", "purchase"])


@query(
    "average_duplicates",
    """SELECT l_partkey, l_suppkey, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 9) AS l_discount,
    arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS l_returnflag FROM lineitem GROUP BY 1, 2""",
)
def average_duplicates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "o")
    out = clean.average_duplicates(li, ["l_partkey", "l_suppkey"], ["l_extendedprice", "l_discount"], "o")
    return out.select("l_partkey", "l_suppkey", F.round("l_extendedprice", 6).alias("l_extendedprice"), F.round("l_discount", 9).alias("l_discount"), "l_returnflag")


@query(
    "upsert_summary",
    """WITH t AS (SELECT n_nationkey AS k, n_name AS name, 0 AS v FROM nation), u AS (SELECT r_regionkey AS k, r_name AS name, 1 AS v FROM region)
    SELECT * FROM t WHERE k NOT IN (SELECT k FROM u) UNION ALL SELECT * FROM u""",
)
def upsert_summary(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(0).alias("v"))
    u = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(1).alias("v"))
    return clean.upsert(t, u, "k").orderBy("k")


@query(
    "union_order",
    """WITH u AS (SELECT c_nationkey AS k, c_custkey AS id, 0 AS p FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier)
    SELECT k, CASE part_no WHEN 0 THEN 'customer' ELSE 'supplier' END AS part, id FROM
    (SELECT k, p AS part_no, id, row_number() OVER (PARTITION BY k ORDER BY p, id) AS r FROM u) WHERE r = 1""",
)
def union_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return clean.union_distinct({"customer": c, "supplier": s}, ["k"], ["id"]).select("k", "part", "id")


@query(
    "removal_log",
    """SELECT o_orderkey AS key, 'high' AS reason, o_totalprice AS value, NULL::VARCHAR AS status FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT o_orderkey, 'status', NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'P'""",
)
def removal_log(spark, sf_dir):
    from sparkassay.sources.sinks import append_log

    o = table(spark, sf_dir, "orders")
    a = o.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("key"), F.lit("high").alias("reason"), F.col("o_totalprice").alias("value"))
    b = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"), F.lit("status").alias("reason"), F.col("o_orderstatus").alias("status"))
    return append_log(b, append_log(a, None))
