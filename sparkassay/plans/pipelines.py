"""Whole curations as one lazy plan each: a property table from a log, an audit of many datasets, a fold report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.text import log_records
from sparkassay.operators import checks, clean, joins, metrics, split
from sparkassay.operators.robust import mask_outliers
from sparkassay.plans.catalog import query, table
from sparkassay.plans.stats import rounded


def property_table(lines: DataFrame, molecules: DataFrame, aliases: DataFrame, units: Mapping[str, str], impossible: Column, screened: str) -> DataFrame:
    """Log lines -> records -> one row a key -> labels of molecules by key, alias or text -> screened.

    ``lines`` (line_no, value), ``molecules`` (key, text, descriptors...), ``aliases``
    (alias, target).  Rows stay; impossible and outlying labels become null.
    """
    names = list(units)
    records = log_records(lines, units).where("ok")
    order = F.struct("line_no", "pos")
    labels = clean.pivot_last(records, "key", "name", "value", order, names).drop("n_overwritten")
    known = joins.expand_aliases(labels, aliases, "key", "alias", "target")
    joined = joins.fallback_join(molecules.withColumnRenamed("key", "mol_key"), known, "key", [F.col("mol_key"), F.col("text")], names)
    out = mask_outliers(joined, screened, impossible=impossible, masked=names)
    return out.withColumn("has_label", F.col("matched_key").isNotNull() & ~F.col("is_outlier"))


def audit(rows: DataFrame, catalogue: DataFrame, tests: Sequence[tuple[str, Column]], bad: DataFrame, factor: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """All datasets in one plan: (consensus rows with status, removed rows with reason).

    ``rows`` (ds, key, ord, value), ``catalogue`` (ds, lo, hi), ``bad`` (key, value, rule).
    """
    kept, rejected, _ = clean.reject_cascade(rows, tests)
    marked = clean.blacklist(kept, bad, "key", "value", "rule")
    listed = marked.where("blocked_by IS NOT NULL").withColumn("reject_reason", F.concat(F.lit("blacklist:"), "blocked_by"))
    fine = clean.limit_by_catalogue(marked.where("blocked_by IS NULL").drop("blocked_by"), catalogue, "ds", "value")
    removed = rejected.select("ds", "key", "ord", "reject_reason").unionByName(listed.select("ds", "key", "ord", "reject_reason"))
    return clean.consensus(fine, ["key"], "value", "ord", factor, ["ds"]), removed


@query(
    "property_table",
    """WITH l AS (SELECT user_id::VARCHAR AS k, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS Hf, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS S0
      FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING Hf IS NOT NULL AND S0 IS NOT NULL),
    a AS (SELECT (s_suppkey + 150)::VARCHAR AS a, s_suppkey::VARCHAR AS t FROM supplier),
    k AS (SELECT * FROM l UNION ALL SELECT a, Hf, S0 FROM a JOIN l ON t = k WHERE a NOT IN (SELECT k FROM l)),
    m AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS mk, (c_custkey - 240)::VARCHAR AS tx FROM customer),
    j AS (SELECT id, CASE WHEN p.k IS NOT NULL THEN 0 WHEN q.k IS NOT NULL THEN 1 END AS matched_key, CASE WHEN p.k IS NOT NULL THEN p.Hf ELSE q.Hf END AS Hf,
      CASE WHEN p.k IS NOT NULL THEN p.S0 ELSE q.S0 END AS S0 FROM m LEFT JOIN k p ON p.k = mk LEFT JOIN k q ON q.k = tx),
    c AS (SELECT median(S0) AS med FROM j WHERE S0 >= 1), s AS (SELECT med, 1.4826 * median(abs(S0 - med)) AS sg FROM j, c WHERE S0 >= 1 GROUP BY med),
    o AS (SELECT j.*, coalesce(S0 < 1, false) OR coalesce(S0 < med - 6 * sg OR S0 > med + 6 * sg, false) AS bad FROM j, s)
    SELECT id, matched_key, CASE WHEN NOT bad THEN Hf END AS "Hf", CASE WHEN NOT bad THEN S0 END AS "S0", matched_key IS NOT NULL AND NOT bad AS has_label FROM o""",
)
def property_table_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    number = F.col("value").cast("decimal(20,2)").cast("string")
    click = F.concat(F.lit("Hf for "), "user_id", F.lit(" is "), number, F.lit(" kJ/mol"))
    view = F.concat(F.lit("S0 for "), "user_id", F.lit(" is "), number, F.lit(" J/K"))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "click", click).otherwise(view).alias("value"))
    text = lambda c: c.cast("string")
    mols = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text(F.col("c_custkey")).alias("key"), text(F.col("c_custkey") - 240).alias("text"))
    alias = table(spark, sf_dir, "supplier").select(text(F.col("s_suppkey") + 150).alias("alias"), text(F.col("s_suppkey")).alias("target"))
    out = property_table(lines, mols, alias, {"Hf": "kJ/mol", "S0": "J/K"}, F.col("S0") < 1, "S0")
    return out.select("id", "matched_key", "Hf", "S0", "has_label")


_AUDIT = """WITH r AS (SELECT o_orderpriority AS ds, o_custkey::VARCHAR AS key, o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value FROM orders),
  b AS (SELECT key, round_even(value, 6) AS v FROM (SELECT c_custkey::VARCHAR AS key, o_totalprice AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY') GROUP BY 1, 2),
  x AS (SELECT r.*, b.key IS NOT NULL AS blocked FROM r LEFT JOIN b ON b.key = r.key AND b.v = round_even(r.value, 6)),
  k AS (SELECT * FROM x WHERE value IS NOT NULL AND value >= 2000),
  f AS (SELECT * FROM k WHERE NOT blocked AND (ds <> '5-LOW' OR value <= 300000))"""


def _audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("ds"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    catalogue = spark.createDataFrame([("5-LOW", None, 300000.0)], "ds string, lo double, hi double")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    bad = c.join(o, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").cast("string").alias("key"), F.col("o_totalprice").alias("value"), F.lit("SEGMENT").alias("rule"))
    return audit(rows, catalogue, [("no value", F.col("value").isNull()), ("small", F.col("value") < 2000)], bad)


@query(
    "audit_clean",
    _AUDIT + """, s AS (SELECT ds, 0.3 * CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 1 END AS th FROM f GROUP BY 1),
    g AS (SELECT ds, key, count(*) AS n, avg(value) AS m, max(value) - min(value) AS spread, min(ord) AS first_order FROM f GROUP BY 1, 2)
    SELECT ds, key, n, first_order, round(spread, 4) AS spread, round(th, 4) AS threshold, CASE WHEN n = 1 THEN 'kept' WHEN spread > th THEN 'rejected' ELSE 'aggregated' END AS status,
    CASE WHEN n = 1 OR spread <= th THEN round(m, 4) END AS value FROM g JOIN s USING (ds)""",
)
def audit_clean(spark, sf_dir):
    return rounded(_audit(spark, sf_dir)[0], 4)


@query(
    "audit_removed",
    _AUDIT + """ SELECT ds, key, ord, CASE WHEN value IS NULL THEN 'no value' WHEN value < 2000 THEN 'small' ELSE 'blacklist:SEGMENT' END AS reject_reason FROM x WHERE value IS NULL OR value < 2000 OR blocked""",
)
def audit_removed(spark, sf_dir):
    return _audit(spark, sf_dir)[1]


@query(
    "cv_report",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS t, ((row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) - 1) % 5)::INT AS fold, o_custkey FROM orders),
    m AS (SELECT a.fold, a.t, (SELECT avg(t) FROM p b WHERE b.fold <> a.fold) AS pred FROM p a),
    f AS (SELECT fold, avg(abs(pred - t)) AS mae, sqrt(avg((pred - t) ** 2)) AS rmse FROM m GROUP BY 1)
    SELECT count(*) AS n_folds, round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std, round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std FROM f""",
)
def cv_report(spark, sf_dir):
    """Mean-of-train predictor, cross-validated: folds, training statistics, fold metrics, roll-up."""
    rows = split.random_folds(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("t")), "o_orderkey")
    sums = rows.groupBy("fold").agg(F.sum("t").alias("s"), F.count("t").alias("c"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    pred = sums.crossJoin(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))).alias("pred"))  # one row a fold
    folds = metrics.regression(rows.join(pred, "fold"), "t", "pred", ["fold"])
    return rounded(metrics.fold_rollup(folds, [], ["mae", "rmse"]), 4)


@query(
    "table_checks",
    """SELECT 'positive' AS "check", count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS n_bad, CASE WHEN count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders
    UNION ALL SELECT 'unique', (count(*) - count(DISTINCT o_orderkey))::BIGINT, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END FROM orders
    UNION ALL SELECT 'customer known', count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), CASE WHEN count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT DISTINCT o_custkey FROM orders)""",
)
def table_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ref = joins.reference_check(o, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")
    ref = ref.select(F.lit("customer known").alias("check"), F.col("n_missing").alias("n_bad"), F.when(F.col("n_missing") == 0, "PASS").otherwise("FAIL").alias("status"))
    return checks.constraint_report(o, {"positive": F.col("o_totalprice") > 0}).unionByName(checks.unique_check(o, ["o_orderkey"])).unionByName(ref)
