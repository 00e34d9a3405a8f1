"""Sources and sinks as round trips over the driver tables: written by a sink, read by a scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkassay.plans.catalog import query, table
from sparkassay.session import shared_dir
from sparkassay.sources import scan, sinks


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_parquet", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_parquet(spark, sf_dir):
    return scan.parquet(spark, f"{sf_dir}/supplier.parquet")


@query("csv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    at = _at(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), at)
    return scan.csv(spark, at)


@query("csv_by_position", "SELECT p_partkey AS a, p_size AS b, p_retailprice AS c FROM part")
def csv_by_position(spark, sf_dir):
    at = _at(spark, "csv-named")
    table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").write.csv(at)
    return scan.csv_named(spark, at, "a long, b int, c double")


@query("csv_tolerant", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 > 1 THEN c_acctbal END AS x FROM customer")
def csv_tolerant(spark, sf_dir):
    at = _at(spark, "csv-tolerant")
    key = F.col("c_custkey")
    x = F.when(key % 7 == 0, "n/a").when(key % 7 == 1, "NaN").otherwise(F.col("c_acctbal").cast("string"))
    sinks.write_csv(table(spark, sf_dir, "customer").select(key, x.alias("x")), at)
    return scan.csv_tolerant(spark, at, ["x"])


@query("text_scan", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def text_scan(spark, sf_dir):
    at = _at(spark, "text")
    table(spark, sf_dir, "orders").select("o_orderpriority").write.text(at)
    return scan.text_lines(spark, at).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("json_map_scan", "SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation")
def json_map_scan(spark, sf_dir):
    at = _at(spark, "json-map")
    one = table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("string"))))).alias("value"))
    one.coalesce(1).write.text(at)
    return scan.json_map(spark, at)


@query("json_reports", "SELECT s_nationkey AS report, count(*)::INT AS n_folds, round(avg(s_acctbal), 6) AS mae_mean FROM supplier GROUP BY 1")
def json_reports(spark, sf_dir):
    at = _at(spark, "reports")
    folds = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("report")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("fold"), F.col("s_acctbal").alias("mae"))).alias("folds"))
    folds.withColumn("name", F.col("report")).repartition("name").write.partitionBy("name").json(at)
    reports = scan.json_reports(spark, at, "report int, folds array<struct<fold:long,mae:double>>").where("_corrupt_record IS NULL")
    out = scan.mean_of_reports(reports, "folds", "mae")
    return out.select("report", F.size("folds").alias("n_folds"), F.round("mae_mean", 6).alias("mae_mean"))


@query("token_list", "SELECT p_partkey::VARCHAR AS value FROM part")
def token_list(spark, sf_dir):
    at = _at(spark, "tokens")
    table(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name")).write.text(at)
    return scan.token_list(spark, at)


def _structures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("l"))
    atoms = F.transform("l", lambda s: F.struct(s["l_quantity"].alias("x"), F.lit(0.5).alias("y"), F.lit(-1.0).alias("z"), F.lit("C").alias("element")))
    bonds = F.transform(F.slice("l", 2, F.size("l")), lambda s, i: F.struct((i + 1).alias("src"), (i + 2).alias("dst"), F.lit(1).alias("type")))
    return li.select(F.col("l_orderkey").cast("string").alias("title"), atoms.alias("atoms"), bonds.alias("bonds"), F.create_map(F.lit("key"), F.col("l_orderkey").cast("string")).alias("props"))


@query(
    "structure_round_trip",
    """SELECT l_orderkey::VARCHAR AS title, count(*)::INT AS n_atoms, (count(*) - 1)::INT AS n_bonds, round(sum(l_quantity), 4) AS x, l_orderkey::VARCHAR AS key FROM lineitem GROUP BY l_orderkey""",
)
def structure_round_trip(spark, sf_dir):
    at = _at(spark, "sdf")
    sinks.structure_text(_structures(spark, sf_dir), "title", "atoms", "bonds", "props").write.text(at)
    total = F.round(F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"]), 4)
    return scan.structure_records(spark, at).select("title", "n_atoms", "n_bonds", total.alias("x"), F.col("properties")["key"].alias("key"))


@query(
    "xyz_round_trip",
    "SELECT s_nationkey::VARCHAR AS title, count(*)::INT AS n, round(sum(s_acctbal), 3) AS x FROM supplier GROUP BY s_nationkey",
)
def xyz_round_trip(spark, sf_dir):
    at = _at(spark, "xyz")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("title")).agg(
        F.collect_list(F.struct(F.lit("N").alias("element"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))).alias("atoms"))
    text = s.select("title", F.col("title").alias("name"), sinks._xyz("title", "atoms").alias("value"))
    text.select("name", "value").repartition("name").write.partitionBy("name").text(at)
    return scan.xyz_structures(spark, at).select("title", F.size("atoms").alias("n"), F.round(F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"]), 3).alias("x"))


@query(
    "trajectory_text",
    """SELECT o_custkey, count(*)::INT AS n_frames, min(o_orderkey)::VARCHAR AS first FROM orders GROUP BY 1""",
)
def trajectory_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("title"), F.array(
        F.struct(F.lit("O").alias("element"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).alias("atoms"))
    lines = F.split("value", "\n")
    return sinks.trajectory_text(o, "o_custkey", "o_orderkey", "title", "atoms").select("o_custkey", (F.size(lines) / 3).cast("int").alias("n_frames"), lines[1].alias("first"))


@query(
    "fold_fanout",
    """SELECT (c_custkey % 5)::INT AS fold, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1, 2""",
)
def fold_fanout(spark, sf_dir):
    at = _at(spark, "folds")
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("fold"), F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("train").alias("part"))
    sinks.write_folds(c, at, fmt="parquet")
    return spark.read.parquet(at).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query(
    "staged_overwrite",
    """SELECT 'new' AS which, count(*) AS n, sum(p_size)::BIGINT AS total FROM part UNION ALL SELECT 'bak', count(*), sum(p_size)::BIGINT FROM part WHERE p_size > 10""",
)
def staged_overwrite(spark, sf_dir):
    at = _at(spark, "staged")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sinks.replace_table(p.where("p_size > 10"), at)
    sinks.replace_table(p, at)
    sinks.replace_table(p.where("false"), at, dry_run=True)
    one = lambda name, path: spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total")).select(F.lit(name).alias("which"), "n", "total")
    return one("new", at).unionByName(one("bak", f"{at}.bak"))


@query("json_with_counts", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_missing, round(sum(value), 4) AS total FROM events")
def json_with_counts(spark, sf_dir):
    at = _at(spark, "json")
    sinks.write_json(table(spark, sf_dir, "events"), at, n_rows=F.count(F.lit(1)), n_missing=F.count_if(F.col("value").isNull()), total=F.sum("value"))
    return spark.read.json(f"{at}.stats").select("n_rows", "n_missing", F.round("total", 4).alias("total"))


@query(
    "snapshot_copy",
    """SELECT 'nation' AS name, count(*) AS n_rows, 3 AS n_columns FROM nation UNION ALL SELECT 'supplier', count(*), 4 FROM supplier UNION ALL SELECT 'events', count(*), 6 FROM events""",
)
def snapshot_copy(spark, sf_dir):
    return sinks.copy_snapshot(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("nation", "supplier", "events")}, _at(spark, "snapshot"))


@query("alias_views", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def alias_views(spark, sf_dir):
    sinks.alias_views(spark, {"places": f"{sf_dir}/nation.parquet", "areas": f"{sf_dir}/region.parquet"})
    return spark.sql("SELECT r_name, count(*) AS n FROM places JOIN areas ON n_regionkey = r_regionkey GROUP BY r_name")


@query(
    "statistics_bundle",
    """SELECT 'sizes' AS stat, p_size AS key, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'regions', n_regionkey, count(*) FROM nation GROUP BY 2""",
)
def statistics_bundle(spark, sf_dir):
    at = _at(spark, "bundle")
    count = F.count(F.lit(1)).alias("n")
    sinks.write_statistics({
        "sizes": table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("key")).agg(count), "regions": table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(count),
    }, at)
    read = lambda name: spark.read.parquet(f"{at}/{name}").select(F.lit(name).alias("stat"), "key", "n")
    return read("sizes").unionByName(read("regions"))


@query("aligned_list", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_partkey::VARCHAR AS listed FROM part WHERE p_size > 5")
def aligned_list(spark, sf_dir):
    """Rows of the CSV beside what the list has on the same line of the same part."""
    at = _at(spark, "aligned")
    sinks.write_aligned(table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey", "p_name"), at, "p_partkey", ["p_partkey"], 4)
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)

    def numbered(path: str, skip: int):
        one = spark.read.text(path, wholetext=True).select(part.alias("part"), F.posexplode(F.split("value", "\n")).alias("at", "line")).where("line <> ''")
        return one.where(F.col("at") >= skip).withColumn("at", F.col("at") - skip)

    rows = numbered(f"{at}.csv", 1).select("part", "at", F.split("line", ",").alias("c"))
    return rows.join(numbered(f"{at}.list", 0), ["part", "at"]).select(F.col("c")[0].alias("p_partkey"), F.col("c")[1].alias("p_name"), F.col("line").alias("listed"))


@query("literal_rows", "SELECT * FROM (VALUES ('CCO'), ('c1ccccc1'), ('O')) t(value)")
def literal_rows(spark, sf_dir):
    return scan.literal_rows(spark, ["CCO", "c1ccccc1", "O"])


@query("markdown_report", "SELECT '| ' || r_name || ' | ' || count(*) || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def markdown_report(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    body = [line for line in sinks.markdown(n, "nations").splitlines()[4:] if line]
    return spark.createDataFrame([(line,) for line in body], "line string")
