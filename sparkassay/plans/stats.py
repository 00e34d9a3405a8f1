"""Statistics, screening, histograms and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import stats
from sparkassay.operators.robust import mask_outliers
from sparkassay.plans.catalog import query, table


def rounded(df, digits=6):
    """Doubles rounded, and never a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "mad_mask",
    """
    WITH m AS (SELECT o_orderpriority p, median(o_totalprice) med FROM orders WHERE o_totalprice >= 0 GROUP BY 1),
    s AS (SELECT p, med, 1.4826 * median(abs(o_totalprice - med)) sigma
          FROM orders JOIN m ON o_orderpriority = p WHERE o_totalprice >= 0 GROUP BY p, med)
    SELECT o_orderkey, o_orderpriority,
           o_totalprice < 0 OR o_totalprice < med - 1.5 * sigma OR o_totalprice > med + 1.5 * sigma AS is_outlier,
           CASE WHEN NOT (o_totalprice < 0 OR o_totalprice < med - 1.5 * sigma OR o_totalprice > med + 1.5 * sigma)
                THEN o_totalprice END AS o_totalprice
    FROM orders JOIN s ON o_orderpriority = p
    """,
)
def mad_mask(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return mask_outliers(orders, "o_totalprice", ["o_orderpriority"], k=1.5, impossible=F.col("o_totalprice") < 0)


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS subset, '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_null, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(median({c}), 6) AS median, round(max({c}), 6) AS max FROM lineitem {w}"""
        for s, w in (("all", ""), ("returned", "WHERE l_returnflag = 'R'")) for c in _COLS
    ),
)
def column_profile(spark, sf_dir):
    return rounded(stats.column_profile(table(spark, sf_dir, "lineitem"), _COLS, {"returned": F.col("l_returnflag") == "R"}))


@query(
    "group_summary",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min,
    round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max
    FROM events GROUP BY 1""",
)
def group_summary(spark, sf_dir):
    return rounded(stats.five_numbers(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query(
    "source_freq_topk",
    """SELECT lang, source, n, rank FROM (SELECT lang, source, count(*) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source)::INT AS rank FROM documents GROUP BY 1, 2) WHERE rank <= 3""",
)
def source_freq_topk(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_k(counts, ["lang"], 3, "source")


@query(
    "split_frequency",
    """SELECT part, count(*) AS n FROM (SELECT unnest(string_split(replace(p_name, ' ', '|'), '|')) AS part FROM part) WHERE trim(part) <> '' GROUP BY 1""",
)
def split_frequency(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("|")).alias("names"))
    return stats.split_frequency(parts, "names")


_STARS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 1}


@query(
    "tier_hist",
    """SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 5
    WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 ELSE 0 END AS bucket, count(*) AS n FROM orders GROUP BY 1)""",
)
def tier_hist(spark, sf_dir):
    return rounded(stats.mapped_histogram(table(spark, sf_dir, "orders"), "o_orderpriority", _STARS))


@query("rollup_counts", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY ROLLUP (o_orderstatus)")
def rollup_counts(spark, sf_dir):
    return stats.rollup_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@query(
    "norm_hist",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1, 2""",
)
def norm_hist(spark, sf_dir):
    return rounded(stats.frequency(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), 9)


@query(
    "cond_dist",
    """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) / sum(n) OVER () AS p_given, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM c)
    SELECT l_returnflag, l_linestatus, n, round(p_given, 9) AS p_given, round(p, 9) AS p,
    round(sum(p * p_given) OVER (PARTITION BY l_linestatus), 9) AS prior FROM p""",
)
def cond_dist(spark, sf_dir):
    return rounded(stats.conditional(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), 9)


@query(
    "array_histogram",
    """SELECT value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
    FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1""",
)
def array_histogram(spark, sf_dir):
    return rounded(stats.array_histogram(table(spark, sf_dir, "part"), F.split("p_name", " ")), 9)


@query(
    "edge_type_hist",
    """WITH g AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS m1,
         sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS m2 FROM lineitem GROUP BY 1),
    t AS (SELECT 0 AS type, sum(n * (n - 1) - m1 - m2)::BIGINT AS n FROM g UNION ALL SELECT 1, sum(m1)::BIGINT FROM g UNION ALL SELECT 2, sum(m2)::BIGINT FROM g)
    SELECT type, n, round(n / sum(n) OVER (), 9) AS share FROM t""",
)
def edge_type_hist(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2)
    g = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_nodes"), F.collect_list(kind).alias("types"))
    return rounded(stats.edge_type_histogram(g, "n_nodes", "types"), 9)


@query(
    "size_hist",
    """SELECT value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
    FROM (SELECT len(string_split(p_name, ' '))::INT AS value FROM part) GROUP BY 1""",
)
def size_hist(spark, sf_dir):
    return rounded(stats.size_histogram(table(spark, sf_dir, "part"), F.split("p_name", " ")), 9)


@query(
    "value_histogram",
    """WITH s AS (SELECT min(o_totalprice) a, max(o_totalprice) b, least(60, greatest(10, floor(count(o_totalprice) / 50)))::INT k FROM orders)
    SELECT bin, round(a + (bin - 1) * ((b - a) / k), 6) AS lo, round(a + bin * ((b - a) / k), 6) AS hi, count(*) AS n
    FROM (SELECT least(k, floor((o_totalprice - a) / (b - a) * k) + 1)::INT AS bin, a, b, k FROM orders, s WHERE o_totalprice IS NOT NULL) GROUP BY bin, a, b, k""",
)
def value_histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice"))


@query(
    "wasserstein_hist",
    """WITH b AS (SELECT event_type AS key, value AS x, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS side FROM events WHERE value IS NOT NULL),
    s AS (SELECT key, min(x) lo, max(x) hi, sum(1 - side) ns, sum(side) nr FROM b GROUP BY 1),
    r AS (SELECT *, nr / sum(nr) OVER () AS weight FROM s WHERE nr > 0),
    i AS (SELECT r.key, CASE WHEN hi = lo THEN 0 ELSE least(999, greatest(0, floor((x - lo) / (hi - lo) * 1000))) END::INT AS bin, side, lo, hi, ns, nr FROM b JOIN r USING (key)),
    g AS (SELECT s.key, k.bin, s.lo, s.hi, s.ns, s.nr, coalesce(c.cs, 0) cs, coalesce(c.cr, 0) cr FROM r s, (SELECT unnest(range(1000)) AS bin) k
          LEFT JOIN (SELECT key, bin, sum(1 - side) cs, sum(side) cr FROM i GROUP BY 1, 2) c ON c.key = s.key AND c.bin = k.bin),
    d AS (SELECT key, lo, hi, abs(sum(cs) OVER w / ns - sum(cr) OVER w / nr) AS gap FROM g WHERE ns > 1 WINDOW w AS (PARTITION BY key ORDER BY bin))
    SELECT r.key, round(weight, 9) AS weight, round(coalesce(w1, 0), 6) AS w1
    FROM r LEFT JOIN (SELECT key, sum(gap) * max(hi - lo) / 1000 AS w1 FROM d GROUP BY key) USING (key)""",
)
def wasserstein_hist(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    out = stats.wasserstein(e.where(~early), e.where(early), "event_type", "value")
    return out.select("key", F.round("weight", 9).alias("weight"), F.round("w1", 6).alias("w1"))


@query(
    "multinomial_draw",
    """WITH h AS (SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1),
    c AS (SELECT value, sum(n) OVER (ORDER BY value) / sum(n) OVER () AS c FROM h),
    d AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u FROM customer)
    SELECT c_custkey, (SELECT min(value) FROM c WHERE c.c > d.u) AS value FROM d""",
)
def multinomial_draw(spark, sf_dir):
    hist = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    draws = table(spark, sf_dir, "customer").select("c_custkey")
    u = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return stats.multinomial_draw(hist, draws, "value", "n", u)


@query(
    "large_group_quantiles",
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
    round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM lineitem GROUP BY 1""",
)
def large_group_quantiles(spark, sf_dir):
    from sparkassay.operators.quantiles import exact_quantiles

    q = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return q.select("l_returnflag", "n", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q05", "q50", "q95"))))


@query(
    "large_group_bounds",
    """WITH m AS (SELECT l_returnflag g, median(l_quantity) med FROM lineitem GROUP BY 1)
    SELECT g AS l_returnflag, med, round(1.4826 * median(abs(l_quantity - med)), 6) AS sigma, round(med - 6 * 1.4826 * median(abs(l_quantity - med)), 6) AS lo,
    round(med + 6 * 1.4826 * median(abs(l_quantity - med)), 6) AS hi FROM lineitem JOIN m ON g = l_returnflag GROUP BY g, med""",
)
def large_group_bounds(spark, sf_dir):
    from sparkassay.operators.quantiles import robust_bounds

    return rounded(robust_bounds(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]))
