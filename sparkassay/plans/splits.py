"""Splits, similarity search, clusters and packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkassay.operators import similarity, split
from sparkassay.operators.order import rank_quartiles
from sparkassay.plans.catalog import query, table
from sparkassay.plans.stats import rounded

_ORDER = "row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) - 1"


@query("kfold_random", f"SELECT o_orderkey, (({_ORDER}) % 5)::INT AS fold FROM orders")
def kfold_random(spark, sf_dir):
    return split.random_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "kfold_valid",
    f"""WITH f AS (SELECT o_orderkey, (({_ORDER}) % 5)::INT AS fold FROM orders), w AS (SELECT *, unnest(range(5))::INT AS cv FROM f),
    p AS (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY md5(o_orderkey || '|' || cv || '|42'), o_orderkey || '|' || cv) - 1 AS no, count(*) OVER (PARTITION BY cv) AS n FROM w WHERE fold <> cv)
    SELECT o_orderkey, fold, cv, CASE WHEN no < greatest(1, round_even(0.1 * n, 0)) THEN 'valid' ELSE 'train' END AS part FROM p
    UNION ALL SELECT o_orderkey, fold, cv, 'test' FROM w WHERE fold = cv""",
)
def kfold_valid(spark, sf_dir):
    folds = split.random_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return split.fold_parts(folds, "o_orderkey")


@query(
    "three_way_split",
    """WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey) - 1 AS no, count(*) OVER () AS n FROM customer),
    t AS (SELECT *, n < 100000 + floor(0.1 * n) + 1 AS small FROM s)
    SELECT c_custkey, CASE WHEN no < CASE WHEN small THEN floor(0.8 * n) ELSE 100000 END THEN 'train'
      WHEN no < CASE WHEN small THEN floor(0.8 * n) + floor(0.1 * n) ELSE n - floor(0.1 * n) END THEN 'valid' ELSE 'test' END AS part FROM t""",
)
def three_way_split(spark, sf_dir):
    return split.three_way(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def _lpt_sql(source: str, key: str) -> str:
    """Largest group first into the emptiest of five bins, one group a step."""
    return f"""WITH RECURSIVE s AS (SELECT {key} AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {key}) AS r FROM {source} GROUP BY 1),
    p(r, g, n, fold, load) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0, [0, 0, 0, 0, 0]::BIGINT[]
      UNION ALL SELECT r, g, n, spot - 1, list_transform(load, lambda x, i: CASE WHEN i = spot THEN x + n ELSE x END)
      FROM (SELECT s.r, s.g, s.n, load, list_position(load, list_min(load)) AS spot FROM p JOIN s ON s.r = p.r + 1))"""


@query("group_kfold", _lpt_sql("orders", "o_custkey") + " SELECT o_custkey, o_orderkey, fold::INT AS fold FROM orders JOIN p ON g = o_custkey")
def group_kfold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return split.group_folds(o, "o_custkey").where("o_custkey IS NOT NULL")  # null takes room in a fold, its rows are in none


@query(
    "lpt_fold",
    _lpt_sql("lineitem", "l_partkey") + """, f AS (SELECT fold, sum(n)::BIGINT AS n FROM p WHERE r > 0 GROUP BY 1)
    SELECT count(*) AS n_folds, min(n) AS smallest, max(n) AS largest, max(n) / min(n) AS ratio FROM f""",
)
def lpt_fold(spark, sf_dir):
    return split.balance(split.packed(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey"), "fold", "n")


@query(
    "size_chunks",
    """WITH RECURSIVE s AS (SELECT p_size, count(*) AS c, row_number() OVER (ORDER BY p_size) AS r FROM part GROUP BY 1),
    p(r, p_size, chunk, n) AS (SELECT r, p_size, 0, c FROM s WHERE r = 1
      UNION ALL SELECT s.r, s.p_size, CASE WHEN p.n >= 100 THEN chunk + 1 ELSE chunk END, CASE WHEN p.n >= 100 THEN s.c ELSE p.n + s.c END FROM p JOIN s ON s.r = p.r + 1),
    e AS (SELECT chunk AS last, n AS held FROM p ORDER BY r DESC LIMIT 1)
    SELECT part.p_size, p_partkey, CASE WHEN chunk = last AND held < 100 AND chunk > 0 THEN chunk - 1 ELSE chunk END::INT AS chunk FROM part JOIN p USING (p_size), e""",
)
def size_chunks(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return split.assign(sizes, "p_size", split.merge_size_chunks(split.group_sizes(sizes, "p_size"), 100), "chunk")


_SIM = "WITH s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query(
    "knn",
    f"""{_SIM} SELECT query, neighbour, round(sim, 6) AS sim, rank::INT AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, neighbour) AS rank FROM s) WHERE rank <= 5""",
)
def knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(similarity.neighbours(e, e, "vec_id", "embedding", 5))


@query(
    "knn_residual",
    f"""{_SIM}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, neighbour) AS r FROM s) WHERE r <= 20),
    p AS (SELECT query, coalesce(sum(greatest(sim, 0) * e.label) / nullif(sum(greatest(sim, 0)), 0), avg(e.label)) AS predicted, max(sim) AS best_sim FROM k JOIN embeddings e ON e.vec_id = neighbour GROUP BY 1),
    d AS (SELECT vec_id, label::DOUBLE AS target, predicted, label - predicted AS residual, best_sim FROM embeddings JOIN p ON query = vec_id),
    g AS (SELECT stddev_pop(residual) AS s, count(*) AS n FROM d)
    SELECT vec_id, target, round(predicted, 6) AS predicted, round(best_sim, 6) AS best_sim, round(residual, 6) AS residual, round(abs(residual) / s, 6) AS ratio,
    abs(residual) > 3 * s AND n > 20 AS flagged, NOT (abs(residual) > 3 * s AND n > 20) AND best_sim < 0.2 AS isolated FROM d, g""",
)
def knn_residual(spark, sf_dir):
    return rounded(similarity.knn_residual(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


@query("mean_similarity", "SELECT a.vec_id AS query, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) + 0.0::DOUBLE AS mean_sim FROM embeddings a, embeddings b GROUP BY 1")
def mean_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(similarity.mean_similarity(e, e, "vec_id", "embedding"))


@query(
    "nn_distance",
    """SELECT a.vec_id AS query, (a.label % 5)::INT AS fold, round(1 - max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance
    FROM embeddings a JOIN embeddings b ON a.label % 5 <> b.label % 5 GROUP BY 1, 2""",
)
def nn_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("fold", F.col("label") % 5)
    return rounded(similarity.leakage_distance(e, "vec_id", "embedding", "fold"))


@query(
    "leakage_summary",
    """WITH d AS (SELECT a.label % 5 AS fold, 1 - max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d
      FROM embeddings a JOIN embeddings b ON a.label % 5 <> b.label % 5 GROUP BY a.vec_id, 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY d) - 1 AS no, count(*) OVER (PARTITION BY fold) AS n FROM d)
    SELECT fold::INT AS fold, max(n) AS n, round(median(d), 6) AS median, round(max(d) FILTER (WHERE no = n // 4), 6) AS q1, round(max(d) FILTER (WHERE no = 3 * n // 4), 6) AS q3 FROM r GROUP BY 1""",
)
def leakage_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("fold", F.col("label") % 5)
    return rounded(rank_quartiles(similarity.leakage_distance(e, "vec_id", "embedding", "fold"), ["fold"], "distance"))


@query(
    "similar_pairs",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35""",
)
def similar_pairs(spark, sf_dir):
    return rounded(similarity.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35))


@query(
    "tanimoto_bits",
    """WITH b AS (SELECT doc_id, ('0x' || substr(md5(lang || source), 1, 8))::BIGINT AS w FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
    SELECT a.doc_id, round(bit_count(a.w & c.w) / nullif(bit_count(a.w) + bit_count(c.w) - bit_count(a.w & c.w), 0)::DOUBLE, 9) AS sim FROM b a, (SELECT w FROM b ORDER BY doc_id LIMIT 1) c""",
)
def tanimoto_bits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    b = d.select("doc_id", F.array(F.conv(F.substring(F.md5(F.concat("lang", "source")), 1, 8), 16, 10).cast("long")).alias("w"))
    first = b.agg(F.min_by("w", "doc_id").alias("v"))
    return rounded(b.crossJoin(F.broadcast(first)).select("doc_id", similarity.tanimoto_bits(F.col("w"), F.col("v")).alias("sim")), 9)


def label_clusters(spark, sf_dir):
    """Centroids of the label groups, their sizes and distances: as many rows as labels."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select("label", F.transform("x", lambda s: s["v"]).alias("x"))
    sizes = dict(split.group_sizes(table(spark, sf_dir, "embeddings").select("label"), "label"))
    got = sorted(split.bounded(rows, split.MAX_GROUPS, "clusters"), key=lambda r: r.label)
    x = np.array([r.x for r in got])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [r.label for r in got], x, np.array([sizes[r.label] for r in got], float), 1 - unit @ unit.T


@query("butina")
def butina(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return split.butina_clusters(e.select("vec_id", "label", "embedding"), "vec_id", "embedding", 0.35).drop("embedding")


@query("maxmin_voronoi")
def maxmin_voronoi(spark, sf_dir):
    labels, _, sizes, d = label_clusters(spark, sf_dir)
    fold = split.rebalance(split.voronoi(d, split.maxmin_seeds(sizes, d, 5)), sizes, 5)
    return split.assign(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", dict(zip(labels, fold, strict=True)))


@query("hybrid_split")
def hybrid_split(spark, sf_dir):
    labels, x, sizes, d = label_clusters(spark, sf_dir)
    fold = split.hybrid(x, sizes, d, 5)
    return split.assign(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", dict(zip(labels, fold, strict=True)))


@query(
    "grouped_cv",
    """WITH g AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS labelled FROM lineitem GROUP BY 1),
    f AS (SELECT *, ((row_number() OVER (ORDER BY md5(l_orderkey || '|42'), l_orderkey) - 1) % 5)::INT AS fold FROM g)
    SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS has_target, labelled, fold FROM lineitem JOIN f USING (l_orderkey)""",
)
def grouped_cv(spark, sf_dir):
    """All replicas of an order in one fold; an order is labelled if any of its lines is."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("has_target"))
    groups = li.groupBy("l_orderkey").agg(F.bool_or("has_target").alias("labelled"))
    return li.join(split.random_folds(groups, "l_orderkey"), "l_orderkey")


@query(
    "nearest_in_group",
    """SELECT e.user_id, e.event_id AS i, o.event_id AS j, rank::INT AS rank FROM (SELECT a.user_id, a.event_id, b.event_id AS other,
      row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY sqrt((a.value - b.value) * (a.value - b.value)), b.event_id) AS rank
      FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id) e JOIN events o ON o.event_id = other WHERE rank <= 3""",
)
def nearest_in_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return similarity.knn_cells(e, "user_id", "event_id", ["value"], 3).select("user_id", "i", "j", "rank")


@query("random_forest")
def random_forest(spark, sf_dir):
    """Mean absolute error of a forest over folds, by number of trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from sparkassay.operators.metrics import regression

    p = split.random_folds(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", k=3)
    x = VectorAssembler(inputCols=["p_size", "p_partkey"], outputCol="x").transform(p)
    out = None
    for trees in (3, 6):
        for fold in range(3):
            model = RandomForestRegressor(featuresCol="x", labelCol="p_retailprice", numTrees=trees, maxDepth=5, seed=7).fit(x.where(F.col("fold") != fold))
            one = regression(model.transform(x.where(F.col("fold") == fold)), "p_retailprice", "prediction").select(F.lit(trees).alias("trees"), F.lit(fold).alias("fold"), "n", "mae", "r2")
            out = one if out is None else out.union(one)
    return out.groupBy("trees").agg(F.sum("n").alias("n"), F.avg("mae").alias("mae_mean"), F.avg("r2").alias("r2_mean"))
