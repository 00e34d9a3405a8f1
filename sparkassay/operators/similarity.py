"""Similarity of vectors and bit sets, neighbours by exact block search, leakage distances.

An exact search of n queries over m rows is n * m comparisons whatever the engine.
Rows and queries are dealt to blocks; a task holds one block of each (a matrix
product in numpy) and sends on only k rows a query, so memory is bounded by the
block and nothing of size n * m is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tanimoto_bits(a: Column, b: Column) -> Column:
    """Tanimoto of bit sets kept as arrays of 64-bit words; 0 for two empty sets."""
    ones = lambda x: F.aggregate(x, F.lit(0), lambda s, w: s + F.bit_count(w))
    both = ones(F.zip_with(a, b, lambda p, q: p.bitwiseAND(q)))
    return F.coalesce(F.try_divide(both, ones(a) + ones(b) - both), F.lit(0.0))


def tanimoto_float(a: Column, b: Column) -> Column:
    """dot / (sum a + sum b - dot) of float vectors."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))
    return F.coalesce(F.try_divide(dot, total(F.transform(a, lambda v: v.cast("double"))) + total(F.transform(b, lambda v: v.cast("double"))) - dot), F.lit(0.0))


def _blocks(n_rows: int) -> int:
    return max(1, -(-n_rows // BLOCK))


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def neighbours(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int, group: str | None = None, same_group: bool = True) -> DataFrame:
    """(query, ident, sim, rank): the k rows of largest cosine for each query, itself excluded, ties to the smaller id.

    With ``group``, only rows of the same (or of another) group are compared.
    """
    g = [group] if group else []
    n_rows, n_queries = rows.count(), queries.count()
    rb, qb = _blocks(n_rows), _blocks(n_queries)
    deal = lambda n, salt: F.pmod(F.xxhash64(ident, F.lit(salt)), F.lit(n)).cast("int")
    q = queries.select(ident, vector, *g).withColumn("qb", deal(qb, 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    r = rows.select(ident, vector, *g).withColumn("rb", deal(rb, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    r = r.select(F.col(ident).alias("r_id"), F.col(vector).alias("r_vec"), *(F.col(x).alias("r_group") for x in g), F.col("rb").alias("r_rb"), F.col("qb").alias("r_qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("r_id")
            x, ids = _unit(b.r_vec), b.r_id.to_numpy()
            for lo in range(0, len(a), 256):
                part = a.iloc[lo : lo + 256]
                sims = _unit(part[vector]) @ x.T
                sims[part[ident].to_numpy()[:, None] == ids] = -np.inf
                if group:
                    equal = part[group].to_numpy()[:, None] == b.r_group.to_numpy()
                    sims[~equal if same_group else equal] = -np.inf
                for i, query in enumerate(part[ident]):
                    row = sims[i]
                    m = min(k, len(row))
                    edge = np.partition(row, len(row) - m)[len(row) - m] if m < len(row) else -np.inf
                    near = np.flatnonzero((row >= edge - 1e-12) & np.isfinite(row))
                    near = near[np.lexsort((ids[near], -np.round(row[near], 12)))][:m]
                    out += [(query, ids[j], float(row[j])) for j in near]
        return pd.DataFrame(out, columns=["query", "neighbour", "sim"]).astype({"query": "int64", "neighbour": "int64", "sim": "float64"})

    found = q.groupBy("rb", "qb").cogroup(r.groupBy("r_rb", "r_qb")).applyInPandas(best, "query long, neighbour long, sim double")
    w = W.Window.partitionBy("query").orderBy(F.round("sim", 12).desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_similarity(queries: DataFrame, rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(query, mean_sim): mean cosine of each query to all rows, from the sum of unit vectors: one pass, no pairs."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = lambda df: df.select(F.col(ident).alias("id"), F.posexplode(vector).alias("i", "v"), size.alias("s")).where("s > 0").select("id", "i", (F.col("v").cast("double") / F.col("s")).alias("u"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    total = unit(rows).groupBy("i").agg(F.sum("u").alias("t"))
    return unit(queries).join(total, "i").groupBy(F.col("id").alias("query")).agg(F.sum(F.col("u") * F.col("t")).alias("dot")).crossJoin(
        F.broadcast(n)  # one row
    ).select("query", (F.col("dot") / F.col("n")).alias("mean_sim"))


def knn_residual(df: DataFrame, ident: str, vector: str, target: str, k: int = 20, z: float = 3.0, isolated_below: float = 0.2) -> DataFrame:
    """(ident, target, predicted, residual, ratio, best_sim, flagged, isolated) from weighted neighbour targets.

    Weights are max(similarity, 0); the plain mean if all are 0.  Sigma is the
    population deviation of the residuals (1 if 0).  With fewer than k + 1 rows
    nothing is flagged.
    """
    near = neighbours(df, df, ident, vector, k)
    targets = df.select(F.col(ident).alias("neighbour"), F.col(target).cast("double").alias("t"))
    w = F.greatest("sim", F.lit(0.0))
    pred = near.join(targets, "neighbour").groupBy("query").agg(
        F.coalesce(F.try_divide(F.sum(w * F.col("t")), F.sum(w)), F.avg("t")).alias("predicted"), F.max("sim").alias("best_sim")
    )
    out = df.select(F.col(ident), F.col(target).cast("double").alias("target")).join(pred, F.col(ident) == F.col("query")).drop("query")
    out = out.withColumn("residual", F.col("target") - F.col("predicted"))
    sigma = out.agg(F.stddev_pop("residual").alias("s"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"), "n")
    out = out.crossJoin(F.broadcast(sigma))  # one row
    flagged = (F.abs("residual") > z * F.col("s")) & (F.col("n") > k)
    return out.withColumn("ratio", F.abs("residual") / F.col("s")).withColumn("flagged", flagged).withColumn(
        "isolated", ~flagged & (F.col("best_sim") < isolated_below)
    ).drop("s", "n")


def leakage_distance(df: DataFrame, ident: str, vector: str, fold: str) -> DataFrame:
    """(query, fold, distance): 1 - largest similarity of each row to a row of another fold."""
    one = neighbours(df, df, ident, vector, 1, group=fold, same_group=False)
    return one.join(df.select(F.col(ident).alias("query"), F.col(fold)), "query").select("query", fold, (1 - F.col("sim")).alias("distance"))


def similar_pairs(df: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    """(a, b, sim) with a < b and cosine >= least: a blocked self join; only similar pairs leave the tasks."""
    n = _blocks(df.count())
    one = df.select(F.col(ident).alias("id"), F.col(vector).alias("vec")).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = one.withColumn("other", F.explode(F.sequence(F.col("blk"), F.lit(n - 1))))
    right = one.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("blk"))))
    right = right.select(F.col("id").alias("r_id"), F.col("vec").alias("r_vec"), F.col("first").alias("r_first"), F.col("blk").alias("r_blk"))

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, y, ia, ib = _unit(a.vec), _unit(b.r_vec), a.id.to_numpy(), b.r_id.to_numpy()
            inside = a.blk.iloc[0] == a.other.iloc[0]
            for lo in range(0, len(a), 512):
                sims = x[lo : lo + 512] @ y.T
                i, j = np.nonzero(sims >= least)
                p, q = ia[lo + i], ib[j]
                keep = p < q if inside else p != q
                out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "sim": sims[i, j][keep]}))
        none = pd.DataFrame({"a": [], "b": [], "sim": []})
        return pd.concat(out or [none]).astype({"a": "int64", "b": "int64", "sim": "float64"})

    return left.groupBy("blk", "other").cogroup(right.groupBy("r_first", "r_blk")).applyInPandas(pairs, "a long, b long, sim double")


def knn_cells(df: DataFrame, key: str, ident: str, coords: Sequence[str], k: int) -> DataFrame:
    """k nearest rows (by distance) of the same key: a self join within the key."""
    a = df.select(key, F.col(ident).alias("i"), *(F.col(c).alias(f"a_{c}") for c in coords))
    b = df.select(key, F.col(ident).alias("j"), *(F.col(c).alias(f"b_{c}") for c in coords))
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in coords), F.lit(0.0))
    w = W.Window.partitionBy(key, "i").orderBy("d", "j")
    return a.join(b, key).where("i <> j").withColumn("d", F.sqrt(d2)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "i", "j", "d", "rank")
