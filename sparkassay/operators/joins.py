"""Joins: fallback chains, alias expansion, referential checks, ranges and graph walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def fallback_join(df: DataFrame, labels: DataFrame, label_key: str, keys: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """LEFT join on the first of ``keys`` that has a label; ``matched_key`` is its number, null if none has.

    A chain of left joins and a coalesce: rows are never multiplied, and each
    probe is an equi join that Spark may broadcast or merge.
    """
    out = df
    for i, key in enumerate(keys):
        side = labels.select(F.col(label_key).alias(f"__k{i}"), F.struct(*payload).alias(f"__p{i}"))
        out = out.join(side, key == F.col(f"__k{i}"), "left")
    found = F.coalesce(*(F.col(f"__p{i}") for i in range(len(keys))))
    which = F.coalesce(*(F.when(F.col(f"__p{i}").isNotNull(), F.lit(i)) for i in range(len(keys))))
    out = out.withColumn("__found", found).withColumn("matched_key", which)
    return out.select(*df.columns, "matched_key", *(F.col("__found")[c].alias(c) for c in payload))


def expand_aliases(labels: DataFrame, index: DataFrame, key: str, alias: str, target: str) -> DataFrame:
    """Labels, and for each alias of a labelled target the target's label, unless the alias has its own."""
    payload = [c for c in labels.columns if c != key]
    more = index.select(F.col(alias).alias("__a"), F.col(target).alias("__t")).join(labels, F.col("__t") == F.col(key)).select(
        F.col("__a").alias(key), *payload
    ).join(labels.select(key), key, "left_anti")
    return labels.select(key, *payload).unionByName(more)


def close_aliases(labels: DataFrame, index: DataFrame, key: str, alias: str, target: str) -> DataFrame:
    """Two passes: aliases found in the first are labels for the second.  Free of row order."""
    return expand_aliases(expand_aliases(labels, index, key, alias, target), index, key, alias, target)


def reference_check(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(n_keys, n_missing) of the child's distinct keys."""
    keys = child.select(F.col(child_key).alias("k")).distinct()
    known = parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("known")).distinct()
    return keys.join(known, "k", "left").agg(F.count("k").alias("n_keys"), F.count_if(F.col("known").isNull() & F.col("k").isNotNull()).alias("n_missing"))


def novelty(df: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """(n, n_unique, n_novel, novelty): share of distinct keys that are not known."""
    keys = df.select(F.col(key).alias("k")).distinct().join(known.select(F.col(known_key).alias("k"), F.lit(True).alias("seen")).distinct(), "k", "left")
    counts = keys.agg(F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("seen").isNull()).alias("n_novel"))
    return counts.withColumn("novelty", F.try_divide("n_novel", "n_unique"))


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points within [lo, hi], by equi join on cells of ``width``; a range is listed once for each cell it meets."""
    cells = ranges.withColumn("__c", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("__c", F.floor(F.col(at) / width)).join(cells, "__c").where(F.col(at).between(F.col(lo), F.col(hi))).drop("__c")


def positional_join(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """i-th row with i-th row, by explicit ordinals; a length mismatch shows as nulls."""
    l, r = left.withColumnRenamed(order_left, "ordinal"), right.withColumnRenamed(order_right, "ordinal")
    return l.join(r, "ordinal", "full")


def angles(bonds: DataFrame, key: str = "mol") -> DataFrame:
    """(key, i, j, k): pairs i < k of neighbours of j.  ``bonds`` has both directions (key, src, dst)."""
    a = bonds.select(key, F.col("src").alias("j"), F.col("dst").alias("i"))
    b = bonds.select(key, F.col("src").alias("j"), F.col("dst").alias("k"))
    return a.join(b, [key, "j"]).where("i < k").select(key, "i", "j", "k")


def torsions(bonds: DataFrame, key: str = "mol") -> DataFrame:
    """(key, a, b, c, d): walks over three bonds with distinct ends, each once (b < c)."""
    mid = bonds.where("src < dst").select(key, F.col("src").alias("b"), F.col("dst").alias("c"))
    left = bonds.select(key, F.col("src").alias("b"), F.col("dst").alias("a"))
    right = bonds.select(key, F.col("src").alias("c"), F.col("dst").alias("d"))
    return mid.join(left, [key, "b"]).where("a <> c").join(right, [key, "c"]).where("d <> b AND a <> d").select(key, "a", "b", "c", "d")


def complete_graph(nodes: DataFrame, bonds: DataFrame, key: str, node: str, bond_type: str = "type") -> DataFrame:
    """(key, i, j, type): all ordered pairs i <> j of a key, type 0 where there is no bond."""
    pairs = nodes.select(key, F.col(node).alias("i")).join(nodes.select(key, F.col(node).alias("j")), key).where("i <> j").withColumn(bond_type, F.lit(0))
    return pairs.unionByName(bonds.select(key, F.col("src").alias("i"), F.col("dst").alias("j"), F.col(bond_type).cast("int"))).groupBy(key, "i", "j").agg(
        F.max(bond_type).alias(bond_type)
    )


def ragged(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row a key with its rows as an ordered array of structs."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def upper_triangle(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    return edges.where(F.col(i) < F.col(j))


def symmetrise(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    rest = [c for c in edges.columns if c not in (i, j)]
    return edges.select(i, j, *rest).unionByName(edges.select(F.col(j).alias(i), F.col(i).alias(j), *rest)).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, key: str, node: str, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept nodes numbered again from 0 within their key, and the edges among them."""
    w = W.Window.partitionBy(key).orderBy(node)
    kept = nodes.where(keep).withColumn("new", F.row_number().over(w) - 1)
    one = kept.select(key, F.col(node).alias("src"), F.col("new").alias("new_src"))
    two = kept.select(key, F.col(node).alias("dst"), F.col("new").alias("new_dst"))
    return kept, edges.join(one, [key, "src"]).join(two, [key, "dst"])
