"""Segments, lists by key, replication and scattering back to input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def segment_softmax(df: DataFrame, by: Sequence[str], value: str, out: str = "softmax") -> DataFrame:
    """exp(x - max) / sum of it, within each segment."""
    w = W.Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def merge_lists(df: DataFrame, key: Sequence[str], values: str, count: str | None = None) -> DataFrame:
    """Lists of equal keys put together (sorted) and their counts summed."""
    n = F.sum(count) if count else F.sum(F.size(values))
    return df.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list(values))).alias(values), n.alias("n"))


def by_component(df: DataFrame, key: str, position: int, values: str) -> DataFrame:
    """Lists again, by one component of an array key."""
    return merge_lists(df.withColumn("component", F.get(key, F.lit(position))), ["component"], values)


def weighted_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: |mean of a - mean of b| by key, weighted by the key's share of ``b``; keys that ``a`` lacks count 0."""
    left = a.groupBy(F.col(key).alias("k")).agg(F.avg(value).alias("ma"))
    right = b.groupBy(F.col(key).alias("k")).agg(F.avg(value).alias("mb"), F.count(value).alias("n"))
    both = right.join(left, "k", "left")
    return both.agg((F.sum(F.coalesce(F.abs(F.col("ma") - F.col("mb")), F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("difference"), F.count(F.lit(1)).alias("n_keys"))


def replicate(df: DataFrame, k: int | Column, out: str = "replica") -> DataFrame:
    """Every row k times, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), (F.lit(k) if isinstance(k, int) else k) - 1)))


def explode_first(df: DataFrame, items: str, k: int, out: str = "item") -> DataFrame:
    """One row for each of the first k list entries; nulls among them are skipped."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode(F.slice(items, 1, k)).alias("pos", out)).where(F.col(out).isNotNull())


def gather_back(df: DataFrame, index: str, order: str, value: str) -> DataFrame:
    """Results in input order again: one list for each input, by replica number."""
    rows = df.groupBy(index).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__l"))
    return rows.select(index, F.transform("__l", lambda s: s[value]).alias(value))


def materialise_split(split: DataFrame, rows: DataFrame, split_key: str, row_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of every split entry, entries without any row)."""
    hit = split.join(rows, F.col(split_key) == F.col(row_key))
    lost = split.join(rows.select(F.col(row_key).alias("__k")).distinct(), F.col(split_key) == F.col("__k"), "left_anti")
    return hit, lost


def by_cardinality(df: DataFrame, by: Sequence[str], limit: int, small, large, out: str = "setting") -> DataFrame:
    """A setting for each group by its number of rows."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), F.when(n > limit, F.lit(large)).otherwise(F.lit(small)).alias(out))


def sweep(df: DataFrame, **grid: Sequence) -> DataFrame:
    """Every row under every combination of parameters; the grid is a literal."""
    out = df
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def first_matching_prefix(keys: DataFrame, key: str, prefixes: Sequence[str]) -> DataFrame:
    """(prefix): the first candidate that any key begins with; no row if none does."""
    tests = [F.struct(F.lit(i).alias("i"), F.lit(p).alias("prefix"), F.max(F.col(key).startswith(p).cast("int")).alias("hit")) for i, p in enumerate(prefixes)]
    one = keys.agg(F.array(*tests).alias("t"))
    return one.select(F.explode(F.slice(F.filter("t", lambda s: s["hit"] == 1), 1, 1)).alias("s")).select("s.prefix")


def layers_of(keys: DataFrame, key: str, pattern: str = r"layer\.(\d+)\.") -> DataFrame:
    """(n): largest number in names of a pattern, plus one."""
    return keys.agg((F.coalesce(F.max(F.regexp_extract(key, pattern, 1).try_cast("int")), F.lit(-1)) + 1).alias("n"))
