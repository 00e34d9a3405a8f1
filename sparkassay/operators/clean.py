"""Cleaning: first-failure rejection, rule tables, blacklists, ranges and deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Texts that stand for a missing value.
NULL_WORDS = ("", "nan", "none")


def is_missing(col: str) -> Column:
    """Blank, nan or none in any case, or null."""
    return F.coalesce(F.lower(F.trim(col)).isin(*NULL_WORDS), F.lit(True))


def to_number(col: str) -> Column:
    """The value as a double, null where it does not parse or is NaN."""
    x = F.col(col).try_cast("double")
    return F.when(~F.isnan(x), x)


def guarded_log10(col: str) -> Column:
    return F.when(F.col(col) > 0, F.log10(F.col(col).cast("double")))


def reject_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The first reason whose test holds, in order; null for an accepted row.  A null test does not hold."""
    out = F.lit(None).cast("string")
    for reason, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), reason).otherwise(out)
    return out


def reject_cascade(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reject_reason``, counts by reason with 'kept')."""
    marked = df.withColumn("reject_reason", reject_reason(checks))
    counts = marked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL"), counts


def drop_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one of the columns has a value; NaN is missing."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    have = F.lit(False)
    for c in columns:
        have = have | (F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull())
    return df.where(have)


def keep_known(df: DataFrame, items: Column, allowed: Sequence) -> DataFrame:
    """Rows all of whose elements are allowed; an empty or null array has none that is not."""
    return df.where(F.coalesce(F.forall(items, lambda x: F.coalesce(x.isin(*allowed), F.lit(False))), F.lit(True)))


def outside_vocabulary(df: DataFrame, items: Column, allowed: Sequence) -> DataFrame:
    """How many rows hold each element that is not allowed; an element counts once a row."""
    known = F.array(*map(F.lit, allowed))
    return df.select(F.explode(F.array_except(F.array_distinct(items), known)).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))


def within(col: str, lo: Column, hi: Column) -> Column:
    """lo <= x <= hi where a null bound is open."""
    return F.coalesce(F.col(col) >= lo, F.lit(True)) & F.coalesce(F.col(col) <= hi, F.lit(True))


def limit_by_catalogue(df: DataFrame, catalogue: DataFrame, key: str, value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows within the limits their key has in a small catalogue; keys without an entry are unlimited."""
    c = catalogue.select(F.col(key), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    return df.join(c, key, "left").where(within(value, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def rule_case(rules: Mapping[str, str], key: str) -> Column:
    """One CASE over SQL predicates by key; keys without a rule give false."""
    out = F.lit(False)
    for name, predicate in rules.items():
        out = F.when(F.col(key) == name, F.coalesce(F.expr(predicate), F.lit(False))).otherwise(out)
    return out


def blacklist(df: DataFrame, bad: DataFrame, key: str, value: str, rule: str, exempt: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """``blocked_by``: rules that name a row's key and rounded value, sorted, joined by '|'; null if none.

    Both sides round half to even, so ties meet.
    """
    named = (
        bad.where(~F.col(rule).isin(*exempt)) if exempt else bad
    ).groupBy(F.col(key).alias("__k"), F.bround(F.col(value).cast("double"), digits).alias("__v")).agg(
        F.array_join(F.array_sort(F.collect_set(rule)), "|").alias("blocked_by")
    )
    return df.join(named, (F.col(key) == F.col("__k")) & (F.bround(F.col(value).cast("double"), digits) == F.col("__v")), "left").drop("__k", "__v")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first whole row of each key.  An aggregate, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    lead = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), lead).alias("__r")).select(*keys, "__r.*")


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def consensus(
    df: DataFrame, keys: Sequence[str], value: str, order: str, factor: float = 0.3, within_cols: Sequence[str] = ()
) -> DataFrame:
    """Consensus of repeated keys: (keys, status, n, value, spread, threshold, first_order).

    Threshold is ``factor`` times the sample deviation of all values (1 if there is
    at most one) within ``within_cols``.  One row: kept.  Spread beyond the
    threshold: the whole group rejected, no value.  Else the mean, on the first row.
    """
    scope = list(within_cols)
    sigma = df.groupBy(*scope).agg(F.stddev_samp(value).alias("__s"), F.count(value).alias("__c"))
    sigma = sigma.select(*scope, (factor * F.when(F.col("__c") > 1, F.col("__s")).otherwise(1.0)).alias("threshold"))
    groups = df.groupBy(*dict.fromkeys([*scope, *keys])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("__m"), (F.max(value) - F.min(value)).alias("spread"), F.min(order).alias("first_order")
    )
    groups = groups.join(sigma, scope) if scope else groups.crossJoin(F.broadcast(sigma))  # one row
    status = F.when(F.col("n") == 1, "kept").when(F.col("spread") > F.col("threshold"), "rejected").otherwise("aggregated")
    return groups.withColumn("status", status).withColumn("value", F.when(status != "rejected", F.col("__m"))).drop("__m")


def average_duplicates(df: DataFrame, keys: Sequence[str], mean: Sequence[str], order: str) -> DataFrame:
    """One row a key: means of some columns, the rest from the first row."""
    rest = [c for c in df.columns if c not in keys and c not in mean]
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in mean), *(F.min_by(c, order).alias(c) for c in rest))


def pivot_last(df: DataFrame, key: str, name: str, value: str, order: Column, names: Sequence[str], complete: bool = True) -> DataFrame:
    """Key-value rows to one wide row a key; the last value of a name wins; ``n_overwritten`` counts the others."""
    picked = [F.max_by(value, F.when(F.col(name) == n, order)).alias(n) for n in names]
    seen = [F.greatest(F.lit(0), F.count_if(F.col(name) == n) - 1) for n in names]
    over = seen[0]
    for s in seen[1:]:
        over = over + s
    wide = df.where(F.col(name).isin(*names)).groupBy(key).agg(*picked, over.cast("long").alias("n_overwritten"))
    return wide.dropna(how="any", subset=list(names)) if complete else wide


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with rows of the same key replaced and the others added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def union_in_order(parts: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL that keeps where a row came from: ``part`` and its ordinal ``part_no``."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        tagged = df.withColumn("part", F.lit(name)).withColumn("part_no", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def union_distinct(parts: Mapping[str, DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row of the first part that has it."""
    return first_per_key(union_in_order(parts), keys, ["part_no", *order])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Set equality with multiplicity."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
