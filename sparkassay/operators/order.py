"""Order over a whole table without a single-task window, and window-style operators on groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sparkassay.operators.quantiles import at_rank, interpolated, ranked_slots

#: Leading hex digits of an md5 that make a bucket: 4096 of them, all equally likely.
HEX = 3


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """A seeded order that any engine with md5 reproduces."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def _with_offsets(df: DataFrame, bucket: str, value: Column, by: Sequence[str]) -> DataFrame:
    """``__before``: the sum of ``value`` over earlier buckets (of the same group)."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("__s"))
    run = W.Window.partitionBy(*by).orderBy(bucket).rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(run), F.lit(0))).withColumn("__all", F.sum("__s").over(W.Window.partitionBy(*by)))
    return df.join(sums.drop("__s"), [*by, bucket])


def shuffled(df: DataFrame, id_col: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``shuffle_no`` (from 0) and ``shuffle_n``: the row's place in md5 order, over all rows or per group.

    The place is a row number within a bucket of leading digits plus the rows of
    earlier buckets; only counts by bucket pass through one window.
    """
    keyed = df.withColumn("__key", shuffle_key(id_col, seed)).withColumn("__bucket", F.substring("__key", 1, HEX))
    w = W.Window.partitionBy(*by, "__bucket").orderBy("__key", id_col)
    out = _with_offsets(keyed, "__bucket", F.lit(1), by)
    return out.withColumn("shuffle_no", F.col("__before") + F.row_number().over(w) - 1).withColumn("shuffle_n", F.col("__all")).drop(
        "__key", "__bucket", "__before", "__all"
    )


#: Cells of ties within one cell of values.
TIE_CELLS = 64


def _cells(df: DataFrame, order: Sequence[str], cells: int, descending: bool = False) -> Column:
    """Number of the cell of a row in an order by a numeric column and its tie-breakers.

    Cells lie between approximate quantiles.  A value that spans cells gets one of
    its own, cut again by the first tie-breaker where that is a number, so a value
    that a third of all rows have is no single task.  At most ``cells`` numbers of
    each column reach the driver.
    """
    col = order[0]
    found = df.approxQuantile(col, [i / cells for i in range(1, cells)], 0.001)
    cuts = sorted(set(found))
    if not cuts:
        return F.lit(0)
    hot = sorted({c for c in cuts if found.count(c) > 1})
    cell = 2 * F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(col)))
    if not hot:
        return -cell if descending else cell
    is_hot = F.col(col).isin(*hot)
    # a hot value ends its cell of smaller ones
    cell = cell + F.when(is_hot, 1).otherwise(0)
    cell = (-cell if descending else cell) * (TIE_CELLS + 1)
    if len(order) < 2 or not isinstance(df.schema[order[1]].dataType, T.NumericType):
        return cell
    ties = sorted(set(df.where(is_hot).approxQuantile(order[1], [i / TIE_CELLS for i in range(1, TIE_CELLS)], 0.01)))
    return cell + F.when(is_hot, F.size(F.filter(F.array(*map(F.lit, ties)), lambda c: c < F.col(order[1])))).otherwise(0) if ties else cell


def ranked(df: DataFrame, col: str, ties: str, descending: bool = False, cells: int = 64) -> DataFrame:
    """``rank_no`` (from 1) and ``rank_n`` over the whole table by a numeric column, ties by ``ties``."""
    marked = df.withColumn("__cell", _cells(df, [col, ties], cells, descending))
    order = F.col(col).desc() if descending else F.col(col)
    w = W.Window.partitionBy("__cell").orderBy(order, ties)
    out = _with_offsets(marked, "__cell", F.lit(1), ())
    return out.withColumn("rank_no", F.col("__before") + F.row_number().over(w)).withColumn("rank_n", F.col("__all")).drop("__cell", "__before", "__all")


def running_sum(df: DataFrame, order: Sequence[str], value: Column, out: str = "running", cells: int = 64) -> DataFrame:
    """Sum of ``value`` over all rows up to this one, in the order of a numeric column and its tie-breakers."""
    marked = df.withColumn("__cell", _cells(df, order, cells))
    w = W.Window.partitionBy("__cell").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return _with_offsets(marked, "__cell", value, ()).withColumn(out, F.col("__before") + F.sum(value).over(w)).drop("__cell", "__before", "__all")


def prefix_offsets(df: DataFrame, order: str, size: str) -> DataFrame:
    """Where each row's items begin when all rows are laid end to end: ``start`` and ``stop``."""
    out = running_sum(df, [order], F.col(size), "stop")
    return out.withColumn("start", F.col("stop") - F.col(size))


def cost_batches(df: DataFrame, size: str, ties: str, budget: float, power: int = 2) -> DataFrame:
    """``batch``: rows in order of size, cut where the running cost size**power passes another budget."""
    cost = F.pow(F.col(size).cast("double"), F.lit(power)).cast("long")
    return running_sum(df.withColumn("__cost", cost), [size, ties], F.col("__cost"), "__run").withColumn(
        "batch", F.floor((F.col("__run") - F.col("__cost")) / budget).cast("long")
    ).drop("__cost", "__run")


def best_of_last(df: DataFrame, by: Sequence[str], order: Sequence[str], metric: str, last: int) -> DataFrame:
    """Of the last rows of each group the one with the smallest metric, the earliest on ties."""
    w = W.Window.partitionBy(*by).orderBy(*(F.col(o).desc() for o in order))
    tail = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= last).drop("__n")
    rest = [c for c in df.columns if c not in by]
    return tail.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(metric, *order)).alias("__r")).select(*by, "__r.*")


def patience(df: DataFrame, by: Sequence[str], order: Sequence[str], metric: str, limit: int) -> DataFrame:
    """``best`` so far, ``waited`` rows since it last fell, ``stopped`` once ``limit`` were waited."""
    w = W.Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(W.Window.unboundedPreceding, 0), w.rowsBetween(W.Window.unboundedPreceding, -1)
    better = F.coalesce(F.col(metric) < F.min(metric).over(before), F.col(metric).isNotNull())
    out = df.withColumn("best", F.min(metric).over(upto)).withColumn("__no", F.row_number().over(w)).withColumn("__better", better)
    out = out.withColumn("waited", F.col("__no") - F.coalesce(F.max(F.when(F.col("__better"), F.col("__no"))).over(upto), F.lit(0)))
    return out.withColumn("stopped", F.max(F.col("waited") >= limit).over(upto)).drop("__no", "__better")


def above_group_minimum(df: DataFrame, by: Sequence[str], value: str, out: str = "relative") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.min(value).over(W.Window.partitionBy(*by)))


def centre(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Group means taken off."""
    w = W.Window.partitionBy(*by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def z_score(df: DataFrame, by: Sequence[str], value: str, train: Column, out: str = "z") -> DataFrame:
    """(x - mean) / deviation with statistics of training rows only; a zero deviation counts as 1."""
    stats = df.where(train).groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    spread = F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return df.join(stats, list(by), "left").withColumn(out, (F.col(value) - F.col("__m")) / spread).drop("__m", "__s")


def group_order(df: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """``group_no``: groups in seeded order, rows of a group together."""
    groups = shuffled(df.select(group).distinct(), group, seed).select(group, F.col("shuffle_no").alias("group_no"))
    return df.join(groups, group)


def rank_quartiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median and the values at places floor(n/4) and floor(3n/4) of the sorted group, without interpolation."""
    slots = ranked_slots(df, by, value, [0.25, 0.5, 0.75])
    n = F.col("n")
    return slots.groupBy(*by).agg(
        F.max("n").alias("n"), interpolated(0.5).alias("median"), at_rank(F.floor(n / 4)).alias("q1"), at_rank(F.floor(3 * n / 4)).alias("q3")
    )


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample without replacement; sampling is what this operator is for."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n)
