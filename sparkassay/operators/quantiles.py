"""Exact quantiles of groups of any size.

Spark's own ``percentile`` keeps the distinct values of a group in one task's
memory, which suits groups of millions.  Here a mergeable sketch first gives, for
each quantile, two values that hold it between them; a second pass counts what lies
outside and keeps only the distinct values between, which are few.  Their running
counts give the exact value of every rank.  What is shuffled is partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Width in robust sigmas, and the factor that makes MAD a sigma.
ROBUST_K = 6.0
MAD_TO_SIGMA = 1.4826


def number(col: str | Column) -> Column:
    """A double in which NaN is missing."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c), c)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns in which null is a group; without columns ``right`` is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*(F.col(c).alias(f"__g_{c}") for c in by), *(c for c in right.columns if c not in by))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return left.join(renamed, on, how).drop(*(f"__g_{c}" for c in by))


def ranked_slots(df: DataFrame, by: Sequence[str], value: str | Column, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(by, x, start, c, n): values near the given shares of each group, with the rank from 0 of the first and how often they stand.

    Groups of at most ``accuracy`` values are given whole.  In larger ones the sketch
    errs by n / accuracy ranks, so a bracket of four times that holds every rank within
    two of the wanted one.
    """
    by = list(by)
    rows = df.select(*by, number(value).alias("x")).where("x IS NOT NULL")
    edges = [min(1.0, max(0.0, s + d * 4 / accuracy)) for s in sorted(shares) for d in (-1, 1)]
    cuts = rows.groupBy(*by).agg(F.percentile_approx("x", F.array(*map(F.lit, edges)), accuracy).alias("cuts"), F.count(F.lit(1)).alias("n"))
    marked = join_groups(rows, cuts, by)
    x, cut = F.col("x"), F.col("cuts")
    inside = F.col("n") <= accuracy
    for i in range(0, len(edges), 2):
        inside = inside | ((x >= cut[i]) & (x <= cut[i + 1]))
    # in order of (region, slot): outside values of a region are all below its one edge
    region = F.when(F.col("n") > accuracy, F.size(F.filter(cut, lambda e: e < x))).otherwise(0)
    counts = marked.select(*by, "n", region.alias("region"), F.when(inside, x).alias("slot")).groupBy(*by, "n", "region", "slot").agg(F.count(F.lit(1)).alias("c"))
    run = W.Window.partitionBy(*by).orderBy("region", F.col("slot").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("c").over(run), F.lit(0))).where("slot IS NOT NULL").select(*by, F.col("slot").alias("x"), "start", "c", "n")


def at_rank(rank: Column) -> Column:
    """Aggregate over ranked slots: the value of a rank, an expression of ``n``."""
    return F.max(F.when((F.col("start") <= rank) & (rank < F.col("start") + F.col("c")), F.col("x")))


def interpolated(share: float) -> Column:
    """Aggregate over ranked slots: the linearly interpolated quantile."""
    at = F.lit(float(share)) * (F.col("n") - 1)
    low, high = at_rank(F.floor(at)), at_rank(F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))


#: Frames that the optimizer puts below this size are left to Spark's own percentile.
SMALL_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, from file sizes and without a job; it errs on the large side after joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str | Column, shares: Sequence[float], accuracy: int = 10_000, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """(by, n, q): linearly interpolated quantiles of each group, in the order of ``shares``.

    One aggregate where the whole frame fits a task anyway, the two passes where it may not.
    """
    rows = df.select(*by, number(value).alias("x"))
    if estimated_bytes(rows) <= small_bytes:
        found = rows.where("x IS NOT NULL").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("x", [float(s) for s in shares]).alias("q"))
        return found if by else found.where("n > 0")
    slots = ranked_slots(df, by, value, shares, accuracy)
    return slots.groupBy(*by).agg(F.max("n").alias("n"), F.array(*map(interpolated, shares)).alias("q"))


def robust_bounds(
    df: DataFrame, value: str, by: Sequence[str] = (), k: float = ROBUST_K, where: Column | None = None, scale: float = MAD_TO_SIGMA
) -> DataFrame:
    """Per group: ``med``, ``sigma`` = ``scale`` times the MAD, ``lo`` and ``hi``; null is a group too."""
    by = list(by)
    rows = (df if where is None else df.where(where)).select(*by, number(value).alias("__x")).where("__x IS NOT NULL")
    centre = exact_quantiles(rows, by, "__x", [0.5]).select(*by, F.col("q")[0].alias("med"))
    off = join_groups(rows, centre, by).withColumn("__d", F.abs(F.col("__x") - F.col("med")))
    spread = exact_quantiles(off, by, "__d", [0.5]).select(*by, (F.col("q")[0] * scale).alias("sigma"))
    return join_groups(centre, spread, by).select(
        *by, "med", "sigma", (F.col("med") - k * F.col("sigma")).alias("lo"), (F.col("med") + k * F.col("sigma")).alias("hi")
    )
