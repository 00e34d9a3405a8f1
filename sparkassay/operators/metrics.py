"""Regression metrics: pooled and averaged over folds, ensembles, masked and paired means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_aggs(truth: Column, pred: Column) -> list[Column]:
    """n, mae, rmse, r2; R2 is null if the truth does not vary."""
    e = pred - truth
    n, tss = F.count(e), F.var_pop(F.when(e.isNotNull(), truth)) * F.count(e)
    return [
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(tss > 0, 1 - F.sum(e * e) / tss).alias("r2"),
    ]


def regression(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*regression_aggs(F.col(truth), F.col(pred)))


def pooled_and_averaged(df: DataFrame, dataset: str, fold: str, truth: str, pred: str) -> DataFrame:
    """Two tracks: metrics of all predictions together, and means over folds with sample deviations.

    ``disagrees``: the two MAE differ by more than 5 % of the averaged one.
    """
    folds = regression(df, truth, pred, [dataset, fold])
    averaged = folds.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("mae").alias("mae_mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("mae")).otherwise(0.0).alias("mae_std"), F.avg("rmse").alias("rmse_mean"), F.avg("r2").alias("r2_mean"),
    )
    pooled = regression(df, truth, pred, [dataset]).select(
        dataset, "n", F.col("mae").alias("mae_pooled"), F.col("rmse").alias("rmse_pooled"), F.col("r2").alias("r2_pooled")
    )
    return averaged.join(pooled, dataset).withColumn("disagrees", F.abs(F.col("mae_pooled") - F.col("mae_mean")) > 0.05 * F.col("mae_mean"))


def weighted_fallback(folds: DataFrame, dataset: str) -> DataFrame:
    """Pooled metrics when only (dataset, n, mae, rmse) of folds is known."""
    return folds.groupBy(dataset).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mae")), F.sum("n")).alias("mae"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")), F.sum("n"))).alias("rmse"),
        F.lit("weighted-fallback").alias("pooled_src"),
    )


def fold_rollup(folds: DataFrame, by: Sequence[str], metrics: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; an optional metric only if every fold has it."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    aggs += [F.when(F.count(m) == F.count(F.lit(1)), F.avg(m)).alias(f"{m}_mean") for m in optional]
    return folds.groupBy(*by).agg(*aggs)


def ensemble(df: DataFrame, group: str, truth: str, pred: str) -> DataFrame:
    """One row: metrics of group means and of single predictions, and the spread inside groups."""
    g = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(group).agg(
        F.avg(truth).alias("t"), F.avg(pred).alias("p"), F.count(F.lit(1)).alias("k"),
        F.greatest(F.lit(0.0), F.avg(F.col(pred) * F.col(pred)) - F.avg(pred) * F.avg(pred)).alias("v"),
    )
    std = F.sqrt("v")
    groups = g.agg(
        *[m.alias(f"ens_{n}") for m, n in zip(regression_aggs(F.col("t"), F.col("p")), ("n", "mae", "rmse", "r2"), strict=True)],
        F.avg(std).alias("std_mean"), F.median(std).alias("std_median"), F.percentile(std, F.lit(0.95)).alias("std_p95"),
        (F.avg(std) / F.greatest(F.stddev_pop("t"), F.lit(1e-12))).alias("std_share"), F.floor(F.median("k")).cast("long").alias("k"),
    )
    rows = df.agg(*[m.alias(f"row_{n}") for m, n in zip(regression_aggs(F.col(truth), F.col(pred)), ("n", "mae", "rmse", "r2"), strict=True)])
    return groups.crossJoin(F.broadcast(rows))  # one row each


def within_group_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """Population variance inside groups of at least two, averaged over them."""
    g = df.groupBy(group).agg(F.var_pop(value).alias("v"), F.count(value).alias("n")).where("n >= 2")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("v").alias("mean_variance"))


def masked_means(df: DataFrame, columns: Sequence[str], flag: Column | None = None) -> DataFrame:
    """Per column: sum over valid cells / max(their number, 1)."""
    ok = F.lit(True) if flag is None else flag
    cells = {c: F.when(ok & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    return df.agg(*((F.coalesce(F.sum(x), F.lit(0.0)) / F.greatest(F.count(x), F.lit(1))).alias(c) for c, x in cells.items()))


def paired_difference(df: DataFrame, a: str, b: str, factor: float = 1.0, band: float = 0.1, valid: Column | None = None) -> DataFrame:
    """Mean and lower median of (a - b) * factor and the shares below -band, inside and above it."""
    d = (F.col(a) - F.col(b)) * factor
    d = F.when(valid, d) if valid is not None else d
    n = F.count(d)
    return df.agg(
        n.alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"),
        F.try_divide(F.count_if(d < -band), n).alias("below"), F.try_divide(F.count_if(F.abs(d) <= band), n).alias("inside"),
        F.try_divide(F.count_if(d > band), n).alias("above"),
    )


def fractions(df: DataFrame, by: Sequence[str], **tests: Column) -> DataFrame:
    """Share of rows for which each test holds; null tests do not hold."""
    return df.groupBy(*by).agg(*(F.avg(F.coalesce(t, F.lit(False)).cast("int")).alias(n) for n, t in tests.items()))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"))


def argmin_where(df: DataFrame, by: Sequence[str], value: str, ident: str, flag: Column) -> DataFrame:
    """The id of the smallest value of each group, over all rows and over flagged rows; ties to the smaller id; no missing value counts."""
    lead = F.when(F.col(value).isNotNull() & F.col(ident).isNotNull(), F.struct(value, ident))
    return df.groupBy(*by).agg(F.min_by(ident, lead).alias("best"), F.min_by(ident, F.when(flag, lead)).alias("best_flagged"))


def noise_rank(df: DataFrame, key: str, truth: str, pred: str, top: int = 30, cut: float = 1.5, digits: int | None = None) -> DataFrame:
    """Residuals of largest size first: rank <= top or |residual| / sigma >= cut (sigma of truths, 1 if 0).

    With ``digits``, residuals and ratios are rounded before they rank or are held
    against the cut, so that noise of the arithmetic breaks no tie.  Rows are ranked over the whole table by cells, not in one task.
    """
    from sparkassay.operators.order import ranked

    sigma = df.agg(F.stddev_pop(truth).alias("__s")).select(F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0).alias("sigma"))
    shown = lambda c: c if digits is None else F.round(c, digits)
    raw = F.col(pred) - F.col(truth)
    r = df.crossJoin(F.broadcast(sigma)).withColumn("ratio", shown(F.abs(raw) / F.col("sigma"))).withColumn("residual", shown(raw))  # one row
    r = ranked(r.withColumn("size", F.abs("residual")).where("size IS NOT NULL"), "size", key, descending=True)
    return r.where((F.col("rank_no") <= top) | (F.col("ratio") >= cut)).drop("rank_n", "sigma", "size")


def bundle(parts: Sequence[tuple[str, DataFrame]], defaults: dict[str, float]) -> DataFrame:
    """(metric, value) of one-row frames; metrics that none of them gives take their default."""
    out = None
    for prefix, df in parts:
        cells = F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        rows = df.select(F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    spark = parts[0][1].sparkSession
    base = spark.createDataFrame([(k, float(v)) for k, v in defaults.items()], "metric string, fallback double")
    return base.join(out, "metric", "full").select("metric", F.coalesce("value", "fallback").alias("value"))
