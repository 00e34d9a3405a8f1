"""Median / MAD screening: bounds per group, then masking instead of dropping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.operators.quantiles import ROBUST_K, join_groups, robust_bounds

def mask_outliers(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    k: float = ROBUST_K,
    impossible: Column | None = None,
    masked: Sequence[str] = (),
    flag: str = "is_outlier",
) -> DataFrame:
    """Every row stays; rows outside the bounds get NULL in ``masked`` and a true flag.

    ``impossible`` marks rows that no bound may be computed from (first level).
    """
    bad = F.coalesce(impossible, F.lit(False)) if impossible is not None else F.lit(False)
    bounds = robust_bounds(df, value, by, k, ~bad)
    keys = list(by)
    wide = join_groups(df, bounds, keys, "left")
    out = wide.withColumn(flag, bad | F.coalesce((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")), F.lit(False)))
    for c in masked or (value,):
        out = out.withColumn(c, F.when(~F.col(flag), F.col(c)))
    return out.drop("med", "sigma", "lo", "hi")
