"""Constraint reports: every check of a table in one aggregation, one row a check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constraint_report(df: DataFrame, checks: Mapping[str, Column], tolerance: Mapping[str, int] | None = None) -> DataFrame:
    """(check, n_bad, status) for row tests that must hold; null counts as bad.

    PASS without bad rows, WARN up to the check's tolerance, else FAIL.
    """
    tolerance = dict(tolerance or {})
    names = list(checks)
    one = df.agg(*(F.count_if(~F.coalesce(checks[n], F.lit(False))).alias(f"b{i}") for i, n in enumerate(names)))
    cells = [
        F.struct(
            F.lit(n).alias("check"), F.col(f"b{i}").alias("n_bad"),
            F.when(F.col(f"b{i}") == 0, "PASS").when(F.col(f"b{i}") <= tolerance.get(n, 0), "WARN").otherwise("FAIL").alias("status"),
        )
        for i, n in enumerate(names)
    ]
    return one.select(F.inline(F.array(*cells)))


def unique_check(df: DataFrame, keys: Sequence[str], name: str = "unique") -> DataFrame:
    """(check, n_bad, status): rows beyond the first of their key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    bad = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"))
    return bad.select(F.lit(name).alias("check"), "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL").alias("status"))


def schema_check(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Differences between a frame's schema and (column -> type), in order; reads no data."""
    have = dict(df.dtypes)
    out = [f"missing {c}" for c in expected if c not in have]
    out += [f"extra {c}" for c in have if c not in expected]
    out += [f"{c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
    if not out and list(have) != list(expected):
        out.append("columns are out of order")
    return out


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max) of several columns in one pass."""
    one = df.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("min"), F.col(f"b_{c}").alias("max")) for c in columns])))


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """The frame, or an error if it has fewer than ``least`` rows; reads no more than that."""
    if len(df.limit(least).select(F.lit(1)).collect()) < least:
        raise ValueError(f"fewer than {least} rows")
    return df
