"""Text expressions: records in log lines, links, file names, numbers as text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern as an array of structs g1..gn."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
    return F.transform(
        F.arrays_zip(*[p.alias(f"g{i + 1}") for i, p in enumerate(parts)]),
        lambda s: F.struct(*[s[f"g{i + 1}"].alias(f"g{i + 1}") for i in range(groups)]),
    )


def log_pattern(names: Sequence[str]) -> str:
    """A record: property, key up to the first " is ", number, unit; records may be glued together."""
    some = "|".join(map(re.escape, names))
    return rf"({some}) for (.+?) is (-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?) (\S+?)(?=(?:{some}) for |\s|$)"


def log_records(lines: DataFrame, units: Mapping[str, str], line: str = "value", order: str = "line_no") -> DataFrame:
    """(order, pos, name, key, value, unit, ok): every record of every line; ok if the unit is the property's.

    Records beyond the first of a line (glued without a newline) have pos > 0.
    """
    table = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    found = lines.select(F.col(order), F.posexplode(matches(F.col(line), log_pattern(list(units)), 4)).alias("pos", "m"))
    return found.select(
        order, "pos", F.col("m.g1").alias("name"), F.col("m.g2").alias("key"), F.col("m.g3").try_cast("double").alias("value"), F.col("m.g4").alias("unit")
    ).withColumn("ok", F.coalesce(F.try_element_at(table, F.col("name")) == F.col("unit"), F.lit(False)))


def any_marker(text: Column, markers: Sequence[str]) -> Column:
    """Whether any of the substrings occurs."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def first_token(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")[0]


def date_token(name: Column) -> Column:
    """The last run of exactly eight digits, for picking the newest of several files."""
    return F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{8})(?!\d)"), F.lit(1))), -1)


#: Characters that file names may not have, and their greatest length.
RESERVED, NAME_LENGTH = '<>:"/\\|?*', 50


def safe_name(text: Column) -> Column:
    return F.substring(F.translate(text, RESERVED, "_" * len(RESERVED)), 1, NAME_LENGTH)


def number_text(x: Column) -> Column:
    """Three decimals; scientific for what would read as 0.000; a dash for missing.

    Python rounds the exact binary value as C does; Java's formatter rounds the shortest decimal.
    """

    def show(values: pd.Series) -> pd.Series:
        return pd.Series(["-" if v != v else ("%.2e" if v != 0 and abs(v) < 0.001 else "%.3f") % v for v in values.astype("float64")], dtype=object)

    return F.pandas_udf(show, "string")(x.cast("double"))


def set_text(values: Column, sep: str = "|") -> Column:
    """Distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(values)), sep)


def flag(col: str, default: int = 1) -> Column:
    """A 0/1 flag written as a number; what does not parse is the default."""
    return F.coalesce(F.col(col).try_cast("double").try_cast("int"), F.lit(default)) == 1


def int_or(col: str, default: int = -1) -> Column:
    return F.coalesce(F.col(col).try_cast("int"), F.lit(default))


def json_value(col: str, path: str, default: float | None = None) -> Column:
    x = F.get_json_object(col, path).try_cast("double")
    return x if default is None else F.coalesce(x, F.lit(default))
