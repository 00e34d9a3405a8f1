"""Scans: Parquet, CSV in its variants, logs, JSON maps and reports, structure files, folds as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions.text import date_token, first_token

#: Target columns by preference, and columns that are never the target.
TARGETS = ("TARGET", "target", "mean", "y", "value")
NOT_TARGETS = ("smiles", "split", "_split", "n", "std", "solvent")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: NaN of float columns becomes null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.parquet(path))


def csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header, all columns as text; a byte order mark is not part of the first name."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def csv_named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless: names and types by position; what does not parse is null."""
    return nan_to_null(spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path))


def csv_tolerant(spark: SparkSession, path: str, numeric: Sequence[str]) -> DataFrame:
    """Text columns, the numeric ones parsed with null for what does not parse."""
    df = csv(spark, path)
    return nan_to_null(df.withColumns({c: F.col(c).try_cast("double") for c in numeric}))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines of text files; bytes that are not UTF-8 are replaced."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of files that hold one object of strings."""
    one = spark.read.text(path, wholetext=True)
    return one.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def json_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a corrupt one is a row with ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def mean_of_reports(reports: DataFrame, folds: str, field: str) -> DataFrame:
    """Adds the mean of a field over an embedded array; an empty array gives 0."""
    total = F.aggregate(folds, F.lit(0.0), lambda s, f: s + f[field].cast("double"))
    return reports.withColumn(f"{field}_mean", total / F.greatest(F.size(folds), F.lit(1)))


def token_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): the first token of every line that is not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(first_token(F.col("value")).alias("value"))


def structure_records(spark: SparkSession, path: str) -> DataFrame:
    """(title, n_atoms, n_bonds, atoms, bonds, properties) of multi-record structure files (V2000 blocks).

    Records end with ``$$$$``; ones that do not parse are dropped.
    """
    raw = spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", r"^\n(?=\S)", ""), "\r?\n")
    rec = raw.select(lines.alias("l")).withColumn("counts", F.get("l", F.lit(3)))
    n = lambda a: F.substring("counts", a, 3).try_cast("int")
    rec = rec.withColumn("na", n(1)).withColumn("nb", n(4)).where("na IS NOT NULL AND nb IS NOT NULL AND na > 0 AND size(l) >= 4 + na + nb")
    field = lambda s, a, k: F.trim(F.substring(s, a, k))
    atoms = F.transform(F.slice("l", 5, F.col("na")), lambda s: F.struct(
        field(s, 1, 10).try_cast("double").alias("x"), field(s, 11, 10).try_cast("double").alias("y"), field(s, 21, 10).try_cast("double").alias("z"), field(s, 32, 3).alias("element")))
    bonds = F.transform(F.slice("l", F.col("na") + 5, F.col("nb")), lambda s: F.struct(
        field(s, 1, 3).try_cast("int").alias("src"), field(s, 4, 3).try_cast("int").alias("dst"), field(s, 7, 3).try_cast("int").alias("type")))
    props = F.str_to_map(F.array_join(F.transform(
        F.regexp_extract_all(F.array_join("l", "\n"), F.lit(r"> +<([^>]+)>[^\n]*\n([^\n]*)"), F.lit(0)),
        lambda m: F.concat(F.regexp_extract(m, r"<([^>]+)>", 1), F.lit("\x01"), F.regexp_extract(m, r"\n([^\n]*)", 1))), "\x02"), F.lit("\x02"), F.lit("\x01"))
    return rec.select(F.trim(F.get("l", F.lit(0))).alias("title"), F.col("na").alias("n_atoms"), F.col("nb").alias("n_bonds"), atoms.alias("atoms"), bonds.alias("bonds"), props.alias("properties"))


def xyz_structures(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, atoms) of files that hold one structure: count, title, then element and coordinates."""
    one = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("l"))
    n = F.trim(F.get("l", F.lit(0))).try_cast("int")
    part = lambda s, i: F.get(F.split(F.trim(s), r"\s+"), F.lit(i))
    atoms = F.transform(F.slice("l", 3, n), lambda s: F.struct(part(s, 0).alias("element"), *(part(s, i + 1).try_cast("double").alias(c) for i, c in enumerate("xyz"))))
    return one.where(n > 0).select("file", F.get("l", F.lit(1)).alias("title"), atoms.alias("atoms"))


def fold_files(spark: SparkSession, path: str, pattern: str = r"cv(\d+)_(train|valid|test)\.csv$") -> DataFrame:
    """CSV rows with ``fold`` and ``part`` read from their file's name."""
    df = csv(spark, path)
    name = F.input_file_name()
    return df.withColumn("fold", F.regexp_extract(name, pattern, 1).try_cast("int")).withColumn("part", F.regexp_extract(name, pattern, 2))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, length, modified); contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def newest(files: DataFrame, contains: str = "") -> DataFrame:
    """(path) of the file whose name holds a substring (any case) and the latest eight-digit date."""
    hit = files.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return hit.agg(F.max_by("path", F.struct(date_token(F.col("name")), "name")).alias("path"))


def datasets(files: DataFrame, only: Sequence[str] = (), skip: str = "report") -> DataFrame:
    """Data files: every one whose name does not hold ``skip``, or those listed."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    out = files.withColumn("dataset", stem).where(~F.contains(F.lower("name"), F.lit(skip)))
    return out.where(F.col("dataset").isin(*only)) if only else out


def literal_rows(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


def resolve_columns(columns: Sequence[str], target: str | None = None) -> tuple[str, str]:
    """(molecule column, target column) by name; reads no data."""
    key = next((c for c in columns if c.lower() == "smiles"), None)
    if key is None:
        raise ValueError("no smiles column")
    if target:
        if target not in columns:
            raise ValueError(f"no column {target}")
        return key, target
    for t in TARGETS:
        if t in columns:
            return key, t
    for c in columns:
        if c.lower() not in NOT_TARGETS:
            return key, c
    raise ValueError("no target column")


def ordinal(df: DataFrame, key: Column) -> DataFrame:
    """An explicit order for first-wins operators, from data and not from partition numbers."""
    return df.withColumn("ordinal", key)
