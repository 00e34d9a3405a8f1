"""Sinks: staged overwrite, folds as partitions, statistics, reports and structure files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def replace_table(df: DataFrame, path: str, backup: bool = True, dry_run: bool = False) -> None:
    """Overwrite a table that ``df`` may itself read: stage, move the old one aside, rename."""
    spark = df.sparkSession
    fs, p, Path = _fs(spark, path)
    stage = Path(f"{path}.stage-{uuid.uuid4().hex[:8]}")
    df.write.parquet(stage.toString())
    if dry_run:
        fs.delete(stage, True)
        return
    old = Path(f"{path}.bak")
    aside = Path(f"{path}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(p)
    if had:
        _rename(fs, p, aside)
    try:
        _rename(fs, stage, p)
    except OSError:
        if had:
            _rename(fs, aside, p)  # the table keeps its name and rows
        raise
    if had and backup:
        fs.delete(old, True)  # the earlier backup goes only once the new table stands
        _rename(fs, aside, old)
    elif had:
        fs.delete(aside, True)


def _rename(fs, a, b) -> None:
    """Rename, or an error: file systems may only say that they did not."""
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {a.toString()} to {b.toString()}")


def write_folds(df: DataFrame, path: str, keys: Sequence[str] = ("fold", "part"), fmt: str = "csv") -> None:
    """One folder for each fold and part."""
    writer = df.repartition(*keys).write.mode("overwrite").partitionBy(*keys)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, log: DataFrame | None) -> DataFrame:
    """Rows added to a log whose rows may have other columns; the missing ones are null."""
    return df if log is None else log.unionByName(df, allowMissingColumns=True)


def write_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each statistic."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str, **counts: Column) -> DataFrame:
    """JSON lines at ``path``, and beside them in ``path.stats`` one row of aggregates, counted while writing."""
    seen = Observation(f"json-{uuid.uuid4().hex[:8]}")
    aggs = counts or {"n_rows": F.count(F.lit(1))}
    df.observe(seen, *(c.alias(name) for name, c in aggs.items())).write.mode("overwrite").json(path)
    stats = df.sparkSession.createDataFrame([seen.get])
    stats.coalesce(1).write.mode("overwrite").json(f"{path}.stats")
    return stats


def copy_snapshot(spark: SparkSession, tables: Mapping[str, str], path: str) -> DataFrame:
    """Copies of named Parquet tables under ``path`` and (name, n_rows, n_columns) of what was copied."""
    out = None
    for name, source in tables.items():
        at = f"{path}/{name}"
        spark.read.parquet(source).write.mode("overwrite").parquet(at)
        copy = spark.read.parquet(at)
        one = copy.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(copy.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def alias_views(spark: SparkSession, tables: Mapping[str, str]) -> None:
    """Names for tables that stay where they are: temporary views instead of links in a folder."""
    for name, source in tables.items():
        spark.read.parquet(source).createOrReplaceTempView(name)


def write_aligned(df: DataFrame, path: str, key: str, order: Sequence[str], parts: int | None = None) -> None:
    """A list of keys and the rows as CSV, in one order: line i of ``path.list`` is row i of ``path.csv``.

    The frame is sorted once into ranges and kept; both files are written from it, part by part.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    stage = f"{path}.stage-{uuid.uuid4().hex[:8]}"
    spark = df.sparkSession
    ranged.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).write.parquet(stage)
    rows = spark.read.parquet(stage).repartition("__part").sortWithinPartitions("__part", *order)
    rows.select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(f"{path}.list")
    rows.drop("__part").write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    fs, p, _ = _fs(spark, stage)
    fs.delete(p, True)


def trajectory_text(df: DataFrame, key: str, order: str, title: str, atoms: str) -> DataFrame:
    """(key, value): the frames of each key in order, one structure after the other."""
    frames = df.select(key, order, _xyz(title, atoms).alias("__frame"))
    return frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "__frame"))).alias("f")).select(
        key, F.array_join(F.transform("f", lambda s: s["__frame"]), "\n").alias("value")
    )


def is_fresh(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the target exists and is not older than the source."""
    fs, s, Path = _fs(spark, source)
    t = Path(target)
    return bool(fs.exists(t)) and fs.getFileStatus(t).getModificationTime() >= fs.getFileStatus(s).getModificationTime()


def structure_text(df: DataFrame, title: str, atoms: str, bonds: str, properties: str | None = None) -> DataFrame:
    """(value): V2000 records with their properties, to be written with a text sink."""
    atom = F.transform(atoms, lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", a["x"], a["y"], a["z"], a["element"]))
    bond = F.transform(bonds, lambda b: F.format_string("%3d%3d%3d  0", b["src"], b["dst"], b["type"]))
    head = F.array(F.col(title), F.lit("  sparkassay"), F.lit(""), F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size(atoms), F.size(bonds)))
    props = F.transform(F.map_entries(properties), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n"))) if properties else F.array().cast("array<string>")
    lines = F.concat(head, atom, bond, F.array(F.lit("M  END")), props, F.array(F.lit("$$$$")))
    return df.select(F.array_join(lines, "\n").alias("value"))


def _xyz(title: str, atoms: str) -> Column:
    lines = F.transform(atoms, lambda a: F.format_string("%s %.6f %.6f %.6f", a["element"], a["x"], a["y"], a["z"]))
    return F.array_join(F.concat(F.array(F.size(atoms).cast("string"), F.col(title)), lines), "\n")


def xyz_text(df: DataFrame, title: str, atoms: str) -> DataFrame:
    return df.select(_xyz(title, atoms).alias("value"))


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small aggregate as a table for reading; more than ``limit`` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    text = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(map(text, r)) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *body, ""])
