"""From raw documents to a training mix: five stages, each one operator over all that the one before kept.

Defined results: rows without a text pass the quality stage on the score of an
empty text; a document that loses its last line to earlier documents goes, one
that was empty before stays; rows that share an id are one document, of which the
near-duplicate stage keeps one row; rows without an id are never linked and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkassay.llm._store import Scratch
from sparkassay.llm.decontaminate import drop_contaminated
from sparkassay.llm.line_dedup import KEY_SPACE, dedup_lines
from sparkassay.llm.minhash import dedup_near
from sparkassay.llm.mixing import mix_sources
from sparkassay.llm.quality import classify_quality


def beside(docs: DataFrame, results: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(docs)`` with the columns of ``docs`` alone; own columns named like its results keep their values."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in results}
    safe = docs.withColumnsRenamed(own)
    return step(safe).select(*safe.columns).withColumnsRenamed({v: k for k, v in own.items()})


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return beside(docs, ("held_out", "score", "predicted"), lambda d: classify_quality(d, labels).where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text."""
    return beside(docs, ("kept_text", "n_lines", "n_dropped"), without_lines)


def without_lines(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    cut = F.col("n_dropped") > 0
    out = out.where(~cut | (F.btrim("kept_text", F.lit(KEY_SPACE)) != "")).withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each class of near duplicates.

    A row is known by its id and text: two unlike texts under one id are two documents.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h")))
    kept = dedup_near(docs.select(row.alias("__np_row"), "text"), "__np_row").where("kept AND __np_row IS NOT NULL")
    kept = kept.select(F.col("__np_row.doc_id").alias("__np_id"), F.col("__np_row.h").alias("__np_h")).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn("__np_th", F.xxhash64("text"))
    named = named.join(kept.hint("merge"), (F.col("doc_id") == F.col("__np_id")) & (F.col("__np_th") == F.col("__np_h")), "left_semi")
    one = W.Window.partitionBy("doc_id", "__np_th").orderBy(F.xxhash64(*docs.columns))
    named = named.withColumn("__np_no", F.row_number().over(one)).where("__np_no = 1").select(*docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The classifier's network and the alignments have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
