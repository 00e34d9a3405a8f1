"""Line dedup over levelled, sorted runs of line hashes.

Batches of documents arrive in id order.  The runs hold one row for every line
key seen so far: a 128-bit hash and the smallest id that holds it.  A run is a
table bucketed and sorted by hash, so a batch's keys are anti-joined with the
runs by merging and only the batch side moves.  Keys that no run has become the
batch's own run on level 0; when a level has ``fanout`` runs they are merged
into one run of the next level, so a batch meets O(log batches) runs.

Lines are hashed in one pass over the texts and stored by batch; a second pass puts
the kept lines together.  The number of batches follows the bytes (``batch_bytes``,
at least 4), as every batch reads all runs.  Runs that were merged, and at the end
all of them, are dropped.

A line stays if its key is exempt (shorter than ``min_chars``) or if the batch's
new run names this very document as the key's holder.  That test joins on (hash,
id), so a line found in a third of all documents spreads over all partitions,
and keys are pre-aggregated on the map side before their shuffle.

DataFrame functions only.  Defined results:

* null or empty text is one empty line and stays as it is;
* a null id comes after all ids; rows without an id hold a line together and all
  keep it if no row with an id has it;
* rows that share an id count as one document: none of them loses a line to the
  other, and a line repeated inside one holder stays repeated;
* ids are numbers;
* columns of the input that are named like a result are replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm._store import Scratch, partitions

#: The white space stripped from a key and the letters lower-cased.
KEY_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

BUCKET_LINES = 50_000
LEAST_BATCHES, BATCH_BYTES = 4, 8 << 40
HASHES = ("__ld_h1", "__ld_h2")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(KEY_SPACE)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs: ``absent`` merge-anti-joins, ``add`` appends, ``compact`` merges full levels."""

    def __init__(self, scratch: Scratch, fanout: int = 3, buckets: int | None = None):
        self.scratch, self.spark, self.fanout = scratch, scratch.spark, fanout
        self.buckets = buckets or partitions(scratch.spark)
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def absent(self, keys: DataFrame) -> DataFrame:
        for run in self.runs():
            keys = keys.join(run.select(*HASHES), list(HASHES), "left_anti")
        return keys

    def _write(self, keys: DataFrame, name: str) -> DataFrame:
        at = self.scratch.path(name)
        table = "line_run_" + at.rsplit("/", 2)[-2].replace("-", "_") + f"_{self.scratch._n}"
        (
            keys.repartition(self.buckets, *HASHES).write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
            .option("path", at).saveAsTable(table)
        )
        out = self.spark.table(table)
        out._scratch_path, out._table = at, table
        return out

    def _drop(self, runs: list[DataFrame]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run._table}")
        self.scratch.drop(runs)

    def add(self, keys: DataFrame) -> DataFrame:
        """Store new keys as a run of level 0."""
        run = self._write(keys, "run")
        self.levels[0].append(run)
        return run

    def compact(self) -> None:
        """Merge each level that has ``fanout`` runs into one run of the next; plans over the merged runs end here."""
        i = 0
        while i < len(self.levels):
            level = self.levels[i]
            if len(level) >= self.fanout:
                merged = level[0]
                for other in level[1:]:
                    merged = merged.unionByName(other)
                big = self._write(merged, f"level{i + 1}")
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(big)
                self._drop(level)
            i += 1

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]


def batch_cuts(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ids that part the rows into about equal batches in id order."""
    found = docs.approxQuantile(id_col, [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(x) for x in found})


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int | None = None,
    fanout: int = 3,
) -> DataFrame:
    """All input rows and columns, plus ``kept_text``, ``n_lines`` and ``n_dropped``."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    ident, text = F.col(id_col), F.col(text_col)
    if batches is None:
        total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        batches = max(LEAST_BATCHES, -(-total // BATCH_BYTES))
    cuts = batch_cuts(docs, id_col, batches)
    # a null id comes after all ids
    number = sum((F.when(ident < c, 0).otherwise(1) for c in cuts), F.lit(0))
    lines = (
        docs.select(ident.alias("__ld_id"), F.xxhash64(text).alias("__ld_th"), F.posexplode(text_lines(text)).alias("__ld_at", "__ld_line"), number.alias("__ld_batch"))
        .withColumn("__ld_key", line_key(F.col("__ld_line")))
        .where(F.length("__ld_key") >= min_chars)
        .select(
            "__ld_id", "__ld_th", "__ld_at", "__ld_batch",
            F.xxhash64("__ld_key").alias(HASHES[0]), F.xxhash64(F.lit(1), "__ld_key").alias(HASHES[1]),
        )
    )
    lines = scratch.cut(lines, "lines", by="__ld_batch")
    # all runs share one bucketing: a bucket for every BUCKET_LINES, at most one a shuffle partition
    runs = LineRuns(scratch, fanout, min(partitions(docs.sparkSession), max(4, -(-lines.count() // BUCKET_LINES))))
    gone = None
    for no in range(len(cuts) + 1):
        part = lines.where(F.col("__ld_batch") == no).drop("__ld_batch")
        keys = part.groupBy(*HASHES).agg(F.min("__ld_id").alias("__ld_first"))
        run = runs.add(runs.absent(keys))
        held = run.select(*(F.col(h).alias(h + "r") for h in HASHES), "__ld_first")
        dropped = part.join(
            held,
            (F.col(HASHES[0]) == F.col(HASHES[0] + "r")) & (F.col(HASHES[1]) == F.col(HASHES[1] + "r")) & F.col("__ld_id").eqNullSafe(F.col("__ld_first")),
            "left_anti",
        )
        # identical rows that share an id collect the same places; array_except takes each once
        found = scratch.cut(dropped.groupBy("__ld_id", "__ld_th").agg(F.collect_set("__ld_at").alias("__ld_gone")), "gone")
        gone = found if gone is None else gone.unionByName(found)
        runs.compact()
    runs.close()
    scratch.drop([lines])
    # merged at every size: broadcasting what is dropped would only suit small inputs
    gone = gone.select(F.col("__ld_id").alias("__ld_gid"), F.col("__ld_th").alias("__ld_gth"), "__ld_gone").hint("merge")
    wide = docs.withColumn("__ld_th", F.xxhash64(text)).join(
        gone, ident.eqNullSafe(F.col("__ld_gid")) & (F.col("__ld_th") == F.col("__ld_gth")), "left"
    )
    split = text_lines(text)
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__ld_gone"))
    kept = F.when(F.col("__ld_gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(split, i)), "\n")
    )
    return (
        wide.withColumn("kept_text", kept)
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long"))
        .drop("__ld_th", "__ld_gid", "__ld_gth", "__ld_gone")
    )
