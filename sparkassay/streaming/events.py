"""Structured Streaming forms: windowed accumulators, last-wins upserts, running best, cost batches."""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, path: str, files_a_trigger: int = 8) -> DataFrame:
    """A Parquet table as a stream; the schema is read from what is there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream watches a folder
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def windowed_metrics(events: DataFrame, at: str, value: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, by, n, mean, mse): mergeable sums per event-time window; rows later than the watermark are dropped."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    x = F.col(value)
    return e.groupBy(F.window(at, width).alias("w"), *by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(x * x).alias("mse")
    ).select(F.col("w.start").alias("window_start"), *by, "n", "mean", "mse")


def last_value(events: DataFrame, key: list[str], order: Column, payload: list[str]) -> DataFrame:
    """The latest payload of each key so far; complete or update mode."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*payload), order).alias("p")).select(*key, "p.*")


BEST = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("waited", T.LongType()), T.StructField("n", T.LongType())])


def running_best(events: DataFrame, key: str, metric: str, order: str, limit: int) -> DataFrame:
    """(key, n, best, waited, stopped) after each batch: least value so far and rows since it last fell.

    Rows are in order within a micro-batch; one that arrives in a later batch than its
    place in ``order`` counts where it arrives.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waited, n = state.get if state.exists else (float("inf"), 0, 0)
        rows = pd.concat(list(parts)).sort_values([order])
        for v in rows[metric].dropna():
            n += 1
            best, waited = (float(v), 0) if v < best else (best, waited + 1)
        state.update((best, waited, n))
        yield pd.DataFrame({key: [name[0]], "n": [n], "best": [best], "waited": [waited], "stopped": [waited >= limit]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, metric, order).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, n long, best double, waited long, stopped boolean", BEST, "update", GroupStateTimeout.NoTimeout
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", batch=None) -> None:
    """Drain what is there: ``availableNow`` into Parquet, or through ``batch(frame, number)``.

    The checkpoint makes a second run continue where the first ended.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)).start()
    query.awaitTermination()


def upsert_batch(path: str, key: list[str], order: str, buckets: int = 64):
    """For ``foreachBatch``: keep the latest row of each key in the table at ``path``.

    The table lies in folders by a hash of the key; a batch rewrites those it has
    keys of, through a staged copy, and leaves the others as they are.
    """
    from sparkassay.operators.clean import first_per_key
    from sparkassay.sources.sinks import _fs

    def write(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        fs, p, _ = _fs(spark, path)
        rows = frame.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        if fs.exists(p):
            touched = rows.select("bucket").distinct()  # at most ``buckets`` rows
            old = spark.read.schema(rows.schema).parquet(path).join(F.broadcast(touched), "bucket", "left_semi")
            rows = old.select(*rows.columns).unionByName(rows)
        stage = f"{path}.stage-{number}"
        first_per_key(rows, key, [-F.unix_micros(F.col(order).cast("timestamp"))]).select(*rows.columns).write.mode("overwrite").parquet(stage)
        staged = spark.read.schema(rows.schema).parquet(stage).repartition("bucket")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        fs, p, _ = _fs(spark, stage)
        fs.delete(p, True)

    return write


def log_stream(spark: SparkSession, path: str, units: dict[str, str]) -> DataFrame:
    """Records of a growing folder of logs: (file, name, key, value, ok); for last_value or upsert_batch."""
    from sparkassay.functions.text import log_records

    lines = spark.readStream.text(path).select(F.input_file_name().alias("line_no"), "value")
    return log_records(lines, units).withColumnRenamed("line_no", "file")


CARRY = T.StructType([T.StructField("held", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("batch", T.LongType())])

#: Rows a batch may have at the reference size, that size, the least size counted, rows looked at at once, and how much larger than a drawn row the others may be.
REFERENCE_ROWS, REFERENCE_SIZE, LEAST_SIZE, LOOKAHEAD, MARGIN = 100, 20, 9, 800, 5


def rows_allowed(size: int, reference_rows: int = REFERENCE_ROWS, reference_size: int = REFERENCE_SIZE) -> int:
    """Rows a batch may have whose largest row has ``size``: the cost of a row grows with its square."""
    return max(1, int(reference_rows * (reference_size / max(LEAST_SIZE, size)) ** 2))


def lookahead_batches(
    rows: DataFrame, key: str, ident: str, size: str, reference_rows: int = REFERENCE_ROWS, reference_size: int = REFERENCE_SIZE,
    window: int = LOOKAHEAD, idle: str | None = None, seed: int = 42,
) -> DataFrame:
    """(key, batch, ident): rows grouped by size so that a batch keeps to ``rows_allowed`` of its largest row.

    A window of rows is held; those that suit a drawn row leave together, the others
    are carried over.  Each row leaves exactly once, repeated rows as often as they
    came.  Less than a window stays held until more arrives, a row of the key without
    an id asks for all that is held, or the key was idle for ``idle``.  That last needs
    a query that goes on; one that drains what is there and ends must leave it out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sizes, batch = state.get if state.exists else ([], [], 0)
        pool, batch = list(zip(sizes, held, strict=True)), int(batch)
        flush = state.hasTimedOut
        frame = lambda out: pd.DataFrame(out, columns=["batch", ident]).assign(**{key: name[0]})[[key, "batch", ident]].astype({"batch": "int64", ident: "int64"})
        if not flush:
            # part by part: a task holds a window and one part, however many rows a key has
            for part in parts:
                flush |= bool(part[ident].isna().any())
                part = part[part[ident].notna()]
                pool += list(zip(part[size].astype("int64").tolist(), part[ident].astype("int64").tolist(), strict=True))
                out, batch = take_batches(pool, reference_rows, reference_size, window, batch, seed=seed)
                yield frame(out)
        out, batch = take_batches(pool, reference_rows, reference_size, window, batch, drain=flush, seed=seed)
        state.update(([int(i) for _, i in pool], [int(s) for s, _ in pool], batch))
        if pool and wait:
            state.setTimeoutDuration(wait)
        yield frame(out)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ident, size).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, batch long, `{ident}` long", CARRY, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    )


def take_batches(
    pool: list[tuple[int, int]], reference_rows: int, reference_size: int, window: int, batch: int, drain: bool = False, seed: int = 42
) -> tuple[list[tuple[int, int]], int]:
    """Take whole batches out of ``pool`` (size, id), which keeps what is carried over, in order.

    A batch costs a window whatever the pool holds: its rows are kept by arrival and by size.
    """
    out: list[tuple[int, int]] = []
    seen = min(window, len(pool))  # rows of the pool that have come into the window
    held = [(s, i, no) for no, (s, i) in enumerate(pool[:seen])]
    by_size = sorted(held)  # the number tells equal rows apart
    while held and (drain or len(held) >= window):
        n = len(held)
        # the drawn row bounds the batch, so large rows do not always go first
        top = max(LEAST_SIZE, min(by_size[-1][0], held[random.Random(f"{seed}|{batch}").randrange(n)][0] + MARGIN))
        end = max(1, bisect_right(by_size, top, key=lambda row: row[0]))
        start = max(0, end - rows_allowed(by_size[end - 1][0], reference_rows, reference_size))
        while start == 0 and end < n and end + 1 <= rows_allowed(by_size[end][0], reference_rows, reference_size):
            end += 1  # room is left: larger rows may come along
        taken = {no for _, _, no in by_size[start:end]}
        out += [(batch, i) for _, i, no in held if no in taken]
        come = [(s, i, no) for no, (s, i) in enumerate(pool[seen : seen + len(taken)], seen)]
        seen += len(come)
        held = [row for row in held if row[2] not in taken] + come
        del by_size[start:end]
        by_size += come
        by_size.sort()
        batch += 1
    pool[:] = [(s, i) for s, i, _ in held] + pool[seen:]
    return out, batch
