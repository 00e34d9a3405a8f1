import random

from pyspark.sql import functions as F

from sparkassay.streaming import events


def write(spark, at, rows):
    spark.createDataFrame(rows, "k string, o long, v double").coalesce(1).write.mode("append").parquet(at)


def test_a_second_run_goes_on_where_the_first_ended(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k string, at timestamp, v double"
    mk = lambda rows: spark.createDataFrame(rows, "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("at"), "v").coalesce(1).write.mode("append").parquet(src)
    batches = []
    save = events.upsert_batch(table, ["k"], "at")

    def batch(frame, number):
        batches.append(frame.count())
        save(frame, number)

    mk([("a", 1, 1.0), ("b", 5, 2.0)])
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    events.run_available(stream(), "", str(tmp_path / "state"), batch=batch)
    mk([("a", 9, 3.0), ("b", 2, 9.0)])
    events.run_available(stream(), "", str(tmp_path / "state"), batch=batch)
    events.run_available(stream(), "", str(tmp_path / "state"), batch=batch)
    assert [n for n in batches if n] == [2, 2]
    assert {(r.k, r.v) for r in spark.read.parquet(table).collect()} == {("a", 3.0), ("b", 2.0)}


def test_running_best_across_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    values = {"x": [5.0, 4.0, 4.5, 6.0, 3.0], "y": [1.0, 2.0]}
    for part in (slice(0, 3), slice(3, 9)):
        write(spark, src, [(k, i, v) for k, vs in values.items() for i, v in list(enumerate(vs))[part]] or [("x", 99, None)])
    stream = spark.readStream.schema("k string, o long, v double").option("maxFilesPerTrigger", 1).parquet(src)
    events.run_available(events.running_best(stream, "k", "v", "o", 2), "", str(tmp_path / "state"), "update", lambda f, n: out.extend(f.collect()))
    last = {}
    for r in out:
        if r.k not in last or r.n > last[r.k].n:
            last[r.k] = r
    assert {k: (r.n, r.best) for k, r in last.items()} == {"x": (5, 3.0), "y": (2, 1.0)}


def test_every_row_leaves_exactly_once():
    rng = random.Random(2)
    pool = [(rng.randint(1, 40), rng.randint(0, 300)) for _ in range(500)]  # equal rows among them
    out, batch, waiting = [], 0, []
    for lo in range(0, 500, 90):
        waiting += pool[lo : lo + 90]
        got, batch = events.take_batches(waiting, 10, 20, 100, batch)
        out += got
    assert 0 < len(waiting) < 100
    got, batch = events.take_batches(waiting, 10, 20, 100, batch, drain=True)
    out += got
    assert sorted(i for _, i in out) == sorted(i for _, i in pool) and not waiting
    assert events.take_batches([(5, 1), (5, 1)], 1, 5, 1, 0, drain=True)[0] == [(0, 1), (1, 1)] or events.rows_allowed(5, 1, 5) == 1
    sizes = {}
    for s, i in pool:
        sizes.setdefault(i, set()).add(s)
    for b in range(batch):
        rows = [i for n, i in out if n == b]
        least = max(min(sizes[i]) for i in rows)
        assert rows and len(rows) <= events.rows_allowed(least, 10, 20)


def test_a_batch_costs_a_window_and_not_the_pool():
    class Pool(list):
        read = 0

        def __getitem__(self, at):
            got = super().__getitem__(at)
            Pool.read += len(got) if isinstance(at, slice) else 1
            return got

        def __setitem__(self, at, rows):
            Pool.read += len(rows)
            super().__setitem__(at, rows)

    rng = random.Random(3)
    rows = [(rng.randint(1, 30), i) for i in range(4000)]
    pool, parts, fed = Pool(rows), [], []
    out, batch = events.take_batches(pool, 10, 20, 50, 0)
    assert batch > 100 and Pool.read < 3 * len(rows)
    last = 0
    for lo in range(0, 4000, 333):  # in parts as at once
        parts += rows[lo : lo + 333]
        got, last = events.take_batches(parts, 10, 20, 50, last)
        fed += got
    assert (fed, last, parts) == (out, batch, list(pool))


def test_rows_allowed():
    assert [events.rows_allowed(s, 100, 20) for s in (1, 9, 20, 40, 400)] == [493, 493, 100, 25, 1]


def test_stream_flushes_what_is_held(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, "k string, i long, s long").coalesce(1).write.mode("append").parquet(src)
    run = lambda: events.run_available(
        events.lookahead_batches(spark.readStream.schema("k string, i long, s long").parquet(src), "k", "i", "s", 10, 20, 50), out, str(tmp_path / "state"))
    put([("a", i % 60, i % 35) for i in range(120)] + [("b", 1, 7)])
    run()
    held = 121 - spark.read.parquet(out).count()
    assert 0 < held <= 50 + 1
    put([("a", None, None), ("b", None, None)])
    run()
    got = spark.read.parquet(out).collect()
    assert sorted((r.k, r.i) for r in got) == sorted([("a", i % 60) for i in range(120)] + [("b", 1)])


def test_log_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("Hf for A is 1.5 kJ/molHf for B is 2 kJ/mol\nnoise\n")
    stream = events.log_stream(spark, str(tmp_path / "logs"), {"Hf": "kJ/mol"})
    got = []
    events.run_available(stream, "", str(tmp_path / "state"), batch=lambda f, n: got.extend(f.collect()))
    assert sorted((r.key, r.value, r.ok) for r in got) == [("A", 1.5, True), ("B", 2.0, True)]
