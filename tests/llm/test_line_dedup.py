import hashlib
import random

from pyspark.sql import functions as F

from sparkassay.llm.line_dedup import KEY_SPACE, LOWER, UPPER, LineRuns, dedup_lines
from sparkassay.llm._store import Scratch


def brute(rows, least=10):
    key = lambda s: s.strip(KEY_SPACE).translate(str.maketrans(UPPER, LOWER))
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else t or ""))
    return sorted(out, key=repr)


def spark_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_against_brute_force(llm):
    rng = random.Random(3)
    lines = [f"Line {i} is long enough" for i in range(12)] + ["short", "", " \tPADDED line here\r", "padded LINE here", "Ähnliche Zeile hier"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 3), (5, 2)):
        assert spark_rows(dedup_lines(df, batches=batches, fanout=fanout)) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert spark_rows(dedup_lines(odd_docs)) == brute(rows)
    assert dedup_lines(no_docs).count() == 0


def test_clashing_columns_are_replaced(odd_docs):
    df = odd_docs.withColumn("N_lines", F.lit("x")).withColumn("kept_text", F.lit(1)).withColumn("pos", F.lit(2))
    out = dedup_lines(df)
    assert dict(out.dtypes)["kept_text"] == "string" and "pos" in out.columns
    assert out.where("n_lines = 3000 AND n_dropped = 0").count() == 1


def test_runs_are_compacted(llm):
    runs = LineRuns(Scratch(llm, "test-runs"), fanout=2)
    for i in range(4):
        keys = llm.range(i * 5, i * 5 + 10).select(F.col("id").alias("__ld_h1"), F.col("id").alias("__ld_h2"), F.col("id").alias("__ld_first"))
        runs.add(runs.absent(keys))
        runs.compact()
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.runs()[0].count() == 25
    runs.close()
    assert not [t for t in llm.catalog.listTables() if "test_runs" in t.name]


def test_more_levels_and_no_tables_left(llm):
    rng = random.Random(5)
    rows = [(i, "\n".join(f"this is line {rng.randint(0, 60)} of all" for _ in range(5))) for i in range(80)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    before = {t.name for t in llm.catalog.listTables()}
    assert spark_rows(dedup_lines(df, batches=9, fanout=2)) == brute(rows)
    assert {t.name for t in llm.catalog.listTables()} == before


def test_digest_matches(llm, odd_docs):
    out = dedup_lines(odd_docs).select("kept_text", F.sha2("kept_text", 256).alias("h")).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.h for r in out)
