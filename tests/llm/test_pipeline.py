import random

from pyspark.sql import functions as F

import corpus_pipeline
from sparkassay.llm._store import Scratch


def tables(llm, at):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("n", "ka", "ri", "del")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = sentence(40)
    docs, labels = [], []
    for i in range(260):
        body = "\n".join(sentence(rng.randint(8, 30)) for _ in range(rng.randint(2, 6)))
        if i % 9 == 0:
            body = " ".join(w.upper() + "$$$" for w in body.split())
        elif i % 13 == 1:
            body += "\n" + item
        elif i % 17 == 2 and docs:
            body = docs[i - 3][1]
        docs.append((i, body, "en", f"s{i % 4}", len(body)))
        labels.append((i, 0 if i % 9 == 0 else 1, 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, sentence(30), "en", None, 5), (20, docs[20][1], "en", "s0", 1)]
    llm.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_each_stage_does_its_work(llm, tmp_path):
    at = str(tmp_path)
    tables(llm, at)
    docs, scratch = llm.read.parquet(f"{at}/documents.parquet"), Scratch(llm, "test-pipeline")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.cut(stage(llm, docs, at), name)
        kept[name] = docs
        if name != "mixing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    bad = {i for i in range(260) if i % 9 == 0}
    assert len(ids["quality"] & bad) <= 1 and len(ids["quality"] - bad) >= 0.97 * (260 - len(bad))
    copies = {i for i in range(260) if i % 17 == 2 and i > 3 and i % 9 and i % 13 != 1}
    assert not {i for i in copies if i - 3 in ids["quality"]} & ids["line_dedup"]
    rows = [r for r in kept["near_duplicates"].collect() if r.doc_id is not None]
    assert len(rows) == len({r.doc_id for r in rows})
    # line dedup leaves the passage in its first holder alone, and that one leaks
    leaky = {r.doc_id for r in kept["near_duplicates"].collect() if r.doc_id is not None and r.doc_id % 13 == 1 and r.doc_id < 260}
    gone = ids["near_duplicates"] - ids["decontamination"]
    assert len(gone) == 1 and gone <= leaky
    assert ids["mixing"] == ids["decontamination"]
    assert all(r.taken <= 2 * r.size for r in kept["mixing"].collect())


def test_run_agrees_with_the_stages(llm, tmp_path):
    at = str(tmp_path)
    tables(llm, at)
    one = sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in corpus_pipeline.run(llm, at).collect())
    two = sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in corpus_pipeline.run(llm, at).collect())
    assert one == two and one


def test_empty_documents(llm, tmp_path):
    at = str(tmp_path)
    tables(llm, at)
    docs = llm.read.parquet(f"{at}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, at)
        assert docs.count() == 0


def test_extra_columns_with_clashing_names(llm, tmp_path):
    at = str(tmp_path)
    tables(llm, at)
    mark = F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    names = ("score", "Predicted", "kept_text", "n_dropped", "component_id", "kept", "item_id", "id")
    docs = llm.read.parquet(f"{at}/documents.parquet").withColumns({n: mark for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, at)
        assert out.columns == docs.columns
        assert out.where(" OR ".join(f"`{n}` <> 'own ' || coalesce(string(doc_id), 'none')" for n in names)).count() == 0, name
