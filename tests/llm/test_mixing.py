import random

from pyspark.sql import functions as F

from sparkassay.llm.mixing import apportion, mix_sources


def fill(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        share = left / sum(w[s] for s in free)
        full = [s for s in free if 2 * sizes[s] <= share * w[s] + 1e-9]
        if not full:
            out.update({s: share * w[s] for s in free})
            break
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check(rows, df, **kw):
    got = mix_sources(df, **kw).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    goal = fill(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[s]) <= max(2, 0.02 * goal[s])
    return got


def test_targets_and_taken(llm):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 300)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    df = llm.createDataFrame(rows, "doc_id long, text string, source string")
    one = check(rows, df)
    two = check(rows, df.repartition(7), shard_words=500)
    again = check(rows, df.repartition(3), shard_words=500)
    assert sorted(map(tuple, two)) == sorted(map(tuple, again))
    assert sum(r.taken for r in one) > 0


def test_odd_rows(odd_docs, no_docs):
    got = mix_sources(odd_docs)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "taken"}
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (3, 4, 6))
    assert mix_sources(no_docs).count() == 0
    clash = mix_sources(odd_docs.withColumn("Size", F.lit("x")).withColumn("target", F.lit(1)))
    assert dict(clash.dtypes)["target"] == "double" and clash.columns.count("size") == 1


def test_only_empty_texts(llm):
    rows = llm.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_sources(rows).collect()] == [(0, 0.0, 0)] * 2


def test_apportionment_is_by_highest_quotients(llm):
    rng = random.Random(5)
    for seats in (7, 100, 1001):
        votes = [rng.randint(1, 1000) for _ in range(12)]
        want = [0] * 12
        for _ in range(seats):
            i = max(range(12), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))
            want[i] += 1
        total = sum(votes)
        rows = [(i, v, int(v * seats / total + 0.5), seats, 1) for i, v in enumerate(votes)]
        df = llm.createDataFrame(rows, "k long, votes long, start long, seats long, one int")
        got = {r.k: r.q for r in apportion(df, "votes", "start", "seats", "q", ["one"], "k").collect()}
        assert [got[i] for i in range(12)] == want
