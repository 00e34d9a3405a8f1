"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Size of a document: its words.  Sources in code-point order (null last) get
   ``weights`` in turn; together they share ``budget`` times all words.  A target
   stops at ``ceiling`` times its source's words and the rest is shared again by
   weight (water filling, solved by one sorted pass over the sources).
2. The budget is cut into blocks of equal words.  Blocks go to sources by highest
   quotients target / (2k + 1).  Rounding target / block gives all but a few of
   the quotas; only the quotients next to that are ranked, about 2.5 a source.
3. A source is cut into hash shards of about ``shard_words`` words, so the largest
   source is spread over as many tasks as its share asks for.  Its quota goes to
   its shards in the same way, by their sizes.
4. In a shard, documents lie end to end in seeded hash order, and the quota's
   blocks are read from the start, going round again once the shard is used up.
   What a document gives is the overlap of its words with those blocks.

DataFrame functions only.  Joins to the per-source frame are salted.  Defined
results: null text has size 0 and gives nothing; an empty table gives no rows;
equal rows are interchangeable and reruns agree; null ids count as the text
'null' in the hash; the block shrinks until every positive target holds
``min_blocks`` of them, so tiny sources come near their targets too.  Input
columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkassay.llm._store import Scratch

#: The weights in turn, the share of all words, and the most copies of a source.
WEIGHTS = (3, 1, 2)
BUDGET_HALVES = 3
CEILING = 2
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row a source: ``__mx_no`` (rank), ``__mx_total``, ``__mx_target``.

    The windows over all sources hold one row a source, not the documents.
    """
    sums = sized.groupBy("__mx_src").agg(F.sum("__mx_size").alias("__mx_total"))
    order = W.Window.orderBy(F.col("__mx_src").asc_nulls_last())
    whole = W.Window.partitionBy()
    s = (
        sums.withColumn("__mx_no", F.row_number().over(order))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__mx_no") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", CEILING * F.col("__mx_total"))
        .withColumn("all", F.sum("__mx_total").over(whole))
    )
    by_fill = W.Window.orderBy((F.col("cap").cast("double") / F.col("w")), "__mx_no")
    before = by_fill.rowsBetween(W.Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, W.Window.unboundedFollowing)
    s = (
        s.withColumn("i", F.row_number().over(by_fill))
        .withColumn("c", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("ws", F.sum("w").over(after))
        .withColumn("twice_left", BUDGET_HALVES * F.col("all") - 2 * F.col("c"))
        .withColumn("open", F.col("cap").cast("double") * 2 * F.col("ws") > F.col("w").cast("double") * F.col("twice_left"))
    )
    s = s.withColumn("first", F.min(F.when(F.col("open"), F.col("i"))).over(whole))
    s = (
        s.withColumn("l", F.max(F.when(F.col("i") == F.col("first"), F.col("twice_left"))).over(whole))
        .withColumn("lw", F.max(F.when(F.col("i") == F.col("first"), F.col("ws"))).over(whole))
        .withColumn(
            "__mx_target",
            F.when(F.col("i") >= F.col("first"), (F.col("w") * F.col("l")).cast("double") / (2 * F.col("lw"))).otherwise(F.col("cap").cast("double")),
        )
    )
    return s.select("__mx_src", "__mx_no", "__mx_total", "__mx_target")


def apportion(parties: DataFrame, votes: str, start: str, seats: str, out: str, within: Sequence[str], key: str) -> DataFrame:
    """Sainte-Lague quotas of ``seats`` by ``votes``, from the rounded quotas in ``start``.

    The start differs from the wanted sum by at most half the number of parties,
    so a party gains or loses at most 1.5 x parties x its share + 1 seats, and
    only that many quotients a party are ranked.
    """
    group = W.Window.partitionBy(*within)
    p = (
        parties.withColumn("d", F.col(seats) - F.sum(start).over(group))
        .withColumn("near", F.ceil(1.5 * F.count(F.lit(1)).over(group) * F.col(votes) / F.greatest(F.sum(votes).over(group), F.lit(1e-9))) + 1)
    )
    tried = p.where(F.col("d") != 0).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("near"))))
    up = F.col("d") > 0
    seat = F.when(up, F.col(start) + F.col("j")).otherwise(F.col(start) - F.col("j") + 1)
    tried = tried.withColumn("seat", seat).where("seat >= 1").withColumn("q", F.col(votes).cast("double") / (2 * F.col("seat") - 1))
    best = W.Window.partitionBy(*within).orderBy(F.when(up, -F.col("q")).otherwise(F.col("q")), key)
    moved = (
        tried.withColumn("r", F.row_number().over(best)).where(F.col("r") <= F.abs("d"))
        .groupBy(*within, key).agg(F.sum(F.signum("d")).cast("long").alias("move"))
    )
    return (
        p.join(moved, [*within, key], "left")
        .withColumn(out, F.col(start) + F.coalesce("move", F.lit(0))).drop("d", "near", "move")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    block_words: int = 64,
    min_blocks: int = 100,
    shard_words: int = 1_000_000,
    seed: int = 7,
) -> DataFrame:
    """Input columns without the text, plus ``size``, ``source_size``, ``target`` and ``taken``."""
    results = ("size", "source_size", "target", "taken")
    carried = [c for c in docs.columns if c.lower() not in (*results, text_col.lower())]
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = scratch.cut(
        docs.select(
            *carried, F.col(source_col).alias("__mx_src"), key.alias("__mx_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__mx_size"),
        ),
        "sizes",
    )
    sources = source_targets(sized, weights)
    whole = W.Window.partitionBy()
    sources = sources.withColumn(
        "__mx_block",
        F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("__mx_target") > 0, F.col("__mx_target"))).over(whole) / min_blocks))).cast("long"),
    ).withColumn("seats", F.floor(F.sum("__mx_total").over(whole) * BUDGET_HALVES / 2 / F.col("__mx_block") + 0.5).cast("long"))
    sources = sources.withColumn("start", F.floor(F.col("__mx_target") / F.col("__mx_block") + 0.5).cast("long")).withColumn("one", F.lit(1))
    sources = apportion(sources, "__mx_target", "start", "seats", "__mx_quota", ["one"], "__mx_no").withColumn(
        "__mx_shards", F.greatest(F.lit(1), F.ceil(F.col("__mx_total") / shard_words)).cast("long")
    )
    sources = scratch.cut(sources.select("__mx_src", "__mx_no", "__mx_total", "__mx_target", "__mx_block", "__mx_quota", "__mx_shards"), "sources")
    salted = sources.withColumn("__mx_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("__mx_src", "__mx_src2")
    number = F.conv(F.substring("__mx_key", 1, 8), 16, 10).cast("long")
    placed = (
        sized.withColumn("__mx_salt", (number % SALTS).cast("int"))
        .join(salted, F.col("__mx_src").eqNullSafe(F.col("__mx_src2")) & (F.col("__mx_salt") == F.col("__mx_salt2")))
        .withColumn("__mx_shard", number % F.col("__mx_shards"))
    )
    placed = scratch.cut(placed.drop("__mx_src", "__mx_src2", "__mx_salt", "__mx_salt2", "__mx_shards"), "placed")
    shards = placed.groupBy("__mx_no", "__mx_shard").agg(
        F.sum("__mx_size").alias("__mx_words"), F.first("__mx_quota").alias("__mx_quota"), F.first("__mx_total").alias("__mx_total")
    )
    shards = shards.withColumn(
        "start", F.coalesce(F.floor(F.try_divide(F.col("__mx_words").cast("double") * F.col("__mx_quota"), F.col("__mx_total")) + 0.5), F.lit(0)).cast("long")
    )
    shards = apportion(shards, "__mx_words", "start", "__mx_quota", "__mx_own", ["__mx_no"], "__mx_shard").select("__mx_no", "__mx_shard", "__mx_words", "__mx_own")
    lay = W.Window.partitionBy("__mx_no", "__mx_shard").orderBy("__mx_key", "__mx_size").rowsBetween(W.Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("__mx_size").over(lay), F.lit(0))
    size, goal, once = F.col("__mx_size"), F.col("__mx_own") * F.col("__mx_block"), F.col("__mx_words")
    clip = lambda x: F.greatest(F.lit(0).cast("long"), F.least(size, x))
    out = placed.join(shards, ["__mx_no", "__mx_shard"]).withColumn("__mx_at", at)
    return out.select(
        *carried, size.alias("size"), F.col("__mx_total").alias("source_size"), F.col("__mx_target").alias("target"),
        (clip(goal - F.col("__mx_at")) + clip(goal - once - F.col("__mx_at"))).cast("long").alias("taken"),
    )
