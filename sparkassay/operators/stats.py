"""Column profiles, group summaries, frequency tables, histograms and distances between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkassay.operators.quantiles import exact_quantiles, join_groups, number

def column_profile(df: DataFrame, columns: Sequence[str], subsets: Mapping[str, Column] | None = None) -> DataFrame:
    """(subset, column, n, n_null, mean, std, min, median, max); sample deviation.

    Values are unpivoted once for each subset they are in; medians are exact and distributed.
    """
    subsets = {"all": F.lit(True)} | dict(subsets or {})
    inside = F.filter(F.array(*(F.when(where, F.lit(name)) for name, where in subsets.items())), lambda s: s.isNotNull())
    values = F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("x")) for c in columns))
    long = df.select(F.explode(inside).alias("subset"), values.alias("__v")).select("subset", F.inline("__v"))
    x = F.col("x")
    base = long.groupBy("subset", "column").agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_null"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    middle = exact_quantiles(long, ["subset", "column"], "x", [0.5]).select("subset", "column", F.col("q")[0].alias("median"))
    # a subset without rows has its line all the same
    lines = df.sparkSession.createDataFrame([(s, c) for s in subsets for c in columns], "subset string, column string")
    out = lines.join(base, ["subset", "column"], "left").join(middle, ["subset", "column"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("subset", "column", zero("n"), zero("n_null"), "mean", "std", "min", "median", "max")


def five_numbers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation and linear quartiles of each group."""
    x = number(value)
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(df, by, value, [0.25, 0.5, 0.75]).drop("n")
    return join_groups(base, q, by, "left").select(
        *by, "n", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max"
    )


def with_total(counts: DataFrame, n: str = "n", out: str = "__total") -> DataFrame:
    """The sum of a column beside every row, by an aggregate of one row and not a window in one task."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias(out))))


def frequency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, share of all rows)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return with_total(counts).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def top_k(counts: DataFrame, by: Sequence[str], k: int, name: str, n: str = "n") -> DataFrame:
    """The k commonest values of each group, ties by name.  The rows are counts, one a value."""
    order = W.Window.partitionBy(*by).orderBy(F.col(n).desc(), F.col(name))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def split_frequency(df: DataFrame, col: str, sep: str = r"\|") -> DataFrame:
    """How often each non-empty part of a separated string occurs."""
    parts = df.select(F.explode(F.split(col, sep)).alias("part")).where(F.trim("part") != "")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def mapped_histogram(df: DataFrame, label: str, buckets: Mapping[str, int], other: int = 0) -> DataFrame:
    """(bucket, n, share in percent) of labels mapped to buckets; the map is a literal."""
    table = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])
    bucket = F.coalesce(F.try_element_at(table, F.col(label)), F.lit(other))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return with_total(counts).withColumn("share", 100.0 * F.col("n") / F.col("__total")).drop("__total")


def rollup_counts(df: DataFrame, by: str, distinct: str) -> DataFrame:
    """Rows and distinct keys for each group and over all (``by`` null)."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("n_distinct"))


def conditional(df: DataFrame, given: str, what: str) -> DataFrame:
    """P(what | given), P(given) and the prior of ``what`` that they imply."""
    counts = df.groupBy(given, what).agg(F.count(F.lit(1)).alias("n"))
    g, w = W.Window.partitionBy(given), W.Window.partitionBy(what)
    return (
        with_total(counts).withColumn("p_given", F.sum("n").over(g) / F.col("__total")).drop("__total")
        .withColumn("p", F.col("n") / F.sum("n").over(g))
        .withColumn("prior", F.sum(F.col("p") * F.col("p_given")).over(w))
    )


def array_histogram(df: DataFrame, items: Column) -> DataFrame:
    """Shares of the elements of nested arrays."""
    return frequency(df.select(F.explode(items).alias("value")), ["value"])


def size_histogram(df: DataFrame, items: Column) -> DataFrame:
    return frequency(df.select(F.size(items).alias("value")), ["value"])


def edge_type_histogram(df: DataFrame, n_nodes: str, edge_types: str) -> DataFrame:
    """Shares of edge types, type 0 standing for the ordered node pairs without an edge."""
    none = df.agg(F.sum(F.col(n_nodes) * (F.col(n_nodes) - 1) - F.size(edge_types)).alias("n")).select(F.lit(0).alias("type"), "n")
    some = df.select(F.explode(edge_types).alias("type")).groupBy(F.col("type").cast("int").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    both = none.unionByName(some).groupBy("type").agg(F.sum("n").alias("n"))
    return with_total(both).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def histogram(df: DataFrame, value: str, bins: int | None = None, least: int = 10, most: int = 60, rows_a_bin: int = 50) -> DataFrame:
    """(bin, lo, hi, n); without ``bins`` their number follows the row count, n / 50 within [10, 60]."""
    x = number(value)
    span = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count(x).alias("c")).select(
        "a", "b", (F.lit(bins) if bins else F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("c") / rows_a_bin)))).cast("int").alias("k")
    )
    wide = df.select(x.alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(span))  # one row
    at = F.least(F.col("k"), F.when(F.col("a") == F.col("b"), 1).otherwise(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * F.col("k")) + 1)).cast("int")
    step = (F.col("b") - F.col("a")) / F.col("k")
    return wide.groupBy(at.alias("bin"), "a", "b", "k").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("a") + (F.col("bin") - 1) * step).alias("lo"), (F.col("a") + F.col("bin") * step).alias("hi"), "n"
    )


def wasserstein(
    sample: DataFrame, reference: DataFrame, key: str, value: str, bins: int = 1000, span: tuple[float, float] | None = None
) -> DataFrame:
    """(key, weight, w1): 1-Wasserstein distance of binned densities of each reference key.

    The range is common to both sides (``span``, or their joint extremes per key).
    Weight is the key's share of the reference; keys missing from the sample, or
    there only once, count 0.  Sum weight * w1 for the total.
    """
    both = sample.select(F.col(key).alias("key"), number(value).alias("x"), F.lit(0).alias("side")).union(
        reference.select(F.col(key), number(value), F.lit(1))
    ).where("x IS NOT NULL")
    lo, hi = (F.lit(float(span[0])), F.lit(float(span[1]))) if span else (F.min("x"), F.max("x"))
    stat = both.groupBy("key").agg(
        lo.alias("lo"), hi.alias("hi"), F.count_if(F.col("side") == 0).alias("ns"), F.count_if(F.col("side") == 1).alias("nr")
    )
    stat = with_total(stat.where("nr > 0"), "nr").withColumn("weight", F.col("nr") / F.col("__total")).drop("__total")
    width = F.col("hi") - F.col("lo")
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - F.col("lo")) / width * bins))))
    counts = both.join(stat, "key").groupBy("key", at.alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("cs"), F.count_if(F.col("side") == 1).alias("cr"), *(F.first(c).alias(c) for c in ("lo", "hi", "ns", "nr", "weight"))
    )
    run = W.Window.partitionBy("key").orderBy("bin")
    upto = run.rowsBetween(W.Window.unboundedPreceding, 0)
    # |F - G| is constant from an occupied bin to the next; after the last it is 0
    gap = F.abs(F.sum("cs").over(upto) / F.col("ns") - F.sum("cr").over(upto) / F.col("nr")) * (F.coalesce(F.lead("bin").over(run), F.col("bin")) - F.col("bin"))
    done = counts.where("ns > 1").withColumn("gap", gap).groupBy("key").agg(
        (F.sum("gap") * F.first(F.col("hi") - F.col("lo")) / bins).alias("w1")
    )
    return stat.select("key", "weight").join(done, "key", "left").withColumn("w1", F.coalesce("w1", F.lit(0.0)))


#: Most values a histogram may have to be sent to all tasks as one array.
MOST_STEPS = 100_000


def multinomial_draw(hist: DataFrame, draws: DataFrame, value: str, weight: str, u: Column) -> DataFrame:
    """For every row of ``draws`` the value whose cumulative share first exceeds ``u`` in [0, 1).

    ``hist`` has one row a value, at most ``MOST_STEPS`` of them (more is an error);
    their cumulative limits are one array, looked up by counting.
    """
    if hist.limit(MOST_STEPS + 1).count() > MOST_STEPS:
        raise ValueError(f"a histogram of more than {MOST_STEPS} values: draw from bins first")
    order = W.Window.orderBy(value).rowsBetween(W.Window.unboundedPreceding, 0)
    cum = with_total(hist, weight).withColumn("c", F.sum(weight).over(order) / F.col("__total"))
    one = cum.agg(F.array_sort(F.collect_list(F.struct("c", value))).alias("steps"))
    at = F.size(F.filter("steps", lambda s: s["c"] <= F.col("__u")))
    return draws.withColumn("__u", u).crossJoin(F.broadcast(one)).withColumn(
        value, F.element_at("steps", F.least(at + 1, F.size("steps")).cast("int"))[value]
    ).drop("__u", "steps")
