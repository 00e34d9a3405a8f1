"""Text, logs, links and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import text
from sparkassay.plans.catalog import query, table


@query(
    "regex_log",
    """WITH v AS (SELECT event_id, 'Hf for ' || user_id || ' is ' || value || ' kJ/mol' || CASE WHEN event_type = 'error' THEN 'S0 for ' || user_id || ' is 1.5e3 cal' ELSE '' END AS line FROM events)
    SELECT event_id, 0 AS pos, 'Hf' AS name, user_id::VARCHAR AS key, value, 'kJ/mol' AS unit, true AS ok FROM events
    UNION ALL SELECT event_id, 1, 'S0', user_id::VARCHAR, 1500.0, 'cal', false FROM events WHERE event_type = 'error'""",
)
def regex_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    glued = F.when(F.col("event_type") == "error", F.concat(F.lit("S0 for "), "user_id", F.lit(" is 1.5e3 cal"))).otherwise("")
    lines = e.select("event_id", F.concat(F.lit("Hf for "), "user_id", F.lit(" is "), F.col("value").cast("decimal(20,2)").cast("string"), F.lit(" kJ/mol"), glued).alias("line"))
    return text.log_records(lines, {"Hf": "kJ/mol", "S0": "J/mol/K"}, "line", "event_id")


@query(
    "page_links",
    """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""",
)
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_markers",
    """SELECT doc_id, contains(text, 'License') OR contains(text, 'CC BY') AS marked, split_part(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ', 1) AS first_token FROM documents WHERE text IS NOT NULL""",
)
def text_markers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.any_marker(F.col("text"), ["License", "CC BY"]).alias("marked"), text.first_token(F.regexp_replace("text", r"\s+", " ")).alias("first_token"))


@query("json_values", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k, TRY_CAST(json_extract_string(props, '$.absent') AS DOUBLE) AS absent FROM events")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_value("props", "$.k", -1.0).alias("k"), text.json_value("props", "$.absent").alias("absent"))


@query("set_text", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events GROUP BY 1")
def set_text(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(text.set_text(F.collect_set("event_type")).alias("types"))


@query("safe_names", """SELECT page_id, left(translate(url, '<>:"/\\|?*', '_________'), 50) AS name FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(
    "conversation_summary",
    """SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, arg_min(length(text), turn) AS first_length FROM conversations GROUP BY 1""",
)
def conversation_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_distinct("role").alias("n_roles"), F.min_by(F.length("text").cast("long"), "turn").alias("first_length"))


def _drain(spark, sf_dir, build, mode="append"):
    """Run a stream over the table to its end and read what it wrote."""
    import uuid

    from sparkassay.session import shared_dir
    from sparkassay.streaming import events

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = events.stream_table(spark, f"{sf_dir}/events.parquet")
    out = build(stream)
    if mode == "append":
        events.run_available(out, f"{at}/out", f"{at}/state")
    else:
        def keep(frame, number):
            frame.write.mode("overwrite").parquet(f"{at}/out")

        events.run_available(out, "", f"{at}/state", mode, keep)
    return spark.read.parquet(f"{at}/out")


@query(
    "stream_last_value",
    "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1",
)
def stream_last_value(spark, sf_dir):
    from sparkassay.streaming.events import last_value

    return _drain(spark, sf_dir, lambda s: last_value(s, ["user_id"], F.col("ts"), ["event_id", "value"]), "complete")


@query(
    "stream_windows",
    """SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(avg(value * value), 4) AS mse FROM events GROUP BY 1, 2""",
)
def stream_windows(spark, sf_dir):
    from sparkassay.streaming.events import windowed_metrics

    out = _drain(spark, sf_dir, lambda s: windowed_metrics(s, "ts", "value", ["event_type"]), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("mse", 4).alias("mse"))


@query(
    "stream_best",
    """WITH a AS (SELECT *, row_number() OVER w AS no, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, count(*) AS n, min(value) AS best, max(no) - max(CASE WHEN prev IS NULL OR value < prev THEN no END) AS waited,
    max(no) - max(CASE WHEN prev IS NULL OR value < prev THEN no END) >= 20 AS stopped FROM a GROUP BY 1""",
)
def stream_best(spark, sf_dir):
    from sparkassay.streaming.events import running_best

    return _drain(spark, sf_dir, lambda s: running_best(s, "user_id", "value", "ts", 20), "update")


@query(
    "stream_batches",
    """SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, true AS within FROM events GROUP BY 1""",
)
def stream_batches(spark, sf_dir):
    """Cost batches of a stream with lookahead, closed by one flushing row a key: every row leaves once, within the budget."""
    import uuid

    from sparkassay.session import shared_dir
    from sparkassay.streaming import events

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("user_id") % 30 + 1).alias("size"))
    e.write.parquet(f"{at}/in")

    def drain():
        rows = spark.readStream.schema(e.schema).parquet(f"{at}/in")
        events.run_available(events.lookahead_batches(rows, "event_type", "event_id", "size", 40, 20), f"{at}/out", f"{at}/state")

    drain()
    e.select("event_type").distinct().select("event_type", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("size")).write.mode("append").parquet(f"{at}/in")
    drain()
    out = spark.read.parquet(f"{at}/out").join(e, ["event_type", "event_id"])
    batches = out.groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("m"), F.count_distinct("event_id").alias("d"))
    allowed = F.greatest(F.lit(1), F.floor(40 * F.pow(20 / F.greatest(F.col("m"), F.lit(events.LEAST_SIZE)), 2)))
    return batches.groupBy("event_type").agg(F.sum("c").alias("n"), F.sum("d").alias("n_ids"), F.bool_and(F.col("c") <= allowed).alias("within"))


@query(
    "stream_upsert",
    "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1",
)
def stream_upsert(spark, sf_dir):
    """The latest event of each user, kept in a table by upserts of the buckets a batch touches."""
    import uuid

    from sparkassay.session import shared_dir
    from sparkassay.streaming import events

    at = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    stream = events.stream_table(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    events.run_available(stream, "", f"{at}/state", batch=events.upsert_batch(f"{at}/table", ["user_id"], "ts"))
    return spark.read.parquet(f"{at}/table").select("user_id", "event_id")
