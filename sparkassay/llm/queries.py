"""The queries opN_<name> and their SQL: thin uses of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    from sparkassay.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES["op1_line_dedup"] = op1_line_dedup
ORACLES["op1_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, i, line, first IS NOT NULL AND first <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op9_mix_sources(spark, sf_dir):
    from sparkassay.llm.mixing import mix_sources

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op9_mix_sources"] = op9_mix_sources
ORACLES["op9_mix_sources"] = r"""
WITH z AS (
  SELECT doc_id, source, md5('7|' || coalesce(doc_id::VARCHAR, 'null')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS total FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, 2 * total AS cap, (sum(total) OVER ())::BIGINT AS everything FROM s0),
s2 AS (SELECT *, [3, 1, 2][((no - 1) % 3 + 1)::INT] AS w FROM s1),
s3 AS (SELECT *, row_number() OVER f AS i,
         coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         (sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
       FROM s2 WINDOW f AS (ORDER BY cap::DOUBLE / w, no)),
s4 AS (SELECT *, 3 * everything - 2 * c AS twice_left FROM s3),
s5 AS (SELECT *, min(i) FILTER (WHERE cap::DOUBLE * 2 * ws > w::DOUBLE * twice_left) OVER () AS first FROM s4),
s6 AS (SELECT *, max(twice_left) FILTER (WHERE i = first) OVER () AS l, max(ws) FILTER (WHERE i = first) OVER () AS lw FROM s5),
s7 AS (SELECT source, no, total, everything, CASE WHEN i >= first THEN (w * l)::DOUBLE / (2 * lw) ELSE cap::DOUBLE END AS target FROM s6),
s8 AS (SELECT *, greatest(1, least(64, floor(min(target) FILTER (WHERE target > 0) OVER () / 100)))::BIGINT AS block FROM s7),
s9 AS (SELECT *, floor((everything * 3)::DOUBLE / 2 / block + 0.5)::BIGINT AS seats, floor(target / block + 0.5)::BIGINT AS start FROM s8),
s10 AS (SELECT *, (seats - sum(start) OVER ())::BIGINT AS d FROM s9),
sc AS (SELECT no, d, CASE WHEN d > 0 THEN start + j ELSE start - j + 1 END AS seat, target FROM s10, generate_series(1, 64) g(j) WHERE d <> 0),
sr AS (SELECT no, sign(d) AS step, d, row_number() OVER (ORDER BY CASE WHEN d > 0 THEN -(target / (2 * seat - 1)) ELSE target / (2 * seat - 1) END, no) AS r FROM sc WHERE seat >= 1),
sm AS (SELECT no, sum(step)::BIGINT AS move FROM sr WHERE r <= abs(d) GROUP BY no),
s AS (SELECT s10.*, start + coalesce(move, 0) AS quota, greatest(1, ceil(total / 1000000.0))::BIGINT AS shards FROM s10 LEFT JOIN sm USING (no)),
p AS (SELECT z.doc_id, z.k, z.size, s.no, s.total, s.target, s.block, s.quota, ('0x' || substr(z.k, 1, 8))::BIGINT % s.shards AS shard
      FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
h0 AS (SELECT no, shard, sum(size)::BIGINT AS words, first(quota) AS quota, first(total) AS total FROM p GROUP BY no, shard),
h1 AS (SELECT *, coalesce(floor(words::DOUBLE * quota / nullif(total, 0) + 0.5), 0)::BIGINT AS start FROM h0),
h2 AS (SELECT *, (quota - sum(start) OVER (PARTITION BY no))::BIGINT AS d FROM h1),
hc AS (SELECT no, shard, d, words, CASE WHEN d > 0 THEN start + j ELSE start - j + 1 END AS seat FROM h2, generate_series(1, 64) g(j) WHERE d <> 0),
hr AS (SELECT no, shard, d, row_number() OVER (PARTITION BY no ORDER BY CASE WHEN d > 0 THEN -(words::DOUBLE / (2 * seat - 1)) ELSE words::DOUBLE / (2 * seat - 1) END, shard) AS r FROM hc WHERE seat >= 1),
hm AS (SELECT no, shard, sum(sign(d))::BIGINT AS move FROM hr WHERE r <= abs(d) GROUP BY no, shard),
h AS (SELECT h2.no, h2.shard, words, start + coalesce(move, 0) AS own FROM h2 LEFT JOIN hm USING (no, shard)),
a AS (SELECT p.*, h.words, h.own * p.block AS goal,
        coalesce(sum(size) OVER (PARTITION BY p.no, p.shard ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM p JOIN h USING (no, shard))
SELECT doc_id, size, total AS source_size, target,
       (greatest(0, least(size, goal - pos)) + greatest(0, least(size, goal - words - pos)))::BIGINT AS taken
FROM a
"""


def op4_license_scan(spark, sf_dir):
    from sparkassay.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op4_license_scan"] = op4_license_scan


def op2_quality(spark, sf_dir):
    from sparkassay.llm.quality import classify_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, _table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", "held_out", "score", "predicted")


QUERIES["op2_quality"] = op2_quality


def op3_html_extract(spark, sf_dir):
    from sparkassay.llm.html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES["op3_html_extract"] = op3_html_extract


def op6_minhash_dedup(spark, sf_dir):
    from sparkassay.llm.minhash import dedup_near

    return dedup_near(_table(spark, sf_dir, "documents"))


QUERIES["op6_minhash_dedup"] = op6_minhash_dedup
ORACLES["op6_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
        ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, far) AS (SELECT x, y FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.far),
m AS (SELECT node, min(far) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(m.least, d.doc_id), d.doc_id) AS component_id, coalesce(least(m.least, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""


def op8_decontaminate(spark, sf_dir):
    from sparkassay.llm.decontaminate import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word", "item_words")


QUERIES["op8_decontaminate"] = op8_decontaminate


def page_captures(pages):
    """A crawl log of the pages: a full response at second ``page_id`` and a 304 a thousand seconds later."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    stored = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Cache-Control"), F.lit("max-age=60"),
        F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
    )
    fresh = F.create_map(
        F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("cache-control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("Age"), F.lit("0"),
    )
    full = pages.select(
        F.concat(F.lit("r"), name).alias("record_id"), F.lit("response").alias("kind"), "url", F.timestamp_seconds("page_id").alias("at"),
        F.when(F.col("html").isNotNull(), 200).otherwise(204).alias("status"), stored.alias("headers"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
    )
    again = pages.select(
        F.concat(F.lit("v"), name).alias("record_id"), F.lit("revisit").alias("kind"), "url", F.timestamp_seconds(F.col("page_id") + 1000).alias("at"),
        F.lit(304).alias("status"), fresh.alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)


def op10_warc_revisits(spark, sf_dir):
    from sparkassay.llm.warc import header_text, resolve_revisits

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return resolve_revisits(page_captures(pages)).select(
        "record_id", "canonical_url", "resolution", "response_id", "payload_digest", header_text(F.col("merged_headers")).alias("headers")
    )


QUERIES["op10_warc_revisits"] = op10_warc_revisits
ORACLES["op10_warc_revisits"] = r"""
WITH u AS (
  SELECT page_id, md5(coalesce(html, '')) AS h, html IS NOT NULL AS full_page, strlen(coalesce(html, '')) AS n,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[Ww][Ww][Ww]\.)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|jsessionid|phpsessid|sessionid|sid|gclid|fbclid)(=.*)?$'))), '&') AS query
  FROM pages),
c AS (SELECT page_id, h, n, full_page,
    host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM u),
f AS (SELECT * FROM c WHERE full_page),
j AS (SELECT v.page_id, v.canonical_url, v.h, f.page_id AS fid, f.h AS fh, f.n AS fn
      FROM (SELECT *, page_id + 1000 AS at_s FROM c) v ASOF LEFT JOIN f ON v.canonical_url = f.canonical_url AND v.at_s > f.page_id)
SELECT 'v' || page_id AS record_id, canonical_url,
  CASE WHEN fid IS NULL THEN 'missing' WHEN fh = h THEN 'resolved' ELSE 'mismatch' END AS resolution,
  'r' || fid AS response_id, CASE WHEN fh = h THEN fh END AS payload_digest,
  CASE WHEN fh = h THEN 'age: 0; cache-control: max-age=600; content-length: ' || fn || '; content-type: text/html; etag: W/"' || h || '"' END AS headers
FROM j
"""


def op5_nearest(spark, sf_dir):
    from sparkassay.llm.ann import nearest_neighbours

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 50 == 0))


QUERIES["op5_nearest"] = op5_nearest


def op7_suffix_dedup(spark, sf_dir):
    from sparkassay.llm.suffix_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES["op7_suffix_dedup"] = op7_suffix_dedup
ORACLES["op7_suffix_dedup"] = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(len(x) // 2 - 49)) AS i, unnest(list_transform(range(len(x) // 2 - 49), lambda i: substr(x, 2 * i + 1, 100))) AS w FROM h WHERE len(x) >= 100),
f AS (SELECT w, min(doc_id) AS least FROM p GROUP BY w),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p JOIN f USING (w) WHERE least < doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY 1, 2),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM s),
q AS (SELECT t.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
        string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM t JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN q USING (doc_id)
"""
