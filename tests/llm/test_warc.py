import gzip
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sparkassay.llm.warc import CAPTURES, canonical_url, read_records, read_warc, resolve_revisits, write_record

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(llm, rows):
    return llm.createDataFrame(rows, CAPTURES)


def test_canonical_urls(llm):
    pairs = {
        "HTTP://www.Example.COM:80/a/?b=2&a=1&utm_source=x#top": "example.com/a?a=1&b=2", "https://example.com": "example.com/", "https://example.com/": "example.com/",
        "http://example.com:8080/x//": "example.com:8080/x", "https://u:p@example.com/q?": "example.com/q", "no url": None, None: None, "http://m.example.com/a?ref=x": "m.example.com/a?ref=x",
    }
    df = llm.createDataFrame([(k,) for k in pairs], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == pairs


def brute(rows):
    out = {}
    for rid, kind, url, at, _, headers, digest in rows:
        if kind != "revisit":
            continue
        full = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] == url and r[3] < at]
        if not full:
            out[rid] = ("missing", None)
            continue
        best = max(full, key=lambda r: (r[3], r[0]))
        same = headers["ETag"] == best[5]["ETag"]
        out[rid] = ("resolved" if same else "mismatch", best[0])
    return out


def test_as_of_join_against_brute_force(llm):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "response", "revisit"])
        status = 304 if kind == "revisit" else rng.choice([200, 200, 404])
        url = "http://hot.example.com/" if i % 3 == 0 else f"http://e{rng.randint(0, 9)}.example.com/p"
        rows.append((f"r{i:03d}", kind, url, T0 + timedelta(minutes=rng.randint(0, 600)), status, {"ETag": f'"{rng.randint(0, 1)}"'}, f"d{i}"))
    for block in (600, 86400):
        got = {r.record_id: (r.resolution, r.response_id) for r in resolve_revisits(frame(llm, rows), block).collect()}
        assert got == brute(rows)


def test_headers_and_validators(llm):
    full = {"Content-Type": "text/html", "ETag": 'W/"1"', "content-length": "9", "Cache-Control": "old", "X-Old": "1", "Last-Modified": "Mon"}
    rows = [
        ("a", "response", "http://e.com/", T0, 200, full, "d"),
        ("b", "revisit", "https://www.e.com/#x", T0 + timedelta(days=9), 304, {"etag": '"1"', "cache-control": "new", "Content-Length": "0", "Date": "now"}, None),
        ("c", "revisit", "http://e.com/", T0 + timedelta(days=9), 304, {"ETag": '"2"'}, None),
        ("d", "revisit", "http://e.com/", T0 + timedelta(days=9), 304, {"last-modified": "Mon"}, None),
        ("e", "revisit", "http://e.com/", T0 + timedelta(days=9), 304, None, "other"),
        ("f", "revisit", "http://e.com/", T0, 304, {}, None), ("g", "revisit", None, T0, 304, {}, None), ("h", "revisit", "http://e.com/", None, 304, {}, None),
        ("i", None, None, None, None, None, None), ("b", "revisit", "http://e.com/", T0 + timedelta(days=10), 304, {}, None),
    ]
    got = {(r.record_id, r.at): r for r in resolve_revisits(frame(llm, rows)).collect()}
    state = sorted((k[0], r.resolution) for k, r in got.items())
    assert state == [("b", "resolved"), ("b", "resolved"), ("c", "mismatch"), ("d", "resolved"), ("e", "mismatch"), ("f", "missing"), ("g", "missing"), ("h", "missing")]
    merged = next(r.merged_headers for r in got.values() if r.record_id == "b" and "date" in (r.merged_headers or {}))
    assert merged == {"content-type": "text/html", "etag": '"1"', "content-length": "9", "cache-control": "new", "x-old": "1", "last-modified": "Mon", "date": "now"}
    assert all((r.payload_digest == "d") == (r.resolution == "resolved") for r in got.values())
    assert resolve_revisits(frame(llm, [])).count() == 0


def test_round_trip_of_files(llm, tmp_path):
    body = b"<p>\r\n\r\nWARC/1.0 inside \xff</p>"
    data = write_record("response", "urn:1", "http://e.com/", T0, 200, {"ETag": '"1"', "Content-Type": "text/html"}, body)
    data += write_record("revisit", "urn:2", "http://e.com/", T0 + timedelta(hours=1), 304, {"ETag": '"1"'})
    one, two = read_records(data)
    assert one["body"] == body and one["status"] == 200 and two["kind"] == "revisit" and two["body"] == b""
    (tmp_path / "a.warc.gz").write_bytes(data)
    caps = read_warc(llm, str(tmp_path / "*.warc.gz"))
    assert caps.count() == 2
    got = resolve_revisits(caps.drop("body")).collect()
    assert [(r.record_id, r.resolution, r.response_id) for r in got] == [("urn:2", "resolved", "urn:1")]


def test_records_that_do_not_parse(llm, tmp_path):
    """Each becomes a row with an error; the records after it are read."""
    good = lambda n: gzip.decompress(write_record("response", f"urn:{n}", "http://e.com/", T0, 200, {"ETag": '"1"'}, b"body"))
    no_date = good(2).replace(b"WARC-Date: ", b"X-Date: ")
    bad_date = good(3).replace(b"WARC-Date: 2", b"WARC-Date: x")
    bad_size = good(4).replace(b"Content-Length: ", b"Content-Length: -")
    data = good(1) + no_date + bad_date + bad_size + b"junk\r\nmore junk\r\n" + good(5) + good(6)[:-20]
    got = [(r["record_id"], r["error"], r["at"] is None) for r in read_records(data)]
    assert got == [
        ("urn:1", None, False), ("urn:2", "bad WARC-Date", True), ("urn:3", "bad WARC-Date", True), ("urn:4", "bad Content-Length", False),
        ("urn:5", None, False), ("urn:6", "truncated block", False),
    ]
    assert [r["error"] for r in read_records(b"junk" + good(1))] == ["no record header"]
    assert [r["error"] for r in read_records(good(1)[:30])] == ["truncated header"]
    packed = write_record("response", "urn:7", "http://e.com/", T0, 200, {}, b"x" * 5000)
    assert [(r["record_id"], (r["error"] or "")[:12]) for r in read_records(packed + packed[:60])][0] == ("urn:7", "")
    assert "damaged" in [r["error"] for r in read_records(packed + packed[:60])][-1]
    assert list(read_records(b"")) == []
    (tmp_path / "b.warc").write_bytes(data)
    caps = read_warc(llm, str(tmp_path / "b.warc"))
    assert caps.where("error IS NULL").count() == 2 and resolve_revisits(caps.drop("body")).count() == 0


def test_clashing_columns(llm):
    rows = [("a", "response", "http://e.com/", T0, 200, {"ETag": '"1"'}, "d"), ("b", "revisit", "http://e.com/", T0 + timedelta(days=1), 304, {"ETag": '"1"'}, None)]
    caps = frame(llm, rows).withColumn("resolution", F.lit(3)).withColumn("block", F.lit("x")).withColumn("full", F.lit(1)).withColumn("canonical_url", F.lit("no"))
    assert [(r.record_id, r.resolution, r.response_id) for r in resolve_revisits(caps).collect()] == [("b", "resolved", "a")]
