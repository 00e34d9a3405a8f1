"""WARC captures and the resolution of not-modified revisits.

A crawler that gets "304 Not Modified" stores a revisit record: headers and no
body.  To use it, the body has to come from the latest earlier full response
(status 200) for the same canonical URL, provided that the validators agree; the
304's permitted headers then replace the stored ones.

The as-of join is two windows.  Time is cut into blocks, so that a URL with a
third of all captures is many small groups: within (URL, block) a window finds the
latest earlier response; across blocks only one row for each (URL, block) goes
through a second window, and revisits with no response in their own block take
what that one carries.  Bodies never move: records hold a digest.

Defined results for a revisit: ``resolved``; ``mismatch`` if the latest earlier
response has other validators (then no body is given); ``missing`` if there is
none, or the URL or time is null.  A response at the very same time is not
earlier.  Of responses at one time the largest id counts as the latest.  Weak and
strong ETags compare by their value; without an ETag on both sides Last-Modified
decides, then the payload digest; with none of them the revisit is taken as valid.
Header names are compared in lower case and the last of a repeated name counts.
Repeated records resolve alike; empty tables give no rows; other columns of
revisits are dropped.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

URL_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:[Ww][Ww][Ww]\.)?([^/?#:]*)(?::(?:80|443)?(?=[/?#]|$))?(:[0-9]+)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query parameters that name a visit and not a page.
VISIT_PARAMS = r"^(utm_[a-z]+|jsessionid|phpsessid|sessionid|sid|gclid|fbclid)(=.*)?$"
#: Fields that a 304 may not change (length and coding of the stored body, the connection).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)

#: Bodies are sent on in batches of about so many bytes.
SENT_BYTES = 16 << 20
EMPTY_RECORD = {"record_id": None, "kind": None, "url": None, "at": None, "status": None, "headers": {}, "body": None, "error": None}
CAPTURES = "record_id string, kind string, url string, at timestamp, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without a last slash, sorted query, no scheme or fragment."""
    part = lambda i: F.regexp_extract(url, URL_PARTS, i)
    params = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(VISIT_PARAMS))
    query = F.array_join(F.array_sort(params), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    whole = F.concat(F.lower(part(1)), part(2), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(1) != "", whole)


def lower_headers(headers: Column) -> Column:
    """Names in lower case; of a repeated name the last value."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.aggregate(
        F.map_entries(headers), empty,
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def merge_headers(stored: Column, revisit: Column) -> Column:
    """The stored response's headers, updated by what a 304 may update."""
    allowed = F.map_filter(revisit, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(captures: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """One row a revisit: ids, canonical URL, resolution, digest of the body and merged headers."""
    c = captures.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "at", "status",
        lower_headers(F.coalesce("headers", F.from_json(F.lit("{}"), "map<string,string>"))).alias("headers"), "digest",
    )
    usable = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    is_full = (F.col("kind") == "response") & (F.col("status") == 200)
    is_revisit = F.col("kind") == "revisit"
    c = c.where(is_revisit | (is_full & usable)).withColumn(
        "full", F.when(is_full, F.struct(F.col("record_id").alias("id"), F.col("at"), "digest", "headers"))
    ).withColumn("block", F.floor(F.unix_seconds("at") / block_seconds))
    held = c.where(usable)
    order = [F.col("at"), is_full.cast("int"), F.col("record_id")]  # at one time revisits come first
    inside = W.Window.partitionBy("canonical_url", "block").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    seen = held.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where(is_revisit)
    blocks = held.groupBy("canonical_url", "block").agg(F.max_by("full", F.when(is_full, F.struct("at", "record_id"))).alias("latest"))
    across = W.Window.partitionBy("canonical_url").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carry", F.last("latest", ignorenulls=True).over(across)).select("canonical_url", "block", "carry")
    found = seen.join(carried, ["canonical_url", "block"], "left").withColumn("found", F.coalesce("near", "carry")).drop("near", "carry")
    lost = c.where(is_revisit & ~usable).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    out = found.unionByName(lost)
    value = lambda m, k: F.try_element_at(m, F.lit(k))
    etag = lambda m: F.regexp_replace(value(m, "etag"), r"^\s*[Ww]/", "")
    mine, theirs = F.col("headers"), F.col("found.headers")
    valid = F.coalesce(
        etag(mine) == etag(theirs), value(mine, "last-modified") == value(theirs, "last-modified"), F.col("digest") == F.col("found.digest"), F.lit(True)
    )
    state = F.when(F.col("found").isNull(), "missing").when(valid, "resolved").otherwise("mismatch")
    good = F.col("resolution") == "resolved"
    return out.withColumn("resolution", state).select(
        "record_id", "canonical_url", "at", "resolution", F.col("found.id").alias("response_id"), F.col("found.at").alias("response_at"),
        F.when(good, F.col("found.digest")).alias("payload_digest"), F.when(good, merge_headers(theirs, mine)).alias("merged_headers"),
    )


def header_text(headers: Column) -> Column:
    """``name: value`` lines in name order, joined by '; '."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


# ---- the file format ----


def write_record(kind: str, record_id: str, url: str, at: datetime, status: int, headers: dict[str, str], body: bytes = b"") -> bytes:
    """One WARC 1.1 record as a gzip member; a revisit uses the server-not-modified profile."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "Status")
    http = f"HTTP/1.1 {status} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + body
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {url}",
        f"WARC-Date: {at.astimezone(timezone.utc):%Y-%m-%dT%H:%M:%SZ}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return lines[0], fields


class _Members(io.RawIOBase):
    """The inflated bytes of gzip members, one after the other; damage is told only when it is reached."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member = memoryview(data), 0, None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.member is not None or self.at < len(self.data):
            if self.member is None:
                self.member = zlib.decompressobj(31)
            piece = self.member.unconsumed_tail
            if not piece:
                piece = self.data[self.at : self.at + 65536]
                self.at += len(piece)
            out = self.member.decompress(piece, len(into))
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = None
            elif not out and not piece:
                raise EOFError("it ends inside a gzip member")
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def _lines_of_head(stream: BinaryIO) -> bytes | None:
    """Header lines up to the empty one; None if the stream ends before it."""
    lines = []
    while line := stream.readline():
        if line.strip() == b"":
            return b"\r\n".join(lines)
        lines.append(line.rstrip(b"\r\n"))
    return None


def _when(text: str | None) -> datetime | None:
    try:
        return datetime.strptime((text or "")[:19], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None


def read_records(data: bytes) -> Iterator[dict]:
    """Response and revisit records of a WARC file, gzipped by record or plain, inflated one at a time.

    What cannot be read becomes a row with an ``error``; reading goes on at the next
    line that begins a record.
    """
    stream: BinaryIO = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(_Members(data))
    try:
        yield from _read_stream(stream)
    except (OSError, EOFError, zlib.error) as e:
        yield EMPTY_RECORD | {"error": f"damaged file: {e}"}


def _read_stream(stream: BinaryIO) -> Iterator[dict]:
    lost = False
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip() and not lost:
                lost = True
                yield EMPTY_RECORD | {"error": "no record header"}
            continue
        head = _lines_of_head(stream)
        if head is None:
            yield EMPTY_RECORD | {"error": "truncated header"}
            return
        _, fields = _fields(line.rstrip() + b"\r\n" + head)
        kind = fields.get("warc-type")
        record = EMPTY_RECORD | {"record_id": fields.get("warc-record-id", "").strip("<>"), "kind": kind, "url": fields.get("warc-target-uri"), "at": _when(fields.get("warc-date"))}
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            lost = True  # said here; what follows is passed over up to the next record
            yield record | {"error": "bad Content-Length"}
            continue
        block = stream.read(int(size))
        lost = False
        if len(block) < int(size):
            yield record | {"error": "truncated block"}
            return
        if kind not in ("response", "revisit"):
            continue
        http, _, body = block.partition(b"\r\n\r\n")
        first, headers = _fields(http)
        words = first.split()
        status = int(words[1]) if len(words) > 1 and words[1].isascii() and words[1].isdigit() else None
        error = None if record["at"] else "bad WARC-Date"
        yield record | {"status": status, "headers": headers, "body": body, "error": error}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures with their ``body`` and ``error`` from WARC files; a file is read by one task.

    ``resolve_revisits`` takes the rows as they are: one without a time is never a
    match, one without a kind is passed over.
    """
    schema = CAPTURES.replace(", digest string", "") + ", body binary, error string"

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([
            ("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("at", pa.timestamp("us", "UTC")),
            ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string()),
        ])
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for r in read_records(data.as_py()):
                    rows.append(r | {"headers": list(r["headers"].items())})
                    held += len(r["body"] or b"")
                    if held > SENT_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)
    return found.withColumn("digest", F.sha2("body", 256))
