"""Licence scan: ordered signature rules with keyword gates and suppression.

Each text becomes words with one space between them.  A rule runs only where its
keyword occurs; what it finds is an interval of words.  Detections are taken by
falling priority, then longer first, then earlier; one that lies inside an
interval already taken is suppressed, so "gnu general public license version 3"
reports gpl-3.0 and not also a bare mention.  The base phrases are searched apart
and always count.

Runs over Arrow batches, one row at a time; memory is one batch and one text.
Defined results: null or empty text has no words, empty label strings, null
places and score 0; repeated rows give equal rows; other columns pass through,
except those named like a result, which the result replaces.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkassay.llm.license_rules import BASE, RULES

RESULTS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Bytes to the normal form: words are 0-9, a-z and all bytes from 0x80; A-Z is lower-cased.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _word_no(normal: bytes, places: list[int]) -> list[int]:
    """How many words stand before each place."""
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    return np.searchsorted(spaces, np.array(places, np.int64)).tolist()


def base_places(normal: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase; ``normal`` has a space at both ends."""
    places, labels = [], []
    for phrase, label in BASE:
        wanted = b" " + phrase + b" "
        at = normal.find(wanted)
        while at >= 0:
            places.append(at)
            labels.append(label)
            at = normal.find(wanted, at + 1)
    return list(zip(_word_no(normal, places), labels, strict=True)) if places else []


class Cover:
    """The widest intervals taken so far, none inside another: sorted by start and so by end."""

    def __init__(self):
        self.lo: list[int] = []
        self.hi: list[int] = []

    def holds(self, lo: int, hi: int) -> bool:
        i = bisect_right(self.lo, lo) - 1
        return i >= 0 and self.hi[i] >= hi

    def add(self, lo: int, hi: int) -> None:
        a, b = bisect_left(self.lo, lo), bisect_right(self.hi, hi)
        self.lo[a : max(a, b)] = [lo]
        self.hi[a : max(a, b)] = [hi]


def detect(normal: bytes) -> list[tuple[int, int, int, str, float]]:
    """Kept detections: (first word, end word, priority, label, confidence)."""
    gates: dict[bytes, bool] = {}
    found = []
    for rule in RULES:
        if rule.keyword not in gates:
            gates[rule.keyword] = rule.keyword in normal
        if gates[rule.keyword]:
            for m in rule.pattern.finditer(normal):
                found.append((rule.priority, m.end() - m.start(), m.start(), m.end(), rule))
    found.sort(key=lambda x: (-x[0], -x[1], x[2], x[4].label))
    cover, taken = Cover(), []
    for priority, _, lo, hi, rule in found:
        if not cover.holds(lo, hi):
            cover.add(lo, hi)
            taken.append((lo, hi, priority, rule))
    if not taken:
        return []
    first = _word_no(normal, [lo for lo, *_ in taken])
    last = _word_no(normal, [hi for _, hi, *_ in taken])
    return [(a - 1, b, t[2], t[3].label, t[3].confidence) for a, b, t in zip(first, last, taken, strict=True)]


def scan(text: str | None) -> tuple:
    """The result columns for one text, in the order of RESULTS."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
    normal = b" " + b" ".join(words) + b" "
    base = base_places(normal)
    kept = detect(normal)
    base_labels = {label for _, label in base}
    labels = base_labels | {d[3] for d in kept}
    best: dict[str, float] = dict.fromkeys(base_labels, 0.9)
    for d in kept:
        best[d[3]] = max(best.get(d[3], 0.0), d[4])
    miss = 1.0
    for label in sorted(best):
        miss *= 1.0 - best[label]
    at = [place for place, _ in base]
    return (
        len(words), len(base), min(at, default=None), max(at, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - miss,
    )


def scan_licenses(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Input columns (without the text unless ``keep_text``) and the result columns."""
    names = [part.split()[0] for part in RESULTS.split(", ")]
    carried = [c for c in docs.columns if c.lower() not in names and (keep_text or c != text_col)]
    chosen = docs.select(*carried, docs[text_col].alias("__ls_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]), RESULTS])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            new = [pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *names])

    return chosen.mapInArrow(run, schema)
