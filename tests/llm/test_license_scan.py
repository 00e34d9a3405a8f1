import re

from pyspark.sql import functions as F

from sparkassay.llm.license_rules import RULES
from sparkassay.llm.license_scan import Cover, detect, scan, scan_licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "MIT License, mit-license; the MIT\nLICENSE!", "Licensed under CC BY-NC 4.0.", "Ämit license 你好 cc by",
    "This work is licensed under the GNU General Public License, version 3.", "Apache License 2.0 " * 3000, "cc  by\tcc-by,cc/by permit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def test_base_phrases_against_brute_force():
    for t in TEXTS:
        assert scan(t)[:5] == brute(t)
        assert set(filter(None, scan(t)[4].split(","))) <= set(scan(t)[5].split(","))
        assert 0 <= scan(t)[6] <= 1


def test_priority_and_containment():
    assert {d[3] for d in detect(b" under the gnu general public license version 3 or later version ")} >= {"gpl-3.0"}
    assert "gpl" not in {d[3] for d in detect(b" the gnu general public license version 3 ")}
    assert scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc-4.0"
    assert scan("no licence talk here, permitted limits")[5] == ""
    assert len(RULES) >= 200 and [r.priority for r in RULES] == sorted((r.priority for r in RULES), reverse=True)


def plain_detect(normal):
    """Every rule on every text, no gates; one by one, none inside one taken before."""
    found = [(-r.priority, m.start() - m.end(), m.start(), r.label, m.end()) for r in RULES for m in r.pattern.finditer(normal)]
    taken = []
    for _, _, lo, label, hi in sorted(found):
        if not any(a <= lo and hi <= b for a, b, _ in taken):
            taken.append((lo, hi, label))
    return sorted((normal[:lo].count(b" ") - 1, normal[:hi].count(b" "), label) for lo, hi, label in taken)


def test_detections_against_every_rule_without_gates():
    import random

    rng = random.Random(12)
    parts = [b"gnu", b"general public license", b"version 3", b"or later", b"cc by", b"nc sa 4 0", b"mit license", b"the", b"apache license version 2 0", b"bsd 3 clause",
             b"permission to use copy modify", b"and distribute this software and its documentation for any purpose", b"all rights reserved", b"mozilla public license v 2 0",
             b"this source code form is subject to the terms of the", b"eupl 1 2", b"word", b"this is free and unencumbered software released into the public domain"]
    for _ in range(300):
        normal = b" " + b" ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) + b" "
        got = sorted((a, b, label) for a, b, _, label, _ in detect(normal))
        assert got == plain_detect(normal)


def test_every_rule_finds_what_it_is_written_for():
    """A text made from each rule's own words holds its keyword, so no gate shuts out its own rule."""
    for rule in RULES:
        pattern = rule.pattern.pattern.decode()[len("(?<= )(?:") : -len(")(?= )")]
        assert rule.keyword.decode() in re.sub(r"\(\?:|\)|\?", "", pattern) or rule.keyword.decode().split()[0] in pattern, rule


NOTICES = {
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2.0",
    "SPDX: GPL-2.0-or-later WITH Classpath-exception-2.0": "gpl-2.0-or-later,gpl-with-classpath",
    "Redistributions of source code must retain the above copyright notice": "bsd",
    "Community Data License Agreement - Permissive - Version 2.0": "cdla-permissive",
    "The Universal Permissive License (UPL), Version 1.0": "",
    "released under the terms of the MIT license": "mit",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
    "Blue Oak Model License 1.0.0": "blueoak-1.0.0",
}


def test_notices():
    for text, want in NOTICES.items():
        labels = set(filter(None, scan(text)[5].split(",")))
        assert set(filter(None, want.split(","))) <= labels, (text, labels)


def test_cover_against_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(200):
        cover, kept = Cover(), []
        for _ in range(30):
            lo = rng.randint(0, 40)
            hi = lo + rng.randint(1, 12)
            assert cover.holds(lo, hi) == any(a <= lo and hi <= b for a, b in kept)
            if not cover.holds(lo, hi):
                cover.add(lo, hi)
                kept.append((lo, hi))


def test_table(llm, odd_docs, no_docs):
    out = scan_licenses(odd_docs.withColumn("labels", F.lit(5)))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and dict(out.dtypes)["labels"] == "string" and "text" not in out.columns
    seven = next(r for r in rows if r.doc_id == 7)
    assert (seven.n_base, seven.base_labels) == (1, "mit")
    assert [(r.n_words, r.first_word, r.labels, r.score) for r in rows if r.doc_id == 3] == [(0, None, "", 0.0)]
    assert scan_licenses(no_docs).count() == 0
