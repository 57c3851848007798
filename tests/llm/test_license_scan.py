import random
import re
import time

from common_docs import no_docs, odd_docs, odd_rows, prose

from lexloom.llm import license_scan as S
from lexloom.llm.license_rules import RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    w = WORD.findall((text or "").translate(LOW))
    places = [(i, label) for label, phrase in S.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_are_those_of_brute_force():
    rng = random.Random(6)
    bits = ["Under the MIT License", "under the mit", "license", "apache license version 2", "Apache License, Version 2.0", "CC-BY-NC", "cc by nc", "cc by", "nc", "x", "Ämit", "é", "5"]
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice([" ", "-", "\n", "; ", "_", ""]) for _ in range(rng.randrange(12)))
        got = S.scan(text)
        assert got[:5] == brute_base(text), text
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
        assert got[5] == ",".join(sorted(set(filter(None, got[5].split(",")))))
        assert 0 <= got[6] <= 1
    assert S.scan(None) == (0, 0, None, None, "", "", 0.0, [])


def every_regex(line):
    """Detections before suppression, every rule tried everywhere."""
    found = {}
    for label, _, priority, pattern in S.rules():
        for m in pattern.finditer(line):
            k = (m.start(), m.end(), label)
            found[k] = max(priority, found.get(k, 0))
    return found


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)", "This program is free software under the GNU General Public License version 3 or any later version", "GPLv2", "BSD 3-Clause License", "released under the MIT license",
    "Mozilla Public License 2.0", "GNU Lesser General Public License v2.1", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 3.0", "ISC License", "Boost Software License", "zlib license", "the Unlicense", "all rights reserved", "public domain",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
]


def test_keywords_never_hide_a_rule():
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join(rng.choice(TEXTS) for _ in range(3)) + " " + prose(rng, 5)
        line = S.flat(text)[1]
        assert S.detect(line) == S.suppress([(*k, p) for k, p in every_regex(line).items()]), text


def brute_suppress(found):
    kept = []
    for start, end, label, priority in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        inside = any(a <= start and end <= b for a, b, _, _ in kept)
        overlaps = any(a < end and start < b for a, b, _, _ in kept)
        if not inside and not (overlaps and priority <= S.GENERIC):
            kept.append((start, end, label, priority))
    return sorted(kept)


def test_suppression_is_that_of_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        found = {(a := rng.randrange(30), a + rng.randrange(1, 12), rng.choice("abc")): rng.choice([30, 50, 60, 90]) for _ in range(rng.randrange(12))}
        rows = [(*k, p) for k, p in found.items()]
        assert S.suppress(rows) == brute_suppress(rows)


def test_long_texts_take_linear_time():
    began = time.process_time()
    got = S.scan("mit license " * 200_000)
    assert got[5] == "mit" and got[7][0]["first_word"] == 0 and got[7][-1]["last_word"] == got[0] - 1 == 399_999
    long = "under the mit license " * 100_000
    assert S.scan(long, False)[:4] == (400_000, 100_000, 0, 399_996)
    spin = time.process_time()
    sum(range(3_000_000))
    spin = time.process_time() - spin  # 0.06 s on a usual machine
    assert time.process_time() - began < 10 * max(1, spin / 0.06)


def test_hundreds_of_rules_and_what_they_find():
    assert len(S.rules()) >= 200 and len(RULES.strip().splitlines()) == len(S.rules())
    labels = lambda t: S.scan(t)[5].split(",")
    assert labels(TEXTS[0]) == ["apache-2"]
    assert labels(TEXTS[1]) == ["gpl-3-or-later"]
    assert labels(TEXTS[6]) == ["lgpl-2.1"]
    assert labels(TEXTS[4]) == ["mit"]
    assert S.scan("a story about an apache helicopter, a bus and a permit")[5] == ""


def test_odd_rows(spark):
    rows = S.license_scan(odd_docs(spark)).collect()
    assert sorted(str((r["doc_id"], *(r[f] for f in S.FIELDS))) for r in rows) == sorted(str((r[0], *S.scan(r[1])[:7])) for r in odd_rows())
    assert S.license_scan(no_docs(spark)).count() == 0
