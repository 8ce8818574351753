"""License scans: the expression parser, and the scan against a brute-force one."""

from __future__ import annotations

import random
import re

import pytest

from jobmix.llm.licenses import BASE_PHRASES, Scanner, evaluate, scan_licenses, to_postfix


@pytest.mark.parametrize("text, postfix", [
    ("mit", ["mit"]),
    ("mit or apache-2.0", ["mit", "apache-2.0", "or"]),
    ("a or b and c", ["a", "b", "c", "and", "or"]),
    ("(a or b) and c", ["a", "b", "or", "c", "and"]),
    ("gpl-2.0 with classpath-exception-2.0 and mit", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "and"]),
    ("mit this file is", ["mit"]), ("a and", ["a"]), ("(a or b", ["a", "b", "or"]), ("a) or b", ["a"]),
    ("", []), ("and b", []), ("*/", []),
])
def test_shunting_yard(text, postfix):
    assert to_postfix(text) == postfix


@pytest.mark.parametrize("text, labels, strictness", [
    ("mit", {"mit"}, 0), ("mit or gpl-3.0-only", {"mit", "gpl"}, 0), ("mit and gpl-3.0-only", {"mit", "gpl"}, 2),
    ("gpl-2.0 with classpath-exception-2.0", {"gpl"}, 1), ("lgpl-2.1+", {"lgpl"}, 1),
    ("some-own-terms", set(), 3), ("(mit or gpl-2.0) and mpl-2.0", {"mit", "gpl", "mpl"}, 1),
])
def test_evaluation(text, labels, strictness):
    assert evaluate(to_postfix(text)) == (labels, strictness)


def test_unreadable_expressions_count_for_nothing():
    assert evaluate([]) is None and evaluate(["or"]) is None and evaluate(["a", "b"]) is None


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = sorted((i, label) for phrase, label in BASE_PHRASES.items() for p in [phrase.split()]
                    for i in range(len(words)) if words[i:i + len(p)] == p)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_base_columns_equal_brute_force():
    rng = random.Random(3)
    pool = ["mit", "MIT", "license", "License,", "apache", "general", "public", "the", "é", "É", "\n", "x", "\x00", "2.0"]
    scanner = Scanner()
    for n in range(3000):
        text = rng.choice([" ", "-", "  "]).join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert scanner.scan(text)[:5] == brute(text), text
    text = "General Public License MIT license mit-license"
    assert scanner.scan(text)[:5] == brute(text) == (7, 3, 0, 5, "gpl,mit")


def test_labels_and_score():
    scanner = Scanner()
    tagged = scanner.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND MPL-2.0 */\ncode")
    assert tagged[4] == "" and tagged[5] == "apache,mit,mpl" and tagged[7:] == (1, 1) and tagged[6] == pytest.approx(0.9)
    assert scanner.scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc"
    many = scanner.scan("mit license " * 5000)
    assert many[1] == 5000 and 0.99 < many[6] <= 1.0


def test_scan_on_odd_rows(spark):
    data = [(1, None, 9), (2, "", 9), (3, "MIT License", 9), (3, "MIT License", 9), (None, "x" * 200_000, 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_words long")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in scan_licenses(df).collect()}
    score = 1 - 0.4
    assert got == {(1, 0, 0, None, "", 0.0), (2, 0, 0, None, "", 0.0), (3, 2, 1, 0, "mit", score), (None, 1, 0, None, "", 0.0)}
    assert scan_licenses(df).count() == 5 and scan_licenses(df.limit(0)).collect() == []
