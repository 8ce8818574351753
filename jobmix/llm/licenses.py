"""License scans: phrases and identifier tags by automaton, expressions by shunting-yard.

An Aho-Corasick automaton runs over the text's normalised words and finds
license names, phrases of license notices, and the words of the SPDX tag.
Where a tag occurs, the expression after it is read with Dijkstra's
shunting-yard algorithm (WITH binds tighter than AND, AND tighter than OR) and
evaluated: labels of all its licenses, and how strict the whole is (AND: the
strictest side, OR: the mildest, WITH: an exception makes copyleft milder).

Results for odd input: a null or empty text has no words, no labels and score
0; a malformed expression counts as far as it can be read; overlapping
places all count; repeated rows are scanned each; a null ``doc_id`` stays
null; other columns of the input are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from jobmix.llm.common import ASCII_LOWER, arrow_schema, map_rows, table

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Phrases of license notices and names, as normalised words.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "released under the mit": "mit",
    "licensed under the apache": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "gnu general public": "gpl",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "released into the public domain": "public-domain",
    "cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# The words of the tag and, in raw lower-cased text, the tag itself.
TAG_WORDS = "spdx license identifier"
TAGS = ("spdx-license-identifier:", "spdx-license-identifier =", "spdx-license-identifier=")

# License identifiers by their beginning, with a label and a strictness:
# 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 unknown or restricted.
FAMILIES = (
    ("agpl", "agpl", 2), ("lgpl", "lgpl", 1), ("gpl", "gpl", 2), ("mit", "mit", 0), ("apache", "apache", 0),
    ("bsd", "bsd", 0), ("0bsd", "bsd", 0), ("isc", "isc", 0), ("mpl", "mpl", 1), ("epl", "epl", 1),
    ("bsl", "bsl", 0), ("unlicense", "public-domain", 0), ("cc0", "cc0", 0), ("cc-by-nc", "cc-by-nc", 3),
    ("cc-by-sa", "cc-by-sa", 1), ("cc-by-nd", "cc-by-nd", 3), ("cc-by", "cc-by", 0),
)
UNKNOWN = 3
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:\-]*)")

# How much one kind of evidence says that the text states a license.
WEIGHTS = {"tag": 0.9, "base": 0.6, "notice": 0.5}

# Upper case A-Z to lower case; all other ASCII but digits and letters to blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))

SCHEMA = arrow_schema({
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
    "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "n_tags": pa.int64(), "strictness": pa.int64()})


def to_postfix(text: str) -> list[str]:
    """The license expression at the start of ``text`` in postfix order.

    Reads as far as operands and operators alternate properly; what follows
    (the end of a comment, prose) is not part of it.  A dangling operator and
    unbalanced brackets are dropped.
    """
    out, waiting, at, operand_next = [], [], 0, True
    while (m := TOKEN.match(text, at)) is not None:
        token = m[1]
        if operand_next:
            if token == "(":
                waiting.append(token)
            elif token == ")" or token in PRECEDENCE:
                break
            else:
                out.append(token)
                operand_next = False
        elif token == ")":
            if "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif token in PRECEDENCE:
            while waiting and PRECEDENCE.get(waiting[-1], 0) >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            break
        at = m.end()
    if operand_next and waiting and waiting[-1] in PRECEDENCE:
        waiting.pop()
    while waiting:
        if (top := waiting.pop()) != "(":
            out.append(top)
    return out


def family(identifier: str) -> tuple[frozenset[str], int]:
    """Label and strictness of one license identifier."""
    for start, label, strictness in FAMILIES:
        if identifier == start or identifier.startswith((start + "-", start + "+")):
            return frozenset([label]), strictness
    return frozenset(), UNKNOWN


def evaluate(postfix: list[str]) -> tuple[frozenset[str], int] | None:
    """Labels and strictness of a postfix expression; None if it is empty or cannot be evaluated."""
    stack: list = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((*family(token), token))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if token == "with":
            strictness = left[1] - 1 if left[1] in (1, 2) else left[1]
            stack.append((left[0], strictness, ""))
        else:
            pick = max if token == "and" else min
            stack.append((left[0] | right[0], pick(left[1], right[1]), ""))
    return stack[0][:2] if len(stack) == 1 else None


class Scanner:
    """The automata; built once per task."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None):
        phrases: dict[str, list[tuple[str, str, int]]] = {}
        for kind, found in (("base", BASE_PHRASES if base is None else base),
                            ("notice", NOTICE_PHRASES if notices is None else notices),
                            ("tag", {TAG_WORDS: ""})):
            for phrase, label in found.items():
                phrases.setdefault(f" {phrase} ", []).append((kind, label, phrase.count(" ") + 1))
        self.words = ahocorasick.Automaton()
        for phrase, what in phrases.items():
            self.words.add_word(phrase, what)
        self.words.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def expressions(self, lowered: str) -> list[tuple[frozenset[str], int]]:
        """The evaluated expressions after the tags of a lower-cased text."""
        found = []
        for end, _ in self.tags.iter(lowered):
            stop = lowered.find("\n", end)
            value = evaluate(to_postfix(lowered[end + 1:stop if stop >= 0 else len(lowered)]))
            if value is not None:
                found.append(value)
        return found

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.translate(_WORD_BYTES).split()
        # One character a byte: positions and blanks are all that is needed.
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        n_base = last = seen = at = 0
        first = None
        base, labels, kinds, tagged = set(), set(), {"base": 0, "notice": 0, "tag": 0}, False
        for end, what in self.words.iter(line):
            for kind, label, size in what:
                if kind == "tag":
                    tagged = True
                    continue
                labels.add(label)
                kinds[kind] += 1
                if kind == "base":
                    seen += line.count(" ", at, end)
                    at = end
                    start = seen - size
                    first = start if first is None else min(first, start)
                    last = max(last, start)
                    n_base += 1
                    base.add(label)
        strictness = None
        if tagged:
            values = self.expressions(raw.translate(ASCII_LOWER).decode())
            kinds["tag"] = len(values)
            for found, s in values:
                labels |= found
                strictness = s if strictness is None else max(strictness, s)
        doubt = 1.0
        for kind, n in kinds.items():
            if n:
                doubt *= (1.0 - WEIGHTS[kind]) ** min(n, 8)
        return (len(words), n_base, first, last if n_base else None, ",".join(sorted(base)),
                ",".join(sorted(labels)), 1.0 - doubt, kinds["tag"], strictness)


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None,
                  notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, labels, score, tags, strictness.

    Map-only; the automata are small and built in each task.  ``score`` is
    1 minus the product of (1 - weight) over the evidence found.
    """
    def make():
        scanner = Scanner(base, notices)
        return lambda doc_id, text: (doc_id, *scanner.scan(text))
    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), make, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
