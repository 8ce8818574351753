"""Line dedup: the perfect hash, and the whole operator against brute force."""

from __future__ import annotations

import pickle
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from jobmix.llm.line_dedup import (LineTable, build_shards, dedup_lines, distinct_lines, document_lines, hashes,
                                   hot_shards, line_keys, probe)


def brute(rows, min_chars=20, min_docs=3):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, text)."""
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")
        return k if len(k) >= min_chars else None
    found, holder = {}, {}
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            found[k] = found.get(k, 0) + 1
            if doc_id is not None:
                holder[k] = max(holder.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [doc_id is not None and (k := key(x)) is not None and found[k] >= min_docs and doc_id < holder[k]
                for x in lines]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash(n):
    keys = hashes([f"line {i}".encode() for i in range(n)])
    table = LineTable(keys, np.arange(n), np.arange(n) + 7)
    slots = table._slots(keys) if n else np.empty(0, int)
    assert sorted(slots) == list(range(n))  # minimal and perfect
    assert [x.tolist() for x in table.lookup(keys)] == [list(range(n)), list(range(7, n + 7))]
    other = hashes([f"other {i}".encode() for i in range(2000)])
    assert not table.lookup(other)[0].any()


def test_perfect_hash_of_keys_that_never_part():
    keys = np.array([[1, 2], [2, 1], [7, 4], [5, 6], [9, 9]])  # the first four mix to 3
    table = LineTable(keys, np.arange(5) + 1, np.arange(5) + 10)
    assert sorted(table._slots(keys)) == list(range(5)) and len(table.rest) == 4
    assert table.lookup(keys)[1].tolist() == [10, 11, 12, 13, 14]
    assert table.lookup(np.array([[0, 3], [4, 7]]))[0].tolist() == [0, 0]


def test_keys_are_cut_lowered_and_measured_in_code_points():
    assert line_keys(" \tABCÉ" + "é" * 17 + "\x0b\r\nshort\n", 20) == [("abcÉ" + "é" * 17).encode(), None, None]
    assert line_keys("é" * 19, 20) == [None] and line_keys(None, 20) == [None]


@pytest.mark.parametrize("shard_keys", [20_000, 3, 1])
def test_equal_to_brute_force(spark, shard_keys):
    rng = random.Random(shard_keys)
    pool = [f"a rather long common line number {i}" for i in range(12)] + ["short", "", "  ", "É" * 20]
    rows = [(i, "\n".join(rng.choice([str.upper, str, lambda x: f" {x}\t"])(rng.choice(pool))
                          for _ in range(rng.randint(0, 9)))) for i in range(60)]
    # A line that every document holds, twice in some; a very long text.
    rows = [(i, t + "\nthis very line is in each and every document" * (1 + i % 2)) for i, t in rows]
    rows += [(500, None), (501, ""), (None, pool[0]), (None, pool[0] + "\n" + pool[1]), (7, rows[7][1]),
             (502, "\n".join(pool * 2000))]
    df = spark.createDataFrame([(a, b, 5, "z") for a, b in rows], "doc_id long, text string, n_lines int, _cut string")
    df = df.withColumns({"_Gone": F.lit(1), "_gone_id": F.lit(2)})
    out = dedup_lines(df, shard_keys=shard_keys)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert out.columns == ["doc_id", "_cut", "_Gone", "_gone_id", "text", "n_lines", "n_dropped"]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_distinct_line_is_indexed_and_hot_shards_get_copies(spark):
    texts = [f"the line number {i} stands here alone\nthe very same line in each document" for i in range(400)]
    lines = document_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20)
    distinct = distinct_lines(lines).cache()
    assert distinct.count() == 401 and distinct.agg(F.max("n_docs")).first()[0] == 400
    hot = hot_shards(distinct, 20, 60)
    assert [r.copies for r in hot.collect()] == [7]  # 400 and some twenty lines, 60 to a copy
    tables = [pickle.loads(r.arrays) for r in build_shards(distinct, 20).collect()]
    assert sum(len(t.count) for t in tables) == 401 and max(t.count.max() for t in tables) == 400
    gone = probe(lines, build_shards(distinct, 20), 20, hot, 3)
    assert sorted(r.doc_id for r in gone.collect()) == list(range(399))
