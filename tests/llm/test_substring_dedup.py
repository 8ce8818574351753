from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import jobmix.llm.substring_dedup as sd
from jobmix.llm.substring_dedup import dedup_substrings, op12_substring_dedup

ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def expected(rows) -> list[tuple]:
    words = [(r[1] or "").encode().split() for r in rows]
    places = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if places[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def same(spark, rows, parts=3, **kw) -> list[tuple]:
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], ROW).repartition(parts).checkpoint()
    got = ordered(dedup_substrings(df, **kw).collect())
    assert got == ordered(expected(rows))
    return got


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = ordered(op12_substring_dedup(spark, SF_SMALL).collect())
    assert got == ordered(expected(rows)) and sum(r[2] > 0 for r in got) > 5


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_small_batches_and_parts(spark, monkeypatch, broadcast_bytes):
    """Passages of every length and phase, near and across batches, beside texts of few different words."""
    monkeypatch.setattr(sd, "BATCH_WORDS", 300)
    monkeypatch.setattr(sd, "PART_WORDS", 2000)
    rng = random.Random(broadcast_bytes)
    shared = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = [f"w{i}x{j}" for j in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            lo = rng.randrange(80)
            at = rng.randrange(len(own) + 1)
            own[at:at] = shared[lo:lo + rng.choice([18, 30, 34, 35, 36, 50, 90])]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(own)))
    rows += [(500 + i, " ".join(rng.choice("ab") for _ in range(200))) for i in range(4)]
    rows += [(600 + i, "z " * n) for i, n in enumerate([34, 35, 36, 80])]
    got = same(spark, rows, 5, broadcast_bytes=broadcast_bytes)
    assert sum(r[2] > 0 for r in got) > 30 and any(0 < r[2] < r[1] for r in got)


def test_edges_of_a_window(spark):
    own = [f"a{i}" for i in range(35)]
    # Thirty-four equal words are no repeat, thirty-five are; case and other blanks count.
    same(spark, [(1, " ".join(own[:34]) + " x"), (2, "y " + " ".join(own[:34]))])
    got = same(spark, [(1, " ".join(own) + " x"), (2, "y  " + "\r\n".join(own)), (3, " ".join(own).upper())])
    assert [r[2] for r in got] == [35, 35, 0]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 7000}" for i in range(20_000))
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, None), (None, text), (1, text), (1, text), (1, ""), (2, " \n\t"), (3, "é " * 50), (4, None),
            (None, text), (5, long), (6, "w " + text + " é")]
    same(spark, rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], ROW).checkpoint()
    for name in ("text_id", "spans", "part", "batch", "_id", "hash", "n_words", "kept"):
        df = df.selectExpr("*", f"'1' AS {name}")
    assert ordered(dedup_substrings(df).collect()) == ordered(expected(rows))


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_WORDS", 1000)
    text = " ".join(f"t{i}" for i in range(50))
    same(spark, [(i % 300, text if i % 3 else f"{text} {i}") for i in range(900)], 4)


def test_empty(spark):
    got = dedup_substrings(spark.createDataFrame([], ROW))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400_000), min_size=1, max_size=40, unique=True).map(sorted))
def test_gaps(places):
    assert sd.ungapped(sd.gaps(np.array(places, np.int64))).tolist() == places


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80), st.integers(1, 40))
def test_rolling_hashes_tell_windows_apart(words, width):
    hashes = sd.rolling(np.array(words, np.uint64), width)
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    assert len(hashes) == len(windows)
    assert len(set(zip(windows, hashes.tolist()))) == len(set(windows)) == len(set(hashes.tolist()))


def test_a_window_holds_a_block():
    assert 2 * sd.BLOCK - 1 <= sd.WINDOW
