"""Spaced seeds: leaked items are found through substitutions, clean texts are left alone."""

from __future__ import annotations

import random

import pytest

from corpus_pipeline import drop_contaminated
from jobmix.llm import decontamination
from jobmix.llm.decontamination import MASKS, MIN_IN_STRETCH, MIN_SHARE, STRETCH, WHOLE_BELOW, contaminated

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


ITEMS = [(i, prose(n)) for i, n in enumerate((8, 14, 20, 37, 59, 90))] + [(90, prose(5)), (91, None), (92, [])]


def changed(words, every):
    return [f"new{i}" if every and i % every == every - 1 else w for i, w in enumerate(words)]


def documents():
    docs = []
    for item_id, words in ITEMS[:6]:
        for k, every in enumerate((0, 9, 7)):
            docs.append((100 * k + item_id, prose(30) + changed(words, every) + prose(30)))
    docs.append((300, ITEMS[3][1]))  # nothing but the item
    docs.append((301, ITEMS[4][1][5:]))  # its beginning cut off
    docs.append((302, prose(5000) + ITEMS[2][1] + prose(5000) + ITEMS[1][1]))
    docs += [(400 + i, prose(200)) for i in range(30)]
    docs.append((500, prose(20) + ITEMS[4][1][10:17] + prose(20)))  # seven shared words are no leak
    return docs


def brute(docs, items):
    """Every shift of every item along every document, with the same thresholds."""
    found = {}
    for doc_id, d in docs:
        for item_id, words in items:
            if not words or len(words) < min(map(len, MASKS)):
                continue
            for shift in range(-len(words), len(d)):
                flags = [0 <= shift + j < len(d) and d[shift + j] == w for j, w in enumerate(words)]
                best = max(sum(flags[j:j + STRETCH]) for j in range(max(1, len(flags) - STRETCH + 1)))
                if sum(flags) >= (MIN_SHARE if len(words) >= WHOLE_BELOW else 1) * len(words) or best >= MIN_IN_STRETCH:
                    key = (doc_id, item_id)
                    found[key] = max(found.get(key, 0), sum(flags))
    return found


@pytest.mark.parametrize("broadcast_words", [200_000, 0])
def test_equal_to_brute_force(spark, broadcast_words):
    docs = documents()
    text = lambda words: None if words is None else " ".join(words).upper().replace(" ", ", ")
    df = spark.createDataFrame([(d, text(w), 0) for d, w in docs] + [(None, text(ITEMS[3][1]), 0), (600, None, 0),
                                (601, "", 0), (300, text(ITEMS[3][1]), 0)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(i, text(w), 1) for i, w in ITEMS] + [(None, text(ITEMS[2][1]), 1)],
                                  "item_id long, text string, t long")
    out = contaminated(df, items, broadcast_words).collect()
    want = brute([d for d in docs if len(d[1]) < 1000], ITEMS)
    got = {(r.doc_id, r.item_id): r.n_agree for r in out if r.doc_id != 302}
    # A changed copy of the shortest item may keep no seed: it is about as long as a mask.
    assert got == {k: n for k, n in want.items() if k in got or k[1] != 0} and (0, 0) in got
    assert {(r.doc_id, r.item_id) for r in out if r.doc_id == 302} == {(302, 2), (302, 1)}
    assert {r.first_word for r in out if r.doc_id in (3, 300, 301)} == {30, 0, -5}
    assert not {r.doc_id for r in out} & {*range(400, 430), 500, 600, 601}
    assert len(out) == len({(r.doc_id, r.item_id) for r in out})


@pytest.mark.parametrize("broadcast_words", [200_000, 0])
def test_whatever_the_rule_accepts_is_found(spark, broadcast_words):
    """Items of any length, with as many words replaced as the rule allows, wherever they are."""
    rng = random.Random(5)
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 16, 20, 30, 59):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, words))
        left_out = int(n * (1 - MIN_SHARE) + 1e-9)
        places = [[k] for k in range(n)] if left_out else [[]]
        places += [[k for k in range(n) if k % 5 in (a, b)] for a in range(5) for b in range(a)]  # evenly spread
        places += [[k for k in range(n) if k % 6 > 2], []]
        places += [rng.sample(range(n), min(n, left_out + rng.randrange(2))) for _ in range(12)]
        for gone in places:
            docs.append((len(docs), prose(6) + [f"z{k}" if k in gone else w for k, w in enumerate(words)] + prose(6)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_agree for r in contaminated(df, tests, broadcast_words).collect()}
    want = brute(docs, items)
    assert got == want and {i for _, i in want} == {i for i, _ in items}


@pytest.mark.parametrize("broadcast_words", [200_000, 0])
def test_short_items_must_stand_whole(spark, broadcast_words):
    items = spark.createDataFrame([(1, "what is the"), (2, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so this is the house"), (2, "and What is, the house"), (3, "what was the house"),
                                  (4, "one two three four five six eight"), (5, "zero one two three four five six seven")],
                                 "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, broadcast_words).collect()} == {(2, 1), (5, 2)}


@pytest.mark.parametrize("broadcast_words", [200_000, 0])
def test_across_the_borders_of_pieces(spark, monkeypatch, broadcast_words):
    monkeypatch.setattr(decontamination, "PIECE", 5)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in (1, 3, 9, 20)]
    docs = []
    for n, words in items:
        for at in range(45):
            docs.append((len(docs), prose(at) + changed(words, (0, 9)[at % 2]) + prose(23)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    out = contaminated(df, tests, broadcast_words).collect()
    assert {(r.doc_id, r.item_id): r.n_agree for r in out} == brute(docs, items)
    assert {(r.doc_id, r.first_word) for r in out} == {(d, d % 45) for d, _ in docs}


@pytest.mark.parametrize("broadcast_words", [200_000, 0])
def test_long_text_of_chance_hits(spark, broadcast_words):
    """20,000 hits in a text of 100,000 words: each with the whole text's hashes would be 16 GB."""
    item = [f"i{k}" for k in range(20)]
    words = [w for k in range(20_000) for w in (*item[k % 17:k % 17 + 3], f"x{k}", f"y{k}")] + item
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    out = contaminated(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), broadcast_words).collect()
    assert [(r.doc_id, r.item_id, r.n_agree, r.first_word) for r in out] == [(1, 7, 20, 100_000)]


def test_pipeline_stage_with_long_texts(spark, tmp_path):
    """The stage drops the leak at the end of a text of chance hits and keeps the text without it."""
    item = [f"i{k}" for k in range(20)]
    words = [w for k in range(20_000) for w in (*item[k % 17:k % 17 + 3], f"x{k}", f"y{k}")]
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, " ".join(words + item)), (2, " ".join(words)), (None, "a b")], "doc_id long, text string")
    assert {r.doc_id for r in drop_contaminated(spark, df, str(tmp_path)).collect()} == {2, None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert contaminated(docs, items).collect() == []
    assert contaminated(items.selectExpr("item_id doc_id", "text"), docs.selectExpr("doc_id item_id", "text")).collect() == []
