"""Quality rules and toxicity."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobmix.llm.quality import ABSTAIN, BAD, GOOD, default_rules, fit, judge, measures
from jobmix.llm.toxicity import NEAR, Features, train

# Wide enough that rules disagree on some documents.
SF_LARGE = "/root/testdata/sf0.1"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(9)
    pool = ["a", "b", "The", "é", "x#", "|", "\n", "\t", "\x0b", " ", "same line\nsame line\n", "1,2"]
    out = ["".join(rng.choice(pool) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return out + [None, "", "   ", "a a a a a", "a a a a a a", "a b c d e " * 4000]


def test_base_measures_equal_brute_force(spark):
    many = texts()
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(many)], "doc_id long, text string, n_words int")
    got = {r[0]: tuple(r)[1:6] for r in measures(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute(t) for i, t in enumerate(many)}


def test_expectation_maximisation_trusts_rules_that_agree():
    patterns = {(GOOD, GOOD, GOOD): 800, (BAD, BAD, GOOD): 90, (BAD, BAD, BAD): 60, (GOOD, GOOD, BAD): 2}
    model = fit(patterns, 3)
    assert model.belief((GOOD, GOOD, GOOD)) > 0.9 and model.belief((BAD, BAD, GOOD)) < 0.1
    assert fit({}, 3).belief((GOOD, BAD, GOOD)) == pytest.approx(0.5)


def test_a_weak_bad_vote_is_outvoted_and_the_share_is_estimated():
    # The last rule votes at random; the first three agree on 30% junk.
    patterns = {(GOOD, GOOD, GOOD, GOOD): 500, (GOOD, GOOD, GOOD, BAD): 200, (BAD, BAD, BAD, GOOD): 200,
                (BAD, BAD, BAD, BAD): 80, (BAD, BAD, GOOD, GOOD): 10, (GOOD, GOOD, BAD, ABSTAIN): 10}
    model = fit(patterns, 4)
    assert model.prior == pytest.approx(0.71, abs=0.01)
    assert model.belief((GOOD, GOOD, GOOD, BAD)) > 0.9 and model.belief((BAD, BAD, BAD, GOOD)) < 0.1
    assert model.belief((GOOD, GOOD, BAD, ABSTAIN)) > 0.5 > model.belief((BAD, BAD, GOOD, GOOD))
    assert model.odds[3][BAD] == pytest.approx(1, abs=0.1)


def test_posterior_is_not_all_must_pass_on_the_given_documents(spark):
    rules = default_rules()
    documents = spark.read.parquet(f"{SF_LARGE}/documents.parquet")
    quality = spark.read.parquet(f"{SF_LARGE}/labels.parquet").select("doc_id", "quality")
    judged = judge(documents).withColumn("all_pass", ~F.col("base_failed") & ~F.array_contains(
        F.array(*[r.vote() for r in rules]), BAD))
    assert judged.where("kept and not all_pass").count() > 0
    known = judged.drop("quality").join(quality.where("quality is not null"), "doc_id")
    n, posterior, all_pass = known.agg(F.count(F.lit(1)), F.expr("count_if(kept = (quality = 1))"),
                                       F.expr("count_if(all_pass = (quality = 1))")).first()
    assert posterior > all_pass and posterior >= 0.97 * n


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = [" ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(80)) for _ in range(200)]
    junk = [" ".join(word() + rng.choice(["***", "$$$", "###"]) for _ in range(80)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(prose + junk)) + [(900, None), (None, prose[0]), (0, prose[0])],
                               "doc_id long, text string")
    rows = judge(df).collect()
    assert len(rows) == 223 and all(0 <= r.quality <= 1 for r in rows)
    assert all(r.kept for r in rows if r.doc_id is None or r.doc_id < 200)
    assert not any(r.kept for r in rows if r.doc_id is not None and r.doc_id >= 200)
    assert [r.base_failed for r in rows if r.doc_id == 900] == [True]
    assert judge(df.limit(0)).collect() == []


def test_features():
    f = Features([" idio", " scum "])
    hits, second = f._hits(" you are an idiot and scum scummy ")
    assert hits == [(4, " idio"), (6, " scum ")] and second == [1]
    row = f.of("YOU idiot! an 1d1ot")
    assert row[0] == pytest.approx(1 / 5) and row[3] == pytest.approx(1 / 5) and row[5] > 0 and row[8] > 0
    assert f.of("") == (0.0,) * 10
    # Each hit counts once, whichever of the second persons is near.
    assert f.of("scum a b c d e you f scum you")[3] == pytest.approx(1 / 10)
    rng = random.Random(6)
    for _ in range(50):
        words = [rng.choice(["you", "your", "scum", "idiot", "a", "b", "c"]) for _ in range(rng.randint(1, 60))]
        hits, second = f._hits(" " + " ".join(words) + " ")
        assert f.of(" ".join(words))[3] == pytest.approx(
            sum(any(abs(w - s) <= NEAR for s in second) for w, _ in hits) / len(words))


def test_features_of_a_very_long_text():
    start = time.monotonic()
    row = Features([" scum "]).of("you " * 200_000 + "x " * 1000 + "scum " * 200_000)
    assert row[3] == 0 and row[0] == pytest.approx(200_000 / 401_000)
    assert time.monotonic() - start < 20


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [word() for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zzlow" + word(), "quomp", "vexx" + word()])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(toxic), 1))
    docs = spark.createDataFrame(rows + [(None, "x", "en"), (9000, None, "en"), (9001, "", "en"), (0, rows[0][1], "en")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks + [(None, 1, 1), (5, None, 1), (5, 0, 1)], "doc_id long, toxic int, quality int")
    out = train(docs, labels).score(docs).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    known = dict((a, b) for a, b, _ in marks)
    held = [r for r in out if r.doc_id is not None and r.held_out and r.doc_id in known]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(known[r.doc_id] == r.predicted for r in held) >= 0.9 * len(held)
    # Without toxic rows to learn from, the score is the share of toxic ones.
    none = train(docs, labels.withColumn("toxic", F.lit(0))).score(docs)
    assert {r.score for r in none.collect()} == {0.0}
    assert train(docs.limit(0), labels).score(docs.limit(0)).collect() == []
