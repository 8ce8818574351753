"""N-gram join: against brute force, with forced large groups and deficient sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmix.llm import ngram_join as N


def words(rng, n, vocabulary=300):
    return [f"W{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


def corpus(rng):
    docs = []
    for size in (3, 5, 6, 8, 9, 12, 20, 40, 70, 140, 300):
        base = words(rng, size)
        docs += [base, base, *(edited(rng, base, share) for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.1))]
        docs += [base + words(rng, max(1, size // k)) for k in (3, 4, 6, 10)]
    passage = words(rng, 60)
    docs += [words(rng, rng.randint(10, 60)) + passage + words(rng, rng.randint(10, 60)) for _ in range(60)]
    hub = words(rng, 120)
    docs += [hub] + [edited(rng, hub, 0.025) for _ in range(60)]
    return [" ".join(d) for d in docs]


def brute(rows):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component)}; doc ids are unique."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").lower().split()
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed, small_group", [(1, N.SMALL_GROUP), (2, 2)])
def test_equal_to_brute_force(spark, seed, small_group):
    rng = random.Random(seed)
    rows = list(enumerate(corpus(rng))) + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "x " * 40_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows] + [(None, rows[0][1], 1)],
                               "doc_id long, text string, size int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.linked(df, small_group).collect()}
    assert got == brute(rows)


def test_rows_with_one_id_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, None)],
                               "doc_id long, text string")
    got = sorted(tuple(r) for r in N.linked(df).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert N.linked(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 15, 33, 64, 65, 100, 127, 200, 500, 1000])
def test_similar_sets_share_a_signature(size):
    """Pairs at the very edge of the threshold, equal and unequal sizes, one part or several."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        drop = int(rng.integers(0, size // 4 + 1))
        keep = x[drop:]
        # As many new ones as the threshold still allows.
        room = max(0, (4 * len(keep)) // 3 - len(x))
        y = np.unique(np.r_[keep, rng.integers(0, 2**63, int(rng.integers(0, room + 1))).astype(np.uint64)])
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if 100 * common < 75 * (len(x) + len(y) - common) or not len(y):
            continue
        sigs = []
        for g in (x, y):
            made = {}
            sigs.append({int(s) for i in N.instances_of(len(g), made) for s in i.signatures(g)})
        assert sigs[0] & sigs[1]


def test_batched_signatures_equal_those_of_one_set():
    rng = np.random.default_rng(4)
    grams = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (70, 100, 300, 301, 900)]
    made = {}
    pairs = [(g, i) for g in grams for i in N.instances_of(len(g), made) if i.n2 == 1]
    found, whose = N.whole_signatures([g for g, _ in pairs], [i for _, i in pairs])
    for k, (g, i) in enumerate(pairs):
        own = {int(s) for s in found[whose == k]}
        assert own <= {int(s) for s in i.signatures(g)} and own


def test_packing_keeps_pairs_together():
    sigs = np.array([5, 6, 2**63 + 11, 5], np.uint64)
    rows = [r for b in N._packed(sigs, np.array([0, 0, 1, 2], np.uint32), np.array([70, 80, 90]), 3) for r in b.to_pylist()]
    seen = [(r["part"], int(s), int(n)) for r in rows for s, n in zip(*N._unpacked(r["sigs"], r["places"], r["names"]))]
    assert sorted(n for _, _, n in seen) == [70, 70, 80, 90]
    assert len({(p, s) for p, s, n in seen if n in (70, 90)}) == 2


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 400)]
    links = spark.createDataFrame([*chain, *star, (500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in N.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 900), st.integers(0, 500), st.integers(0, 500))
def test_fine_counts_never_exceed_the_difference(seed, common, only_a, only_b):
    rng = np.random.default_rng(seed)
    grams = np.unique(rng.integers(0, 2**63, common + only_a + only_b).astype(np.uint64))
    rng.shuffle(grams)
    # Crowded buckets, so that counts are clipped.
    grams = np.unique(np.where(rng.random(len(grams)) < 0.1, grams << np.uint64(40), grams))
    rng.shuffle(grams)
    a, b = np.sort(grams[:common + only_a]), np.sort(np.r_[grams[:common], grams[common + only_a:]])
    real = len(np.setxor1d(a, b))
    assert N.fine_difference(N.fine_counts(a), N.fine_counts(b)) <= real
    assert N.fine_difference(N.fine_counts(a), N.fine_counts(a)) == 0


@pytest.mark.parametrize("size", [1, 2, 5, 9, 20, 33, 64, 65, 100, 127, 200, 500, 1000])
def test_similar_sets_share_a_first_signature(size):
    """In any order of the signatures; here some of those that both sets have come last."""
    rng = np.random.default_rng(size + 7)
    fewer = 0
    for _ in range(40):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        keep = x[int(rng.integers(0, size // 4 + 1)):]
        room = max(0, (4 * len(keep)) // 3 - len(x))
        y = np.unique(np.r_[keep, rng.integers(0, 2**63, int(rng.integers(0, room + 1))).astype(np.uint64)])
        common = len(np.intersect1d(x, y))
        if 100 * common < 75 * (len(x) + len(y) - common) or not len(y):
            continue
        every = [np.concatenate([i.signatures(g) for i in N.instances_of(len(g), {})]) for g in (x, y)]
        names = N.named(np.intersect1d(*every), 5).view(np.int64).tolist()
        order = N.Order({n: 3 + k for k, n in enumerate(names) if rng.random() < 0.8}, 5)
        first = [np.concatenate([i.first_signatures(g, order) for i in N.instances_of(len(g), {})]) for g in (x, y)]
        assert len(np.intersect1d(*first))
        fewer += sum(map(len, every)) - sum(map(len, first))
    assert fewer > 0 or size < 65


def test_first_of_each_equals_one_set_at_a_time():
    rng = np.random.default_rng(5)
    grams = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (70, 100, 300, 301, 900)]
    made = {}
    pairs = [(g, i) for g in grams for i in N.instances_of(len(g), made) if i.n2 == 1]
    found, whose = N.whole_signatures([g for g, _ in pairs], [i for _, i in pairs])
    order = N.Order({int(n): 9 for n in N.named(found[::3], 4).view(np.int64)}, 4)
    keep = np.array([i.spoiled(len(g)) + 1 for g, i in pairs])
    got, who = N.first_of_each(found, whose, keep, order)
    for k, (g, i) in enumerate(pairs):
        assert keep[k] <= (whose == k).sum()
        assert sorted(got[who == k].tolist()) == sorted(i.first_signatures(g, order).tolist())


def rows_with_a_passage():
    rng = random.Random(11)
    passage = words(rng, 12)
    docs = [words(rng, 40, 10**6) + passage + words(rng, 40, 10**6) for _ in range(120)]
    docs += [edited(rng, d, 0.01) for d in docs[:20]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("sampled", [True, False])
def test_shared_passage_makes_no_large_groups_to_join(spark, monkeypatch, sampled):
    """Texts with a passage in common were all joined by their prefixes; without a sample they are signed again."""
    rows, joined = rows_with_a_passage(), []
    whole = N.prefix_pairs
    monkeypatch.setattr(N, "prefix_pairs", lambda docs, wanted, *more: joined.append(wanted.count()) or whole(docs, wanted, *more))
    if not sampled:
        monkeypatch.setattr(N, "frequent_signatures", lambda *args: {})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.linked(df).collect()}
    assert got == brute(rows)
    assert sum(joined) < 10
