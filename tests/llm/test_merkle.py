from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmix.llm.merkle import FIELDS, manifest

ROW = "doc_id bigint, source string, lang string, n_chars bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes: list[str]) -> list[list[str]]:
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i:i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def ascend(tree: list[list[str]], at: int, folded: str, proof: list[str]) -> str:
    for level in tree[:-1]:
        start = at // 16 * 16
        run = level[start:start + 16]
        run[at - start:at - start + 1] = []
        proof.extend(run)
        run.insert(at - start, folded)
        folded, at = digest(*run), at // 16
    return folded


def expected(rows) -> list[tuple]:
    by_source: dict = {}
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        tampered = leaf(row)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            tampered = leaf((doc_id, source, lang, n_chars, text.translate(LOWER)))
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(row), tampered, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for source in sources:
        by_source[source].sort(key=lambda r: r[:3])
    trees = [levels([r[2] for r in by_source[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, source in enumerate(sources):
        for i, (_, _, own, tampered, doc_id) in enumerate(by_source[source]):
            proof: list[str] = []
            folded = ascend(top, k, ascend(trees[k], i, tampered, proof), proof)
            root = top[-1][0]
            out.append((doc_id, own, trees[k][-1][0], root, digest(*proof), folded, folded == root))
    return out


def same(spark, rows, **more) -> None:
    df = spark.createDataFrame(rows, ROW)
    for name, value in more.items():
        df = df.selectExpr("*", f"{value} AS {name}")
    key = lambda r: tuple((v is not None, v) for v in r)
    got = [tuple(r) for r in manifest(df.repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def doc(i, source="a", text="Some Text"):
    return (i, source, "en", i, text)


@pytest.mark.parametrize("sizes", [[1], [16], [1, 1], [257, 1, 17]])
def test_sizes(spark, sizes):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows += [doc(at + i, f"s{k}", f"Text {at + i}") for i in range(n)]
        at += n
    same(spark, rows)


def test_many_sources(spark):
    same(spark, [doc(i, f"é{i % 270}") for i in range(300)])


def test_three_levels_and_a_hot_source(spark):
    same(spark, [doc(i, "hot" if i % 20 else f"s{i}") for i in range(4500)])


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, None, "en", 3, "Ab"), (1, None, "en", None, ""),
            (1, "", "en", 2, "AB"), (1, "", "en", 2, "AB"), (1, "", "en", 2, "ABC"), (2, "É", None, 1, "ÀB"),
            (-7, "b", "de", 0, None), (10**15, "B", "de", 0, "x" * 300_000)]
    same(spark, rows, leaf="'x'", path="1", number="2", _part="3", first="4", n="5", hash="'h'", block="6")


def test_repeated_rows_in_number(spark):
    same(spark, [doc(5, text="Same")] * 400 + [doc(None, text="Same")] * 40)


def test_empty(spark):
    got = manifest(spark.createDataFrame([], ROW))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.collect() == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-50, 50)), st.sampled_from([None, "", "a", "Z", "ß"]),
                          st.sampled_from([None, "en"]), st.one_of(st.none(), st.integers(0, 9)),
                          st.one_of(st.none(), st.text("aAbBÄ \n", max_size=6))), max_size=60))
def test_random(spark, rows):
    same(spark, rows)


def test_fields_are_those_of_documents():
    assert FIELDS == tuple(ROW.replace(",", "").split()[::2])
