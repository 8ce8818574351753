from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import SF_MID

from jobmix.llm.whitening import op11_whitening, whitened

ROW = "vec_id bigint, embedding array<float>, label int"


def check(rows: list, vectors: dict[int, list], components: int = 32) -> None:
    """The definition, in numpy, on vectors by id."""
    ids = sorted(vectors)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors[i]] for i in ids])
    n, sums = len(ids), x.sum(0)
    z = x - sums / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, x.shape[1])
    assert len(rows) == n * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == n * k
    for c in range(k):
        own = np.array([got[i, c + 1]["whitened"] for i in ids])
        want = z @ axes[:, c] / math.sqrt(values[c])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
        assert all(math.isclose(got[i, c + 1]["explained"], values[c] / values.sum(), rel_tol=1e-6) for i in ids)
    for i, row in zip(ids, x):
        exact = sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))
        assert {got[i, c + 1]["deviation"] for c in range(k)} == {exact}
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] <= 1e-4


def test_given_table(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()}
    check(op11_whitening(spark, SF_MID).collect(), vectors)


def test_several_blocks_and_parts(spark, monkeypatch):
    import jobmix.llm.whitening as w
    monkeypatch.setattr(w, "ROWS", 16)
    monkeypatch.setattr(w, "BLOCKS_IN_PART", 2)
    rng = np.random.default_rng(1)
    vectors = {i: [float(np.float32(v)) for v in rng.normal(size=5) * [9, 5, 3, 2, 1]] for i in range(300)}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], ROW).repartition(7)
    check(whitened(df, components=3).collect(), vectors, 3)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * 4], 1) for i in range(40)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [float("nan"), 0.0, 0.0], 1),
           (103, [float("inf"), 0.0, 0.0], 1), (104, [0.0, float("-inf"), 0.0], 1), (105, [], 1)]
    df = spark.createDataFrame(good + bad, ROW)
    # Columns named like those of the work are not read.
    for name in ("x", "v", "number", "n", "_part", "_at", "component"):
        df = df.selectExpr("*", f"'a' AS {name}")
    check(whitened(df).collect(), {i: v for i, v, _ in good})


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [0.0, 1.0], 0), (None, [2.0, 1.0], 0), (7, [2.0, 3.0], 0), (7, [2.0, 3.0], 0)]
    got = whitened(spark.createDataFrame(rows, ROW)).collect()
    assert len(got) == 8 and sum(r["vec_id"] is None for r in got) == 4 and {r["n"] for r in got} == {4}
    same = [r["whitened"] for r in got if r["vec_id"] == 7 and r["component"] == 1]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [3.0, 4.0], 0) for i in range(9)]])
def test_no_variance(spark, rows):
    got = whitened(spark.createDataFrame(rows, ROW))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(20)]
    got = whitened(spark.createDataFrame(rows, ROW)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="1 to 2"):
        whitened(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], ROW))
