"""Whitening against a dense eigendecomposition and whole-number sums."""

import math

import numpy as np
import pytest

from quern.llm import whitening
from quern.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, n string, deviation int, label int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, None) for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def brute(vectors):
    """(kept places, exact deviations, eigenvalues, eigenvectors, centred rows)."""
    kept = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors[i]] for i in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    away = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array(away, float) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return kept, [sum(a * a for a in row) for row in away], values[::-1], vecs[:, ::-1], centred


def check(done, vectors, components, tolerance=1e-9):
    kept, away, values, vecs, centred = brute(vectors)
    got = {r.vec_id: r for r in done.collect()}
    assert sorted(got) == kept
    assert [int(got[i].deviation) for i in kept] == away and {got[i].n for i in kept} == {len(kept)}
    y = np.array([got[i].whitened for i in kept])
    want = centred @ vecs[:, :components] / np.sqrt(values[:components])
    sign = np.sign((y * want).sum(axis=0))
    assert y.shape == want.shape and np.abs(y * sign - want).max() < tolerance
    assert np.allclose(got[kept[0]].explained, values[:components] / values.sum(), rtol=1e-10)
    assert len({tuple(r.explained) for r in got.values()}) == 1 and {r.identity_error for r in got.values()} == {got[kept[0]].identity_error}
    assert got[kept[0]].identity_error < 1e-10


def test_against_eigenvectors_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [*(rng.standard_normal((400, 12)) * np.linspace(1, 3, 12)).tolist(), None, [float("nan")] + [0.0] * 11, [None] + [0.0] * 11, [float("inf")] * 12]
    check(whitening.whiten(table(spark, rows), components=5), rows, 5)
    check(whitening.whiten(table(spark, rows), components=50), rows, 12)


def test_one_vector_holds_most_rows_and_constant_columns(spark):
    rng = np.random.default_rng(3)
    rows = np.zeros((300, 9))
    rows[:, :6] = rng.standard_normal((300, 6))
    rows[:100] = 0.5
    rows[:, 8] = 7.25
    check(whitening.whiten(table(spark, rows.tolist())), rows.tolist(), 7, 1e-7)


def test_equal_eigenvalues_are_found_as_often_as_they_occur(spark):
    rows = [[(1.0 if k == i else 0.0) * s for k in range(6)] for i in range(6) for s in (1, -1)]
    done = whitening.whiten(table(spark, rows), components=6).collect()
    y = np.array([r.whitened for r in sorted(done, key=lambda r: r.vec_id)])
    assert y.shape == (12, 6) and np.allclose(y.T @ y / 12, np.eye(6), atol=1e-10)
    assert np.allclose(done[0].explained, [1 / 6] * 6)


def test_many_dimensions_stop_early(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FULL", 8)
    rng = np.random.default_rng(4)
    rows = (rng.standard_normal((200, 60)) * np.r_[40, 30, 20, 10, np.full(56, 0.5)]).tolist()
    made = []
    total = whitening.Rows.total
    monkeypatch.setattr(whitening.Rows, "total", lambda self, *a: made.append(1) or total(self, *a))
    check(whitening.whiten(table(spark, rows), components=4), rows, 4)
    assert len(made) < 50


def test_edges(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [None, None])).collect() == []
    assert whitening.whiten(table(spark, [[], []])).collect() == []
    equal = whitening.whiten(table(spark, [[1.0, 2.0]] * 4, [None, 7, 7, 8])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained) for r in equal] == [(4, 0, [], [])] * 4 and {r.vec_id for r in equal} == {None, 7, 8}
    assert whitening.components_long(whitening.whiten(table(spark, [[1.0, 2.0]] * 4))).collect() == []
    ragged = [[1.0], [2.0, 1.0], [0.0, 3.0], []]
    check(whitening.whiten(table(spark, ragged)), [[*r, 0.0, 0.0][:2] for r in ragged], 2)
    huge = whitening.whiten(table(spark, [[1e12, 1.0], [1.0, -1e12], [5.0, 5.0]])).collect()
    assert all(int(r.deviation) > 1 << 63 for r in huge if r.vec_id < 2)
    long = whitening.components_long(whitening.whiten(table(spark, [[3e38, 1.0], [1.0, -3e38], [5.0, 5.0]])))
    assert {r.deviation for r in long.collect() if r.vec_id == 0} == {None}  # beyond even 38 digits


@pytest.mark.parametrize("most", [50, 1 << 20, 1 << 44])
def test_deviations_are_exact(most):
    rng = np.random.default_rng(5)
    x = rng.integers(-most, most, (20, 7))
    n, sums = 1_000_003, [int(s) for s in x.sum(axis=0)]
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    _, away, values, vecs, centred = brute([rows[i] for i in sorted(rows)])
    got = op11_whitening(spark, sf).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 32 * len(rows)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ vecs[:, :32] / np.sqrt(values[:32])
    assert np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-9
    assert got.sort_values(["component", "vec_id"]).deviation.head(len(rows)).tolist() == away and got.identity_error.max() < 1e-10
    assert np.allclose(got.groupby("component").explained.first(), values[:32] / values.sum(), rtol=1e-10)
