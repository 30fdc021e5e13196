import math

import numpy as np
import pytest
from canasta.llm import registry, whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components=8):
    """Rows by numpy alone, from (vec_id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviations = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return kept, n, deviations, (centred @ vectors / np.sqrt(np.maximum(values, 1e-300)))[:, :components], values[:components] / values.sum()


def held_against(df, rows):
    kept, n, deviations, whitened, explained = brute(rows)
    got = df.collect()
    assert len(got) == len(kept) * whitened.shape[1] and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(whitened.shape[1]):
        column = np.array([by_id[i, k + 1]["whitened"] for i, _ in kept])
        sign = np.sign(column @ whitened[:, k])
        assert np.abs(column - sign * whitened[:, k]).max() < 1e-7
        assert all(abs(by_id[i, k + 1]["explained"] / explained[k] - 1) < 1e-9 for i, _ in kept)
    assert [by_id[i, 1]["deviation"] for i, _ in kept] == deviations
    return got


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held_against(registry.op11_whitening(spark, SF), rows)


def test_many_tasks_merge_to_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    held_against(whitening.report(vectors.repartition(70)), [(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_merging_loses_nothing():
    x = np.random.default_rng(1).integers(-500, 500, (300, 12))
    whole = None
    for a, b in ((0, 3), (3, 4), (4, 100), (100, 300)):
        whole = whitening.merged(whole, whitening.summary(x[a:b]))
    centred = x - x.mean(axis=0)
    assert whole.n == 300 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.vectors.T * whole.values**2 @ whole.vectors, centred.T @ centred)


def test_odd_vectors(spark):
    rows = [(i, [math.sin(i * k + k * k) for k in range(1, 5)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, _v string, n int")
    got = whitening.report(df).collect()
    assert {r["n"] for r in got} == {42} and len(got) == 42 * 4
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == list(range(40))
    assert len([r for r in got if r["vec_id"] is None]) == 4
    same = [(r["component"], r["whitened"], r["deviation"]) for r in got if r["vec_id"] in (3, None)]
    assert len(same) == 12 and len(set(same)) == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.report(df)
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_constant_dimensions_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 5.0, float(i * i % 11)]) for i in range(30)], "vec_id long, embedding array<double>")
    got = whitening.report(df).collect()
    assert {r["component"] for r in got} == {1, 2} and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12
    model = whitening.fit(df)
    assert all(len(r["whitened"]) == 2 for r in whitening.whiten(df, model).collect())


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 0], [0, 1], [1, 1]], np.int64)
    model = whitening.Whitening(3, [int(s) for s in x.sum(axis=0)], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(x) == [None, None, None]
    x = np.array([[1 << 31, 0], [0, 1]], np.int64)
    model = whitening.Whitening(2, [int(s) for s in x.sum(axis=0)], np.eye(2), np.ones(2), 2.0)
    assert model.deviations(x) == [(1 << 62) + 1] * 2
