"""Whitening against plain numpy over all rows, and its edges."""

import math

import numpy as np
import pytest

from keyloom.llm import whitening
from keyloom.llm.queries import op12_whitening

DIR = "/root/testdata/sf0.001"


def plain(rows, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    away = np.array([[float(v * n - s) / n for v, s in zip(r, sums)] for r in x])
    covariance = away.T @ away / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, away @ axes / np.sqrt(values), values / np.trace(covariance)


def test_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    n, deviation, whitened, explained = plain(rows)
    got = op12_whitening(spark, DIR).toPandas()
    assert dict(op12_whitening(spark, DIR).dtypes)["deviation"] == "bigint"
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    signs = np.sign((wide * whitened).sum(axis=0))
    assert np.allclose(wide * signs, whitened, atol=1e-7)
    one = got[got.component == 1].set_index("vec_id").deviation
    assert [int(one[i]) for i, _ in rows] == deviation.tolist()
    assert np.allclose(got.sort_values(["vec_id", "component"]).explained.to_numpy()[:8], explained, rtol=1e-9)


def test_merging_in_any_order_is_the_whole():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 6)) * [1, 5, 20, 1, 1, 300]) + 1e5
    parts = [whitening.State.of(p) for p in np.split(x, [1, 7, 60, 61, 300])]
    for p, part in zip(parts, np.split(x, [1, 7, 60, 61, 300])):
        p.sums = part.sum(axis=0).astype(int).tolist()
    for order in ([0, 1, 2, 3, 4, 5], [5, 3, 1, 0, 2, 4]):
        whole = parts[order[0]]
        for k in order[1:]:
            whole = whitening.chan(whole, parts[k])
        assert whole.n == 500 and whole.sums == x.sum(axis=0).astype(int).tolist()
        assert np.allclose(whole.mean, x.mean(axis=0), rtol=1e-14)
        assert np.allclose(whole.scatter / 500, np.cov(x.T, bias=True), rtol=1e-11, atol=1e-9)


def test_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf")] * 4), (105, [1.0, 2.0])]
    more = [(None, rows[0][1]), (1, rows[1][1]), (1, rows[2][1])]
    schema = "vec_id long, embedding array<double>, n int, component string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd + more], schema).repartition(7)
    got = whitening.whiten(df).collect()
    kept = rows + more
    n, deviation, whitened, _ = plain(kept, 4)
    assert len(got) == 4 * n == 4 * len(kept) and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation.tolist())
    assert {r.vec_id for r in got} == {i for i, _ in kept}
    empty = lambda x: whitening.whiten(x).count() == 0
    assert empty(df.limit(0)) and empty(df.where("vec_id = 105")) and empty(df.where("vec_id IN (100, 101, 102, 103, 104)"))
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert empty(same)


def test_large_entries_stay_exact(spark):
    rows = [(0, [1e9, 1.0]), (1, [-1e9, 2.0]), (2, [3e8, 1e300]), (3, [0.0, -1e300])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[max(-(1 << 52), min(1 << 52, math.floor(1024 * c) + 100_000)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got.where("component = 1").collect()} == want


@pytest.mark.parametrize("n", [1, 7, 1 << 33])
def test_deviation_of_any_count(n):
    rng = np.random.default_rng(n)
    sums = [int(v) for v in rng.integers(-9 * n, 9 * n, 5)]
    model = whitening.Whitening(n, sums, np.ones(1), np.ones((5, 1)), 1.0)
    x = rng.integers(-1 << 19, 1 << 19, (6, 5))
    assert model.deviations(x) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
