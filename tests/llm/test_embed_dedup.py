"""Embedding near-duplicates against all products, and the recall of the cells."""

import math

import numpy as np

from keyloom.llm import embed_dedup as module
from keyloom.llm.embed_dedup import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows, least=0.9):
    links = {i: set() for i, _ in rows}
    able = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for k, (i, x) in enumerate(able):
        for j, y in able[k + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i].add(j)
                links[j].add(i)
    label = {i: i for i in links}
    moved = True
    while moved:
        moved = False
        for i, own in links.items():
            if (low := min([label[i], *(label[j] for j in own)])) < label[i]:
                label[i], moved = low, True
    return {i: (len(links[i]), label[i], label[i] == i) for i in links}


def vectors(n, dim=64, seed=1, cos=0.9, copies=0.3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(int(n * copies)):
        z = r.normal(size=dim)
        z -= z @ x[i] * x[i]
        c = cos + (0.995 - cos) * r.random()
        x[n - 1 - i] = c * x[i] + math.sqrt(1 - c * c) * z / np.linalg.norm(z)
    return x.astype(np.float32)


def test_same_as_all_products_without_loss(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300))]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, [2 * x for x in rows[5][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [None] + [1.0] * 63), (3005, [float("inf")] * 64), (3006, [1.0, 2.0]), (3007, [1.0, 2.0])]
    got = embed_dedup(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), per_cell=40, margin=0.4359).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute([(i, None if v is None else [np.float32(x) if x is not None else None for x in v]) for i, v in rows])


def test_recall_at_the_threshold(spark):
    x = vectors(4000, cos=0.9, copies=0.5, seed=3)
    got = {r.vec_id: r for r in embed_dedup(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA), per_cell=100).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all()
    assert found.sum() / true.sum() >= 0.95


def test_no_link_is_lost_across_borders(spark, monkeypatch):
    """Vectors near a space of 4 dimensions in many cells, by the default margin."""
    monkeypatch.setattr(module, "ROW", 0, raising=False)  # handed-on rows are free: as many cells as asked for
    r = np.random.default_rng(5)
    x = (r.normal(size=(1200, 4)) @ r.normal(size=(4, 64)) + 0.05 * r.normal(size=(1200, 64))).astype(np.float32)
    sizes = []
    monkeypatch.setattr(module, "_assigned", lambda centres, margin, f=module._assigned: sizes.append(len(centres)) or f(centres, margin))
    got = {v.vec_id: v.n_links for v in embed_dedup(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA), per_cell=20).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sizes[0] > 10
    assert [got[i] for i in range(len(x))] == true.tolist()


def test_empty(spark):
    assert embed_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in embed_dedup(spark.createDataFrame([(1, None, "")], SCHEMA)).collect()] == [(1, 0, 1, True)]
