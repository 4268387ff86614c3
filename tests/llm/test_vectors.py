"""Operators 4 and 6 against brute force."""

from __future__ import annotations

import math

import numpy as np

from riskflow.llm.components import connected_components
from riskflow.llm.topk import exact_topk
from riskflow.llm.vector_join import embedding_links

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, n long"


def vectors():
    r = np.random.default_rng(7)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[100] + 0.05 * r.normal(size=(60, 16))
    x[200:230] = x[200]
    x[300:340] = x[300] + 0.28 * np.abs(x[300]).mean() * r.normal(size=(40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return rows + [(800, None), (900, [0.0] * 16), (1000, [float("nan")] * 16), (1100, [None] + [1.0] * 15), (1200, [float("inf")] + [1.0] * 15), (1300, (2 * x[5]).tolist()), (None, x[5].tolist()), (5, x[5].tolist()), (1400, [1.0, 2.0]), (1500, [])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def full(v):
    return np.array([*v, *[0.0] * (16 - len(v))], np.float32).astype(float)


def test_topk(spark):
    rows = [(i, full(v)) for i, v in vectors() if i is not None and usable(v)]
    ids = np.array([i for i, _ in rows])
    q = np.floor(1024 * np.stack([v for _, v in rows])).astype(np.int64)
    want = set()
    for query in sorted({i for i in ids if i % 100 == 0}):
        score = q @ q[np.flatnonzero(ids == query)[0]]
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != query)[:10]
        want |= {(int(query), k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in exact_topk(table(spark, vectors())).collect()} == want
    assert exact_topk(table(spark, [])).count() == 0
    assert exact_topk(table(spark, [(0, [1.0]), (1, [2.0])])).count() == 1


def test_topk_bound_with_repeated_queries(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 8)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, x[100].tolist())] * 14
    ids = np.array([i for i, _ in rows])
    q = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    want = set()
    for query in range(0, 6000, 100):
        score = q @ q[query]
        best = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != query)[:10]
        want |= {(query, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(row) for row in exact_topk(table(spark, rows)).collect()} == want


def test_links_of_rows_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [2.0, 0.01]), (9, [0.0, 3.0]), (9, [0.0, 3.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links(table(spark, rows)).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (7, 1, 5), (9, 2, 5), (9, 2, 5)]


def test_links(spark):
    rows = vectors()
    good = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v) and any(v)]
    x = np.stack([full(rows[k][1]) for k in good])
    norm = np.linalg.norm(x, axis=1)
    link = x @ x.T >= 0.95 * np.outer(norm, norm)
    np.fill_diagonal(link, False)
    part = np.array([rows[k][0] for k in good])
    while True:
        new = np.array([min(part[j], *part[link[j]]) if link[j].any() else part[j] for j in range(len(good))])
        new = np.array([new[part == part[j]].min() for j in range(len(good))])
        if (new == part).all():
            break
        part = new
    want = [(rows[k][0], int(link[j].sum()), int(part[j])) for j, k in enumerate(good)] + [(i, 0, i) for k, (i, _) in enumerate(rows) if k not in set(good)]
    got = embedding_links(table(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_links(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (100, 70), (70, 100), (5, 5), (200, 201)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 50, 50: 50, 70: 50, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_end_at_once_and_many_by_stars(spark, monkeypatch):
    from riskflow.llm import components

    edges = [(k, k + 1) for k in range(60) if k % 20 != 19] + [(5, 5), (3, 1), (61, 7)]
    want = {**{k: k // 20 * 20 for k in range(60)}, 61: 0}
    write, written = components.materialise, []
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or write(df, name))
    find = lambda: {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert find() == want and len(written) <= 2
    monkeypatch.setattr(components, "CONTRACTED", 4)
    written.clear()
    assert find() == want and len(written) > 2
