"""Searches over many shelves: queries stream by a shelf's rows instead of being joined with them."""

from __future__ import annotations

import re

import numpy as np

from riskflow.llm import topk


def data():
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 8)).astype(np.float32)
    x[500:1500] = x[500]  # a cell of equal rows, larger than a shelf
    return x


def test_shelves_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHELF_LEAST", 100, raising=False)
    monkeypatch.setattr(topk, "SHELVES", 10**6, raising=False)
    x = data()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = topk.exact_topk(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join.*\bblock\b", plan)  # no row holds a shelf's vectors once for each lot of queries
    q = np.floor(1024 * x.astype(float)).astype(np.int64)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    for query, rows in got.items():
        score = q @ q[query]
        assert rows == [(int(i), int(score[i])) for i in sorted((i for i in range(3000) if i != query), key=lambda i: (-score[i], i))[:10]]


def test_cells_on_shelves():
    first, parts = topk.shelves(np.array([5, 0, 5, 25, 3, 10, 1]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_products_take_numbers_that_hold_them():
    unit, large = np.full((1, 64), 500), np.full((1, 64), 2**25)
    assert topk.kind_of(unit, unit) is np.float32 and topk.kind_of(10 * unit, unit) is np.float64 and topk.kind_of(large, large) is np.int64
