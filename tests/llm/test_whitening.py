"""Operator 12 against covariances of exact fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from riskflow.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x string, w double, component int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 0.5, 9) for i, v in rows], SCHEMA).repartition(parts)


def expected(rows, m=8):
    """n, deviations, eigenvalues and whitened values, the covariance by fractions."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in kept)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (dim - len(v)) for _, v in kept]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(dim)] for a in range(dim)])
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1][:m], u[:, ::-1][:, :m]
    return n, [(i, sum(a * a for a in r)) for (i, _), r in zip(kept, y, strict=True)], values, (np.array(y, float) / n) @ u / np.sqrt(values), np.trace(cov)


def random_rows(n, dim, seed=1):
    r = np.random.default_rng(seed)
    return [(k, [float(c) for c in v]) for k, v in enumerate((r.normal(size=(n, dim)) * (1 + np.arange(dim)) + 3).astype(np.float32))]


@pytest.mark.parametrize(("n", "dim"), [(200, 12), (300, 3)])
def test_whitened_as_by_fractions(spark, n, dim):
    rows = random_rows(n, dim)
    rows += [(rows[4][0], rows[4][1]), (None, rows[5][1]), (901, rows[6][1][: dim - 1])]  # a repeat, no id, a short one
    bad = [(902, None), (903, [*rows[0][1][1:], float("nan")]), (904, [*rows[0][1][1:], None]), (905, [float("inf")] * dim)]
    want_n, deviation, values, w, trace = expected(rows)
    got = wh.whiten(table(spark, rows + bad)).collect()
    m = min(8, dim)
    assert len(got) == m * want_n and {r.n for r in got} == {want_n}
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == sorted(deviation, key=str)
    at = {i: k for k, (i, _) in enumerate(deviation) if i not in (None, rows[4][0])}
    out = np.zeros((want_n, m))
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        if r.vec_id in at:
            out[at[r.vec_id], r.component - 1] = r.whitened
    rest = sorted(at.values())
    sign = np.sign((out * w).sum(0))
    assert np.abs(out[rest] * sign - w[rest]).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_squares_beyond_64_bits():
    r = random.Random(2)
    u = [[r.randrange(-(1 << 58), 1 << 58) for _ in range(3)] for _ in range(50)]
    assert wh.square_sums(np.array(u, np.int64)) == [sum(row[k] ** 2 for row in u) for k in range(3)]
    wide = [[v << 20 for v in row] for row in u]
    assert wh.square_sums(np.array(wide, object)) == [sum(row[k] ** 2 for row in wide) for k in range(3)]
    assert wh.square_sums(np.zeros((4, 2), np.int64)) == [0, 0]


def test_many_rows_are_centred_exactly():
    """As if there were 10^13 rows: n x - S goes beyond 64 bits."""
    n, sums = 10**13, [10**13 * 100_000 + 7, 10**13 * 99_999 + 10**12]
    x = np.array([[100_500, 10**6], [99_000, 99_999]], np.int64)
    got = wh.Centred(n, sums).exact(x)
    assert got.tolist() == [[n * int(c) - s for c, s in zip(row, sums, strict=True)] for row in x]


def test_nothing_to_whiten(spark):
    assert wh.whiten(table(spark, [])).count() == 0
    assert wh.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    one = wh.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = wh.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    assert flat[0].identity_error < 1e-9
