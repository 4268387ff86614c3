"""Conserved cycles against a walk over all paths, with an account that takes part in a fifth of all transfers."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskflow import config
from riskflow.operators import graph
from riskflow.sources.shared import written

START = dt.datetime(2024, 1, 1)
SCHEMA = "row_idx long, ts timestamp, from_account string, to_account string, amount decimal(18,2), scope long"


def sample(seed, n=260, accounts=14, hub=0.2, days=40):
    r = random.Random(seed)
    names = [f"a{k}" for k in range(accounts)]
    out = []
    for k in range(n):
        a, b = r.choice(names), r.choice(names)
        if r.random() < hub:
            a, b = ("hub", b) if r.random() < 0.5 else (a, "hub")
        out.append((k, START + dt.timedelta(hours=r.randint(0, 24 * days)), a, b, Decimal(r.choice([100, 100, 104, 110, 130, 180, 900, 5])), k % 2))
    return out


def walked(rows, days, tolerance, percentile, max_hops):
    """Rings with the earliest of their paths, and how many open paths a walk onward from the first transfer makes."""
    rows = [r for r in rows if r[2] != r[3] and r[4] > 0]
    amounts = sorted(r[4] for r in rows)
    floor, found, made = amounts[int(percentile * len(amounts))] if rows else 0, {}, 0
    for seed in rows:
        if seed[4] < floor:
            continue
        open_ = [[seed]]
        while open_:
            path = open_.pop()
            made += 1
            if len(path) == max_hops:
                continue
            seen = [path[0][2], *(p[3] for p in path)]
            for n in rows:
                if n[2] == path[-1][3] and path[-1][1] <= n[1] <= seed[1] + dt.timedelta(days=days) and abs(n[4] - seed[4]) <= Decimal(str(tolerance)) * seed[4]:
                    if n[3] == seed[2]:
                        if len(path) + 1 >= config.FLOW_MIN_HOPS:
                            ring = min(">".join(seen[k:] + seen[:k]) for k in range(len(seen)))
                            ids = [p[0] for p in [*path, n]]
                            found.setdefault(ring, []).append((seed[1], ids[0], ids, n[1]))
                    elif n[3] not in seen and n[0] not in [p[0] for p in path]:
                        open_.append([*path, n])
    return {k: min(v) for k, v in found.items()}, made


@pytest.mark.parametrize(("seed", "days", "tolerance", "hops"), [(1, 10, 0.25, 6), (2, 12, 0.05, 5), (3, 10, 0.25, 3), (4, 1.5, 0.6, 5), (5, 10, 0.0, 4), (6, 4, 1.0, 3)])
def test_cycles_of_all_walks(spark, seed, days, tolerance, hops):
    rows = sample(seed, 130, accounts=8, days=16) if hops == 6 else sample(seed, 240, accounts=7, days=20)
    want, walks = walked(rows, days, tolerance, 0.6, hops)
    sizes = []

    def keep(df):
        out = written(df, "paths")
        sizes.append(out.count())
        return out

    got = graph.conserved_cycles(spark.createDataFrame(rows, SCHEMA).repartition(4), days, tolerance, 0.6, hops, 0.0, checkpoint=keep).collect()
    assert {r["ring"]: r["idxs"] for r in got} == {k: v[2] for k, v in want.items()} and want
    for r in got:
        first, _, _, last = want[r["ring"]]
        assert r["span_days"] == pytest.approx(max((last - first).total_seconds() / 86400, 0.01)) and r["hops"] == len(r["idxs"]) == len(r["accounts"])
    # sizes: the transfers that can lie on a cycle, then the open paths of each round
    print(f"{len(rows)} transfers, {sizes[0]} kept, open paths by round {sizes[1:]}, by a walk onward {walks}")
    assert sum(sizes[1:]) < walks


def test_busy_account_is_left_for_the_end(spark):
    """Everyone pays the hub and is paid by it in its turn, but only one ring exists: open paths don't multiply through the hub."""
    r = random.Random(9)
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [(k, at(r.randint(0, 48)), f"in{k}", "hub", Decimal(100), 0) for k in range(300)] + [(1000 + k, at(r.randint(48, 96)), "hub", f"out{k}", Decimal(100), 0) for k in range(300)]
    rows += [(2000, at(10), "x", "hub", Decimal(100), 0), (2001, at(60), "hub", "y", Decimal(100), 0), (2002, at(70), "y", "x", Decimal(100), 0)]
    rows += [(3000 + k, at(1), f"p{k}", f"in{k}", Decimal(100), 0) for k in range(300)] + [(4000 + k, at(120), f"out{k}", f"q{k}", Decimal(100), 0) for k in range(300)]
    sizes = []

    def keep(df):
        out = written(df, "paths")
        sizes.append(out.count())
        return out

    got = graph.conserved_cycles(spark.createDataFrame(rows, SCHEMA), checkpoint=keep).collect()
    assert [g["ring"] for g in got] == ["hub>y>x"] and sum(sizes[1:]) < 2000  # onward through the hub alone: 90,000


def test_scopes_and_no_rows(spark):
    rows = sample(12, 160)
    table = spark.createDataFrame(rows, SCHEMA)
    keep = lambda df: written(df, "paths")
    got = {(r["scope"], r["ring"]): r["idxs"] for r in graph.conserved_cycles(table, 10, 0.25, 0.6, 4, 0.0, "scope", keep).collect()}
    want = {(s, ring): v[2] for s in (0, 1) for ring, v in walked([r for r in rows if r[5] == s], 10, 0.25, 0.6, 4)[0].items()}
    assert got == want and want
    assert graph.conserved_cycles(table.limit(0), checkpoint=keep).count() == 0
    assert graph.conserved_cycles(table.where(F.lit(False)), scope="scope", checkpoint=keep).count() == 0
