"""Greedy matching and bursts against scans of lists, with accounts cut into pieces, and with one very busy account."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskflow.operators import features, patterns, ranks

SCHEMA = "statement_id long, row_id string, row_index long, ts timestamp, txn_date date, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), counterparty string, narration string, reference_no string"
START = dt.datetime(2024, 1, 1)


def rows(seed, n=260, accounts=4, whole_days=False):
    """Runs of activity with silences between them; equal times, rows with both legs or none."""
    r, out = random.Random(seed), []
    for account in range(accounts):
        at = START
        for k in range(n):
            at += dt.timedelta(days=r.choice([0] * 8 + [1, 1, 2, 3, 5, 35, 60])) if whole_days else dt.timedelta(hours=r.choice([0, 0, 1, 1, 2, 5, 12, 24, 25, 80]))
            kind = r.random()
            debit, credit = (r.randint(1, 40) if kind < 0.55 else None), (r.randint(1, 40) if kind > 0.5 else None)
            out.append((account, f"{account}-{k:04d}", k, at, at.date(), debit, credit, None, "c", None, None) if r.random() < 0.97 else (account, f"{account}-{k:04d}", k, at, at.date(), None, None, None, None, None, None))
    return out


def table(spark, data):
    from decimal import Decimal

    money = lambda x: None if x is None else Decimal(x)
    return spark.createDataFrame([(*r[:5], money(r[5]), money(r[6]), *r[7:]) for r in data], SCHEMA).repartition(5)


def accounts(data):
    out: dict = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[3], r[2])) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_end_at_silences(spark, seed):
    data = rows(seed, whole_days=True)
    t = table(spark, data).select("statement_id", "row_index", F.unix_date("txn_date").alias("day"))
    got = {(r["statement_id"], r["row_index"]): r["piece"] for r in ranks.cut_at_gaps(t, "day", 2, ["row_index"], ("statement_id",)).collect()}
    for account, own in accounts(data).items():
        piece, last = None, None
        for r in own:
            day = (r[4] - dt.date(1970, 1, 1)).days
            piece = day if last is None or day - last > 2 else piece
            last = day
            assert got[account, r[2]] == piece


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_debits_within_a_day(spark, seed):
    data = rows(seed)
    want = Counter()
    for account, own in accounts(data).items():
        used = set()
        for c in own:
            if c[6]:
                for d in own:
                    if d[5] and d[1] not in used and c[3] < d[3] <= c[3] + dt.timedelta(hours=24):
                        used.add(d[1])
                        want[account, float(d[5]), (d[3] - c[3]).total_seconds() / 3600] += 1
                        break
    assert Counter(tuple(r) for r in features.matched_debits(table(spark, data)).collect()) == want and want


@pytest.mark.parametrize("hold", [0, 1, 3])
def test_layers(spark, hold):
    data = rows(7 + hold, whole_days=True)
    want = set()
    for own in accounts(data).values():
        used = set()
        for c in own:
            if c[6]:
                for d in own:
                    if d[5] and d[1] not in used and 0 <= (d[4] - c[4]).days <= hold and min(c[6], d[5]) / max(c[6], d[5]) >= 0.6:
                        used.add(d[1])
                        want.add((c[1], d[1], min(c[6], d[5]) / max(c[6], d[5]), float((d[4] - c[4]).days), float(max(c[6], d[5])), float(c[6] + d[5])))
                        break
    assert {tuple(r)[1:] for r in patterns.layering_matches(table(spark, data), hold).collect()} == want and want


@pytest.mark.parametrize(("gap", "least", "days"), [(30, 3, 3), (1, 2, 3), (0, 2, 4), (2, 1, 1), (4, 5, 9)])
def test_bursts(spark, gap, least, days):
    data = rows(11, whole_days=True)
    want = {}
    for own in accounts(data).values():
        own = [r for r in own if r[5] or r[6]]
        i = 1
        while i < len(own):
            burst = [r for r in own[i:] if (r[4] - own[i][4]).days <= days]
            silent = (own[i][4] - own[i - 1][4]).days
            if silent > gap and len(burst) >= least:
                want[f"dormancy:{own[i][1]}"] = (0.5 * min(silent / 90, 1) + 0.5 * min(len(burst) / 6, 1), float(sum(max(r[5] or 0, r[6] or 0) for r in burst)), [r[1] for r in burst])
                i += len(burst) + 1
            else:
                i += 1
    got = {r["pattern_id"]: (r["risk"], r["total"], r["row_ids"]) for r in patterns.dormancy_patterns(table(spark, data), gap, least, days).collect()}
    assert got.keys() == want.keys() and want
    for k, (risk, total, ids) in want.items():
        assert got[k][0] == pytest.approx(risk) and got[k][1] == total and got[k][2] == ids


def test_no_rows(spark):
    empty = table(spark, [])
    assert features.matched_debits(empty).count() == patterns.layering_matches(empty).count() == patterns.dormancy_patterns(empty).count() == 0
    undated = table(spark, [(1, "a", 1, None, None, 5, None, None, None, None, None)])
    assert features.matched_debits(undated).count() == patterns.layering_matches(undated).count() == patterns.dormancy_patterns(undated).count() == 0


def test_an_account_of_a_million_rows(spark):
    """Without any silence: it is one piece, and each row costs a logarithm of its day."""
    n, per_day = 1_000_000, 50_000
    at = F.expr(f"timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 86400.0 / {per_day})")
    hub = spark.range(n).select(
        F.lit(1).cast("long").alias("statement_id"), F.col("id").cast("string").alias("row_id"), F.col("id").alias("row_index"), at.alias("ts"), F.to_date(at).alias("txn_date"),
        F.when(F.col("id") % 2 == 1, 1 + F.pmod(F.xxhash64("id"), F.lit(5000))).cast("decimal(18,2)").alias("debit"), F.when(F.col("id") % 2 == 0, 1 + F.pmod(F.xxhash64("id"), F.lit(5000))).cast("decimal(18,2)").alias("credit"), F.lit("c").alias("counterparty"),
    )
    matched = features.matched_debits(hub).agg(F.count("*").alias("n"), F.max("held_hours").alias("h")).first()
    assert matched["n"] == n // 2 and matched["h"] < 0.01
    pairs = patterns.layering_matches(hub).agg(F.count("*").alias("n"), F.count_distinct("debit_row").alias("d"), F.min("near").alias("near")).first()
    assert n * 0.45 < pairs["n"] == pairs["d"] <= n // 2 and pairs["near"] >= 0.6
    assert patterns.dormancy_patterns(hub).count() == 0
