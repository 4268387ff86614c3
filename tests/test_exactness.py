"""Whole tables, and results at limits that don't depend on how the rows are dealt."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from riskflow.operators import features, graph, patterns, scoring

TXN = "statement_id long, row_index long, row_id string, ts timestamp, txn_date date, debit decimal(18,2), credit decimal(18,2), counterparty string, narration string, reference_no string, balance decimal(18,2)"


def txns(spark, rows):
    """rows: days after 1 January, debit, credit, counterparty."""
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(d)
    money = lambda x: None if x is None else Decimal(str(x))
    return spark.createDataFrame([(1, k, str(k), at(d), at(d).date(), money(debit), money(credit), who, "x", "r", None) for k, (d, debit, credit, who) in enumerate(rows)], TXN)


def test_dataset_holds_every_account(spark):
    text = lambda letter: F.concat(F.lit(letter), "id")
    t = spark.range(30_001).select(
        F.col("id").alias("row_idx"), F.timestamp_seconds("id").alias("ts"), text("U").alias("from_account"), text("V").alias("to_account"), F.lit(1).cast("decimal(18,2)").alias("amount"), (F.col("id") == 0).alias("labelled")
    )
    found = features.account_dataset(t)
    assert found.select("account_id").distinct().count() == found.count() == 60_002
    capped = features.account_dataset(t, cap=3)
    assert capped.select("account_id").distinct().count() == 3 and {r["account_id"] for r in capped.where("label").collect()} == {"U0", "V0"}


def test_scores_at_half_a_tenth_go_up(spark):
    points = spark.range(21).select((5 * F.col("id")).alias("p"))
    got = points.select(F.round(scoring.fuse(F.col("p"), F.lit(0.0)), 1), F.round(scoring.fuse(F.col("p"), F.lit(0.0), F.lit(None).cast("double")), 1), ((65 * F.col("p")).cast("decimal(9,0)") / 100).cast("decimal(9,1)").cast("double")).collect()
    assert all(a == b == exact for a, b, exact in got)


def test_features_have_the_decimals_that_they_are_stated_with(spark):
    found = features.all_features(txns(spark, [(0, None, 3, "a"), (0.1, 1, None, "b"), (0.2, 2, 1, "c")])).first()
    assert found["net_retention_ratio"] == 0.75 and found["counterparty_concentration_hhi"] == round((9 + 1 + 9) / 49, 9)
    third = features.all_features(txns(spark, [(0, None, 3, "a"), (0.1, 1, None, "b")])).first()
    assert third["net_retention_ratio"] == 0.666666667 and third["benford_deviation_score"] == 0


def test_rounding_takes_the_product(spark):
    values = [0.2504145, 0.6174595, -0.6174595, 2.5e-7, 5e-7, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(features.half_up(F.col("v"), 6)).collect()]
    assert got == [0.250414, 0.61746, -0.61746, 0.0, 1e-6, 1e300, None]  # as DuckDB's round has them


def dealt(df, n):
    """The same rows in another order over n tasks."""
    return df.repartition(n, F.xxhash64("row_id", F.lit(n)))


def test_structuring_risks_are_summed_in_the_order_of_rows(spark):
    r = random.Random(4)
    amounts = [10 * r.randint(4500, 5000) for _ in range(40)]
    t = txns(spark, [(k / 10, a, None, "a") for k, a in enumerate(amounts)])
    mean = 0.0
    for a in amounts:
        mean += a / 50_000
    risk = 0.5 + 0.5 * max(0.0, min((mean / 40 - 0.9) / 0.1, 1.0))
    assert {patterns.structuring_patterns(dealt(t, n)).first()["risk"] for n in (1, 2, 3, 5)} == {risk}


def test_cycles_are_scored_in_the_order_of_rows(spark):
    r = random.Random(6)
    amounts = [float(r.randint(10, 2000)) + r.randint(0, 99) / 100 for _ in range(40)]
    t = txns(spark, [(k / 4, a, None, "a") if k % 2 else (k / 4, None, a, "a") for k, a in enumerate(amounts)])
    n = mean = square = total = 0.0
    for x in amounts:
        n, before, total = n + 1, mean, total + x
        mean = before + (x - before) / n
        square += (x - mean) * (x - before)
    want = 1 - math.sqrt(square / (n - 1)) / (total / n)
    assert {graph.star_cycles(dealt(t, n), 0.0).first()["conservation"] for n in (1, 2, 3, 5)} == {want}
