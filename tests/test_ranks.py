"""Ranks, order statistics and statistics without a row's own value, against sorted lists."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskflow import config
from riskflow.operators import models, ranks, scoring

SCHEMA = "id long, k string, x double"


def sample(n=700, seed=4):
    """Keys of very different sizes, a null one among them, and many equal values."""
    r = random.Random(seed)
    return [(i, r.choice(["hot"] * 12 + ["a", "b", None]), float(r.choice([0, 0, 0, r.randint(1, 9), r.random() * 50]))) for i in range(n)] + [(n, "one", 3.0), (n + 1, "two", 1.0), (n + 2, "two", 9.0)]


def by_key(rows):
    out: dict = {}
    for i, k, x in rows:
        out.setdefault(k, []).append((x, i))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_totals(spark, keys):
    rows = sample()
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r["id"]: (r["id_before"], r["id_all"]) for r in ranks.running_totals(table, ["x", "id"], ["id"], keys).collect()}
    for group in by_key(rows).values() if keys else [sorted((x, i) for i, _, x in rows)]:
        run, whole = 0, sum(i for _, i in group)
        for _, i in group:
            assert got[i] == (run, whole)
            run += i
    down = {r["id"]: r["id_before"] for r in ranks.running_totals(table, [F.desc("x"), F.desc("id")], ["id"]).collect()}
    ordered, run = sorted(((x, i) for i, _, x in rows), reverse=True), 0
    for _, i in ordered:
        assert down[i] == run
        run += i


def test_order_statistics_and_medians(spark):
    rows = sample()
    table = spark.createDataFrame([*rows, (10**6, "hot", None)], SCHEMA)
    found = {r["k"]: r for r in ranks.order_statistics(table, "x", {"first": lambda n: F.lit(0), "third": lambda n: F.floor(n * 0.3), "beyond": lambda n: n}, ("k",)).collect()}
    middle = {r["k"]: r["median"] for r in ranks.medians(table, "x", ("k",)).collect()}
    for k, group in by_key(rows).items():
        x = [v for v, _ in group]
        assert (found[k]["n"], found[k]["first"], found[k]["third"], found[k]["beyond"]) == (len(x), x[0], x[int(len(x) * 0.3)], None)
        assert middle[k] == statistics.median(x)
    assert ranks.medians(table, "x").first()["median"] == statistics.median(x for _, _, x in rows)


def test_ranges_hold_a_hot_key_in_many_tasks(spark):
    """Half a million distinct values of one key: no task has more than its share, and the median is exact."""
    n = 500_001
    table = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    counts = table.groupBy("k", "x").agg(F.count("*").alias("_k"))
    placed = ranks.running_totals(counts, ["x"], ["_k"], ("k",))
    assert placed.where(F.col("_k_before") != F.col("x")).count() == 0
    assert ranks.medians(table, "x", ("k",)).first()["median"] == (n - 1) / 2


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 61])
def test_statistics_of_all_others(spark, n):
    for seed in range(3):
        rows = [(i, "a", x) for i, _, x in sample(n, seed)[:n]] + [(100 + i, "b", x * 2) for i, _, x in sample(n + 1, seed + 9)[: n + 1]] + [(999, "alone", 5.0)]
        got = {r["id"]: r for r in ranks.others_deviation(spark.createDataFrame(rows, SCHEMA), "x", ("k",)).collect()}
        assert len(got) == len(rows)
        for i, k, _ in rows:
            others = [x for j, key, x in rows if key == k and j != i]
            middle = statistics.median(others) if others else None
            deviation = statistics.median(abs(x - middle) for x in others) if others else None
            assert (got[i]["others"], got[i]["others_median"], got[i]["others_mad"]) == (len(others), middle, deviation)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ranks.running_totals(empty, ["x"], ["id"]).count() == 0
    assert ranks.others_deviation(empty, "x", ("k",)).count() == 0


def cohort(spark, values):
    """Long rows of accounts 1, 2, ... with the same value in every feature, and one feature more far apart."""
    rows = [(i, name, x) for i, x in enumerate(values) for name in ("p", "q")] + [(i, "far", None if i % 2 else 1000.0 * i) for i in range(len(values))]
    return spark.createDataFrame(rows, "statement_id long, name string, value double")


def test_flags_leave_the_account_out(spark):
    """Two far accounts of five: with itself in its cohort neither would stand out as far."""
    values = [1.0, 2.0, 3.0, 4.0, 30.0]
    long = cohort(spark, values).where("name <> 'far'")
    got = {r["statement_id"]: (r["n_flags"], r["flagged"], r["reason"]) for r in scoring.mad_flags(long).collect()}
    for i, x in enumerate(values):
        others = [v for j, v in enumerate(values) if j != i]
        m = statistics.median(others)
        mad = statistics.median(abs(v - m) for v in others)
        far = abs(0.6745 * (x - m) / mad) > config.ROBUST_Z
        assert got[i] == ((2, "p,q", None) if far else (0, "", None))
    assert got[4][0] == 2


def test_a_small_cohort_gives_a_reason(spark):
    long = cohort(spark, [1.0, 2.0, 300.0])  # two others each
    assert {tuple(r)[1:] for r in scoring.mad_flags(long).collect()} == {(None, None, scoring.NO_COHORT)}
    assert {tuple(r)[1:] for r in scoring.top_distances(long).collect()} == {(None, scoring.NO_COHORT)}
    apart = models.isolation_forest(spark.createDataFrame([(k, float(k)) for k in range(3)], "statement_id long, a double"), "statement_id", ["a"])
    assert {r["isolation"] for r in apart.collect()} == {None}
    assert {r["anomaly_score"] for r in scoring.anomaly_score(scoring.mad_flags(long), apart).collect()} == {0.0}
    assert scoring.mad_flags(cohort(spark, [1.0, 2.0, 3.0, 4.0])).where("n_flags is null").count() == 0


def test_top_features_are_the_farthest(spark):
    got = {r["statement_id"]: r["top_features"] for r in scoring.top_distances(cohort(spark, [1.0, 2.0, 3.0, 40.0, 5.0]), 2).collect()}
    assert got == dict.fromkeys(range(5), "far,p")  # missing values are 0: the others' median of far is 0 or 1000
    near = cohort(spark, [1.0, 2.0, 3000.0, 40.0, 5.0])
    assert {r["statement_id"]: r["top_features"] for r in scoring.top_distances(near, 1).collect()}[2] == "p"


def test_trees_draw_few_rows_of_many(spark):
    """As if there were 10^9 rows: a million of them are drawn by some 100 trees in all, and each by the trees that a chance of its own names."""
    keys = spark.range(1_000_000).select(F.col("id").cast("string").alias("key"))
    drawn = keys.select("key", F.explode(models.drawing_trees(F.col("key"), 10**9, 200, 256, 42)).alias("tree"))
    n = drawn.count()
    assert 60 < n < 150  # 102.4 are expected
    beyond = keys.select(F.size(models.drawing_trees(F.col("key"), 10**13, 200, 256, 42)).alias("n")).agg(F.max("n")).first()[0]
    assert beyond <= 1
    often = spark.range(20_000).select(F.col("id").cast("string").alias("key")).select("key", F.explode(models.drawing_trees(F.col("key"), 20_000, 200, 256, 7)).alias("tree"))
    per_tree = [r["count"] for r in often.groupBy("tree").count().collect()]
    assert len(per_tree) == 200 and 400 < min(per_tree) and max(per_tree) < 630  # 512 each
    assert often.distinct().count() == often.count()
    few = spark.range(3).select(F.col("id").cast("string").alias("key")).select(F.size(models.drawing_trees(F.col("key"), 3, 20, 256, 7)).alias("n"))
    assert {r["n"] for r in few.collect()} == {20}


def test_scores_leave_out_the_trees_that_drew_the_row(spark):
    """A far row in a small table: two thirds of the trees grow without it, and the score is the same wherever the rows lie."""
    r = random.Random(1)
    rows = [(k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(60)] + [(99, 40.0, 40.0)]
    table = spark.createDataFrame(rows, "id long, a double, b double")
    run = lambda t: {x["id"]: x["isolation"] for x in models.isolation_forest(t, "id", ["a", "b"], trees=60).collect()}
    got = run(table.repartition(1))
    assert got == run(table.repartition(6)) and got[99] == 1.0 and sum(got.values()) < 20


def test_curve_and_head_by_ranks(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 2), int(r.random() < 0.3)) for _ in range(400)]
    table = spark.createDataFrame(rows, "score double, y int")
    curve = {x["score"]: (x["precision"], x["recall"]) for x in models.pr_curve(table, "score", "y").collect()}
    for cut, (precision, recall) in curve.items():
        taken = [y for s, y in rows if s >= cut]
        assert precision == pytest.approx(sum(taken) / len(taken)) and recall == pytest.approx(sum(taken) / sum(y for _, y in rows))
    metrics = scoring.binary_metrics(table, "score", "y", 0.5).first()
    best = sorted(rows, reverse=True)[:20]
    assert metrics["lift"] == pytest.approx(sum(y for _, y in best) / 20 / (sum(y for _, y in rows) / 400))
