"""Decisions, evidence records, reasons and confidence of small accounts."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskflow import config
from riskflow.operators import evidence as ev
from riskflow.operators import features as f
from riskflow.operators import quality, scoring

FEATURES = "statement_id long, " + ", ".join(f"{n} double" for n in scoring.NAMES)


def features(spark, *rows):
    """rows: statement_id and what isn't null."""
    return spark.createDataFrame([(i, *(v.get(n) for n in scoring.NAMES)) for i, v in rows], FEATURES)


SUSPECT = {"net_retention_ratio": 0.05, "turnover_ratio": 12.0, "dormancy_breaks": 2.0, "near_threshold_ratio": 0.4, "benford_deviation_score": 20.0, "max_cycle_risk_score": 0.9, "fan_in_score": 0.1}


def decided(spark, cases):
    """cases: statement_id, features, anomaly, extraction and a model's probability."""
    table = features(spark, *((i, v) for i, v, *_ in cases))
    anomaly = spark.createDataFrame([(i, a) for i, _, a, *_ in cases], "statement_id long, anomaly_score double")
    rates = spark.createDataFrame([(i, {"high": 1.0, "medium": 0.9, "low": 0.5}[e], e) for i, _, _, e, _ in cases], "statement_id long, rate double, extraction string")
    model = spark.createDataFrame([(i, p) for i, *_, p in cases], "statement_id long, probability double")
    return ev.decisions(ev.fired_rules(table), anomaly, rates, model)


def test_decisions(spark):
    cases = [(1, SUSPECT, 0.6, "high", None), (2, SUSPECT, 0.6, "low", None), (3, {}, 0.1, "high", None), (4, {}, 0.4, "high", None), (5, {}, 0.1, "low", None), (6, SUSPECT, 0.1, "high", 0.25), (7, {"dormancy_breaks": 1.0}, 0.9, "medium", None)]
    got = {r["statement_id"]: r for r in decided(spark, cases).collect()}
    assert [got[i]["rule_score"] for i in range(1, 8)] == [100, 100, 0, 0, 0, 100, 15]
    assert [got[i]["score"] for i in range(1, 8)] == [86.0, 86.0, 3.5, 14.0, 3.5, 51.3, 41.3]  # 40 + 2.5 + 8.75 is 51.25, 9.75 + 31.5 is 41.25
    assert [got[i]["tier"] for i in range(1, 8)] == ["CONFIRMED_SUSPICIOUS", "REVIEW_REQUIRED", "LIKELY_LEGITIMATE", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "REVIEW_REQUIRED"]
    reasons = [got[i]["decision_reason"] for i in range(1, 8)]
    assert reasons[0] == "Fused risk score (86.0 >= 75) with active regulatory fraud rules triggered."
    assert reasons[1] == "Low statement extraction confidence requires human verification before account clearance." == reasons[4]
    assert reasons[2].startswith("Fused score (3.5 <= 25)") and "(10.0% < 30%)" in reasons[2]
    assert reasons[3].startswith("0 deterministic rules triggered (Rule Score: 0.0)") and "(40.0%)" in reasons[3]
    assert reasons[5] == "Ambiguous risk score (51.3) between thresholds (25 - 75) requires human auditor sign-off."
    assert got[6]["formula"].endswith("0.35*supervised_probability") and got[1]["formula"].endswith("(no supervised model active)")
    first = got[1]["rules"][0]
    assert (first["id"], first["points"], first["joiner"], first["computed_value"]) == ("R1_low_retention_high_turnover", 25, "AND", 0.05)
    assert [(c["field"], c["op"], c["threshold"], c["actual"], c["holds"]) for c in first["clauses"]] == [("net_retention_ratio", "<", 0.15, 0.05, True), ("turnover_ratio", ">", 8.0, 12.0, True)]
    assert [r["id"][:2] for r in got[1]["rules"]] == ["R1", "R2", "R3", "R4", "R5"]


def test_breakdown(spark):
    done = decided(spark, [(1, SUSPECT, 0.6, "high", None), (2, {"dormancy_breaks": 1.0, "near_threshold_ratio": 0.5}, 0.5, "high", 0.5), (3, {}, 0.0, "high", None)])
    got = {(r["statement_id"], r["component"]): r for r in ev.score_breakdown(done).collect()}
    assert (got[1, "rules"]["points"], got[1, "anomaly"]["points"]) == (65.0, 21.0) and (1, "model") not in got
    assert got[1, "R5_circular_flow_detected"]["share"] == pytest.approx(30 / 100 * 65 / 86 * 100, abs=0.05)
    total = 14 + 12.5 + 17.5
    assert got[2, "model"]["points"] == 17.5 and got[2, "rules"]["share"] == pytest.approx(14 / total * 100, abs=0.05)
    assert got[2, "R3_structuring_near_threshold"]["share"] == pytest.approx(20 / 35 * 14 / total * 100, abs=0.05)
    assert got[3, "rules"]["share"] == got[3, "anomaly"]["share"] == 0.0


def rows(spark, statement_id, n, who=lambda k: f"c{k % 4}"):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=30 * k)
    data = [(statement_id, k, f"{statement_id}-{k}", day(k), day(k).date(), Decimal(100 + k) if k % 2 else None, None if k % 2 else Decimal(200 + k), who(k), "UPI/x", "ref", None) for k in range(n)]
    return spark.createDataFrame(data, "statement_id long, row_index long, row_id string, ts timestamp, txn_date date, debit decimal(18,2), credit decimal(18,2), counterparty string, narration string, reference_no string, balance decimal(18,2)")


PATTERNS = "statement_id long, kind string, pattern_id string, risk double, severity string, rank int, row_ids array<string>"
CYCLES = "statement_id long, counterparty string, conservation double, span_days double, risk double, row_ids array<string>, dense boolean"


def test_reasons(spark):
    t = rows(spark, 1, 12).unionByName(rows(spark, 2, 9)).unionByName(rows(spark, 3, 3))
    found = spark.createDataFrame([(1, "structuring", "p1", 0.8, "HIGH", 2, [f"1-{k}" for k in range(8)]), (1, "structuring", "p0", 0.6, "MEDIUM", 5, ["1-9", "1-10"]), (1, "cycle", "p2", 0.9, "CRITICAL", 1, ["1-3", "1-1"]), (2, "dormancy", "p3", 0.5, "MEDIUM", 1, ["2-4", "2-5"])], PATTERNS)
    values = features(spark, (1, {"inflow_outflow_velocity": 1.0, "net_retention_ratio": 0.9}), (2, {"round_number_ratio": 0.5, "inflow_outflow_velocity": 9.0}), (3, {}))
    cycles = spark.createDataFrame([(3, "c1", 0.9, 3.0, 0.7, ["3-1"], False), (1, "c1", 0.9, 3.0, 0.7, ["1-1"], False), (2, None, 0.0, 0.0, 0.0, None, True)], CYCLES)
    got = {(r["statement_id"], r["reason"]): r for r in ev.reasons_with_rows(found, t, values, cycles).collect()}
    assert set(got) == {(1, "amounts"), (1, "circular"), (1, "connections"), (2, "dormancy"), (2, "amounts"), (2, "velocity"), (2, "connections"), (3, "circular")}
    assert got[1, "amounts"]["row_ids"] == ["1-6", "1-4", "1-2", "1-0", "1-7"] and (got[1, "amounts"]["withheld"], got[1, "amounts"]["n_patterns"], got[1, "amounts"]["severity"]) == (3, 2, "HIGH")  # the largest first
    assert got[1, "circular"]["row_ids"] == ["1-3", "1-1"] and got[1, "circular"]["severity"] == "CRITICAL"
    assert got[2, "amounts"]["row_ids"] == ["2-8", "2-6", "2-4", "2-2", "2-0"] and got[2, "amounts"]["withheld"] == 4
    assert got[2, "velocity"]["row_ids"] == ["2-0"] and got[2, "velocity"]["severity"] == "MEDIUM"  # 30 hours between rows
    assert got[3, "circular"]["severity"] == "HIGH" and got[3, "circular"]["row_ids"] == []
    assert got[1, "connections"]["severity"] == "HIGH" and got[2, "connections"]["severity"] == "MEDIUM"
    links = {r["counterparty"]: r for r in ev.counterparties_on_patterns(found.where("statement_id = 2"), t).collect()}
    assert (links["c0"]["n"], links["c0"]["inflow"], links["c0"]["outflow"], links["c0"]["rank"]) == (3, 612.0, 0.0, 1)  # rows off the pattern count

    anomaly = spark.createDataFrame([(1, (None, {})), (2, (1.0, {"a": 5.0, "b": 6.0, "c": -7.0})), (3, (0.0, {}))], "statement_id long, anomaly struct<isolation_forest_score:double,flags:map<string,double>>")
    done = decided(spark, [(1, SUSPECT, 0.2, "high", None), (2, {}, 0.5, "high", None), (3, {"dormancy_breaks": 1.0}, 0.0, "high", None)])
    ranked = {(r["statement_id"], r["reason"]): r for r in ev.ranked_reasons(ev.reasons_with_rows(found, t, values, cycles), anomaly, done).collect()}
    assert ranked[1, "amounts"]["rules"] == "R3_structuring_near_threshold,R4_benford_anomaly" and ranked[1, "amounts"]["rule_points"] == 30
    assert ranked[1, "circular"]["severity"] == "CRITICAL" and (ranked[1, "circular"]["rank"], ranked[1, "amounts"]["rank"]) == (2, 1) or ranked[1, "circular"]["rank"] == 1
    assert (1, "statistical") not in ranked and ranked[1, "velocity"]["row_ids"] is None  # by its rule alone
    assert (ranked[2, "statistical"]["severity"], ranked[2, "statistical"]["share"], ranked[2, "statistical"]["rank"]) == ("HIGH", 100.0, 1)
    assert (ranked[3, "dormancy"]["rank"], ranked[3, "dormancy"]["share"], ranked[3, "dormancy"]["severity"]) == (1, 100.0, "MEDIUM")


def bundle(spark):
    done = decided(spark, [(1, SUSPECT, 0.6, "high", None), (2, {}, 0.0, "medium", None)])
    cycles = spark.createDataFrame([(1, "c9", 0.987, 3.0, 0.7, ["1-1"], False), (1, "c1", 0.5, 3.0, 0.8, ["1-2", "1-3"], False)], CYCLES)
    facts = spark.createDataFrame([(1, "2024-01-01", "2024-02-01", 40, 1.0, "high", 0.9, False), (2, None, None, 0, 0.9, "medium", 0.4, True)], "statement_id long, start string, end string, n long, rate double, extraction string, ood double, manual_mapping boolean")
    long = spark.createDataFrame([(i, n, v) for i, v in ((1, 5.0), (2, 1.0), (3, 2.0), (4, 3.0), (5, 4.0)) for n in ("a", "b")], "statement_id long, name string, value double")
    none = spark.createDataFrame([(1, 1.0), (2, 0.0)], "statement_id long, isolation double")
    details = ev.anomaly_details(scoring.against_others(long), none, scoring.top_distances(long))
    return ev.evidence_bundle(facts, done, f.feature_evidence(features(spark, (1, SUSPECT))), ev.ranked_cycles(cycles), details)


def test_bundle_and_what_leaves_it(spark):
    made = bundle(spark)
    got = {r["statement_id"]: json.loads(r["j"]) for r in made.select("statement_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()}
    one, two = got[1], got[2]
    assert [c["cycle_id"] for c in one["cycles_detected"]] == ["C1", "C2"] and one["cycles_detected"][0]["nodes"] == ["ACCT_1", "c1"] and one["cycles_detected"][0]["contributing_row_ids"] == ["1-2", "1-3"]
    assert len(one["features"]) == len(f.FEATURES) and next(x for x in one["features"] if x["name"] == "turnover_ratio")["formula"] == f.FORMULAS["turnover_ratio"][0]
    assert one["guardrail_log"] == {"ood_check_passed": True, "ood_score": 0.9, "reconciliation_rate": 1.0, "extraction_confidence": "high", "manual_mapping_used": False}
    assert two["guardrail_log"]["ood_check_passed"] is False and two["cycles_detected"] == [] and two["features"] == [] and two["triggered_rules"] == []
    assert one["anomaly_detail"]["reference_cohort_size"] == 4 and one["anomaly_detail"]["availability_reason"] is None and one["anomaly_detail"]["top_contributing_features"] == ["a", "b"]
    assert one["final_decision"]["thresholds_applied"] == {"T_high": 75, "T_low": 25} and one["supervised_detail"]["fallback_reason"] == "no_model_enabled"
    left = {r["statement_id"]: r for r in ev.redacted_projection(made).collect()}
    text = json.dumps(left[1].asDict(True), default=str)
    assert len(left[1]["triggered_rules"]) == 3 and len(left[1]["cycles"]) == 2 and left[1]["analysis"]["fused_score"] == 86.0 and left[2]["limitations"]["manual_mapping_used"] is True
    assert not any(x in text for x in ("ACCT_", "c9", "1-2", "2024-01-01", "average_daily_balance"))
    told = {r["statement_id"]: r["text"] for r in ev.narrative(made).collect()}
    assert "R1_low_retention_high_turnover (25 pts), R2_dormancy_then_burst (15 pts), R3_structuring_near_threshold (20 pts). Detected cycles: 2-hop cycle with 50% amount conservation; 2-hop cycle with 99% amount conservation. " in told[1]
    assert "observed over unknown to unknown (0 transactions, extracted with 90.0% confidence)" in told[2] and "none triggered. This is" in told[2]


def test_confidence(spark):
    done = decided(spark, [(1, SUSPECT, 0.6, "high", 0.9), (2, {}, 0.0, "high", None), (3, SUSPECT, 0.0, "low", None)])
    fit = spark.createDataFrame([(1, 0.8), (2, None), (3, 0.6)], "statement_id long, ood double")
    found = spark.createDataFrame([(1, 2, 0), (3, None, 4)], "statement_id long, n_cycles long, n_flags long")
    for model in (False, True):
        got = {r["statement_id"]: r for r in ev.confidence(done.join(fit, "statement_id"), found, model).collect()}
        score = done.where("statement_id = 1").first()["score"]
        one = 0.35 + 0.25 * 0.8 + 0.25 * (score - 75) / 25 + 0.15 * (3 / 4 if model else 2 / 3)
        assert got[1]["confidence"] == pytest.approx(100 * one, abs=0.06)
        assert got[2]["confidence"] == pytest.approx(100 * (0.35 + 0 + 0.25 + 0.15), abs=0.06)
        assert got[3]["corroboration"] == pytest.approx(2 / 4 if model else 2 / 3) and got[3]["decision_margin"] == pytest.approx(10 / 25)


def test_grids_with_ragged_rows(spark):
    cells = [("a", r, c, v) for r in range(4) for c, v in enumerate((f"0{r + 1}/01/2024", f"payment number {r} to someone", "", str(100 * r), str(1000 + 10 * r)))] + [("b", 0, 0, "x"), ("b", 1, 0, None), ("b", 2, 3, "7")]
    texts = [("a", "IFSC SBIN0001234 Statement of Account Bank", 4), ("b", "", 3), ("c", None, 0)]
    got = {r["file_id"]: r for r in quality.ood_score(spark.createDataFrame(cells, "file_id string, row int, col int, value string"), spark.createDataFrame(texts, "file_id string, text string, n_rows long")).collect()}
    assert got["a"]["tier"] == "auto_proceed" and got["c"]["score"] == 0 and got["c"]["tier"] == "hard_reject" and got["b"]["date"] == 0
    reasons = {r["file_id"]: r["reasons"] for r in quality.ood_failure_reasons(spark.createDataFrame([tuple(r) for r in got.values()], "file_id string, " + ", ".join(f"{k} double" for k in config.OOD_WEIGHTS) + ", score double, tier string")).collect()}
    assert "date" in reasons["b"]
