"""What a decision rests on: rules with their clauses, cycles, anomalies and reasons with sample rows, as nested records of each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .features import ID
from .patterns import amounts, peak_velocity_rows, points_severity, severity_rank
from .scoring import NO_COHORT, clause, condition, decide_tier, fuse

#: Rows and counterparties shown with a reason; the rest is counted.
SHOWN = 5
#: Which reason a rule speaks for; a rule whose reason has no evidence of its own becomes a reason (fixed values).
REASON_OF_RULE = {
    "R5_circular_flow_detected": "circular", "R1_low_retention_high_turnover": "velocity", "R3_structuring_near_threshold": "amounts",
    "R4_benford_anomaly": "amounts", "R2_dormancy_then_burst": "dormancy", "R6_fan_in_fan_out": "connections",
}
REASON_OF_KIND = {"cycle": "circular", "layering": "velocity", "structuring": "amounts", "dormancy": "dormancy"}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def fired_rules(features: DataFrame, rules=config.RULES) -> DataFrame:
    """statement_id, rules: those that fired, in their order, with points, condition, joiner and every clause's threshold, value and outcome."""
    found = []
    for name, points, text in rules:
        joiner = "AND" if " AND " in text else "OR"
        parts = [clause(part) for part in text.split(f" {joiner} ")]
        clauses = F.array(*(F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), limit.cast("double").alias("threshold"), F.col(field).cast("double").alias("actual"), held.alias("holds")) for field, op, limit, held in parts))
        record = F.struct(F.lit(name).alias("id"), F.lit(points).alias("points"), F.lit(text).alias("condition"), F.lit(joiner).alias("joiner"), F.col(parts[0][0]).cast("double").alias("computed_value"), clauses.alias("clauses"))
        found.append(F.when(condition(text), record))
    return features.select(ID, F.filter(F.array(*found), lambda r: r.isNotNull()).alias("rules"))


def decisions(rules: DataFrame, anomaly: DataFrame, rates: DataFrame, probability: DataFrame | None = None) -> DataFrame:
    """statement_id, rules, rule_score, anomaly_score, probability, score (one decimal), formula, tier and decision_reason.

    Args:
        rules: from :func:`fired_rules`. anomaly: anomaly_score. rates: rate and extraction (its tier). probability: a model's, null
            where its gate is shut.
    """
    both = rules.join(anomaly, ID).join(rates, ID)
    both = both.join(probability.select(ID, "probability"), ID, "left") if probability is not None else both.withColumn("probability", F.lit(None).cast("double"))
    points = F.least(F.lit(100), F.aggregate("rules", F.lit(0), lambda a, r: a + r["points"])).cast("long")
    done = both.withColumn("rule_score", points)
    done = done.withColumn("score", F.round(fuse(F.col("rule_score"), F.col("anomaly_score"), F.col("probability")), 1))
    w, wo = config.FUSE_WITH, config.FUSE_WITHOUT
    formula = F.when(F.col("probability").isNotNull(), f"{w[0]}*rule_score + {w[1]}*anomaly_score + {w[2]}*supervised_probability").otherwise(f"{wo[0]}*rule_score + {wo[1]}*anomaly_score (no supervised model active)")
    fired = F.concat_ws(",", F.transform("rules", lambda r: r["id"]))
    tier = decide_tier(F.col("score"), fired, F.col("anomaly_score"), F.col("extraction"))
    return done.withColumns({"formula": formula, "fired": fired, "tier": tier}).withColumn("decision_reason", decision_reason())


def decision_reason() -> Column:
    """Why an account is in its tier, in the order in which tiers are decided (wording fixed)."""
    high, low = config.CONFIRMED_MIN, config.LEGITIMATE_MAX
    score, anomaly = F.col("score"), F.col("anomaly_score") * 100
    return (
        F.when(F.col("tier") == "CONFIRMED_SUSPICIOUS", F.format_string(f"Fused risk score (%.1f >= {high}) with active regulatory fraud rules triggered.", score))
        .when(F.col("tier") == "LIKELY_LEGITIMATE", F.format_string(f"Fused score (%.1f <= {low}) with 0 severe rules triggered and normal anomaly sub-score (%.1f%% < 30%%).", score, anomaly))
        .when((score <= low) & (F.col("anomaly_score") >= config.ANOMALY_LOW), F.format_string("0 deterministic rules triggered (Rule Score: %.1f), but statistical anomaly sub-score (%.1f%%) exceeded the strict auto-clear threshold (< 30.0%%).", F.col("rule_score").cast("double"), anomaly))
        .when(F.col("extraction") == "low", "Low statement extraction confidence requires human verification before account clearance.")
        .otherwise(F.format_string(f"Ambiguous risk score (%.1f) between thresholds ({low} - {high}) requires human auditor sign-off.", score))
    )


def ranked_cycles(cycles: DataFrame) -> DataFrame:
    """statement_id, cycles: an account's cycles by falling risk, named C1, C2 and so on; the edge cap bounds how many there are."""
    order = F.struct((-F.col("risk")).alias("order"), "counterparty", "conservation", "span_days", "risk", "row_ids")
    found = cycles.groupBy(ID).agg(F.array_sort(F.collect_list(order)).alias("c"))
    record = lambda c, k: F.struct(
        F.concat(F.lit("C"), k + 1).alias("cycle_id"), F.array_compact(F.array(F.concat(F.lit("ACCT_"), F.col(ID)), c["counterparty"])).alias("nodes"), F.when(c["counterparty"].isNull(), 0).otherwise(2).alias("hop_count"),
        c["conservation"].alias("amount_conservation_ratio"), c["span_days"].alias("cycle_span_days"), c["risk"].alias("cycle_risk_score"), F.coalesce(c["row_ids"], F.array().cast("array<string>")).alias("contributing_row_ids"),
    )
    return found.select(ID, F.transform("c", record).alias("cycles"))


def anomaly_details(against: DataFrame, isolation: DataFrame, top: DataFrame, limit: float = config.ROBUST_Z) -> DataFrame:
    """statement_id, anomaly: isolation, the farthest features, flagged features with their z (four decimals), seed, cohort and reason."""
    far = F.abs("z") > limit
    flags = against.groupBy(ID).agg(F.min("others").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.when(far, F.struct("name", F.round("z", 4).alias("z")))))).alias("flags"))
    both = flags.join(isolation.select(ID, "isolation"), ID, "left").join(top.select(ID, "top_features"), ID, "left")
    short = F.col("n") < config.LEAST_COHORT
    none = F.array().cast("array<string>")
    record = F.struct(
        F.col("isolation").alias("isolation_forest_score"), F.when(short, none).otherwise(F.coalesce(F.split("top_features", ","), none)).alias("top_contributing_features"), "flags", F.lit(42).alias("seed"),
        F.when(short, NO_COHORT).alias("availability_reason"), F.col("n").alias("reference_cohort_size"), F.lit(config.LEAST_COHORT).alias("minimum_reference_cohort_size"),
    )
    return both.select(ID, record.alias("anomaly"))


def evidence_bundle(facts: DataFrame, decided: DataFrame, features: DataFrame, cycles: DataFrame, anomaly: DataFrame) -> DataFrame:
    """One nested record per account.

    Args:
        facts: start, end, n (transactions), rate, extraction, ood and manual_mapping of each statement.
        decided: from :func:`decisions`. features: name, value, family, formula, explanation. cycles: from :func:`ranked_cycles`.
        anomaly: from :func:`anomaly_details`; an account without one has a null detail, one without cycles or features empty lists.
    """
    listed = features.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("name", "value", "formula", "explanation", "family"))).alias("features"))
    keep = ["rules", "rule_score", "anomaly_score", "probability", "score", "formula", "tier", "decision_reason"]
    all_ = facts.join(decided.select(ID, *keep), ID).join(listed, ID, "left").join(cycles, ID, "left").join(anomaly, ID, "left")
    period = F.struct(F.coalesce("start", F.lit("")).alias("start"), F.coalesce("end", F.lit("")).alias("end"))
    kind = dict(all_.select("features", "cycles").dtypes)
    listed_or_none = lambda c: F.coalesce(c, F.array().cast(kind[c])).alias({"cycles": "cycles_detected"}.get(c, c))
    thresholds = F.struct(F.lit(config.CONFIRMED_MIN).alias("T_high"), F.lit(config.LEGITIMATE_MAX).alias("T_low"))
    missing = F.col("probability").isNull()
    return all_.select(
        ID,
        F.struct(F.col(ID).cast("string").alias("statement_id"), period.alias("observed_period"), F.col("rate").alias("extraction_confidence"), F.col("ood").alias("statement_likelihood_score"), F.col("n").alias("transaction_count")).alias("account_summary"),
        F.struct("tier", F.col("score").alias("fused_score"), F.col("formula").alias("score_formula_used"), thresholds.alias("thresholds_applied"), "rule_score", "anomaly_score", "decision_reason").alias("final_decision"),
        F.col("rules").alias("triggered_rules"), listed_or_none("features"), listed_or_none("cycles"), F.col("anomaly").alias("anomaly_detail"),
        F.struct(F.col("probability").alias("calibrated_probability"), F.when(~missing, "supervised").alias("model_type"), F.lit(False).alias("contributions_available"), F.when(missing, "no_model_enabled").alias("fallback_reason")).alias("supervised_detail"),
        F.struct((F.col("ood") >= 0.5).alias("ood_check_passed"), F.col("ood").alias("ood_score"), F.col("rate").alias("reconciliation_rate"), F.col("extraction").alias("extraction_confidence"), F.col("manual_mapping").alias("manual_mapping_used")).alias("guardrail_log"),
    )


def redacted_projection(bundle: DataFrame) -> DataFrame:
    """statement_id and facts that identify nobody: counts, tier and score, three rules and cycles as numbers, what was lacking."""
    s, d = F.col("account_summary"), F.col("final_decision")
    analysis = F.struct(s["transaction_count"].alias("transaction_count"), s["extraction_confidence"].alias("extraction_confidence"), d["tier"].alias("risk_tier"), d["fused_score"].alias("fused_score"))
    rules = F.transform(F.slice("triggered_rules", 1, 3), lambda r: F.struct(r["id"].alias("id"), r["points"].alias("points")))
    cycles = F.transform(F.slice("cycles_detected", 1, 3), lambda c: F.struct(c["hop_count"].alias("hop_count"), c["amount_conservation_ratio"].alias("amount_conservation_ratio"), c["cycle_risk_score"].alias("cycle_risk_score")))
    limits = F.struct(F.col("anomaly_detail.availability_reason").alias("anomaly_availability"), F.col("guardrail_log.manual_mapping_used").alias("manual_mapping_used"))
    return bundle.select(ID, analysis.alias("analysis"), rules.alias("triggered_rules"), cycles.alias("cycles"), limits.alias("limitations"))


def listed_facts() -> tuple[Column, Column]:
    """The first three rules and cycles of a bundle in words (wording fixed)."""
    rules = F.concat_ws(", ", F.transform(F.slice("triggered_rules", 1, 3), lambda r: F.concat(r["id"], F.lit(" ("), r["points"], F.lit(" pts)"))))
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("int"), F.lit("%"))
    cycles = F.concat_ws("; ", F.transform(F.slice("cycles_detected", 1, 3), lambda c: F.concat(c["hop_count"], F.lit("-hop cycle with "), percent(c["amount_conservation_ratio"]), F.lit(" amount conservation"))))
    return F.when(rules == "", "none triggered").otherwise(rules), F.when(cycles == "", "").otherwise(F.concat(F.lit("Detected cycles: "), cycles, F.lit(". ")))


def narrative(bundle: DataFrame) -> DataFrame:
    """statement_id, text: the same words for the same bundle (wording fixed)."""
    rules, cycles = listed_facts()
    s, d = F.col("account_summary"), F.col("final_decision")
    day = lambda c: F.when(s["observed_period"][c] == "", "unknown").otherwise(s["observed_period"][c])
    head = F.format_string("Account %s observed over %s to %s (%d transactions, extracted with %.1f%% confidence) has been classified as %s with a fused score of %.1f. The top triggered rules are: %s. ", s["statement_id"], day("start"), day("end"), s["transaction_count"], s["extraction_confidence"] * 100, d["tier"], d["fused_score"], rules)
    return bundle.select(ID, F.concat(head, cycles, F.lit("This is a decision-support output, not a final determination, and requires human review before any account action.")).alias("text"))


def score_breakdown(decided: DataFrame) -> DataFrame:
    """statement_id, component, weight, raw_value, points (one decimal) and share of the fused score in percent; rules also each by itself.

    A rule's share is its part of all rules' points times the rules' part of the score. Accounts without any points have shares of 0.
    """
    with_model = F.col("probability").isNotNull()
    weight = lambda k: F.when(with_model, config.FUSE_WITH[k]).otherwise(config.FUSE_WITHOUT[k] if k < 2 else 0.0)
    unit = lambda c: F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0))
    parts = [("rules", 0, F.col("rule_score") / 100), ("anomaly", 1, F.col("anomaly_score")), ("model", 2, F.col("probability"))]
    made = decided.withColumns({f"_{n}": weight(k) * unit(v) * 100 for n, k, v in parts})
    total = F.col("_rules") + F.col("_anomaly") + F.col("_model")
    share = lambda x: F.round(F.when(total > 0, x / total * 100).otherwise(0.0), 1)
    record = lambda name, w, raw, points, part: F.struct(name.alias("component"), w.cast("double").alias("weight"), raw.cast("double").alias("raw_value"), F.round(points, 1).alias("points"), part.alias("share"))
    own = [record(F.lit(n), weight(k), F.col({"rules": "rule_score", "anomaly": "anomaly_score", "model": "probability"}[n]), F.col(f"_{n}"), share(F.col(f"_{n}"))) for n, k, _ in parts]
    all_points = F.aggregate("rules", F.lit(0), lambda a, r: a + r["points"])
    each = F.transform("rules", lambda r: record(r["id"], F.lit(None), r["points"], F.col("_rules") * r["points"] / all_points, share(F.col("_rules") * r["points"] / all_points)))
    rows = F.concat(F.filter(F.array(*own), lambda x: (x["component"] != "model") | with_model), each)
    return made.select(ID, F.explode(rows).alias("r")).select(ID, "r.*")


def counterparties_on_patterns(patterns: DataFrame, txns: DataFrame) -> DataFrame:
    """statement_id, counterparty, n, value, inflow, outflow, rank: who is on an account's patterns, by what they move on the whole statement."""
    name = F.coalesce("counterparty", F.lit("UNKNOWN"))
    moved = amounts(txns).withColumn("counterparty", name)
    on = patterns.select(ID, F.explode("row_ids").alias("row_id")).join(moved.select("row_id", "counterparty"), "row_id").select(ID, "counterparty").distinct()
    out = F.coalesce("debit", F.lit(0)) > 0
    sums = moved.join(on, [ID, "counterparty"]).groupBy(ID, "counterparty").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("value"), F.sum(F.when(~out, F.col("amount")).otherwise(0)).cast("double").alias("inflow"), F.sum(F.when(out, F.col("amount")).otherwise(0)).cast("double").alias("outflow"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("value"), "counterparty")))


def reasons_with_rows(patterns: DataFrame, txns: DataFrame, features: DataFrame, cycles: DataFrame) -> DataFrame:
    """statement_id, reason, severity, pattern_id, n_patterns, row_ids (at most SHOWN), withheld: what can be shown for each reason but the statistical one.

    The gravest pattern of a kind speaks for it. Without one, the densest day speaks for velocity and the largest amounts for
    amounts; cycles that make no pattern, and counterparties on patterns, have no rows. Amounts come largest first, others in order.
    """
    kinds = patterns.groupBy(ID, "kind").agg(F.min_by(F.struct("pattern_id", "severity", "row_ids"), "rank").alias("top"), F.count("*").alias("n_patterns"))
    top = kinds.withColumn("reason", lookup(REASON_OF_KIND, F.col("kind"))).select(ID, "reason", "top.*", "n_patterns")
    graded = F.when(F.col("reason").isin("velocity", "amounts"), "HIGH").otherwise(F.col("severity"))
    found = top.select(ID, "reason", graded.alias("severity"), "pattern_id", "n_patterns")
    moved = amounts(txns).select(ID, "row_id", "row_index", "amount", "ts")
    first = lambda value, order: F.struct(F.when(F.col("reason") == "amounts", -F.col("amount")).otherwise(0).alias("a"), order.alias("o"), value.alias("row_id"))
    of_patterns = top.select(ID, "reason", F.posexplode("row_ids").alias("at", "row_id")).join(moved.select("row_id", "amount"), "row_id").select(ID, "reason", first(F.col("row_id"), F.col("at").cast("long")).alias("s"))
    none = lambda reason, where: features.where(where).select(ID, F.lit(reason).alias("reason")).join(top, [ID, "reason"], "left_anti")
    busy = none("velocity", (F.col("inflow_outflow_velocity") >= 5) | (F.col("net_retention_ratio") < 0.5))
    near = none("amounts", (F.col("near_threshold_ratio") >= 0.10) | (F.col("round_number_ratio") >= 0.30))
    ring = cycles.where("not dense").select(ID, F.lit("circular").alias("reason")).distinct().join(top, [ID, "reason"], "left_anti")
    densest = busy.join(peak_velocity_rows(txns), ID).join(txns.select("row_id", "row_index", "ts"), "row_id").select(ID, "reason", F.struct(F.lit(0).cast("decimal(18,2)").alias("a"), F.unix_micros("ts").alias("o"), "row_id").alias("s"))
    largest = near.join(moved, ID).select(ID, "reason", first(F.col("row_id"), F.col("row_index").cast("long")).alias("s"))
    plain = lambda df, grade: df.select(ID, "reason", F.lit(grade).alias("severity"), F.lit(None).cast("string").alias("pattern_id"), F.lit(0).cast("long").alias("n_patterns"))
    links = counterparties_on_patterns(patterns, txns).groupBy(ID).agg(F.count("*").alias("n"))
    linked = links.select(ID, F.lit("connections").alias("reason"), F.when(F.col("n") >= 3, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit(None).cast("string").alias("pattern_id"), F.lit(0).cast("long").alias("n_patterns"))
    found = found.unionByName(plain(busy, "MEDIUM")).unionByName(plain(near, "MEDIUM")).unionByName(plain(ring, "HIGH")).unionByName(linked)
    cast = "struct<a:decimal(20,2),o:bigint,row_id:string>"
    rows = of_patterns.withColumn("s", F.col("s").cast(cast)).unionByName(densest.withColumn("s", F.col("s").cast(cast))).unionByName(largest.withColumn("s", F.col("s").cast(cast)))
    sizes = rows.groupBy(ID, "reason").agg(F.count("*").alias("size"))
    shown = rows.withColumn("_r", F.row_number().over(Window.partitionBy(ID, "reason").orderBy("s"))).where(F.col("_r") <= SHOWN).groupBy(ID, "reason").agg(F.array_sort(F.collect_list(F.struct("_r", "s.row_id")))["row_id"].alias("row_ids"))
    whole = found.join(shown, [ID, "reason"], "left").join(sizes, [ID, "reason"], "left")
    return whole.select(ID, "reason", "severity", "pattern_id", "n_patterns", F.coalesce("row_ids", F.array().cast("array<string>")).alias("row_ids"), F.greatest(F.lit(0), F.coalesce("size", F.lit(0)) - SHOWN).cast("long").alias("withheld"))


def ranked_reasons(shown: DataFrame, anomaly: DataFrame, decided: DataFrame) -> DataFrame:
    """All reasons of each account by their share of the score, then severity: reason, severity, share, rule_points, rules, row_ids, withheld, rank.

    A reason's share is that of the rules behind it, and a rule raises its severity; the statistical reason (flagged features,
    or an isolation of 0.3 or more) has the anomaly's share. Rules whose reason shows nothing are reasons without rows.
    """
    flags = F.coalesce(F.size(F.map_keys("anomaly.flags")), F.lit(0))
    odd = anomaly.where((flags > 0) | (F.col("anomaly.isolation_forest_score") >= config.ANOMALY_LOW)).select(ID, F.lit("statistical").alias("reason"), F.when(flags >= 3, "HIGH").otherwise("MEDIUM").alias("severity"))
    parts = score_breakdown(decided)
    every = shown.unionByName(odd, allowMissingColumns=True).withColumns({"points": F.lit(0.0), "share": F.lit(0.0), "rule": F.lit(None).cast("string")})
    named = lookup(REASON_OF_RULE, F.col("component"))
    grade = F.when(named.isNotNull(), points_severity(F.col("raw_value")))
    behind = parts.where(~F.col("component").isin("rules", "anomaly", "model")).select(ID, F.coalesce(named, "component").alias("reason"), F.coalesce(grade, F.lit("LOW")).alias("severity"), F.col("raw_value").alias("points"), "share", F.col("component").alias("rule"))
    of_anomaly = parts.where("component = 'anomaly'").select(ID, F.lit("statistical").alias("reason"), "share").join(odd.select(ID), ID, "left_semi").withColumns({"severity": F.lit("LOW"), "points": F.lit(0.0), "rule": F.lit(None).cast("string")})
    both = every.unionByName(behind, allowMissingColumns=True).unionByName(of_anomaly, allowMissingColumns=True)
    found = both.groupBy(ID, "reason").agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.round(F.sum("share"), 1).alias("share"), F.sum("points").cast("long").alias("rule_points"),
        F.concat_ws(",", F.array_sort(F.collect_list("rule"))).alias("rules"), F.max("row_ids").alias("row_ids"), F.coalesce(F.max("withheld"), F.lit(0)).alias("withheld"),
    )
    order = Window.partitionBy(ID).orderBy(F.desc("share"), F.desc(severity_rank(F.col("severity"))), "reason")
    return found.withColumn("rank", F.row_number().over(order))


def confidence(decided: DataFrame, found: DataFrame, supervised: bool = False) -> DataFrame:
    """statement_id, confidence (one decimal) and its parts: extraction, statement fit, decision margin and corroboration.

    Args:
        decided: from :func:`decisions`, with rate and ood. found: n_cycles and n_flags of each account, null for none.
        supervised: whether a model is one of the detectors that can agree.
    """
    high, low = config.CONFIRMED_MIN, config.LEGITIMATE_MAX
    unit = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    both = decided.join(found, ID, "left")
    score = F.col("score")
    margin = F.when(F.col("tier") == "CONFIRMED_SUSPICIOUS", (score - high) / (100 - high)).when(F.col("tier") == "LIKELY_LEGITIMATE", (low - score) / low).otherwise(F.least(F.abs(score - high), F.abs(score - low)) / ((high - low) / 2))
    suspicious = F.col("tier") != "LIKELY_LEGITIMATE"
    detectors = [F.size("rules") > 0, F.coalesce("n_cycles", F.lit(0)) > 0, F.coalesce("n_flags", F.lit(0)) > 0]
    detectors += [F.coalesce(F.col("probability") >= 0.5, F.lit(False))] if supervised else []
    agree = sum((d == suspicious).cast("int") for d in detectors) / len(detectors)
    done = both.withColumns({"extraction_quality": unit(F.col("rate")), "statement_fit": unit(F.col("ood")), "decision_margin": unit(margin), "corroboration": agree})
    whole = 100 * (0.35 * F.col("extraction_quality") + 0.25 * F.col("statement_fit") + 0.25 * F.col("decision_margin") + 0.15 * F.col("corroboration"))
    return done.select(ID, F.round(whole, 1).alias("confidence"), "extraction_quality", "statement_fit", "decision_margin", "corroboration")
