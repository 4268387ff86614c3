"""Rules, robust statistics, fusion and decisions, and the evaluation of labelled scores."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .features import FEATURES, ID
from .ranks import medians, others_deviation, others_median, running_totals, same

NAMES = (*FEATURES, "max_cycle_risk_score")
COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq}


def threshold(token: str) -> Column:
    """A number, a feature, a percentile of the account's own features, or a named critical value."""
    if token in NAMES:
        return F.coalesce(F.col(token), F.lit(0.0))
    if token == "critical_value_95":
        return F.lit(config.BENFORD_CRITICAL)
    if token[0] == "p" and token[1:].isdigit():
        own = F.array_sort(F.filter(F.array(*(F.col(n).cast("double") for n in NAMES)), lambda x: x.isNotNull()))
        return F.try_element_at(own, F.least(F.size(own), F.floor(F.size(own) * int(token[1:]) / 100) + 1).cast("int"))
    try:
        return F.lit(float(token))
    except ValueError:
        return F.lit(0.0)


def clause(text: str) -> tuple[str, str, Column, Column]:
    """Field, operator, threshold and whether it holds; a missing field doesn't."""
    field, op, token = text.split()
    limit = threshold(token)
    held = COMPARE[op](F.col(field).cast("double"), limit) if field in NAMES and op in COMPARE else F.lit(False)
    return field, op, limit, F.coalesce(held, F.lit(False))


def condition(text: str) -> Column:
    how, parts = (" AND ", text.split(" AND ")) if " AND " in text else (" OR ", text.split(" OR "))
    out = clause(parts[0])[3]
    for part in parts[1:]:
        held = clause(part)[3]
        out = out & held if how == " AND " else out | held
    return out


def evaluate_rules(features: DataFrame, rules=config.RULES) -> DataFrame:
    """statement_id, rule_score (at most 100) and the rules that fired."""
    fired = [(name, points, condition(text)) for name, points, text in rules]
    score = F.least(F.lit(100), sum(F.when(held, points).otherwise(0) for _, points, held in fired))
    names = F.array_join(F.filter(F.array(*(F.when(held, F.lit(name)) for name, _, held in fired)), lambda x: x.isNotNull()), ",")
    return features.select(ID, score.cast("long").alias("rule_score"), names.alias("fired"))


def rule_clauses(features: DataFrame, rules=config.RULES) -> DataFrame:
    """One row per account, rule and clause: field, op, threshold, actual, holds."""
    rows = []
    for name, _, text in rules:
        for k, part in enumerate(text.replace(" OR ", " AND ").split(" AND ")):
            field, op, limit, held = clause(part)
            rows.append(F.struct(F.lit(name).alias("rule"), F.lit(k).alias("clause"), F.lit(field).alias("field"), F.lit(op).alias("op"), limit.cast("double").alias("threshold"), F.col(field).cast("double").alias("actual"), held.alias("holds")))
    return features.select(ID, F.explode(F.array(*rows)).alias("r")).select(ID, "r.*")


def robust_z(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """0.6745 (x - median) / MAD within the groups of ``keys``; 0 where the deviation is 0."""
    near = same(rows, medians(rows, value, keys, "_m").drop("n"), keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    both = same(near, medians(near, "_d", keys, "_mad").drop("n"), keys)
    return both.withColumn("z", F.when(F.col("_mad") > 0, 0.6745 * (F.col(value) - F.col("_m")) / F.col("_mad")).otherwise(0.0)).drop("_m", "_d", "_mad")


#: Why an account has no anomaly: fewer others than LEAST_COHORT to compare it with.
NO_COHORT = "insufficient_reference_cohort"


def cohort_long(features: DataFrame) -> DataFrame:
    """statement_id, name, value of all features that accounts are compared by, the cycle risk among them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in NAMES)))
    return features.select(ID, pairs.alias("f")).select(ID, "f.*")


def against_others(long: DataFrame) -> DataFrame:
    """statement_id, name, value, others, others_median, others_mad, z: every feature against all other accounts, missing values as 0.

    z is null where the others' deviation is 0, or where there are too few others.
    """
    filled = long.select(ID, "name", F.coalesce("value", F.lit(0.0)).alias("value"))
    found = others_deviation(filled, "value", ("name",))
    return found.withColumn("z", F.when((F.col("others_mad") > 0) & (F.col("others") >= config.LEAST_COHORT), 0.6745 * (F.col("value") - F.col("others_median")) / F.col("others_mad")))


def mad_flags(long: DataFrame, limit: float = config.ROBUST_Z) -> DataFrame:
    """statement_id, n_flags, flagged, reason: features that lie far from the median of all other accounts, the account itself left out.

    With fewer than LEAST_COHORT others n_flags and flagged are null and the reason says so.
    """
    return mad_flags_of(against_others(long), limit)


def mad_flags_of(against: DataFrame, limit: float = config.ROBUST_Z) -> DataFrame:
    far = F.abs("z") > limit
    found = against.groupBy(ID).agg(F.min("others").alias("_others"), F.count_if(far).alias("n_flags"), F.array_join(F.array_sort(F.collect_list(F.when(far, F.col("name")))), ",").alias("flagged"))
    enough = F.col("_others") >= config.LEAST_COHORT
    return found.select(ID, F.when(enough, F.col("n_flags")).alias("n_flags"), F.when(enough, F.col("flagged")).alias("flagged"), F.when(~enough, F.lit(NO_COHORT)).alias("reason"))


def top_distances(long: DataFrame, k: int = 5) -> DataFrame:
    """statement_id, top_features, reason: the features farthest from the others' median, unscaled, the farthest first, ties by name."""
    filled = long.select(ID, "name", F.coalesce("value", F.lit(0.0)).alias("value"))
    far = F.struct(-F.abs(F.col("value") - F.col("others_median")), "name")
    found = others_median(filled, "value", ("name",)).groupBy(ID).agg(F.min("others").alias("_others"), F.slice(F.array_sort(F.collect_list(far)), 1, k)["name"].alias("top"))
    enough = F.col("_others") >= config.LEAST_COHORT
    return found.select(ID, F.when(enough, F.array_join("top", ",")).alias("top_features"), F.when(~enough, F.lit(NO_COHORT)).alias("reason"))


def anomaly_score(flags: DataFrame, isolation: DataFrame, n_features: int = len(NAMES)) -> DataFrame:
    """(share of flagged features + isolation) / 2; 0 where the cohort is too small for either."""
    both = flags.join(isolation.select(ID, "isolation"), ID, "left")
    return both.select(ID, F.coalesce((F.col("n_flags") / n_features + F.col("isolation")) / 2, F.lit(0.0)).alias("anomaly_score"))


def fuse(rule: Column, anomaly: Column, probability: Column | None = None) -> Column:
    """A score in points. Points are weighted as they are: 0.65 * 35 is 22.75, but 0.65 * (35 / 100) * 100 falls short of it."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    r, a = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rule)), unit(anomaly) * 100
    without = config.FUSE_WITHOUT[0] * r + config.FUSE_WITHOUT[1] * a
    if probability is None:
        return without
    w = config.FUSE_WITH
    return F.when(probability.isNull(), without).otherwise(w[0] * r + w[1] * a + w[2] * (unit(probability) * 100))


def decide_tier(score: Column, fired: Column, anomaly: Column, extraction: Column) -> Column:
    return (
        F.when((score >= config.CONFIRMED_MIN) & (fired != "") & (extraction != "low"), "CONFIRMED_SUSPICIOUS")
        .when((score <= config.LEGITIMATE_MAX) & (anomaly < config.ANOMALY_LOW) & (extraction == "high"), "LIKELY_LEGITIMATE")
        .otherwise("REVIEW_REQUIRED")
    )


def binary_metrics(rows: DataFrame, score: str, label: str, cut: float, top: float = 0.05) -> DataFrame:
    """precision, recall, f1, false positive rate and lift among the ``top`` share by score, in one row."""
    p, y = F.col(score) >= cut, F.col(label) == 1
    ranked = running_totals(rows.groupBy(score, label).count(), [F.desc(score), F.desc(label)], ["count"])
    counts = rows.agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("tp", p & y), ("fp", p & ~y), ("fn", ~p & y), ("tn", ~p & ~y))), F.count("*").alias("n"))
    head = ranked.withColumn("_k", F.ceil(F.col("count_all") * top))
    taken = F.greatest(F.lit(0), F.least(F.col("count"), F.col("_k") - F.col("count_before")))
    best = head.agg(F.sum(F.when(F.col(label) == 1, taken)).alias("hits"), F.max("_k").alias("k"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.crossJoin(F.broadcast(best)).select(precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("hits") / F.col("k"), (F.col("tp") + F.col("fn")) / F.col("n")).alias("lift"))
