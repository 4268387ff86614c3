"""Registered queries on patterns, reasons, views and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import banks as b
from .. import config
from ..operators import cases as c
from ..operators import evidence as ev
from ..operators import features as f
from ..operators import graph as g
from ..operators import models as m
from ..operators import patterns as p
from ..operators import quality as q
from ..operators import scoring as s
from ..operators import views as v
from ..sources.adapters import SQL_CASE, SQL_TRF, SQL_TXN, mirrored_case, transactions, transfers
from ..sources.shared import folder, read_published, written
from .narration_queries import CHANNEL
from .account_queries import FEATURES_SQL
from .account_queries import ORACLES as ACCOUNT_SQL
from .risk_queries import DERIVED, GEDGES, STAR, anomaly, features_of, isolation_of, plausibility, rates, scored
from .risk_queries import ORACLES as RISK_SQL

QUERIES, ORACLES = {}, {}


def register(name, source, make, cte=None, sql=None):
    QUERIES[name] = lambda spark, d: make(source(spark, d))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {cte} {sql}"


AMOUNTS = ", am AS (SELECT *, greatest(coalesce(debit, 0), coalesce(credit, 0)) AS amount, CASE WHEN greatest(coalesce(debit, 0), coalesce(credit, 0)) / 100.0 BETWEEN 45000 AND 50000 THEN 50000 WHEN greatest(coalesce(debit, 0), coalesce(credit, 0)) / 100.0 BETWEEN 180000 AND 200000 THEN 200000 END AS band FROM txn WHERE coalesce(debit, credit) > 0)"
STRUCTURED = AMOUNTS + ", st AS (SELECT statement_id, 'structuring:' || band AS pattern_id, 0.5 * least(count(*) / 5, 1) + 0.5 * greatest(0, least((avg(amount / 100.0 / band) - 0.9) / 0.1, 1)) AS risk, sum(amount) / 100.0 AS total, count(*) AS n FROM am WHERE band IS NOT NULL GROUP BY statement_id, band HAVING count(*) >= 2)"
SEVERITY = "CASE WHEN risk >= 0.85 THEN 'CRITICAL' WHEN risk >= 0.70 THEN 'HIGH' WHEN risk >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END"


#: The rows of case edges with the id of their edge.
BEHIND = GEDGES + ", pe AS (SELECT *, 'E' || left(sha256(case_id || '|' || CASE WHEN ambiguous THEN row_id ELSE ref || '|' || least(row_id, mirror) || '+' || greatest(row_id, mirror) END), 20) AS edge_id FROM p)"


def dormant(gap: int, rows: int, days: int = 3) -> str:
    """Silences and the bursts behind them (da), by a scan over an account's rows that goes on behind each burst."""
    return f""", rw AS (SELECT statement_id, row_id, row_number() OVER (PARTITION BY statement_id ORDER BY txn_date, row_index) AS k, txn_date, greatest(coalesce(debit, 0), coalesce(credit, 0)) AS amount FROM txn WHERE coalesce(debit, 0) > 0 OR coalesce(credit, 0) > 0),
bs AS (SELECT a.statement_id, a.k, a.row_id, count(*) AS burst, sum(b.amount) AS total, string_agg(b.row_id, ',' ORDER BY b.k) AS row_ids FROM rw a JOIN rw b ON b.statement_id = a.statement_id AND b.k >= a.k AND b.txn_date <= a.txn_date + {days} GROUP BY ALL),
sl AS (SELECT bs.*, date_diff('day', z.txn_date, y.txn_date) AS silent FROM bs JOIN rw y USING (statement_id, k) JOIN rw z ON z.statement_id = bs.statement_id AND z.k = bs.k - 1),
sn AS (SELECT DISTINCT statement_id, 2::BIGINT AS k FROM rw UNION ALL SELECT statement_id, CASE WHEN silent > {gap} AND burst >= {rows} THEN k + burst + 1 ELSE k + 1 END FROM sn JOIN sl USING (statement_id, k)),
da AS (SELECT statement_id, 'dormancy' AS kind, 'dormancy:' || row_id AS pattern_id, 0.5 * least(silent / 90, 1) + 0.5 * least(burst / 6, 1) AS risk, total / 100.0 AS total, 'R2_dormancy_then_burst' AS rule, row_ids FROM sl JOIN sn USING (statement_id, k) WHERE silent > {gap} AND burst >= {rows})"""


#: Credits in order, each with the first debit of its day or the next that is near enough and unused; then the ten gravest.
LAYERED = """, lc AS (SELECT statement_id, row_id, txn_date, credit, row_number() OVER (PARTITION BY statement_id ORDER BY txn_date, row_index) AS c FROM txn WHERE credit > 0),
ld AS (SELECT statement_id, row_id, txn_date, debit, row_number() OVER (PARTITION BY statement_id ORDER BY txn_date, row_index) AS k FROM txn WHERE debit > 0),
lk AS (SELECT statement_id, c, coalesce(list(k ORDER BY k) FILTER (k IS NOT NULL), []) AS fits FROM lc LEFT JOIN (SELECT lc.statement_id, c, k FROM lc JOIN ld ON lc.statement_id = ld.statement_id AND date_diff('day', lc.txn_date, ld.txn_date) BETWEEN 0 AND 1 AND least(credit, debit)::DOUBLE / greatest(credit, debit) >= 0.6) USING (statement_id, c) GROUP BY ALL),
lm AS (SELECT DISTINCT statement_id, 0::BIGINT AS c, []::BIGINT[] AS used, NULL::BIGINT AS hit FROM lc UNION ALL
  SELECT statement_id, c, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (SELECT m.statement_id, m.c + 1 AS c, used, [x FOR x IN fits IF NOT list_contains(used, x)][1] AS hit FROM lm m JOIN lk ON lk.statement_id = m.statement_id AND lk.c = m.c + 1)),
lp AS (SELECT statement_id, lc.row_id AS credit_row, ld.row_id AS debit_row, least(credit, debit)::DOUBLE / greatest(credit, debit) AS near, date_diff('day', lc.txn_date, ld.txn_date) AS held, greatest(credit, debit) / 100.0 AS largest, (credit + debit) / 100.0 AS total FROM lm JOIN lc USING (statement_id, c) JOIN ld USING (statement_id) WHERE ld.k = hit),
la AS (SELECT statement_id, 'layering' AS kind, 'layering:' || credit_row AS pattern_id, (0.5 * near + 0.5 * (1 - held)) * (0.6 + 0.4 * least(largest / 200000, 1)) AS risk, total, 'R1_low_retention_high_turnover' AS rule, credit_row || ',' || debit_row AS row_ids FROM lp QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY risk DESC, total DESC, credit_row) <= 10)"""
CYCLIC = STAR + """, ca AS (SELECT statement_id, 'cycle' AS kind, 'cycle:' || counterparty AS pattern_id, any_value(risk) AS risk, sum(greatest(coalesce(debit, 0), coalesce(credit, 0))) / 100.0 AS total, 'R5_circular_flow_detected' AS rule, string_agg(row_id, ',' ORDER BY row_id) AS row_ids
  FROM star JOIN txn USING (statement_id, counterparty) WHERE risk >= 0.3 AND (coalesce(debit, 0) > 0 OR coalesce(credit, 0) > 0) GROUP BY statement_id, counterparty)"""
BANDED = STRUCTURED + ", sa AS (SELECT statement_id, 'structuring' AS kind, pattern_id, risk, total, 'R3_structuring_near_threshold' AS rule, row_ids FROM st JOIN (SELECT statement_id, 'structuring:' || band AS pattern_id, string_agg(row_id, ',' ORDER BY row_id) AS row_ids FROM am WHERE band IS NOT NULL GROUP BY ALL) USING (statement_id, pattern_id))"
BUILT = CYCLIC + LAYERED + BANDED + dormant(30, 3) + f""", pa AS (SELECT * FROM ca UNION ALL SELECT * FROM la UNION ALL SELECT * FROM sa UNION ALL SELECT * FROM da), fi AS ({RISK_SQL["R1_rule_eval"]}),
pn AS (SELECT pa.*, {SEVERITY} AS severity FROM pa LEFT JOIN fi USING (statement_id) WHERE risk >= 0.5 OR list_contains(string_split(fired, ','), rule)),
pt AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, risk DESC, total DESC, pattern_id) AS rank FROM pn QUALIFY rank <= 25),
pr AS (SELECT pt.statement_id, pattern_id, risk, txn.row_id, ts, txn_date, debit, counterparty, narration, reference_no, greatest(coalesce(debit, 0), coalesce(credit, 0)) / 100.0 AS amount FROM (SELECT *, unnest(string_split(row_ids, ',')) AS row_id FROM pt) pt JOIN txn USING (row_id))"""


def patterns(t):
    parts = [p.cycle_patterns(g.star_cycles(t, 0.3), t), p.layering_patterns(t), p.structuring_patterns(t), p.dormancy_patterns(t)]
    return written(p.build_patterns(parts, s.evaluate_rules(features_of(t))), "patterns")


def known(t):
    """All that an account's evidence is made of, each part written once."""
    features = features_of(t)
    cycles = written(g.star_cycles(t), "cycles")
    against = written(s.against_others(s.cohort_long(features)), "against")
    isolation = written(isolation_of(features), "isolation")
    details = written(ev.anomaly_details(against, isolation, s.top_distances(s.cohort_long(features))), "anomaly")
    decided = written(ev.decisions(ev.fired_rules(features), s.anomaly_score(s.mad_flags_of(against), isolation), rates(t)), "decided")
    return features, cycles, details, decided


def reasons_shown(t, features, cycles):
    return ev.reasons_with_rows(patterns(t), t, features, cycles)


def ranked(t):
    features, cycles, details, decided = known(t)
    return ev.ranked_reasons(reasons_shown(t, features, cycles), details, decided)


def facts(t):
    """What the statements' files and rows say by themselves."""
    seen = t.groupBy("statement_id").agg(F.min("txn_date").cast("string").alias("start"), F.max("txn_date").cast("string").alias("end"), F.count("*").alias("n"))
    fit = plausibility(t).select(F.col("file_id").alias("statement_id"), F.col("score").alias("ood"))
    return seen.join(rates(t), "statement_id").join(fit, "statement_id", "left").withColumn("manual_mapping", F.lit(False))


def bundle(t):
    features, cycles, details, decided = known(t)
    return ev.evidence_bundle(facts(t), decided, f.feature_evidence(features), ev.ranked_cycles(cycles), details)


def bundle_without_forest(t):
    """The bundle of what rules, cycles and files give; the anomaly is that of no cohort."""
    features, cycles = features_of(t), written(g.star_cycles(t), "cycles")
    none = features.select("statement_id", F.lit(0.0).alias("anomaly_score"))
    nothing = F.struct(F.lit(None).cast("double").alias("isolation_forest_score"), F.lit(s.NO_COHORT).alias("availability_reason"))
    return ev.evidence_bundle(facts(t), ev.decisions(ev.fired_rules(features), none, rates(t)), f.feature_evidence(features), ev.ranked_cycles(cycles), features.select("statement_id", nothing.alias("anomaly")))


def sure(t):
    features, cycles, details, decided = known(t)
    found = details.select("statement_id", F.size(F.map_keys("anomaly.flags")).alias("n_flags")).join(cycles.groupBy("statement_id").agg(F.count("*").alias("n_cycles")), "statement_id", "left")
    fit = plausibility(t).select(F.col("file_id").alias("statement_id"), F.col("score").alias("ood"))
    return ev.confidence(decided.join(fit, "statement_id", "left"), found, supervised=True)


def shown(found):
    return found.withColumns({"risk": F.round("risk", 6), "total": F.round("total", 2), "row_ids": F.array_join("row_ids", ",")})


register("T2_severity", transactions, lambda t: p.structuring_patterns(t).select("statement_id", "pattern_id", p.severity(F.col("risk")).alias("severity")), SQL_TXN, STRUCTURED + f" SELECT statement_id, pattern_id, {SEVERITY} AS severity FROM st")
register("T4_cycle_pattern", transactions, lambda t: shown(p.cycle_patterns(g.star_cycles(t, 0.3), t)), SQL_TXN, CYCLIC + " SELECT * REPLACE (round(risk, 6) AS risk, round(total, 2) AS total) FROM ca")
register("T4_cycle_paths", transactions, lambda t: p.cycle_paths(g.star_cycles(t, 0.3)).select("statement_id", "pattern_id", F.array_join(F.transform("node_path", lambda x: F.concat_ws(":", x["id"], x["is_subject"], x["is_return"])), ",").alias("path")), SQL_TXN,
         STAR + " SELECT statement_id, 'cycle:' || counterparty AS pattern_id, 'ACCT_' || statement_id || ':true:false,' || counterparty || ':false:false,ACCT_' || statement_id || ':true:true' AS path FROM star WHERE risk >= 0.3")
register("T5_J4_layering", transactions, lambda t: shown(p.layering_patterns(t)), SQL_TXN, LAYERED + " SELECT * REPLACE (round(risk, 6) AS risk, round(total, 2) AS total) FROM la")
register("T6_structuring", transactions, lambda t: p.structuring_patterns(t).select("statement_id", "pattern_id", F.round("risk", 6).alias("risk"), "total"), SQL_TXN, STRUCTURED + " SELECT statement_id, pattern_id, round(risk, 6) AS risk, total FROM st")
register("T7_dormancy", transactions, lambda t: shown(p.dormancy_patterns(t, gap=1, rows=2)), SQL_TXN, dormant(1, 2) + " SELECT * REPLACE (round(risk, 6) AS risk, round(total, 2) AS total) FROM da")
register("T8_build_patterns", transactions, lambda t: patterns(t).select("statement_id", "pattern_id", "kind", "severity", "rank"), SQL_TXN, BUILT + " SELECT statement_id, pattern_id, kind, severity, CAST(rank AS INTEGER) AS rank FROM pt")
register("T1_hops", transactions, lambda t: p.hops(patterns(t), t).withColumns({"gap_hours": f.half_up(F.col("gap_hours"), 6), "hop_risk": f.half_up(F.col("hop_risk"), 6), "band": F.col("band").cast("double")}), SQL_TXN,
         BUILT + """, hp AS (SELECT *, row_number() OVER w AS hop, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9::DOUBLE AS gap, coalesce(debit, 0) > 0 AS out, amount BETWEEN 45000 AND 50000 OR amount BETWEEN 180000 AND 200000 AS banded FROM pr WINDOW w AS (PARTITION BY statement_id, pattern_id ORDER BY txn_date, row_id)),
         hr AS (SELECT *, coalesce(gap <= 24, FALSE) AS rapid, 'ACCT_' || statement_id AS me, coalesce(counterparty, 'UNKNOWN') AS other FROM hp), hs AS (SELECT * REPLACE (least(1, risk + CASE WHEN banded THEN 0.10 ELSE 0 END + CASE WHEN rapid THEN 0.05 ELSE 0 END) AS risk) FROM hr)
         SELECT statement_id, pattern_id, CAST(hop AS INTEGER) AS hop, row_id, reference_no AS txn_id, CAST(txn_date AS VARCHAR) AS day, CASE WHEN out THEN 'debit' ELSE 'credit' END AS direction, """ + CHANNEL + """ AS channel, narration, CASE WHEN amount BETWEEN 45000 AND 50000 THEN 50000 WHEN amount BETWEEN 180000 AND 200000 THEN 200000 END::DOUBLE AS band, CASE WHEN out THEN me ELSE other END AS from_node, CASE WHEN out THEN other ELSE me END AS to_node, amount, round(gap, 6) AS gap_hours, rapid, banded, round(risk, 6) AS hop_risk, """ + SEVERITY + " AS severity FROM hs")
register("T3_finalize", transactions, lambda t: p.finalize(patterns(t), t).withColumns({"total": F.round("total", 2), "row_ids": F.array_join("row_ids", ","), "node_ids": F.array_join("node_ids", ",")}), SQL_TXN, BUILT + ", pn2 AS (SELECT statement_id, pattern_id, string_agg(node, ',' ORDER BY node) AS node_ids FROM (SELECT DISTINCT statement_id, pattern_id, unnest(['ACCT_' || statement_id, coalesce(counterparty, 'UNKNOWN')]) AS node FROM pr) GROUP BY 1, 2) SELECT statement_id, pattern_id, string_agg(row_id, ',' ORDER BY txn_date, row_id) AS row_ids, any_value(node_ids) AS node_ids, count(*) AS n, round(sum(amount), 2) AS total, date_diff('day', min(txn_date), max(txn_date))::DOUBLE AS span_days, CAST(min(txn_date) AS VARCHAR) AS start, CAST(max(txn_date) AS VARCHAR) AS \"end\" FROM pr JOIN pn2 USING (statement_id, pattern_id) GROUP BY 1, 2")
register("W1_peak_velocity_rows", transactions, p.peak_velocity_rows, SQL_TXN, ", v AS (SELECT statement_id, row_id, ts, count(*) OVER (PARTITION BY statement_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS n FROM txn), k AS (SELECT statement_id, min(ts) AS peak FROM v JOIN (SELECT statement_id, max(n) AS n FROM v GROUP BY 1) USING (statement_id, n) GROUP BY 1) SELECT statement_id, row_id FROM txn JOIN k USING (statement_id) WHERE ts BETWEEN peak - INTERVAL '24' HOUR AND peak")
register("W2_W4_reasons", transactions, lambda t: ranked(t).withColumn("row_ids", F.array_join("row_ids", ",")))
PEAK = """, pv AS (SELECT statement_id, row_id, row_index, ts, count(*) OVER (PARTITION BY statement_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS n FROM txn), pk AS (SELECT statement_id, min(ts) AS peak FROM pv JOIN (SELECT statement_id, max(n) AS n FROM pv GROUP BY 1) USING (statement_id, n) GROUP BY 1), pw AS (SELECT statement_id, row_id, epoch_us(ts)::DOUBLE AS o1, 0 AS o2 FROM pv JOIN pk USING (statement_id) WHERE ts BETWEEN peak - INTERVAL '24' HOUR AND peak)"""
SHOWN = BUILT + PEAK + f""", wk AS (SELECT statement_id, kind, arg_min(pattern_id, rank) AS pattern_id, arg_min(severity, rank) AS severity, count(*) AS n_patterns FROM pt GROUP BY 1, 2),
wt AS (SELECT statement_id, pattern_id, n_patterns, CASE kind WHEN 'cycle' THEN 'circular' WHEN 'layering' THEN 'velocity' WHEN 'structuring' THEN 'amounts' ELSE 'dormancy' END AS reason, CASE WHEN kind IN ('layering', 'structuring') THEN 'HIGH' ELSE severity END AS severity FROM wk),
wf AS (SELECT * FROM ({FEATURES_SQL})), wx AS (SELECT statement_id, 'velocity' AS reason FROM wf WHERE inflow_outflow_velocity >= 5 OR net_retention_ratio < 0.5 UNION ALL SELECT statement_id, 'amounts' FROM wf WHERE near_threshold_ratio >= 0.10 OR round_number_ratio >= 0.30),
wy AS (SELECT * FROM wx ANTI JOIN wt USING (statement_id, reason)), wz AS (SELECT DISTINCT statement_id, 'circular' AS reason FROM star WHERE risk >= 0.6), wr AS (SELECT * FROM wz ANTI JOIN wt USING (statement_id, reason)),
wc AS (SELECT statement_id, count(DISTINCT coalesce(counterparty, 'UNKNOWN')) AS n FROM pr GROUP BY 1),
wa AS (SELECT statement_id, reason, severity, pattern_id, n_patterns FROM wt UNION ALL SELECT statement_id, reason, 'MEDIUM', NULL, 0 FROM wy UNION ALL SELECT statement_id, reason, 'HIGH', NULL, 0 FROM wr UNION ALL SELECT statement_id, 'connections', CASE WHEN n >= 3 THEN 'HIGH' ELSE 'MEDIUM' END, NULL, 0 FROM wc),
wp AS (SELECT wt.statement_id, reason, row_id, CASE WHEN reason = 'amounts' THEN -greatest(coalesce(debit, 0), coalesce(credit, 0)) ELSE 0 END::DOUBLE AS o1, spot::DOUBLE AS o2 FROM (SELECT statement_id, pattern_id, unnest(string_split(row_ids, ',')) AS row_id, generate_subscripts(string_split(row_ids, ','), 1) AS spot FROM pt) p JOIN wt USING (statement_id, pattern_id) JOIN txn USING (row_id)
  UNION ALL SELECT statement_id, 'velocity', row_id, o1, o2 FROM pw SEMI JOIN (SELECT * FROM wy WHERE reason = 'velocity') w USING (statement_id)
  UNION ALL SELECT statement_id, 'amounts', row_id, -greatest(coalesce(debit, 0), coalesce(credit, 0))::DOUBLE, row_index FROM txn SEMI JOIN (SELECT * FROM wy WHERE reason = 'amounts') w USING (statement_id) WHERE coalesce(debit, 0) > 0 OR coalesce(credit, 0) > 0),
wl AS (SELECT statement_id, reason, array_to_string(list(row_id ORDER BY o1, o2, row_id)[1:5], ',') AS row_ids, greatest(count(*) - 5, 0) AS withheld FROM wp GROUP BY 1, 2)"""
register("W2_sample_rows", transactions, lambda t: reasons_shown(t, features_of(t), g.star_cycles(t)).withColumn("row_ids", F.array_join("row_ids", ",")), SQL_TXN,
         SHOWN + " SELECT statement_id, reason, severity, pattern_id, n_patterns, coalesce(row_ids, '') AS row_ids, coalesce(withheld, 0) AS withheld FROM wa LEFT JOIN wl USING (statement_id, reason)")
register("W2_connections", transactions, lambda t: ev.counterparties_on_patterns(patterns(t), t).where(F.col("rank") <= ev.SHOWN), SQL_TXN,
         BUILT + ", cn AS (SELECT DISTINCT statement_id, coalesce(counterparty, 'UNKNOWN') AS counterparty FROM pr), cm AS (SELECT statement_id, counterparty, count(*) AS n, sum(amount) AS value, coalesce(sum(CASE WHEN NOT out THEN amount END), 0) AS inflow, coalesce(sum(CASE WHEN out THEN amount END), 0) AS outflow FROM (SELECT statement_id, coalesce(counterparty, 'UNKNOWN') AS counterparty, coalesce(debit, 0) > 0 AS out, greatest(coalesce(debit, 0), coalesce(credit, 0)) / 100.0 AS amount FROM txn WHERE coalesce(debit, 0) > 0 OR coalesce(credit, 0) > 0) SEMI JOIN cn USING (statement_id, counterparty) GROUP BY 1, 2) SELECT statement_id, counterparty, n, value::DOUBLE AS value, inflow::DOUBLE AS inflow, outflow::DOUBLE AS outflow, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY value DESC, counterparty) AS INTEGER) AS rank FROM cm QUALIFY rank <= 5")
register("W5_confidence", transactions, sure)
register("W6_coverage", transactions, lambda t: p.coverage(t, patterns(t), s.evaluate_rules(features_of(t)), len(f.FEATURES)), SQL_TXN,
         BUILT + f", wn AS (SELECT statement_id, count(*) AS np FROM pt GROUP BY 1) SELECT statement_id, examined, counterparties, coalesce(np, 0) AS patterns, len([x FOR x IN string_split(fired, ',') IF x <> '']) AS rules_triggered, 6::BIGINT AS rules_evaluated, {len(f.FEATURES)}::BIGINT AS features FROM (SELECT statement_id, count(*) AS examined, count(DISTINCT counterparty) AS counterparties FROM txn GROUP BY 1) LEFT JOIN wn USING (statement_id) LEFT JOIN fi USING (statement_id)")
register("C3_evidence_bundle", transactions, lambda t: bundle(t).select("statement_id", *(F.to_json(c).alias(c) for c in ("account_summary", "final_decision", "triggered_rules", "features", "cycles_detected", "anomaly_detail", "supervised_detail", "guardrail_log"))))
register("P16_redacted_projection", transactions, lambda t: ev.redacted_projection(bundle(t)).select("statement_id", F.to_json(F.struct("analysis", "triggered_rules", "cycles", "limitations")).alias("projection")))
register("P17_narrative", transactions, lambda t: ev.narrative(bundle(t)))


def exported(t):
    """Bundles as lines of JSON, and what reading those gives."""
    path = folder(t.sparkSession, "json")
    v.export_evidence_json(bundle_without_forest(t), path)
    line = "statement_id long, account_summary struct<transaction_count:long>, triggered_rules array<struct<id:string>>"
    return t.sparkSession.read.schema(line).json(path).select("statement_id", F.col("account_summary.transaction_count").alias("n"), F.array_join(F.transform("triggered_rules", lambda r: r["id"]), ",").alias("fired"))


register("S8_export_evidence_json", transactions, exported, SQL_TXN, f", fr AS ({RISK_SQL['R1_rule_eval']}) SELECT statement_id, n, fired FROM (SELECT statement_id, count(*) AS n FROM txn GROUP BY 1) JOIN fr USING (statement_id)")


def published(t):
    """Rows of each table of a ledger's last version: one of half the ledger is published first, then the whole."""
    spark, path = t.sparkSession, folder(t.sparkSession, "intel")
    t = written(t, "transfers")
    for ledger in (t.where("row_idx % 2 = 0"), t):
        derived = b.derive(ledger)
        risk = b.bank_risk(b.risk_components(written(b.components(derived), "components")))
        v.sink_intel(ledger, risk, b.bank_volume(b.bank_legs(derived)), b.bank_edges(ledger), path, 1)
    found = None
    for name in ("ledger", "banks", "edges", "profiles"):
        one = read_published(spark, path, name, 1).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        found = one if found is None else found.unionByName(one)
    return found


register("S6_sink_intel", transfers, published, SQL_TRF,
         "SELECT 'ledger' AS \"table\", count(*) AS n FROM trf UNION ALL SELECT 'banks', count(*) FROM (SELECT from_bank FROM trf UNION SELECT to_bank FROM trf) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT from_bank, to_bank FROM trf) UNION ALL SELECT 'profiles', count(*) FROM (SELECT from_bank FROM trf UNION SELECT to_bank FROM trf)")


def summaries(t):
    """Statements with the tier and score of their latest bundle: an empty first one, and one by rules and files alone after it."""
    made = bundle_without_forest(t).select("statement_id", F.lit(2).alias("created_ts"), "final_decision.tier", F.col("final_decision.fused_score").alias("score"))
    earlier = made.select("statement_id", F.lit(1).alias("created_ts"), F.lit("REVIEW_REQUIRED").alias("tier"), F.lit(0.0).alias("score"))
    rows = t.groupBy("statement_id").agg(F.count("*").alias("n")).join(plausibility(t).select(F.col("file_id").alias("statement_id"), F.col("tier").alias("ood_tier")), "statement_id")
    return v.statement_summary(rows, earlier.unionByName(made))


def grids(t):
    scored_ = plausibility(t)
    return scored_.join(q.ood_failure_reasons(scored_), "file_id").select("file_id", *(F.round(k, 6).alias(k) for k in (*config.OOD_WEIGHTS, "score")), "tier", F.array_join("reasons", ",").alias("reasons"))


def pattern_sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The six signals of the statements' raw files, over their cells.
GRID = rf""", gr AS (SELECT statement_id AS f, row_number() OVER (PARTITION BY statement_id ORDER BY row_index) - 1 AS r, [strftime(txn_date, '%d/%m/%Y'), '', narration, reference_no, coalesce(format('{{:,.2f}}', debit / 100.0), ''), coalesce(format('{{:,.2f}}', credit / 100.0), ''), format('{{:,.2f}}', balance / 100.0)] AS cells FROM txn),
gx AS (SELECT f, r, i - 1 AS col, trim(cells[i]) AS v FROM gr, range(1, 8) AS t(i)),
gy AS (SELECT *, v IS NOT NULL AND v <> '' AS ok, CASE WHEN regexp_matches(v, {pattern_sql(q.NUMBER)}) THEN CAST(regexp_replace(v, '[₹$,\s]', '', 'g') AS DOUBLE) END AS num, coalesce(regexp_matches(v, {pattern_sql(q.DATE)}), FALSE) AS dated FROM gx),
gz AS (SELECT *, lag(num) OVER (PARTITION BY f, col ORDER BY r) AS prev FROM gy),
gc AS (SELECT f, col, count_if(ok AND dated) / greatest(count_if(ok), 1) AS d, count_if(ok AND num IS NOT NULL) / greatest(count_if(ok), 1) AS a, count_if(ok) AS n, count(num) AS k, min(num) AS low, max(num) AS high, count_if(abs(num - prev) <= 0.5 * greatest(abs(num), abs(prev), 1) AND r <= 20) / greatest(count_if(prev IS NOT NULL AND num IS NOT NULL AND r <= 20), 1) AS s, count_if(ok AND length(v) > 10) / greatest(count_if(ok), 1) AS lng, count(DISTINCT CASE WHEN ok THEN v END) / greatest(count_if(ok), 1) AS dis FROM gz GROUP BY 1, 2),
gs AS (SELECT f, coalesce(arg_min(d, col) FILTER (d >= 0.8), 0) AS date, count_if(n > 0 AND a >= 0.8) / greatest(count_if(n > 0), 1) AS amount, coalesce(arg_min(CASE WHEN low = high THEN 1 ELSE s END, col) FILTER (k >= 3 AND NOT (low > 0 AND high > 100 * low) AND (s >= 0.3 OR low = high)), 0) AS balance, coalesce(arg_min(dis, col) FILTER (lng > 0.3 AND dis > 0.3), 0) AS narration FROM gc GROUP BY 1),
gt AS (SELECT f, string_agg(array_to_string([x FOR x IN cells IF x IS NOT NULL], chr(9)), chr(10) ORDER BY r) FILTER (r < 100) AS text, count(*) AS rows FROM gr GROUP BY 1),
gb AS (SELECT f, rows, date, amount, balance, narration, ({" + ".join(f"CASE WHEN regexp_matches(text, {pattern_sql(x)}) THEN 1 ELSE 0 END" for x in q.BANK_MARKS)}) / {len(q.BANK_MARKS)}.0::DOUBLE AS bank, CASE WHEN rows BETWEEN 3 AND 200000 THEN 1.0::DOUBLE ELSE 0 END AS row_count FROM gs JOIN gt USING (f)),
go AS (SELECT *, CASE WHEN rows < 3 THEN 0 ELSE least(1, {" + ".join(f"{w} * {k}" for k, w in config.OOD_WEIGHTS.items())}) END::DOUBLE AS score FROM gb)"""
OOD_TIER = f"CASE WHEN score >= {config.OOD_PROCEED} THEN 'auto_proceed' WHEN score >= {config.OOD_LOW} THEN 'low_confidence' ELSE 'hard_reject' END"
register("Q4_Q5_Q6_plausibility", transactions, grids, SQL_TXN,
         GRID + " SELECT f AS file_id, " + ", ".join(f"round({k}::DOUBLE, 6) AS {k}" for k in (*config.OOD_WEIGHTS, "score")) + f", {OOD_TIER} AS tier, coalesce(nullif(array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {k} < 0.5 THEN '{k}' END" for k in config.OOD_WEIGHTS) + "] IF x IS NOT NULL], ','), ''), 'All signals passed') AS reasons FROM go")
FACTS = GRID + f", cy AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY risk DESC, counterparty) AS k, counterparty, cons, risk FROM star WHERE risk >= 0.6), cl AS (SELECT statement_id, string_agg('C' || k || ':' || counterparty || ':' || round(risk, 6)::DECIMAL(18,6), ',' ORDER BY k) AS cycles, string_agg(CASE WHEN k <= 3 THEN '2-hop cycle with ' || CAST(round_even(cons * 100, 0) AS INTEGER) || '% amount conservation' END, '; ' ORDER BY k) AS told FROM cy GROUP BY 1), fr AS ({RISK_SQL['R1_rule_eval']}), rt AS ({ACCOUNT_SQL['Q1_reconcile']})"
POINTS = "MAP {" + ", ".join(f"'{n}': {k}" for n, k, _ in config.RULES) + "}"


def bundle_facts(t):
    rules, cycles = ev.listed_facts()
    six = lambda x: F.round(x, 6).cast("decimal(18,6)").cast("string")
    named = F.array_join(F.transform("cycles_detected", lambda c: F.concat_ws(":", c["cycle_id"], c["nodes"][1], six(c["cycle_risk_score"]))), ",")
    made = bundle_without_forest(t)
    return made.select("statement_id", F.col("account_summary.observed_period.start").alias("start"), F.col("account_summary.observed_period.end").alias("end"), F.col("account_summary.transaction_count").alias("n"), F.round("account_summary.extraction_confidence", 6).alias("rate"), F.round("account_summary.statement_likelihood_score", 6).alias("ood"), F.col("guardrail_log.ood_check_passed").alias("passed"), F.array_join(F.transform("triggered_rules", lambda r: r["id"]), ",").alias("fired"), F.size("features").cast("long").alias("features"), named.alias("cycles"), F.col("anomaly_detail.availability_reason").alias("lacking"), rules.alias("rules_told"), cycles.alias("cycles_told"))


register("C3_P16_P17_facts", transactions, bundle_facts, SQL_TXN,
         STAR + FACTS + f""" SELECT t.statement_id, start, "end", n, round(reconciliation_rate, 6) AS rate, round(score, 6) AS ood, score >= 0.5 AS passed, fired, {len(f.FEATURES)}::BIGINT AS features, coalesce(cycles, '') AS cycles, '{s.NO_COHORT}' AS lacking,
         CASE WHEN fired = '' THEN 'none triggered' ELSE array_to_string([x || ' (' || {POINTS}[x] || ' pts)' FOR x IN string_split(fired, ',')[1:3]], ', ') END AS rules_told, CASE WHEN told IS NULL THEN '' ELSE 'Detected cycles: ' || told || '. ' END AS cycles_told
         FROM (SELECT statement_id, CAST(min(txn_date) AS VARCHAR) AS start, CAST(max(txn_date) AS VARCHAR) AS "end", count(*) AS n FROM txn GROUP BY 1) t JOIN go ON f = t.statement_id JOIN fr ON fr.statement_id = t.statement_id JOIN rt ON rt.statement_id = t.statement_id LEFT JOIN cl ON cl.statement_id = t.statement_id""")
register("P9_txn_page", transactions, lambda t: v.txn_page(t, 8, search="payee", low=100.0, size=20).select("row_id", F.col("txn_date").cast("string"), "narration"), SQL_TXN, "SELECT row_id, CAST(txn_date AS VARCHAR) AS txn_date, narration FROM txn WHERE statement_id = 8 AND narration ILIKE '%payee%' AND (debit >= 10000 OR credit >= 10000) ORDER BY txn.txn_date, row_index LIMIT 20")
register("P9_txn_total", transactions, lambda t: v.matching_txns(t, 8, search="payee", low=100.0).agg(F.count("*").alias("n")), SQL_TXN, "SELECT count(*) AS n FROM txn WHERE statement_id = 8 AND narration ILIKE '%payee%' AND (debit >= 10000 OR credit >= 10000)")
register("P10_node_txn_page", mirrored_case, lambda t: v.node_txn_page(c.case_edges(t), t, 1, "S3", size=30).select("row_id", "reference_no"), SQL_CASE, BEHIND + " SELECT row_id, reference_no FROM pe JOIN ce USING (case_id, edge_id) WHERE case_id = 1 AND 'S3' IN (src, dst) ORDER BY txn_date, row_id LIMIT 30")
register("P10_node_txn_ranges", mirrored_case, lambda t: v.node_txn_page(c.case_edges(t), t, 1, "S3", "out", 3, ("1995-02-01", "1995-06-30"), (1020, 1070)).select("row_id", "reference_no"), SQL_CASE,
         BEHIND + " SELECT row_id, reference_no FROM pe JOIN ce USING (case_id, edge_id) WHERE case_id = 1 AND src = 'S3' AND statement_id = 3 AND txn_date BETWEEN DATE '1995-02-01' AND DATE '1995-06-30' AND pe.amount BETWEEN 102000 AND 107000 ORDER BY txn_date, row_id LIMIT 50")
register("J1_txn_counterparty", transactions, lambda t: v.txn_counterparty(t, t.where("counterparty is not null").groupBy("statement_id", "counterparty").agg(F.min("row_index").alias("first_row"))).select("row_id", "first_row"), SQL_TXN, ", f AS (SELECT statement_id, counterparty, min(row_index) AS first_row FROM txn WHERE counterparty IS NOT NULL GROUP BY ALL) SELECT row_id, first_row FROM txn LEFT JOIN f USING (statement_id, counterparty)")
register("J6_reference_cohort", transactions, lambda t: v.reference_cohort(t.groupBy("statement_id").agg(F.count("*").cast("double").alias("value")).withColumn("name", F.lit("n"))), SQL_TXN, ", n AS (SELECT statement_id, count(*)::DOUBLE AS value FROM txn GROUP BY 1) SELECT statement_id, 'n' AS name, (SELECT sum(value) FROM n) - value AS others_sum, (SELECT count(*) FROM n) - 1 AS others FROM n")
register("J7_bounds", transfers, lambda t: v.bounds(b.bank_legs(b.derive(t))), SQL_TRF, DERIVED + " SELECT bank, CAST(min(CASE WHEN way = 'out' THEN day END) AS VARCHAR) AS first_sent, CAST(max(CASE WHEN way = 'out' THEN day END) AS VARCHAR) AS last_sent, CAST(min(CASE WHEN way = 'in' THEN day END) AS VARCHAR) AS first_received, CAST(max(CASE WHEN way = 'in' THEN day END) AS VARCHAR) AS last_received, CAST(count_if(way = 'out') AS BIGINT) AS n_sent, CAST(count_if(way = 'in') AS BIGINT) AS n_received, coalesce(sum(CASE WHEN way = 'out' THEN amount END), 0) / 100.0 AS sent, coalesce(sum(CASE WHEN way = 'in' THEN amount END), 0) / 100.0 AS received FROM l GROUP BY bank")
register("J8_case_membership", mirrored_case, lambda t: t.select("case_id", "statement_id").distinct(), SQL_CASE, "SELECT DISTINCT case_id, statement_id FROM legs")
QUERIES["J8_case_statements"] = lambda spark, d: c.case_statements(transactions(spark, d).groupBy("statement_id").agg(F.count("*").alias("n")), mirrored_case(spark, d).select("case_id", "statement_id"))
ORACLES["J8_case_statements"] = f"WITH {SQL_TXN}, members AS (WITH {SQL_CASE} SELECT DISTINCT statement_id FROM legs) SELECT statement_id, count(*) AS n FROM txn SEMI JOIN members USING (statement_id) GROUP BY 1"
register("P14_statement_summary", transactions, summaries, SQL_TXN,
         GRID + f", fr AS ({RISK_SQL['R1_rule_eval']}), rt AS ({ACCOUNT_SQL['Q1_reconcile']}), dc AS (SELECT *, round(0.65 * rule_score, 1) AS fused, CASE WHEN reconciliation_rate >= 0.98 THEN 'high' WHEN reconciliation_rate >= 0.85 THEN 'medium' ELSE 'low' END AS ext FROM fr JOIN rt USING (statement_id)) SELECT statement_id, n, {OOD_TIER} AS ood_tier, CASE WHEN fused >= 75 AND fired <> '' AND ext <> 'low' THEN 'CONFIRMED_SUSPICIOUS' WHEN fused <= 25 AND ext = 'high' THEN 'LIKELY_LEGITIMATE' ELSE 'REVIEW_REQUIRED' END AS tier, fused AS score FROM (SELECT statement_id, count(*) AS n FROM txn GROUP BY 1) JOIN dc USING (statement_id) JOIN go ON f = statement_id")
register("P20_statement_rollup", transactions, lambda t: v.statement_rollup(scored(t).join(t.groupBy("statement_id").agg(F.count("*").alias("n")), "statement_id")))


def isolated(t):
    features = features_of(t)
    return isolation_of(features).join(s.top_distances(s.cohort_long(features)), "statement_id")


def modelled(t):
    """Accounts of the ledger with simple features, a label and a split."""
    ledger = f.account_ledger(t)
    rows = ledger.groupBy("account_id").agg(F.count("debit").cast("double").alias("n_out"), F.count("credit").cast("double").alias("n_in"), F.coalesce(F.sum("debit").cast("double"), F.lit(0.0)).alias("out"), F.coalesce(F.sum("credit").cast("double"), F.lit(0.0)).alias("into"), F.max("labelled").cast("int").alias("label"))
    return written(rows, "accounts")


MODELLED = ["n_out", "n_in", "out", "into"]


def governed(t):
    """Training and test rows with probabilities of a model that was saved with its manifest and passed the gate."""
    rows = written(m.split(modelled(t), "account_id", "label"), "split")
    train = rows.where("not is_test")
    path = folder(t.sparkSession, "model")
    m.save_model(m.train_classifier(train, MODELLED, "label"), path, MODELLED, dict.fromkeys(m.MANIFEST, "see README"))
    return written(m.predict_supervised(rows, path, MODELLED, enabled=True), "predictions")


def calibrated(t):
    """Test rows calibrated by the training rows."""
    scored_ = governed(t)
    return m.calibrate(scored_.where("not is_test"), scored_.where("is_test"), "label")


#: Accounts of the ledger with their labels, and a score and a second one of the flow that both languages have.
ACCOUNTS = ", ac AS (SELECT account_id, CAST(max(CASE WHEN labelled THEN 1 ELSE 0 END) AS INTEGER) AS label, count_if(way = 'out') AS o, count_if(way = 'in') AS i FROM (SELECT from_account AS account_id, labelled, 'out' AS way FROM trf UNION ALL SELECT to_account, labelled, 'in' FROM trf) GROUP BY 1)"
register("M1_stratified_split", transfers, lambda t: m.split(modelled(t), "account_id", "label").select("account_id", "label", "is_test"), SQL_TRF,
         ACCOUNTS + " SELECT account_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(account_id || ':42'), account_id) <= floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5) AS is_test FROM ac")
register("M3_gate_shut", transfers, lambda t: m.predict_supervised(modelled(t), "", MODELLED, enabled=False).select("account_id", "probability", "unavailable_reason"), SQL_TRF,
         ACCOUNTS + " SELECT account_id, CAST(NULL AS DOUBLE) AS probability, 'disabled_by_configuration' AS unavailable_reason FROM ac")


def flow_scores(t):
    """The share of an account's transfers that go out as its score, and that drawn in to the middle as a second one."""
    share = F.col("n_out") / (F.col("n_out") + F.col("n_in"))
    return modelled(t).select("label", F.round(share, 3).alias("score")).withColumn("second", 0.25 + F.col("score") / 2)


M4 = ("brier", "brier_calibrated", "base_rate", "brier_base_rate", "pr_auc", *(f"{k}_{p}" for p in (5, 7, 9) for k in ("recall", "threshold")))
register("M4_metrics_of_flow_scores", transfers, lambda t: m.eval_metrics(flow_scores(t), "score", "label", "second").select(*(F.round(c, 9).alias(c) for c in M4)), SQL_TRF,
         ACCOUNTS + """, sc AS (SELECT label, round(o / (o + i), 3) AS score FROM ac), cu AS (SELECT score, sum(sum(label)) OVER w / sum(count(*)) OVER w AS p, sum(sum(label)) OVER w / (SELECT sum(label) FROM sc) AS r, sum(label) / (SELECT sum(label) FROM sc) AS g FROM sc GROUP BY score WINDOW w AS (ORDER BY score DESC))
         SELECT round(b, 9) AS brier, round(b2, 9) AS brier_calibrated, round(br, 9) AS base_rate, round(br * (1 - br), 9) AS brier_base_rate, round(auc, 9) AS pr_auc, """ + ", ".join(f"round(coalesce(r{p}, 0), 9) AS recall_{p}, round(t{p}, 9) AS threshold_{p}" for p in (5, 7, 9)) + " FROM (SELECT avg((score - label) ** 2) AS b, avg((0.25 + score / 2 - label) ** 2) AS b2, avg(label) AS br FROM sc), (SELECT sum(p * g) AS auc, " + ", ".join(f"max(r) FILTER (p >= 0.{p}) AS r{p}, min(score) FILTER (p >= 0.{p}) AS t{p}" for p in (5, 7, 9)) + " FROM cu)")
register("A3_isolation_forest", transactions, isolated)
register("A4_anomaly_score", transactions, lambda t: anomaly(features_of(t)))
register("M1_M3_predictions", transfers, lambda t: governed(t).where("is_test").select("account_id", "label", "probability", "unavailable_reason"))
register("M2_calibrate", transfers, lambda t: calibrated(t).select("account_id", "label", "calibrated"))
register("M4_eval_metrics", transfers, lambda t: m.eval_metrics(calibrated(t), "probability", "label", "calibrated"))
