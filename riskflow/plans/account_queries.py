"""Registered queries on statements: quality and features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import quality as q
from ..sources.adapters import SQL_TRF, SQL_TXN, transactions, transfers

QUERIES, ORACLES = {}, {}


def on_transactions(name, make, sql=None):
    QUERIES[name] = lambda spark, d: make(transactions(spark, d))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {SQL_TXN} {sql}"


def with_id(feature: str, expression: str) -> str:
    return f"SELECT statement_id, {expression} AS {feature} FROM txn GROUP BY statement_id"


LEGS = ", legs AS (SELECT statement_id, unnest([debit, credit]) AS amount FROM txn), pos AS (SELECT * FROM legs WHERE amount > 0), ids AS (SELECT DISTINCT statement_id FROM txn)"
RECONCILED = """, bal AS (
  SELECT *, lag(balance) OVER (PARTITION BY statement_id ORDER BY txn_date, row_index) AS before FROM txn
), rec AS (
  SELECT *, before IS NULL OR abs(before - coalesce(debit, 0) + coalesce(credit, 0) - balance) <= 1 AS is_reconciled FROM bal
)"""
ADB = """, steps AS (
  SELECT *, lead(balance) OVER w AS nxt, date_diff('day', txn_date, lead(txn_date) OVER w) AS days, row_number() OVER w AS pos
  FROM txn WINDOW w AS (PARTITION BY statement_id ORDER BY txn_date, row_index)
), adb AS (
  SELECT statement_id, coalesce(sum(CASE WHEN days > 0 THEN (balance + nxt) * days END) / 100.0 / 2 / sum(CASE WHEN days > 0 THEN days END), min_by(balance, pos) / 100.0) AS average_daily_balance
  FROM steps GROUP BY statement_id
)"""
#: Credits in order, each with the first debit left within a day: the pointer over the debits only moves on.
MATCHED = """, ct AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY ts, row_index) AS c, ts FROM txn WHERE credit > 0),
dt AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY ts, row_index) AS k, ts, debit FROM txn WHERE debit > 0),
cp AS (SELECT ct.statement_id, c, ct.ts, 1 + count(dt.k) AS p FROM ct LEFT JOIN dt ON dt.statement_id = ct.statement_id AND dt.ts <= ct.ts GROUP BY ALL),
mm AS (SELECT DISTINCT statement_id, 0::BIGINT AS c, 1::BIGINT AS k, NULL::BIGINT AS hit FROM ct UNION ALL
  SELECT m.statement_id, cp.c, coalesce(dt.k + 1, greatest(m.k, cp.p)), dt.k FROM mm m JOIN cp ON cp.statement_id = m.statement_id AND cp.c = m.c + 1
  LEFT JOIN dt ON dt.statement_id = m.statement_id AND dt.k = greatest(m.k, cp.p) AND dt.ts <= cp.ts + INTERVAL '24' HOUR),
md AS (SELECT mm.statement_id, dt.debit, (epoch_us(dt.ts) - epoch_us(cp.ts)) / 3.6e9::DOUBLE AS held FROM mm JOIN dt ON dt.statement_id = mm.statement_id AND dt.k = mm.hit JOIN cp ON cp.statement_id = mm.statement_id AND cp.c = mm.c)"""
RETENTION = MATCHED + """, kept AS (SELECT statement_id, sum(debit) AS m, median(held) AS h FROM md GROUP BY 1), cs AS (SELECT statement_id, coalesce(sum(credit), 0) AS c FROM txn GROUP BY 1)
  SELECT statement_id, round(CASE WHEN c = 0 THEN 1.0 ELSE greatest(0, 1 - coalesce(m, 0)::DOUBLE / c) END, 9) AS net_retention_ratio, h AS median_holding_time_hours FROM cs LEFT JOIN kept USING (statement_id)"""


def dormancy_sql(gap: int, rows: int, days: int) -> str:
    """Breaks by a scan over an account's distinct days that goes on behind each burst."""
    return f""", dd AS (SELECT statement_id, list_sort(list(DISTINCT txn_date)) AS d FROM txn GROUP BY 1), br AS (SELECT statement_id, 2::BIGINT AS i, 0::BIGINT AS n FROM dd UNION ALL
  SELECT statement_id, CASE WHEN silent > {gap} AND burst >= {rows} THEN i + burst + 1 ELSE i + 1 END, CASE WHEN silent > {gap} AND burst >= {rows} THEN n + 1 ELSE n END
  FROM (SELECT statement_id, i, n, date_diff('day', d[i - 1], d[i]) AS silent, (SELECT count(*) FROM (SELECT unnest(d) AS x) WHERE x BETWEEN d[i] AND d[i] + {days}) AS burst FROM br JOIN dd USING (statement_id) WHERE i <= len(d)))
  SELECT statement_id, max(n) AS dormancy_breaks FROM br GROUP BY 1"""


NIGHT = "CASE WHEN dayofweek(txn_date) IN (0, 6) OR hour(ts) >= 22 OR hour(ts) < 6 THEN 1 ELSE 0 END"

on_transactions("S4_scan_statement_tables", lambda t: t.select("statement_id", "row_id", F.col("txn_date").cast("string"), F.col("debit").cast("double"), F.col("credit").cast("double"), F.col("balance").cast("double"), "narration", "reference_no"),
                "SELECT statement_id, row_id, CAST(txn_date AS VARCHAR) AS txn_date, debit / 100.0 AS debit, credit / 100.0 AS credit, balance / 100.0 AS balance, narration, reference_no FROM txn")
on_transactions("Q1_reconcile", q.reconciliation_rate, RECONCILED + " SELECT statement_id, count_if(is_reconciled) / count(*) AS reconciliation_rate FROM rec GROUP BY statement_id")
on_transactions("Q2_row_confidence", q.row_confidence, RECONCILED + """ SELECT row_id, (1.0::DOUBLE + CASE WHEN debit IS NOT NULL OR credit IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE + CASE WHEN is_reconciled THEN 1.0 ELSE 0.5 END::DOUBLE) / 3 AS row_confidence FROM rec""")
on_transactions("Q3_extraction_tier", q.extraction_tiers, RECONCILED + """, r AS (SELECT statement_id, count_if(is_reconciled) / count(*) AS r FROM rec GROUP BY statement_id)
  SELECT statement_id, CASE WHEN r >= 0.98 THEN 'high' WHEN r >= 0.85 THEN 'medium' ELSE 'low' END AS tier FROM r""")
on_transactions("F1_account_age", f.account_age, with_id("account_age_days_observed", "date_diff('day', min(txn_date), max(txn_date))"))
on_transactions("F2_dormancy_breaks", lambda t: f.dormancy_breaks(t, gap=1, rows=2, days=3), dormancy_sql(1, 2, 3))
on_transactions("F3_first_week_activity", f.first_week_activity, ", d AS (SELECT *, min(txn_date) OVER (PARTITION BY statement_id) AS first FROM txn) SELECT statement_id, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN date_diff('day', first, txn_date) <= 7 THEN 1.0::DOUBLE ELSE 0 END) END AS first_week_activity_ratio FROM d GROUP BY statement_id")
on_transactions("F4_days_since_last", lambda t: f.days_since_last(t, "2024-03-01"), with_id("days_since_last_activity", "greatest(0, date_diff('day', max(txn_date), DATE '2024-03-01'))"))
on_transactions("F5_match_credit_debit_24h", f.matched_debits, MATCHED + " SELECT statement_id, debit / 100.0 AS matched, held AS held_hours FROM md")
on_transactions("F6_F7_retention", lambda t: f.retention(t).withColumn("net_retention_ratio", F.round("net_retention_ratio", 9)), RETENTION)
on_transactions("F8_average_daily_balance", f.average_daily_balance, ADB + " SELECT * FROM adb")
on_transactions("F9_turnover_ratio", f.turnover, ADB + """, flow AS (SELECT statement_id, (coalesce(sum(debit), 0) + coalesce(sum(credit), 0)) / 100.0 AS flow FROM txn GROUP BY statement_id)
  SELECT statement_id, CASE WHEN flow = 0 THEN 0.0 WHEN average_daily_balance > 0 THEN flow / average_daily_balance END AS turnover_ratio FROM flow LEFT JOIN adb USING (statement_id)""")
on_transactions("F10_velocity", f.velocity, ", v AS (SELECT statement_id, count(*) OVER (PARTITION BY statement_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS n FROM txn) SELECT statement_id, max(n) AS inflow_outflow_velocity FROM v GROUP BY statement_id")
on_transactions("F10_daily_velocity", f.daily_velocity, ", v AS (SELECT statement_id, txn_date, count(*) AS n FROM txn GROUP BY ALL) SELECT statement_id, max(n) AS peak_daily FROM v GROUP BY statement_id")
on_transactions("F11_weekend_ratio", f.weekend_ratio, with_id("weekend_night_activity_ratio", "avg(CASE WHEN dayofweek(txn_date) IN (0, 6) THEN 1.0::DOUBLE ELSE 0 END)"))
on_transactions("F11_weekend_night_ratio", lambda t: f.weekend_ratio(t, True), with_id("weekend_night_activity_ratio", f"avg({NIGHT}::DOUBLE)"))
on_transactions("F12_near_threshold", f.near_threshold, LEGS + ", h AS (SELECT statement_id, count_if(amount / 100.0 BETWEEN 45000 AND 50000 OR amount / 100.0 BETWEEN 180000 AND 200000) / count(*) AS r FROM pos GROUP BY statement_id) SELECT statement_id, coalesce(r, 0) AS near_threshold_ratio FROM ids LEFT JOIN h USING (statement_id)")
on_transactions("F13_round_numbers", f.round_numbers, LEGS + ", h AS (SELECT statement_id, count_if(amount % 100000 < 1 OR amount % 1000000 < 1) / count(*) AS r FROM pos GROUP BY statement_id) SELECT statement_id, coalesce(r, 0) AS round_number_ratio FROM ids LEFT JOIN h USING (statement_id)")
on_transactions("F14_benford", f.benford, LEGS + """, al AS (SELECT statement_id, count(*) AS al FROM pos GROUP BY statement_id),
  g AS (SELECT statement_id, CAST(left(CAST(amount // 100 AS VARCHAR), 1) AS INTEGER) AS d FROM pos WHERE amount >= 100),
  n AS (SELECT statement_id, count(*) AS n FROM g GROUP BY statement_id),
  o AS (SELECT n.statement_id, n.n, d.d, n.n * log10(1 + 1.0::DOUBLE / d.d) AS e, (SELECT count(*) FROM g WHERE g.statement_id = n.statement_id AND g.d = d.d) AS c FROM n CROSS JOIN range(1, 10) d(d)),
  chi AS (SELECT statement_id, sum((c - e) * (c - e) / greatest(e, 1) ORDER BY d) AS chi FROM o GROUP BY statement_id)
  SELECT statement_id, CASE WHEN al >= 10 AND chi IS NOT NULL THEN round(chi, 6) ELSE 0 END AS benford_deviation_score FROM ids LEFT JOIN al USING (statement_id) LEFT JOIN chi USING (statement_id)""")
QUERIES["F14_benford"] = lambda spark, d: f.benford(transactions(spark, d)).withColumn("benford_deviation_score", F.round("benford_deviation_score", 6))
on_transactions("F15_fan_in", f.fan_in, with_id("fan_in_score", "coalesce(count(DISTINCT CASE WHEN credit > 0 THEN coalesce(counterparty, 'UNKNOWN') END) / nullif(count_if(credit > 0), 0), 0)"))
on_transactions("F16_fan_out", f.fan_out, with_id("fan_out_score", "coalesce(count(DISTINCT CASE WHEN debit > 0 THEN coalesce(counterparty, 'UNKNOWN') END) / nullif(count_if(debit > 0), 0), 0)"))
on_transactions("F17_counterparty_hhi", lambda t: f.counterparty_hhi(t).withColumn("counterparty_concentration_hhi", F.round("counterparty_concentration_hhi", 9)), LEGS + """, s AS (SELECT statement_id, counterparty, sum(coalesce(debit, 0) + coalesce(credit, 0)) / 100.0 AS s FROM txn WHERE counterparty IS NOT NULL GROUP BY ALL),
  h AS (SELECT statement_id, CASE WHEN sum(s) > 0 THEN sum(s * s) / (sum(s) * sum(s)) END AS h FROM s GROUP BY statement_id)
  SELECT statement_id, round(h, 9) AS counterparty_concentration_hhi FROM ids LEFT JOIN h USING (statement_id)""")
on_transactions("F2_dormancy_default", f.dormancy_breaks, dormancy_sql(30, 3, 3))
SOURCES = ("F1_account_age", "F2_dormancy_default", "F3_first_week_activity", "F6_F7_retention", "F8_average_daily_balance", "F9_turnover_ratio", "F10_velocity", "F11_weekend_ratio", "F12_near_threshold", "F13_round_numbers", "F14_benford", "F15_fan_in", "F16_fan_out", "F17_counterparty_hhi")
#: All features of every account, from the SQL of each.
FEATURES_SQL = "SELECT statement_id, " + ", ".join(f"{n}::DOUBLE AS {n}" for n in f.FEATURES) + " FROM (SELECT DISTINCT user_id AS statement_id FROM events) " + " ".join(f"LEFT JOIN ({ORACLES[s]}) USING (statement_id)" for s in SOURCES)
LONG_SQL = "SELECT statement_id, u.name AS name, u.value AS value, u.family AS family FROM (SELECT statement_id, unnest([" + ", ".join(f"struct_pack(name := '{n}', value := {n}, family := '{k}')" for n, (k, _) in f.FEATURES.items()) + f"]) AS u FROM ({FEATURES_SQL}))"
QUERIES["F20_feature_long"] = lambda spark, d: f.feature_long(f.all_features(transactions(spark, d))).withColumn("value", F.round("value", 6))
ORACLES["F20_feature_long"] = f"SELECT statement_id, name, round(value, 6) AS value, family FROM ({LONG_SQL})"
on_transactions("P22_features_by_family", lambda t: f.features_by_family(f.feature_long(f.all_features(t))), """, fam AS (SELECT * FROM (VALUES
  ('behavior', 4, 'average_daily_balance,median_holding_time_hours,net_retention_ratio,turnover_ratio'), ('identity', 1, 'counterparty_concentration_hhi'), ('lifecycle', 3, 'account_age_days_observed,dormancy_breaks,first_week_activity_ratio'),
  ('structuring', 5, 'benford_deviation_score,fan_in_score,fan_out_score,near_threshold_ratio,round_number_ratio'), ('velocity', 2, 'inflow_outflow_velocity,weekend_night_activity_ratio')) v(family, n, names))
  SELECT statement_id, family, CAST(n AS BIGINT) AS n, names FROM (SELECT DISTINCT statement_id FROM txn) CROSS JOIN fam""")
LEDGER = """, led AS (SELECT from_account AS account_id, row_idx, ts, labelled, amount AS debit, NULL AS credit, to_account AS counterparty FROM trf
  UNION ALL SELECT to_account, row_idx, ts, labelled, NULL, amount, from_account FROM trf)"""
QUERIES["F21_account_ledger"] = lambda spark, d: f.account_ledger(transfers(spark, d)).select("account_id", "row_idx", F.col("debit").cast("double"), F.col("credit").cast("double"), "counterparty")
ORACLES["F21_account_ledger"] = f"WITH {SQL_TRF} {LEDGER} SELECT account_id, row_idx, debit / 100.0 AS debit, credit / 100.0 AS credit, counterparty FROM led"
QUERIES["F22_account_dataset"] = lambda spark, d: f.account_dataset(transfers(spark, d), recent=50).groupBy("account_id").agg(F.count("*").alias("n"), F.max("label").alias("label"), F.max_by("row_idx", F.struct("ts", "row_idx")).alias("latest"))
ORACLES["F22_account_dataset"] = f"WITH {SQL_TRF} {LEDGER} SELECT account_id, least(count(*), 50) AS n, bool_or(labelled) AS label, max_by(row_idx, struct_pack(t := ts, r := row_idx)) AS latest FROM led GROUP BY account_id"
