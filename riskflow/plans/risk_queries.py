"""Registered queries on graphs, rules, cases and banks, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import narration as n
from ..operators import banks as b
from ..operators import cases as c
from ..operators import evidence as ev
from ..operators import features as f
from ..operators import graph as g
from ..operators import models as m
from ..operators import quality as q
from ..operators import scoring as s
from ..sources.adapters import SQL_BULK, SQL_CASE, SQL_TRF, SQL_TXN, bulk_transfers, mirrored_case, transactions, transfers
from ..sources.shared import written
from .account_queries import FEATURES_SQL, LONG_SQL
from .account_queries import ORACLES as ACCOUNT_SQL
from .narration_queries import CODES, raw_grids

QUERIES, ORACLES = {}, {}


def register(name, source, make, cte=None, sql=None):
    QUERIES[name] = lambda spark, d: make(source(spark, d))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {cte} {sql}"


STAR = """, cyc AS (
  SELECT statement_id, counterparty, count(debit) AS d, count(credit) AS c, count(*) AS edges, stddev_samp(coalesce(debit, credit) / 100.0) AS s, avg(coalesce(debit, credit) / 100.0) AS m
  FROM txn WHERE (coalesce(debit, 0) > 0 OR coalesce(credit, 0) > 0) AND counterparty IS NOT NULL GROUP BY ALL HAVING count(debit) > 0 AND count(credit) > 0
), span AS (SELECT statement_id, greatest(date_diff('day', min(txn_date), max(txn_date))::DOUBLE, 0.1) AS days FROM txn GROUP BY 1),
sc AS (
  SELECT statement_id, counterparty, edges, days, greatest(0, 1 - coalesce(s, 0) / m) AS cons, sum(edges) OVER (PARTITION BY statement_id) AS al FROM cyc JOIN span USING (statement_id)
), star AS (
  SELECT statement_id, counterparty, edges, cons, 0.35 * cons + 0.30 * least(2 / days / 10, 1) + 0.20 * least(edges / 2, 1) + 0.15 / 2 AS risk FROM sc WHERE al <= 1000
)"""
register("G1_star_edges", transactions, lambda t: g.star_edges(t).select("statement_id", "src", "dst", F.col("amount").cast("double"), "row_id"), SQL_TXN,
         "SELECT statement_id, 'ACCT_' || statement_id AS src, coalesce(counterparty, 'CPTY_' || row_id) AS dst, debit / 100.0 AS amount, row_id FROM txn WHERE debit > 0 UNION ALL SELECT statement_id, coalesce(counterparty, 'CPTY_' || row_id), 'ACCT_' || statement_id, credit / 100.0, row_id FROM txn WHERE credit > 0")
EDGES = ", e AS (SELECT statement_id, 'ACCT_' || statement_id AS src, coalesce(counterparty, 'CPTY_' || row_id) AS dst, debit AS amount, txn_date FROM txn WHERE debit > 0 UNION ALL SELECT statement_id, coalesce(counterparty, 'CPTY_' || row_id), 'ACCT_' || statement_id, credit, txn_date FROM txn WHERE credit > 0)"
register("G2_star_nodes", transactions, lambda t: g.star_nodes(g.star_edges(t)), SQL_TXN, EDGES + " SELECT statement_id, node, sum(amount) / 100.0 AS flow, CAST(min(txn_date) AS VARCHAR) AS first_seen, CAST(max(txn_date) AS VARCHAR) AS last_seen FROM (SELECT *, unnest([src, dst]) AS node FROM e) GROUP BY ALL")
rounded = lambda df: df.select("statement_id", "counterparty", "edges", F.round("conservation", 6).alias("conservation"), F.round("risk", 6).alias("risk"))
register("G3_star_cycles", transactions, lambda t: rounded(g.star_cycles(t, 0.55)), SQL_TXN, STAR + " SELECT statement_id, counterparty, edges, round(cons, 6) AS conservation, round(risk, 6) AS risk FROM star WHERE risk >= 0.55")
register("G4_merge_statements", transactions, lambda t: rounded(g.star_cycles(g.merge_statements(t, [1, 2, 3]), 0.3)), SQL_TXN.replace("\n)\n", "\n)") + ", txn_all AS (SELECT * FROM txn)", STAR.replace("FROM txn", "FROM merged").replace(", cyc AS", ", merged AS (SELECT * REPLACE (-1::BIGINT AS statement_id) FROM txn WHERE statement_id IN (1, 2, 3)), cyc AS", 1) + " SELECT statement_id, counterparty, edges, round(cons, 6) AS conservation, round(risk, 6) AS risk FROM star WHERE risk >= 0.3")
register("J10_tag_cycles", transactions, lambda t: g.tag_cycles(t, g.star_cycles(t, 0.3)), SQL_TXN, STAR + ", st AS (SELECT * FROM star WHERE risk >= 0.3) SELECT row_id, CAST(CASE WHEN s.counterparty IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_cycles FROM txn t LEFT JOIN st s ON s.statement_id = t.statement_id AND s.counterparty = t.counterparty AND (coalesce(debit, 0) > 0 OR coalesce(credit, 0) > 0)")
register("F19_max_cycle_risk", transactions, lambda t: g.max_cycle_risk(t, g.star_cycles(t)).withColumn("max_cycle_risk_score", F.round("max_cycle_risk_score", 6)), SQL_TXN, STAR + ", r AS (SELECT statement_id, max(risk) AS r FROM star WHERE risk >= 0.6 GROUP BY 1) SELECT statement_id, round(coalesce(r, 0), 6) AS max_cycle_risk_score FROM (SELECT DISTINCT statement_id FROM txn) LEFT JOIN r USING (statement_id)")


def anomaly(features):
    """Each account against all others: the share of its flagged features and its isolation."""
    return s.anomaly_score(s.mad_flags(s.cohort_long(features)), isolation_of(features))


def isolation_of(features):
    return m.isolation_forest(features, "statement_id", list(s.NAMES))


def plausibility(t):
    """Q4 and Q5 for the raw file of every statement."""
    cells, texts = raw_grids(t)
    return q.ood_score(cells, texts)


def rates(t):
    """statement_id, rate and extraction of every statement."""
    return q.reconciliation_rate(t).select("statement_id", F.col("reconciliation_rate").alias("rate"), q.extraction_tier(F.col("reconciliation_rate")).alias("extraction"))


def scored(t):
    """Rules, anomaly, fused score, tier and its reason of every account; no supervised model is enabled."""
    features = features_of(t)
    return ev.decisions(ev.fired_rules(features), anomaly(features), rates(t))


def features_of(t):
    risk_ = g.max_cycle_risk(t, g.star_cycles(t)).withColumn("max_cycle_risk_score", f.half_up(F.col("max_cycle_risk_score"), 6))
    return written(f.all_features(t).join(risk_, "statement_id", "left"), "features")


def limit_sql(token: str) -> str:
    """A threshold as s.threshold has it, over the columns of ft and its sorted list own."""
    if token == "critical_value_95":
        return str(config.BENFORD_CRITICAL)
    if token[0] == "p" and token[1:].isdigit():
        return f"own[least(len(own), CAST(floor(len(own) * {token[1:]} / 100) AS BIGINT) + 1)]"
    return token


def clauses_sql(text: str) -> list[tuple[str, str, str]]:
    return [(field, op, limit_sql(token)) for field, op, token in (part.split() for part in text.replace(" OR ", " AND ").split(" AND "))]


RULED = f", ft AS (SELECT *, list_sort([x FOR x IN [{', '.join(s.NAMES)}] IF x IS NOT NULL]) AS own FROM ({FEATURES_SQL}) LEFT JOIN ({ORACLES['F19_max_cycle_risk']}) USING (statement_id))"
HELD = {name: "(" + " AND ".join(f"coalesce({field} {op} {limit}, FALSE)" for field, op, limit in clauses_sql(text)) + ")" for name, _, text in config.RULES}
CLAUSES = ", ".join(f"struct_pack(rule := '{name}', clause := {k}, field := '{field}', op := '{op}', threshold := ({limit})::DOUBLE, actual := {field}, holds := coalesce({field} {op} {limit}, FALSE))" for name, _, text in config.RULES for k, (field, op, limit) in enumerate(clauses_sql(text)))
register("R1_rule_eval", transactions, lambda t: s.evaluate_rules(features_of(t)), SQL_TXN,
         RULED + " SELECT statement_id, CAST(least(100, " + " + ".join(f"CASE WHEN {HELD[name]} THEN {points} ELSE 0 END" for name, points, _ in config.RULES) + ") AS BIGINT) AS rule_score, coalesce(array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {h} THEN '{name}' END" for name, h in HELD.items()) + "] IF x IS NOT NULL], ','), '') AS fired FROM ft")
register("R2_R3_rule_clauses", transactions, lambda t: s.rule_clauses(features_of(t)).withColumns({c: f.half_up(F.col(c), 6) for c in ("threshold", "actual")}), SQL_TXN,
         RULED + f" SELECT statement_id, u.rule AS rule, u.clause AS clause, u.field AS field, u.op AS op, round(u.threshold, 6) AS threshold, round(u.actual, 6) AS actual, u.holds AS holds FROM (SELECT statement_id, unnest([{CLAUSES}]) AS u FROM ft)")
#: Every feature of an account, and the median of all other accounts' values by comparing each with each.
OTHERS = RULED + f""", cl AS (SELECT statement_id, u.name AS name, u.value AS value FROM (SELECT statement_id, unnest([{", ".join(f"struct_pack(name := '{x}', value := coalesce({x}, 0)::DOUBLE)" for x in s.NAMES)}]) AS u FROM ft)),
cm AS (SELECT a.statement_id, a.name, any_value(a.value) AS value, median(b.value) AS m, count(*) AS others FROM cl a JOIN cl b ON a.name = b.name AND a.statement_id <> b.statement_id GROUP BY 1, 2)"""
register("A2_mad_flags", transactions, lambda t: s.mad_flags(s.cohort_long(features_of(t))), SQL_TXN,
         OTHERS + f""", cd AS (SELECT a.statement_id, a.name, any_value(a.value) AS value, any_value(m) AS m, median(abs(b.value - m)) AS mad, any_value(others) AS others FROM cm a JOIN cl b ON a.name = b.name AND a.statement_id <> b.statement_id GROUP BY 1, 2),
         cz AS (SELECT *, mad > 0 AND abs(0.6745 * (value - m) / mad) > {config.ROBUST_Z} AS far FROM cd)
         SELECT statement_id, CAST(count_if(far) AS BIGINT) AS n_flags, coalesce(string_agg(CASE WHEN far THEN name END, ',' ORDER BY name), '') AS flagged, CAST(NULL AS VARCHAR) AS reason FROM cz WHERE others >= {config.LEAST_COHORT} GROUP BY 1""")
register("A3_top_features", transactions, lambda t: s.top_distances(s.cohort_long(features_of(t))), SQL_TXN,
         OTHERS + " SELECT statement_id, array_to_string(list(name ORDER BY abs(value - m) DESC, name)[1:5], ',') AS top_features, CAST(NULL AS VARCHAR) AS reason FROM cm GROUP BY 1")
register("C1_C2_account_risk", transactions, lambda t: scored(t).select("statement_id", "rule_score", "fired", "anomaly_score", "score", "formula", "tier", "decision_reason"))
register("W3_score_breakdown", transactions, lambda t: ev.score_breakdown(scored(t)))
register("A1_robust_z", transactions, lambda t: s.robust_z(t.groupBy("statement_id").agg(F.count("*").alias("n")), "n").select("statement_id", F.round("z", 9).alias("z")), SQL_TXN,
         ", n AS (SELECT statement_id, count(*) AS n FROM txn GROUP BY 1), m AS (SELECT median(n) AS m FROM n), d AS (SELECT statement_id, n, m, abs(n - m) AS d FROM n, m), mad AS (SELECT median(d) AS mad FROM d) SELECT statement_id, round(CASE WHEN mad > 0 THEN 0.6745 * (n - m) / mad ELSE 0 END, 9) AS z FROM d, mad")
METRIC = ", r AS (SELECT row_id, CASE WHEN credit IS NOT NULL THEN 1 ELSE 0 END AS y, row_index % 101 AS score FROM txn), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, y DESC) AS k FROM r), t AS (SELECT count_if(score >= 50 AND y = 1)::DOUBLE AS tp, count_if(score >= 50 AND y = 0)::DOUBLE AS fp, count_if(score < 50 AND y = 1)::DOUBLE AS fn, count_if(score < 50 AND y = 0)::DOUBLE AS tn, count(*) AS n, count_if(k <= ceil((SELECT count(*) FROM r) * 0.05) AND y = 1) AS hits, ceil(count(*) * 0.05) AS kk FROM o)"
register("M5_baseline_eval", transactions, lambda t: s.binary_metrics(t.select("row_id", F.col("credit").isNotNull().cast("int").alias("y"), (F.col("row_index") % 101).alias("score")), "score", "y", 50), SQL_TXN,
         METRIC + " SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, fp / (fp + tn) AS fpr, (hits / kk) / ((tp + fn) / n) AS lift FROM t")

# Cases.
PAIRS = """, o AS (SELECT *, CASE WHEN length(regexp_replace(upper(reference_no), '[^A-Z0-9]', '', 'g')) >= 6 THEN regexp_replace(upper(reference_no), '[^A-Z0-9]', '', 'g') END AS ref, coalesce(debit, 0) > 0 AS is_debit, coalesce(debit, credit) AS amount FROM legs),
m AS (SELECT a.case_id, a.row_id, count(*) AS n_mirrors, min(b.row_id) AS mirror FROM o a JOIN o b ON a.case_id = b.case_id AND a.ref = b.ref AND a.statement_id <> b.statement_id AND a.is_debit <> b.is_debit AND abs(a.amount - b.amount) <= 1 AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 1 GROUP BY ALL),
p AS (SELECT o.*, coalesce(n_mirrors, 0) AS n_mirrors, mirror, max(CASE WHEN coalesce(n_mirrors, 0) <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o.case_id, o.ref) = 1 AS ambiguous FROM o LEFT JOIN m ON o.case_id = m.case_id AND o.row_id = m.row_id)"""
register("J2_mirrored_reference", mirrored_case, lambda t: c.mirrored_pairs(t).select("case_id", "ref", "row_id", "n_mirrors", "ambiguous"), SQL_CASE, PAIRS + " SELECT case_id, ref, row_id, n_mirrors, ambiguous FROM p")
GEDGES = PAIRS + """, ce AS (
  SELECT case_id, 'E' || left(sha256(case_id || '|' || ref || '|' || least(row_id, mirror) || '+' || greatest(row_id, mirror)), 20) AS edge_id, 'S' || max(CASE WHEN is_debit THEN statement_id END) AS src, 'S' || max(CASE WHEN NOT is_debit THEN statement_id END) AS dst, max(amount) / 100.0 AS amount, 'mirrored_reference' AS resolution, min(txn_date) AS day
  FROM p WHERE NOT ambiguous GROUP BY case_id, ref, least(row_id, mirror), greatest(row_id, mirror)
  UNION ALL SELECT case_id, 'E' || left(sha256(case_id || '|' || row_id), 20), CASE WHEN is_debit THEN 'S' || statement_id ELSE 'S' || statement_id || ':' || counterparty END, CASE WHEN is_debit THEN 'S' || statement_id || ':' || counterparty ELSE 'S' || statement_id END, amount / 100.0, 'ambiguous_mirrored_reference', txn_date FROM p WHERE ambiguous)"""
register("G9_case_edges", mirrored_case, lambda t: c.case_edges(t).select("case_id", "edge_id", "src", "dst", F.col("amount").cast("double"), "resolution"), SQL_CASE, GEDGES + " SELECT * EXCLUDE (day) FROM ce")


def flows(source: str) -> str:
    """Conserved cycles of ``source`` (sc, idx, us, from_account, to_account, amount): all closed paths, then the earliest one of each ring of a scope sc."""
    return f""", ft AS ({source}),
ff AS (SELECT sc, list_sort(list(amount))[CAST(floor(0.6 * count(*)) AS BIGINT) + 1] AS least FROM ft GROUP BY sc),
fp AS (
  SELECT sc, from_account AS origin, to_account AS here, us AS t0, us AS latest, amount AS lead, [from_account, to_account] AS accounts, [idx] AS idxs, [amount] AS amounts FROM ft JOIN ff USING (sc) WHERE amount >= least
  UNION ALL
  SELECT p.sc, origin, n.to_account, t0, n.us, lead, CASE WHEN n.to_account = origin THEN accounts ELSE list_append(accounts, n.to_account) END, list_append(idxs, n.idx), list_append(amounts, n.amount)
  FROM fp p JOIN ft n ON p.sc = n.sc AND p.here = n.from_account AND n.us >= p.latest AND n.us <= p.t0 + 864000000000 AND abs(n.amount - p.lead) <= 0.25 * p.lead
  WHERE p.here <> p.origin AND len(p.idxs) < 6 AND (n.to_account = p.origin OR NOT list_contains(accounts, n.to_account)) AND NOT list_contains(idxs, n.idx)
), fr AS (
  SELECT *, list_sort([array_to_string(list_concat(accounts[i:], accounts[:i - 1]), '>') FOR i IN range(1, len(accounts) + 1)])[1] AS ring, len(idxs) AS hops FROM fp WHERE here = origin AND len(idxs) >= 3
), fo AS (
  SELECT sc, ring, hops, idxs, accounts, list_avg(amounts) AS mean_amount, greatest(0, 1 - list_stddev_samp(amounts) / list_avg(amounts)) AS conservation, greatest((latest - t0) / 86400000000.0, 0.01) AS span
  FROM fr QUALIFY row_number() OVER (PARTITION BY sc, ring ORDER BY t0, idxs[1], idxs) = 1
), cyc AS (SELECT * FROM (SELECT *, 0.35 * conservation + 0.30 * least(hops / span / 10, 1) + 0.20 / 3 + 0.15 / hops AS risk FROM fo) WHERE risk >= 0.5)"""


CASE_FLOWS = GEDGES + flows("SELECT case_id AS sc, edge_id AS idx, epoch_us(CAST(day AS TIMESTAMP)) AS us, src AS from_account, dst AS to_account, amount FROM ce WHERE resolution = 'mirrored_reference' AND src <> dst AND amount > 0")


def findings(t):
    edges = written(c.case_edges(t), "edges")
    return edges, written(c.case_findings(edges, checkpoint=lambda df: written(df, "paths")), "findings")


register("G10_case_findings", mirrored_case, lambda t: findings(t)[1].select("case_id", "ring", "hops", F.round("risk", 6).alias("risk")), SQL_CASE, CASE_FLOWS + " SELECT sc AS case_id, ring, hops, round(risk, 6) AS risk FROM cyc")
register("G11_case_graph_view", mirrored_case, lambda t: c.case_graph_view(*findings(t)), SQL_CASE,
         CASE_FLOWS + ", nd AS (SELECT case_id, node, count(*) AS n_edges FROM (SELECT case_id, unnest([src, dst]) AS node FROM ce) GROUP BY ALL), hi AS (SELECT DISTINCT sc, unnest(accounts) AS node FROM cyc) SELECT case_id, nd.node, n_edges, CASE WHEN hi.node IS NULL THEN 'low' ELSE 'high' END AS tier FROM nd LEFT JOIN hi ON hi.sc = nd.case_id AND hi.node = nd.node")


def case_graph(t):
    """The edges of all cases as one graph, nodes named by their case."""
    name = lambda c: F.concat_ws("|", "case_id", c)
    return written(c.case_edges(t).select(name("src").alias("src"), name("dst").alias("dst"), "amount", F.col("txn_date").alias("at")), "graph")


CASE_GRAPH = GEDGES + """, ge AS (SELECT case_id || '|' || src AS src, case_id || '|' || dst AS dst, amount, CAST(day AS TIMESTAMP) AS at_ FROM ce WHERE src <> dst), gp AS (SELECT DISTINCT src, dst FROM ge),
gr AS (SELECT src AS a, dst AS b FROM gp UNION SELECT a, dst FROM gr JOIN gp ON b = src), gc AS (SELECT x.a AS node, max(x.b) AS component FROM gr x JOIN gr y ON x.a = y.b AND x.b = y.a GROUP BY 1),
gn AS (SELECT node, min(at_) AS f, max(at_) AS l FROM (SELECT unnest([src, dst]) AS node, at_ FROM ge) GROUP BY 1),
gi AS (SELECT x.component, ge.src, ge.dst, amount FROM ge JOIN gc x ON x.node = ge.src JOIN gc y ON y.node = ge.dst AND y.component = x.component),
gs AS (SELECT component, count(*) AS n FROM gi GROUP BY 1), gq AS (SELECT DISTINCT gi.component, src, dst FROM gi JOIN gs USING (component) WHERE n <= 1000),
gw AS (SELECT [src, dst] AS nodes, src AS start, dst AS here FROM gq WHERE src < dst UNION ALL
  SELECT CASE WHEN q.dst = start THEN nodes ELSE list_append(nodes, q.dst) END, start, q.dst FROM gw JOIN gq q ON q.src = here WHERE here <> start AND (q.dst = start OR (len(nodes) < 6 AND q.dst > start AND NOT list_contains(nodes, q.dst)))),
gd AS (SELECT nodes, len(nodes) AS hops, array_to_string(nodes, '>') AS ring FROM gw WHERE here = start),
gh AS (SELECT ring, hops, nodes[i] AS u, nodes[i % hops + 1] AS v FROM (SELECT *, unnest(range(1, hops + 1)) AS i FROM gd)),
ga AS (SELECT ring, hops, count(*) AS edges, avg(amount) AS m, stddev_samp(amount) AS sd FROM gh JOIN ge ON ge.src = u AND ge.dst = v GROUP BY ALL),
gt AS (SELECT ring, min(f) AS f, max(l) AS l FROM gh JOIN gn ON gn.node = u GROUP BY 1),
gx AS (SELECT ring, hops, edges, greatest(0, 1 - coalesce(sd, 0) / m) AS conservation, CASE WHEN l > f THEN (epoch_us(l) - epoch_us(f)) / 86400000000.0 ELSE 0.1 END AS span FROM ga JOIN gt USING (ring)),
gy AS (SELECT ring, hops, edges, conservation, 0.35 * conservation + 0.30 * least(hops / span / 10, 1) + 0.20 * least(edges / hops, 1) + 0.15 / hops AS risk, FALSE AS dense FROM gx)"""
register("G11_case_edges_view", mirrored_case, lambda t: c.case_edges_view(*findings(t)).withColumn("amount", F.col("amount").cast("double")), SQL_CASE,
         CASE_FLOWS + ", fx AS (SELECT DISTINCT sc, unnest(idxs) AS edge_id FROM cyc) SELECT case_id, ce.edge_id, src, dst, ce.amount, resolution, fx.edge_id IS NOT NULL AS on_finding FROM ce LEFT JOIN fx ON fx.sc = ce.case_id AND fx.edge_id = ce.edge_id")
register("G3b_graph_cycles", mirrored_case, lambda t: g.graph_cycles(case_graph(t), 0.4, checkpoint=lambda df: written(df, "graph")).select(F.concat_ws(">", "nodes").alias("ring"), "hops", "edges", F.round("risk", 6).alias("risk"), "dense"), SQL_CASE,
         CASE_GRAPH + " SELECT ring, hops, edges, round(risk, 6) AS risk, dense FROM gy WHERE risk >= 0.4 UNION ALL SELECT component, 0, n, 0, TRUE FROM gs WHERE n > 1000")
register("J9_finding_edges", mirrored_case, lambda t: c.finding_edges(*findings(t)[::-1]).select("case_id", "ring", "hop", "edge_id", "src", "dst", F.col("amount").cast("double")), SQL_CASE,
         CASE_FLOWS + " SELECT sc AS case_id, ring, CAST(i - 1 AS INTEGER) AS hop, edge_id, src, dst, ce.amount FROM (SELECT *, unnest(range(1, hops + 1)) AS i FROM cyc) JOIN ce ON ce.case_id = sc AND ce.edge_id = idxs[i]")
def drafts(t):
    """Draft records with their hops and subjects as text."""
    hop = lambda h: F.concat_ws(":", h["hop"], h["src"], h["dst"], F.size(h["evidence"]))
    return c.draft_records(*findings(t)[::-1]).select("case_id", "ring", F.array_join(F.transform("hops", hop), ",").alias("hops"), F.array_join("subjects", ",").alias("subjects"), F.col("total").cast("double"), F.col("first_date").cast("string"), F.col("last_date").cast("string"), "filing_status", "summary")


register("G12_draft_records", mirrored_case, drafts, SQL_CASE, CASE_FLOWS + """, fh AS (SELECT sc AS case_id, ring, i, src, dst, ce.amount, day FROM (SELECT *, unnest(range(1, hops + 1)) AS i FROM cyc) JOIN ce ON ce.case_id = sc AND ce.edge_id = idxs[i]),
  fs AS (SELECT case_id, ring, string_agg(node, ',' ORDER BY node) AS subjects, count(*) AS parties FROM (SELECT DISTINCT case_id, ring, unnest([src, dst]) AS node FROM fh) GROUP BY 1, 2)
  SELECT case_id, ring, string_agg((i - 1) || ':' || src || ':' || dst || ':3', ',' ORDER BY i) AS hops, any_value(subjects) AS subjects, sum(amount) AS total, CAST(min(day) AS VARCHAR) AS first_date, CAST(max(day) AS VARCHAR) AS last_date, 'NOT_FILED' AS filing_status,
    format('{} transfers moved {:.2f} between {} parties from {} to {} and back.', count(*), sum(amount), any_value(parties), CAST(min(day) AS VARCHAR), CAST(max(day) AS VARCHAR)) AS summary FROM fh JOIN fs USING (case_id, ring) GROUP BY case_id, ring""")

# Banks.
DERIVED = """, d AS (SELECT *, CAST(ts AS DATE) AS day, coalesce(payment_currency <> receiving_currency, FALSE) AS cross_currency, amount / 100.0 BETWEEN 9000 AND 10000 OR amount / 100.0 BETWEEN 45000 AND 50000 AS near_threshold, payment_currency || ' -> ' || receiving_currency AS corridor, lower(trim(format)) AS fmt FROM trf),
l AS (SELECT row_idx, from_bank AS bank, to_bank AS partner, from_account AS account, 'out' AS way, amount, day, fmt, cross_currency, near_threshold, corridor, labelled FROM d
  UNION ALL SELECT row_idx, to_bank, from_bank, to_account, 'in', amount, day, fmt, cross_currency, near_threshold, corridor, labelled FROM d)"""
for tag, source, cte in (("", transfers, SQL_TRF), ("_bulk", bulk_transfers, SQL_BULK)):
    register("B5_transfer_derive" + tag, source, lambda t: b.derive(t).select("row_idx", F.col("day").cast("string"), "format", "cross_currency", "near_threshold", "corridor"), cte, DERIVED + " SELECT row_idx, CAST(day AS VARCHAR) AS day, fmt AS format, cross_currency, near_threshold, corridor FROM d")
    register("B6_bank_edges" + tag, source, b.bank_edges, cte, "SELECT from_bank, to_bank, count(*) AS n, sum(amount) / 100.0 AS amount, CAST(count_if(labelled) AS BIGINT) AS n_labelled FROM trf GROUP BY ALL")
    register("B8_bank_volume" + tag, source, lambda t: b.bank_volume(b.bank_legs(b.derive(t))).withColumn("mean", F.round("mean", 4)), cte, DERIVED + " SELECT bank, coalesce(sum(CASE WHEN way = 'out' THEN amount END), 0) / 100.0 AS sent, coalesce(sum(CASE WHEN way = 'in' THEN amount END), 0) / 100.0 AS received, count(*) AS n, CAST(count_if(way = 'out') AS BIGINT) AS n_sent, round(avg(amount / 100.0), 4) AS mean, median(amount / 100.0) AS median, max(amount) / 100.0 AS largest, count(DISTINCT CASE WHEN partner <> bank THEN partner END) AS partners FROM l GROUP BY bank")
    register("B9_bank_top_lists" + tag, source, lambda t: b.top_list(b.bank_legs(b.derive(t)), "partner"), cte, DERIVED + ", x AS (SELECT bank, partner, count(*) AS n, sum(amount) / 100.0 AS amount FROM l GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY bank ORDER BY amount DESC, partner) AS INTEGER) AS rank FROM x QUALIFY rank <= 8")
    for part, column, k, by in (("corridors", "corridor", 8, "amount"), ("formats", "format", 8, "n"), ("accounts", "account", 5, "amount")):
        register(f"B9_top_{part}{tag}", source, lambda t, column=column, k=k, by=by: b.top_list(b.bank_legs(b.derive(t)), column, k, by).withColumnRenamed(column, "part"), cte, DERIVED + f", x AS (SELECT bank, {'fmt' if column == 'format' else column} AS part, count(*) AS n, sum(amount) / 100.0 AS amount FROM l WHERE part IS NOT NULL GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY bank ORDER BY {by} DESC, part) AS INTEGER) AS rank FROM x QUALIFY rank <= {k}")
    register("B17_time_range" + tag, source, lambda t: b.ledger_summary(b.derive(t)).select(*(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("first_ts", "last_ts"))), cte, DERIVED + " SELECT min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts FROM d")
    register("B10_format_shares" + tag, source, lambda t: b.format_shares(b.bank_legs(b.derive(t))), cte, DERIVED + " SELECT bank, avg(CASE WHEN fmt IN ('wire', 'rtgs', 'neft') THEN 1.0::DOUBLE ELSE 0 END) AS wire_share, avg(CASE WHEN fmt IN ('wire', 'rtgs', 'cash', 'crypto', 'bitcoin', 'reinvestment') THEN 1.0::DOUBLE ELSE 0 END) AS high_risk_format_share FROM l GROUP BY bank")
    register("B11_account_hhi" + tag, source, lambda t: b.account_hhi(b.bank_legs(b.derive(t))).withColumn("account_concentration", F.round("account_concentration", 9)), cte, DERIVED + ", x AS (SELECT bank, account, sum(amount) / 100.0 AS s FROM l GROUP BY ALL) SELECT bank, round(sum(s * s) / (sum(s) * sum(s)), 9) AS account_concentration FROM x GROUP BY bank")
    register("B12_burst" + tag, source, lambda t: b.burst(b.bank_legs(b.derive(t))), cte, DERIVED + ", x AS (SELECT bank, day, count(*) AS k FROM l GROUP BY ALL) SELECT bank, count(day) AS active_days, CAST(max_by(day, struct_pack(k := k, d := -date_diff('day', DATE '1970-01-01', day))) AS VARCHAR) AS busiest_day, max(k) / sum(k) AS burst_velocity FROM x GROUP BY bank")
    register("B17_ledger_summary" + tag, source, lambda t: b.ledger_summary(b.derive(t)).drop("first_ts", "last_ts"), cte, DERIVED + " SELECT (SELECT count(DISTINCT bank) FROM l) AS banks, (SELECT count(DISTINCT account) FROM l) AS accounts, count(*) AS transfers, sum(amount) / 100.0 AS value, count(DISTINCT from_bank || '|' || to_bank) AS edges, string_agg(DISTINCT payment_currency, ',' ORDER BY payment_currency) AS currencies, count(DISTINCT fmt) AS formats, avg(CASE WHEN cross_currency THEN 1.0::DOUBLE ELSE 0 END) AS cross_currency_share FROM d")
FLOWS = flows("SELECT 0 AS sc, row_idx AS idx, epoch_us(ts) AS us, from_account, to_account, amount / 100.0 AS amount FROM trf WHERE from_account <> to_account AND amount > 0")
LEVELS = 6
#: Betweenness of banks by counts of shortest paths, of at most LEVELS hops, between all pairs.
BETWEEN = """, be AS (SELECT DISTINCT from_bank AS src, to_bank AS dst FROM trf WHERE from_bank <> to_bank), bn AS (SELECT DISTINCT unnest([src, dst]) AS node FROM be), q0 AS (SELECT node AS s, node AS t, 0 AS d, 1.0::DOUBLE AS g FROM bn)""" + "".join(
    f", q{k} AS (SELECT * FROM q{k - 1} UNION ALL SELECT s, dst, {k}, sum(g) FROM q{k - 1} q JOIN be ON q.t = be.src WHERE d = {k - 1} AND NOT EXISTS (SELECT 1 FROM q{k - 1} x WHERE x.s = q.s AND x.t = be.dst) GROUP BY s, dst)" for k in range(1, LEVELS + 1)
) + f""", bw AS (SELECT node, coalesce(b, 0) / ((count(*) OVER () - 1) * (count(*) OVER () - 2)) AS betweenness FROM bn LEFT JOIN (
  SELECT a.t AS node, sum(a.g * z.g / c.g) AS b FROM q{LEVELS} a JOIN q{LEVELS} z ON a.t = z.s JOIN q{LEVELS} c ON c.s = a.s AND c.t = z.t AND c.d = a.d + z.d WHERE a.s <> a.t AND z.s <> z.t AND a.s <> z.t GROUP BY 1) USING (node))"""
EXPOSED = ", ce AS (SELECT bank, avg(CASE WHEN x.row_idx IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS cycle_exposure FROM l LEFT JOIN (SELECT DISTINCT unnest(idxs) AS row_idx FROM cyc) x ON x.row_idx = l.row_idx GROUP BY bank)"
CENTRAL = ", ct AS (SELECT bank, coalesce(CASE WHEN (SELECT count(DISTINCT bank) FROM l) >= 4 AND (SELECT max(betweenness) FROM bw) > 0 THEN betweenness / (SELECT max(betweenness) FROM bw) END, 0) AS network_centrality FROM (SELECT DISTINCT bank FROM l) LEFT JOIN bw ON bw.node = bank)"
COMPONENTS = DERIVED + FLOWS + BETWEEN + EXPOSED + CENTRAL + """, hh AS (SELECT bank, sum(s * s) / (sum(s) * sum(s)) AS account_concentration FROM (SELECT bank, account, sum(amount) / 100.0 AS s FROM l GROUP BY ALL) GROUP BY bank),
bu AS (SELECT bank, max(k) / sum(k) AS burst_velocity FROM (SELECT bank, day, count(*) AS k FROM l GROUP BY ALL) GROUP BY bank),
v AS (SELECT bank, avg(CASE WHEN near_threshold THEN 1.0::DOUBLE ELSE 0 END) AS structuring_share, avg(CASE WHEN cross_currency THEN 1.0::DOUBLE ELSE 0 END) AS cross_currency_share, avg(CASE WHEN fmt IN ('wire', 'rtgs', 'cash', 'crypto', 'bitcoin', 'reinvestment') THEN 1.0::DOUBLE ELSE 0 END) AS high_risk_format_share FROM l GROUP BY bank),
lg AS (""" + " UNION ALL ".join(f"SELECT bank, '{k}' AS component, {k}::DOUBLE AS value, {w} AS weight, {config.BANK_REFERENCES[k]} AS reference FROM {'v' if k in ('structuring_share', 'cross_currency_share', 'high_risk_format_share') else 'hh' if k == 'account_concentration' else 'bu' if k == 'burst_velocity' else 'ce' if k == 'cycle_exposure' else 'ct'}" for k, w in config.BANK_WEIGHTS.items()) + """),
md AS (SELECT component, median(value) AS m, count(*) AS banks FROM lg GROUP BY 1), nr AS (SELECT lg.*, m, banks, abs(value - m) AS d FROM lg JOIN md USING (component)),
sp AS (SELECT component, 1.4826 * median(d) AS mad, avg(d) AS dev FROM nr GROUP BY 1), wd AS (SELECT nr.*, CASE WHEN mad > 0 THEN mad ELSE dev END AS width FROM nr JOIN sp USING (component)),
rc AS (SELECT bank, component, value, weight, greatest(least(value / reference, 1), CASE WHEN banks >= 3 AND width > 0 THEN greatest(0, least((value - m) / width, 3.5)) / 3.5 ELSE 0 END) AS severity FROM wd),
rk AS (SELECT bank, least(sum(100 * weight * severity), 100) AS risk_score FROM rc GROUP BY bank)"""
TIER = "CASE WHEN risk_score >= 45 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


def cycles(t):
    return written(g.conserved_cycles(t, checkpoint=lambda df: written(df, "paths")), "cycles")


def bank_graph(t):
    return b.bank_edges(t).select(F.col("from_bank").alias("src"), F.col("to_bank").alias("dst"), "n", "amount")


def bank_centrality(t):
    return g.betweenness(bank_graph(t), checkpoint=lambda df: written(df, "levels"))


def whole_centrality(t):
    return g.bank_centrality(written(bank_graph(t), "banks"), checkpoint=lambda df: written(df, "levels"))


def risk_parts(t):
    """The seven components; the transfers are written once for all of them."""
    t = written(t, "transfers")
    return b.risk_components(written(b.components(b.derive(t), cycles(t), written(bank_centrality(t), "centrality")), "components"))


def risk(t):
    return b.bank_risk(risk_parts(t))


register("B14_risk_components", transfers, lambda t: risk_parts(t).select("bank", "component", F.round("value", 9).alias("value"), F.round("severity", 6).alias("severity"), F.round("points", 6).alias("points")), SQL_TRF, COMPONENTS + " SELECT bank, component, round(value, 9) AS value, round(severity, 6) AS severity, round(100 * weight * severity, 6) AS points FROM rc")
register("B15_risk_tier", transfers, lambda t: risk(t).select("bank", F.round("risk_score", 6).alias("risk_score"), "tier"), SQL_TRF, COMPONENTS + f" SELECT bank, round(risk_score, 6) AS risk_score, {TIER} AS tier FROM rk")
register("B16_top_profiles", transfers, lambda t: b.top_profiles(risk(t), 5).select("bank"), SQL_TRF, COMPONENTS + " SELECT bank FROM rk ORDER BY risk_score DESC, bank LIMIT 5")
register("B18_label_evaluation", transfers, lambda t: b.label_evaluation(t, risk(t)), SQL_TRF, COMPONENTS + f", h AS (SELECT bank FROM rk WHERE risk_score >= 45), y AS (SELECT DISTINCT bank FROM l WHERE labelled) SELECT 'caught' AS what, count(*) AS n FROM (SELECT * FROM h INTERSECT SELECT * FROM y) UNION ALL SELECT 'missed', count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM h) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT * FROM h EXCEPT SELECT * FROM y)")
register("B19_tier_rollup", transfers, lambda t: b.tier_rollup(risk(t)).withColumn("mean_risk", F.round("mean_risk", 6)), SQL_TRF, COMPONENTS + f" SELECT {TIER} AS tier, count(*) AS n, round(avg(risk_score), 6) AS mean_risk, max_by(bank, struct_pack(r := risk_score, b := bank)) AS top FROM rk GROUP BY 1")
register("P11_bank_list", transfers, lambda t: b.bank_list(risk(t), "bank_1").select("bank", F.round("risk_score", 6).alias("risk_score")), SQL_TRF, COMPONENTS + " SELECT bank, round(risk_score, 6) AS risk_score FROM rk WHERE contains(lower(bank), 'bank_1') ORDER BY risk_score DESC, bank LIMIT 50")
register("P21_bank_client_filter", transfers, lambda t: b.bank_list(risk(t), "", "MEDIUM").select("bank"), SQL_TRF, COMPONENTS + f" SELECT bank FROM rk WHERE {TIER} = 'MEDIUM' ORDER BY risk_score DESC, bank LIMIT 50")
BEDGES = ", e AS (SELECT from_bank, to_bank, count(*) AS n, sum(amount) / 100.0 AS amount, CAST(count_if(labelled) AS BIGINT) AS n_labelled FROM trf GROUP BY ALL)"
register("P12_bank_neighbourhood", bulk_transfers, lambda t: b.bank_neighbourhood(b.bank_edges(t), "N1"), SQL_BULK, BEDGES + " SELECT *, CASE WHEN from_bank = 'N1' THEN 'out' ELSE 'in' END AS way FROM e WHERE from_bank = 'N1' OR to_bank = 'N1' ORDER BY amount DESC, from_bank, to_bank LIMIT 40")
register("P13_bank_graph", bulk_transfers, lambda t: b.bank_graph(b.bank_edges(t)), SQL_BULK, BEDGES + ", top AS (SELECT bank FROM (SELECT unnest([from_bank, to_bank]) AS bank, amount FROM e) GROUP BY bank ORDER BY sum(amount) DESC, bank LIMIT 8) SELECT * FROM e WHERE from_bank IN (SELECT bank FROM top) AND to_bank IN (SELECT bank FROM top)")


def subject_bank():
    return F.element_at(F.array(*map(F.lit, ("SBIN", "HDFC", "ICIC", "UTIB"))), (F.col("statement_id") % 4 + 1).cast("int"))


def ledger(t):
    return b.statement_ledger(t, subject_bank(), n.resolve_counterparty_bank(F.col("narration")))


LEDGER = f""", lg AS (SELECT * FROM (SELECT *, s || ':stmt' || statement_id AS me, CASE WHEN cb <> 'UNATTRIBUTED' THEN cb || ':cp' || counterparty END AS other, coalesce(debit, 0) > 0 AS out, CASE WHEN debit > 0 THEN debit ELSE credit END AS paid
  FROM (SELECT *, ['SBIN', 'HDFC', 'ICIC', 'UTIB'][statement_id % 4 + 1] AS s FROM txn) JOIN (SELECT row_id, coalesce(a, b, c, d, e, 'UNATTRIBUTED') AS cb FROM ({CODES})) USING (row_id)) WHERE paid > 0),
ld AS (SELECT statement_id, row_id, row_index, txn_date, CASE WHEN out THEN s ELSE cb END AS from_bank, CASE WHEN out THEN me ELSE other END AS from_account, CASE WHEN out THEN cb ELSE s END AS to_bank, CASE WHEN out THEN other ELSE me END AS to_account, paid FROM lg)"""
register("B1_statement_ledger", transactions, lambda t: ledger(t).select("row_id", "from_bank", "from_account", "to_bank", "to_account", F.col("amount").cast("double")), SQL_TXN, LEDGER + " SELECT row_id, from_bank, from_account, to_bank, to_account, paid / 100.0 AS amount FROM ld")
register("B2_dedup_mirrored", transactions, lambda t: b.dedup_mirrored(ledger(t)).select("row_id"), SQL_TXN, LEDGER + " SELECT row_id FROM ld QUALIFY from_account IS NULL OR to_account IS NULL OR row_number() OVER (PARTITION BY from_account, to_account, paid, txn_date ORDER BY statement_id, row_index) = 1")
register("B3_coverage", transactions, lambda t: b.coverage(ledger(t)), SQL_TXN, LEDGER + " SELECT statement_id, count(*) AS n, avg(CASE WHEN from_bank <> 'UNATTRIBUTED' AND to_bank <> 'UNATTRIBUTED' THEN 1.0::DOUBLE ELSE 0 END) AS attribution_rate FROM ld GROUP BY 1")


def covered(t):
    found = n.resolve_bank(F.col("narration"))
    known = t.where("debit > 0 or credit > 0").select("statement_id", subject_bank().alias("subject"), F.coalesce(found["code"], F.lit(config.UNATTRIBUTED)).alias("counterparty_bank"), found["signal"].alias("signal"))
    return b.coverage_summary(written(known, "attributed"), b.dedup_mirrored(ledger(t)).count())


register("B3_coverage_summary", transactions, covered, SQL_TXN,
         LEDGER + f""", sg AS (SELECT CASE WHEN a IS NOT NULL THEN 'ifsc' WHEN b IS NOT NULL THEN 'ifsc_partial' WHEN c IS NOT NULL THEN 'reference_prefix' WHEN d IS NOT NULL THEN 'upi_handle' WHEN e IS NOT NULL THEN 'name' END AS signal FROM ({CODES}) JOIN lg USING (row_id)),
         dd AS (SELECT row_id FROM ld QUALIFY from_account IS NULL OR to_account IS NULL OR row_number() OVER (PARTITION BY from_account, to_account, paid, txn_date ORDER BY statement_id, row_index) = 1)
         SELECT (SELECT count(DISTINCT statement_id) FROM lg) AS statements, 0 AS skipped, count(*) AS used, count(signal) AS attributed, count(*) - count(signal) AS unattributed, round(count(signal) / count(*), 4) AS attribution_rate, (SELECT count(*) FROM dd) AS transfer_rows, count(*) - (SELECT count(*) FROM dd) AS mirrored,
         (SELECT string_agg(signal || ':' || n, ',' ORDER BY n DESC, signal) FROM (SELECT signal, count(*) AS n FROM sg WHERE signal IS NOT NULL GROUP BY 1)) AS signals, (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM lg) AS direct_banks FROM sg""")


def statements_of(t):
    """statement_id, its rows, its extraction tier as status and the bank it is from."""
    return t.groupBy("statement_id").agg(F.count("*").alias("n")).join(q.extraction_tiers(t).withColumnRenamed("tier", "status"), "statement_id").withColumn("bank", subject_bank())


register("B4_corpus_fingerprint", transactions, lambda t: b.corpus_fingerprint(statements_of(t)), SQL_TXN,
         f", st AS (SELECT statement_id, statement_id || ':' || tier || ':' || n || ':' || ['SBIN', 'HDFC', 'ICIC', 'UTIB'][statement_id % 4 + 1] AS line FROM (SELECT statement_id, count(*) AS n FROM txn GROUP BY 1) JOIN ({ACCOUNT_SQL['Q3_extraction_tier']}) USING (statement_id)), pt AS (SELECT statement_id // 1000 AS p, sha256(string_agg(line, '|' ORDER BY statement_id)) AS d FROM st GROUP BY 1) SELECT sha256(string_agg(d, '|' ORDER BY p)) AS fingerprint FROM pt")
register("G6_conserved_cycles", transfers, lambda t: cycles(t).select("ring", "hops", F.round("conservation", 6).alias("conservation"), F.round("risk", 6).alias("risk")), SQL_TRF, FLOWS + " SELECT ring, hops, round(conservation, 6) AS conservation, round(risk, 6) AS risk FROM cyc")
register("G7_bank_cycle_index", transfers, lambda t: b.bank_cycle_index(t, cycles(t)).withColumn("top_risk", F.round("top_risk", 6)), SQL_TRF, FLOWS + "  , bx AS (SELECT DISTINCT ring, risk, unnest([from_bank, to_bank]) AS bank FROM (SELECT ring, risk, unnest(idxs) AS row_idx FROM cyc) JOIN trf USING (row_idx)) SELECT bank, count(*) AS n_cycles, round(max(risk), 6) AS top_risk FROM bx GROUP BY bank")
register("G7_cycle_summary", transfers, lambda t: b.cycle_summary(cycles(t)).withColumns({"top_risk": F.round("top_risk", 6), "value": F.round("value", 2)}), SQL_TRF, FLOWS + " SELECT count(*) AS n, round(max(risk), 6) AS top_risk, round(sum(mean_amount * hops), 2) AS value FROM cyc")
register("P12_bank_cycles", transfers, lambda t: b.cycles_of_bank(t, cycles(t), "BANK_1").select("ring", "hops", F.round("risk", 6).alias("risk")), SQL_TRF, FLOWS + " SELECT DISTINCT ring, hops, round(risk, 6) AS risk FROM (SELECT ring, hops, risk, unnest(idxs) AS row_idx FROM cyc) JOIN trf USING (row_idx) WHERE from_bank = 'BANK_1' OR to_bank = 'BANK_1'")
register("B13_cycle_exposure", transfers, lambda t: b.cycle_exposure(b.bank_legs(b.derive(t)), cycles(t)).withColumn("cycle_exposure", F.round("cycle_exposure", 9)), SQL_TRF, DERIVED + FLOWS + EXPOSED + " SELECT bank, round(cycle_exposure, 9) AS cycle_exposure FROM ce")
#: Ranks after RANK_ROUNDS rounds, by when they no longer change in eight places.
RANK_ROUNDS = 60
RANKED = """, rw AS (SELECT from_bank AS src, to_bank AS dst, count(*) / sum(count(*)) OVER (PARTITION BY from_bank)::DOUBLE AS p FROM trf GROUP BY 1, 2), rn AS (SELECT DISTINCT unnest([src, dst]) AS node FROM rw), rm AS (SELECT count(*) AS n FROM rn),
k0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM rn, rm)""" + "".join(
    f", k{i} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce((SELECT sum(rank) FROM k{i - 1} WHERE node NOT IN (SELECT src FROM rw)), 0) / n) AS rank FROM rn CROSS JOIN rm LEFT JOIN (SELECT dst, sum(rank * p) AS got FROM k{i - 1} JOIN rw ON node = src GROUP BY 1) ON node = dst)" for i in range(1, RANK_ROUNDS + 1)
)
register("G5_pagerank", transfers, lambda t: g.pagerank(b.bank_edges(t).select(F.col("from_bank").alias("src"), F.col("to_bank").alias("dst"), F.col("n").alias("weight")), tolerance=1e-10, checkpoint=lambda df: written(df, "rank")).withColumn("rank", F.round("rank", 8)), SQL_TRF, RANKED + f" SELECT node, round(rank, 8) AS rank FROM k{RANK_ROUNDS}")
register("G5_degrees", transfers, lambda t: g.degrees(b.bank_edges(t).select(F.col("from_bank").alias("src"), F.col("to_bank").alias("dst"), "amount")).select("node", "out_degree", "in_degree", F.round("out_flow", 2).alias("out_flow"), F.round("in_flow", 2).alias("in_flow")), SQL_TRF,
         ", o AS (SELECT from_bank AS node, count(DISTINCT to_bank) AS out_degree, sum(amount) / 100.0 AS out_flow FROM trf GROUP BY 1), i AS (SELECT to_bank AS node, count(DISTINCT from_bank) AS in_degree, sum(amount) / 100.0 AS in_flow FROM trf GROUP BY 1) SELECT node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, round(coalesce(out_flow, 0), 2) AS out_flow, round(coalesce(in_flow, 0), 2) AS in_flow FROM o FULL JOIN i USING (node)")
register("G8_bank_centrality", transfers, lambda t: whole_centrality(t).withColumns({"betweenness": F.round("betweenness", 9), "pagerank": F.round("pagerank", 8)}), SQL_TRF, RANKED.rstrip() + BETWEEN + f""", og AS (SELECT from_bank AS node, count(DISTINCT to_bank) AS out_degree FROM trf GROUP BY 1), ig AS (SELECT to_bank AS node, count(DISTINCT from_bank) AS in_degree FROM trf GROUP BY 1)
         SELECT k.node AS node, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, round(coalesce(betweenness, 0), 9) AS betweenness, FALSE AS sampled, round(rank, 8) AS pagerank FROM k{RANK_ROUNDS} k LEFT JOIN og USING (node) LEFT JOIN ig USING (node) LEFT JOIN bw USING (node)""")
register("G8_betweenness_bulk", bulk_transfers, lambda t: bank_centrality(t).select("node", F.round("betweenness", 9).alias("betweenness")), SQL_BULK, BETWEEN + " SELECT node, round(betweenness, 9) AS betweenness FROM bw")
STAR_RANK = """, se AS (SELECT statement_id, coalesce(counterparty, 'CPTY_' || row_id) AS node, debit, credit FROM txn WHERE debit > 0 OR credit > 0),
so AS (SELECT statement_id, node, count_if(debit > 0) AS paid, count_if(credit > 0) AS pays, coalesce(sum(CASE WHEN debit > 0 THEN debit END), 0) / 100.0 AS came, coalesce(sum(CASE WHEN credit > 0 THEN credit END), 0) / 100.0 AS went FROM se GROUP BY ALL),
sn AS (SELECT statement_id, count(*) + 1 AS n, count_if(pays > 0) AS c, count_if(paid > 0) AS d, count_if(pays > 0 AND paid > 0) AS b, sum(paid)::DOUBLE AS p, sum(came) AS spent, sum(went) AS got FROM so GROUP BY 1),
sv AS (SELECT statement_id, 'ACCT_' || statement_id AS v FROM sn UNION ALL SELECT statement_id, node FROM so),
sp AS (SELECT statement_id, 'ACCT_' || statement_id AS src, node AS dst, paid / p AS w FROM so JOIN sn USING (statement_id) WHERE paid > 0 UNION ALL SELECT statement_id, node, 'ACCT_' || statement_id, 1.0 FROM so WHERE pays > 0),
z0 AS MATERIALIZED (SELECT statement_id, v, 1.0::DOUBLE / n AS r FROM sv JOIN sn USING (statement_id))""" + "".join(
    f", z{i} AS MATERIALIZED (SELECT x.statement_id, x.v, 0.15 / n + 0.85 * (coalesce(g, 0) + coalesce(h, 0) / n) AS r FROM sv x JOIN sn USING (statement_id) LEFT JOIN (SELECT statement_id, dst, sum(r * w) AS g FROM z{i - 1} JOIN sp USING (statement_id) WHERE v = src GROUP BY ALL) y ON y.statement_id = x.statement_id AND y.dst = x.v LEFT JOIN (SELECT statement_id, sum(r) AS h FROM z{i - 1} WHERE (statement_id, v) NOT IN (SELECT statement_id, src FROM sp) GROUP BY 1) d ON d.statement_id = x.statement_id)" for i in range(1, 41)
)
#: Ranks by rounds over all nodes and edges of the stars.
register("G5_star_centrality", transactions, lambda t: g.star_centrality(t).withColumns({c: F.round(c, k) for c, k in (("degree_ratio", 6), ("flow_ratio", 6), ("in_flow", 2), ("out_flow", 2), ("betweenness", 9), ("pagerank", 7))}), SQL_TXN,
         STAR_RANK + """ SELECT statement_id, v AS node, i AS in_degree, o AS out_degree, round(o / greatest(i, 1), 6) AS degree_ratio, round(fi, 2) AS in_flow, round(fo, 2) AS out_flow, round(fo / greatest(fi, 1), 6) AS flow_ratio, round(CASE WHEN n >= 5 THEN bt END, 9) AS betweenness, round(CASE WHEN n >= 5 THEN r END, 7) AS pagerank
         FROM (SELECT statement_id, 'ACCT_' || statement_id AS v, n, c AS i, d AS o, got AS fi, spent AS fo, (c * d - b) / ((n - 1) * (n - 2))::DOUBLE AS bt FROM sn UNION ALL SELECT statement_id, node, n, CASE WHEN paid > 0 THEN 1 ELSE 0 END, CASE WHEN pays > 0 THEN 1 ELSE 0 END, came, went, 0 FROM so JOIN sn USING (statement_id)) JOIN z40 USING (statement_id, v)""")
