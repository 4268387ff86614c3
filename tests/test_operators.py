"""Operators of statements, graphs, cases and banks on small tables."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskflow import config
from riskflow.functions import narration as n
from riskflow.plans import risk_queries
from riskflow.sources.shared import written
from riskflow.operators import banks, cases, features, graph, models, patterns, quality, scoring, views

TXN = "statement_id long, row_index long, row_id string, ts timestamp, txn_date date, debit decimal(18,2), credit decimal(18,2), counterparty string, narration string, reference_no string, balance decimal(18,2)"


def txns(spark, rows):
    """rows: ts text, debit, credit, counterparty, balance."""
    out = []
    for k, (ts, debit, credit, who, balance) in enumerate(rows):
        at = dt.datetime.fromisoformat(ts)
        money = lambda x: None if x is None else Decimal(str(x))
        out.append((1, k, str(k), at, at.date(), money(debit), money(credit), who, "x", "r", money(balance)))
    return spark.createDataFrame(out, TXN)


def value(df):
    return df.first()[1]


def test_boundaries(spark):
    t = txns(spark, [("2024-01-01 00:00", 1, None, "a", None), ("2024-01-01 23:59", 1, None, "a", None), ("2024-01-02 00:00", 1, None, "a", None), ("2024-01-02 00:01", 1, None, "a", None)])
    assert value(features.velocity(t)) == 3 and value(features.daily_velocity(t)) == 2
    flow = lambda adb: txns(spark, [("2024-01-01", 30, None, "a", adb), ("2024-01-01", None, 70, "b", adb)])
    assert [value(features.turnover(flow(b))) for b in (20, None, 0, -20)] == [5.0, None, None, None]


def test_matching_by_time(spark):
    got = features.retention(txns(spark, [("2024-01-01 08:00", None, 100, "a", None), ("2024-01-01 09:00", None, 100, "a", None), ("2024-01-01 10:00", 100, None, "b", None)])).first()
    assert (got["net_retention_ratio"], got["median_holding_time_hours"]) == (0.5, 2.0)
    got = features.retention(txns(spark, [("2024-01-01 08:00", None, 100, "a", None), ("2024-01-01 08:00", 100, None, "b", None), ("2024-01-02 08:01", 100, None, "b", None)])).first()
    assert (got["net_retention_ratio"], got["median_holding_time_hours"]) == (1.0, None)


def brute_dormancy(days, gap=30, rows=3, burst=3):
    d, found, i = sorted(set(days)), 0, 1
    while i < len(d):
        j = i
        while j < len(d) and d[j] <= d[i] + burst:
            j += 1
        if d[i] - d[i - 1] > gap and j - i >= rows:
            found, i = found + 1, j + 1
        else:
            i += 1
    return found


def test_dormancy_against_a_loop(spark):
    r, start, rows = random.Random(2), dt.date(2024, 1, 1), []
    series = {}
    for s in range(40):
        day, own = 0, []
        for _ in range(r.randint(1, 25)):
            day += r.choice([0, 1, 1, 2, 31, 40])
            own.append(day)
        series[s] = own
        rows += [(s, start + dt.timedelta(days=x)) for x in own]
    got = {r_["statement_id"]: r_["dormancy_breaks"] for r_ in features.dormancy_breaks(spark.createDataFrame(rows, "statement_id long, txn_date date")).collect()}
    assert got == {s: brute_dormancy(own) for s, own in series.items()}


def test_reconciliation(spark):
    rate = lambda rows: value(quality.reconciliation_rate(txns(spark, rows)))
    assert rate([("2024-01-01", None, 1000, "a", 1000), ("2024-01-02", 500, None, "a", 500), ("2024-01-03", None, 300, "a", 800)]) == 1.0
    assert rate([("2024-01-01", 500, None, "a", None), ("2024-01-02", None, 1000, "a", None)]) == 0.5


def test_plausibility_gate(spark):
    grid = [("01/02/2024", "UPI payment to shop 12345", "100.00", "", "900.00"), ("02/02/2024", "NEFT transfer from alpha", "", "50.00", "950.00"), ("03/02/2024", "ATM withdrawal main street", "200.00", "", "750.00"), ("04/02/2024", "salary credit for month", "", "500.00", "1250.00")]
    cells = spark.createDataFrame([(1, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "file_id long, row long, col long, value string")
    texts = spark.createDataFrame([(1, "Statement of Account My Bank IFSC SBIN0001234 Account No 1 opening balance", 4), (2, "x", 1)], "file_id long, text string, n_rows long")
    got = {r["file_id"]: r for r in quality.ood_score(cells, texts).collect()}
    assert got[1]["score"] >= 0.7 and got[1]["tier"] == "auto_proceed" and got[2]["tier"] == "hard_reject"
    assert quality.ood_failure_reasons(quality.ood_score(cells, texts)).count() == 2


def transfers(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), a, b, Decimal(x)) for k, (a, b, d, x) in enumerate(rows)], "row_idx long, ts timestamp, from_account string, to_account string, amount decimal(18,2)")


def brute_rings(rows, days=10, tol=0.25, pct=0.6, most=6):
    """Rings by a search from every seed."""
    order = sorted(x for a, b, _, x in rows if a != b)
    floor, rings = order[int(pct * len(order))], set()

    def walk(path, nodes):
        a, b, d, x = rows[path[-1]]
        for k, (c, e, d2, y) in enumerate(rows):
            s = rows[path[0]]
            if c == b and c != e and k not in path and d <= d2 <= s[2] + days and abs(y - s[3]) <= tol * s[3]:
                if e == nodes[0]:
                    if len(path) + 1 >= 3:
                        rings.add(min(">".join(nodes[i:] + nodes[:i]) for i in range(len(nodes))))
                elif e not in nodes and len(path) + 1 < most:
                    walk([*path, k], [*nodes, e])

    for k, (a, b, d, x) in enumerate(rows):
        if x >= floor and a != b:
            walk([k], [a, b])
    return rings


def test_conserved_cycles_against_a_search(spark):
    r = random.Random(4)
    rows = [(r.choice("ABCDEF"), r.choice("ABCDEF"), r.randint(0, 12), r.choice([100, 105, 110, 300])) for _ in range(26)]
    got = {x["ring"] for x in graph.conserved_cycles(transfers(spark, rows), least_risk=0.0, checkpoint=lambda df: written(df, "paths")).collect()}
    assert got == brute_rings(rows) and got
    one = graph.conserved_cycles(transfers(spark, [("A", "B", 0, 100), ("B", "C", 0, 100), ("C", "A", 0, 100)]), checkpoint=keep).first()
    assert one["hops"] == 3 and one["conservation"] == 1.0
    assert graph.conserved_cycles(transfers(spark, [("A", "B", 0, 100), ("B", "C", 0, 100)]), checkpoint=keep).count() == 0


def test_centrality(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "c", 1.0)], "src string, dst string, weight double")
    rank = {r["node"]: r["rank"] for r in graph.pagerank(edges, rounds=30, checkpoint=keep).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank["d"] == max(rank.values())
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, checkpoint=keep).collect()}
    assert between["c"] == pytest.approx(2 / 6) and between["a"] == between["b"] == between["d"] == 0


def keep(df):
    return written(df, "step")


def found_in(edges):
    return keep(cases.case_findings(edges, checkpoint=keep))


def ring(spark, ref="AB-000001", extra=()):
    legs = []
    for k, (a, b, r) in enumerate([(1, 2, ref), (2, 3, "BC-000001"), (3, 1, "CA-000001")]):
        day = dt.date(2024, 1, 1 + k)
        legs += [(1, r, day, a, f"{k}d", Decimal(1000), None, "x"), (1, r, day, b, f"{k}c", None, Decimal(1000), "y")]
    return spark.createDataFrame(legs + list(extra), "case_id long, reference_no string, txn_date date, statement_id long, row_id string, debit decimal(18,2), credit decimal(18,2), counterparty string")


def test_case_graph(spark):
    edges = keep(cases.case_edges(ring(spark)))
    findings = found_in(edges)
    assert edges.count() == 3 and edges.where("size(row_ids) = 2").count() == 3 and findings.first()["hops"] == 3
    assert cases.case_graph_view(edges, findings).where("tier = 'high'").count() == 3
    record = cases.draft_records(findings, edges).first()
    assert record["filing_status"] == "NOT_FILED" and record["total"] == 3000 and len(record["hops"]) == 3
    assert found_in(cases.case_edges(ring(spark, "REF"))).count() == 0
    third = cases.case_edges(ring(spark, extra=[(1, "AB-000001", dt.date(2024, 1, 1), 3, "z", None, Decimal(1000), "q")]))
    assert found_in(third).count() == 0 and third.where("resolution = 'ambiguous_mirrored_reference'").count() == 3


def test_cascade(spark):
    member = spark.createDataFrame([(1, 10), (2, 20)], "case_id long, statement_id long")
    gone = spark.createDataFrame([(10,)], "statement_id long")
    tables = {"transactions": spark.createDataFrame([(10, 1), (20, 2)], "statement_id long, x int"), "findings": spark.createDataFrame([(1, "f"), (2, "g")], "case_id long, x string")}
    left = cases.cascade_delete(tables, gone, member)
    assert [r[0] for r in left["transactions"].collect()] == [20] and [r[0] for r in left["findings"].collect()] == [2]


def test_rules(spark):
    base = dict.fromkeys(scoring.NAMES, 0.0) | {"net_retention_ratio": 0.09, "turnover_ratio": 10.0, "benford_deviation_score": 5.0, "fan_in_score": 0.5, "near_threshold_ratio": 0.1}
    df = spark.createDataFrame([(1, *base.values())], "statement_id long, " + ", ".join(f"{k} double" for k in base))
    got = scoring.evaluate_rules(df).first()
    assert got["rule_score"] == 25 and got["fired"] == "R1_low_retention_high_turnover"
    clauses = scoring.rule_clauses(df)
    assert clauses.count() == sum(len(t.split(" AND ")) for _, _, t in config.RULES) and clauses.where("rule = 'R1_low_retention_high_turnover' and holds").count() == 2
    assert spark.range(1).select(scoring.fuse(F.lit(80), F.lit(0.5)), scoring.fuse(F.lit(80), F.lit(0.5), F.lit(0.9))).first()[:] == (pytest.approx(69.5), pytest.approx(76.0))
    tier = lambda s, f, a, e: spark.range(1).select(scoring.decide_tier(F.lit(s), F.lit(f), F.lit(a), F.lit(e))).first()[0]
    assert [tier(80, "R1", 0.1, "high"), tier(80, "", 0.1, "high"), tier(10, "", 0.1, "high"), tier(10, "", 0.5, "high")] == ["CONFIRMED_SUSPICIOUS", "REVIEW_REQUIRED", "LIKELY_LEGITIMATE", "REVIEW_REQUIRED"]


def test_narration(spark):
    pick = lambda c, *x: spark.createDataFrame([x], ", ".join(f"c{k} string" for k in range(len(x)))).select(c).first()[0]
    c0 = F.col("c0")
    assert [str(pick(n.parse_date(c0), d)) for d in ("01/02/2024", "2024-03-04", "5-Jan-2024", "x", "31/12/99")] == ["2024-02-01", "2024-03-04", "2024-01-05", "None", "1999-12-31"]
    assert [pick(n.parse_amount(c0).cast("double"), a) for a in ("Rs. 1,234.50", "(12)", "-", "", "₹ 7", "-3")] == [1234.5, -12.0, None, None, 7.0, -3.0]
    assert pick(n.resolve_bank(c0)["code"], "NEFT/DR/X/BLUE DUNE TRADING LLP/SBIN0001234") == "SBIN"
    assert pick(n.redact_pii(c0), "card 1234567890123456 ABCDE1234F") == "card [CARD] [PAN]"
    assert pick(n.normalize_counterparty(c0), " Blue  Dune, Pvt. Ltd ") == "BLUE DUNE"
    assert pick(n.fact_check(c0, F.col("c1")), "score 42.0 and 25%", '{"s":42.0,"p":0.25}') and not pick(n.fact_check(c0, F.col("c1")), "score 43", '{"s":42.0}')


def test_layering_and_dormancy_patterns(spark):
    t = txns(spark, [("2024-01-01", None, 100, "a", None), ("2024-01-01", 90, None, "b", None), ("2024-01-01", 30, None, "b", None), ("2024-03-01", None, 10, "a", None), ("2024-03-02", None, 10, "a", None), ("2024-03-03", 10, None, "a", None)])
    got = patterns.layering_matches(t).collect()
    assert [(r["credit_row"], r["debit_row"]) for r in got] == [("0", "1"), ("4", "5")]
    assert [r["row_ids"] for r in patterns.dormancy_patterns(t).collect()] == [["3", "4", "5"]]


def test_isolation_forest_marks_the_far_row(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(60)] + [(99, 40.0, 40.0)], "id long, a double, b double")
    got = {x["id"]: x["isolation"] for x in models.isolation_forest(rows, "id", ["a", "b"], trees=30).collect()}
    assert got[99] == 1.0 and sum(got.values()) < 20


def test_sinks(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "statement_id long, x string")
    path = f"{tmp_path}/out"
    views.sink_results(first, path)
    views.sink_results(spark.createDataFrame([(2, "c")], "statement_id long, x string"), path)
    assert {(r["statement_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    views.export_evidence_json(first, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_same_with_other_partitions(spark):
    rows = [("A", "B", 0, 100), ("B", "C", 1, 105), ("C", "A", 2, 100), ("A", "C", 3, 99)]
    t = transfers(spark, rows)
    assert sorted(map(tuple, graph.conserved_cycles(t, checkpoint=keep).select("ring", "risk").collect())) == sorted(map(tuple, graph.conserved_cycles(t.repartition(5), checkpoint=keep).select("ring", "risk").collect()))


def brute_betweenness(edges):
    """Over all pairs of nodes, the share of shortest paths through each, by listing the paths."""
    nodes = sorted({x for e in edges for x in e})
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        level, done = [[s]], {s}
        while level:
            longer = [[*p, b] for p in level for a, b in edges if a == p[-1] and b not in done]
            for t in {p[-1] for p in longer}:
                paths = [p for p in longer if p[-1] == t]
                for p in paths:
                    for x in p[1:-1]:
                        total[x] += 1 / len(paths)
            done |= {p[-1] for p in longer}
            level = longer
    return total


def test_bank_risk_has_cycles_and_centrality(spark):
    rows = [("A", "B", 0, 100), ("B", "C", 1, 105), ("C", "A", 2, 100), ("C", "D", 3, 90), ("D", "E", 4, 7)]
    t = transfers(spark, rows).select("*", F.col("from_account").alias("from_bank"), F.col("to_account").alias("to_bank"), F.lit("INR").alias("payment_currency"), F.lit("INR").alias("receiving_currency"), F.lit("wire").alias("format"), F.lit(False).alias("labelled"))
    parts = {(r["bank"], r["component"]): r for r in risk_queries.risk_parts(t).collect()}
    between = brute_betweenness({(a, b) for a, b, _, _ in rows})
    for bank in "ABCDE":
        legs = [k for k, (a, b, _, _) in enumerate(rows) for x in (a, b) if x == bank]
        assert parts[bank, "cycle_exposure"]["value"] == pytest.approx(sum(k < 3 for k in legs) / len(legs))
        assert parts[bank, "network_centrality"]["value"] == pytest.approx(between[bank] / max(between.values()))
    assert parts["A", "cycle_exposure"]["points"] == pytest.approx(24) and parts["C", "network_centrality"]["points"] == pytest.approx(16)
    scores = {r["bank"]: (r["risk_score"], r["tier"]) for r in risk_queries.risk(t).collect()}
    for bank, (score, tier) in scores.items():
        assert score == pytest.approx(min(100, sum(r["points"] for (who, _), r in parts.items() if who == bank)))
    assert scores["C"][1] == "HIGH" and scores["C"][0] > 60
    few = {(r["bank"], r["component"]): r["value"] for r in risk_queries.risk_parts(t.where("row_idx < 2")).collect()}
    assert few["B", "network_centrality"] == 0  # three banks


def brute_weighted(edges):
    """Betweenness by edge lengths: all simple paths of all pairs, the shortest ones kept."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths, open_ = {}, [([s], 0.0)]
        while open_:
            path, d = open_.pop()
            for a, b, w in edges:
                if a == path[-1] and b not in path:
                    open_.append(([*path, b], d + w))
                    paths.setdefault(b, []).append((d + w, [*path, b]))
        for found in paths.values():
            best = [p for d, p in found if d == min(found)[0]]
            for p in best:
                for x in p[1:-1]:
                    total[x] += 1 / len(best)
    return total


def test_betweenness_of_long_and_weighted_paths(spark):
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(19)], "src string, dst string")
    got = {r["node"]: r["betweenness"] * 19 * 18 for r in graph.betweenness(chain, checkpoint=keep).collect()}
    assert got["n09"] == pytest.approx(90) and got["n00"] == 0 and {round(v) for v in got.values()} == {k * (19 - k) for k in range(20)}
    r = random.Random(8)
    edges = list({(f"v{a}", f"v{b}"): float(r.randint(1, 4)) for a, b in ((r.randrange(7), r.randrange(7)) for _ in range(22)) if a != b}.items())
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges] + [("v1", "v1", 1.0)], "src string, dst string, w double")
    for weight, flat in (("w", None), (None, 1.0)):
        want = brute_weighted([(a, b, flat or w) for (a, b), w in edges])
        found = {x["node"]: (x["betweenness"], x["sampled"]) for x in graph.betweenness(table, weight=weight, checkpoint=keep).collect()}
        n = len(want)
        assert {k: v for k, (v, _) in found.items()} == pytest.approx({k: v / ((n - 1) * (n - 2)) for k, v in want.items()})
        assert not any(s for _, s in found.values())
    assert {x["sampled"] for x in graph.betweenness(table, pivots=3, checkpoint=keep).collect()} == {True}
    assert graph.betweenness(chain.limit(0), checkpoint=keep).count() == 0


def test_star_centrality_is_that_of_the_graph(spark):
    """The closed form against shortest paths by length and ranks by rounds over the edges of the star."""
    rows = [("2024-01-01", 10, None, "a", 0), ("2024-01-02", 20, None, "a", 0), ("2024-01-03", None, 5, "a", 0), ("2024-01-04", None, 7, "b", 0), ("2024-01-05", 8, None, "c", 0), ("2024-01-06", 9, None, None, 0), ("2024-01-07", None, 1, "d", 0)]
    t = txns(spark, rows)
    got = {r["node"]: r for r in graph.star_centrality(t).collect()}
    edges = [(r["src"], r["dst"]) for r in graph.star_edges(t).collect()]
    me = next(x for x in got if x.startswith("ACCT_"))
    between = brute_weighted([(a, b, float(edges.count((a, b)))) for a, b in set(edges)])
    n = len(got)
    assert {k: r["betweenness"] for k, r in got.items()} == pytest.approx({k: v / ((n - 1) * (n - 2)) for k, v in between.items()})
    rank = dict.fromkeys(got, 1 / n)
    for _ in range(200):
        loose = sum(v for k, v in rank.items() if k not in {a for a, _ in edges})
        rank = {k: 0.15 / n + 0.85 * (loose / n + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == k)) for k in rank}
    assert {k: r["pagerank"] for k, r in got.items()} == pytest.approx(rank, abs=1e-6)
    assert (got[me]["in_degree"], got[me]["out_degree"], got["a"]["in_flow"], got["a"]["out_flow"]) == (3, 3, 30.0, 5.0)
    assert got[me]["flow_ratio"] == pytest.approx(47 / 13) and got["b"]["degree_ratio"] == 1.0
    small = {r["pagerank"] for r in graph.star_centrality(txns(spark, rows[:4])).collect()}
    assert small == {None}
    only_in = {r["node"]: r["pagerank"] for r in graph.star_centrality(txns(spark, [("2024-01-01", None, 5, x, 0) for x in "abcde"])).collect()}
    assert sum(only_in.values()) == pytest.approx(1)


def test_scores_take_the_isolation_forest(spark):
    r = random.Random(6)
    usual = [(f"2024-01-{1 + d:02d} {9 + k % 8:02d}:00", *((r.randint(90, 110), None) if k % 2 else (None, r.randint(90, 110))), f"p{k % 5}", 1000) for k in range(6) for d in (2 * k,)]
    odd = [(f"2024-03-{1 + k // 20:02d} {k % 20:02d}:{k % 60:02d}", *((50_000 * (1 + k % 7), None) if k % 2 else (None, 49_000 * (1 + k % 5))), f"q{k}", 7 * k) for k in range(120)]
    t = txns(spark, odd).withColumn("statement_id", F.lit(99).cast("long"))
    alike = txns(spark, usual).withColumn("statement_id", F.explode(F.expr("sequence(1L, 20L)")))  # trees without the far account need something to split
    more = lambda c: (F.col(c) * (1 + F.pmod(F.xxhash64("statement_id", "row_index"), F.lit(9)) / 20)).cast(alike.schema[c].dataType)
    t = t.unionByName(alike.withColumns({"debit": more("debit"), "credit": more("credit")}))
    t = keep(t.withColumn("row_id", F.concat_ws("-", "statement_id", "row_index")))
    table = risk_queries.features_of(t)
    flags = {x["statement_id"]: x["n_flags"] for x in scoring.mad_flags(scoring.cohort_long(table)).collect()}
    apart = {x["statement_id"]: x["isolation"] for x in models.isolation_forest(table, "statement_id", list(scoring.NAMES)).collect()}
    got = {x["statement_id"]: x["anomaly_score"] for x in risk_queries.scored(t).select("statement_id", "anomaly_score").collect()}
    assert got == pytest.approx({k: (n / len(scoring.NAMES) + apart[k]) / 2 for k, n in flags.items()})
    assert apart[99] == 1 and got[99] >= 0.5 and len(got) == 21


def test_graph_cycles(spark):
    schema = "src string, dst string, amount double, at timestamp"
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    ring = [("A", "B", 100.0, day(0)), ("B", "C", 100.0, day(1)), ("C", "A", 100.0, day(2)), ("C", "D", 5.0, day(2)), ("D", "E", 5.0, day(3)), ("F", "F", 1.0, day(0)), ("D", "G", 1.0, day(3)), ("G", "D", 500.0, day(90))]
    got = graph.graph_cycles(spark.createDataFrame(ring, schema), 0.0).collect()
    assert sorted((tuple(r["nodes"]), r["hops"], r["edges"]) for r in got) == [(("A", "B", "C"), 3, 3), (("D", "G"), 2, 2)]
    one = next(r for r in got if r["hops"] == 3)
    assert abs(one["risk"] - (0.35 + 0.30 * 3 / 2 / 10 + 0.20 + 0.15 / 3)) < 1e-9 and one["span_days"] == 2
    assert graph.graph_cycles(spark.createDataFrame([e for e in ring if e[0] in "AD"], schema), 0.0).count() == 0
    assert graph.graph_cycles(spark.createDataFrame([], schema)).count() == 0
    dense = graph.graph_cycles(spark.createDataFrame(ring, schema), 0.0, edge_cap=2).collect()
    assert sorted((r["dense"], r["hops"], r["edges"]) for r in dense) == [(False, 2, 2), (True, 0, 3)]


def brute_components(edges):
    """Nodes on cycles of two or more with the largest node that they reach and are reached by."""
    nodes = {x for e in edges for x in e}
    reach = {v: set() for v in nodes}
    for v in nodes:
        open_ = [v]
        while open_:
            x = open_.pop()
            for a, b in edges:
                if a == x and b not in reach[v]:
                    reach[v].add(b)
                    open_.append(b)
    out = {}
    for v in nodes:
        both = {u for u in reach[v] if v in reach[u]} | ({v} if v in reach[v] else set())
        if len(both) > 1:
            out[v] = max(both)
    return out


def test_strong_components_of_random_graphs(spark):
    """Sparse ones, whose chains are nested, lead out of and into components, or come back to their start."""
    for seed, n, m in ((1, 14, 16), (2, 20, 24), (3, 9, 22)):
        r = random.Random(seed)
        edges = {(f"v{r.randrange(n):02d}", f"v{r.randrange(n):02d}") for _ in range(m)}
        edges |= {("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("v00", "s1"), ("s1", "s2"), ("s2", "v00"), ("v01", "t1"), ("t1", "t2")}
        got = {x["node"]: x["component"] for x in graph.strong_components(spark.createDataFrame(sorted(edges), "src string, dst string"), keep).collect()}
        assert got == brute_components(edges), seed


def test_long_chains_take_few_jobs(spark):
    n, kept = 100_000, []

    def counted(df):
        kept.append(1)
        return keep(df)

    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.range(1000).select((F.col("id") + 10 * n).alias("src"), (10 * n + (F.col("id") + 1) % 1000).alias("dst"))
    ends = spark.createDataFrame([(n, n - 5), (-1, 0), (-2, 0)], "src long, dst long")  # the chain's last nodes come back
    got = {r["component"]: r["n"] for r in graph.strong_components(chain.unionByName(ring).unionByName(ends), counted).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {10 * n + 999: 1000, n: 6}
    assert len(kept) < 80


def test_counterparty_cascade(spark):
    cases = {
        "sweep trf": "Sweep Account", "FD MATURITY x": "Fixed Deposit", "INSTALLMENT AMOUNT FOR RD": "Recurring Deposit", "INTCR": "Bank Interest", "UPI/CR/431794202708/CHETAN SUDHAKAR/YESB": "CHETAN SUDHAKAR",
        "UPI/SHREYAS SANJAY UPI-4106": "SHREYAS SANJAY", "UPI/DR/12/CR/x": "CR/x", "ECOM:123:BLUE TOKAI MUMBAI": "BLUE TOKAI", "PCD/12/WWWSHOPPERCOM": "SHOPPER", "NEFT-CR-SBIN0001-RAVI KUMAR": "RAVI KUMAR",
        "ATM/S1A": "ATM S1A", "POS/99": "POS 99", "to me@okaxis now": "me@okaxis", "ONLINE PAYMENT grocery": "grocery", "12/34": None, "": None, None: None,
    }
    del cases["UPI/DR/12/CR/x"]
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", n.extract_counterparty(F.col("t")).alias("who"))
    assert {r["t"]: r["who"] for r in rows.collect()} == cases


def test_equal_payments_and_rows_without_an_account(spark):
    rows = [(1, "a", 1, "X:1", "Y:2", 5), (1, "b", 2, "X:1", "Y:2", 5), (1, "c", 3, "X:1", None, 5), (1, "d", 4, "X:1", None, 5), (2, "e", 1, None, None, 5), (2, "e2", 2, "X:1", "Y:2", 6)]
    ledger = spark.createDataFrame(rows, "statement_id long, row_id string, row_index long, from_account string, to_account string, amount long").withColumn("txn_date", F.lit("2024-01-01").cast("date"))
    assert sorted(r["row_id"] for r in banks.dedup_mirrored(ledger).collect()) == ["a", "c", "d", "e", "e2"]
    assert banks.dedup_mirrored(ledger.limit(0)).count() == 0


def test_node_page_by_ranges(spark):
    edges = spark.createDataFrame([(1, "E1", "S1", "S2", ["a", "b"]), (1, "E2", "S2", "S1", ["c"]), (2, "E3", "S1", "S2", ["d"])], "case_id long, edge_id string, src string, dst string, row_ids array<string>")
    rows = [("a", 1, 10, None, "2024-01-01"), ("b", 2, None, 10, "2024-01-02"), ("c", 2, 30, None, "2024-01-03"), ("d", 1, 40, None, "2024-01-04")]
    t = spark.createDataFrame(rows, "row_id string, statement_id long, debit long, credit long, day string").withColumn("txn_date", F.to_date("day"))
    page = lambda *a, **k: [r["row_id"] for r in views.node_txn_page(edges, t, 1, "S1", *a, **k).collect()]
    assert page() == ["a", "b", "c"]
    assert page("in") == ["c"] and page("out", 2) == ["b"]
    assert page(days=("2024-01-02", None)) == ["b", "c"] and page(amounts=(None, 10)) == ["a", "b"]
    assert page(finding=edges.where("edge_id = 'E2'")) == ["c"]
