"""Multi-statement cases: mirrored references, transfer edges, findings and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

CASE = "case_id"


def normal_reference(ref: Column) -> Column:
    """Upper-case letters and digits; null where too short or generic."""
    r = F.regexp_replace(F.upper(ref), "[^A-Z0-9]", "")
    return F.when((F.length(r) >= config.REFERENCE_LENGTH) & ~r.isin(*config.GENERIC_REFERENCES), r)


def observations(rows: DataFrame) -> DataFrame:
    debit = F.coalesce("debit", F.lit(0)) > 0
    amount = F.when(debit, F.col("debit")).otherwise(F.col("credit"))
    return rows.withColumns({"ref": normal_reference(F.col("reference_no")), "is_debit": debit, "amount": amount}).where("amount > 0")


def mirrored_pairs(rows: DataFrame, days: int = 1) -> DataFrame:
    """case_id, ref, row_id, n_mirrors, ambiguous: rows of a reference, and whether each has just one mirror.

    A mirror is the opposite leg in another statement, of the same amount and at most ``days`` apart. One row without
    just one mirror makes its whole reference ambiguous.
    """
    o = observations(rows).where("ref is not null").select(CASE, "ref", "row_id", "statement_id", "txn_date", "is_debit", "amount")
    m = o.select(CASE, "ref", *(F.col(c).alias(f"m_{c}") for c in ("row_id", "statement_id", "txn_date", "is_debit", "amount")))
    fits = (F.col("statement_id") != F.col("m_statement_id")) & (F.col("is_debit") != F.col("m_is_debit")) & (F.abs(F.col("amount") - F.col("m_amount")) <= 0.01) & (F.abs(F.datediff("txn_date", "m_txn_date")) <= days)
    pairs = o.join(m, [CASE, "ref"]).where(fits).groupBy(CASE, "row_id").agg(F.count("*").alias("n_mirrors"), F.min("m_row_id").alias("mirror"))
    both = o.select(CASE, "ref", "row_id").join(pairs, [CASE, "row_id"], "left").withColumn("n_mirrors", F.coalesce("n_mirrors", F.lit(0)))
    bad = F.max((F.col("n_mirrors") != 1).cast("int")).over(Window.partitionBy(CASE, "ref"))
    return both.withColumn("ambiguous", bad == 1)


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def case_edges(rows: DataFrame) -> DataFrame:
    """Edges of all cases: case_id, edge_id, src, dst, amount, txn_date, row_ids, statement_ids, resolution.

    A mirrored pair is one edge between its two statements; any other row is one to a counterparty of its own statement.
    """
    o = observations(rows)
    marks = mirrored_pairs(rows).select(CASE, "row_id", "mirror", "ambiguous")
    all_ = o.join(marks, [CASE, "row_id"], "left")
    clear = F.col("ambiguous").isNotNull() & ~F.col("ambiguous")
    subject = F.concat(F.lit("S"), F.col("statement_id"))
    pair = all_.where(clear).withColumn("pair", F.concat_ws("+", F.array_sort(F.array("row_id", "mirror"))))
    mirrored = pair.groupBy(CASE, "ref", "pair").agg(
        F.max(F.when(F.col("is_debit"), subject)).alias("src"), F.max(F.when(~F.col("is_debit"), subject)).alias("dst"), F.max(F.when(F.col("is_debit"), F.col("amount"))).alias("amount"),
        F.min("txn_date").alias("txn_date"), F.array_sort(F.collect_set("row_id")).alias("row_ids"), F.array_sort(F.collect_set("statement_id")).alias("statement_ids"),
    )
    mirrored = mirrored.select(CASE, short_id("E", F.col(CASE).cast("string"), F.col("ref"), F.col("pair")).alias("edge_id"), "src", "dst", "amount", "txn_date", "row_ids", "statement_ids", F.lit("mirrored_reference").alias("resolution"))
    other = F.concat(subject, F.lit(":"), F.coalesce("counterparty", F.col("row_id")))
    alone = all_.where(~clear | F.col("ambiguous").isNull()).select(
        CASE, short_id("E", F.col(CASE).cast("string"), F.col("row_id")).alias("edge_id"), F.when(F.col("is_debit"), subject).otherwise(other).alias("src"), F.when(F.col("is_debit"), other).otherwise(subject).alias("dst"),
        "amount", "txn_date", F.array("row_id").alias("row_ids"), F.array("statement_id").alias("statement_ids"),
        F.when(F.col("ambiguous"), "ambiguous_mirrored_reference").otherwise("unresolved_name_not_merged").alias("resolution"),
    )
    return mirrored.unionByName(alone)


def case_findings(edges: DataFrame, checkpoint=None) -> DataFrame:
    """Conserved cycles within each case over its mirrored edges."""
    from .graph import conserved_cycles

    t = edges.where("resolution = 'mirrored_reference'").select(CASE, F.col("edge_id").alias("row_idx"), F.col("txn_date").cast("timestamp").alias("ts"), F.col("src").alias("from_account"), F.col("dst").alias("to_account"), "amount")
    return conserved_cycles(t, scope=CASE, checkpoint=checkpoint)


def case_graph_view(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """case_id, node, n_edges, tier: high for nodes on a finding."""
    nodes = edges.select(CASE, F.explode(F.array("src", "dst")).alias("node")).groupBy(CASE, "node").agg(F.count("*").alias("n_edges"))
    on = findings.select(CASE, F.explode("accounts").alias("node")).distinct().withColumn("_on", F.lit(True))
    return nodes.join(on, [CASE, "node"], "left").select(CASE, "node", "n_edges", F.when(F.col("_on"), "high").otherwise("low").alias("tier"))


def case_edges_view(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """case_id, edge_id, src, dst, amount, resolution, on_finding: whether a finding runs over the edge."""
    on = findings.select(CASE, F.explode("idxs").alias("edge_id")).distinct().withColumn("on_finding", F.lit(True))
    return edges.join(on, [CASE, "edge_id"], "left").select(CASE, "edge_id", "src", "dst", "amount", "resolution", F.coalesce("on_finding", F.lit(False)).alias("on_finding"))


def finding_edges(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of each finding in order: case_id, ring, hop, edge_id, src, dst, amount, row_ids."""
    at = findings.select(CASE, "ring", F.posexplode("idxs").alias("hop", "edge_id"))
    return at.join(edges.select(CASE, "edge_id", "src", "dst", "amount", "txn_date", "row_ids", "statement_ids"), [CASE, "edge_id"])


def draft_records(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """One record per finding: ordered hops with their evidence, subjects, dates, total and summary."""
    hops = finding_edges(findings, edges)
    one = hops.groupBy(CASE, "ring").agg(
        F.array_sort(F.collect_list(F.struct("hop", "edge_id", "src", "dst", "amount", F.concat(F.array("edge_id"), F.col("row_ids")).alias("evidence")))).alias("hops"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("subjects"), F.sum("amount").alias("total"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"),
    )
    text = F.format_string("%d transfers moved %s between %d parties from %s to %s and back.", F.size("hops"), F.col("total").cast("string"), F.size("subjects"), F.col("first_date").cast("string"), F.col("last_date").cast("string"))
    return one.withColumns({"filing_status": F.lit("NOT_FILED"), "summary": text})


def cascade_delete(tables: dict[str, DataFrame], statement_ids: DataFrame, membership: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of deleted statements, and of every case that held one of them.

    ``tables`` by name, keyed by statement_id or case_id; ``membership``: case_id, statement_id.
    """
    cases = membership.join(statement_ids, "statement_id", "left_semi").select(CASE).distinct()
    return {name: df.join(statement_ids, "statement_id", "left_anti") if "statement_id" in df.columns else df.join(cases, CASE, "left_anti") for name, df in tables.items()}


def case_statements(statements: DataFrame, membership: DataFrame, case_id: int | None = None) -> DataFrame:
    """The statements that belong to a case, or to any case; each once, however many cases it is in."""
    members = membership if case_id is None else membership.where(F.col("case_id") == case_id)
    return statements.join(members.select("statement_id"), "statement_id", "left_semi")
