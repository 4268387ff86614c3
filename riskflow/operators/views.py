"""Pages, summaries and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import publish


def matching_txns(txns: DataFrame, statement_id: int, channel: str | None = None, category: str | None = None, low: float | None = None, high: float | None = None, search: str = "") -> DataFrame:
    """A statement's transactions of a channel and category, with a text in their narration; bounds hold for either leg. Its count is a page's total."""
    rows = txns.where((F.col("statement_id") == statement_id) & F.col("narration").ilike(f"%{search}%"))
    for name, value in (("channel", channel), ("category", category)):
        rows = rows.where(F.col(name) == value) if value else rows
    if low is not None:
        rows = rows.where((F.col("debit") >= low) | (F.col("credit") >= low))
    if high is not None:
        rows = rows.where((F.col("debit") <= high) | (F.col("credit") <= high))
    return rows


def txn_page(txns: DataFrame, statement_id: int, *filters, offset: int = 0, size: int = 50, **more) -> DataFrame:
    """One page of :func:`matching_txns`."""
    return matching_txns(txns, statement_id, *filters, **more).orderBy("txn_date", "row_index").offset(offset).limit(size)


def node_txn_page(
    edges: DataFrame, txns: DataFrame, case_id: int, node: str, way: str | None = None, statement_id: int | None = None, days: tuple[str | None, str | None] = (None, None), amounts: tuple[float | None, float | None] = (None, None), finding: DataFrame | None = None, offset: int = 0, size: int = 50,
) -> DataFrame:
    """The transactions behind a case's node: of one way or statement, within days and amounts, on a finding's edges (``finding``: edge_id)."""
    touch = {"in": F.col("dst") == node, "out": F.col("src") == node}.get(way, (F.col("src") == node) | (F.col("dst") == node))
    near = edges.where((F.col("case_id") == case_id) & touch)
    near = near.join(finding.select("edge_id"), "edge_id", "left_semi") if finding is not None else near
    rows = txns.join(near.select(F.explode("row_ids").alias("row_id")).distinct(), "row_id", "left_semi")
    rows = rows.where(F.col("statement_id") == statement_id) if statement_id is not None else rows
    amount = F.when(F.coalesce("debit", F.lit(0)) > 0, F.col("debit")).otherwise(F.col("credit"))
    for value, (low, high) in ((F.col("txn_date"), (F.lit(d).cast("date") if d is not None else None for d in days)), (amount, amounts)):
        rows = rows.where(value >= low) if low is not None else rows
        rows = rows.where(value <= high) if high is not None else rows
    return rows.orderBy("txn_date", "row_id").offset(offset).limit(size)


def txn_counterparty(txns: DataFrame, counterparties: DataFrame) -> DataFrame:
    """Transactions with the display name of their counterparty."""
    return txns.join(counterparties, ["statement_id", "counterparty"], "left")


def reference_cohort(features: DataFrame) -> DataFrame:
    """For each account and feature the sum and count over all other accounts, from totals."""
    total = features.groupBy("name").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    mine = F.coalesce("value", F.lit(0.0))
    return features.join(F.broadcast(total), "name").select("statement_id", "name", (F.col("_s") - mine).alias("others_sum"), (F.col("_n") - F.col("value").isNotNull().cast("int")).alias("others"))  # a row for each feature


def bounds(legs: DataFrame) -> DataFrame:
    """First and last day, number and amount of what each bank sent and received; null days and zeros where it did neither."""
    found = []
    for way, name in (("out", "sent"), ("in", "received")):
        on = F.col("way") == way
        found += [F.min(F.when(on, F.col("day"))).cast("string").alias(f"first_{name}"), F.max(F.when(on, F.col("day"))).cast("string").alias(f"last_{name}"), F.count_if(on).alias(f"n_{name}"), F.coalesce(F.sum(F.when(on, F.col("amount"))).cast("double"), F.lit(0.0)).alias(name)]
    return legs.groupBy("bank").agg(*found)


def statement_summary(statements: DataFrame, bundles: DataFrame) -> DataFrame:
    """Each statement with the tier and score of its latest bundle."""
    latest = bundles.groupBy("statement_id").agg(F.max_by(F.struct("tier", "score"), "created_ts").alias("b"))
    return statements.join(latest, "statement_id", "left").select(*statements.columns, "b.tier", "b.score")


def statement_rollup(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("analysed"), F.count_if(F.col("tier") == "CONFIRMED_SUSPICIOUS").alias("suspicious"), F.count_if(F.col("tier") == "REVIEW_REQUIRED").alias("review"), F.sum("n").alias("transactions"))


def sink_results(df: DataFrame, path: str, key: str = "statement_id") -> None:
    """Replace the written partitions of the keys in ``df``; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def export_evidence_json(bundle: DataFrame, path: str) -> None:
    bundle.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def sink_intel(transfers: DataFrame, risk: DataFrame, volume: DataFrame, edges: DataFrame, path: str, dataset: int) -> str:
    """Ledger, banks, edges and profiles of one dataset, published as one version.

    Args:
        transfers: the ledger with from_bank and to_bank. risk: bank, risk_score, driver, tier. volume: bank and its totals.
            edges: from_bank, to_bank and their totals.
    """
    banks = transfers.select(F.explode(F.array("from_bank", "to_bank")).alias("bank")).where("bank is not null").distinct()
    named = banks.withColumn("display_name", F.regexp_replace("bank", "^BANK_", "Bank "))
    profiles = volume.join(risk, "bank", "left")
    profiles = profiles.withColumn("profile", F.to_json(F.struct(*(F.col(c) for c in profiles.columns))))
    return publish({"ledger": transfers, "banks": named, "edges": edges, "profiles": profiles}, path, dataset)
