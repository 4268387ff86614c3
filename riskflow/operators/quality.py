"""Reconciliation and confidence of statements, and the plausibility gate for raw grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

def money(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))


def reconcile(txns: DataFrame) -> DataFrame:
    """row_id and is_reconciled: each balance against the one before it and the row's amounts.

    Rows without a balance are taken as reconciled, and so is a statement's first balance.
    """
    w = Window.partitionBy("statement_id", F.col("balance").isNotNull()).orderBy("txn_date", "row_index")
    before = F.lag("balance").over(w)
    gap = F.abs(before - money("debit") + money("credit") - F.col("balance"))
    ok = F.col("balance").isNull() | before.isNull() | (gap <= F.lit(config.RECONCILE_TOLERANCE).cast("decimal(18,2)"))
    return txns.withColumn("is_reconciled", ok)


def reconciliation_rate(txns: DataFrame) -> DataFrame:
    """statement_id, reconciliation_rate: the share of balance rows that fit, or how far debits and credits agree."""
    d, c = F.coalesce(F.sum("debit"), F.lit(0)).cast("double"), F.coalesce(F.sum("credit"), F.lit(0)).cast("double")
    rated = F.count("balance")
    fit = F.count_if(F.col("balance").isNotNull() & F.col("is_reconciled"))
    without = F.when(F.greatest(d, c) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(c - d) / F.greatest(d, c)))
    return reconcile(txns).groupBy("statement_id").agg(F.when(rated > 0, fit / rated).otherwise(without).alias("reconciliation_rate"))


def row_confidence(txns: DataFrame) -> DataFrame:
    """row_id, row_confidence: the mean of reading, completeness and reconciliation."""
    whole = F.col("txn_date").isNotNull() & F.col("narration").isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull())
    reading = F.coalesce(F.col("ocr_confidence"), F.lit(1.0)) if "ocr_confidence" in txns.columns else F.lit(1.0)
    return reconcile(txns).select("row_id", ((reading + F.when(whole, 1.0).otherwise(0.5) + F.when(F.col("is_reconciled"), 1.0).otherwise(0.5)) / 3).alias("row_confidence"))


def extraction_tier(rate: Column) -> Column:
    return F.when(rate >= config.TIER_HIGH, "high").when(rate >= config.TIER_MEDIUM, "medium").otherwise("low")


def extraction_tiers(txns: DataFrame) -> DataFrame:
    return reconciliation_rate(txns).select("statement_id", extraction_tier(F.col("reconciliation_rate")).alias("tier"))


def ood_tier(score: Column) -> Column:
    return F.when(score >= config.OOD_PROCEED, "auto_proceed").when(score >= config.OOD_LOW, "low_confidence").otherwise("hard_reject")


NUMBER = r"^\s*-?[₹$]?\s*[\d,]+(\.\d+)?\s*$"
DATE = r"^\s*(\d{1,4}[-/. ]\d{1,2}[-/. ]\d{1,4}|\d{1,2}[-/ ][A-Za-z]{3,9}[-/ ]\d{2,4})\s*$"
BANK_MARKS = (r"[A-Z]{4}0[A-Z0-9]{6}", r"(?i)account\s*(no|number)", r"(?i)statement\s+of\s+account", r"(?i)\bbank\b", r"(?i)ifsc", r"(?i)\b(opening|closing)\s+balance\b")


def ood_score(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Plausibility of raw grids.

    Args:
        cells: file_id, row, col, value (strings). texts: file_id, text, n_rows.
    Returns:
        file_id, the six signals, score and tier; fewer than three rows score 0.
    """
    value = F.trim("value")
    filled = F.col("value").isNotNull() & (value != "")
    number = F.when(value.rlike(NUMBER), F.regexp_replace(value, "[₹$,\\s]", "").cast("double"))
    step = Window.partitionBy("file_id", "col").orderBy("row")
    c = cells.withColumns({"_ok": filled, "_num": number, "_date": value.rlike(DATE)}).withColumn("_prev", F.lag("_num").over(step))
    smooth = F.abs(F.col("_num") - F.col("_prev")) <= 0.5 * F.greatest(F.abs("_num"), F.abs("_prev"), F.lit(1.0))
    share = lambda x: F.count_if(F.col("_ok") & x) / F.greatest(F.count_if("_ok"), F.lit(1))
    in_front = F.col("row") <= 20
    columns = c.groupBy("file_id", "col").agg(
        share(F.col("_date")).alias("d"), share(F.col("_num").isNotNull()).alias("a"), F.count_if("_ok").alias("n"),
        F.count("_num").alias("k"), F.min("_num").alias("low"), F.max("_num").alias("high"),
        (F.count_if(smooth & in_front) / F.greatest(F.count_if(F.col("_prev").isNotNull() & F.col("_num").isNotNull() & in_front), F.lit(1))).alias("s"),
        share(F.length(value) > 10).alias("long"), (F.count_distinct(F.when(F.col("_ok"), value)) / F.greatest(F.count_if("_ok"), F.lit(1))).alias("distinct"),
    )
    balance = (F.col("k") >= 3) & ~((F.col("low") > 0) & (F.col("high") > 100 * F.col("low"))) & ((F.col("s") >= 0.3) | (F.col("low") == F.col("high")))
    narrated = (F.col("long") > 0.3) & (F.col("distinct") > 0.3)
    marks = sum(F.when(F.col("text").rlike(m), 1).otherwise(0) for m in BANK_MARKS) / len(BANK_MARKS)
    signals = columns.groupBy("file_id").agg(
        F.coalesce(F.min_by("d", F.when(F.col("d") >= 0.8, F.col("col"))), F.lit(0.0)).alias("date"),
        (F.count_if((F.col("n") > 0) & (F.col("a") >= 0.8)) / F.greatest(F.count_if(F.col("n") > 0), F.lit(1))).alias("amount"),
        F.coalesce(F.min_by(F.when(F.col("low") == F.col("high"), 1.0).otherwise(F.col("s")), F.when(balance, F.col("col"))), F.lit(0.0)).alias("balance"),
        F.coalesce(F.min_by("distinct", F.when(narrated, F.col("col"))), F.lit(0.0)).alias("narration"),
    )
    out = texts.withColumn("bank", marks).join(signals, "file_id", "left").withColumn("row_count", F.when(F.col("n_rows").between(3, 200_000), 1.0).otherwise(0.0)).fillna(0.0)
    score = F.when(F.col("n_rows") < 3, 0.0).otherwise(F.least(F.lit(1.0), sum(F.col(k) * w for k, w in config.OOD_WEIGHTS.items())))
    return out.select("file_id", *config.OOD_WEIGHTS, score.alias("score")).withColumn("tier", ood_tier(F.col("score")))


def ood_failure_reasons(scored: DataFrame) -> DataFrame:
    """file_id, reasons: the signals below a half."""
    low = F.filter(F.array(*(F.when(F.col(k) < 0.5, F.lit(k)) for k in config.OOD_WEIGHTS)), lambda x: x.isNotNull())
    return scored.select("file_id", F.when(F.size(low) == 0, F.array(F.lit("All signals passed"))).otherwise(low).alias("reasons"))
