"""Which column of an unknown statement holds which field, by its header and its content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.narration import parse_date
from ..functions.similarity import token_sort_ratio

#: What statements call each field (fixed values).
FIELD_HINTS = {
    "txn_date": ("transaction date", "txn date", "tran date", "date", "post date", "trans date", "posting date", "txndate", "txn_date"),
    "value_date": ("value date", "value dt", "val dt", "val date", "value_date"),
    "narration": ("narration", "description", "particulars", "details", "remarks", "transaction details", "transaction particulars", "txn description"),
    "debit_amount": ("debit amount (₹)", "debit amount", "withdrawal amount", "debit", "withdrawal", "dr", "dr amount", "withdrawal amt", "debit (inr)", "amount debited", "dr."),
    "credit_amount": ("credit amount (₹)", "credit amount", "deposit amount", "credit", "deposit", "cr", "cr amount", "deposit amt", "credit (inr)", "amount credited", "cr."),
    "balance_after": ("running balance (₹)", "running balance", "balance (₹)", "balance", "closing balance", "available balance", "balance amt", "balance (inr)", "net balance", "clear balance"),
    "reference_no": ("transaction reference", "chq / ref no.", "chq/ref no", "chq no", "ref no", "reference no", "cheque no", "utr", "ref", "reference", "chq/ref", "txn ref", "reference number"),
}
HEADER_WEIGHT, CONTENT_WEIGHT, LEAST = 0.5, 0.5, 0.55
#: A header as like a hint as this counts by itself, at this share.
SURE, SURE_SHARE = 0.85, 0.9
SAMPLE_ROWS = 50
#: Fields that an empty column may hold, and how well it does.
MAYBE_EMPTY, EMPTY_SCORE = ("credit_amount", "debit_amount", "reference_no", "value_date"), 0.5


def share(hit: Column) -> Column:
    return F.avg(F.coalesce(hit, F.lit(False)).cast("int"))


def content_scores(values: DataFrame) -> DataFrame:
    """file, col, field, content: how well a column's values fit a field.

    values: file, col and value of the sampled rows.
    """
    v = F.col("value")
    full = values.withColumn("value", F.when(F.trim(v) != "", v))
    number = F.regexp_replace(v, r"Rs\.|INR|[,₹$+\- ]", "").try_cast("double").isNotNull()
    day = (F.length(v) >= 6) & parse_date(v).isNotNull()
    per = full.groupBy("file", "col").agg(
        F.count("value").alias("n"), F.avg(F.when(v.isNotNull(), day.cast("int"))).alias("days"), F.avg(F.when(v.isNotNull(), number.cast("int"))).alias("numbers"),
        F.avg((F.length(v) > 8).cast("int")).alias("long"), F.avg(v.rlike(r"\d").cast("int")).alias("digits"), (F.count_distinct("value") / F.greatest(F.count("value"), F.lit(1))).alias("distinct"),
    )
    fit = {
        "txn_date": F.col("days"), "value_date": F.col("days") * 0.9, "narration": F.col("long") * 0.5 + F.col("distinct") * 0.5, "debit_amount": F.col("numbers"),
        "credit_amount": F.col("numbers"), "balance_after": F.col("numbers"), "reference_no": F.col("digits") * 0.5 + F.col("distinct") * 0.5,
    }
    each = [F.struct(F.lit(f).alias("field"), F.when(F.col("n") == 0, F.lit(EMPTY_SCORE if f in MAYBE_EMPTY else 0.0)).otherwise(fit[f]).alias("content")) for f in FIELD_HINTS]
    return per.select("file", "col", F.explode(F.array(*each)).alias("x")).select("file", "col", "x.*")


@F.pandas_udf(ArrayType(DoubleType()))
def header_scores(headers: pd.Series) -> pd.Series:
    """The likeness of each header with each field's best hint."""

    def one(header: str) -> list[float]:
        plain = header.lower()
        for mark in ("₹", "inr", "(", ")"):
            plain = plain.replace(mark, "")
        return [max(token_sort_ratio(plain.strip(), hint) for hint in hints) for hints in FIELD_HINTS.values()]

    return headers.map(one)


def classify_columns(body: DataFrame) -> DataFrame:
    """file, col, field and score: the field of each column, each column and field once, the best score first.

    body: file, row, header and cells, as ``scan_statement_csv`` gives them; content is that of a file's first
    SAMPLE_ROWS rows. Equal scores go by column and then by the order of the fields.
    """
    first = body.groupBy("file").agg(F.min("row").alias("_from"))
    rows = body.join(first, "file").where(F.col("row") < F.col("_from") + SAMPLE_ROWS)
    values = rows.select("file", "header", F.posexplode("header").alias("col", "name"), "cells").select("file", "col", "name", F.get("cells", F.col("col")).alias("value"))
    names = values.groupBy("file", "col").agg(F.first("name").alias("name"))
    distinct = names.select(F.coalesce("name", F.lit("")).alias("name")).distinct().withColumn("_scores", header_scores("name"))
    fields = list(FIELD_HINTS)
    likeness = names.withColumn("name", F.coalesce("name", F.lit(""))).join(distinct, "name").select("file", "col", F.posexplode("_scores").alias("_f", "header"))
    likeness = likeness.withColumn("field", F.element_at(F.array(*map(F.lit, fields)), F.col("_f") + 1))
    both = content_scores(values).join(likeness, ["file", "col", "field"])
    score = F.col("header") * HEADER_WEIGHT + F.col("content") * CONTENT_WEIGHT
    score = F.when(F.col("header") >= SURE, F.greatest(score, F.col("header") * SURE_SHARE)).otherwise(score)
    good = both.withColumn("score", score).where(F.col("score") >= LEAST)

    def assign(one: pd.DataFrame) -> pd.DataFrame:
        """A file's columns by seven fields at most."""
        chosen, columns, taken = [], set(), set()
        for r in one.sort_values(["score", "col", "_f"], ascending=[False, True, True]).itertuples():
            if r.col not in columns and r.field not in taken:
                chosen.append((r.file, r.col, r.field, r.score))
                columns.add(r.col)
                taken.add(r.field)
        return pd.DataFrame(chosen, columns=["file", "col", "field", "score"])

    return good.select("file", "col", "field", "score", "_f").groupBy("file").applyInPandas(assign, f"file {dict(body.dtypes)['file']}, col int, field string, score double")
