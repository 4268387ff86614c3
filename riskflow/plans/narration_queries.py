"""Registered queries on narrations, parsing and pages of transactions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import narration as n
from ..functions.similarity import assign_category, match_templates, merge_variants
from ..operators.features import name_consistency
from ..sources.adapters import SQL_TXN, transactions
from ..sources.columns import classify_columns
from ..sources.readers import extract_preamble, map_rows, scan_statement_csv

QUERIES, ORACLES = {}, {}


def on_transactions(name, make, sql=None):
    QUERIES[name] = lambda spark, d: make(transactions(spark, d))
    if sql:
        ORACLES[name] = f"WITH {SQL_TXN} {sql}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WAY = "CASE WHEN coalesce(debit, 0) >= coalesce(credit, 0) AND coalesce(debit, 0) > 0 THEN 'debit' ELSE 'credit' END"


def direction():
    return n.direction_of(F.col("debit"), F.col("credit"))


def who():
    return n.extract_counterparty(F.col("narration"))


def bank():
    return n.resolve_bank(F.col("narration"))


CHANNEL = "CASE " + " ".join(f"WHEN regexp_matches(narration, {quoted('(?i)' + '|'.join(p))}) THEN '{c}'" for c, p in config.CHANNELS.items()) + " ELSE 'UNKNOWN' END"


def category_sql() -> str:
    cases = []
    for name, (way, words) in config.CATEGORIES.items():
        hit = " OR ".join(f"contains(lower(narration), {quoted(w)})" for w in words)
        cases.append(f"WHEN ({hit})" + ("" if way == "any" else f" AND {WAY} = '{way}'") + f" THEN '{name}'")
    return "CASE " + " ".join(cases) + " END"


#: Who each kind of narration names, stated for itself and not by the library's patterns.
WHO = """CASE row_index % 24 WHEN 0 THEN 'payee' || counterparty || '@okaxis' WHEN 1 THEN 'payee' || counterparty || ' LTD'
  WHEN 2 THEN 'payee' || counterparty || '-' || ['SBIN','HDFC','ICIC','UTIB','PUNB','KKBK','YESB','CNRB'][row_index % 8 + 1] WHEN 3 THEN 'payee' || counterparty
  WHEN 4 THEN 'CASH' WHEN 5 THEN 'STORES' WHEN 6 THEN 'refund' WHEN 7 THEN 'salary' WHEN 8 THEN 'payee' || counterparty || ' HOTEL'
  WHEN 9 THEN 'Sweep Account' WHEN 10 THEN 'Fixed Deposit' WHEN 11 THEN 'Recurring Deposit' WHEN 12 THEN 'Merchant Refund' WHEN 13 THEN 'Bank SMS Charges'
  WHEN 14 THEN 'ATM Maintenance Charges' WHEN 15 THEN 'Cash Deposit' WHEN 16 THEN 'Bank Interest' WHEN 17 THEN 'payeeshop' WHEN 18 THEN 'ATM SN1234' WHEN 19 THEN 'POS 4321'
  WHEN 20 THEN 'payee' || counterparty || '@ybl' WHEN 22 THEN 'payee shop' WHEN 23 THEN 'union' END"""
OWN = "(row_index % 24 = 9 OR (contains(narration, 'payee') AND contains(narration, 'payee' || statement_id)))"
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(who)), '[^\w\s@.\-]', '', 'g'), '\b(PVT|LTD|LIMITED|PRIVATE|LLP|INC|CORP|CO)\b\.?', ' ', 'g'), '\s+', ' ', 'g'))"
KNOWN = "[" + ",".join(quoted(b) for b in config.BANKS) + "]"
HANDLES = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in config.UPI_HANDLES.items()) + "}"
NAMED = "CASE " + " ".join(f"WHEN regexp_matches(lower(narration), {quoted(f'(^|[^a-z]){a}($|[^a-z])')}) THEN {quoted(config.NAME_ALIASES[a])}" for a in sorted(config.NAME_ALIASES, key=len, reverse=True)) + " END"
NAMES = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in config.BANKS.items()) + "}"
CODES = rf"""SELECT row_id, [c FOR c IN regexp_extract_all(upper(narration), '\b([A-Z]{{4}})0[A-Z0-9]{{6}}\b', 1) IF list_contains({KNOWN}, c)][1] AS a,
  [c FOR c IN regexp_extract_all(upper(narration), '\b([A-Z]{{4}})0[A-Z0-9]{{3,9}}\b', 1) IF list_contains({KNOWN}, c)][1] AS b,
  [c FOR c IN regexp_extract_all(upper(narration), '\b([A-Z]{{4}})[0-9]{{6,}}\b', 1) IF list_contains({KNOWN}, c)][1] AS c,
  [h FOR h IN [{HANDLES}[x] FOR x IN regexp_extract_all(lower(narration), '@([a-z]+)', 1)] IF h IS NOT NULL][1] AS d,
  {NAMED} AS e FROM txn"""

on_transactions("E1_infer_channel", lambda t: t.select("row_id", n.infer_channel(F.col("narration")).alias("channel")), f"SELECT row_id, {CHANNEL} AS channel FROM txn")
on_transactions("E2_category_by_keyword", lambda t: t.select("row_id", n.category_by_keyword(F.col("narration"), direction()).alias("category")), f"SELECT row_id, {category_sql()} AS category FROM txn")
on_transactions("E3_extract_counterparty", lambda t: t.select("row_id", who().alias("who")), f"SELECT row_id, {WHO} AS who FROM txn")
on_transactions("E4_clean_merchant", lambda t: t.select("row_id", n.clean_merchant(F.concat(who(), F.lit("com/"))).alias("merchant")),
                f"SELECT row_id, trim(CASE WHEN length(m) > 6 AND regexp_matches(m, '(?i)COM$') THEN regexp_replace(m, '(?i)COM$', '') ELSE m END) AS merchant FROM (SELECT row_id, CASE WHEN length(m) > 5 AND regexp_matches(m, '(?i)IN$') THEN regexp_replace(m, '(?i)IN$', '') ELSE m END AS m FROM (SELECT row_id, regexp_replace(regexp_replace(trim({WHO} || 'com/'), '/+$', ''), '(?i)^www', '') AS m FROM txn))")
on_transactions("E5_is_self_transfer", lambda t: t.select("row_id", n.is_self_transfer(F.col("narration"), F.concat(F.lit("payee"), F.col("statement_id"))).alias("own")),
                f"SELECT row_id, {OWN} AS own FROM txn")
on_transactions("E6_normalize_counterparty", lambda t: t.select("row_id", n.normalize_counterparty(who()).alias("name")), f"SELECT row_id, {NORMAL} AS name FROM (SELECT row_id, {WHO} AS who FROM txn)")


def counterparties(t):
    """Names of each statement: a narration's payee is worked out once a row, its normal form once for each payee."""
    own = n.is_self_transfer(F.col("narration"), F.concat(F.lit("payee"), F.col("statement_id")))
    raw = t.groupBy("statement_id", who().alias("raw")).agg(F.min("row_index").alias("first"), F.bool_or(own).alias("own"), F.count("*").alias("n"))
    named = raw.withColumn("name", n.normalize_counterparty(F.col("raw")))
    return named.groupBy("statement_id", "name").agg(F.min_by("raw", "first").alias("variant"), F.bool_or("own").alias("own"), F.sum("n").alias("n"))


on_transactions("E8_counterparty_dim", counterparties,
                f"SELECT statement_id, {NORMAL} AS name, min_by(who, row_index) AS variant, bool_or(own) AS own, count(*) AS n FROM (SELECT statement_id, row_index, {WHO} AS who, {OWN} AS own FROM txn) GROUP BY 1, 2")
on_transactions("E9_resolve_bank", lambda t: t.select("row_id", bank().alias("b")).select("row_id", "b.code", "b.signal"),
                f"SELECT row_id, coalesce(a, b, c, d, e) AS code, CASE WHEN a IS NOT NULL THEN 'ifsc' WHEN b IS NOT NULL THEN 'ifsc_partial' WHEN c IS NOT NULL THEN 'reference_prefix' WHEN d IS NOT NULL THEN 'upi_handle' WHEN e IS NOT NULL THEN 'name' END AS signal FROM ({CODES})")
on_transactions("E10_resolve_subject_bank", lambda t: t.groupBy("statement_id").agg(F.min_by("narration", "row_index").alias("p")).select("statement_id", n.resolve_subject_bank(F.col("p"), F.lit("none"), F.concat(F.lit("hdfc_"), F.col("statement_id"), F.lit(".csv"))).alias("b")).select("statement_id", "b.code", "b.signal"),
                f"SELECT f.statement_id, coalesce(a, b, c, d, e, 'HDFC') AS code, CASE WHEN coalesce(a, b, c, d, e) IS NULL THEN 'filename' ELSE 'preamble' END AS signal FROM (SELECT statement_id, min_by(row_id, row_index) AS row_id FROM txn GROUP BY 1) f JOIN ({CODES}) USING (row_id)")
on_transactions("E11_resolve_counterparty_bank", lambda t: t.select("row_id", n.resolve_counterparty_bank(F.col("narration")).alias("bank")), f"SELECT row_id, coalesce(a, b, c, d, e, 'UNATTRIBUTED') AS bank FROM ({CODES})")
on_transactions("E13_bank_name", lambda t: t.select("row_id", n.bank_name(n.resolve_counterparty_bank(F.col("narration"))).alias("bank")), f"SELECT row_id, coalesce({NAMES}[coalesce(a, b, c, d, e)], 'Unattributed') AS bank FROM ({CODES})")
LAYOUTS = ("d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "d-MMMM-yyyy", "MMM d, yyyy", "MMM d yyyy", "d/M/yyyy", "d/M/yy", "yyyy-MM-dd", "d-M-yyyy", "yyyyMMdd", "d.M.yyyy", "yyyy/M/d", "d MMM yy")


def written_date():
    """The day in one layout after the other, months in upper case in every second row."""
    out = F.lit(None).cast("string")
    for k, layout in enumerate(LAYOUTS):
        out = F.when(F.col("row_index") % len(LAYOUTS) == k, F.date_format("txn_date", layout)).otherwise(out)
    return F.when(F.col("row_index") % 2 == 0, F.upper(out)).otherwise(out)


on_transactions("P1_parse_date", lambda t: t.select("row_id", n.parse_date(written_date()).cast("string").alias("day")), "SELECT row_id, CAST(txn_date AS VARCHAR) AS day FROM txn")
on_transactions("P2_parse_amount", lambda t: t.select("row_id", n.parse_amount(F.when(F.col("debit").isNotNull(), F.concat(F.lit("("), F.format_number("debit", 2), F.lit(")"))).when(F.col("credit").isNotNull(), F.concat(F.lit("INR "), F.format_number("credit", 2))).otherwise(F.lit("-"))).cast("double").alias("amount")),
                "SELECT row_id, CASE WHEN debit IS NOT NULL THEN -(debit / 100.0) ELSE credit / 100.0 END AS amount FROM txn")
on_transactions("P8_amount_direction", lambda t: t.select("row_id", n.amount_of(F.col("debit"), F.col("credit")).cast("double").alias("amount"), direction().alias("direction"), n.case_direction(F.col("debit")).alias("case_direction")),
                f"SELECT row_id, greatest(coalesce(debit, 0), coalesce(credit, 0)) / 100.0 AS amount, {WAY} AS direction, CASE WHEN coalesce(debit, 0) > 0 THEN 'debit' ELSE 'credit' END AS case_direction FROM txn")
on_transactions("P15_redact_pii", lambda t: t.select("row_id", n.redact_pii(F.col("narration")).alias("text")),
                r"SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(narration, '\b\d{16}\b', '[CARD]', 'g'), '\b[A-Z]{4}0[A-Z0-9]{6}\b', '[IFSC]', 'g'), '\b\d{12}\b', '[AADHAAR]', 'g'), '\b[A-Z]{5}\d{4}[A-Z]\b', '[PAN]', 'g'), '\b\d{10}\b', '[PHONE]', 'g') AS text FROM txn")
on_transactions("P19_channel_to_format", lambda t: t.select("row_id", n.channel_to_format(n.infer_channel(F.col("narration")), F.col("narration")).alias("format")),
                f"SELECT row_id, CASE WHEN contains(b, 'rtgs') THEN 'rtgs' WHEN contains(b, 'neft') THEN 'neft' WHEN contains(b, 'imps') THEN 'imps' WHEN contains(b, 'upi') THEN 'upi' WHEN contains(b, 'cash') OR contains(b, 'atm') THEN 'cash' WHEN contains(b, 'cheque') OR contains(b, 'chq') THEN 'cheque' WHEN contains(b, 'pos') OR contains(b, 'card') THEN 'card' ELSE lower(c) END AS format FROM (SELECT row_id, {CHANNEL} AS c, lower({CHANNEL} || ' ' || narration) AS b FROM txn)")
on_transactions("E2_assign_category", lambda t: assign_category(t.select("row_id", "narration", direction().alias("direction"))).select("row_id", "category"))
on_transactions("E7_merge_variants", lambda t: merge_variants(t.select("statement_id", n.normalize_counterparty(who()).alias("name"))))


def raw_statement(t):
    """Every statement as a raw file: odd headers, cells as text, one empty column."""
    cells = (F.date_format("txn_date", "dd/MM/yyyy"), F.lit(""), F.col("narration"), F.col("reference_no"), F.coalesce(F.format_number("debit", 2), F.lit("")), F.coalesce(F.format_number("credit", 2), F.lit("")), F.format_number("balance", 2))
    header = ("Txn Date", "Value Dt", "Transaction Particulars", "Chq/Ref No.", "Withdrawal Amt (INR)", "Deposit Amt (INR)", "Closing Balance")
    return t.select(F.col("statement_id").alias("file"), F.row_number().over(Window.partitionBy("statement_id").orderBy("row_index")).alias("row"), F.array(*map(F.lit, header)).alias("header"), F.array(*cells).alias("cells"))


def raw_grids(t):
    """The raw files as cells (file_id, row from 0, col, value), and their first 100 rows as a text with the number of rows."""
    raw = raw_statement(t).withColumnRenamed("file", "file_id").withColumn("row", F.col("row") - 1)
    cells = raw.select("file_id", "row", F.posexplode("cells").alias("col", "value"))
    line = F.when(F.col("row") < 100, F.struct("row", F.concat_ws("\t", "cells").alias("line")))
    texts = raw.groupBy("file_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))["line"]).alias("text"), F.count("*").alias("n_rows"))
    return cells, texts


on_transactions("P5_classify_columns", lambda t: classify_columns(raw_statement(t)).select("file", "col", "field"),
                "SELECT DISTINCT statement_id AS file, CAST(i AS INTEGER) AS col, ['txn_date', 'value_date', 'narration', 'reference_no', 'debit_amount', 'credit_amount', 'balance_after'][i + 1] AS field FROM txn, range(7) AS r(i)")
HEADER = {"date": "Txn Date", "narration": "Transaction Particulars", "reference": "Chq/Ref No.", "debit": "Withdrawal Amt (INR)", "credit": "Deposit Amt (INR)", "balance": "Closing Balance"}
on_transactions("P3_map_row", lambda t: map_rows(raw_statement(t), HEADER).select("file", "row_index", F.col("txn_date").cast("string"), "narration", "reference_no", *(F.col(c).cast("double") for c in ("debit", "credit", "balance"))),
                "SELECT statement_id AS file, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY row_index) AS INTEGER) AS row_index, CAST(txn_date AS VARCHAR) AS txn_date, narration, reference_no, nullif(debit, 0) / 100.0 AS debit, nullif(credit, 0) / 100.0 AS credit, balance / 100.0 AS balance FROM txn")


def file_lines(t):
    """The raw statements as lines of files: three lines ahead of the header, the rows, a blank line and a total."""
    raw = raw_statement(t)
    cells = raw.select("file", F.struct((F.col("row") + 3).alias("row"), "cells").alias("at"))
    ahead = [F.array(F.concat(F.lit("Statement of S"), F.col("file"))), F.array(F.lit("")), F.array(F.lit("Branch 7"))]
    one = raw.groupBy("file").agg(F.first("header").alias("header"), F.count("*").cast("int").alias("n"))
    fixed = F.array(*(F.struct(F.lit(k).alias("row"), c.alias("cells")) for k, c in enumerate([*ahead, F.col("header")])), *(F.struct((F.col("n") + k).alias("row"), F.array(F.lit(text)).alias("cells")) for k, text in ((4, ""), (5, "Total 12"))))
    return one.select("file", F.explode(fixed).alias("at")).unionByName(cells).select("file", "at.row", F.concat_ws(";", "at.cells").alias("line"), "at.cells", F.lit(3).alias("header_row"))


on_transactions("S1_statement_rows", lambda t: scan_statement_csv(file_lines(t)).select("file", "row", F.element_at("header", 1).alias("first"), F.element_at("cells", 4).alias("reference_no")),
                "SELECT statement_id AS file, CAST(3 + row_number() OVER (PARTITION BY statement_id ORDER BY row_index) AS INTEGER) AS row, 'Txn Date' AS first, reference_no FROM txn")
on_transactions("E12_extract_preamble", lambda t: extract_preamble(file_lines(t)).select("file", F.array_join("preamble", "|").alias("preamble")), "SELECT DISTINCT statement_id AS file, 'Statement of S' || statement_id || '|Branch 7' AS preamble FROM txn")
TEMPLATES = {"six_columns": list(HEADER.values()), "other": ["Posting Day", "Text", "Sum"]}
on_transactions("P4_template_match", lambda t: match_templates(t.select("statement_id").distinct().select(F.col("statement_id").alias("file"), F.when(F.col("statement_id") % 3 == 0, F.array(*(F.lit(h.upper()) for h in HEADER.values()))).when(F.col("statement_id") % 3 == 1, F.array(*map(F.lit, ("Day, Posting", "Sum", "text")))).otherwise(F.array(F.lit("xyz"))).alias("header")), TEMPLATES).select("file", "template"),
                "SELECT DISTINCT statement_id AS file, CASE statement_id % 3 WHEN 0 THEN 'six_columns' WHEN 1 THEN 'other' END AS template FROM txn")
on_transactions("P18_fact_check", lambda t: t.select("row_id", n.fact_check(
                    F.concat(F.lit("Row "), F.col("row_id"), F.when(F.col("row_index") % 3 == 0, " moved 987654321.5").otherwise(" moved"), F.when(F.col("row_index") % 5 == 0, ", proven").otherwise("")), F.concat(F.lit("id "), F.col("row_id"))).alias("holds")),
                "SELECT row_id, row_index % 3 <> 0 AND row_index % 5 <> 0 AS holds FROM txn")
on_transactions("F18_name_consistency", lambda t: name_consistency(t.select("statement_id", F.concat(F.lit("Holder "), F.col("statement_id")).alias("holder"), F.concat(F.lit(" HOLDER "), F.when((F.col("statement_id") % 2 == 0) | (F.col("row_index") % 7 > 0), F.col("statement_id")).otherwise(0), F.lit(" ")).alias("name"))),
                "SELECT statement_id, CASE WHEN bool_and(statement_id % 2 = 0 OR row_index % 7 > 0 OR statement_id = 0) THEN 0.0::DOUBLE ELSE 1 END AS name_consistency_flag FROM txn GROUP BY 1")
