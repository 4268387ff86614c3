"""Canonical tables from the synthetic ones: transactions, transfers and mirrored cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
CODES = ("SBIN", "HDFC", "ICIC", "UTIB", "PUNB", "KKBK", "YESB", "CNRB")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per user: purchases and signups are credits, clicks and views debits, errors neither."""
    e = read(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100000 + 0.5)
    amount = (cents.cast("decimal(16,0)") / 100).cast(MONEY)
    k = F.get_json_object("props", "$.k")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("row_index") % 8 + 1).cast("int"))
    tail = F.concat(F.lit("payee"), F.col("counterparty"))
    L = F.lit
    texts = [
        F.concat(L("UPI/"), F.col("row_id"), L("/"), tail, L("@okaxis")),
        F.concat(L("NEFT/DR/REF"), F.col("row_id"), L("/"), tail, L(" LTD/"), code, L("0001234")),
        F.concat(L("IMPS-"), F.col("row_id"), L("-"), tail, L("-"), code),
        F.concat(L("RTGS/"), code, L("R52024/"), tail),
        L("ATM CASH WDL 1234"),
        F.concat(L("POS 4321 "), tail, L(" STORES")),
        F.concat(L("ECOM:"), tail, L("/refund")),
        F.concat(L("salary from hdfc "), tail),
        F.concat(L("UPI/DR/4107718"), F.col("row_id"), L("/"), tail, L(" HOTEL/UTIB/x")),
        L("SWEEP TRANSFER TO 1234"),
        F.concat(L("FD PREMAT 1234 "), tail),
        F.concat(L("INSTALLMENT AMOUNT FOR RD "), tail),
        F.concat(L("POS REFUND "), tail),
        L("SMS CHARGES JAN 123412341234 card 1234123412341234"),
        L("ATM CARD ANNUAL FEE"),
        F.concat(L("CASH DEPOSIT "), tail, L(" ABCDE1234F 9876543210")),
        L("INT.PD:01-01 TO 31-03"),
        L("PCD/1234/WWWpayeeshopCOM"),
        F.concat(L("ATM/SN1234/"), tail),
        F.concat(L("POS-4321/"), tail),
        F.concat(L("pay to "), tail, L("@ybl")),
        L("12/34"),
        L("ECOM:12:payee shop Gurgaon HRIN"),
        F.concat(L("CHQ 123456 HDFC0012 SBIN20240201 union bank of india "), tail),
    ]
    narration = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        narration = F.when(F.col("row_index") % len(texts) == i, text).otherwise(narration)
    order = Window.partitionBy("statement_id").orderBy("ts", "row_index").rowsBetween(Window.unboundedPreceding, 0)
    flow = F.coalesce("credit", F.lit(0).cast(MONEY)) - F.coalesce("debit", F.lit(0).cast(MONEY))
    return (
        e.select(
            F.col("user_id").alias("statement_id"), F.col("event_id").alias("row_index"), F.col("event_id").cast("string").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"),
            F.to_date("ts").alias("txn_date"), F.when(F.col("event_type").isin("click", "view"), amount).alias("debit"), F.when(F.col("event_type").isin("purchase", "signup"), amount).alias("credit"), k.alias("counterparty"),
        )
        .withColumn("narration", narration)
        .withColumn("reference_no", F.concat(F.lit("REF"), F.lpad("row_id", 8, "0")))
        .withColumn("balance", (F.lit(1000000).cast(MONEY) + F.sum(flow).over(order) + F.when(F.col("row_index") % 97 == 0, 1).otherwise(0)).cast(MONEY))
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a transfer from its user to its counterparty, between twelve banks."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    amount = (F.floor(F.col("value") * 100000 + 0.5).cast("decimal(16,0)") / 100).cast(MONEY)
    currency = F.element_at(F.array(*map(F.lit, ("INR", "USD", "EUR"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("row_idx"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("BANK_"), F.col("user_id") % 12).alias("from_bank"), F.concat(F.lit("U"), F.col("user_id")).alias("from_account"),
        F.concat(F.lit("BANK_"), k % 12).alias("to_bank"), F.concat(F.lit("U"), k).alias("to_account"),
        amount.alias("amount"), currency.alias("payment_currency"), F.when(F.col("event_id") % 10 == 0, F.lit("USD")).otherwise(currency).alias("receiving_currency"),
        F.when(F.col("event_type") == "signup", F.lit("wire")).when(F.col("event_type") == "error", F.lit("cash")).otherwise(F.col("event_type")).alias("format"),
        (F.col("event_id") % 50 == 0).alias("labelled"),
    )


def bulk_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a transfer from its customer's national bank to its supplier's."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.concat(F.lit("N"), F.col("c_nationkey")).alias("from_bank"), F.concat(F.lit("C"), F.col("c_custkey")).alias("from_account"),
            F.concat(F.lit("N"), F.col("s_nationkey")).alias("to_bank"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("to_account"),
            (F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("decimal(16,0)") / 100).cast(MONEY).alias("amount"),
            F.lit("INR").alias("payment_currency"), F.lit("INR").alias("receiving_currency"), F.col("o_orderpriority").alias("format"), (F.col("l_orderkey") % 50 == 0).alias("labelled"),
        )
    )


def mirrored_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the two legs of a payment around rings of three customers; some lack a leg, some have one too many."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = F.col("o_custkey")
    base = c - c % 3
    ref = F.concat(F.lit("ORD"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    amount = (1000 + 10 * (F.col("o_orderkey") % 10)).cast(MONEY)
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("o_orderkey") % 200).cast("int"))
    common = [(F.floor(c / 3) % 20).alias("case_id"), ref.alias("reference_no"), day.alias("txn_date")]
    none = F.lit(None).cast(MONEY)

    def leg(statement, tag: str, debit, credit):
        return o.select(*common, statement.alias("statement_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(tag)).alias("row_id"), debit.alias("debit"), credit.alias("credit"), F.col("o_orderkey").alias("_k"), F.concat(F.lit("ACCT"), c).alias("counterparty"))

    out = leg(c, "-D", amount, none)
    back = leg(base + (c + 1) % 3, "-C", none, amount).where(F.col("_k") % 5 != 0)
    more = leg(base + (c + 2) % 3, "-X", none, amount).where(F.col("_k") % 7 == 0)
    return out.unionByName(back).unionByName(more).drop("_k")


#: The same tables for DuckDB; amounts in hundredths.
SQL_TXN = """
txn0 AS (
  SELECT user_id AS statement_id, event_id AS row_index, CAST(event_id AS VARCHAR) AS row_id, ts, CAST(ts AS DATE) AS txn_date,
    CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value * 100000 + 0.5) AS BIGINT) END AS debit,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(floor(value * 100000 + 0.5) AS BIGINT) END AS credit,
    json_extract_string(props, '$.k') AS counterparty
  FROM events
), txn AS (
  SELECT *,
    CASE row_index % 24
      WHEN 0 THEN 'UPI/' || row_id || '/payee' || counterparty || '@okaxis'
      WHEN 1 THEN 'NEFT/DR/REF' || row_id || '/payee' || counterparty || ' LTD/' || ['SBIN','HDFC','ICIC','UTIB','PUNB','KKBK','YESB','CNRB'][row_index % 8 + 1] || '0001234'
      WHEN 2 THEN 'IMPS-' || row_id || '-payee' || counterparty || '-' || ['SBIN','HDFC','ICIC','UTIB','PUNB','KKBK','YESB','CNRB'][row_index % 8 + 1]
      WHEN 3 THEN 'RTGS/' || ['SBIN','HDFC','ICIC','UTIB','PUNB','KKBK','YESB','CNRB'][row_index % 8 + 1] || 'R52024/payee' || counterparty
      WHEN 4 THEN 'ATM CASH WDL 1234'
      WHEN 5 THEN 'POS 4321 payee' || counterparty || ' STORES'
      WHEN 6 THEN 'ECOM:payee' || counterparty || '/refund'
      WHEN 7 THEN 'salary from hdfc payee' || counterparty
      WHEN 8 THEN 'UPI/DR/4107718' || row_id || '/payee' || counterparty || ' HOTEL/UTIB/x'
      WHEN 9 THEN 'SWEEP TRANSFER TO 1234'
      WHEN 10 THEN 'FD PREMAT 1234 payee' || counterparty
      WHEN 11 THEN 'INSTALLMENT AMOUNT FOR RD payee' || counterparty
      WHEN 12 THEN 'POS REFUND payee' || counterparty
      WHEN 13 THEN 'SMS CHARGES JAN 123412341234 card 1234123412341234'
      WHEN 14 THEN 'ATM CARD ANNUAL FEE'
      WHEN 15 THEN 'CASH DEPOSIT payee' || counterparty || ' ABCDE1234F 9876543210'
      WHEN 16 THEN 'INT.PD:01-01 TO 31-03'
      WHEN 17 THEN 'PCD/1234/WWWpayeeshopCOM'
      WHEN 18 THEN 'ATM/SN1234/payee' || counterparty
      WHEN 19 THEN 'POS-4321/payee' || counterparty
      WHEN 20 THEN 'pay to payee' || counterparty || '@ybl'
      WHEN 21 THEN '12/34'
      WHEN 22 THEN 'ECOM:12:payee shop Gurgaon HRIN'
      ELSE 'CHQ 123456 HDFC0012 SBIN20240201 union bank of india payee' || counterparty END AS narration,
    'REF' || lpad(row_id, 8, '0') AS reference_no,
    100000000 + CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY statement_id ORDER BY ts, row_index ROWS UNBOUNDED PRECEDING) AS BIGINT)
      + CASE WHEN row_index % 97 = 0 THEN 100 ELSE 0 END AS balance
  FROM txn0
)"""
SQL_TRF = """
trf AS (
  SELECT event_id AS row_idx, ts, 'BANK_' || (user_id % 12) AS from_bank, 'U' || user_id AS from_account, 'BANK_' || (k % 12) AS to_bank, 'U' || k AS to_account,
    CAST(floor(value * 100000 + 0.5) AS BIGINT) AS amount, ['INR','USD','EUR'][event_id % 3 + 1] AS payment_currency,
    CASE WHEN event_id % 10 = 0 THEN 'USD' ELSE ['INR','USD','EUR'][event_id % 3 + 1] END AS receiving_currency,
    CASE event_type WHEN 'signup' THEN 'wire' WHEN 'error' THEN 'cash' ELSE event_type END AS format, event_id % 50 = 0 AS labelled
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
SQL_BULK = """
trf AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_idx, l_shipdate AS ts, 'N' || c_nationkey AS from_bank, 'C' || c_custkey AS from_account, 'N' || s_nationkey AS to_bank,
    'S' || s_suppkey AS to_account, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS amount, 'INR' AS payment_currency, 'INR' AS receiving_currency, o_orderpriority AS format,
    l_orderkey % 50 = 0 AS labelled
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""
SQL_CASE = """
legs AS (
  SELECT CAST(o_custkey // 3 % 20 AS BIGINT) AS case_id, 'ORD' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS reference_no, DATE '1995-01-01' + CAST(o_orderkey % 200 AS INTEGER) AS txn_date,
    CASE tag WHEN '-D' THEN c WHEN '-C' THEN c - c % 3 + (c + 1) % 3 ELSE c - c % 3 + (c + 2) % 3 END AS statement_id, o_orderkey || tag AS row_id,
    CASE WHEN tag = '-D' THEN 100000 + 1000 * (o_orderkey % 10) END AS debit, CASE WHEN tag <> '-D' THEN 100000 + 1000 * (o_orderkey % 10) END AS credit,
    'ACCT' || c AS counterparty
  FROM (SELECT o_orderkey, o_custkey, o_custkey AS c FROM orders) CROSS JOIN (VALUES ('-D'), ('-C'), ('-X')) t(tag)
  WHERE tag = '-D' OR tag = '-C' AND o_orderkey % 5 <> 0 OR tag = '-X' AND o_orderkey % 7 = 0
)"""
