"""Institution intelligence on a ledger of transfers between banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .features import hhi
from .ranks import medians, same


def derive(transfers: DataFrame) -> DataFrame:
    """day, normal format, cross_currency, near_threshold and corridor of each transfer."""
    near = F.lit(False)
    for band in config.BANK_BANDS:
        near = near | F.col("amount").cast("double").between(config.BAND_LOWER * band, band)
    cross = F.coalesce(F.col("payment_currency") != F.col("receiving_currency"), F.lit(False))
    fmt = F.coalesce(F.nullif(F.lower(F.trim("format")), F.lit("")), F.lit("unspecified"))
    return transfers.withColumns({"day": F.to_date("ts"), "format": fmt, "cross_currency": cross, "near_threshold": near, "corridor": F.concat("payment_currency", F.lit(" -> "), "receiving_currency")})


def bank_edges(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("from_bank", "to_bank").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"), F.count_if("labelled").alias("n_labelled"))


def bank_legs(derived: DataFrame) -> DataFrame:
    """Each transfer as a leg of its sender and one of its receiver."""
    common = ["row_idx", "amount", "day", "format", "cross_currency", "near_threshold", "corridor", "labelled"]
    out = derived.select(F.col("from_bank").alias("bank"), F.col("to_bank").alias("partner"), F.col("from_account").alias("account"), F.lit("out").alias("way"), *common)
    return out.unionByName(derived.select(F.col("to_bank").alias("bank"), F.col("from_bank").alias("partner"), F.col("to_account").alias("account"), F.lit("in").alias("way"), *common))


def bank_volume(legs: DataFrame) -> DataFrame:
    sent, got = F.col("way") == "out", F.col("way") == "in"
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))).cast("double"), F.lit(0.0))
    middle = medians(legs.select("bank", F.col("amount").cast("double").alias("amount")), "amount", ("bank",)).drop("n")
    rest = legs.groupBy("bank").agg(
        money(sent).alias("sent"), money(got).alias("received"), F.count("*").alias("n"), F.count_if(sent).alias("n_sent"), F.avg(F.col("amount").cast("double")).alias("mean"),
        F.max("amount").cast("double").alias("largest"), F.count_distinct(F.when(F.col("partner") != F.col("bank"), F.col("partner"))).alias("partners"),
    )
    return same(rest, middle, ("bank",))


def top_list(legs: DataFrame, part: str, k: int = 8, by: str = "amount") -> DataFrame:
    """bank, part, n, amount, rank: the k parts of each bank with the largest amounts, or the most transfers (``by`` n)."""
    sums = legs.where(F.col(part).isNotNull()).groupBy("bank", part).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    w = Window.partitionBy("bank").orderBy(F.desc(by), part)
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def format_shares(legs: DataFrame) -> DataFrame:
    share = lambda names: F.avg(F.col("format").isin(*names).cast("int"))
    return legs.groupBy("bank").agg(share(config.WIRE_FORMATS).alias("wire_share"), share(config.HIGH_RISK_FORMATS).alias("high_risk_format_share"))


def account_hhi(legs: DataFrame) -> DataFrame:
    return hhi(legs, "bank", "account", "amount", "account_concentration")


def burst(legs: DataFrame) -> DataFrame:
    """Active days, the busiest day (the earliest of equals) and its share of all transfers."""
    days = legs.groupBy("bank", "day").count()
    dated = F.col("day").isNotNull()
    return days.groupBy("bank").agg(
        F.count("day").alias("active_days"), F.max_by("day", F.when(dated, F.struct("count", -F.unix_date("day")))).cast("string").alias("busiest_day"),
        (F.coalesce(F.max(F.when(dated, F.col("count"))), F.lit(0)) / F.sum("count")).alias("burst_velocity"),
    )


def cycle_exposure(legs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Share of a bank's legs that lie on a conserved cycle."""
    on = cycles.select(F.explode("idxs").alias("row_idx")).distinct().withColumn("_on", F.lit(1))
    return legs.join(on, "row_idx", "left").groupBy("bank").agg(F.avg(F.coalesce("_on", F.lit(0))).alias("cycle_exposure"))


def bank_cycle_index(transfers: DataFrame, cycles: DataFrame) -> DataFrame:
    """bank, n_cycles, top_risk: the cycles that a bank's transfers lie on."""
    at = cycles.select("ring", "risk", F.explode("idxs").alias("row_idx")).join(transfers.select("row_idx", F.explode(F.array_distinct(F.array("from_bank", "to_bank"))).alias("bank")), "row_idx")
    return at.select("bank", "ring", "risk").distinct().groupBy("bank").agg(F.count("*").alias("n_cycles"), F.max("risk").alias("top_risk"))


def cycles_of_bank(transfers: DataFrame, cycles: DataFrame, bank: str) -> DataFrame:
    """The cycles that a bank's transfers lie on."""
    touch = transfers.where((F.col("from_bank") == bank) | (F.col("to_bank") == bank)).select("row_idx")
    on = cycles.select("ring", F.explode("idxs").alias("row_idx")).join(touch, "row_idx", "left_semi").select("ring").distinct()
    return cycles.join(on, "ring", "left_semi")


def cycle_summary(cycles: DataFrame) -> DataFrame:
    return cycles.agg(F.count("*").alias("n"), F.max("risk").alias("top_risk"), F.sum(F.col("mean_amount") * F.col("hops")).alias("value"))


def components(derived: DataFrame, cycles: DataFrame | None = None, centrality: DataFrame | None = None) -> DataFrame:
    """The seven risk components of every bank but the placeholder of unknown ones, which is nobody's peer; what isn't given is 0.

    A bank's network centrality is its share of the largest betweenness; among fewer than four banks there is none.
    """
    legs = bank_legs(derived)
    base = legs.groupBy("bank").agg(F.avg(F.col("near_threshold").cast("int")).alias("structuring_share"), F.avg(F.col("cross_currency").cast("int")).alias("cross_currency_share"))
    for part in (format_shares(legs).drop("wire_share"), account_hhi(legs), burst(legs).select("bank", "burst_velocity")):
        base = base.join(part, "bank", "left")
    base = base.join(cycle_exposure(legs, cycles), "bank", "left") if cycles is not None else base.withColumn("cycle_exposure", F.lit(0.0))
    if centrality is None:
        base = base.withColumn("network_centrality", F.lit(0.0))
    else:
        top = centrality.agg(F.max("betweenness").alias("_top")).crossJoin(F.broadcast(legs.agg(F.count_distinct("bank").alias("_banks"))))
        share = F.when((F.col("_banks") >= 4) & (F.col("_top") > 0), F.col("betweenness") / F.col("_top"))
        base = base.join(centrality.crossJoin(F.broadcast(top)).select(F.col("node").alias("bank"), share.alias("network_centrality")), "bank", "left")  # one row
    return base.where(F.col("bank") != config.UNATTRIBUTED).select("bank", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in config.BANK_WEIGHTS))


def risk_components(values: DataFrame) -> DataFrame:
    """bank, component, value, severity, points: against fixed references and against the peers' spread (three banks or more)."""
    long = values.select("bank", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("value"), F.lit(w).alias("weight"), F.lit(config.BANK_REFERENCES[c]).alias("reference")) for c, w in config.BANK_WEIGHTS.items()))).alias("c")).select("bank", "c.*")
    mid = medians(long, "value", ("component",), "m").withColumnRenamed("n", "banks")
    near = long.join(F.broadcast(mid), "component").withColumn("d", F.abs(F.col("value") - F.col("m")))  # a row for each component
    middle = medians(near, "d", ("component",), "_d").select("component", (1.4826 * F.col("_d")).alias("mad"))
    spread = near.groupBy("component").agg(F.avg("d").alias("dev")).join(middle, "component")
    width = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("dev"))
    z = F.when((F.col("banks") >= 3) & (width > 0), F.greatest(F.lit(0.0), F.least((F.col("value") - F.col("m")) / width, F.lit(config.ROBUST_Z))) / config.ROBUST_Z).otherwise(0.0)
    severity = F.greatest(F.least(F.col("value") / F.col("reference"), F.lit(1.0)), z)
    return near.join(F.broadcast(spread), "component").select("bank", "component", "value", severity.alias("severity"), (100 * F.col("weight") * severity).alias("points"))


def risk_tier(score: Column) -> Column:
    return F.when(score >= config.BANK_HIGH, "HIGH").when(score >= config.BANK_MEDIUM, "MEDIUM").otherwise("LOW")


def bank_risk(parts: DataFrame) -> DataFrame:
    """bank, risk_score, driver, tier."""
    score = F.least(F.sum("points"), F.lit(100.0))
    return parts.groupBy("bank").agg(score.alias("risk_score"), F.max_by("component", F.struct("points", "component")).alias("driver")).withColumn("tier", risk_tier(F.col("risk_score")))


def top_profiles(risk: DataFrame, cap: int = 500) -> DataFrame:
    return risk.where(F.col("bank") != config.UNATTRIBUTED).orderBy(F.desc("risk_score"), "bank").limit(cap)


def ledger_summary(derived: DataFrame) -> DataFrame:
    banks = derived.select(F.explode(F.array("from_bank", "to_bank")).alias("bank")).agg(F.count_distinct("bank").alias("banks"))
    accounts = derived.select(F.explode(F.array("from_account", "to_account")).alias("a")).agg(F.count_distinct("a").alias("accounts"))
    rest = derived.agg(
        F.count("*").alias("transfers"), F.sum("amount").cast("double").alias("value"), F.count_distinct("from_bank", "to_bank").alias("edges"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"),
        F.array_join(F.array_sort(F.collect_set("payment_currency")), ",").alias("currencies"), F.count_distinct("format").alias("formats"), F.avg(F.col("cross_currency").cast("int")).alias("cross_currency_share"),
    )
    return rest.crossJoin(F.broadcast(banks)).crossJoin(F.broadcast(accounts))  # one row each


def label_evaluation(transfers: DataFrame, risk: DataFrame) -> DataFrame:
    """Banks of the high tier against banks with labelled transfers."""
    labelled = transfers.where("labelled").select(F.explode(F.array("from_bank", "to_bank")).alias("bank")).distinct()
    high = risk.where("tier = 'HIGH'").select("bank")
    sets = {"caught": high.intersect(labelled), "missed": labelled.subtract(high), "unlabelled": high.subtract(labelled)}
    out = None
    for name, df in sets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def tier_rollup(risk: DataFrame) -> DataFrame:
    return risk.groupBy("tier").agg(F.count("*").alias("n"), F.avg("risk_score").alias("mean_risk"), F.max_by("bank", F.struct("risk_score", "bank")).alias("top"))


def bank_list(risk: DataFrame, search: str = "", tier: str | None = None, order: str = "risk_score", descending: bool = True, offset: int = 0, size: int = 50) -> DataFrame:
    rows = risk.where(F.lower("bank").contains(search.lower()))
    rows = rows.where(F.col("tier") == tier) if tier else rows
    return rows.orderBy(F.desc(order) if descending else F.asc(order), "bank").offset(offset).limit(size)


def bank_neighbourhood(edges: DataFrame, bank: str, k: int = 40) -> DataFrame:
    touch = edges.where(((F.col("from_bank") == bank) | (F.col("to_bank") == bank)) & (F.col("from_bank") != config.UNATTRIBUTED) & (F.col("to_bank") != config.UNATTRIBUTED))
    return touch.withColumn("way", F.when(F.col("from_bank") == bank, "out").otherwise("in")).orderBy(F.desc("amount"), "from_bank", "to_bank").limit(k)


def bank_graph(edges: DataFrame, top: int = 8) -> DataFrame:
    """Edges between the banks that move most."""
    moved = edges.select(F.explode(F.array("from_bank", "to_bank")).alias("bank"), "amount").groupBy("bank").agg(F.sum("amount").alias("m")).orderBy(F.desc("m"), "bank").limit(top).select("bank")
    return edges.join(moved, F.col("from_bank") == F.col("bank"), "left_semi").join(moved, F.col("to_bank") == F.col("bank"), "left_semi")


def statement_ledger(txns: DataFrame, subject: Column, counterparty_bank: Column) -> DataFrame:
    """Statement rows with an amount as transfers; accounts are keyed by bank and statement."""
    debit = F.coalesce("debit", F.lit(0)) > 0
    amount = F.when(debit, F.col("debit")).otherwise(F.col("credit"))
    me = F.concat(subject, F.lit(":stmt"), F.col("statement_id"))
    other = F.when(counterparty_bank != config.UNATTRIBUTED, F.concat(counterparty_bank, F.lit(":cp"), F.col("counterparty")))
    rows = txns.withColumns({"amount": amount, "_s": subject, "_c": counterparty_bank, "_me": me, "_other": other}).where("amount > 0")
    flip = lambda a, b: F.when(debit, F.col(a)).otherwise(F.col(b))
    return rows.select("statement_id", "row_id", "row_index", "txn_date", flip("_s", "_c").alias("from_bank"), flip("_me", "_other").alias("from_account"), flip("_c", "_s").alias("to_bank"), flip("_other", "_me").alias("to_account"), "amount")


def dedup_mirrored(ledger: DataFrame) -> DataFrame:
    """Without later rows equal in accounts, amount and day; rows lacking an account stay, each in a group of its own."""
    known = F.col("from_account").isNotNull() & F.col("to_account").isNotNull()
    w = Window.partitionBy("from_account", "to_account", "amount", "txn_date", F.when(~known, F.col("row_id"))).orderBy("statement_id", "row_index")
    return ledger.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def coverage(ledger: DataFrame) -> DataFrame:
    named = (F.col("from_bank") != config.UNATTRIBUTED) & (F.col("to_bank") != config.UNATTRIBUTED)
    return ledger.groupBy("statement_id").agg(F.count("*").alias("n"), F.avg(named.cast("int")).alias("attribution_rate"))


def coverage_summary(rows: DataFrame, kept: int | None = None) -> DataFrame:
    """How far a corpus of statements says who is paid, in one row.

    Args:
        rows: statement_id, subject (its bank), counterparty_bank and signal (what named it, null for nothing) of each transaction
            with an amount. Statements of an unknown bank are skipped.
        kept: transfers left after equal ones were dropped, if they were.
    Returns:
        statements, skipped, used, attributed, unattributed, attribution_rate (four decimals), transfer_rows, mirrored, signals
        (``name:count``, the most frequent first) and direct_banks, whose own statements are among them.
    """
    known, named = F.col("subject") != config.UNATTRIBUTED, F.col("counterparty_bank") != config.UNATTRIBUTED
    each = rows.groupBy("statement_id").agg(F.bool_and(known).alias("_known")).agg(F.count("*").alias("statements"), F.count_if(~F.col("_known")).alias("skipped"))
    used = rows.where(known)
    total = used.agg(F.count("*").alias("used"), F.count_if(named).alias("attributed"), F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("direct_banks"))
    counts = used.where(named).groupBy("signal").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "signal", "n")))
    signals = counts.agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["signal"], x["n"])), ",").alias("signals"))  # a row for each signal
    both = each.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(signals))  # one row each
    rate = F.when(F.col("used") > 0, F.round(F.col("attributed") / F.col("used"), 4)).otherwise(0.0)
    left = F.lit(kept).cast("long") if kept is not None else F.col("used")
    return both.select("statements", "skipped", "used", "attributed", (F.col("used") - F.col("attributed")).alias("unattributed"), rate.alias("attribution_rate"), left.alias("transfer_rows"), (F.col("used") - left).alias("mirrored"), "signals", "direct_banks")


def corpus_fingerprint(statements: DataFrame) -> DataFrame:
    """One digest of id, status, rows and bank of all statements; ids come in order from bounded digests of ranges."""
    line = F.concat_ws(":", "statement_id", "status", "n", "bank")
    part = statements.groupBy(F.floor(F.col("statement_id") / 1000).alias("_p")).agg(F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("statement_id", line.alias("l")))), lambda x: x["l"])), 256).alias("d"))
    return part.agg(F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("_p", "d"))), lambda x: x["d"])), 256).alias("fingerprint"))
