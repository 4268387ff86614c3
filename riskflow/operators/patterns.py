"""Suspicious patterns of accounts as ordered hops, and the reasons that explain a score."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.narration import infer_channel
from ..sources.shared import written
from .features import ID, in_order, in_pieces
from .ranks import cut_at_gaps

PATTERN = ("statement_id", "kind", "pattern_id", "risk", "total", "rule", "row_ids")


def severity(risk: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(config.SEVERITIES):
        out = F.when(risk >= least, name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    return F.when(name == "CRITICAL", 4).when(name == "HIGH", 3).when(name == "MEDIUM", 2).otherwise(1)


def points_severity(points: Column) -> Column:
    return F.when(points >= 25, "CRITICAL").when(points >= 20, "HIGH").when(points >= 15, "MEDIUM").otherwise("LOW")


def first_band(amount: Column) -> Column:
    """The first limit that an amount lies just below."""
    out = F.lit(None).cast("long")
    for band in reversed(config.BANDS):
        out = F.when(amount.cast("double").between(config.BAND_LOWER * band, band), F.lit(band).cast("long")).otherwise(out)
    return out


def amounts(txns: DataFrame) -> DataFrame:
    amount = F.greatest(F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))).cast("decimal(18,2)")
    return txns.withColumn("amount", amount).where("amount > 0")


def cycle_patterns(cycles: DataFrame, txns: DataFrame) -> DataFrame:
    at = cycles.select(ID, "counterparty", "risk", "row_ids", F.explode("row_ids").alias("row_id")).join(amounts(txns).select("row_id", "amount"), "row_id")
    total = at.groupBy(ID, "counterparty").agg(F.sum("amount").cast("double").alias("total"), F.first("risk").alias("risk"), F.first("row_ids").alias("row_ids"))
    return total.select(ID, F.lit("cycle").alias("kind"), F.concat(F.lit("cycle:"), "counterparty").alias("pattern_id"), "risk", "total", F.lit("R5_circular_flow_detected").alias("rule"), "row_ids")


def cycle_paths(cycles: DataFrame) -> DataFrame:
    """statement_id, pattern_id, node_path: a cycle's nodes from the account and back to it, with marks of the account and of the return."""
    node = lambda name, subject, back: F.struct(name.alias("id"), F.lit(subject).alias("is_subject"), F.lit(back).alias("is_return"))
    me = F.concat(F.lit("ACCT_"), F.col(ID))
    path = F.array(node(me, True, False), node(F.col("counterparty"), False, False), node(me, True, True))
    return cycles.where("not dense").select(ID, F.concat(F.lit("cycle:"), "counterparty").alias("pattern_id"), path.alias("node_path"))


class Earliest:
    """Debits by amount, with the earliest unused one of any range of amounts: the least place over a range of a binary tree."""

    def __init__(self, amounts: list[float]):
        self.order = sorted(range(len(amounts)), key=amounts.__getitem__)
        self.amounts = [amounts[k] for k in self.order]
        self.size = 1 << max(0, len(amounts) - 1).bit_length()
        self.none = len(amounts)
        self.tree = [self.none] * self.size + self.order + [self.none] * (self.size - len(amounts))
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        self.at = {place: k for k, place in enumerate(self.order)}

    def take(self, credit: float, match: float) -> int | None:
        """The place of the earliest debit whose amount is near enough; it is used from then on."""
        low = bisect.bisect_left(self.amounts, True, key=lambda d: d / credit >= match)
        high = bisect.bisect_left(self.amounts, True, key=lambda d: d > credit and credit / d < match)
        best, a, b = self.none, low + self.size, high + self.size
        while a < b:
            if a & 1:
                best = min(best, self.tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = min(best, self.tree[b])
            a, b = a >> 1, b >> 1
        if best == self.none:
            return None
        k = self.at[best] + self.size
        self.tree[k] = self.none
        while k > 1:
            k >>= 1
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        return best


def layering_matches(txns: DataFrame, hold_days: int = config.LAYERING_HOLD_DAYS, match: float = config.LAYERING_MATCH) -> DataFrame:
    """Credits in order, each with the first unused debit within ``hold_days`` whose amount is near enough.

    Accounts are cut at silences of more than ``hold_days``; the pieces are read in order, and only the days that credits can
    still reach are held. A day's credits look their debits up by amount, so a busy account costs a logarithm for each row.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, days = None, deque()  # of each day: its number, credits and unused debits in order

        def settle(account: int) -> list[tuple]:
            """The pairs of the first day held."""
            day, credits, _ = days[0]
            debits = [(k, d[0], *x) for k, d in enumerate(days) if d[0] <= day + hold_days for x in d[2]] if credits else []
            out = []
            if debits:
                tree, used = Earliest([d[3] for d in debits]), [set() for _ in days]
                for row_id, credit in credits:
                    place = tree.take(credit, match)
                    if place is not None:
                        k, other, debit_row, debit = debits[place]
                        used[k].add(debit_row)
                        out.append((account, row_id, debit_row, min(credit, debit) / max(credit, debit), float(other - day), max(credit, debit), credit + debit))
                for d, gone in zip(days, used, strict=True):
                    if gone:
                        d[2][:] = [x for x in d[2] if x[0] not in gone]
            days.popleft()
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [ID, "credit_row", "debit_row", "near", "held_days", "largest", "total"])

        for batch in batches:
            found: list[tuple] = []
            for account, piece, day, row_id, debit, credit in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                while days and ((account, piece) != key or days[0][0] + hold_days < day):
                    found += settle(key[0])
                key = account, piece
                if not days or days[-1][0] != day:
                    days.append((day, [], []))
                if credit > 0:
                    days[-1][1].append((row_id, credit))
                if debit > 0:
                    days[-1][2].append((row_id, debit))
            if found:
                yield batch_of(found)
        found = []
        while days:
            found += settle(key[0])
        if found:
            yield batch_of(found)

    money = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = txns.where("txn_date is not null and (debit > 0 or credit > 0)").select(ID, "row_id", "row_index", F.unix_date("txn_date").alias("day"), money("debit"), money("credit"))
    schema = f"{ID} long, credit_row string, debit_row string, near double, held_days double, largest double, total double"
    return in_pieces(cut_at_gaps(rows, "day", hold_days, ["row_index"], (ID,)), ["day", "row_index"], ["day", "row_id", "debit", "credit"], pair, schema)


def layering_patterns(txns: DataFrame, k: int = config.LAYERING_CHAINS) -> DataFrame:
    """The k chains of each account with the highest risk."""
    base = 0.5 * F.col("near") + 0.5 * (1 - F.col("held_days") / config.LAYERING_HOLD_DAYS)
    risk = base * (0.6 + 0.4 * F.least(F.col("largest") / 200_000, F.lit(1.0)))
    w = Window.partitionBy(ID).orderBy(F.desc("risk"), F.desc("total"), "credit_row")
    best = layering_matches(txns).withColumn("risk", risk).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.select(ID, F.lit("layering").alias("kind"), F.concat(F.lit("layering:"), "credit_row").alias("pattern_id"), "risk", "total", F.lit("R1_low_retention_high_turnover").alias("rule"), F.array("credit_row", "debit_row").alias("row_ids"))


def structuring_patterns(txns: DataFrame, rows: int = config.LEAST_PATTERN_ROWS) -> DataFrame:
    """Amounts of an account just below one limit; their mean is taken in the order of rows, so that a risk at a limit doesn't depend on how they are dealt."""
    near = amounts(txns).withColumn("band", first_band(F.col("amount"))).where("band is not null")
    low = config.BAND_LOWER
    share = in_order("row_index", "row_id", F.col("amount").cast("double") / F.col("band"))
    closeness = (F.aggregate("shares", F.lit(0.0), lambda a, x: a + x) / F.col("n") - low) / round(1 - low, 9)
    risk = 0.5 * F.least(F.col("n") / 5, F.lit(1.0)) + 0.5 * F.greatest(F.lit(0.0), F.least(closeness, F.lit(1.0)))
    grouped = near.groupBy(ID, "band").agg(F.count("*").alias("n"), share.alias("shares"), F.sum("amount").cast("double").alias("total"), F.array_sort(F.collect_list("row_id")).alias("row_ids")).where(F.col("n") >= rows)
    grouped = grouped.withColumn("risk", risk)
    return grouped.select(ID, F.lit("structuring").alias("kind"), F.concat(F.lit("structuring:"), F.col("band")).alias("pattern_id"), "risk", "total", F.lit("R3_structuring_near_threshold").alias("rule"), "row_ids")


def dormancy_patterns(txns: DataFrame, gap: int = config.DORMANCY_GAP_DAYS, rows: int = config.BURST_ROWS, days: int = config.BURST_DAYS) -> DataFrame:
    """Silence of more than ``gap`` days, then at least ``rows`` rows within ``days``; the scan goes on behind the row that follows a burst.

    Accounts are cut at their silences. A piece's first row begins a burst, which may reach into as many later pieces as fit into
    ``days``; so rows are handed to few pieces, and whatever goes by the account's order is done on its pieces alone, of which
    there are no more than its days allow.
    """
    dated = amounts(txns).where("txn_date is not null").select(ID, "row_id", "row_index", F.unix_date("txn_date").alias("day"), "amount")
    cut = written(cut_at_gaps(dated, "day", gap, ["row_index"], (ID,)), "silences")
    w = Window.partitionBy(ID).orderBy("piece")
    pieces = cut.groupBy(ID, "piece").agg(F.count("*").alias("size"), F.max("day").alias("last"))
    begins = F.array_compact(F.array("piece", *(F.lag("piece", k).over(w) for k in range(1, days // (gap + 1) + 1))))
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = written(pieces.select(ID, "piece", begins.alias("begins"), before.alias("place"), (F.col("piece") - F.lag("last").over(w)).alias("silent")), "pieces")
    handed = cut.join(pieces.select(ID, "piece", "begins"), [ID, "piece"]).withColumn("begin", F.explode("begins")).where(F.col("day") <= F.col("begin") + days)
    bursts = handed.groupBy(ID, "begin").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.array_sort(F.collect_list(F.struct("day", "row_index", "row_id")))["row_id"].alias("row_ids"))
    starts = pieces.where("silent is not null").select(ID, F.col("piece").alias("begin"), "place", "silent")
    found = bursts.where(F.col("n") >= rows).join(starts, [ID, "begin"])
    free = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<int>").alias("kept"))
    scan = lambda s, x: F.when(x["place"] > s["end"], F.struct((x["place"] + x["n"]).alias("end"), F.concat(s["kept"], F.array(x["begin"])).alias("kept"))).otherwise(s)
    kept = found.groupBy(ID).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("place", "n", "begin"))), free, scan)["kept"].alias("kept")).select(ID, F.explode("kept").alias("begin"))
    risk = 0.5 * F.least(F.col("silent") / 90, F.lit(1.0)) + 0.5 * F.least(F.col("n") / 6, F.lit(1.0))
    return found.join(kept, [ID, "begin"]).select(ID, F.lit("dormancy").alias("kind"), F.concat(F.lit("dormancy:"), F.col("row_ids")[0]).alias("pattern_id"), risk.alias("risk"), "total", F.lit("R2_dormancy_then_burst").alias("rule"), "row_ids")


def build_patterns(parts: list[DataFrame], fired: DataFrame, k: int = config.PATTERNS) -> DataFrame:
    """The k gravest patterns of each account, those below the least risk only if their rule fired."""
    rows = parts[0].select(*PATTERN)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*PATTERN))
    hit = fired.select(ID, F.explode(F.split("fired", ",")).alias("rule"), F.lit(True).alias("_fired")).where("rule <> ''")
    kept = rows.join(hit, [ID, "rule"], "left").where((F.col("risk") >= config.LEAST_PATTERN_RISK) | F.col("_fired")).drop("_fired")
    w = Window.partitionBy(ID).orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("risk"), F.desc("total"), "pattern_id")
    return kept.withColumn("severity", severity(F.col("risk"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hops(patterns: DataFrame, txns: DataFrame) -> DataFrame:
    """The rows of each pattern in order: reference, day, from and to, direction, amount, channel, narration, hours since the hop before, rapid and band marks, hop risk and severity."""
    at = patterns.select(ID, "pattern_id", "risk", F.explode("row_ids").alias("row_id")).join(amounts(txns).select("row_id", "ts", "txn_date", "debit", "counterparty", "amount", "reference_no", "narration"), "row_id")
    w = Window.partitionBy(ID, "pattern_id").orderBy("txn_date", "row_id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3.6e9
    me, other, out = F.concat(F.lit("ACCT_"), F.col(ID)), F.coalesce("counterparty", F.lit("UNKNOWN")), F.coalesce("debit", F.lit(0)) > 0
    band = first_band(F.col("amount"))
    banded = band.isNotNull()
    rapid = F.coalesce(F.col("gap_hours") <= config.RAPID_HOURS, F.lit(False))
    risk = F.least(F.lit(1.0), F.col("risk") + 0.10 * banded.cast("int") + 0.05 * F.col("rapid").cast("int"))
    return (
        at.withColumns({"hop": F.row_number().over(w), "gap_hours": gap}).withColumn("rapid", rapid)
        .select(ID, "pattern_id", "hop", "row_id", F.coalesce("reference_no", "row_id").alias("txn_id"), F.col("txn_date").cast("string").alias("day"), F.when(out, me).otherwise(other).alias("from_node"), F.when(out, other).otherwise(me).alias("to_node"), F.when(out, "debit").otherwise("credit").alias("direction"), F.col("amount").cast("double").alias("amount"), infer_channel(F.col("narration")).alias("channel"), F.coalesce("narration", F.lit("")).alias("narration"), "gap_hours", "rapid", banded.alias("banded"), band.alias("band"), risk.alias("hop_risk"))
        .withColumn("severity", severity(F.col("hop_risk")))
    )


def finalize(patterns: DataFrame, txns: DataFrame) -> DataFrame:
    """Totals, span, row ids in order and sorted nodes of each pattern."""
    at = patterns.select(ID, "pattern_id", F.explode("row_ids").alias("row_id")).join(amounts(txns).select("row_id", "txn_date", "amount", "counterparty"), "row_id")
    nodes = F.array_sort(F.array_union(F.collect_set(F.coalesce("counterparty", F.lit("UNKNOWN"))), F.array(F.concat(F.lit("ACCT_"), F.first(ID)))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("txn_date", "row_id"))), lambda x: x["row_id"])
    return at.groupBy(ID, "pattern_id").agg(ordered.alias("row_ids"), nodes.alias("node_ids"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.datediff(F.max("txn_date"), F.min("txn_date")).cast("double").alias("span_days"), F.min("txn_date").cast("string").alias("start"), F.max("txn_date").cast("string").alias("end"))


def peak_velocity_rows(txns: DataFrame) -> DataFrame:
    """The rows of each account's densest 24 hours, the first of equals."""
    at = txns.select(ID, "row_id", "row_index", F.unix_micros("ts").alias("at"))
    w = Window.partitionBy(ID).orderBy("at").rangeBetween(-86_400_000_000, 0)
    peak = at.withColumn("n", F.count("*").over(w)).groupBy(ID).agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("peak"))
    return at.join(peak, ID).where(F.col("at").between(F.col("peak") - 86_400_000_000, F.col("peak"))).select(ID, "row_id")


def coverage(txns: DataFrame, patterns: DataFrame, fired: DataFrame, n_features: int) -> DataFrame:
    """What was looked at: rows, counterparties, patterns, rules evaluated and triggered, features."""
    seen = txns.groupBy(ID).agg(F.count("*").alias("examined"), F.count_distinct("counterparty").alias("counterparties"))
    found = patterns.groupBy(ID).agg(F.count("*").alias("patterns"))
    rules = fired.select(ID, F.size(F.filter(F.split("fired", ","), lambda x: x != "")).cast("long").alias("rules_triggered"))
    both = seen.join(found, ID, "left").join(rules, ID, "left").fillna(0, ["patterns", "rules_triggered"])
    return both.withColumns({"rules_evaluated": F.lit(len(config.RULES)).cast("long"), "features": F.lit(n_features).cast("long")})
