"""Transaction graphs: star edges and cycles, conserved circular flows, centrality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..sources.shared import written
from .features import in_order
from .ranks import order_statistics, same

W_CONSERVE, W_VELOCITY, W_AGAIN, W_HOPS = config.CYCLE_WEIGHTS


def star_edges(txns: DataFrame) -> DataFrame:
    """statement_id, src, dst, amount, row_id, txn_date: debits go out to the counterparty, credits come in."""
    me, other = F.concat(F.lit("ACCT_"), F.col("statement_id")), F.coalesce("counterparty", F.concat(F.lit("CPTY_"), F.col("row_id")))
    cols = ["row_id", "txn_date"]
    out = txns.where("debit > 0").select("statement_id", me.alias("src"), other.alias("dst"), F.col("debit").alias("amount"), *cols)
    return out.unionByName(txns.where("credit > 0").select("statement_id", other.alias("src"), me.alias("dst"), F.col("credit").alias("amount"), *cols))


def star_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select("statement_id", F.explode(F.array("src", "dst")).alias("node"), "amount", "txn_date")
    return ends.groupBy("statement_id", "node").agg(F.sum("amount").cast("double").alias("flow"), F.min("txn_date").cast("string").alias("first_seen"), F.max("txn_date").cast("string").alias("last_seen"))


def merge_statements(txns: DataFrame, ids: list[int]) -> DataFrame:
    """Several statements as one subject."""
    return txns.where(F.col("statement_id").isin(ids)).withColumn("statement_id", F.lit(-1).cast("long"))


def star_cycles(txns: DataFrame, least_risk: float = config.STAR_RISK, edge_cap: int = config.STAR_EDGE_CAP) -> DataFrame:
    """Counterparties that an account both pays and is paid by, scored; a statement with too many such edges gives one dense record."""
    both = txns.where((F.coalesce("debit", F.lit(0)) > 0) | (F.coalesce("credit", F.lit(0)) > 0)).where("counterparty is not null")
    amount = F.coalesce("debit", "credit").cast("double")
    cycle = both.groupBy("statement_id", "counterparty").agg(
        F.count("debit").alias("d"), F.count("credit").alias("c"), F.count("*").alias("edges"), in_order("row_index", "row_id", amount).alias("amounts"),
        F.array_sort(F.collect_list("row_id")).alias("row_ids"),
    ).where("d > 0 and c > 0")
    cycle = cycle.withColumns({"s": running_deviation(F.col("amounts")), "m": F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x) / F.size("amounts")}).drop("amounts")
    span = txns.groupBy("statement_id").agg(F.datediff(F.max("txn_date"), F.min("txn_date")).alias("days"))
    per = cycle.withColumn("_all", F.sum("edges").over(Window.partitionBy("statement_id"))).join(span, "statement_id")
    conserve = F.greatest(F.lit(0.0), 1 - F.coalesce("s", F.lit(0.0)) / F.col("m"))
    days = F.when(F.col("days") > 0, F.col("days").cast("double")).otherwise(0.1)
    speed = F.least(2 / days / 10, F.lit(1.0))
    risk = W_CONSERVE * conserve + W_VELOCITY * speed + W_AGAIN * F.least(F.col("edges") / 2, F.lit(1.0)) + W_HOPS / 2
    dense = F.col("_all") > edge_cap
    scored = per.where(~dense).withColumns({"conservation": conserve, "span_days": days, "risk": risk}).where(F.col("risk") >= least_risk)
    kept = scored.select("statement_id", "counterparty", "edges", "conservation", "span_days", "risk", "row_ids", F.lit(False).alias("dense"))
    guard = per.where(dense).groupBy("statement_id").agg(F.first("_all").alias("edges"))
    none = F.lit(None)
    return kept.unionByName(guard.select("statement_id", none.cast("string").alias("counterparty"), "edges", F.lit(0.0).alias("conservation"), F.lit(0.0).alias("span_days"), F.lit(0.0).alias("risk"), none.cast("array<string>").alias("row_ids"), F.lit(True).alias("dense")))


def tag_cycles(txns: DataFrame, cycles: DataFrame) -> DataFrame:
    """row_id, n_cycles: how many cycles a transaction lies on."""
    on = cycles.select(F.explode("row_ids").alias("row_id")).groupBy("row_id").agg(F.count("*").alias("n"))
    return txns.select("row_id").join(on, "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n_cycles"))


def max_cycle_risk(txns: DataFrame, cycles: DataFrame) -> DataFrame:
    top = cycles.groupBy("statement_id").agg(F.max("risk").alias("r"))
    return txns.select("statement_id").distinct().join(top, "statement_id", "left").select("statement_id", F.coalesce("r", F.lit(0.0)).alias("max_cycle_risk_score"))


def running_deviation(values: Column) -> Column:
    """Sample deviation of an array of doubles by a running mean, one value after another; null for a single one."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["square"] + (x - mean) * (x - s["mean"])).alias("square"))

    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["square"] / (s["n"] - 1))))


def deviation(values: Column) -> Column:
    """Sample deviation of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(n - 1, F.lit(1)))


def flow_paths(transfers: DataFrame, days: float, tolerance: float, percentile: float, max_hops: int, scope: str | None = None, checkpoint=None) -> DataFrame:
    """All closed paths of transfers forward in time whose amounts stay near the first: t0, last, idxs, amounts, accounts.

    The first amount is at least the element at ``percentile`` of the sorted amounts, and fixes the path's origin. A path grows at
    both ends: onward from where it has come to, or back from its origin, whichever account has fewer transfers there; so an
    account with a large share of all transfers is left for the end, when the transfer that closes the path is looked up by both
    its accounts. A path is made once, as the end at which it grows depends on the path alone. Joins go by account, stretch of
    time and band of amounts: transfers lie in one such cell, a path asks at most two stretches and two bands, and a busy
    account's transfers are spread over its cells.
    """
    keep = checkpoint or (lambda df: written(df, "paths"))
    keys = [scope] if scope else []
    window = int(days * 86_400_000_000)
    width = math.log((1 + tolerance) / (1 - tolerance)) if tolerance < 1 else math.inf
    stretch = lambda at: F.floor(at / F.lit(max(1, window))).cast("long")
    banded = 0 < width < math.inf
    band = (lambda x: F.floor(F.log(x) / width).cast("int")) if banded else (lambda x: F.lit(0))
    t = transfers.where("from_account <> to_account and amount > 0").select(*keys, F.col("row_idx").alias("idx"), F.unix_micros("ts").alias("at"), "from_account", "to_account", F.col("amount").cast("double").alias("amount"))
    floor = order_statistics(t, "amount", {"_floor": lambda n: F.floor(percentile * n)}, tuple(keys)).drop("n")
    t = same(t, floor, tuple(keys)).where(F.col("amount") >= (1 - tolerance) * F.col("_floor"))
    leaving = t.groupBy(*keys, F.col("from_account").alias("to_account")).agg(F.count("*").alias("out"))
    coming = t.groupBy(*keys, F.col("to_account").alias("from_account")).agg(F.count("*").alias("into"))
    # a transfer that nothing can follow or come before closes no path
    t = keep(t.join(leaving, [*keys, "to_account"]).join(coming, [*keys, "from_account"]).withColumns({"stretch": stretch(F.col("at")), "band": band(F.col("amount"))}))
    empty = lambda c: F.slice(F.array(c), 1, 0)
    lists = {"accounts": F.array("from_account", "to_account"), "idxs": F.array("idx"), "amounts": F.array("amount"), "b_accounts": empty("from_account"), "b_idxs": empty("idx"), "b_amounts": empty("amount")}
    scalars = [F.col("from_account").alias("start"), F.col("to_account").alias("here"), F.col("at").alias("t0"), F.col("at").alias("last"), (F.col("at") + window).alias("until"), F.lit(None).cast("long").alias("end"), F.col("amount").alias("first"), "out", "into"]
    open_ = t.where(F.col("amount") >= F.col("_floor")).select(*keys, *scalars, *(c.alias(k) for k, c in lists.items()))
    step = t.select(*(F.col(c).alias(f"n_{c}") for c in (*keys, "idx", "at", "from_account", "to_account", "amount", "out", "into", "stretch", "band")))
    first = F.col("first")
    near = (F.col("n_at") >= F.col("last")) & (F.col("n_at") <= F.col("until")) & (F.abs(F.col("n_amount") - first) <= tolerance * first)
    for k in (*keys, "stretch", "band"):
        near = near & (F.col(k) == F.col(f"n_{k}"))
    edge = lambda share, sign: band(F.greatest(share * first * (1 + sign * 1e-9), F.lit(1e-300)))
    bands = F.sequence(edge(1 - tolerance, -1), edge(1 + tolerance, 1)) if banded else F.array(F.lit(0))
    fresh = lambda c: ~F.array_contains("accounts", F.col(c)) & ~F.array_contains("b_accounts", F.col(c))
    new = lambda c: F.array(F.col(f"n_{c}"))
    closed = None
    for size in range(1, max_hops):
        asked = open_.withColumn("stretch", F.explode(F.sequence(stretch(F.col("last")), stretch(F.col("until"))))).withColumn("band", F.explode(bands))
        onto, from_ = F.col("here") == F.col("n_from_account"), F.col("start") == F.col("n_to_account")
        if size + 1 >= config.FLOW_MIN_HOPS:
            done = asked.join(step, near & onto & from_).select(*keys, "t0", F.coalesce("end", "n_at").alias("last"), F.concat("accounts", "b_accounts").alias("accounts"), F.concat("idxs", new("idx"), "b_idxs").alias("idxs"), F.concat("amounts", new("amount"), "b_amounts").alias("amounts"))
            closed = done if closed is None else closed.unionByName(done)
        if size == max_hops - 1:
            break
        onward = asked.where("out <= into").join(step, near & onto).where(fresh("n_to_account")).select(
            *keys, "start", F.col("n_to_account").alias("here"), "t0", F.col("n_at").alias("last"), "until", "end", "first", F.col("n_out").alias("out"), "into",
            F.concat("accounts", new("to_account")).alias("accounts"), F.concat("idxs", new("idx")).alias("idxs"), F.concat("amounts", new("amount")).alias("amounts"), "b_accounts", "b_idxs", "b_amounts",
        )
        back = asked.where("out > into").join(step, near & from_).where(fresh("n_from_account")).select(
            *keys, F.col("n_from_account").alias("start"), "here", "t0", "last", F.col("n_at").alias("until"), F.coalesce("end", "n_at").alias("end"), "first", "out", F.col("n_into").alias("into"),
            "accounts", "idxs", "amounts", F.concat(new("from_account"), "b_accounts").alias("b_accounts"), F.concat(new("idx"), "b_idxs").alias("b_idxs"), F.concat(new("amount"), "b_amounts").alias("b_amounts"),
        )
        open_ = keep(onward.unionByName(back))
    return closed


def ring_key(accounts: Column) -> Column:
    """The smallest rotation of a ring, as text."""
    n = F.size(accounts)
    turned = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(">", F.concat(F.slice(accounts, i, n), F.slice(accounts, F.lit(1), i - 1))))
    return F.array_min(turned)


def conserved_cycles(transfers: DataFrame, days: float = config.FLOW_DAYS, tolerance: float = config.FLOW_TOLERANCE, percentile: float = config.FLOW_PERCENTILE, max_hops: int = config.FLOW_MAX_HOPS, least_risk: float = config.FLOW_RISK, scope: str | None = None, checkpoint=None) -> DataFrame:
    """One finding per ring of accounts, the earliest: ring, hops, idxs, conservation, span_days, risk, amount."""
    keys = [scope] if scope else []
    paths = flow_paths(transfers, days, tolerance, percentile, max_hops, scope, checkpoint).withColumn("ring", ring_key(F.col("accounts")))
    earliest = F.min(F.struct("t0", F.col("idxs")[0].alias("head"), "idxs", "accounts", "amounts", "last")).alias("path")
    one = paths.groupBy(*keys, "ring").agg(earliest).select(*keys, "ring", "path.*")
    hops = F.size("idxs")
    mean = F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x) / hops
    conserve = F.greatest(F.lit(0.0), 1 - deviation(F.col("amounts")) / mean)
    span = F.greatest((F.col("last") - F.col("t0")) / 8.64e10, F.lit(0.01))
    risk = W_CONSERVE * conserve + W_VELOCITY * F.least(hops / span / 10, F.lit(1.0)) + W_AGAIN / 3 + W_HOPS / hops
    scored = one.select(*keys, "ring", hops.cast("long").alias("hops"), "idxs", "accounts", conserve.alias("conservation"), span.alias("span_days"), risk.alias("risk"), mean.alias("mean_amount"))
    return scored.where(F.col("risk") >= least_risk)


def without_chains(edges: DataFrame, keep) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The edges with each chain of nodes that have one edge in and one out as a single edge; the nodes of chains and of rings.

    Pointers forward and back double their reach in each round, so a chain takes a logarithm of its length. Pointers that never
    leave such nodes go round a ring, which is a component by itself.

    Returns:
        edges (src, dst), loops among them; chains: node, start and end of its chain; rings: node, component (its smallest node).
        The last two are None where no node has one edge in and one out.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("dst").alias("end"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("m"), F.max("src").alias("start"))
    single = keep(out.join(into, "node").where("n = 1 and m = 1").select("node", "start", "end", F.col("node").alias("least")))
    n = single.count()
    if not n:
        return edges, None, None
    names = single.select("node")
    on_way = lambda c: single.select(F.col("node").alias(c))
    state = single
    for _ in range(n.bit_length() + 1):
        if state.join(on_way("end"), "end", "left_semi").isEmpty():
            break
        onward = state.select(F.col("node").alias("end"), F.col("end").alias("end2"), F.col("least").alias("least2"))
        back = state.select(F.col("node").alias("start"), F.col("start").alias("start2"))
        further = state.join(onward, "end", "left").join(back, "start", "left")
        state = keep(further.select("node", F.coalesce("start2", "start").alias("start"), F.coalesce("end2", "end").alias("end"), F.least("least", F.coalesce("least2", "least")).alias("least")))
    rings = state.join(on_way("end"), "end", "left_semi").select("node", F.col("least").alias("component"))
    chains = keep(state.join(on_way("end"), "end", "left_anti").select("node", "start", "end"))
    rest = edges.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return keep(rest.unionByName(chains.select(F.col("start").alias("src"), F.col("end").alias("dst"))).distinct()), chains, keep(rings)


def strong_components(edges: DataFrame, checkpoint=None) -> DataFrame:
    """node, component (its largest node) for the nodes of directed edges (src, dst) that lie on a cycle of two nodes or more.

    Chains become single edges, then nodes without an edge in or out are trimmed, again and again. Labels then spread forward,
    the largest winning, and what reaches a label's own node back within it is one component; the rest goes on. A chain
    belongs to the component that both its ends are in, and one that comes back to its start makes a component with it.
    """
    keep = checkpoint or (lambda df: written(df, "graph"))
    left = keep(edges.where("src <> dst").select("src", "dst").distinct())
    found, chains = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0), []
    while True:
        size = -1
        while size != (size := left.count()):
            left, chain, rings = without_chains(left, keep)
            if chain is not None:
                chains.append(chain)
                found = found.unionByName(rings)
                left = keep(left.where("src <> dst"))
            left = keep(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if not size:
            break
        color = keep(left.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")))
        while True:
            pushed = left.join(color, left.src == color.node).select(F.col("dst").alias("node"), F.col("color").alias("pushed")).groupBy("node").agg(F.max("pushed").alias("pushed"))
            new = keep(color.join(pushed, "node", "left").select("node", F.greatest("color", F.coalesce("pushed", "color")).alias("color")))
            same_ = new.join(color, ["node", "color"], "left_anti").isEmpty()
            color = new
            if same_:
                break
        within = left.join(color.select(F.col("node").alias("src"), "color"), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("_c")), "dst").where("color = _c").select("src", "dst", "color")
        within = keep(within)
        part = keep(color.where("node = color"))
        while True:
            back = within.join(part.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "color").distinct().join(part, ["node", "color"], "left_anti")
            back = keep(back)
            if back.isEmpty():
                break
            part = keep(part.unionByName(back))
        big = part.join(part.groupBy("color").agg(F.count("*").alias("_n")).where("_n > 1"), "color").select("node", F.col("color").alias("component"))
        found = found.unionByName(big)
        gone = part.select("node")
        left = keep(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    found = keep(found)
    for chain in reversed(chains):
        looped = chain.where("start = end").select(F.col("start").alias("node")).distinct().join(found, "node", "left_anti")
        found = keep(found.unionByName(looped.withColumn("component", F.col("node"))))
        end = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))  # noqa: B023, E731
        inside = chain.join(end("start", "_a"), "start").join(end("end", "_b"), "end").where("_a = _b").select("node", F.col("_a").alias("component"))
        found = keep(found.unionByName(inside))
    return found.join(found.groupBy("component").agg(F.max("node").alias("_name")), "component").select("node", F.col("_name").alias("component"))


def graph_cycles(edges: DataFrame, least_risk: float = config.STAR_RISK, edge_cap: int = config.STAR_EDGE_CAP, max_hops: int = config.FLOW_MAX_HOPS, checkpoint=None) -> DataFrame:
    """Simple cycles of at most ``max_hops`` nodes of a directed multigraph, scored.

    Args:
        edges: src, dst, amount and at (a date or time); parallel edges count, loops don't.
    Returns:
        nodes (from the smallest), hops, edges, conservation, span_days, risk, dense. A strong component with more than
        ``edge_cap`` edges gives one dense record with a risk of 0 in place of its cycles.

    The cycle starts at its smallest node, so that each is walked once; an edge's time is that of both its nodes.
    """
    keep = checkpoint or (lambda df: written(df, "graph"))
    part = keep(strong_components(edges, checkpoint))
    e = edges.where("src <> dst").select("src", "dst", F.col("amount").cast("double").alias("amount"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"), "at").groupBy("node").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    inner = e.join(part.select(F.col("node").alias("src"), "component"), "src").join(part.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst").where("component = _c")
    pairs = inner.groupBy("component", "src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("s1"), F.sum(F.col("amount") * F.col("amount")).alias("s2"))
    pairs = keep(pairs.join(ends.withColumnRenamed("node", "src"), "src"))
    sizes = pairs.groupBy("component").agg(F.sum("n").alias("all"))
    hop = keep(pairs.join(sizes.where(F.col("all") <= edge_cap), "component"))
    sums = lambda p: [F.col(f"{p}{c}") for c in ("n", "s1", "s2", "first", "last")]
    open_ = hop.where("src < dst").select(F.array("src", "dst").alias("nodes"), F.col("src").alias("start"), F.col("dst").alias("here"), *sums(""))
    step = hop.select(F.col("src").alias("here"), F.col("dst").alias("next"), *(F.col(c).alias(f"o_{c}") for c in ("n", "s1", "s2", "first", "last")))
    closed = None
    for hops in range(2, max_hops + 1):
        grown = open_.join(step, "here").where((F.col("next") == F.col("start")) | ((F.col("next") > F.col("start")) & ~F.array_contains("nodes", F.col("next"))))
        both = [(F.col(c) + F.col(f"o_{c}")).alias(c) for c in ("n", "s1", "s2")] + [F.least("first", "o_first").alias("first"), F.greatest("last", "o_last").alias("last")]
        grown = keep(grown.select("nodes", "start", F.col("next").alias("here"), *both))
        done = grown.where("here = start").select("nodes", F.lit(hops).cast("long").alias("hops"), *sums(""))
        closed = done if closed is None else closed.unionByName(done)
        open_ = grown.where("here <> start").withColumn("nodes", F.concat("nodes", F.array("here")))
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") - F.col("s1") * mean, F.lit(0.0)) / F.greatest(n - 1, F.lit(1)))
    conserve = F.when(mean > 0, F.greatest(F.lit(0.0), 1 - spread / mean)).otherwise(1.0)
    span = F.when(F.col("last") > F.col("first"), (F.col("last") - F.col("first")) / 8.64e10).otherwise(0.1)
    risk = W_CONSERVE * conserve + W_VELOCITY * F.least(F.col("hops") / span / 10, F.lit(1.0)) + W_AGAIN * F.least(n / F.col("hops"), F.lit(1.0)) + W_HOPS / F.col("hops")
    scored = closed.select("nodes", "hops", n.alias("edges"), conserve.alias("conservation"), span.alias("span_days"), risk.alias("risk"), F.lit(False).alias("dense")).where(F.col("risk") >= least_risk)
    none = F.lit(0.0)
    dense = sizes.where(F.col("all") > edge_cap).select(F.array("component").alias("nodes"), F.lit(0).cast("long").alias("hops"), F.col("all").alias("edges"), none.alias("conservation"), none.alias("span_days"), none.alias("risk"), F.lit(True).alias("dense"))
    return scored.unionByName(dense)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, checkpoint=None) -> DataFrame:
    """node, rank for weighted edges (src, dst, weight); what dangling nodes hold goes to all.

    Rounds end, after at most ``rounds``, when all ranks together change by less than ``tolerance`` for each node.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left")
    if checkpoint:
        share, nodes = checkpoint(share), checkpoint(nodes)
    n = nodes.count()
    rank = nodes.select("node", "sends", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("sends").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        got = rank.join(share, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        before, rank = rank, nodes.join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(loose)).select("node", "sends", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))  # one row
        if checkpoint:
            rank = checkpoint(rank)
        moved = rank.join(before.select("node", F.col("rank").alias("_b")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_b")))).first()[0]
        if moved is None or moved < n * tolerance:
            break
    return rank.select("node", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degrees of distinct neighbours and flows, for edges (src, dst, amount)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("out_degree"), F.sum("amount").cast("double").alias("out_flow"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"), F.sum("amount").cast("double").alias("in_flow"))
    both = out.join(into, "node", "full").fillna(0)
    return both.withColumns({"degree_ratio": F.col("out_degree") / F.nullif(F.col("in_degree"), F.lit(0)), "flow_ratio": F.col("out_flow") / F.nullif(F.col("in_flow"), F.lit(0))})


#: From so many nodes on betweenness is that of a sample of roots.
PIVOTS = 150


def betweenness(edges: DataFrame, pivots: int = PIVOTS, weight: str | None = None, checkpoint=None) -> DataFrame:
    """node, betweenness (normalised) and sampled, of the directed graph of the distinct edges (src, dst).

    Args:
        edges: src, dst and, where ``weight`` names a column, positive lengths; parallel edges' lengths are added, loops don't count.
        pivots: searches start from so many nodes at most, those with the smallest hashes; sampled says whether that left any out.

    All searches walk together. A round settles, for each root, the nodes at its least open distance: all shortest paths to
    them are known by then, as lengths are positive. Rounds end when nothing is open, however long the paths are; the way back
    takes them in reverse, and each reads only its own nodes and what later ones have left for their predecessors.
    """
    keep = checkpoint or (lambda df: written(df, "levels"))
    length = F.sum(F.col(weight).cast("double")) if weight else F.lit(1.0)
    e = keep(edges.where("src <> dst").groupBy("src", "dst").agg(length.alias("length")))
    nodes = keep(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.count()
    roots = min(pivots, n)
    open_ = nodes.orderBy(F.xxhash64("node"), "node").limit(pivots).select(F.col("node").alias("root"), "node", F.lit(0.0).alias("dist"), F.lit(1.0).alias("paths"))
    rounds, settled = [], None
    while True:
        now = open_
        if weight:
            now = open_.join(open_.groupBy("root").agg(F.min("dist").alias("_least")), "root").where("dist = _least").drop("_least")
        now = keep(now)
        if now.isEmpty():
            break
        rounds.append(now)
        settled = now if settled is None else settled.unionByName(now)
        reached = now.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), "paths")
        reached = reached.join(settled.select("root", "node"), ["root", "node"], "left_anti")
        if weight:
            reached = reached.unionByName(open_.join(now.select("root", "node"), ["root", "node"], "left_anti"))
        counted = reached.groupBy("root", "node", "dist").agg(F.sum("paths").alias("paths"))
        open_ = keep(counted.groupBy("root", "node").agg(F.min(F.struct("dist", "paths")).alias("at")).select("root", "node", "at.*")) if weight else counted
    total, left = None, None
    for now in reversed(rounds):
        here = now.withColumn("dep", F.lit(0.0))
        if left is not None:
            here = now.join(left, ["root", "node"], "left").select("root", "node", "dist", "paths", F.coalesce("more", F.lit(0.0)).alias("dep"))
        here = keep(here)
        own = here.where("root <> node").select("node", "dep")
        total = own if total is None else total.unionByName(own)
        later = here.select("root", F.col("node").alias("dst"), F.col("dist").alias("_to"), F.col("paths").alias("_paths"), "dep").join(e, "dst").withColumnRenamed("src", "node")
        before = settled.join(later, ["root", "node"]).where(F.col("dist") + F.col("length") == F.col("_to"))
        more = before.select("root", "node", (F.col("paths") / F.col("_paths") * (1 + F.col("dep"))).alias("more"))
        if left is not None and weight:
            more = more.unionByName(left.join(now.select("root", "node"), ["root", "node"], "left_anti"))
        left = keep(more.groupBy("root", "node").agg(F.sum("more").alias("more")))
    scale = (n / max(1, roots)) / max(1, (n - 1) * (n - 2))
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"), F.lit(False).alias("sampled"))
    summed = total.groupBy("node").agg(F.sum("dep").alias("b"))
    return nodes.join(summed, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"), F.lit(n > pivots).alias("sampled"))


#: Fewer nodes than these have no betweenness and no rank.
LEAST_STAR, LEAST_BANKS = 5, 4


def star_centrality(txns: DataFrame, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """Degrees, flows, betweenness and PageRank of every node of every statement's star: one aggregation, no walk.

    In a star all paths lead through the account, so whatever the lengths it lies between each counterparty that pays it and
    each other one that it pays. Ranks weighted by the number of payments move between three sums only: the account's, that of
    counterparties that pay it, and that of those that don't (whose rank goes to all); the rounds are run on these.

    Returns:
        statement_id, node, in_degree, out_degree, degree_ratio, in_flow, out_flow, flow_ratio, betweenness, pagerank; the
        ratios divide by at least 1, and the last two are null in stars of fewer than LEAST_STAR nodes.
    """
    edges = star_edges(txns)
    out = F.col("src") == F.concat(F.lit("ACCT_"), F.col("statement_id"))
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))).cast("double"), F.lit(0.0))
    other = edges.groupBy("statement_id", F.when(out, F.col("dst")).otherwise(F.col("src")).alias("node")).agg(
        F.count_if(out).alias("paid"), F.count_if(~out).alias("pays"), money(out).alias("in_flow"), money(~out).alias("out_flow"),
    )
    pays, paid = F.col("pays") > 0, F.col("paid") > 0
    star = other.groupBy("statement_id").agg(
        (F.count("*") + 1).alias("n"), F.count_if(pays).alias("c"), F.count_if(paid).alias("d"), F.count_if(pays & paid).alias("both"), F.sum("paid").alias("all_paid"),
        F.sum(F.when(pays, F.col("paid")).otherwise(0)).alias("to_c"), F.sum("in_flow").alias("spent"), F.sum("out_flow").alias("got"),
    )
    n = F.col("n").cast("double")
    share = F.when(F.col("all_paid") > 0, F.col("to_c") / F.col("all_paid")).otherwise(0.0)
    rest = F.when(F.col("all_paid") > 0, 1 - share).otherwise(0.0)
    base = lambda s: (1 - damping) / n + damping * (s["l"] + F.when(F.col("all_paid") > 0, 0.0).otherwise(s["a"])) / n
    state = lambda a, c, l: F.struct(a.alias("a"), c.alias("c"), l.alias("l"))
    free = F.col("n") - 1 - F.col("c")
    step = lambda s, _: state(base(s) + damping * s["c"], F.col("c") * base(s) + damping * s["a"] * share, free * base(s) + damping * s["a"] * rest)
    star = star.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(1 / n, F.col("c") / n, free / n), step)).withColumn("_base", base(F.col("s")))
    large = F.col("n") >= LEAST_STAR
    between = (F.col("c") * F.col("d") - F.col("both")) / ((F.col("n") - 1) * (F.col("n") - 2))
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    subject = star.select("statement_id", F.concat(F.lit("ACCT_"), F.col("statement_id")).alias("node"), F.col("c").alias("in_degree"), F.col("d").alias("out_degree"), F.col("got").alias("in_flow"), F.col("spent").alias("out_flow"), F.when(large, between).alias("betweenness"), F.when(large, F.col("s.a")).alias("pagerank"))
    rank = F.col("_base") + F.when(F.col("all_paid") > 0, damping * F.col("s.a") * F.col("paid") / F.col("all_paid")).otherwise(0.0)
    around = other.join(star.select("statement_id", "n", "s", "_base", "all_paid"), "statement_id").select(
        "statement_id", "node", paid.cast("long").alias("in_degree"), pays.cast("long").alias("out_degree"), "in_flow", "out_flow", F.when(large, 0.0).alias("betweenness"), F.when(large, rank).alias("pagerank")
    )
    return subject.unionByName(around).withColumns({"degree_ratio": ratio(F.col("out_degree"), F.col("in_degree")), "flow_ratio": ratio(F.col("out_flow"), F.col("in_flow"))})


def bank_centrality(edges: DataFrame, pivots: int = PIVOTS, checkpoint=None) -> DataFrame:
    """node, in_degree, out_degree, betweenness, sampled and pagerank of a graph of banks (src, dst, n, amount).

    Betweenness counts hops, ranks go by ``n``; among fewer than LEAST_BANKS banks betweenness is 0 and there is no rank. A
    bank that pays itself is its own neighbour; one that has no other neighbour has no betweenness.
    """
    graph = edges.select("src", "dst", "amount", F.col("n").alias("weight"))
    found = degrees(graph).select("node", "in_degree", "out_degree")
    found = found.join(betweenness(graph, pivots, checkpoint=checkpoint), "node", "left")
    ranked = pagerank(graph, tolerance=1e-10, checkpoint=checkpoint).withColumnRenamed("rank", "pagerank")
    enough = F.col("_banks") >= LEAST_BANKS
    both = found.join(ranked, "node", "left").crossJoin(F.broadcast(found.agg(F.count("*").alias("_banks"))))  # one row
    return both.select("node", "in_degree", "out_degree", F.when(enough, F.coalesce("betweenness", F.lit(0.0))).otherwise(0.0).alias("betweenness"), F.coalesce("sampled", F.lit(False)).alias("sampled"), F.when(enough, F.col("pagerank")).alias("pagerank"))
