"""Money-flow graph jobs as joins over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .distribution import forward_counts
from .packed import ACCOUNTS_A_TASK, Accounts
from .search import walked
from .walks import TRACE_WORDS, WALK_BITS, WORD_COLUMNS, hand_on, number_accounts, walk_sums  # noqa: F401

VELOCITY_S, VELOCITY_MORE_THAN = 300, 2
SPLIT_MIN, SPLIT_TOLERANCE = 3, 0.30
TRACE_DEPTH, CREW_HOPS = 5, 3
#: lists that the complaints of one block of walks are dealt to, so that many complaints of one origin make no long one
LISTS = 64


def collapse_edges(ledger: DataFrame, keep: str = "last") -> DataFrame:
    """One edge per (src, dst): the last (or first) transfer in load order."""
    rest = [c for c in ledger.columns if c not in ("src_account", "dst_account")]
    pick = F.max_by if keep == "last" else F.min_by
    return (ledger.groupBy("src_account", "dst_account").agg(pick(F.struct(*rest), F.col("txn_id")).alias("e"))
            .select("src_account", "dst_account", "e.*"))


def build_graph(ledger: DataFrame, accounts: DataFrame, parallel: str = "last") -> tuple[DataFrame, DataFrame]:
    ends = ledger.select(F.col("src_account").alias("account_id")).union(ledger.select("dst_account")).distinct()
    nodes = accounts.join(ends, "account_id", "full_outer")
    return nodes, (ledger if parallel == "all" else collapse_edges(ledger, parallel))


def velocity_flags(edges: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Sources with more than two out-transfers of which three fall inside 300 seconds."""
    keys = (scope or []) + ["src_account"]
    hot = forward_counts(edges, keys, "ts_s", VELOCITY_S).filter(F.col("in_window") > VELOCITY_MORE_THAN)
    return hot.groupBy(*keys).agg(F.max("in_window").alias("peak")).withColumnRenamed("src_account", "account_id")


def split_flags(edges: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Sources whose three or more out-transfers all lie within 30 % of their mean."""
    keys = (scope or []) + ["src_account"]
    stats = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("amount").alias("lo"),
                                     F.max("amount").alias("hi"), F.avg("amount").alias("mean"))
    mean = F.col("mean")
    even = (F.abs(F.col("lo") - mean) / mean <= SPLIT_TOLERANCE) & (F.abs(F.col("hi") - mean) / mean <= SPLIT_TOLERANCE)
    return (stats.filter((F.col("n") >= SPLIT_MIN) & (mean != 0) & even)
            .select(*(scope or []), F.col("src_account").alias("account_id"), "n", "mean"))


def leaves(edges: DataFrame, scope: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Accounts without an out-edge: globally over all nodes, or per case over its own transfers."""
    scope = scope or []
    ends = edges.select(*scope, F.col("dst_account").alias("account_id")).distinct() if nodes is None else nodes.select("account_id").distinct()
    sources = edges.select(*scope, F.col("src_account").alias("account_id")).distinct()
    return ends.join(sources, scope + ["account_id"], "left_anti")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def n(df):
        return df.agg(F.count(F.lit(1))).scalar()

    one = nodes.agg(F.count(F.lit(1)).alias("num_nodes"))
    return (one.withColumn("num_edges", n(edges)).withColumn("terminal_nodes", n(leaves(edges, nodes=nodes)))
            .withColumn("velocity_anomalies", n(velocity_flags(edges))).withColumn("fund_splitting_nodes", n(split_flags(edges))))


def _any_bit(names: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(n) != 0 for n in names])


def bit_levels(starts: DataFrame, edges: DataFrame, max_depth: int = TRACE_DEPTH) -> list[DataFrame]:
    """Breadth-first levels of many walks at once: per depth (account_id, block, w0, w1, ...) of the walks that get there first.

    ``starts`` holds (walk, account_id) with whole numbers from 0 on, consecutive for the most part; bit ``walk % WALK_BITS`` of
    block ``walk div WALK_BITS`` stands for a walk, so a transfer pair carries that many walks in one row. A level is one step
    over a grid of tasks (``hand_on``); what was seen before is taken off word by word. Starts on no edge give nothing.
    """
    pairs = cut_lineage(edges.select("src_account", "dst_account").distinct())
    links, ids = number_accounts(pairs)
    known = pairs.select(F.col("src_account").alias("account_id")).union(pairs.select("dst_account")).distinct()
    bit = (F.col("walk") % WALK_BITS).cast("int")
    own = [F.when(F.floor(bit / 64) == i, F.expr(f"shiftleft(1L, cast(walk % {WALK_BITS} as int) % 64)")).otherwise(F.lit(0).cast("long")).alias(n)
           for i, n in enumerate(WORD_COLUMNS)]
    gather = [F.bit_or(n).alias(n) for n in WORD_COLUMNS]
    here = (starts.join(known, "account_id", "left_semi").select("account_id", F.expr(f"walk div {WALK_BITS}").alias("block"), *own)
            .groupBy("account_id", "block").agg(*gather))
    seen_names = [f"seen_{n}" for n in WORD_COLUMNS]
    state = cut_lineage(here.select("*", *[F.col(n).alias(s) for n, s in zip(WORD_COLUMNS, seen_names)]))
    levels = []
    for depth in range(max_depth + 1):
        level = state.filter(_any_bit(WORD_COLUMNS)).select("account_id", "block", *WORD_COLUMNS)
        if level.isEmpty():
            break
        levels.append(level)
        if depth == max_depth:
            break
        reached = step_walks(level, links, ids)
        zero = F.lit(0).cast("long")
        both = state.select("account_id", "block", *seen_names).join(reached, ["account_id", "block"], "full_outer")
        state = cut_lineage(both.select("account_id", "block", *[F.coalesce(F.col(n).bitwiseAND(F.bitwise_not(F.coalesce(s, zero))), zero).alias(n) for n, s in zip(WORD_COLUMNS, seen_names)],
                                        *[F.coalesce(s, zero).bitwiseOR(F.coalesce(n, zero)).alias(s) for n, s in zip(WORD_COLUMNS, seen_names)]))
    return levels


def step_walks(level: DataFrame, links: DataFrame, ids: DataFrame | None) -> DataFrame:
    """(account_id, block, words) one transfer on; ``links`` and ``ids`` as ``number_accounts`` gives them. A null receiver is a row a block."""
    named = level.filter("account_id is not null")
    named = named.withColumn("account", F.col("account_id").cast("long")) if ids is None else named.join(ids, "account_id")
    known = hand_on(named, links.filter("t is not null"))
    known = known.withColumnRenamed("account", "account_id") if ids is None else known.join(ids, "account").drop("account")
    lost = named.join(links.filter("t is null").select(F.col("s").alias("account")), "account").groupBy("block").agg(*[F.bit_or(n).alias(n) for n in WORD_COLUMNS])
    return known.unionByName(lost.withColumn("account_id", F.lit(None).cast(known.schema["account_id"].dataType)))


def walk_levels(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(levels)])


def _accounts(edges: DataFrame) -> Accounts:
    """Accounts of the transfers by number; ``edges`` is a written table, which is read several times."""
    ends = edges.select(F.col("src_account").alias("account_id")).union(edges.select("dst_account"))
    return Accounts(ends, edges.agg(F.count(F.lit(1))).head()[0])


def _none_seen(edges: DataFrame) -> DataFrame:
    none = edges.select(F.col("src_account").alias("account_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("block"))
    return none.select("*", *[F.lit(0).cast("long").alias(n) for n in WORD_COLUMNS]).limit(0)


def walk_bits(starts: DataFrame, edges: DataFrame, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """Rows of bits (account_id, depth, block, words) as in ``bit_levels``, all levels; searched in whole tasks (``walked``) where a task can hold the accounts."""
    accounts = _accounts(edges)
    if accounts.size <= ACCOUNTS_A_TASK:
        return walked(starts, edges, accounts, max_depth, "words", words=len(WORD_COLUMNS))
    levels = bit_levels(starts, edges, max_depth)
    return walk_levels(levels).select("account_id", "depth", "block", *WORD_COLUMNS) if levels else _none_seen(edges)


def walk_level_sums(starts: DataFrame, edges: DataFrame, weight: Column | None, max_depth: int, all_levels: bool = False) -> DataFrame:
    """(walk, depth, n, weight_sum) per level, or over all levels with the deepest, without writing a level where a task can hold the accounts."""
    accounts = _accounts(edges)
    if accounts.size <= ACCOUNTS_A_TASK:
        return walked(starts, edges, accounts, max_depth, "totals" if all_levels else "levels", weight)
    levels = bit_levels(starts, edges, max_depth)
    sums = walk_sums(walk_levels(levels).select("account_id", "depth", "block", *WORD_COLUMNS) if levels else _none_seen(edges), weight)
    if not all_levels:
        return sums
    return sums.groupBy("walk").agg(F.max("depth").alias("depth"), F.sum("n").alias("n"), F.sum("weight_sum").alias("weight_sum"))


def walk_rows(bits: DataFrame) -> DataFrame:
    """(walk, account_id, depth), one row per bit that is set."""
    words = bits.select("account_id", "depth", "block", F.posexplode(F.array(*WORD_COLUMNS)).alias("word", "bits")).filter("bits <> 0")
    return (words.withColumn("bit", F.explode(F.array(*[F.lit(i) for i in range(64)]))).filter("(shiftright(bits, bit) & 1) = 1")
            .select(F.expr(f"block * {WALK_BITS} + word * 64 + bit").alias("walk"), "account_id", "depth"))


def _numbered(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = cut_lineage(starts.select("trace_id").distinct().withColumn("walk", F.monotonically_increasing_id()))
    return ids, starts.select("trace_id", "account_id").distinct().join(ids, "trace_id").select("walk", "account_id")


def trace_profile(starts: DataFrame, edges: DataFrame, weight: Column | None = None, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """The rows of ``trace`` summed up per level, without writing them out: (trace_id, depth, accounts, weight_sum)."""
    ids, numbered = _numbered(starts)
    return walk_level_sums(numbered, edges, weight, max_depth).join(ids, "walk").select("trace_id", "depth", F.col("n").alias("accounts"), "weight_sum")


def trace(starts: DataFrame, edges: DataFrame, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """Breadth-first depth of every account reachable from each start: (trace_id, account_id, depth).

    All starts advance together, one bit each; several accounts of one trace_id start it together and the smaller depth counts.
    """
    ids, numbered = _numbered(starts)
    return walk_rows(walk_bits(numbered, edges, max_depth)).join(ids, "walk").select("trace_id", "account_id", "depth")


def trace_edges(reached: DataFrame, edges: DataFrame, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """Every out-edge of an account above the depth limit."""
    return reached.filter(F.col("depth") < max_depth).join(edges, reached.account_id == edges.src_account).drop("account_id")


def trace_terminals(reached: DataFrame, edges: DataFrame, max_depth: int = TRACE_DEPTH) -> DataFrame:
    return (trace_edges(reached, edges.filter(F.col("is_terminal") == 1), max_depth)
            .select("trace_id", F.col("dst_account").alias("account_id")).distinct())


def complaint_origins(edges: DataFrame) -> DataFrame:
    return (edges.filter((F.col("hop_depth") == 1) & F.col("complaint_id").isNotNull())
            .select(F.col("complaint_id").alias("trace_id"), F.col("src_account").alias("account_id")).distinct())


def complaint_walks(edges: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(complaint_id, walk) and (walk, account_id): complaints with one and the same origin share a walk, one with several has its own."""
    origins = complaint_origins(edges)
    if asked is not None:
        origins = origins.join(asked.select(F.col("complaint_id").alias("trace_id")).distinct(), "trace_id", "left_semi")
    origins = cut_lineage(origins)
    heads = origins.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("account_id").alias("only"))
    heads = cut_lineage(heads.select("trace_id", F.when(F.col("n") == 1, F.col("only")).alias("only"), F.when(F.col("n") > 1, F.col("trace_id")).alias("own")))
    walks = cut_lineage(heads.select("only", "own").distinct().withColumn("walk", F.monotonically_increasing_id()))
    alone, many = walks.filter("own is null").select("only", "walk"), walks.filter("own is not null").select(F.col("own").alias("trace_id"), "walk")
    of = heads.filter("own is null").join(alone, "only").select("trace_id", "walk").unionByName(many)
    starts = alone.select("walk", F.col("only").alias("account_id")).unionByName(origins.join(many, "trace_id").select("walk", "account_id"))
    return of.select(F.col("trace_id").alias("complaint_id"), "walk"), starts


def trace_complaints(edges: DataFrame, asked: DataFrame | None = None, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """(complaint_id, account_id, depth) from the first-hop sources of the asked complaints, over the whole graph.

    ``asked`` holds the complaint ids somebody wants traced; without it every complaint is, and the result is as large as
    all their reach (``complaint_reach`` sums it up without writing it out). Where two origins of a complaint reach one
    account, the smaller depth is kept.
    """
    of, starts = complaint_walks(edges, asked)
    # complaints come to the bits of their block in short lists: the rows of the result are never shuffled
    place = F.struct("complaint_id", (F.col("walk") % WALK_BITS).cast("int").alias("bit"))
    lists = cut_lineage(of.groupBy(F.expr(f"walk div {WALK_BITS}").alias("block"), F.pmod(F.xxhash64("complaint_id"), F.lit(LISTS)).alias("part")).agg(F.collect_list(place).alias("asked")).drop("part"))
    words = walk_bits(starts, edges, max_depth).select("account_id", "depth", "block", F.array(*WORD_COLUMNS).alias("words"))
    met = words.join(lists, "block").select("account_id", "depth", "words", F.inline("asked"))
    return met.filter("(shiftright(words[bit div 64], bit % 64) & 1) = 1").select("complaint_id", "account_id", "depth")


def complaint_reach(edges: DataFrame, weight: Column | None = None, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """How far every complaint reaches: (complaint_id, reached, deepest, weight_sum), the last over a number of the account.

    Bits are counted per walk before anything is joined with complaints, so the reach itself is never written out.
    """
    of, starts = complaint_walks(edges)
    sums = cut_lineage(walk_level_sums(starts, edges, weight, max_depth, all_levels=True).select("walk", F.col("n").alias("reached"), F.col("depth").alias("deepest"), "weight_sum"))
    return of.join(sums, "walk").drop("walk")


def complaint_terminals(edges: DataFrame, asked: DataFrame | None = None, weight: Column | None = None, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """``trace_terminals`` of ``trace_complaints`` summed up per complaint, without writing either out: (complaint_id, terminals, weight_sum)."""
    of, starts = complaint_walks(edges, asked)
    accounts = _accounts(edges)
    if accounts.size <= ACCOUNTS_A_TASK:
        sums = cut_lineage(walked(starts, edges, accounts, max_depth - 1, "last", weight, edges.filter(F.col("is_terminal") == 1)))
        return of.join(sums, "walk").select("complaint_id", F.col("n").alias("terminals"), "weight_sum")
    levels = bit_levels(starts, edges, max_depth - 1)
    if not levels:
        return of.select("complaint_id", F.lit(0).cast("long").alias("terminals"), F.lit(0).cast("long").alias("weight_sum")).limit(0)
    above = cut_lineage(reduce(DataFrame.unionByName, levels).groupBy("account_id", "block").agg(*[F.bit_or(n).alias(n) for n in WORD_COLUMNS]))
    links, ids = number_accounts(edges.filter(F.col("is_terminal") == 1).select("src_account", "dst_account"))
    ends = step_walks(above, links, ids).withColumn("depth", F.lit(0))
    return of.join(walk_sums(ends, weight), "walk").select("complaint_id", F.col("n").alias("terminals"), "weight_sum")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs, both ways, self transfers left out."""
    both = edges.select(F.col("src_account").alias("a"), F.col("dst_account").alias("b"))
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected component of every account: (account_id, component = smallest id).

    Large-star / small-star contraction: each round rewires every account to the smallest
    label around it, so long chains shrink geometrically and no neighbour list is gathered.
    """
    pairs = edges.select(F.col("src_account").alias("u"), F.col("dst_account").alias("v")).distinct()
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    links = cut_lineage(pairs.filter("u <> v"))
    before = None
    while True:
        # large star: hang every larger neighbour on the smallest label of the neighbourhood
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the same over the smaller neighbours
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        links = cut_lineage(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    return (nodes.join(links.groupBy("u").agg(F.min("v").alias("root")), "u", "left")
            .select(F.col("u").alias("account_id"), F.coalesce("root", "u").alias("component")))


def component_report(edges: DataFrame) -> DataFrame:
    sizes = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    n_edges = edges.select("src_account", "dst_account").distinct().agg(F.count(F.lit(1))).scalar()
    return (sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))
            .withColumn("edges", n_edges).withColumn("mean_degree", F.round(2.0 * F.col("edges") / F.col("nodes"), 4)))


def neighbour_mean(features: DataFrame, edges: DataFrame, columns: list[str], rounds: int = 2, both_ways: bool = True) -> DataFrame:
    """Mean of neighbour features, once per round, edges both ways with multiplicity.

    Parallel transfers become a weight, so a hot account receives one partial sum per task
    and neighbour, never one row per transfer. An account without a neighbour gets zeros.
    """
    def way(s: str, d: str):
        return F.struct(F.col(s).alias("s"), F.col(d).alias("d"))

    # one pass over the edges; the weights are read again in every round
    ways = [way("src_account", "dst_account"), *([way("dst_account", "src_account")] if both_ways else [])]
    weights = cut_lineage(edges.select(F.explode(F.array(*ways)).alias("e")).select("e.*").groupBy("s", "d").agg(F.count(F.lit(1)).alias("w")))
    out, current = features.select("account_id", *columns), list(columns)
    for i in range(1, rounds + 1):
        names = [f"{c}_hop{i}" for c in columns]
        sums = [(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(n) for c, n in zip(current, names)]
        means = (weights.join(out.select("account_id", *current), F.col("s") == F.col("account_id"))
                 .groupBy(F.col("d").alias("account_id")).agg(*sums))
        out = out.join(means, "account_id", "left").na.fill(0.0, names)
        current = names
    return out


def fan_in_rings(ledger: DataFrame, n: int = 3) -> DataFrame:
    pairs = ledger.select("src_account", "dst_account").distinct()
    return (pairs.groupBy(F.col("dst_account").alias("account_id")).agg(F.count(F.lit(1)).alias("sources"))
            .filter(F.col("sources") >= n))


def case_convergence(attached: DataFrame, n: int = 2) -> DataFrame:
    """Accounts of one case fed by several distinct sources."""
    pairs = attached.select("complaint_id", "src_account", "dst_account").distinct()
    return (pairs.groupBy("complaint_id", F.col("dst_account").alias("account_id")).agg(F.count(F.lit(1)).alias("sources"))
            .filter(F.col("sources") >= n))


def hop_profile(attached: DataFrame) -> DataFrame:
    from .distribution import exact_quantiles

    base = attached.groupBy("hop_depth").agg(F.count(F.lit(1)).alias("transfers"), F.sum("is_terminal").cast("long").alias("terminals"))
    median = exact_quantiles(attached, ["hop_depth"], "amount", [0.5]).select("hop_depth", F.col("q")[0].alias("median_amount"))
    return base.join(median, "hop_depth")


def fan_out_profile(attached: DataFrame) -> DataFrame:
    """Histogram: how many (case, source) pairs pay how many distinct receivers."""
    pairs = attached.select("complaint_id", "src_account", "dst_account").distinct()
    return (pairs.groupBy("complaint_id", "src_account").agg(F.count(F.lit(1)).alias("fan_out"))
            .groupBy("fan_out").agg(F.count(F.lit(1)).alias("sources")))


def multi_hop_share(attached: DataFrame) -> DataFrame:
    depths = attached.select("complaint_id", "hop_depth").distinct().groupBy("complaint_id").agg(F.count(F.lit(1)).alias("d"))
    return depths.agg(F.count(F.lit(1)).alias("complaints"), F.avg((F.col("d") >= 2).cast("double")).alias("multi_hop_share"))


def terminal_recall(attached: DataFrame) -> DataFrame:
    """Share of labelled terminals that are leaves of their own case."""
    labelled = attached.filter(F.col("is_terminal") == 1).select("complaint_id", F.col("dst_account").alias("account_id")).distinct()
    found = labelled.join(leaves(attached, ["complaint_id"]), ["complaint_id", "account_id"], "left_semi")
    return (labelled.agg(F.count(F.lit(1)).alias("labelled")).withColumn("found", found.agg(F.count(F.lit(1))).scalar())
            .withColumn("recall", F.col("found") / F.col("labelled")))


def case_nodes(attached: DataFrame, complaints: DataFrame, accounts: DataFrame, risk: DataFrame) -> DataFrame:
    """Accounts of every case with role, hop, amount and risk, as first seen in load order.

    The victim is always there. A transfer's hop belongs to its destination; its source sits
    one hop upstream and shows no amount.
    """
    position = F.col("txn_id") * 2
    src = attached.select("complaint_id", F.col("src_account").alias("account_id"), position.alias("pos"),
                          F.greatest(F.col("hop_depth") - 1, F.lit(0)).alias("hop"), F.lit(0.0).alias("amount"))
    dst = attached.select("complaint_id", F.col("dst_account").alias("account_id"), (position + 1).alias("pos"),
                          F.col("hop_depth").alias("hop"), "amount")
    seen = (src.unionByName(dst).groupBy("complaint_id", "account_id")
            .agg(F.min_by(F.struct("pos", "hop", "amount"), F.col("pos")).alias("s")).select("complaint_id", "account_id", "s.*"))
    ends = (attached.filter(F.col("is_terminal") == 1).select("complaint_id", F.col("dst_account").alias("account_id")).distinct()
            .withColumn("is_terminal", F.lit(True)))
    have = attached.select("complaint_id").distinct()
    victims = (complaints.select(F.col("ticket_id").alias("complaint_id"), F.col("victim_account").alias("account_id"), "stolen_amount")
               .join(have, "complaint_id", "left_semi"))
    others = (seen.join(victims.select("complaint_id", "account_id"), ["complaint_id", "account_id"], "left_anti")
              .join(ends, ["complaint_id", "account_id"], "left").na.fill(False, ["is_terminal"])
              .withColumn("is_victim", F.lit(False)))
    heads = victims.select("complaint_id", "account_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("hop"),
                           F.col("stolen_amount").alias("amount"), F.lit(False).alias("is_terminal"), F.lit(True).alias("is_victim"))
    from ..functions.text import role_label

    return (others.unionByName(heads).join(accounts.select("account_id", "bank_id", "lat", "lon"), "account_id", "left")
            .join(risk.select("account_id", "risk"), "account_id", "left")
            .select("complaint_id", "account_id", "pos", role_label(F.col("hop"), F.col("is_terminal"), F.col("is_victim")).alias("role"),
                    "hop", "amount", "bank_id", F.coalesce("lat", F.lit(20.5937)).alias("lat"), F.coalesce("lon", F.lit(78.9629)).alias("lon"),
                    F.when(F.col("is_victim"), 0.0).otherwise(F.round(F.coalesce("risk", F.lit(0.0)), 4)).alias("risk_score")))


def case_edges(attached: DataFrame) -> DataFrame:
    """First transfer per (case, src, dst)."""
    rest = ["txn_id", "amount", "ts_s", "hop_depth", "is_terminal"]
    return (attached.groupBy("complaint_id", "src_account", "dst_account")
            .agg(F.min_by(F.struct(*rest), F.col("txn_id")).alias("e")).select("complaint_id", "src_account", "dst_account", "e.*"))
