"""Candidate machines of a terminal account, their ranking columns and the training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..session import cut_lineage
from . import accounts as acct
from . import spatial
from .distribution import value_at_rank
from .graph import CREW_HOPS, trace, undirected
from .nearness import crew_sums, within_three
from .packed import ACCOUNTS_A_TASK, Accounts, Packed

HISTORY_FRACTION = 0.50
DENSITY_KM, HOTSPOT_KM = 3.0, 5.0
DEFAULT_AMOUNT, CENTROID, DEFAULT_HOP, DEFAULT_KEEP = 100000.0, (20.5937, 78.9629), 3, 0.7
NO_SAME_BANK_KM = 999.0
MAX_HUBS, HUB_DEGREE = 16, 100_000


def _numeric_id(df: DataFrame, column: str) -> Column:
    """The id itself when it is a number, else its hash: a total order either way."""
    return F.col(column) if isinstance(df.schema[column].dataType, T.NumericType) else F.xxhash64(column)


def history_complaints(complaints: DataFrame, fraction: float = HISTORY_FRACTION) -> DataFrame:
    """(complaint_id) of the earliest int(fraction * n) complaints, ties by id, without a global sort."""
    rows = complaints.select(F.col("ticket_id").alias("complaint_id"), "filed_s", _numeric_id(complaints, "ticket_id").alias("tie"))
    cut = F.floor(F.lit(fraction) * F.col("t"))
    edge_s = value_at_rank(rows, "filed_s", cut)
    marked = rows.withColumn("edge_s", edge_s)
    same = marked.filter(F.col("filed_s") == F.col("edge_s"))
    n_all = rows.agg(F.floor(F.lit(fraction) * F.count(F.lit(1))).cast("long")).scalar()
    n_before = marked.filter(F.col("filed_s") < F.col("edge_s")).agg(F.count(F.lit(1))).scalar()
    edge_tie = value_at_rank(same, "tie", n_all - n_before)
    # no edge at all: the fraction takes in every complaint
    early = F.col("edge_s").isNull() | (F.col("filed_s") < F.col("edge_s")) | ((F.col("filed_s") == F.col("edge_s")) & (F.col("tie") < edge_tie))
    return marked.filter(early).select("complaint_id")


def split_history(df: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.join(history, "complaint_id", "left_semi"), df.join(history, "complaint_id", "left_anti")


def cashout_priors(attached: DataFrame, history: DataFrame, directory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Past cash-outs per machine, and per (account, machine), over history complaints only."""
    past = (acct.cashouts(attached).join(history, "complaint_id", "left_semi")
            .groupBy(F.col("dst_account").alias("account_id"), F.col("cashout_atm_id").alias("atm_id"))
            .agg(F.count(F.lit(1)).alias("n")).join(directory.select("atm_id"), "atm_id", "left_semi"))
    return past.groupBy("atm_id").agg(F.sum("n").alias("atm_prior")), past


def crew_prior(targets: DataFrame, edges: DataFrame, past: DataFrame, hops: int = CREW_HOPS,
               hub_degree: int = HUB_DEGREE) -> DataFrame:
    """Past cash-outs at a candidate machine by accounts within three transfers of the terminal account.

    ``targets``: (account_id, atm_id); ``edges`` and ``past``: written tables, which are read several times. Asking "is this past user of that
    machine near this account" keeps the work to candidate machines. Tasks hold the links as lists and sum the crews of their accounts one after
    the other (``crew_sums``). Accounts next to a hub (a third of all transfers may touch one account) take the hub's
    summed surroundings in one step and only the rest is tested pair by pair (``within_three``); this is also the way for more accounts than a
    task may mark. The number of hubs treated so only changes speed, never the result.
    """
    if hops != 3:
        raise ValueError("the crew is defined by three transfers")
    ends = edges.select(F.col("src_account").alias("account_id")).union(edges.select("dst_account"))
    accounts = Accounts(ends.union(targets.select("account_id")).union(past.select("account_id")), edges.agg(F.count(F.lit(1))).head()[0])
    if accounts.size <= ACCOUNTS_A_TASK:
        pairs = accounts.number(edges.select("src_account", "dst_account").filter("src_account <> dst_account"), t="src_account", s="dst_account")
        packed = Packed(pairs.select(F.explode(F.array(F.struct("t", "s"), F.struct(F.col("s").alias("t"), F.col("t").alias("s")))).alias("p")).select("p.*"))
        hubs = packed.degrees().filter(F.col("n") >= hub_degree)
        hubs = accounts.named(hubs.withColumnRenamed("t", "account")).select(F.col("account_id").alias("hub"), F.col("n").alias("degree"))
    else:
        packed = None
        hubs = undirected(edges).groupBy(F.col("a").alias("hub")).agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") >= hub_degree)
    hub_ids = [r.hub for r in hubs.orderBy(F.desc("degree"), "hub").limit(MAX_HUBS).collect()]  # MAX_HUBS rows at most
    if packed and not hub_ids:
        return _summed_crews(targets, past, packed, accounts)

    targets = targets.select("account_id", "atm_id").distinct()
    links = cut_lineage(undirected(edges))
    if not hub_ids:
        return _near_pairs(targets.join(past.select(F.col("account_id").alias("b"), "atm_id", "n"), "atm_id"), links, None)

    both = links.select(F.col("a").alias("src_account"), F.col("b").alias("dst_account"))
    starts = links.filter(F.col("a").isin(hub_ids)).select(F.col("a").alias("trace_id"), F.col("a").alias("account_id")).distinct()
    reach = (trace(starts, both, 2)
             .select(F.col("trace_id").alias("hub"), "account_id", "depth"))
    by_hub = reach.join(past, "account_id").groupBy("hub", "atm_id").agg(F.sum("n").alias("hub_n"))
    my_hub = reach.filter("depth <= 1").groupBy("account_id").agg(F.min("hub").alias("hub"))
    placed = targets.join(my_hub, "account_id", "left")
    taken = placed.join(by_hub, ["hub", "atm_id"]).select("account_id", "atm_id", F.col("hub_n").alias("n"))
    # past users a hub does not already cover; hubs number at most MAX_HUBS
    rest = (past.withColumn("hub", F.explode(F.array(*[F.lit(h) for h in hub_ids]))).join(reach.select("hub", "account_id"), ["hub", "account_id"], "left_anti")
            .select("hub", F.col("account_id").alias("b"), "atm_id", "n"))
    free = placed.filter(F.col("hub").isNull()).drop("hub").join(past.select(F.col("account_id").alias("b"), "atm_id", "n"), "atm_id")
    asked = placed.filter(F.col("hub").isNotNull()).join(rest, ["hub", "atm_id"]).drop("hub").unionByName(free)
    near = _near_pairs(asked, links, reach)
    return (taken.unionByName(near.withColumnRenamed("crew_prior", "n")).groupBy("account_id", "atm_id")
            .agg(F.sum("n").alias("crew_prior")))


def _summed_crews(targets: DataFrame, past: DataFrame, links: Packed, accounts: Accounts) -> DataFrame:
    """``crew_prior`` where no account is a hub."""
    whole = isinstance(past.schema["atm_id"].dataType, T.IntegralType) and isinstance(targets.schema["atm_id"].dataType, T.IntegralType)
    if whole:
        def numbered(df):
            return accounts.number(df, account="account_id").withColumn("machine", F.col("atm_id").cast("long"))
    else:
        machines = Accounts(past.select(F.col("atm_id").alias("account_id")), 0)

        def numbered(df):
            return machines.number(accounts.number(df, account="account_id"), machine="atm_id").withColumn("machine", F.col("machine").cast("long"))

    asked, used = (numbered(df).filter("account is not null and machine is not null") for df in (targets.select("account_id", "atm_id"), past.select("account_id", "atm_id", "n")))
    sums = cut_lineage(accounts.named(crew_sums(asked, used, links, accounts)))
    if whole:
        return sums.select("account_id", F.col("machine").cast(past.schema["atm_id"].dataType).alias("atm_id"), "crew_prior")
    return machines.named(sums.withColumnRenamed("account_id", "who").withColumnRenamed("machine", "account")).select(F.col("who").alias("account_id"), F.col("account_id").alias("atm_id"), "crew_prior")


def _near_pairs(asked: DataFrame, links: DataFrame, reach: DataFrame | None) -> DataFrame:
    """Sum of n over the (account, past user) pairs that are at most three links apart."""
    asked = cut_lineage(asked.select(F.col("account_id").alias("a"), "b", "atm_id", "n"))
    pairs, plain = asked.select("a", "b"), links
    if reach is not None:
        # ways over a hub are told by its surroundings, so the others need not step on one
        plain = links.join(reach.select(F.col("hub").alias("b")).distinct(), "b", "left_anti")
    close = within_three(pairs, plain)
    if reach is not None:
        ra = reach.select("hub", F.col("account_id").alias("a"), F.col("depth").alias("da"))
        rb = reach.select("hub", F.col("account_id").alias("b"), F.col("depth").alias("db"))
        by_hub = pairs.distinct().join(ra, "a").join(rb, ["b", "hub"]).filter("da + db <= 3").select("a", "b")
        close = close.select("a", "b").union(by_hub).distinct()
    return (asked.join(close, ["a", "b"], "left_semi").groupBy(F.col("a").alias("account_id"), "atm_id").agg(F.sum("n").alias("crew_prior")))


def candidate_sets(terminals: DataFrame, directory: DataFrame, k: int = spatial.CANDIDATES) -> DataFrame:
    """K nearest machines of every account: distance, rank and ratio to the nearest.

    Accounts at one place share one search.
    """
    near = spatial.nearest_k(terminals, directory, k)
    nearest = F.greatest(F.first("dist_km").over(Window.partitionBy("lat", "lon").orderBy("rank")), F.lit(1e-6))
    near = near.withColumn("dist_ratio", F.col("dist_km") / nearest)
    return terminals.join(near, ["lat", "lon"])


def candidate_columns(cands: DataFrame, directory: DataFrame, atm_prior: DataFrame | None = None,
                      crew: DataFrame | None = None) -> DataFrame:
    """The twelve candidate columns on (account_id, atm_id) rows."""
    density = spatial.count_within(directory, directory, DENSITY_KM, "density_3km")
    machines = (directory.select("atm_id", F.col("bank_id").alias("atm_bank"), "risk", "fraud_count", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
                .join(density.select(F.col("lat").alias("mlat"), F.col("lon").alias("mlon"), "density_3km"), ["mlat", "mlon"]).drop("mlat", "mlon"))
    out = cands.join(machines, "atm_id")
    out = out.join(atm_prior, "atm_id", "left") if atm_prior is not None else out.withColumn("atm_prior", F.lit(0))
    out = out.join(crew, ["account_id", "atm_id"], "left") if crew is not None else out.withColumn("crew_prior", F.lit(0))
    seen = F.coalesce(F.col("crew_prior"), F.lit(0))
    return (out.withColumn("dist_rank", F.col("rank") - 1).withColumn("log_fraud", F.log1p("fraud_count"))
            .withColumn("same_bank", (F.col("atm_bank") == F.col("bank_id")).cast("double"))
            .withColumn("decay", F.exp(-F.col("dist_km") / 5.0))
            .withColumn("log_atm_prior", F.log1p(F.coalesce(F.col("atm_prior"), F.lit(0))))
            .withColumn("log_crew_prior", F.log1p(seen)).withColumn("crew_seen", (seen > 0).cast("double"))
            .withColumn("any_crew", F.max("crew_seen").over(Window.partitionBy("account_id")))
            .drop("atm_bank", "rank"))


def same_bank_nearest(accounts: DataFrame, directory: DataFrame) -> DataFrame:
    """Distance to the nearest machine of the own bank (999 if none) and whether it is the nearest of all.

    One search per bank keeps every search on grid keys; banks are a short code list.
    """
    nearest = spatial.nearest_k(accounts, directory, 1).select("lat", "lon", F.col("atm_id").alias("nearest_id"))
    own = nearest_in_group(accounts, directory, "bank_id")
    return (accounts.select("account_id", "bank_id", "lat", "lon").join(nearest, ["lat", "lon"], "left")
            .join(own, ["bank_id", "lat", "lon"], "left")
            .select("account_id", F.coalesce("own_km", F.lit(NO_SAME_BANK_KM)).alias("same_bank_km"),
                    F.coalesce((F.col("own_id") == F.col("nearest_id")).cast("int"), F.lit(0)).alias("is_same_bank")))


def nearest_in_group(queries: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """Nearest point of the same group for every distinct (group, place), by growing rings of grid cells.

    Every round doubles the ring; places that found a point closer than the ring's safe
    radius leave the loop, so dense places stop at once.
    """
    spots = (spatial.finite_points(points).groupBy(group, F.col("lat").alias("plat"), F.col("lon").alias("plon"))
             .agg(F.min("atm_id").alias("atm_id")))
    groups = spots.select(group).distinct()
    todo = cut_lineage(spatial.finite_points(queries).select(group, "lat", "lon").distinct().join(groups, group, "left_semi"))
    spots, done, km = cut_lineage(spots), None, 4.0
    while True:
        whole = km > geo.EARTH_KM * 3.2
        size = 400.0 if whole else km / geo.KM_PER_DEGREE
        asks = todo.withColumn("c", F.explode(geo.covering_cells("lat", "lon", min(km, 20020.0), size))).select(group, "lat", "lon", "c.gx", "c.gy")
        homes = spots.withColumn("gx", geo.grid_index("plat", size)).withColumn("gy", geo.grid_index("plon", size))
        hit = (asks.join(homes, [group, "gx", "gy"]).withColumn("own_km", geo.haversine_km("lat", "lon", "plat", "plon"))
               .filter(F.lit(whole) | (F.col("own_km") <= km)).groupBy(group, "lat", "lon")
               .agg(F.min(F.struct("own_km", "atm_id")).alias("m")).select(group, "lat", "lon", "m.own_km", F.col("m.atm_id").alias("own_id")))
        hit = cut_lineage(hit)
        done = hit if done is None else done.unionByName(hit)
        if whole:
            return done
        todo = cut_lineage(todo.join(hit, [group, "lat", "lon"], "left_anti"))
        if todo.isEmpty():
            return done
        km *= 4


def account_profile(accounts: DataFrame, ledger: DataFrame, directory: DataFrame) -> DataFrame:
    """The account part of the feature vector: velocity, position, three nearest machines, bank affinity."""
    near = spatial.nearest_k(accounts, directory, 3)
    dist = [F.max(F.when(F.col("rank") == i, F.col("dist_km"))).alias(f"dist_{i}") for i in (1, 2, 3)]
    first = F.max(F.when(F.col("rank") == 1, F.struct("plat", "plon"))).alias("p")
    wide = (near.groupBy("lat", "lon").agg(*dist, first)
            .withColumn("dist_2", F.coalesce("dist_2", F.col("dist_1") + 1.0)).withColumn("dist_3", F.coalesce("dist_3", F.col("dist_2") + 1.0)))
    x, y, z = geo.to_cartesian("lat", "lon")
    return (accounts.join(wide, ["lat", "lon"], "left").join(spatial.count_within(accounts, directory, HOTSPOT_KM, "hotspot_5km"), ["lat", "lon"], "left")
            .join(same_bank_nearest(accounts, directory), "account_id", "left")
            .join(acct.account_velocity(ledger), "account_id", "left").na.fill(0.0, ["velocity"])
            .withColumn("node_x", x).withColumn("node_y", y).withColumn("node_z", z)
            .withColumn("bearing_1", geo.bearing_deg("lat", "lon", "p.plat", "p.plon")).drop("p"))


def terminal_rows(attached: DataFrame, complaints: DataFrame, accounts: DataFrame) -> DataFrame:
    """Labelled terminal transfers with complaint amount and account attributes, every default applied."""
    amounts = complaints.select(F.col("ticket_id").alias("complaint_id"), "stolen_amount")
    place = accounts.select(F.col("account_id").alias("dst_account"), "bank_id", "lat", "lon")
    return (attached.filter(F.col("is_terminal") == 1).join(amounts, "complaint_id", "left").join(place, "dst_account", "left")
            .withColumn("stolen_amount", F.coalesce("stolen_amount", F.lit(DEFAULT_AMOUNT)))
            .withColumn("lat", F.coalesce("lat", F.lit(CENTROID[0]))).withColumn("lon", F.coalesce("lon", F.lit(CENTROID[1]))))


def ranking_set(attached: DataFrame, ledger: DataFrame, complaints: DataFrame, accounts: DataFrame, directory: DataFrame,
                features: DataFrame, risk: DataFrame | None = None, with_crew: bool = True) -> DataFrame:
    """One row per (terminal transfer outside history, candidate) with context, candidate columns and label. ``attached`` and ``ledger``: written tables."""
    history = cut_lineage(history_complaints(complaints))
    atm_prior, past = cashout_priors(attached, history, directory)
    rows = (terminal_rows(attached, complaints, accounts).join(history, "complaint_id", "left_anti")
            .join(directory.select(F.col("atm_id").alias("cashout_atm_id")), "cashout_atm_id", "left_semi"))
    people = rows.select(F.col("dst_account").alias("account_id"), "bank_id", "lat", "lon").distinct()
    cands = cut_lineage(candidate_sets(people, directory))
    crew = crew_prior(cands, ledger, cut_lineage(past)) if with_crew else None
    block = candidate_columns(cands, directory, atm_prior, crew).drop("lat", "lon", "bank_id", "plat", "plon")
    behaviour = features.select(F.col("account_id").alias("dst_account"), "hop_depth_max", *BEHAVIOUR) if "hop_depth_max" in features.columns else \
        features.select(F.col("account_id").alias("dst_account"), F.col("hop_depth").alias("hop_depth_max"), *BEHAVIOUR)
    probability = (risk.select(F.col("account_id").alias("dst_account"), "risk") if risk is not None else None)
    context = (rows.withColumn("hour_of_day", F.floor(F.pmod(F.col("ts_s"), F.lit(86400)) / 3600))
               # 1970-01-01 was a Thursday: Monday is day 0
               .withColumn("day_of_week", F.pmod(F.floor(F.col("ts_s") / 86400) + 3, F.lit(7)))
               .join(behaviour, "dst_account", "left").join(acct.account_velocity(ledger).withColumnRenamed("account_id", "dst_account"), "dst_account", "left")
               .join(acct.chain_timing(attached), "complaint_id", "left"))
    context = context.join(probability, "dst_account", "left") if probability is not None else context.withColumn("risk", F.lit(0.0))
    fill = {c: 0.0 for c in (*BEHAVIOUR, "velocity", "risk", "median_gap_s", "min_gap_s", "span_s")}
    context = context.na.fill(fill).select(
        "txn_id", "complaint_id", F.col("dst_account").alias("account_id"), "cashout_atm_id", "time_to_cashout_min", "lat", "lon", "bank_id",
        "stolen_amount", F.coalesce("hop_depth_max", F.lit(DEFAULT_HOP)).alias("hop_depth"), "velocity", "hour_of_day", "day_of_week",
        F.col("amount").alias("amount_after_split"), F.col("risk").alias("mule_probability"), *BEHAVIOUR,
        F.log1p("median_gap_s").alias("log_median_gap"), F.log1p("min_gap_s").alias("log_min_gap"), F.log1p("span_s").alias("log_span"))
    # told from the transfers before they meet their candidates: the rows of the result are not shuffled by transfer
    context = cut_lineage(context)
    reached = (context.select("txn_id", "account_id", F.col("cashout_atm_id").alias("atm_id"))
               .join(cands.select("account_id", "atm_id"), ["account_id", "atm_id"], "left_semi").select(F.col("txn_id").alias("hit")).distinct().withColumn("is_hit", F.lit(1)))
    context = (context.join(reached, F.col("txn_id").eqNullSafe(F.col("hit")), "left")
               .withColumn("truth_in_candidates", F.coalesce("is_hit", F.lit(0))).drop("hit", "is_hit"))
    chosen = (F.col("atm_id") == F.col("cashout_atm_id")).cast("int")
    rows = context.join(block, "account_id").withColumn("label", chosen)
    return rows.select(*[c for c in rows.columns if c != "truth_in_candidates"], "truth_in_candidates")


BEHAVIOUR = ("median_dwell_seconds", "account_age_days", "passthrough_ratio", "burst_out_5min", "night_txn_ratio")
CONTEXT_COLUMNS = ("stolen_amount", "hop_depth", "velocity", "hour_of_day", "day_of_week", "amount_after_split", "mule_probability",
                   *BEHAVIOUR, "log_median_gap", "log_min_gap", "log_span")
CANDIDATE_COLUMNS = ("dist_km", "dist_rank", "dist_ratio", "risk", "log_fraud", "same_bank", "density_3km", "decay",
                     "log_atm_prior", "log_crew_prior", "crew_seen", "any_crew")


def training_set(attached: DataFrame, ledger: DataFrame, complaints: DataFrame, accounts: DataFrame, directory: DataFrame,
                 embeddings: DataFrame | None = None) -> DataFrame:
    """Terminal-level rows with the true machine and its distance (unlabelled terminals are left out)."""
    truth = directory.select(F.col("atm_id").alias("cashout_atm_id"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    rows = terminal_rows(attached, complaints, accounts).join(truth, "cashout_atm_id")
    profile = account_profile(accounts, ledger, directory).drop("city", "state", "bank_id", "lat", "lon", "is_mule_label", "account_age_days")
    out = (rows.join(profile.withColumnRenamed("account_id", "dst_account"), "dst_account", "left")
           .withColumn("dist_to_atm_km", geo.haversine_km("lat", "lon", "alat", "alon")).drop("alat", "alon"))
    if embeddings is not None:
        out = out.join(embeddings.withColumnRenamed("account_id", "dst_account"), "dst_account", "left")
    return out
