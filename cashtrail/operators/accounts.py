"""Per-account behaviour measured from the ledger, and the complaint-side aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .distribution import exact_quantiles, forward_counts, next_event, previous_in_time

CENSORED_DWELL_S = 120 * 24 * 3600.0
BURST_S = 300
NIGHT_HOURS = (23, 0, 1, 2, 3, 4)
OBSERVATION_DAYS = 120
RECENT_S = 3600
#: an account with more transfer sides than this is measured in blocks, any other in one sorted run
BUSY_SIDES = 100_000
HALF_LIFE_DAYS = 30.0


def accounts_seen(ledger: DataFrame) -> DataFrame:
    return (ledger.select(F.col("src_account").alias("account_id"))
            .union(ledger.select(F.col("dst_account").alias("account_id"))).distinct())


def account_totals(ledger: DataFrame) -> DataFrame:
    """Sums, counts and distinct counterparties per account, both directions.

    Transfers are folded to one row per (src, dst) pair first, so the distinct counts are
    plain counts and a hot account meets its counterparties pre-aggregated.
    """
    pairs = ledger.groupBy("src_account", "dst_account").agg(F.sum("amount").alias("amt"), F.count(F.lit(1)).alias("n"))
    return _totals(pairs, pairs)


def _totals(received: DataFrame, sent: DataFrame) -> DataFrame:
    got = received.groupBy(F.col("dst_account").alias("account_id")).agg(
        F.sum("amt").alias("total_received"), F.sum("n").alias("in_degree"), F.count(F.lit(1)).alias("distinct_senders"))
    gave = sent.groupBy(F.col("src_account").alias("account_id")).agg(
        F.sum("amt").alias("total_sent"), F.sum("n").alias("out_degree"), F.count(F.lit(1)).alias("distinct_receivers"))
    return (got.join(gave, "account_id", "full_outer").na.fill(0)
            .withColumn("avg_txn_amount", F.when(F.col("in_degree") > 0, F.col("total_received") / F.col("in_degree")).otherwise(0.0)))


def night_ratio(ledger: DataFrame) -> DataFrame:
    hour = F.floor(F.pmod(F.col("ts_s"), F.lit(86400)) / 3600)
    return (ledger.groupBy(F.col("src_account").alias("account_id"))
            .agg(F.avg(F.when(hour.isin(*NIGHT_HOURS), 1.0).otherwise(0.0)).alias("night_txn_ratio")))


def dwell_gaps(ledger: DataFrame) -> DataFrame:
    """(account_id, ts_s, credits, gap_s): time from a credit to the next debit at or after it."""
    marks = (ledger.select(F.col("dst_account").alias("account_id"), "ts_s", F.lit(1).alias("credits"), F.lit(None).cast("long").alias("debit_s"))
             .unionAll(ledger.select(F.col("src_account").alias("account_id"), "ts_s", F.lit(0), F.col("ts_s")))
             .groupBy("account_id", "ts_s").agg(F.sum("credits").alias("credits"), F.max("debit_s").alias("debit_s")))
    return (next_event(marks, ["account_id"], "ts_s", "debit_s", "next_debit_s")
            .filter((F.col("credits") > 0) & F.col("next_debit_s").isNotNull())
            .select("account_id", "ts_s", "credits", (F.col("next_debit_s") - F.col("ts_s")).alias("gap_s")))


def median_dwell(ledger: DataFrame) -> DataFrame:
    return (exact_quantiles(dwell_gaps(ledger), ["account_id"], "gap_s", [0.5], weight="credits")
            .select("account_id", F.col("q")[0].alias("median_dwell_seconds")))


def burst_5min(ledger: DataFrame) -> DataFrame:
    return (forward_counts(ledger.withColumnRenamed("src_account", "account_id"), ["account_id"], "ts_s", BURST_S)
            .groupBy("account_id").agg(F.max("in_window").alias("burst_out_5min")))


def max_hop(ledger: DataFrame) -> DataFrame:
    return (ledger.filter(F.col("is_fraud") == 1).groupBy(F.col("dst_account").alias("account_id"))
            .agg(F.max("hop_depth").alias("hop_depth")))


MOVED = ["src_account", "dst_account", "amount", "ts_s", "hop_depth", "is_fraud"]


def moved(ledger: DataFrame) -> DataFrame:
    """The columns that behaviour is measured from, written once: a ledger may be a costly view."""
    return cut_lineage(ledger.select(*MOVED))


def _sides(moves: DataFrame) -> DataFrame:
    """Two rows per transfer, one for either account, where there is one."""
    def side(account: str, other: str, credit: bool):
        return F.struct(F.col(account).alias("account_id"), F.col(other).alias("other"), F.lit(credit).alias("credit"))

    both = F.explode(F.array(side("dst_account", "src_account", True), side("src_account", "dst_account", False))).alias("s")
    return moves.select("amount", "ts_s", "hop_depth", "is_fraud", both).select("s.*", "amount", "ts_s", "hop_depth", "is_fraud").filter("account_id is not null")


def _measured_in_runs(sides: DataFrame) -> DataFrame:
    """All measures of accounts of bounded size: rows go to their account once and are read in falling time order."""
    back = Window.partitionBy("account_id").orderBy(F.desc("ts_s"))
    credit, debit = F.col("credit"), ~F.col("credit")
    next_debit = F.min(F.when(debit, F.col("ts_s"))).over(back.rangeBetween(Window.unboundedPreceding, 0))
    in_window = F.sum(debit.cast("long")).over(back.rangeBetween(-BURST_S, 0))
    hour = F.floor(F.pmod(F.col("ts_s"), F.lit(86400)) / 3600)
    rows = sides.withColumns({"gap_s": F.when(credit, next_debit - F.col("ts_s")), "in_window": F.when(debit & F.col("ts_s").isNotNull(), in_window)})

    def distinct(side):
        return (F.size(F.collect_set(F.when(side, F.col("other")))) + F.max(F.when(side & F.col("other").isNull(), 1).otherwise(0))).cast("long")

    sent = F.count(F.when(debit, 1))
    return (rows.groupBy("account_id").agg(
        F.sum(F.when(credit, F.col("amount"))).alias("total_received"), F.count(F.when(credit, 1)).alias("in_degree"), distinct(credit).alias("distinct_senders"),
        F.sum(F.when(debit, F.col("amount"))).alias("total_sent"), sent.alias("out_degree"), distinct(debit).alias("distinct_receivers"),
        F.when(sent > 0, F.sum(F.when(debit & hour.isin(*NIGHT_HOURS), 1.0).otherwise(0.0)) / sent).alias("night_txn_ratio"),
        F.percentile("gap_s", F.lit(0.5)).alias("median_dwell_seconds"), F.max("in_window").alias("burst_out_5min"),
        F.max(F.when(credit & (F.col("is_fraud") == 1), F.col("hop_depth"))).alias("hop_depth")).na.fill(0, ["total_received", "total_sent"])
        .withColumn("avg_txn_amount", F.when(F.col("in_degree") > 0, F.col("total_received") / F.col("in_degree")).otherwise(0.0)))


def _measured_in_blocks(moves: DataFrame) -> DataFrame:
    """The same measures without ever holding an account's rows in one task."""
    pairs = moves.groupBy("src_account", "dst_account").agg(F.sum("amount").alias("amt"), F.count(F.lit(1)).alias("n"))
    totals = _totals(pairs.filter("dst_account is not null"), pairs.filter("src_account is not null"))
    parts = [totals, night_ratio(moves), median_dwell(moves), burst_5min(moves), max_hop(moves)]
    return reduce(lambda left, right: left.join(right, "account_id", "left"), parts)


def measured(moves: DataFrame, busy_sides: int = BUSY_SIDES) -> DataFrame:
    """Every measure of ``account_features`` per account of the written ``moves``. Where the line of busy accounts is drawn changes speed, never the result."""
    sides = _sides(moves)
    busy = cut_lineage(sides.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > busy_sides).select("account_id"))
    found = _measured_in_runs(sides)
    if not busy.isEmpty():
        theirs = [busy.select(F.col("account_id").alias(c), F.lit(True).alias(f"__{c}")) for c in ("src_account", "dst_account")]
        touched = moves.join(theirs[0], "src_account", "left").join(theirs[1], "dst_account", "left").filter("__src_account or __dst_account").select(*MOVED)
        blocks = _measured_in_blocks(cut_lineage(touched)).join(busy, "account_id", "left_semi")
        found = _measured_in_runs(sides.join(busy, "account_id", "left_anti")).unionByName(blocks)
    unnamed = moves.filter("src_account is null or dst_account is null")
    if unnamed.isEmpty():
        return found
    # a null account counts under id 0 in the totals, as in ``account_totals``
    found = cut_lineage(found)
    pairs = unnamed.groupBy("src_account", "dst_account").agg(F.sum("amount").alias("amt"), F.count(F.lit(1)).alias("n"))
    totals = _totals(pairs.filter("dst_account is null"), pairs.filter("src_account is null"))
    return found.unionByName(totals.join(found.drop(*[c for c in totals.columns if c != "account_id"]), "account_id", "left"))


def account_features(ledger: DataFrame, accounts: DataFrame, written: bool = False) -> DataFrame:
    """The measured feature table: every account that moved money. ``written``: the ledger is one that ``moved`` gave."""
    joined = measured(ledger if written else moved(ledger))
    through = F.col("total_sent") / F.col("total_received")
    return (joined.join(accounts, "account_id").select(
        "account_id", "bank_id", "city", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        "total_received", "total_sent", F.col("in_degree").alias("txn_count_24h"), F.round("avg_txn_amount", 2).alias("avg_txn_amount"),
        "in_degree", "out_degree", "distinct_senders", "distinct_receivers",
        F.round(F.coalesce("median_dwell_seconds", F.lit(CENSORED_DWELL_S)), 1).alias("median_dwell_seconds"),
        F.when(F.col("total_received") > 0, F.round(F.least(F.lit(3.0), F.greatest(F.lit(0.0), through)), 4)).otherwise(0.0).alias("passthrough_ratio"),
        "account_age_days", F.round(F.coalesce("night_txn_ratio", F.lit(0.0)), 4).alias("night_txn_ratio"),
        F.coalesce("burst_out_5min", F.lit(1)).alias("burst_out_5min"), "is_mule_label",
        F.coalesce("hop_depth", F.lit(0)).alias("hop_depth")))


FEATURE_COLUMNS = ("total_received", "total_sent", "avg_txn_amount", "in_degree", "out_degree", "distinct_senders",
                   "distinct_receivers", "median_dwell_seconds", "passthrough_ratio", "account_age_days",
                   "night_txn_ratio", "burst_out_5min")


def derive_ratios(features: DataFrame) -> DataFrame:
    days = F.least(F.col("account_age_days").cast("double"), F.lit(float(OBSERVATION_DAYS)))
    return (features.withColumn("dwell_log", F.log1p("median_dwell_seconds"))
            .withColumn("activity_per_day", (F.col("txn_count_24h") + F.col("distinct_receivers")) / (days + 1.0))
            .withColumn("in_out_amount_ratio", F.col("total_sent") / (F.col("total_received") + 1.0))
            .withColumn("avg_amount_per_credit", F.col("total_received") / (F.col("txn_count_24h") + 1.0))
            .withColumn("counterparty_concentration", F.col("txn_count_24h") / (F.col("distinct_receivers") + 1.0)))


def _recent_window(ledger: DataFrame) -> DataFrame:
    """Per account: rows and span of the last hour of activity; a self transfer counts on both sides."""
    sides = (ledger.select(F.col("src_account").alias("account_id"), "ts_s", (F.col("src_account") == F.col("dst_account")).alias("self"))
             .unionAll(ledger.select(F.col("dst_account"), "ts_s", F.lit(False)))
             .groupBy("account_id", "ts_s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("self").cast("int")).alias("selfs")))
    latest = sides.groupBy("account_id").agg(F.max("ts_s").alias("latest"))
    return (sides.join(latest, "account_id").filter(F.col("ts_s") >= F.col("latest") - RECENT_S)
            .groupBy("account_id").agg(F.sum("n").alias("n_sides"), F.sum(F.col("n") - F.col("selfs")).alias("n_rows"),
                                       ((F.max("ts_s") - F.min("ts_s")) / 60.0).alias("span_min")))


def recent_rate(ledger: DataFrame) -> DataFrame:
    """Transfers per minute in the last hour; a zero span gives the count, a lone transfer gives 0."""
    return _recent_window(ledger).select("account_id", F.when(F.col("n_rows") <= 1, 0.0).when(
        F.col("span_min") == 0, F.col("n_rows").cast("double")).otherwise(F.col("n_rows") / F.col("span_min")).alias("recent_rate"))


def account_velocity(ledger: DataFrame) -> DataFrame:
    """Bulk form: the span is floored at 0.1 minute and both sides of a self transfer count."""
    return _recent_window(ledger).select("account_id", F.when(F.col("n_sides") <= 1, 0.0).otherwise(
        F.col("n_sides") / F.greatest(F.lit(0.1), F.col("span_min"))).alias("velocity"))


def transfer_gaps(attached: DataFrame) -> DataFrame:
    """(complaint_id, gap_s, weight) of consecutive transfers; transfers of one second give zero gaps."""
    seconds = attached.groupBy("complaint_id", "ts_s").agg(F.count(F.lit(1)).alias("n"))
    stepped = previous_in_time(seconds, ["complaint_id"], "ts_s", "prev_s")
    steps = stepped.filter(F.col("prev_s").isNotNull()).select("complaint_id", (F.col("ts_s") - F.col("prev_s")).alias("gap_s"), F.lit(1).cast("long").alias("weight"))
    ties = stepped.filter(F.col("n") > 1).select("complaint_id", F.lit(0).cast("long").alias("gap_s"), (F.col("n") - 1).alias("weight"))
    return steps.unionByName(ties)


def chain_timing(attached: DataFrame) -> DataFrame:
    """Median gap, fastest gap and span of every traced chain, zeros below two transfers."""
    gaps = transfer_gaps(attached)
    median = exact_quantiles(gaps, ["complaint_id"], "gap_s", [0.5], weight="weight").select("complaint_id", F.col("q")[0].alias("median_gap_s"))
    fastest = gaps.groupBy("complaint_id").agg(F.min("gap_s").cast("double").alias("min_gap_s"))
    span = attached.groupBy("complaint_id").agg((F.max("ts_s") - F.min("ts_s")).cast("double").alias("span_s"))
    return span.join(median, "complaint_id", "left").join(fastest, "complaint_id", "left").na.fill(0.0, ["median_gap_s", "min_gap_s"])


def minutes_from_first(attached: DataFrame) -> DataFrame:
    first = attached.groupBy("complaint_id").agg(F.min("ts_s").alias("first_s"))
    return attached.join(first, "complaint_id").withColumn("minutes_from_first", F.round((F.col("ts_s") - F.col("first_s")) / 60.0, 2)).drop("first_s")


def cashouts(ledger: DataFrame) -> DataFrame:
    return ledger.filter((F.col("is_terminal") == 1) & F.col("cashout_atm_id").isNotNull())


def recurring_cashpoints(attached: DataFrame, directory: DataFrame, limit: int = 25) -> DataFrame:
    """Machines that keep coming back, by distinct complaints.

    Cash-outs fold to one row per (machine, complaint) before the machine total, so one
    machine with a third of all rows is summed from partial results.
    """
    per_case = (cashouts(attached).groupBy(F.col("cashout_atm_id").alias("atm_id"), "complaint_id")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amt"), F.max("ts_s").alias("last_s")))
    stats = per_case.groupBy("atm_id").agg(
        F.sum("n").alias("cashouts"), F.count(F.lit(1)).alias("distinct_complaints"),
        F.sum("amt").alias("total_amount"), F.max("last_s").alias("last_seen_s"))
    top = stats.orderBy(F.desc("distinct_complaints"), F.desc("cashouts"), "atm_id").limit(limit)
    return with_directory(top, directory)


def with_directory(stats: DataFrame, directory: DataFrame) -> DataFrame:
    names = directory.select("atm_id", "bank_id", "city", "district", "state", "lat", "lon", F.col("risk").alias("cashout_risk_score"))
    return (stats.join(names, "atm_id", "left").na.fill("", ["city", "district", "state"])
            .na.fill(0.0, ["lat", "lon", "cashout_risk_score"]))


def decayed_prior(outs: DataFrame, membership: DataFrame, as_of_s: int) -> DataFrame:
    """Share of decayed historical rupees per cell. Unknown or future times count as fresh."""
    age = F.greatest(F.lit(0.0), F.coalesce((F.lit(as_of_s) - F.col("ts_s")) / 86400.0, F.lit(0.0)))
    raw = (outs.select(F.col("cashout_atm_id").alias("atm_id"), "amount", age.alias("age"))
           .join(membership.select("atm_id", "cell"), "atm_id")
           .groupBy("cell").agg(F.sum(F.coalesce("amount", F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("age") / HALF_LIFE_DAYS)).alias("w")))
    total = raw.agg(F.sum("w")).scalar()
    return raw.filter(total > 0).select("cell", (F.col("w") / total).alias("share"))


def city_state_vote(*tables: DataFrame) -> DataFrame:
    """Majority state per normalised city over several (city, state) tables, with the conflict count."""
    rows = reduce(DataFrame.unionByName, [t.select("city", "state") for t in tables])
    key = F.lower(F.trim(F.regexp_replace("city", r"\s+", " ")))
    votes = (rows.withColumn("city_key", key).filter((F.col("city_key") != "") & (F.coalesce("state", F.lit("")) != ""))
             .groupBy("city_key", "state").agg(F.count(F.lit(1)).alias("votes")))
    return (votes.groupBy("city_key").agg(
        F.min_by("state", F.struct((-F.col("votes")).alias("v"), F.col("state"))).alias("state"),
        F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("states_seen"))
        .withColumn("conflict", F.col("states_seen") > 1))


def city_contribution(named: dict[str, DataFrame]) -> DataFrame:
    """Cities per source table and how many only that table has."""
    parts = [t.select(F.lit(name).alias("source"), F.lower(F.trim("city")).alias("city_key")).distinct() for name, t in named.items()]
    rows = reduce(DataFrame.unionByName, parts).filter(F.col("city_key") != "")
    only = rows.groupBy("city_key").agg(F.count(F.lit(1)).alias("sources"), F.min("source").alias("source"))
    unique = only.filter(F.col("sources") == 1).groupBy("source").agg(F.count(F.lit(1)).alias("unique_cities"))
    return (rows.groupBy("source").agg(F.count(F.lit(1)).alias("cities")).join(unique, "source", "left")
            .na.fill(0, ["unique_cities"]))
