"""Case records as append-only events: status, notes, trail, timeline, queue and dossier rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import accounts as acct
from . import graph
from .distribution import DAY_S, exact_quantiles, first_rows

HIGH_VALUE_FLOOR, GOLDEN_MIN = 100_000.0, 60


def canonical_city(df: DataFrame, states: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical_city`` (NULL when unknown) and ``directory_state``.

    The directory lists cities of a country; the optimizer broadcasts it when it is small.
    """
    names = (states.select(text.fold_name(F.col("city")).alias("key"), "city", F.lit(0).alias("p"))
             .unionByName(aliases.select(text.fold_name(F.col("alias")).alias("key"), "city", F.lit(1).alias("p"))))
    lookup = (names.groupBy("key").agg(F.min_by("city", F.struct("p", "city")).alias("canonical_city"))
              .join(states.select(F.col("city").alias("canonical_city"), F.col("state").alias("directory_state")), "canonical_city", "left"))
    return df.withColumn("key", text.fold_name(F.col("city"))).join(lookup, "key", "left").drop("key")


def authoritative_state(df: DataFrame) -> DataFrame:
    return df.withColumn("state", F.coalesce("directory_state", "state"))


def complaint_quality(df: DataFrame) -> DataFrame:
    """``reasons`` lists why a complaint is refused; empty means accepted, with city and state overwritten."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col("stolen_amount"), F.lit(0.0)) <= 0, "amount must be above zero"),
        F.when(F.col("canonical_city").isNull(), "city not recognised")))
    return (df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
            .withColumn("city", F.coalesce("canonical_city", "city")).withColumn("state", F.coalesce("directory_state", "state")))


def decorate_complaints(complaints: DataFrame, notes: DataFrame, states: DataFrame | None = None) -> DataFrame:
    counts = notes.groupBy(F.col("case_id").alias("ticket_id")).agg(F.count(F.lit(1)).alias("note_count"))
    out = complaints.join(counts, "ticket_id", "left").na.fill(0, ["note_count"]).withColumn("status", text.working_status(F.col("status")))
    if states is not None:
        out = out.join(states.select("city", F.col("state").alias("directory_state")), "city", "left").withColumn("state", F.coalesce("directory_state", "state")).drop("directory_state")
    return out


def newest_complaints(complaints: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return complaints.orderBy(F.desc("filed_s"), F.desc("ticket_id")).offset(offset).limit(limit)


def case_state(audit: DataFrame) -> DataFrame:
    """Latest valid status and assignee per case, with the number of changes."""
    valid = audit.filter(F.col("status").isin(*text.CASE_STATUSES))
    order = F.struct("at_s", "audit_no")
    return valid.groupBy("case_id").agg(F.max_by("status", order).alias("status"), F.max_by("actor", order).alias("assignee"),
                                        F.max("at_s").alias("updated_s"), F.count(F.lit(1)).alias("changes"))


def rejected_transitions(audit: DataFrame) -> DataFrame:
    return audit.filter(~F.col("status").isin(*text.CASE_STATUSES))


def latest_per_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    keep = [c for c in events.columns if c not in keys]
    return first_rows(events, keys, F.struct(*order), keep, "max")


def case_notes(notes: DataFrame) -> DataFrame:
    """Notes with their per-case number: ``NOTE-<case>-001``.

    A note's number is its position by turn. It is counted in blocks of turns, so a case
    with very many notes is spread over tasks.
    """
    block = F.floor(F.col("turn") / 10_000)
    blocked = notes.withColumn("__b", block)
    totals = blocked.groupBy("case_id", "__b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("case_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("case_id", "__b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("case_id", "__b").orderBy("turn", "author", "text")
    out = blocked.join(ahead, ["case_id", "__b"]).withColumn("note_no", F.col("ahead") + F.row_number().over(inside))
    digits = F.col("note_no").cast("string")
    padded = F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0"))
    return out.withColumn("note_id", F.concat(F.lit("NOTE-"), F.col("case_id").cast("string"), F.lit("-"), padded)).drop("__b", "ahead")


def money_trail(attached: DataFrame) -> DataFrame:
    """Every transfer of every case, never deduplicated, with elapsed minutes and amount text."""
    return acct.minutes_from_first(attached).withColumn("amount_text", text.rupee_text(F.col("amount")))


def case_timeline(complaints: DataFrame, attached: DataFrame, audit: DataFrame) -> DataFrame:
    """Typed events of two sections: what happened to the money, and what officers did."""
    columns = ["case_id", "section", "at_s", "kind", "ref", "amount"]
    none = F.lit(None).cast("double").alias("amount")
    report = complaints.select(F.col("ticket_id").alias("case_id"), F.lit("fraud").alias("section"), F.col("filed_s").alias("at_s"),
                               F.lit("report").alias("kind"), F.lit("reported").alias("ref"), F.col("stolen_amount").alias("amount"))
    moves = attached.select(F.col("complaint_id").alias("case_id"), F.lit("fraud").alias("section"), F.col("ts_s").alias("at_s"),
                            F.when(F.col("is_terminal") == 1, "cashout").otherwise("transfer").alias("kind"), F.col("txn_id").cast("string").alias("ref"), "amount")
    acts = audit.select("case_id", F.lit("activity").alias("section"), "at_s", F.col("action").alias("kind"), F.col("audit_no").cast("string").alias("ref"), none)
    return report.select(*columns).unionByName(moves.select(*columns)).unionByName(acts.select(*columns))


def detections(attached: DataFrame) -> DataFrame:
    """Flagged accounts of every case as rows: (complaint_id, detector, account_id)."""
    scope = ["complaint_id"]
    parts = [(graph.velocity_flags(attached, scope), "velocity"), (graph.split_flags(attached, scope), "fund_split"), (graph.leaves(attached, scope), "terminal_leaf")]
    return reduce(DataFrame.unionByName, [d.select("complaint_id", F.lit(name).alias("detector"), "account_id") for d, name in parts])


def detection_counts(attached: DataFrame) -> DataFrame:
    flags = detections(attached)
    n = [F.count(F.when(F.col("detector") == d, 1)).alias(f"{d}_count") for d in ("velocity", "fund_split", "terminal_leaf")]
    return flags.groupBy("complaint_id").agg(*n)


def value_bands(complaints: DataFrame) -> DataFrame:
    """One row: high and mid cut (index picks, high floored) and the share at or above high."""
    q = exact_quantiles(complaints, [], "stolen_amount", [0.90, 0.65], pick="index").select("q").scalar()
    high = F.greatest(q[0], F.lit(HIGH_VALUE_FLOOR))
    return (complaints.withColumn("high", high).withColumn("mid", q[1]).groupBy("high", "mid")
            .agg(F.avg((F.col("stolen_amount") >= F.col("high")).cast("double")).alias("high_share")))


def triage(complaints: DataFrame, now_s: Column | int, bands: DataFrame | None = None) -> DataFrame:
    """Weight 5/4/3 inside the golden hour with a trusted clock, else 2/1/0 by amount band.

    Needs ``clock_trusted``.
    """
    bands = value_bands(complaints) if bands is None else bands
    now = now_s if isinstance(now_s, Column) else F.lit(now_s)
    age = (now - F.col("filed_s")) / 60.0
    golden = F.col("clock_trusted") & (age < GOLDEN_MIN)
    cuts = bands.select(F.struct("high", "mid")).scalar()
    weight = (F.when(golden & (age < 15), 5).when(golden & (age < 35), 4).when(golden, 3)
              .when(F.col("stolen_amount") >= F.col("__c.high"), 2).when(F.col("stolen_amount") >= F.col("__c.mid"), 1).otherwise(0))
    return complaints.withColumn("__c", cuts).withColumn("golden", golden).withColumn("weight", weight).drop("__c")


def queue_filter(df: DataFrame, needle: str = "", status: str = "OPEN", fraud_type: str = "ALL") -> DataFrame:
    current = text.working_status(F.col("status"))
    out = df
    if status == "OPEN":
        out = out.filter(~current.isin(*text.CLOSED_STATUSES))
    elif status != "ALL":
        out = out.filter(current == status)
    if fraud_type != "ALL":
        out = out.filter(F.col("fraud_type") == fraud_type)
    if needle.strip():
        hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("ticket_id", "victim_name", "city", "state", "fraud_type", "victim_account")]))
        out = out.filter(hay.contains(needle.strip().lower()))
    return out


def work_queue(triaged: DataFrame, limit: int | None = None) -> DataFrame:
    out = triaged.orderBy(F.desc("weight"), F.desc("stolen_amount"), "ticket_id")
    return out.limit(limit) if limit else out


def queue_stats(triaged: DataFrame) -> DataFrame:
    golden = F.sum(F.col("golden").cast("long"))
    needs = F.sum((F.col("status") == "Intervention Required").cast("long"))
    return triaged.agg(golden.alias("golden"), F.sum((~F.col("golden") & (F.col("weight") == 2)).cast("long")).alias("high_value"),
                       F.when(needs > 0, needs).otherwise(golden).alias("needs_action"), F.sum("stolen_amount").alias("at_risk"))


def case_banks(attached: DataFrame, accounts: DataFrame) -> DataFrame:
    """Banks involved in a case; banks are a short code list, so the array stays short."""
    pairs = attached.join(accounts.select(F.col("account_id").alias("dst_account"), "bank_id"), "dst_account").select("complaint_id", "bank_id").distinct()
    return pairs.groupBy("complaint_id").agg(F.sort_array(F.collect_list("bank_id")).alias("banks"))


def dossier(complaints: DataFrame, attached: DataFrame, forecast: DataFrame, audit: DataFrame, evidence: DataFrame) -> DataFrame:
    """Case dossiers as section rows: (case_id, section, seq, body JSON).

    A case is the rows of its id in section order; a case with a third of all transfers is
    never one nested value. A case without a ledger simply has no forecast row.
    """
    def rows(df, case, section, order, columns):
        return df.select(F.col(case).cast("string").alias("case_id"), F.lit(section).alias("section"), F.col(order).cast("long").alias("seq"),
                         F.to_json(F.struct(*columns)).alias("body"))

    parts = [rows(complaints, "ticket_id", "1-complaint", "filed_s", ["victim_account", "fraud_type", "stolen_amount", "city", "state", "status"]),
             rows(money_trail(attached), "complaint_id", "2-trail", "ts_s", ["txn_id", "src_account", "dst_account", "amount", "amount_text", "hop_depth", "minutes_from_first"]),
             rows(detections(attached), "complaint_id", "3-detections", "account_id", ["detector", "account_id"]),
             rows(forecast, "complaint_id", "4-forecast", "account_id", [c for c in forecast.columns if c != "complaint_id"]),
             rows(audit, "case_id", "5-actions", "at_s", ["actor", "action", "status"]),
             rows(evidence, "case_id", "6-evidence", "seq", ["id", "sha256", "collected_by", "entry_hash"])]
    return reduce(DataFrame.unionByName, parts)


def format_checks(ledger: DataFrame) -> DataFrame:
    """Data-quality report of a ledger: one row with the number of rows that break each rule."""
    def bad(rule):
        return F.sum((~F.coalesce(rule, F.lit(False))).cast("long"))

    return ledger.agg(F.count(F.lit(1)).alias("rows"), bad(F.col("amount") > 0).alias("bad_amount"), bad(F.col("hop_depth").between(0, 4)).alias("bad_hop"),
                      bad(F.col("is_terminal").isin(0, 1)).alias("bad_flag"), bad(F.col("src_account") != F.col("dst_account")).alias("self_transfers"),
                      bad(F.col("src_account").isNotNull() & F.col("dst_account").isNotNull()).alias("null_accounts"),
                      bad((F.col("is_terminal") == 0) | F.col("cashout_atm_id").isNotNull()).alias("unlabelled_terminals"))


def newest_per_case(audit: DataFrame, limit: int = 100) -> DataFrame:
    """The last ``limit`` audit entries of every case, newest first as ``place``; rows beyond the limit are cut before the shuffle."""
    order = Window.partitionBy("case_id").orderBy(F.desc("at_s"), F.desc("audit_no"))
    return audit.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
