"""From surface rows to alerts, deliveries and the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, timing
from . import rules as R
from .distribution import exact_quantiles, number_rows

MAX_ATTEMPTS = 4
CHANNELS = ("email", "sms", "webhook")
DISPOSITIONS = ("Confirmed", "Actioned", "False positive", "Duplicate")
DEDUPE_KEY = ["rule_id", "cell_id", "window_start_min", "dedupe_bucket"]


def registry_hits(chains: DataFrame, registry: DataFrame, case_cells: DataFrame) -> DataFrame:
    """Distinct registered accounts in the chains that feed a cell: (cell, registry_hits)."""
    ends = chains.select("complaint_id", F.col("src_account").alias("account_id")).union(chains.select("complaint_id", "dst_account")).distinct()
    marked = ends.join(registry.select("account_id").distinct(), "account_id", "left_semi")
    return (marked.join(case_cells.select("cell", "complaint_id").distinct(), "complaint_id").select("cell", "account_id").distinct()
            .groupBy("cell").agg(F.count(F.lit(1)).alias("registry_hits")))


def alert_candidates(surface: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Live cell-windows with the surface-wide watch cut and converge floor."""
    live = surface.filter((F.col("conditional_rupees") > 0) & (F.col("score") > 0))
    cut = exact_quantiles(live, [], "score", [R.WATCH_PERCENTILE], pick="index").select(F.col("q")[0]).scalar()
    floor = live.agg(F.greatest(F.lit(R.CONVERGE_CASES), F.ceil(R.CONVERGE_EXCESS * F.avg("case_count"))).cast("long")).scalar()
    out = (live.withColumn("rupees_at_risk", F.col("conditional_rupees") + F.col("prior_rupees"))
           .withColumn("watch_cut", F.coalesce(cut, F.lit(0.0))).withColumn("converge_floor", floor))
    if hits is None:
        return out.withColumn("registry_hits", F.lit(0).cast("long"))
    return out.join(hits, "cell", "left").na.fill(0, ["registry_hits"])


def evaluate_rules(candidates: DataFrame, as_of: Column, rules=R.DEFAULT_RULES) -> DataFrame:
    """Alert rows of every rule that fires; a degraded surface raises nothing. Writing is the caller's choice."""
    fired = F.array_compact(F.array(*[
        F.when(r.predicate(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.why).alias("why")))
        for r in rules]))
    return (candidates.filter(~F.col("degraded")).withColumn("f", F.explode(fired))
            .select("f.rule_id", "f.severity", "cell", "cell_id", "district", "state", "window_start_min", "window_end_min", "score",
                    "rupees_at_risk", "case_count", "prior_share",
                    text.alert_headline(F.col("rupees_at_risk"), F.col("district"), F.col("cell_id"), F.col("window_start_min"),
                                        F.col("window_end_min"), F.col("case_count")).alias("headline"),
                    timing.hour_bucket(as_of).alias("dedupe_bucket"), "f.why"))


def dedupe_alerts(new: DataFrame, existing: DataFrame | None) -> DataFrame:
    """One alert per rule, cell, window start and hour; those already raised are dropped."""
    rest = [c for c in new.columns if c not in DEDUPE_KEY]
    # among equals inside one pass the highest score stands for all
    best = F.struct((-F.col("score")).alias("s"), F.col("window_end_min"))
    one = new.groupBy(*DEDUPE_KEY).agg(F.min_by(F.struct(*rest), best).alias("a")).select(*DEDUPE_KEY, *[F.col(f"a.{c}").alias(c) for c in rest])
    return one if existing is None else one.join(existing.select(*DEDUPE_KEY), DEDUPE_KEY, "left_anti")


def next_ids(new: DataFrame, existing: DataFrame | None, prefix: str, key: str, out: str = "id", ids: str = "id") -> DataFrame:
    """``ALT-000001`` style ids that go on from the largest suffix in use. ``key`` is a unique number."""
    start = F.lit(1).cast("long")
    if existing is not None:
        suffix = F.regexp_extract(F.col(ids), rf"^{prefix}-(\d+)$", 1)
        start = F.coalesce(existing.filter(suffix != "").agg(F.max(suffix.cast("long"))).scalar(), F.lit(0).cast("long")) + 1
    numbered = number_rows(new, key, "__n", start)
    return numbered.withColumn(out, text.numbered_id(prefix, F.col("__n"))).drop("__n")


def route_alerts(alerts: DataFrame, recipients: DataFrame) -> DataFrame:
    """Every active recipient whose scope is blank or equal, on state and on district.

    Each alert asks for its four possible scopes, so routing is an equi-join. A blank place
    on the alert switches that filter off.
    """
    desks = recipients.filter(F.col("active") == 1).select("recipient_id", "name", "role", "channel", "address", "scope_state", "scope_district")
    st, di = F.coalesce("state", F.lit("")), F.coalesce("district", F.lit(""))
    # '*' asks for every scope of that kind
    asks = (alerts.withColumn("__s", F.when(st == "", F.array(F.lit("*"))).otherwise(F.array(F.lit(""), st)))
            .withColumn("__d", F.when(di == "", F.array(F.lit("*"))).otherwise(F.array(F.lit(""), di)))
            .withColumn("ask_state", F.explode("__s")).withColumn("ask_district", F.explode("__d")).drop("__s", "__d"))
    offers = (desks.withColumn("ask_state", F.explode(F.array(F.col("scope_state"), F.lit("*"))))
              .withColumn("ask_district", F.explode(F.array(F.col("scope_district"), F.lit("*")))))
    return asks.join(offers, ["ask_state", "ask_district"]).drop("ask_state", "ask_district")


def advance_deliveries(deliveries: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Next delivery state after an attempt: sent, failed with 2^n minutes of wait, or dead."""
    known = F.col("channel").isin(*CHANNELS)
    tried = F.col("attempts") + 1
    joined = deliveries.join(attempts.select("delivery_id", "ok", "error"), "delivery_id")
    state = (F.when(~known, "dead").when(F.col("ok"), "sent").when(tried >= MAX_ATTEMPTS, "dead").otherwise("failed"))
    return (joined.withColumn("state", state)
            .withColumn("last_error", F.when(~known, F.concat(F.lit("no adapter for "), F.col("channel"))).when(F.col("ok"), None).otherwise(F.col("error")))
            .withColumn("next_retry_s", F.when(F.col("state") == "failed", now + (F.pow(F.lit(2.0), tried) * 60).cast("long")))
            .withColumn("attempts", tried).drop("ok", "error"))


def deliveries_due(deliveries: DataFrame, now: Column) -> DataFrame:
    return deliveries.filter((F.col("state") == "failed") & (F.col("attempts") < MAX_ATTEMPTS)
                             & (F.col("next_retry_s").isNull() | (F.col("next_retry_s") <= now)))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """The first acknowledgement of an alert stands; unknown outcomes are ignored."""
    valid = acks.filter(F.col("disposition").isin(*DISPOSITIONS))
    first = valid.groupBy("id").agg(F.min_by(F.struct("actor", "at_s", "disposition"), F.struct("at_s", "actor")).alias("a"))
    return (alerts.join(first, "id", "left").withColumn("status", F.when(F.col("a").isNotNull(), "acknowledged").otherwise("open"))
            .withColumn("acknowledged_by", F.col("a.actor")).withColumn("acknowledged_s", F.col("a.at_s"))
            .withColumn("disposition", F.col("a.disposition")).drop("a"))


def severity_order(severity="severity") -> Column:
    return F.when(F.col(severity) == "CRITICAL", 0).when(F.col(severity) == "HIGH", 1).otherwise(2)


def inbox(alerts: DataFrame, status: str = "", severity: str = "", state: str = "", limit: int = 100) -> DataFrame:
    out = alerts
    for column, wanted in (("status", status), ("severity", severity), ("state", state)):
        if wanted:
            out = out.filter(F.col(column) == wanted)
    return out.orderBy(severity_order(), F.desc("created_s"), "id").limit(limit)


def alert_summary(alerts: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(kind, label, n) counts, plus the false-positive rate as a row of its own."""
    outcomes = alerts.filter(F.col("disposition").isNotNull()).groupBy(F.lit("disposition").alias("kind"), F.col("disposition").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    states = deliveries.groupBy(F.lit("delivery").alias("kind"), F.col("state").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n, fp = F.count("disposition"), F.count(F.when(F.col("disposition") == "False positive", 1))
    rate = alerts.agg(F.lit("rate").alias("kind"), F.lit("false_positive_rate").alias("label"),
                      F.when(n > 0, F.round(fp / n, 4)).otherwise(0.0).alias("value"))
    return outcomes.unionByName(states).unionByName(rate)


def delivery_text(alerts: DataFrame) -> DataFrame:
    subject = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("headline"))
    body = F.concat(F.lit("Cell "), F.col("cell_id"), F.lit(" - "), F.col("district"), F.lit(", "), F.col("state"),
                    F.lit(". This area leads a forecast ranking; nobody has been seen there yet."))
    return alerts.withColumn("subject", subject).withColumn("body", body).withColumn("sms", text.sms_text(subject, body))


def outbound_payloads(alerts: DataFrame) -> DataFrame:
    """Fund-hold and dissemination messages as JSON, with the live share beside the historical share.

    Number, time and acknowledgement columns may be absent: such alerts are not stored or acknowledged yet. Keys are fixed values of the receivers' contract;
    the schema labels stay proposals of this engine.
    """
    for name, kind in (("id", "string"), ("created_s", "long"), ("status", "string"), ("acknowledged_by", "string"), ("disposition", "string")):
        alerts = alerts if name in alerts.columns else alerts.withColumn(name, F.lit(None).cast(kind))
    live = F.round(1.0 - F.col("prior_share"), 4)
    window = F.array("window_start_min", "window_end_min").alias("window_minutes_from_now")
    amount = F.round("rupees_at_risk", 2).alias("amount_at_risk_inr")
    place = [F.col(c) for c in ("cell_id", "district", "state")]
    issued, reference = F.col("created_s").alias("issued_at"), F.col("id").alias("reference")
    person = F.struct((F.coalesce("status", F.lit("")) == "acknowledged").alias("acknowledged"), "acknowledged_by", "disposition")
    hold = F.struct(F.lit("cashtrail.hold-request/v1-proposed").alias("schema"), issued, F.struct(F.lit("cashtrail").alias("system"), reference).alias("issuer"),
                    F.lit("PRECAUTIONARY_HOLD").alias("action"), F.col("severity").alias("urgency"), F.col("complaint_ids").alias("complaint_references"), amount,
                    F.struct(*place, window).alias("predicted_cashout"),
                    F.struct(F.col("rule_id").alias("rule"), live.alias("live_share"), F.round("prior_share", 4).alias("historical_prior_share"),
                             F.col("case_count").alias("contributing_cases")).alias("confidence"), person.alias("human_in_the_loop"))
    spread = F.struct(F.lit("cashtrail.dissemination/v1-proposed").alias("schema"), F.lit("PREDICTED_CASHOUT_WINDOW").alias("event_type"), issued, reference,
                      F.col("severity"), F.col("headline"), F.struct("state", "district").alias("jurisdiction"),
                      F.struct(F.col("cell_id"), F.lit(12.0).alias("atm_cluster_radius_km"), window).alias("target"),
                      F.struct(F.col("complaint_ids").alias("linked_complaints"), amount, live.alias("live_share")).alias("evidence"),
                      F.lit("An estimate of where, ordered by likelihood. Watch the place; being there proves nothing against anyone.").alias("advisory"))
    return alerts.withColumn("hold_request", F.to_json(hold)).withColumn("dissemination", F.to_json(spread))


def alert_latency(complaints: DataFrame, alert_cases: DataFrame) -> DataFrame:
    """Filed-to-first-alert seconds: p50, p95 (index pick), max, and the busiest minute of intake."""
    first = alert_cases.groupBy("complaint_id").agg(F.min("created_s").alias("created_s"))
    waits = (complaints.select(F.col("ticket_id").alias("complaint_id"), "filed_s").join(first, "complaint_id")
             .withColumn("wait_s", F.col("created_s") - F.col("filed_s")).filter("wait_s >= 0"))
    q = exact_quantiles(waits, [], "wait_s", [0.5, 0.95], pick="index").select("q").scalar()
    per_min = complaints.groupBy(F.floor(F.col("filed_s") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    return (waits.agg(F.count(F.lit(1)).alias("alerted"), F.max("wait_s").alias("max_s"))
            .withColumn("p50_s", q[0]).withColumn("p95_s", q[1]).withColumn("peak_per_minute", per_min))
