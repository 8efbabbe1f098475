"""Streaming jobs run over the test tables as file streams, drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import timing
from ..operators import accounts as acct
from ..operators import alerts, rules, surface
from ..session import cut_lineage, shared_folder
from ..streaming import jobs, retry
from ..streaming.posterior import PosteriorStore
from .place_queries import ALL, CAND, SURFACE, Picture
from .registry import query, tidy


def _events(d, batch=False):
    schema = d.raw("events").schema
    if batch:
        return d.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.file_stream(d.spark, d.folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_burst_windows", "", """
select cast(floor(epoch(ws)) as bigint) as window_start_s, user_id as src_account, n from (select ws, user_id, count(*) as n from
 (select user_id, date_trunc('minute', ts) - to_minutes(k) as ws from events, (select unnest(generate_series(0,4)) as k)) group by 1, 2 having count(*) > 1)
where ws + interval 5 minute <= (select max(ts) - interval 10 minute from events)""")
def _(d):
    found = jobs.burst_windows(_events(d).withColumnRenamed("user_id", "src_account"), more_than=1)
    return jobs.drain(found, "burst").select(F.unix_timestamp("window_start").alias("window_start_s"), "src_account", "n")


@query("stream_deduped_alerts", "", "select distinct event_type as rule_id, user_id % 25 as cell_id, (event_id % 3)*30 as window_start_min, strftime(ts, '%Y-%m-%dT%H') as dedupe_bucket from events")
def _(d):
    raw = _events(d).select(F.col("event_type").alias("rule_id"), (F.col("user_id") % 25).alias("cell_id"), ((F.col("event_id") % 3) * 30).alias("window_start_min"), F.col("ts").alias("created_at"))
    return jobs.drain(jobs.dedupe_stream(raw), "dedupe").select("rule_id", "cell_id", "window_start_min", "dedupe_bucket")


@query("stream_complaint_intake", "", """
select event_id as ticket_id, case when event_id % 4 = 3 then null else n_name end is not null and value > 0 and event_id % 5 <> 0 as accepted, case when event_id % 4 = 3 then 'Elsewhere' else n_name end as city
from events join nation on n_nationkey = user_id % 25""")
def _(d):
    nation = d.raw("nation").join(d.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    states = nation.select(F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    aliases = nation.select(F.concat(F.lit("old "), F.lower("n_name")).alias("alias"), F.col("n_name").alias("city"))
    typed = F.when(F.col("ticket_id") % 4 == 3, "Elsewhere").when(F.col("ticket_id") % 4 == 2, F.concat(F.lit(" OLD  "), F.col("n_name"))).otherwise(F.lower("n_name"))
    stamp = F.when(F.col("ticket_id") % 5 == 0, "garbage").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    raw = (_events(d).withColumnRenamed("event_id", "ticket_id").join(d.raw("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("user_id") % 25)
           .select("ticket_id", F.col("user_id").alias("victim_account"), F.col("event_type").alias("fraud_type"), (F.col("value") * 1000).alias("stolen_amount"),
                   stamp.alias("complaint_timestamp"), typed.alias("city"), F.lit("").alias("state")))
    return jobs.drain(jobs.intake(raw, states, aliases).select("ticket_id", "accepted", "city"), "intake")


@query("stream_change_feed", "", "select 'acknowledgement' as kind, cast(event_id as varchar) as key, cast(floor(epoch(ts)) as bigint) as at_s from events")
def _(d):
    return jobs.drain(jobs.change_feed(_events(d), "acknowledgement", "event_id", "ts"), "feed").select("kind", "key", F.unix_timestamp("at").alias("at_s"))


def _in_files(rows, parts):
    """A stream of the written ``rows`` that comes in as many files as ``parts`` has conditions, and a call for each delivery."""
    folder = f"{shared_folder(rows.sparkSession)}/streams/in-{uuid.uuid4().hex}"
    schema = rows.schema
    stream = lambda: jobs.file_stream(rows.sparkSession, f"{folder}/*", schema)
    return stream, [lambda i=i, part=part: rows.filter(part).coalesce(1).write.parquet(f"{folder}/{i}") for i, part in enumerate(parts)]


def _ticks(d, registry=None):
    """Complaints filed before the busiest instant's window, in it and after it, each delivered as a file to a query started anew."""
    p = Picture.of(d)
    base, low = f"{shared_folder(d.spark)}/streams/tick-{uuid.uuid4().hex}", p.as_of_s - 1200
    stream, deliveries = _in_files(p.complaints, [F.col("filed_s") < low, F.col("filed_s") == low, F.col("filed_s") > low])
    store = PosteriorStore(d.spark, f"{base}/store", p.directory)
    outs, attached = cut_lineage(acct.cashouts(p.attached).join(p.history, "complaint_id", "left_semi")), p.attached
    for deliver in deliveries:
        deliver()
        sink = jobs.alert_sink(store, lambda: attached, d.accounts, lambda now: acct.decayed_prior(outs, store.membership, now), f"{base}/rows",
                               lambda batch: batch.agg(F.max("filed_s") + 1200).head()[0], registry)
        jobs.start(stream(), sink, f"{base}/checkpoint", once=True).awaitTermination()
    return p, store, f"{base}/rows"


@query("stream_alert_pass", ALL, "select rule_id, cell_id, w0 as window_start_min, round(rupees_at_risk,2) as rupees_at_risk from fired where rule_id <> 'R-HIGH-REGISTRY'", CAND, recursive=True)
def _(d):
    """The minute tick driven by its batch: three files, a restart before each; what the tick of the busiest instant raised."""
    p, _store, target = _ticks(d)
    raised = d.spark.read.parquet(target).filter(F.col("dedupe_bucket") == timing.hour_bucket(F.timestamp_seconds(F.lit(p.as_of_s))))
    return tidy(raised.select("rule_id", "cell_id", "window_start_min", "rupees_at_risk"), 2)


@query("stream_posterior_surface", ALL, "select cell, cell_id, w0 as window_start_min, round(conditional_rupees,2) as conditional_rupees, round(prior_rupees,2) as prior_rupees, case_count from surf", SURFACE, recursive=True)
def _(d):
    """The surface over the stored posterior that three deliveries have built up."""
    p, store, _target = _ticks(d)
    found = surface.forward_surface(surface.open_complaints(store.rows(), p.as_of_s), store.probs(), store.cells, p.prior(), p.as_of_s)
    return tidy(found.select("cell", "cell_id", "window_start_min", "conditional_rupees", "prior_rupees", "case_count"), 2)


@query("stream_delivery_retry", "", """
with a as (select user_id as delivery_id, cast(floor(epoch(ts)) as bigint) as at_s, event_type = 'purchase' as ok, event_type as error, case user_id % 4 when 0 then 'email' when 1 then 'sms' when 2 then 'webhook' else 'fax' end as channel from events),
n as (select *, row_number() over (partition by delivery_id order by at_s, not ok, error) as attempts from a),
e as (select *, min(case when ok or channel = 'fax' then attempts end) over (partition by delivery_id) as over_at from n)
select delivery_id, attempts, case when channel = 'fax' then 'dead' when ok then 'sent' when attempts >= 4 then 'dead' else 'failed' end as state,
 case when channel = 'fax' then 'no adapter for fax' when not ok then error end as last_error,
 case when channel <> 'fax' and not ok and attempts < 4 then at_s + cast(pow(2, attempts) as bigint) * 60 end as next_retry_s, at_s
from e where attempts <= least(4, coalesce(over_at, 4))""".replace("\nwith a as", "\nselect * from (with a as", 1) + ")")
def _(d):
    """Attempts at deliveries in three files with a restart before each; every outcome that counted."""
    times = _events(d, batch=True)
    low, high = times.agg(F.percentile_approx(F.unix_timestamp("ts"), [0.33, 0.67])).head()[0]
    at = F.unix_timestamp("ts")
    channel = F.element_at(F.array(*[F.lit(c) for c in ("email", "sms", "webhook", "fax")]), (F.col("user_id") % 4 + 1).cast("int"))
    rows = times.select(F.col("user_id").alias("delivery_id"), channel.alias("channel"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("error"), at.alias("at_s"))
    stream, deliveries = _in_files(cut_lineage(rows), [F.col("at_s") <= low, (F.col("at_s") > low) & (F.col("at_s") <= high), F.col("at_s") > high])
    base = f"{shared_folder(d.spark)}/streams/retry-{uuid.uuid4().hex}"

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    for deliver in deliveries:
        deliver()
        jobs.start(retry.retry_stream(stream(), replay=True), sink, f"{base}/checkpoint", "update", once=True).awaitTermination()
    # the other streams of the session keep their own store
    d.spark.conf.unset(retry.PROVIDER)
    return d.spark.read.schema(retry.CHANGE).parquet(f"{base}/rows").filter("kind = 'attempted'").select("delivery_id", "attempts", "state", "last_error", "next_retry_s", "at_s")


@query("custom_rule_alerts", ALL, "select 'R-ANY-CASE' as rule_id, cell_id, w0 as window_start_min from cand where case_count >= 2", CAND, recursive=True)
def _(d):
    """A registered rule of one's own beside none of the defaults."""
    p = Picture.of(d)
    own = rules.register_rule((), "R-ANY-CASE", "WATCH", lambda: F.col("case_count") >= 2, "two open cases")
    raised = alerts.evaluate_rules(alerts.alert_candidates(p.surface()), F.timestamp_seconds(F.lit(p.as_of_s)), own)
    return raised.select("rule_id", "cell_id", "window_start_min")
