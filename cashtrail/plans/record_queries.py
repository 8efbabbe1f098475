"""Alert delivery, case, audit and custody queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import accounts as acct
from ..operators import alerts, cases, custody
from ..session import cut_lineage
from ..sources import tables
from .graph_queries import CASE_FLAGS
from .registry import query, tidy

# --- alert rows and deliveries taken from complaints ------------------------------------------

ALERTS = """
alert_rows as (select printf('ALT-%06d', ticket_id + 999000) as id, ticket_id, filed_s + 60 + (ticket_id*37) % 900 as created_s, case ticket_id % 3 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'WATCH' end as severity, state, city as district, stolen_amount as score from complaints),
acks as (select printf('ALT-%06d', audit_no % (select count(*) from complaints) + 999000) as id, actor, at_s, case audit_no % 5 when 0 then 'Confirmed' when 1 then 'Actioned' when 2 then 'False positive' when 3 then 'Duplicate' else 'Nonsense' end as disposition from audit),
acked as (select a.*, f is not null as got, f.actor as actor, f.at_s as at_s, f.disposition as disposition from alert_rows a left join (select id, arg_min(struct_pack(actor := actor, at_s := at_s, disposition := disposition), (at_s, actor)) as f from acks where disposition <> 'Nonsense' group by 1) using (id)),
deliv as (select ticket_id as delivery_id, id as alert_id, case ticket_id % 4 when 0 then 'email' when 1 then 'sms' when 2 then 'webhook' else 'fax' end as channel, ticket_id % 4 as attempts, created_s from alert_rows),
tried as (select *, attempts+1 as n, (ticket_ok) as ok from (select *, delivery_id % 3 = 0 as ticket_ok from deliv)),
advanced as (select delivery_id, n as attempts, case when channel='fax' then 'dead' when ok then 'sent' when n >= 4 then 'dead' else 'failed' end as state, created_s from tried)"""


NUMBERS_FROM = 999_000      # alert numbers of these tables pass from six digits to seven


def _alert_rows(d):
    t = F.col("ticket_id")
    return d.complaints.select(text.numbered_id("ALT", t + NUMBERS_FROM).alias("id"), "ticket_id", (F.col("filed_s") + 60 + (t * 37) % 900).alias("created_s"),
                               F.when(t % 3 == 0, "CRITICAL").when(t % 3 == 1, "HIGH").otherwise("WATCH").alias("severity"),
                               "state", F.col("city").alias("district"), F.col("stolen_amount").alias("score"))


def _acknowledged(d):
    n = d.raw("orders").agg(F.count(F.lit(1))).scalar()
    labels = F.array(*[F.lit(v) for v in ("Confirmed", "Actioned", "False positive", "Duplicate", "Nonsense")])
    acks = d.audit.select(text.numbered_id("ALT", F.col("audit_no") % n + NUMBERS_FROM).alias("id"), "actor", "at_s", F.element_at(labels, (F.col("audit_no") % 5 + 1).cast("int")).alias("disposition"))
    return alerts.acknowledge(_alert_rows(d), acks)


def _advanced(d):
    rows = _alert_rows(d)
    t = F.col("ticket_id")
    deliveries = rows.select(F.col("ticket_id").alias("delivery_id"), F.col("id").alias("alert_id"), F.element_at(F.array(*[F.lit(v) for v in ("email", "sms", "webhook", "fax")]), (t % 4 + 1).cast("int")).alias("channel"),
                             (t % 4).alias("attempts"), F.lit("queued").alias("state"), "created_s")
    attempts = deliveries.select("delivery_id", (F.col("delivery_id") % 3 == 0).alias("ok"), F.lit("send failed").alias("error"))
    return alerts.advance_deliveries(deliveries, attempts, F.col("created_s"))


@query("alert_inbox", "complaints audit", "select id, severity, created_s, state from (select * from acked where not got order by case severity when 'CRITICAL' then 0 when 'HIGH' then 1 else 2 end, created_s desc, id limit 100)", ALERTS)
def _(d):
    return alerts.inbox(_acknowledged(d), status="open").select("id", "severity", "created_s", "state")


@query("acknowledged_alerts", "complaints audit", "select id, case when got then 'acknowledged' else 'open' end as status, actor as acknowledged_by, at_s as acknowledged_s, disposition from acked", ALERTS)
def _(d):
    return _acknowledged(d).select("id", "status", "acknowledged_by", "acknowledged_s", "disposition")


@query("advanced_deliveries", "complaints audit", "select delivery_id, attempts, state, case when state='failed' then created_s + (pow(2, attempts)*60)::bigint end as next_retry_s from advanced", ALERTS)
def _(d):
    return _advanced(d).select("delivery_id", "attempts", "state", "next_retry_s")


@query("deliveries_due", "complaints audit", "select delivery_id, attempts from advanced, (select max(created_s) - 86400 as now from alert_rows) where state='failed' and attempts < 4 and created_s + (pow(2, attempts)*60)::bigint <= now", ALERTS)
def _(d):
    now = _alert_rows(d).agg(F.max("created_s") - 86400).scalar()
    return alerts.deliveries_due(_advanced(d), now).select("delivery_id", "attempts")


@query("alert_summary", "complaints audit", """
select 'disposition' as kind, disposition as label, count(*)::double as value from acked where disposition is not null group by 2 union all select 'delivery', state, count(*) from advanced group by 2
union all select 'rate', 'false_positive_rate', round(count(*) filter (disposition='False positive')/count(disposition),4) from acked""", ALERTS)
def _(d):
    return alerts.alert_summary(_acknowledged(d), _advanced(d))


@query("alert_latency", "complaints", """
select count(*) as alerted, max(w) as max_s, list(w order by w)[least(count(*), floor(0.5*count(*))::bigint+1)]::double as p50_s, list(w order by w)[least(count(*), floor(0.95*count(*))::bigint+1)]::double as p95_s,
 (select max(n) from (select count(*) as n from complaints group by filed_s // 60)) as peak_per_minute from (select created_s - filed_s as w from alert_rows join complaints using (ticket_id))""", ALERTS.split(",\nacks")[0])
def _(d):
    return alerts.alert_latency(d.complaints, _alert_rows(d).select(F.col("ticket_id").alias("complaint_id"), "created_s"))


@query("recipients_narrowest_first", "recipients", "select recipient_id, channel, scope_state, scope_district from recipients where active = 1")
def _(d):
    return d.recipients.filter("active = 1").orderBy(F.desc("scope_district"), F.desc("scope_state"), "recipient_id").select("recipient_id", "channel", "scope_state", "scope_district")


# --- cases ----------------------------------------------------------------------------------------

@query("newest_complaints", "complaints", "select ticket_id, filed_s, city from complaints order by filed_s desc, ticket_id desc limit 100 offset 50")
def _(d):
    return cases.newest_complaints(d.complaints, 50, 100).select("ticket_id", "filed_s", "city")


VALID = "valid as (select * from audit where status in ('New','Under Review','Investigating','Intervention Required','Resolved','Closed'))"


@query("case_state", "audit", "select case_id, arg_max(status, (at_s, audit_no)) as status, arg_max(actor, (at_s, audit_no)) as assignee, max(at_s) as updated_s, count(*) as changes from valid group by 1", VALID)
def _(d):
    return cases.case_state(d.audit)


@query("rejected_transitions", "audit", "select audit_no, case_id, status from audit where status not in ('New','Under Review','Investigating','Intervention Required','Resolved','Closed')")
def _(d):
    return cases.rejected_transitions(d.audit).select("audit_no", "case_id", "status")


@query("latest_action_per_case", "audit", "select case_id, arg_max(action, (at_s, audit_no)) as action, arg_max(actor, (at_s, audit_no)) as actor from audit group by 1")
def _(d):
    return cases.latest_per_key(d.audit.select("case_id", "at_s", "audit_no", "action", "actor"), ["case_id"], ["at_s", "audit_no"]).select("case_id", "action", "actor")


@query("audit_newest_first", "audit", "select audit_no, at_s, case_id, action from audit order by at_s desc, audit_no desc limit 100")
def _(d):
    return d.audit.orderBy(F.desc("at_s"), F.desc("audit_no")).limit(100).select("audit_no", "at_s", "case_id", "action")


@query("audit_newest_per_case", "audit", "select * from (select audit_no, at_s, case_id, action, row_number() over (partition by case_id order by at_s desc, audit_no desc) as place from audit) where place <= 10")
def _(d):
    """The ten newest entries of every case."""
    return cases.newest_per_case(d.audit, 10).select("audit_no", "at_s", "case_id", "action", "place")


@query("case_notes", "notes", "select case_id, turn, author, 'NOTE-' || case_id || '-' || lpad(cast(row_number() over (partition by case_id order by turn, author, text) as varchar), 3, '0') as note_id from notes")
def _(d):
    return cases.case_notes(d.notes).select("case_id", "turn", "author", "note_id")


@query("money_trail", "ledger", "select txn_id, complaint_id, src_account, dst_account, round(amount,4) as amount, ts_s, hop_depth, round((ts_s - min(ts_s) over (partition by complaint_id))/60.0,2) as minutes_from_first from ledger where complaint_id is not null")
def _(d):
    return tidy(cases.money_trail(tables.attached_only(d.ledger)).select("txn_id", "complaint_id", "src_account", "dst_account", "amount", "ts_s", "hop_depth", "minutes_from_first"))


@query("case_timeline", "complaints ledger audit", """
select ticket_id as case_id, 'fraud' as section, filed_s as at_s, 'report' as kind, 'reported' as ref, round(stolen_amount,4) as amount from complaints
union all select complaint_id, 'fraud', ts_s, case when is_terminal=1 then 'cashout' else 'transfer' end, cast(txn_id as varchar), round(amount,4) from ledger where complaint_id is not null
union all select case_id, 'activity', at_s, action, cast(audit_no as varchar), null from audit""")
def _(d):
    return tidy(cases.case_timeline(d.complaints, tables.attached_only(d.ledger), d.audit))


@query("case_detections", "ledger", "select complaint_id, 'velocity' as detector, account_id from cvel union all select complaint_id, 'fund_split', account_id from cspl union all select complaint_id, 'terminal_leaf', account_id from cleaf", CASE_FLAGS)
def _(d):
    return cases.detections(tables.attached_only(d.ledger))


@query("case_detection_counts", "ledger", "select complaint_id, count(*) filter (k='v') as velocity_count, count(*) filter (k='s') as fund_split_count, count(*) filter (k='t') as terminal_leaf_count from (select complaint_id, 'v' as k from cvel union all select complaint_id, 's' from cspl union all select complaint_id, 't' from cleaf) group by 1", CASE_FLAGS)
def _(d):
    return cases.detection_counts(tables.attached_only(d.ledger))


BANDS = """
sorted as (select list(stolen_amount order by stolen_amount) as s, count(*) as n from complaints),
cuts as (select greatest(s[least(n, floor(0.90*n)::bigint+1)], 100000.0) as high, s[least(n, floor(0.65*n)::bigint+1)] as mid from sorted),
nowt as (select max(filed_s) + 1500 as now_s from complaints),
tri as (select c.*, (ticket_id % 5 = 0) and (now_s-filed_s)/60.0 < 60 as golden, case when (ticket_id % 5 = 0) and (now_s-filed_s)/60.0 < 15 then 5 when (ticket_id % 5 = 0) and (now_s-filed_s)/60.0 < 35 then 4 when (ticket_id % 5 = 0) and (now_s-filed_s)/60.0 < 60 then 3
 when stolen_amount >= high then 2 when stolen_amount >= mid then 1 else 0 end as weight from complaints c, cuts, nowt)"""


def _triaged(d):
    now = d.complaints.agg(F.max("filed_s") + 1500).scalar()
    return cases.triage(d.complaints.withColumn("clock_trusted", F.col("ticket_id") % 5 == 0), now)


@query("value_bands", "complaints", "select round(high,2) as high, round(mid,2) as mid, round((select avg(case when stolen_amount >= high then 1.0 else 0.0 end) from complaints),4) as high_share from cuts", BANDS)
def _(d):
    return cases.value_bands(d.complaints).select(F.round("high", 2).alias("high"), F.round("mid", 2).alias("mid"), F.round("high_share", 4).alias("high_share"))


@query("triage", "complaints", "select ticket_id, golden, weight from tri", BANDS)
def _(d):
    return _triaged(d).select("ticket_id", "golden", "weight")


@query("work_queue", "complaints", "select ticket_id, weight, round(stolen_amount,2) as stolen_amount from tri where status <> 'Resolved' and status <> 'Closed'", BANDS)
def _(d):
    return tidy(cases.work_queue(cases.queue_filter(_triaged(d))).select("ticket_id", "weight", "stolen_amount"), 2)


@query("queue_search", "complaints", "select ticket_id from complaints where status <> 'Resolved' and fraud_type = '1-URGENT' and contains(lower(concat_ws(' ', ticket_id, victim_name, city, state, fraud_type, victim_account)), 'nation_1')")
def _(d):
    return cases.queue_filter(d.complaints, "NATION_1", "OPEN", "1-URGENT").select("ticket_id")


@query("queue_stats", "complaints", "select count(*) filter (golden) as golden, count(*) filter (not golden and weight = 2) as high_value, count(*) filter (golden) as needs_action, round(sum(stolen_amount),2) as at_risk from tri", BANDS)
def _(d):
    return tidy(cases.queue_stats(_triaged(d)), 2)


@query("case_banks", "ledger accounts", "select complaint_id, list(distinct bank_id order by bank_id) as banks from ledger join accounts on dst_account = account_id where complaint_id is not null group by 1")
def _(d):
    return cases.case_banks(tables.attached_only(d.ledger), d.accounts)


# --- custody ----------------------------------------------------------------------------------------

RECORDS = """
digests as (select evidence_no, case_id, sha256(text) as sha256, size_bytes, collected_by, collected_s from evidence),
firsts as (select case_id, sha256, arg_min(struct_pack(evidence_no := evidence_no, size_bytes := size_bytes, collected_by := collected_by, collected_s := collected_s), evidence_no) as r from digests group by 1, 2),
recs as (select case_id, sha256, printf('EVD-%06d', r.evidence_no) as id, r.evidence_no as evidence_no, r.size_bytes as size_bytes, r.collected_by as collected_by, r.collected_s as collected_s, row_number() over (partition by case_id order by r.evidence_no) as seq from firsts),
chain(case_id, seq, id, sha256, prev_hash, entry_hash) as (select case_id, seq, id, sha256, '', sha256('|' || id || '|' || case_id || '|' || sha256 || '|' || collected_by || '|' || collected_s) from recs where seq = 1
 union all select r.case_id, r.seq, r.id, r.sha256, c.entry_hash, sha256(c.entry_hash || '|' || r.id || '|' || r.case_id || '|' || r.sha256 || '|' || r.collected_by || '|' || r.collected_s) from chain c join recs r on r.case_id = c.case_id and r.seq = c.seq + 1)"""


def _records(d):
    return custody.custody_records(d.evidence.withColumn("content", F.col("text")))


def _chain(d):
    return custody.link_chain(_records(d))


def _tampered(chain):
    """Rewrite the digest of every seventh artefact after the fact."""
    return chain.withColumn("sha256", F.when(text.id_number("id") % 7 == 3, F.reverse("sha256")).otherwise(F.col("sha256")))


@query("custody_records", "evidence", "select case_id, sha256, id, size_bytes from recs", RECORDS.split(",\nchain")[0])
def _(d):
    return _records(d).select("case_id", "sha256", "id", "size_bytes")


@query("custody_chain", "evidence", "select case_id, id, seq, prev_hash, entry_hash from chain", RECORDS, recursive=True)
def _(d):
    return _chain(d).select("case_id", "id", "seq", "prev_hash", "entry_hash")


@query("custody_verification", "evidence", "select case_id, id, seq, min(case when evidence_no % 7 = 3 and reverse(sha256) <> sha256 then 0 else 1 end) over (partition by case_id order by seq) = 1 as ok from recs", RECORDS.split(",\nchain")[0])
def _(d):
    return custody.verify_chain(_tampered(_chain(d)))


@query("content_verification", "evidence", "select case_id, id, reason = '' as ok, reason from (select *, case when evidence_no % 11 = 5 then 'bytes missing from the store' when evidence_no % 13 = 4 then 'content hash mismatch' else '' end as reason from recs)", RECORDS.split(",\nchain")[0])
def _(d):
    n = F.col("evidence_no")
    kept = d.evidence.filter(n % 11 != 5).select(text.numbered_id("EVD", n).alias("id"), F.when(n % 13 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return custody.verify_content(_records(d), kept).select("case_id", "id", "ok", "reason")


WITHDRAWN = RECORDS.split(",\nchain")[0] + """,
wd as (select *, evidence_no % 9 = 2 as withdrawn from recs)"""


def _withdrawn(d):
    records = _chain(d)
    n = text.id_number("id")
    asked = records.filter(n % 9 == 2).select("id", F.lit("officer-1").alias("actor"), (F.col("collected_s") + 60).alias("at_s"), F.lit("wrong case").alias("reason"))
    short = records.filter(n % 9 == 3).select("id", F.lit("officer-2").alias("actor"), (F.col("collected_s") + 30).alias("at_s"), F.lit("no").alias("reason"))
    late = asked.withColumn("at_s", F.col("at_s") + 600).withColumn("reason", F.lit("second reason"))
    return custody.withdrawals(records, asked.unionByName(short).unionByName(late))


@query("withdrawals", "evidence", "select id, withdrawn, case when withdrawn then collected_s + 60 end as withdrawn_s, case when withdrawn then 'wrong case' else '' end as withdrawn_reason from wd", WITHDRAWN)
def _(d):
    return _withdrawn(d).select("id", "withdrawn", "withdrawn_s", "withdrawn_reason")


@query("evidence_counts", "evidence", "select count(*) as items, count(*) filter (withdrawn) as withdrawn, sum(size_bytes)::bigint as bytes, count(distinct case_id) as cases from wd", WITHDRAWN)
def _(d):
    return custody.evidence_counts(_withdrawn(d))


@query("certificates", "evidence", """
select case_id, count(*) filter (not withdrawn) as artefact_count, count(*) filter (withdrawn) as withdrawn_count, coalesce(sum(size_bytes) filter (not withdrawn),0)::bigint as total_bytes, min(case when evidence_no % 11 = 5 then 0 else 1 end) as content_ok, 1 as chain_ok, min(case when evidence_no % 11 = 5 then 0 else 1 end) as intact from wd group by 1""", WITHDRAWN)
def _(d):
    records = cut_lineage(_withdrawn(d))
    stored = d.evidence.filter(F.col("evidence_no") % 11 != 5).select(text.numbered_id("EVD", F.col("evidence_no")).alias("id"), F.col("text").alias("content"))
    return custody.certificate(records, custody.verify_content(records, stored), custody.verify_chain(records))


@query("dossiers")
def _(d):
    from ..operators import choice

    attached = tables.attached_only(d.ledger)
    ends = choice.case_terminals(attached).join(d.accounts.select("account_id", "lat", "lon", "bank_id"), "account_id")
    best = choice.fixed_scores(d.accounts, d.cashpoints).filter("choice_rank = 1").select("lat", "lon", "bank_id", F.col("atm_id").alias("best_atm"), F.round("p", 4).alias("confidence"))
    forecast = ends.join(best, ["lat", "lon", "bank_id"]).select("complaint_id", "account_id", "lat", "lon", "best_atm", "confidence")
    return cases.dossier(d.complaints, attached, forecast, d.audit, _chain(d))
