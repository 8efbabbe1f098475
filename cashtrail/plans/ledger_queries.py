"""Ledger, scalar, account and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, timing
from ..operators import accounts as acct
from ..operators import candidates, cases, learning, spatial
from ..operators.distribution import exact_quantiles
from ..sources import tables
from .registry import hav, query, tidy

LED = "ledger"


@query("edge_projection", LED, "select src_account, dst_account, round(amount,4) as amount, ts_s, hop_depth, is_terminal, complaint_id from ledger")
def _(d):
    return tidy(tables.edge_projection(d.ledger))


@query("attached_transfers", LED, "select txn_id, complaint_id, round(amount,4) as amount from ledger where complaint_id is not null")
def _(d):
    return tidy(tables.attached_only(d.ledger).select("txn_id", "complaint_id", "amount"))


@query("complaints_with_defaults", "complaints", """
select ticket_id, coalesce(victim_name,'') as victim_name, coalesce(fraud_type,'') as fraud_type,
  round(coalesce(stolen_amount,0.0),2) as stolen_amount, filed_s, case when status is null or status='ACTIVE' then 'New' else status end as status from complaints""")
def _(d):
    c = d.complaints
    return tidy(c.select("ticket_id", F.coalesce("victim_name", F.lit("")).alias("victim_name"), F.coalesce("fraud_type", F.lit("")).alias("fraud_type"),
                         F.coalesce("stolen_amount", F.lit(0.0)).alias("stolen_amount"), "filed_s", text.working_status(F.col("status")).alias("status")), 2)


@query("placed_cashpoints", "cashpoints", "select atm_id, district, state, round(lat,6) as lat, round(lon,6) as lon from cashpoints where lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
def _(d):
    return tidy(spatial.finite_points(d.cashpoints).select("atm_id", "district", "state", "lat", "lon"), 6)


@query("accounts_by_city", "accounts", "select lower(trim(city)) as city_key, account_id from accounts where lower(trim(city)) <> ''")
def _(d):
    return tables.city_index(d.accounts)


@query("distance_to_every_cashout", "ledger, accounts, cashpoints".replace(",", ""), f"""
select txn_id, round({hav('a.lat', 'a.lon', 'c.lat', 'c.lon')},4) as km,
  round(fmod(degrees(atan2(sin(radians(c.lon-a.lon))*cos(radians(c.lat)), cos(radians(a.lat))*sin(radians(c.lat))-sin(radians(a.lat))*cos(radians(c.lat))*cos(radians(c.lon-a.lon))))+360.0, 360.0),4) as bearing,
  round(6371.0*cos(radians(a.lat))*cos(radians(a.lon)),4) as x, round(6371.0*cos(radians(a.lat))*sin(radians(a.lon)),4) as y, round(6371.0*sin(radians(a.lat)),4) as z
from ledger join accounts a on dst_account = a.account_id join cashpoints c on cashout_atm_id = c.atm_id where is_terminal = 1""")
def _(d):
    c = d.cashpoints.select(F.col("atm_id").alias("cashout_atm_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    rows = acct.cashouts(d.ledger).join(d.accounts.select(F.col("account_id").alias("dst_account"), "lat", "lon"), "dst_account").join(c, "cashout_atm_id")
    x, y, z = geo.to_cartesian("lat", "lon")
    return tidy(rows.select("txn_id", geo.haversine_km("lat", "lon", "clat", "clon").alias("km"), geo.bearing_deg("lat", "lon", "clat", "clon").alias("bearing"),
                            x.alias("x"), y.alias("y"), z.alias("z")))


@query("normalised_timestamps", "complaints", """
select ticket_id, case when ticket_id % 4 = 3 then null when ticket_id % 4 = 1 then filed_s - 19800 else filed_s end as instant_s from complaints""")
def _(d):
    # four dialects of the same instant: naive, +05:30, Z, garbage
    base = F.date_format(F.timestamp_seconds("filed_s"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("ticket_id") % 4
    raw = F.when(kind == 0, base).when(kind == 1, F.concat(base, F.lit("+05:30"))).when(kind == 2, F.concat(base, F.lit("Z"))).otherwise("not a time")
    return d.complaints.select("ticket_id", F.unix_timestamp(timing.normalise_timestamp(raw)).alias("instant_s"))


CITY_RULE = """
names as (select lower(n_name) as key, n_name as city from nation union all select 'old ' || lower(n_name), n_name from nation),
typed as (select ticket_id, stolen_amount, state, case ticket_id % 3 when 0 then '  ' || upper(city) || ' ' when 1 then 'Old   ' || lower(city) else city || 'x' end as raw_city from complaints),
folded as (select *, lower(trim(regexp_replace(raw_city, '\\s+', ' ', 'g'))) as key from typed)"""


def _typed_complaints(d):
    kind = F.col("ticket_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("  "), F.upper("city"), F.lit(" "))).when(kind == 1, F.concat(F.lit("Old   "), F.lower("city"))).otherwise(F.concat("city", F.lit("x")))
    nation = d.raw("nation").join(d.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    states = nation.select(F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    aliases = nation.select(F.concat(F.lit("old "), F.lower("n_name")).alias("alias"), F.col("n_name").alias("city"))
    return cases.canonical_city(d.complaints.withColumn("city", raw), states, aliases)


@query("canonical_city", "complaints", """
select ticket_id, n.city as canonical_city, coalesce(r_name, f.state) as state from folded f left join names n using (key)
left join nation on n_name = n.city left join region on n_regionkey = r_regionkey""", CITY_RULE)
def _(d):
    return cases.authoritative_state(_typed_complaints(d)).select("ticket_id", "canonical_city", "state")


@query("complaint_quality", "complaints", """
select ticket_id, coalesce(n.city, f.raw_city) as city, (n.city is not null and stolen_amount > 0) as accepted,
  (case when stolen_amount > 0 then 0 else 1 end) + (case when n.city is null then 1 else 0 end) as n_reasons
from folded f left join names n using (key)""", CITY_RULE)
def _(d):
    return cases.complaint_quality(_typed_complaints(d)).select("ticket_id", "city", "accepted", F.size("reasons").alias("n_reasons"))


@query("working_status_counts", "complaints", "select case when status is null or status='ACTIVE' then 'New' else status end as status, count(*) as n from complaints group by 1")
def _(d):
    return d.complaints.groupBy(text.working_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("decorated_complaints", "complaints notes", """
select ticket_id, state, case when status is null or status='ACTIVE' then 'New' else status end as status, coalesce(n, 0) as note_count
from complaints left join (select case_id, count(*) as n from notes group by 1) on case_id = ticket_id""")
def _(d):
    return cases.decorate_complaints(d.complaints, d.notes).select("ticket_id", "state", "status", "note_count")


@query("account_vector_risk", "accounts", """
select account_id, round(case when v is null then 0.0 else 1/(1+exp(-(list_sum(list_transform(generate_series(1, len(v)), lambda i: v[i]::double * ((i % 5) - 2) / 10.0)) + 0.1))) end,4) as risk
from accounts left join (select vec_id as account_id, embedding as v from embeddings) using (account_id)""")
def _(d):
    e = d.raw("embeddings")
    width = len(e.select("embedding").head()[0])
    weights = [((i % 5) - 2) / 10.0 for i in range(1, width + 1)]
    rows = d.accounts.join(e.select(F.col(e.columns[0]).alias("account_id"), "embedding"), "account_id", "left")
    return tidy(learning.logistic_score(rows, "embedding", weights, 0.1).select("account_id", "risk"))


@query("absent_values", "notes", """
select case_id, turn, case when trim(v)='' or lower(trim(v))='nan' then null else v end as kept
from (select case_id, turn, case turn % 3 when 0 then ' ' when 1 then 'NaN' else author end as v from notes)""")
def _(d):
    raw = F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, "NaN").otherwise(F.col("author"))
    return d.notes.select("case_id", "turn", text.clean_absent(raw).alias("kept"))


@query("machine_open_at_forecast", "ledger cashpoints", """
select txn_id, case when opens_min is null or closes_min is null then null when closes_min > opens_min then m >= opens_min and m < closes_min else m >= opens_min or m < closes_min end as is_open
from (select txn_id, opens_min, closes_min, ((ts_s // 60) + time_to_cashout_min) % 1440 as m from ledger join cashpoints on cashout_atm_id = atm_id)""")
def _(d):
    rows = acct.cashouts(d.ledger).join(d.cashpoints, F.col("cashout_atm_id") == F.col("atm_id"))
    minute = F.pmod(F.floor(F.col("ts_s") / 60) + F.col("time_to_cashout_min"), F.lit(1440))
    return rows.select("txn_id", timing.open_at(minute, F.col("opens_min"), F.col("closes_min")).alias("is_open"))


@query("clock_trust", "complaints", """
select ticket_id, (ticket_id % 5 = 0 or ticket_id % 3 = 1) as trusted from complaints""")
def _(d):
    base = F.date_format(F.timestamp_seconds("filed_s"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("ticket_id") % 3 == 1, F.concat(base, F.lit("+00:00"))).otherwise(base)
    return d.complaints.select("ticket_id", timing.trusted_clock(F.col("ticket_id") % 5 == 0, raw).alias("trusted"))


@query("rupee_labels", "complaints", """
select ticket_id, case when stolen_amount >= 1e7 then format('Rs {:.2f} Cr', stolen_amount/1e7) when stolen_amount >= 1e5 then format('Rs {:.2f} L', stolen_amount/1e5)
  else 'Rs ' || format('{:,}', cast(round_even(stolen_amount, 0) as bigint)) end as label, strftime(make_timestamp(filed_s*1000000), '%Y-%m-%dT%H') as bucket from complaints""")
def _(d):
    return d.complaints.select("ticket_id", text.rupee_text(F.col("stolen_amount")).alias("label"), timing.hour_bucket(F.timestamp_seconds("filed_s")).alias("bucket"))


@query("safe_artefact_names", "evidence", r"""
select evidence_no, substr(case when c='' then 'artefact' else c end, 1, 180) as safe_name
from (select evidence_no, regexp_replace(regexp_replace(trim(regexp_extract('../' || kind || '/..' || replace(text, chr(10), ' '), '([^/]*)$', 1)), '[^A-Za-z0-9._ -]', '_', 'g'), '^\.+', '') as c from evidence)""")
def _(d):
    name = F.concat(F.lit("../"), "kind", F.lit("/.."), F.replace("text", F.lit("\n"), F.lit(" ")))
    return d.evidence.select("evidence_no", text.safe_display_name(name).alias("safe_name"))


@query("ledger_format_checks", LED, """
select count(*) as rows, count(*) filter (not coalesce(amount > 0,false)) as bad_amount, count(*) filter (hop_depth not between 0 and 4) as bad_hop,
  count(*) filter (is_terminal not in (0,1)) as bad_flag, count(*) filter (not coalesce(src_account <> dst_account,false)) as self_transfers,
  count(*) filter (src_account is null or dst_account is null) as null_accounts, count(*) filter (is_terminal = 1 and cashout_atm_id is null) as unlabelled_terminals from ledger""")
def _(d):
    return cases.format_checks(d.ledger)


# --- account behaviour -------------------------------------------------------------------

@query("recurring_cashpoints", "ledger cashpoints", """
select s.*, coalesce(city,'') as city, coalesce(district,'') as district, coalesce(state,'') as state, bank_id, round(coalesce(lat,0),4) as lat, round(coalesce(lon,0),4) as lon, round(coalesce(risk,0),4) as cashout_risk_score
from (select cashout_atm_id as atm_id, count(*) as cashouts, count(distinct complaint_id) as distinct_complaints, round(sum(amount),4) as total_amount, max(ts_s) as last_seen_s
  from ledger where complaint_id is not null and is_terminal=1 and cashout_atm_id is not null group by 1 order by 3 desc, 2 desc, 1 limit 25) s left join cashpoints using (atm_id)""")
def _(d):
    return tidy(acct.recurring_cashpoints(tables.attached_only(d.ledger), d.cashpoints))


TOTALS = """
got as (select dst_account as account_id, sum(amount) as total_received, count(*) as in_degree, count(distinct src_account) as distinct_senders from ledger group by 1),
gave as (select src_account as account_id, sum(amount) as total_sent, count(*) as out_degree, count(distinct dst_account) as distinct_receivers from ledger group by 1),
totals as (select account_id, coalesce(total_received,0) as total_received, coalesce(in_degree,0) as in_degree, coalesce(distinct_senders,0) as distinct_senders,
  coalesce(total_sent,0) as total_sent, coalesce(out_degree,0) as out_degree, coalesce(distinct_receivers,0) as distinct_receivers,
  case when in_degree > 0 then total_received/in_degree else 0.0 end as avg_txn_amount from got full join gave using (account_id)),
night as (select src_account as account_id, avg(case when ((ts_s // 3600) % 24) in (23,0,1,2,3,4) then 1.0 else 0.0 end) as night_txn_ratio from ledger group by 1),
gaps as (select c.dst_account as account_id, c.txn_id, min(b.ts_s) - c.ts_s as gap_s from ledger c asof join (select distinct src_account, ts_s from ledger) b on c.dst_account = b.src_account and c.ts_s <= b.ts_s group by c.dst_account, c.txn_id, c.ts_s),
dwell as (select account_id, quantile_cont(gap_s::double, 0.5) as median_dwell_seconds from gaps group by 1),
bursts as (select account_id, max(w) as burst_out_5min from (select src_account as account_id, count(*) over (partition by src_account order by ts_s range between current row and 300 following) as w from ledger) group by 1),
hops as (select dst_account as account_id, max(hop_depth) as hop_depth from ledger where is_fraud=1 group by 1),
features as (select account_id, bank_id, city, round(lat,6) as lat, round(lon,6) as lon, total_received, total_sent, in_degree as txn_count_24h, round(avg_txn_amount,2) as avg_txn_amount,
  in_degree, out_degree, distinct_senders, distinct_receivers, round(coalesce(median_dwell_seconds, 120*24*3600.0),1) as median_dwell_seconds,
  case when total_received > 0 then round(least(3.0, greatest(0.0, total_sent/total_received)),4) else 0.0 end as passthrough_ratio, account_age_days,
  round(coalesce(night_txn_ratio,0.0),4) as night_txn_ratio, coalesce(burst_out_5min,1) as burst_out_5min, is_mule_label, coalesce(hop_depth,0) as hop_depth
  from totals join accounts using (account_id) left join night using (account_id) left join dwell using (account_id) left join bursts using (account_id) left join hops using (account_id))"""


@query("account_totals", LED, """select account_id, round(total_received,4) as total_received, in_degree, distinct_senders, round(total_sent,4) as total_sent, out_degree, distinct_receivers, round(avg_txn_amount+1e-9,4) as avg_txn_amount from totals""",
       TOTALS.split("night as")[0].rstrip().rstrip(","))
def _(d):
    return tidy(acct.account_totals(d.ledger).withColumn("avg_txn_amount", F.col("avg_txn_amount") + 1e-9))


@query("night_ratio", LED, "select src_account as account_id, round(avg(case when ((ts_s // 3600) % 24) in (23,0,1,2,3,4) then 1.0 else 0.0 end),4) as night_txn_ratio from ledger group by 1")
def _(d):
    return tidy(acct.night_ratio(d.ledger))


@query("median_dwell", LED, "select account_id, round(median_dwell_seconds,1) as median_dwell_seconds from dwell", "gaps as" + TOTALS.split("gaps as")[1].split(",\nbursts")[0])
def _(d):
    return tidy(acct.median_dwell(d.ledger), 1)


@query("credit_to_debit_gaps", LED, "select account_id, sum(gap_s)::bigint as total_gap_s, count(*) as credits, min(gap_s) as min_gap_s from gaps group by 1", "gaps as" + TOTALS.split("gaps as")[1].split(",\ndwell")[0])
def _(d):
    return acct.dwell_gaps(d.ledger).groupBy("account_id").agg(F.sum(F.col("gap_s") * F.col("credits")).alias("total_gap_s"), F.sum("credits").cast("long").alias("credits"), F.min("gap_s").alias("min_gap_s"))


@query("burst_out_5min", LED, "select * from bursts", "bursts as" + TOTALS.split("bursts as")[1].split(",\nhops")[0])
def _(d):
    return acct.burst_5min(d.ledger)


@query("deepest_fraud_hop", LED, "select dst_account as account_id, max(hop_depth) as hop_depth from ledger where is_fraud=1 group by 1")
def _(d):
    return acct.max_hop(d.ledger)


@query("account_features", "ledger accounts", "select * replace (round(total_received,4) as total_received, round(total_sent,4) as total_sent) from features", TOTALS)
def _(d):
    return tidy(acct.account_features(d.ledger, d.accounts), 6).withColumns({c: F.round(c, 4) for c in ("total_received", "total_sent")})


@query("account_ratios", "ledger accounts", """
select account_id, round(ln(1+median_dwell_seconds),6) as dwell_log, round((txn_count_24h+distinct_receivers)/(least(account_age_days::double,120.0)+1),6) as activity_per_day,
  round(total_sent/(total_received+1),6) as in_out_amount_ratio, round(total_received/(txn_count_24h+1)+1e-9,6) as avg_amount_per_credit, round(txn_count_24h/(distinct_receivers+1.0),6) as counterparty_concentration from features""", TOTALS)
def _(d):
    out = acct.derive_ratios(acct.account_features(d.ledger, d.accounts))
    return tidy(out.select("account_id", "dwell_log", "activity_per_day", "in_out_amount_ratio", (F.col("avg_amount_per_credit") + 1e-9).alias("avg_amount_per_credit"), "counterparty_concentration"), 6)


SIDES = """
sides as (select src_account as account_id, ts_s, case when src_account=dst_account then 1 else 0 end as slf from ledger union all select dst_account, ts_s, 0 from ledger),
recent as (select account_id, count(*) as n_sides, count(*) - sum(slf) as n_rows, (max(ts_s)-min(ts_s))/60.0 as span_min
  from (select *, max(ts_s) over (partition by account_id) as latest from sides) where ts_s >= latest - 3600 group by 1)"""


@query("recent_rate", LED, "select account_id, round(case when n_rows <= 1 then 0.0 when span_min = 0 then n_rows else n_rows/span_min end,4) as recent_rate from recent", SIDES)
def _(d):
    return tidy(acct.recent_rate(d.ledger))


@query("account_velocity", LED, "select account_id, round(case when n_sides <= 1 then 0.0 else n_sides/greatest(0.1, span_min) end,4) as velocity from recent", SIDES)
def _(d):
    return tidy(acct.account_velocity(d.ledger))


TIMING = """
steps as (select complaint_id, ts_s - lag(ts_s) over (partition by complaint_id order by ts_s) as gap from ledger where complaint_id is not null),
timing as (select complaint_id, coalesce(quantile_cont(gap::double, 0.5),0.0) as median_gap_s, coalesce(min(gap),0)::double as min_gap_s from steps group by 1),
spans as (select complaint_id, (max(ts_s)-min(ts_s))::double as span_s from ledger where complaint_id is not null group by 1)"""


@query("chain_timing", LED, "select complaint_id, round(median_gap_s,2) as median_gap_s, min_gap_s, span_s from spans join timing using (complaint_id)", TIMING)
def _(d):
    return tidy(acct.chain_timing(tables.attached_only(d.ledger)), 2).select("complaint_id", "median_gap_s", "min_gap_s", "span_s")


@query("transfer_gaps", LED, "select complaint_id, gap as gap_s, count(*) as n from steps where gap is not null group by 1, 2", TIMING)
def _(d):
    return acct.transfer_gaps(tables.attached_only(d.ledger)).groupBy("complaint_id", "gap_s").agg(F.sum("weight").alias("n"))


@query("minutes_from_first", LED, "select txn_id, complaint_id, round((ts_s - min(ts_s) over (partition by complaint_id))/60.0,2) as minutes_from_first from ledger where complaint_id is not null")
def _(d):
    return acct.minutes_from_first(tables.attached_only(d.ledger)).select("txn_id", "complaint_id", "minutes_from_first")


@query("accounts_seen", LED, "select src_account as account_id from ledger union select dst_account from ledger")
def _(d):
    return acct.accounts_seen(d.ledger)


HISTORY = """
history as (select ticket_id as complaint_id from (select ticket_id, row_number() over (order by filed_s, ticket_id) as r, count(*) over () as n from complaints) where r <= floor(0.5*n)),
past as (select dst_account as account_id, cashout_atm_id as atm_id, count(*) as n from ledger join history using (complaint_id) where is_terminal=1 and cashout_atm_id in (select atm_id from cashpoints) group by 1,2)"""


@query("history_cut", "complaints", "select complaint_id from history", HISTORY.split(",\npast")[0])
def _(d):
    return candidates.history_complaints(d.complaints)


@query("history_split_counts", "complaints ledger", """
select count(*) filter (complaint_id in (select complaint_id from history)) as in_history, count(*) filter (complaint_id not in (select complaint_id from history)) as outside from ledger where complaint_id is not null""", HISTORY.split(",\npast")[0])
def _(d):
    inside, outside = candidates.split_history(tables.attached_only(d.ledger), candidates.history_complaints(d.complaints))
    return inside.agg(F.count(F.lit(1)).alias("in_history")).withColumn("outside", outside.agg(F.count(F.lit(1))).scalar())


@query("split_overlap", "complaints ledger", "select 0::bigint as overlap, (select count(distinct complaint_id) from ledger where complaint_id is not null) as complaints")
def _(d):
    """No complaint may sit on both sides of the training split."""
    marked = learning.split_by_complaint(tables.attached_only(d.ledger).select("complaint_id"))
    train, test = (marked.filter(F.col("part") == p).select("complaint_id") for p in ("train", "test"))
    return (train.intersect(test).agg(F.count(F.lit(1)).alias("overlap"))
            .withColumn("complaints", marked.select("complaint_id").distinct().agg(F.count(F.lit(1))).scalar()))


@query("machine_priors", "complaints ledger cashpoints", "select atm_id, sum(n)::bigint as atm_prior from past group by 1", HISTORY)
def _(d):
    return candidates.cashout_priors(tables.attached_only(d.ledger), candidates.history_complaints(d.complaints), d.cashpoints)[0]


@query("account_machine_priors", "complaints ledger cashpoints", "select * from past", HISTORY)
def _(d):
    return candidates.cashout_priors(tables.attached_only(d.ledger), candidates.history_complaints(d.complaints), d.cashpoints)[1]


@query("terminal_amounts", "ledger complaints accounts", """
select txn_id, round(coalesce(stolen_amount,100000.0),2) as stolen_amount, bank_id, round(coalesce(lat,20.5937),6) as lat, round(coalesce(lon,78.9629),6) as lon
from ledger left join complaints on complaint_id = ticket_id left join accounts on dst_account = account_id where complaint_id is not null and is_terminal=1""")
def _(d):
    rows = candidates.terminal_rows(tables.attached_only(d.ledger), d.complaints, d.accounts)
    return tidy(rows.select("txn_id", "stolen_amount", "bank_id", "lat", "lon"), 6).withColumn("stolen_amount", F.round("stolen_amount", 2))


@query("city_state_vote", "accounts cashpoints complaints", """
select city_key, arg_min(state, (-votes, state)) as state, sum(votes)::bigint as votes, count(*) as states_seen, count(*) > 1 as conflict
from (select lower(trim(city)) as city_key, state, count(*) as votes from (select city, state from accounts union all select city, state from cashpoints union all select city, state from complaints) group by 1,2) group by 1""")
def _(d):
    return acct.city_state_vote(d.accounts, d.cashpoints, d.complaints)


@query("city_contribution", "accounts cashpoints complaints", """
select source, count(*) as cities, count(*) filter (k = 1) as unique_cities from (select *, count(*) over (partition by city_key) as k from
 (select distinct 'accounts' as source, lower(trim(city)) as city_key from accounts union all select distinct 'machines', lower(trim(city)) from cashpoints union all select distinct 'complaints', lower(trim(city)) from complaints)) group by 1""")
def _(d):
    return acct.city_contribution({"accounts": d.accounts, "machines": d.cashpoints, "complaints": d.complaints})


@query("amount_percentiles", "complaints", """
select fraud_type, round(quantile_cont(stolen_amount,0.05),4) as p05, round(quantile_cont(stolen_amount,0.5),4) as p50, round(quantile_cont(stolen_amount,0.95),4) as p95 from complaints group by 1""")
def _(d):
    q = exact_quantiles(d.complaints, ["fraud_type"], "stolen_amount", [0.05, 0.5, 0.95])
    return tidy(q.select("fraud_type", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))]))
