"""Evaluation, audit and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import accounts as acct
from ..operators import audits, candidates, choice, evaluation, graph, learning, spatial, surface
from ..operators.distribution import exact_quantiles
from ..session import cut_lineage
from ..sources import tables
from .ledger_queries import HISTORY, TOTALS
from .place_queries import ALL, CELLS, CREW, SCORED, SURFACE, TERMINALS, ZONE, Picture, crew_of, mass_sql
from .registry import hav, query, tidy

# A plain score with a known relation to the label; ties are common on purpose.
SCORES = "scores as (select account_id, is_mule_label as label, (account_id % 2)*0.25 + is_mule_label*0.25 + ((account_id*7919) % 50)/100.0 as score from accounts)"


def _scores(d) -> DataFrame:
    n = F.col("account_id")
    return d.accounts.select("account_id", F.col("is_mule_label").alias("label"), ((n % 2) * 0.25 + F.col("is_mule_label") * 0.25 + ((n * 7919) % 50) / 100.0).alias("score"))


CONF = SCORES + """,
conf as (select count(*) filter (score >= 0.5 and label=1) as tp, count(*) filter (score >= 0.5 and label=0) as fp, count(*) filter (score < 0.5 and label=1) as fn, count(*) filter (score < 0.5 and label=0) as tn from scores),
rates as (select *, coalesce(tp/nullif(tp+fp,0),0.0) as precision, coalesce(tp/nullif(tp+fn,0),0.0) as recall, 2.0*tp/(2.0*tp+fp+fn) as f1, (tp+tn)/(tp+tn+fp+fn) as accuracy from conf)"""


@query("confusion", "accounts", "select tp, fp, fn, tn, round(precision,4) as precision, round(recall,4) as recall, round(f1,4) as f1, round(accuracy,4) as accuracy from rates", CONF)
def _(d):
    return tidy(evaluation.confusion(_scores(d), 0.5))


@query("roc_auc", "accounts", """
select round((sum(case when label=1 then r end) - p*(p+1)/2.0)/(p*(n-p)),6) as auc, round(greatest((sum(case when label=1 then r end) - p*(p+1)/2.0)/(p*(n-p)), 1-(sum(case when label=1 then r end) - p*(p+1)/2.0)/(p*(n-p))),6) as auc_any
from (select label, rank() over (order by score) + (count(*) over (partition by score) - 1)/2.0 as r, sum(label) over () as p, count(*) over () as n from scores) group by p, n""", SCORES)
def _(d):
    return tidy(evaluation.roc_auc(_scores(d)), 6)


@query("average_precision", "accounts", """
select round(sum(pos*cp/cn)/sum(pos),6) as average_precision from (select pos, sum(pos) over (order by score desc) as cp, sum(n) over (order by score desc) as cn from (select score, sum(label) as pos, count(*) as n from scores group by 1))""", SCORES)
def _(d):
    return tidy(evaluation.average_precision(_scores(d)), 6)


SWEEP = SCORES + """,
cut as (select distinct unnest(quantile_cont(score::double, [""" + ",".join(f"{i}/100.0" for i in range(1, 100)) + """])) as threshold from scores),
sweep as (select threshold, sum(case when score >= threshold then label else 0 end)::bigint as tp, count(*) filter (score >= threshold and label=0) as fp, count(*) filter (score < threshold and label=1) as fn from cut, scores group by 1),
swept as (select *, case when 2.0*tp+fp+fn > 0 then 2.0*tp/(2.0*tp+fp+fn) else 0.0 end as f1 from sweep)"""


@query("threshold_sweep", "accounts", "select round(threshold,6) as threshold, tp, fp, fn, round(f1,6) as f1 from swept", SWEEP)
def _(d):
    return tidy(evaluation.threshold_sweep(_scores(d)).select("threshold", "tp", "fp", "fn", "f1"), 6)


@query("best_threshold", "accounts", "select round(threshold,6) as threshold, round(f1,6) as f1 from swept order by swept.f1 desc, swept.threshold limit 1", SWEEP)
def _(d):
    return tidy(evaluation.best_threshold(_scores(d)), 6)


PROJECTED = CONF + """,
scen as (select * from (values ('measured', null), ('half_percent', 0.005), ('one_in_thousand', 0.001), ('one_in_ten_thousand', 0.0001)) s(scenario, prevalence)),
proj as (select scenario, coalesce(prevalence, (tp+fn)/(tp+fn+fp+tn)) as p, tp/(tp+fn) as tpr, fp/(fp+tn) as fpr from scen, conf)"""


def _scenarios(d):
    rows = [("measured", None), ("half_percent", 0.005), ("one_in_thousand", 0.001), ("one_in_ten_thousand", 0.0001)]
    return d.spark.createDataFrame(rows, "scenario string, prevalence double")


@query("prevalence_projection", "accounts", "select scenario, round(p,6) as prevalence, round(tpr*p/(tpr*p+fpr*(1-p)),4) as precision, round((tpr*p+fpr*(1-p))*100000,1) as flagged_per_100k, round(tpr*p*100000,1) as true_per_100k, round(fpr*(1-p)*100000,1) as innocent_per_100k from proj", PROJECTED)
def _(d):
    return evaluation.prevalence_projection(evaluation.confusion(_scores(d), 0.5), _scenarios(d))


@query("report_violations", "accounts", "select 'none' as violation from conf where false", PROJECTED)
def _(d):
    counts = evaluation.confusion(_scores(d), 0.5).select("tp", "fp", "fn", "tn")
    return audits.ledger_violations(counts, evaluation.prevalence_projection(counts, _scenarios(d)))


@query("precision_at_budget", "accounts", """
select k, sum(label)::bigint as hits, round(sum(label)/count(*),4) as precision, round(sum(label)/(select sum(label) from scores),4) as recall, round(sum(label)/count(*)/((select sum(label) from scores)/(select count(*) from scores)),4) as lift
from (select label, row_number() over (order by score desc, account_id) as r from scores), (values (100),(500),(1000)) b(k) where r <= k group by 1""", SCORES)
def _(d):
    return tidy(evaluation.precision_at(_scores(d)))


@query("calibration_bands", "accounts", "select least(10, floor(score*10)+1)::int as band, count(*) as n, round(avg(label),4) as true_rate, round(avg(score)+1e-9,4) as mean_score from scores group by 1", SCORES)
def _(d):
    return tidy(audits.calibration_bands(_scores(d)).withColumn("mean_score", F.col("mean_score") + 1e-9))


@query("calibration_breaks", "accounts", """
select band, true_rate, before from (select band, round(true_rate,4) as true_rate, round(lag(true_rate) over (order by band),4) as before, true_rate < lag(true_rate) over (order by band) as falls
 from (select least(20, floor(score*20)+1)::int as band, avg(label) as true_rate from scores group by 1)) where falls""", SCORES)
def _(d):
    """Of twenty bands those with a lower true rate than the band before."""
    return tidy(audits.calibration_breaks(audits.calibration_bands(_scores(d), bands=20)).select("band", "true_rate", "before"))


@query("class_weight", "accounts", "select count(*) filter (is_mule_label=0) as n_clean, count(*) filter (is_mule_label=1) as n_mule, round(count(*) filter (is_mule_label=0)/greatest(1,count(*) filter (is_mule_label=1)),4) as pos_weight from accounts")
def _(d):
    return tidy(learning.class_weight(_scores(d)))


@query("attainable_ceiling", "accounts", "select pos, pos*0.9 as kept, neg*0.001 as false_reports, round(0.9::double,4) as precision, round(pos*0.9/(pos*0.9+neg*0.001),4) as recall, round(2*0.9*(pos*0.9/(pos*0.9+neg*0.001))/(0.9+pos*0.9/(pos*0.9+neg*0.001)),4) as f1 from (select sum(is_mule_label)::double as pos, (count(*)-sum(is_mule_label))::double as neg from accounts)")
def _(d):
    return tidy(audits.attainable_ceiling(_scores(d), 0.1, 0.001))


# --- feature audits --------------------------------------------------------------------------------

COLUMNS = list(acct.FEATURE_COLUMNS)
STACK = TOTALS + ",\nlong as (" + " union all ".join(f"select account_id, is_mule_label as label, '{c}' as feature, {c}::double as value from features" for c in COLUMNS) + ")"


def _features(d, moves=None):
    moves = acct.moved(d.ledger) if moves is None else moves
    return cut_lineage(acct.account_features(moves, d.accounts, written=True).withColumn("label", F.col("is_mule_label")))


@query("single_feature_f1", "ledger accounts", """
select feature, round(max(f1),6) as best_f1, max(f1) >= 0.95 as leak from (select feature, t, 2.0*sum(label)/(count(*) + any_value(tp)) as f1 from
 (select l.feature, t, side, label, any_value((select sum(label) from (select distinct account_id, label from long))) over () as tp, count(*) over (partition by l.feature, t, side) as flagged
  from (select l.*, t, unnest([value > t, value <= t]) as hit, unnest([1, 2]) as side from long l join (select distinct feature, unnest(quantile_cont(value, [""" + ",".join(repr(p) for p in audits.LEAK_PROBS) + """])) as t from long group by feature) c using (feature)) l where hit) group by feature, t, side having count(*) < (select count(*) from features)) group by 1""", STACK)
def _(d):
    return tidy(audits.single_feature_f1(_features(d), COLUMNS), 6)


@query("class_overlap", "ledger accounts", "select feature, label, round(quantile_cont(value,0.05)+1e-9,4) as p_low, round(quantile_cont(value,0.95)+1e-9,4) as p_high from long group by 1, 2", STACK)
def _(d):
    out = audits.class_overlap(_features(d), COLUMNS)
    return tidy(out.withColumn("p_low", F.col("p_low") + 1e-9).withColumn("p_high", F.col("p_high") + 1e-9))


PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]]


@query("correlation_pairs", "ledger accounts", " union all ".join(f"select '{a}' as a, '{b}' as b, round(case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 then corr({a}, {b}) end,6) as r from features" for a, b in PAIRS), TOTALS)
def _(d):
    out = audits.correlation_pairs(_features(d), COLUMNS)
    return tidy(out.withColumn("r", F.when(~F.isnan("r"), F.col("r"))), 6)


@query("feature_auc", "ledger accounts", """
select feature, round((sum(case when label=1 then r end) - p*(p+1)/2.0)/(p*(n-p)),6) as auc from (select feature, label, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1)/2.0 as r, sum(label) over (partition by feature) as p, count(*) over (partition by feature) as n from long) group by feature, p, n""", STACK)
def _(d):
    return tidy(audits.feature_auc(_features(d), COLUMNS).select("feature", "auc"), 6)


@query("feature_signal")
def _(d):
    return tidy(audits.signal_table(_features(d), COLUMNS), 6)


@query("redundant_features")
def _(d):
    f = _features(d)
    return tidy(audits.redundant_pairs(f, COLUMNS, audits.feature_auc(f, COLUMNS)), 6)


@query("linkage_audit", ALL, """
select 'complaints' as "check", count(*) as n from complaints union all select 'transfers', count(*) from ledger union all select 'accounts', count(*) from accounts union all select 'machines', count(*) from cashpoints
union all select 'transfers_without_complaint', count(*) from ledger where complaint_id is not null and complaint_id not in (select ticket_id from complaints)
union all select 'complaints_without_transfers', count(*) from complaints where ticket_id not in (select complaint_id from ledger where complaint_id is not null)
union all select 'unknown_accounts', count(*) from (select src_account as a from ledger union select dst_account from ledger) where a not in (select account_id from accounts)
union all select 'unknown_machines', count(*) from ledger where cashout_atm_id is not null and cashout_atm_id not in (select atm_id from cashpoints)
union all select 'machines_never_used', count(*) from cashpoints where atm_id not in (select cashout_atm_id from ledger where cashout_atm_id is not null)""")
def _(d):
    return audits.linkage_audit(d.complaints, d.ledger, d.accounts, d.cashpoints)


@query("dataset_summary", ALL, """
with busy as (select a, count(*) as n from (select src_account as a from ledger union all select dst_account from ledger) group by 1)
select count(*) as transfers, sum(is_fraud)::bigint as fraud_transfers, (select count(*) from busy) as accounts_active, (select round(avg(is_mule_label),4) from accounts) as mule_prevalence, (select count(*) from complaints) as complaints,
 (select round(quantile_cont(n::double,0.5),4) from busy) as activity_p50, (select round(quantile_cont(n::double,0.95),4) from busy) as activity_p95, (select round(avg(case when n<=2 then 1.0 else 0.0 end),4) from busy) as quiet_share from ledger""".replace("\nwith busy", "\nselect * from (with busy", 1) + ")")
def _(d):
    return tidy(audits.dataset_summary(d.ledger, d.accounts, d.complaints))


# --- ranking and zones -------------------------------------------------------------------------------

# Labelled cash-outs outside history, on the test side of the complaint split: what is reported was never learned from.
HELD = HISTORY + """,
evalset as (select txn_id as event_id, complaint_id, dst_account as account_id, cashout_atm_id, time_to_cashout_min, lat, lon, bank_id from ledger join accounts on dst_account = account_id
  where complaint_id is not null and is_terminal = 1 and cashout_atm_id in (select atm_id from cashpoints) and complaint_id not in (select complaint_id from history)),
parts as (select complaint_id, ('0x' || substr(md5('42|' || complaint_id), 1, 12))::bigint / 281474976710656.0 as u from (select distinct complaint_id from evalset)),
truth as (select * from evalset where complaint_id in (select complaint_id from parts where u < (select s[least(n, floor(0.2*n)::bigint + 1)] from (select list(u order by u) as s, count(*) as n from parts))))"""

TRUTH = SCORED + "," + HELD + """,
truthrank as (select t.event_id, s.choice_rank as rank, s.rank as dist_rank from truth t left join scored s on s.lat=t.lat and s.lon=t.lon and s.bank_id=t.bank_id and s.atm_id=t.cashout_atm_id)"""


def _truth(d):
    """(event_id, complaint_id, account_id, cashout_atm_id, time_to_cashout_min, lat, lon, bank_id) of every held-out cash-out."""
    history = candidates.history_complaints(d.complaints)
    ends = (tables.attached_only(d.ledger).filter("is_terminal = 1")
            .select(F.col("txn_id").alias("event_id"), "complaint_id", F.col("dst_account").alias("account_id"), "cashout_atm_id", "time_to_cashout_min")
            .join(history, "complaint_id", "left_anti").join(d.cashpoints.select(F.col("atm_id").alias("cashout_atm_id")), "cashout_atm_id", "left_semi")
            .join(d.accounts.select("account_id", "lat", "lon", "bank_id"), "account_id"))
    return learning.split_by_complaint(cut_lineage(ends)).filter("part = 'test'").drop("part")


@query("truth_ranks", ALL, "select * from truthrank", TRUTH)
def _(d):
    s = choice.fixed_scores(d.accounts, d.cashpoints).select("lat", "lon", "bank_id", F.col("atm_id").alias("cashout_atm_id"), F.col("choice_rank"), F.col("rank").alias("dist_rank"))
    return _truth(d).join(s, ["lat", "lon", "bank_id", "cashout_atm_id"], "left").select("event_id", F.col("choice_rank").alias("rank"), "dist_rank")


CURVE = "select k, round(count(*) filter (rank <= k)/count(*),4) as containment, round(count(*) filter (dist_rank <= k)/count(*),4) as baseline, round(1 - k/(select count(*) from cashpoints),6) as reduction, count(*) - count(rank) as retrieval_failures, count(rank) - count(*) filter (rank <= k) as ranking_failures from truthrank, "


def _curve(d, ks):
    ranks = _truth_ranks(d)
    return evaluation.containment_curve(ranks, d.cashpoints.agg(F.count(F.lit(1))).scalar(), ks)


def _truth_ranks(d):
    from .registry import QUERIES

    return QUERIES["truth_ranks"](d)


@query("containment_curve", ALL, CURVE + "(select unnest(generate_series(1,10)) as k) group by k", TRUTH)
def _(d):
    return _curve(d, tuple(range(1, 11)))


@query("nearest_baseline", ALL, CURVE.replace("round(count(*) filter (rank <= k)/count(*),4) as containment, ", "").replace(", round(1 - k/(select count(*) from cashpoints),6) as reduction, count(*) - count(rank) as retrieval_failures, count(rank) - count(*) filter (rank <= k) as ranking_failures", "") + "(values (1),(3)) v(k) group by k", TRUTH)
def _(d):
    """Distance alone: the nearest and the nearest three machines."""
    return _curve(d, (1, 3)).select("k", "baseline")


ZONED = TRUTH + "," + ZONE[len(SCORED) + 2:] + f""",
near3 as (select lat, lon, avg(plat) as nlat, avg(plon) as nlon from near where rank <= 3 group by 1, 2),
zerr as (select t.event_id, {hav('zone_lat', 'zone_lon', 'c.lat', 'c.lon')} as err_km, greatest(zone_radius_km,0.05) as r, {hav('nlat', 'nlon', 'c.lat', 'c.lon')} as near_km, {hav('t.lat', 't.lon', 'c.lat', 'c.lon')} as account_km
  from truth t join zone z on z.lat=t.lat and z.lon=t.lon and z.bank_id=t.bank_id join near3 n on n.lat=t.lat and n.lon=t.lon join cashpoints c on c.atm_id = t.cashout_atm_id)"""


def _zone_errors(d):
    scored = cut_lineage(choice.fixed_scores(d.accounts, d.cashpoints))
    zones = choice.search_zone(scored, ["lat", "lon", "bank_id"], d.cashpoints)
    near3 = scored.filter("rank <= 3").select("lat", "lon", "atm_id", "plat", "plon").distinct().groupBy("lat", "lon").agg(F.avg("plat").alias("nlat"), F.avg("plon").alias("nlon"))
    c = d.cashpoints.select(F.col("atm_id").alias("cashout_atm_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    rows = _truth(d).join(zones, ["lat", "lon", "bank_id"]).join(near3, ["lat", "lon"]).join(c, "cashout_atm_id")
    return rows.select("event_id", geo.haversine_km("zone_lat", "zone_lon", "clat", "clon").alias("err_km"), F.greatest("zone_radius_km", F.lit(0.05)).alias("r"),
                       geo.haversine_km("nlat", "nlon", "clat", "clon").alias("near_km"), geo.haversine_km("lat", "lon", "clat", "clon").alias("account_km"))


@query("zone_containment", ALL, """select count(*) as n, round(avg(case when err_km <= r then 1.0 else 0.0 end),4) as zone_hit, round(avg(case when near_km <= r then 1.0 else 0.0 end),4) as nearest3_hit, round(avg(case when account_km <= r then 1.0 else 0.0 end),4) as account_hit,
 round(quantile_cont(err_km,0.5),4) as median_err_km, round(quantile_cont(r,0.5),4) as median_radius_km from zerr""", ZONED)
def _(d):
    z = cut_lineage(_zone_errors(d))
    med = [exact_quantiles(z, [], c, [0.5]).select(F.col("q")[0]).scalar() for c in ("err_km", "r")]
    hit = lambda c: F.avg((F.col(c) <= F.col("r")).cast("double"))
    return tidy(z.agg(F.count(F.lit(1)).alias("n"), hit("err_km").alias("zone_hit"), hit("near_km").alias("nearest3_hit"), hit("account_km").alias("account_hit"))
                .withColumn("median_err_km", med[0]).withColumn("median_radius_km", med[1]))


@query("zone_significance")
def _(d):
    z = _zone_errors(d).select((F.col("err_km") <= F.col("r")).alias("model_hit"), (F.col("account_km") <= F.col("r")).alias("baseline_hit"))
    return tidy(evaluation.mcnemar(z), 9)


@query("true_machine_distance_rank", ALL, f"""
select event_id, 1 + (select count(*) from cashpoints c where {hav('t.lat', 't.lon', 'c.lat', 'c.lon')} < km - 1e-9) as rank, round(km,4) as km from (select t.*, {hav('t.lat', 't.lon', 'c.lat', 'c.lon')} as km from truth t join cashpoints c on c.atm_id = cashout_atm_id) t""", TRUTH)
def _(d):
    """Rank of the true machine by distance without any cut, as points in a circle."""
    machines = d.cashpoints.select(F.col("atm_id").alias("cell"), "lat", "lon")
    truth = _truth(d).withColumnRenamed("cashout_atm_id", "truth_cell").select("event_id", "truth_cell", "lat", "lon")
    km = truth.join(machines.select(F.col("cell").alias("truth_cell"), F.col("lat").alias("clat"), F.col("lon").alias("clon")), "truth_cell").select("event_id", F.round(geo.haversine_km("lat", "lon", "clat", "clon"), 4).alias("km"))
    return evaluation.distance_rank(truth, machines).join(km, "event_id")


@query("delay_distribution", "ledger", """
select round(avg(t),4) as mean, round(avg(case when t<15 then 1.0 else 0.0 end),4) as under_15, round(avg(case when t<5 then 1.0 else 0.0 end),4) as under_5, round(quantile_cont(t::double,0.05),4) as p05, round(quantile_cont(t::double,0.5),4) as p50, round(quantile_cont(t::double,0.95),4) as p95
from (select time_to_cashout_min as t from ledger where time_to_cashout_min is not null)""")
def _(d):
    return tidy(evaluation.delay_distribution(d.ledger, "time_to_cashout_min"))


COUNT = TRUTH + """,
cd as (select event_id, time_to_cashout_min::double as actual, 22.0+1.9*dist_km as predicted, (22.0+1.9*dist_km)*0.4 as lo, (22.0+1.9*dist_km)*2.2 as hi from truth t join scored s on s.lat=t.lat and s.lon=t.lon and s.bank_id=t.bank_id and s.choice_rank=1)"""


def _countdown(d):
    best = choice.fixed_scores(d.accounts, d.cashpoints).filter("choice_rank = 1").select("lat", "lon", "bank_id", (22.0 + 1.9 * F.col("dist_km")).alias("predicted"))
    return _truth(d).join(best, ["lat", "lon", "bank_id"]).select("event_id", F.col("time_to_cashout_min").cast("double").alias("actual"), "predicted", (F.col("predicted") * 0.4).alias("lo"), (F.col("predicted") * 2.2).alias("hi"))


@query("countdown_report", ALL, """select round(avg(abs(actual-predicted)),4) as mae, round(1 - sum(pow(actual-predicted,2))/sum(pow(actual-(select avg(actual) from cd),2)),4) as r2, round(avg(abs(actual-(select avg(actual) from cd))),4) as mean_mae,
 round(avg(case when actual between lo and hi then 1.0 else 0.0 end),4) as coverage, round(avg(hi-lo),4) as width from cd""", COUNT)
def _(d):
    return tidy(evaluation.regression_report(cut_lineage(_countdown(d))))


@query("lead_time", ALL, "select round(avg(case when greatest(0.0, actual-1) >= 15 then 1.0 else 0.0 end),4) as actionable_share, round(avg(case when predicted-1 >= 15 then case when greatest(0.0, actual-1) >= 15 then 1.0 else 0.0 end end),4) as call_precision, count(*) as n, round(quantile_cont(greatest(0.0, actual-1),0.5),4) as median_lead from cd", COUNT)
def _(d):
    return tidy(evaluation.lead_time_report(cut_lineage(_countdown(d))))


# --- replay -------------------------------------------------------------------------------------------

REPLAY = CELLS + "," + TRUTH + """,
cellp as (select lat, lon, bank_id, cell, sum(p) as p from scored join member using (atm_id) group by 1,2,3,4),
evs as (select t.event_id, t.time_to_cashout_min as delay_min, c.filed_s, c.stolen_amount as amount, c.city, c.state, t.lat, t.lon, t.bank_id, 22.0+1.9*dist_km as m, (22.0+1.9*dist_km)*0.4 as lo, (22.0+1.9*dist_km)*2.2 as hi, mm.cell as truth_cell
  from truth t join complaints c on c.ticket_id = t.complaint_id join scored s on s.lat=t.lat and s.lon=t.lon and s.bank_id=t.bank_id and s.choice_rank=1 join member mm on mm.atm_id = t.cashout_atm_id),
inst as (select distinct filed_s as at_s from evs),
pairs as (select e.*, at_s, (at_s-filed_s)/60.0 as elapsed, w0, w1 from evs e join inst on at_s between filed_s and filed_s + 7200, (values (0,30),(30,60),(60,120)) w(w0,w1)),""" + mass_sql("pairs", "pm") + """,
spread as (select at_s, lat, lon, bank_id, sum(window_mass*amount) as rupees from pm group by 1,2,3,4),
live as (select at_s, cell, sum(rupees*p) as rupees from spread join cellp using (lat, lon, bank_id) group by 1, 2),
rawprior as (select cell, sum(amount*pow(2.0, -greatest(0.0, ((select max(filed_s) from complaints where ticket_id in (select complaint_id from history)) - ts_s)/86400.0)/30.0)) as w, count(*) as k from ledger join history using (complaint_id) join member on atm_id = cashout_atm_id where is_terminal=1 group by 1),
prior as (select cell, w/(select sum(w) from rawprior) as share, k/(select sum(k) from rawprior) as flat from rawprior),
tot as (select at_s, sum(rupees) as total from live group by 1),
full_s as (select t.at_s, c.cell, coalesce(rupees,0) + 0.15*coalesce(share,0)*total as score from tot t cross join cells c left join live using (at_s, cell) left join prior using (cell)),
rk as (select e.event_id, e.amount, e.delay_min, 1 + (select count(*) from full_s o where o.at_s = e.filed_s and o.score > f.score) as rank from evs e join full_s f on f.at_s = e.filed_s and f.cell = e.truth_cell)"""


class Replay:
    """Held-out cash-outs with their true cell, cell spread and the prior of the history alone, written for one query."""

    def __init__(self, d):
        self.d, p = d, Picture(d)
        self.cells, self.membership, self.history, self.attached = p.cells, p.membership, p.history, p.attached
        self.directory = p.directory
        truth = _truth(d).join(self.membership.select(F.col("atm_id").alias("cashout_atm_id"), F.col("cell").alias("truth_cell")), "cashout_atm_id")
        scored = cut_lineage(choice.fixed_scores(d.accounts, self.directory))
        best = scored.filter("choice_rank = 1").select("lat", "lon", "bank_id", (22.0 + 1.9 * F.col("dist_km")).alias("m"))
        cols = d.complaints.select(F.col("ticket_id").alias("complaint_id"), "filed_s", F.col("stolen_amount").alias("amount"), "city", "state")
        self.events = cut_lineage(truth.select("event_id", "complaint_id", "lat", "lon", "bank_id", "truth_cell", F.col("time_to_cashout_min").alias("delay_min"))
                                  .join(cols, "complaint_id").join(best, ["lat", "lon", "bank_id"])
                                  .withColumn("lo", F.col("m") * 0.4).withColumn("hi", F.col("m") * 2.2))
        self.probs = surface.project_to_cells(scored, self.membership, ["lat", "lon", "bank_id"])
        self.outs = acct.cashouts(self.attached).join(self.history, "complaint_id", "left_semi")
        # the prior is dated at the last filing it may know of
        self.now_s = d.complaints.withColumnRenamed("ticket_id", "complaint_id").join(self.history, "complaint_id", "left_semi").agg(F.max("filed_s")).head()[0]

    def prior(self):
        return cut_lineage(acct.decayed_prior(self.outs, self.membership, self.now_s))

    def flat(self):
        n = self.outs.withColumnRenamed("cashout_atm_id", "atm_id").join(self.membership.select("atm_id", "cell"), "atm_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return n.withColumn("share", F.col("n") / n.agg(F.sum("n")).scalar()).drop("n")

    def scores(self):
        return cut_lineage(evaluation.epoch_cell_scores(self.events, self.probs))

    def ranks(self, scores=None):
        return evaluation.replay_truth_ranks(self.events, self.scores() if scores is None else scores, self.cells, self.prior())

    def table(self, ranks):
        return evaluation.hit_table(ranks, self.events.select("event_id", "amount"))


HITS = "select k, count(*) as n, count(*) filter (rank <= k) as hits, round(count(*) filter (rank <= k)/count(*),4) as hit_rate, round(sum(case when rank <= k then amount else 0.0 end)/sum(amount),4) as rupees_covered from {0}, (values (1),(3),(5),(10)) g(k) group by k"


@query("replay_hits", ALL, """
select h.*, round(l.lead, 2) as mean_lead_min, round(h.hits/h.n/f.share, 3) as pai, round(f.share, 5) as flagged_atm_share, round(h.k*pi()*144, 1) as flagged_area_km2 from (""" + HITS.format("rk") + """) h
join (select k, avg(sh) as share from evs e join (select at_s, k, sum(atm_count)/(select count(*) from cashpoints) as sh from (select at_s, atm_count, row_number() over (partition by at_s order by score desc, cell) as r from full_s join cells using (cell) where score > 0) , (values (1),(3),(5),(10)) g(k) where r <= k group by 1, 2) s on s.at_s = e.filed_s group by k) f using (k)
join (select k, avg(case when rank <= k then delay_min end) as lead from rk, (values (1),(3),(5),(10)) g(k) group by k) l using (k)""", REPLAY, recursive=True)
def _(d):
    r = Replay(d)
    scores, machines = r.scores(), d.cashpoints.agg(F.count(F.lit(1))).scalar()
    ranks = cut_lineage(r.ranks(scores))
    shares = evaluation.flagged_shares(r.events, scores, r.cells, r.prior(), machines)
    leads = evaluation.mean_leads(ranks, r.events.select("event_id", "delay_min"))
    return evaluation.forecast_table(r.table(ranks), shares, leads, spatial.CELL_RADIUS_KM)


@query("replay_coverage", ALL, "select k, hits, round(hits/(k*n),5) as precision, case when hits > 0 then round((k*n-hits)/hits,2) else 0.0 end as false_cells_per_hit, case when hits > 0 then round(k*n/hits,2) else 0.0 end as cells_per_hit from (" + HITS.format("rk") + ")", REPLAY, recursive=True)
def _(d):
    r = Replay(d)
    return evaluation.coverage_table(r.table(r.ranks())).select("k", "hits", "precision", "false_cells_per_hit", "cells_per_hit")


@query("replay_prior_baseline", ALL, HITS.format("(select e.event_id, amount, rank from evs e join (select cell, row_number() over (order by share desc, cell) as rank from prior) p on p.cell = e.truth_cell)"), REPLAY, recursive=True)
def _(d):
    r = Replay(d)
    return r.table(evaluation.static_rank(r.events, r.prior()))


@query("replay_static_baseline", ALL, HITS.format("(select e.event_id, amount, rank from evs e join (select cell, row_number() over (order by flat desc, cell) as rank from prior) p on p.cell = e.truth_cell)"), REPLAY, recursive=True)
def _(d):
    r = Replay(d)
    return r.table(evaluation.static_rank(r.events, r.flat()))


@query("replay_nearest_cell_baseline", ALL, HITS.format(f"(select e.event_id, amount, 1 + (select count(*) from cells o where {hav('e.lat', 'e.lon', 'o.lat', 'o.lon')} < {hav('e.lat', 'e.lon', 'c.lat', 'c.lon')} - 1e-9) as rank from evs e join cells c on c.cell = e.truth_cell)"), REPLAY, recursive=True)
def _(d):
    r = Replay(d)
    return r.table(evaluation.distance_rank(r.events.select("event_id", "truth_cell", "lat", "lon"), r.cells))


@query("replay_victim_city_baseline", ALL, HITS.format(f"(select e.event_id, amount, 1 + (select count(*) from cells o where {hav('v.vlat', 'v.vlon', 'o.lat', 'o.lon')} < {hav('v.vlat', 'v.vlon', 'c.lat', 'c.lon')} - 1e-9) as rank from evs e join cells c on c.cell = e.truth_cell join (select city, state, avg(lat) as vlat, avg(lon) as vlon from cashpoints group by 1,2) v on v.city = e.city and v.state = e.state)"), REPLAY, recursive=True)
def _(d):
    r = Replay(d)
    spots = evaluation.city_positions(d.cashpoints)
    truth = r.events.select("event_id", "truth_cell", "city", "state").join(spots, ["city", "state"]).select("event_id", "truth_cell", "lat", "lon")
    return r.table(evaluation.distance_rank(cut_lineage(truth), r.cells))


@query("open_cases_at_filing", "complaints", "select a.filed_s as at_s, sum(b.n)::bigint as n_open from (select distinct filed_s from complaints) a join (select filed_s, count(*) as n from complaints group by 1) b on b.filed_s between a.filed_s - 7200 and a.filed_s group by 1")
def _(d):
    return evaluation.open_pairs(d.complaints)


@query("busiest_prior_share", ALL, """
select round(0.15*sh*total/(total + 0.15*sh*total), 4) as prior_share, n_open from (select sum(share) as sh from prior), tot join
 (select a.filed_s as at_s, count(*) as n_open from (select distinct filed_s from evs) a join evs b on b.filed_s between a.filed_s - 7200 and a.filed_s group by 1 order by n_open desc, at_s limit 1) using (at_s)""", REPLAY, recursive=True)
def _(d):
    """The 15 % cap measured at the instant with most held-out cases open, the earliest of equals."""
    r = Replay(d)
    most = evaluation.open_pairs(r.events).agg(F.min_by(F.struct("at_s", "n_open"), F.struct(-F.col("n_open"), F.col("at_s"))).alias("m")).select("m.*")
    live = r.scores().groupBy("at_s").agg(F.sum("rupees").alias("total"))
    added = 0.15 * r.prior().agg(F.sum("share")).scalar() * F.col("total")
    return live.join(most, "at_s").select(F.round(added / (F.col("total") + added), 4).alias("prior_share"), "n_open")


# --- learning -----------------------------------------------------------------------------------------

@query("split_shares")
def _(d):
    rows = learning.stratified_split(_scores(d).drop("score"))
    return tidy(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("mule_rate")))


@query("standardised_features")
def _(d):
    rows = learning.stratified_split(_features(d))
    return tidy(learning.standardise(rows, COLUMNS, F.col("part") == "train").select("account_id", "part", *COLUMNS), 6)


def _risk_rows(d):
    moves = acct.moved(d.ledger)
    rows, names = learning.graph_features(_features(d, moves), moves, COLUMNS)
    return cut_lineage(learning.stratified_split(rows)), names


@query("account_risk_report")
def _(d):
    rows, names = _risk_rows(d)
    return tidy(learning.risk_report(cut_lineage(learning.fit_risk(rows, names, "logistic")), "graph_features"))


@query("calibrated_risk")
def _(d):
    rows, names = _risk_rows(d)
    return tidy(learning.calibrate(learning.fit_risk(rows, names, "logistic")).select("account_id", "part", "score", "calibrated"))


@query("risk_baselines")
def _(d):
    rows = cut_lineage(learning.stratified_split(_features(d)))
    return tidy(learning.baselines(rows, COLUMNS))


@query("risk_experiments")
def _(d):
    rows, names = _risk_rows(d)
    own = names[:len(COLUMNS)]
    return tidy(learning.experiment_table(rows, names, [{"name": "own", "columns": own, "kind": "logistic"}, {"name": "own_and_graph", "kind": "logistic"}]))


def _ranking(d):
    ledger = cut_lineage(d.ledger)
    return candidates.ranking_set(tables.attached_only(ledger), ledger, d.complaints, d.accounts, cut_lineage(d.cashpoints), _features(d, ledger.select(*acct.MOVED)))


@query("ranking_set")
def _(d):
    rows = _ranking(d)
    return tidy(rows.select("txn_id", "complaint_id", "account_id", "atm_id", *[c for c in (*candidates.CONTEXT_COLUMNS, *candidates.CANDIDATE_COLUMNS)], "label", "truth_in_candidates"))


@query("training_set")
def _(d):
    rows = candidates.training_set(tables.attached_only(d.ledger), d.ledger, d.complaints, d.accounts, cut_lineage(d.cashpoints))
    return tidy(rows.select("txn_id", "complaint_id", "dst_account", "cashout_atm_id", "dist_to_atm_km", "time_to_cashout_min", "velocity", "dist_1", "dist_2", "dist_3", "hotspot_5km", "bearing_1", "node_x", "node_y", "node_z", "is_same_bank", "same_bank_km"))


@query("crew_prior", ALL, "select account_id, atm_id, crew_prior from crew", CREW)
def _(d):
    return crew_of(d, d.accounts.select("account_id", "bank_id", "lat", "lon"))[2]


@query("choice_weights")
def _(d):
    rows = choice.utility_terms(_ranking(d))
    weights = choice.fit_logit(rows.select("txn_id", "label", "truth_in_candidates", *choice.TERMS))
    return tidy(d.spark.createDataFrame(list(zip(choice.TERMS, weights)), "term string, weight double"))


@query("seed_stability")
def _(d):
    """The choice model learned ten times, each seed with a split of its own: how far its held-out figures move."""
    rows = choice.utility_terms(_ranking(d)).select("txn_id", "complaint_id", "label", *choice.TERMS)
    return tidy(evaluation.seed_stability(choice.seed_runs(rows, list(range(10)))))


@query("countdown_forecast")
def _(d):
    rows = _ranking(d).filter("label = 1")
    cols = ["stolen_amount", "velocity", "hour_of_day", "amount_after_split", "median_dwell_seconds", "log_median_gap", "log_span", "dist_km"]
    rows = cut_lineage(learning.split_by_complaint(rows))
    model = learning.fit_countdown(rows, cols)
    scored = model.transform(rows)
    hold = learning._unit(F.col("complaint_id"), 43) < 0.15
    out = learning.countdown_band(scored.filter("part = 'test'"), scored.filter((F.col("part") == "train") & hold))
    return tidy(out.select("txn_id", "complaint_id", "m", "lo", "hi"))


@query("case_forecasts", ALL, """
select complaint_id, t.account_id, atm_id as best_atm, round(s.p,4) as confidence, round(22.0+1.9*dist_km,4) as minutes, round(zone_lat,4) as zone_lat, round(zone_lon,4) as zone_lon, round(zone_radius_km,4) as zone_radius_km, candidates_covered
from terminal t join accounts a using (account_id) join scored s on s.lat=a.lat and s.lon=a.lon and s.bank_id=a.bank_id and s.choice_rank=1 join zone z on z.lat=a.lat and z.lon=a.lon and z.bank_id=a.bank_id""", TERMINALS + "," + ZONE, steps_once=True)
def _(d):
    """Every case in one plan: terminal, best machine, zone and countdown."""
    scored = cut_lineage(choice.fixed_scores(d.accounts, cut_lineage(d.cashpoints)))
    best = scored.filter("choice_rank = 1").select("lat", "lon", "bank_id", F.col("atm_id").alias("best_atm"), F.col("p").alias("confidence"), (22.0 + 1.9 * F.col("dist_km")).alias("minutes"))
    zones = choice.search_zone(scored, ["lat", "lon", "bank_id"], d.cashpoints)
    ends = choice.case_terminals(tables.attached_only(d.ledger)).join(d.accounts.select("account_id", "lat", "lon", "bank_id"), "account_id")
    out = ends.join(best.join(zones, ["lat", "lon", "bank_id"]), ["lat", "lon", "bank_id"])
    return tidy(out.select("complaint_id", "account_id", "best_atm", "confidence", "minutes", "zone_lat", "zone_lon", "zone_radius_km", "candidates_covered"))


@query("risky_accounts", "ledger accounts", """
select complaint_id, account_id, r as rank, round(risk,6) as risk, round(norm,6) as norm from (select complaint_id, account_id, risk, norm, row_number() over (partition by complaint_id order by risk desc, norm desc, account_id) as r
 from (select distinct complaint_id, dst_account as account_id from ledger where complaint_id is not null) join (select account_id, is_mule_label*0.5 + (account_id % 10)/20.0 as risk, sqrt(list_sum(list_transform(v, lambda x: x::double*x::double))) as norm from accounts join (select vec_id as account_id, embedding as v from embeddings) using (account_id)) using (account_id)) where r <= 3""")
def _(d):
    """Highest-risk accounts per case, then by the length of their vector."""
    from pyspark.sql import Window

    e = d.raw("embeddings").select(F.col("vec_id").alias("account_id"), "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    people = d.accounts.join(e, "account_id").select("account_id", (F.col("is_mule_label") * 0.5 + (F.col("account_id") % 10) / 20.0).alias("risk"), norm.alias("norm"))
    rows = tables.attached_only(d.ledger).select("complaint_id", F.col("dst_account").alias("account_id")).distinct().join(people, "account_id")
    w = Window.partitionBy("complaint_id").orderBy(F.desc("risk"), F.desc("norm"), "account_id")
    return tidy(rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("complaint_id", "account_id", "rank", "risk", "norm"), 6)
