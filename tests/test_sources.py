import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtrail.operators import choice, learning
from cashtrail.session import cut_lineage
from cashtrail.sources import tables

LEDGER = """txn_id,complaint_id,src_account,dst_account,bank_name,ifsc_code,city,district,state,lat,long,amount,timestamp,hop_depth,is_terminal,is_fraud,txn_purpose,cashout_atm_id,time_to_cashout_min
t1,c1,A,B,b,i,c,d,s,1.0,2.0,10.5,2026-01-01T10:00:00,1,0,1,x,,
t2,,B,C,b,i,c,d,s,1.0,2.0,3.0,2026-01-01T10:05:00Z,2,1,0,x,ATM-00000001,12.5
t3,nan,B,C,b,i,c,d,s,1.0,2.0,3.0,bad,2,1,0,x,nan,
"""


def test_ledger_and_attached(spark, tmp_path):
    (tmp_path / "l.csv").write_text(LEDGER)
    rows = {r.txn_id: r for r in tables.read_ledger(spark, str(tmp_path / "l.csv")).collect()}
    assert rows["t2"].ts_s - rows["t1"].ts_s == 300 and rows["t3"].ts_s is None
    assert rows["t3"].cashout_atm_id is None and rows["t2"].time_to_cashout_min == 12.5
    assert [r.txn_id for r in tables.attached_only(tables.read_ledger(spark, str(tmp_path / "l.csv"))).collect()] == ["t1"]


def test_directory_drops_unplaced_rows(spark, tmp_path):
    head = "atm_id,bank_name,address,city,district,state,lat,long,opening_time,closing_time,cashout_risk_score,historical_fraud_count\n"
    (tmp_path / "a.csv").write_text(head + "a,b,x,c,d,s,1.5,2.5,09:30,18:00,0.5,3\nb,b,x,c,d,s,north,2.5,,,0.5,3\nc,b,x,c,d,s,NaN,2.5,,,0.5,3\nd,b,x,c,d,s,Infinity,2.5,,,0.5,3\n")
    rows = tables.read_cashpoints(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.atm_id, r.opens_min, r.closes_min) for r in rows] == [("a", 570, 1080)]


def test_complaint_defaults(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ticket_id,victim_name,victim_bank,victim_account,fraud_type,stolen_amount,complaint_timestamp,city,state,status\nt,,,,,,2026-01-01T00:00:00Z,,,\n")
    r = tables.read_complaints(spark, str(tmp_path / "c.csv")).head()
    assert (r.victim_name, r.stolen_amount, r.status) == ("", 0.0, "ACTIVE")


def test_cities_and_registry(spark, tmp_path):
    (tmp_path / "cities.json").write_text('{"total": 1, "cities": ["Pune"],\n "city_to_state": {"Pune": "Maharashtra"}, "aliases": {"poona": "Pune"}}')
    states, aliases = tables.read_city_directory(spark, str(tmp_path / "cities.json"))
    assert states.head().state == "Maharashtra" and aliases.head().city == "Pune"
    (tmp_path / "r.csv").write_text("account_id,source,flagged_on,note\nA,x,2026-01-01,n\n,x,,\n")
    assert tables.read_suspect_registry(spark, str(tmp_path / "r.csv")).count() == 1


def test_roster_is_seeded_once(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,role,channel,address,scope_state,scope_district\nDesk,LEA,sms,1,,\n,LEA,sms,2,,\n")
    roster = tables.read_recipients(spark, str(tmp_path / "r.csv"))
    target = str(tmp_path / "roster")
    assert tables.seed_once(roster, target) and not tables.seed_once(roster, target)
    assert spark.read.parquet(target).count() == 1


def test_metrics(spark, tmp_path):
    path = str(tmp_path / "m")
    for v in (1.0, 2.0):
        tables.write_metrics("zone", spark.createDataFrame([(v,)], "hit double"), "job", path)
    assert float(tables.require_metric(spark, path, "zone", "hit", "job")) == 2.0
    with pytest.raises(KeyError, match="run job"):
        tables.require_metric(spark, path, "zone", "miss", "job")


def test_tables_are_swapped_as_a_set(spark, tmp_path):
    root = str(tmp_path / "w")
    tables.write_tables({"a": spark.range(3), "b": spark.range(4).withColumn("day", F.lit(1))}, root, {"b": ["day"]})
    good = tables.current_version(spark, root)
    bad = spark.range(3).withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        tables.write_tables({"a": spark.range(9), "b": bad}, root)
    assert tables.current_version(spark, root) == good and tables.read_table(spark, root, "a").count() == 3


def test_artefact_bytes(spark, tmp_path):
    (tmp_path / "EVD-000001").write_bytes(b"abc")
    r = tables.read_artefacts(spark, str(tmp_path)).head()
    assert r.stored_name == "EVD-000001" and bytes(r.content) == b"abc"


def test_splits(spark):
    df = spark.range(2000).selectExpr("id as account_id", "int(id % 20 = 0) as label", "id div 4 as complaint_id")
    parts = {(r.part, r.label): r["count"] for r in learning.stratified_split(df).groupBy("part", "label").count().collect()}
    assert parts == {("train", 0): 1330, ("val", 0): 285, ("test", 0): 285, ("train", 1): 70, ("val", 1): 15, ("test", 1): 15}
    marked = learning.split_by_complaint(df)
    assert marked.filter("part = 'test'").select("complaint_id").distinct().count() == 100
    assert marked.groupBy("complaint_id").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0


def test_scaling_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (100.0, "test")], "x double, part string")
    assert [r.x for r in learning.standardise(df, ["x"], F.col("part") == "train").collect()] == [-1.0, 1.0, 98.0]


def test_isotonic_steps(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.35, 0.5, 0.9)], "score double")
    got = [round(r.calibrated, 6) for r in learning.apply_isotonic(df, [0.2, 0.4, 0.6], [0.1, 0.3, 0.3]).collect()]
    assert got == [0.1, 0.1, 0.25, 0.3, 0.3]


def test_mcnemar(spark):
    from math import comb

    from cashtrail.operators import evaluation

    rows = [(True, False)] * 13 + [(False, True)] * 4 + [(True, True)] * 20
    got = evaluation.mcnemar(spark.createDataFrame(rows, "model_hit boolean, baseline_hit boolean")).head()
    assert (got.b, got.c) == (13, 4)
    assert abs(got.p_value - 2 * sum(comb(17, i) for i in range(5)) / 2**17) < 1e-12


def test_logit_solvers_agree(spark):
    rng = np.random.default_rng(0)
    true = np.array([1.0, -0.5])
    rows = []
    for g in range(300):
        x = rng.normal(size=(5, 2))
        p = np.exp(x @ true)
        pick = rng.choice(5, p=p / p.sum())
        rows += [(g, int(i == pick), float(x[i, 0]), float(x[i, 1])) for i in range(5)]
    df = spark.createDataFrame(rows, "txn_id int, label int, a double, b double")
    newton = choice.fit_logit(df, columns=("a", "b"))
    assert np.allclose(newton, true, atol=0.3)
    descent = choice.fit_logit(df, columns=("a", "b"), solver="gd", steps=25)
    assert np.allclose(newton, descent, atol=0.02)


def candidate_sets(spark, n=160, k=6):
    import random

    draw, rows = random.Random(5), []
    for t in range(n):
        terms = [(draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(k)]
        pull = [math.exp(1.2 * a - 0.6 * b) for a, b in terms]
        # every ninth set does not hold its true machine
        true = draw.choices(range(k), pull)[0] if t % 9 else -1
        rows += [(t, t // 2, int(j == true), a, b) for j, (a, b) in enumerate(terms)]
    return rows, spark.createDataFrame(rows, "txn_id long, complaint_id long, label int, a double, b double")


def test_runs_fitted_together_equal_runs_fitted_alone(spark):
    rows, df = candidate_sets(spark)
    seeds = [3, 4, 5]
    parts = learning.split_by_seeds(df, seeds)
    for seed in seeds:
        alone = {(r.complaint_id, r.part) for r in learning.split_by_complaint(df, seed=seed).select("complaint_id", "part").distinct().collect()}
        assert alone == {(r.complaint_id, r.part) for r in parts.filter(F.col("run") == seed).collect()}
    train = parts.filter("part = 'train'").groupBy("complaint_id").agg(F.collect_list("run").alias("runs"))
    sets = cut_lineage(choice.fold_sets(df, columns=("a", "b"), keep=("complaint_id",)).join(train, "complaint_id"))
    together = choice.fit_logits(sets, [*seeds, 99])
    assert together[99] == [0.0, 0.0]

    x = np.array([r[3:] for r in rows]).reshape(-1, 6, 2)
    y = np.array([r[2] for r in rows]).reshape(-1, 6)
    report = {(r.run, r.metric): r.value for r in choice.seed_runs(df, seeds, columns=("a", "b"), keep_unreachable=True).collect()}
    for seed in seeds:
        learns = {r.complaint_id for r in parts.filter((F.col("run") == seed) & (F.col("part") == "train")).collect()}
        mine = np.array([t // 2 in learns for t in range(len(x))])
        w = np.zeros(2)
        for _ in range(4000):
            u = x[mine] @ w
            p = np.exp(u - u.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += 0.5 * np.einsum("sk,skc->c", y[mine] - p, x[mine]) / mine.sum()
        assert np.allclose(together[seed], w, atol=1e-4)
        u, held = x[~mine] @ together[seed], y[~mine]
        p = np.exp(u - u.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top1 = np.mean(held[np.arange(len(u)), u.argmax(1)])
        near = np.mean(held[np.arange(len(u)), x[~mine][:, :, 0].argmax(1)])
        assert math.isclose(report[seed, "top1"], top1) and math.isclose(report[seed, "mass"], (p * held).sum(1).mean(), rel_tol=1e-9)
        assert math.isclose(report[seed, "top1_lift"], top1 - near, abs_tol=1e-12)


def test_fit_without_sets(spark):
    df = spark.createDataFrame([], "txn_id long, complaint_id long, label int, a double, b double")
    assert choice.fit_logit(df, columns=("a", "b")) == [0.0, 0.0]
    assert choice.seed_runs(df, [1, 2], columns=("a", "b")).count() == 0
