import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtrail.operators import distribution as D


@pytest.fixture(params=["one_block", "blocks"])
def limit(request, spark):
    """Small inputs fall into one partition unless partitions stay as they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param == "one_block").lower())
    yield
    spark.conf.set(name, before)


def sample(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 900)] + [("cold", 4.0), ("cold", 1.0), ("one", 2.5)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_quantiles(spark, limit):
    rows, df = sample(spark)
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    probs = [0.0, 0.05, 0.5, 0.98, 1.0]
    got = {r.k: r.q for r in D.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, vs in by.items():
        assert np.allclose(got[k], np.quantile(vs, probs))
    got = {r.k: r.q for r in D.exact_quantiles(df, ["k"], "v", probs, pick="index").collect()}
    for k, vs in by.items():
        s = sorted(vs)
        assert got[k] == [s[min(len(s) - 1, int(p * len(s)))] for p in probs]
    everything = sorted(v for _, v in rows)
    assert np.allclose(D.exact_quantiles(df, [], "v", probs).head().q, np.quantile(everything, probs))
    assert spark.range(1).select(D.scalar_quantile(df, "v", 0.9).alias("x")).head().x == everything[int(0.9 * len(everything))]
    assert spark.range(1).select(D.value_at_rank(df, "v", F.floor(F.col("t") / 3)).alias("x")).head().x == everything[len(everything) // 3]


def test_weights_count(spark, limit):
    df = spark.createDataFrame([("a", 1, 3), ("a", 5, 1), ("a", 9, 1)], "k string, gap int, w int")
    assert D.exact_quantiles(df, ["k"], "gap", [0.5], weight="w").head().q == [1.0]


def test_empty_input_gives_no_row(spark, limit):
    df = spark.createDataFrame([], "v double")
    assert D.exact_quantiles(df, [], "v", [0.5]).count() == 0
    assert spark.range(1).select(D.scalar_quantile(df, "v", 0.5).alias("x")).head().x is None


def test_running_totals_and_numbers(spark, limit):
    _, df = sample(spark)
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    total = {}
    for r in sorted(D.cumulative(counts, ["k"], "v", ["n"]).collect(), key=lambda r: (r.k, r.v)):
        total[r.k] = total.get(r.k, 0) + r.n
        assert r.cum_n == total[r.k]
    ids = spark.range(0, 300, 3).withColumnRenamed("id", "x")
    assert [r.no for r in D.number_rows(ids, "x", "no", 41).orderBy("x").collect()] == list(range(41, 141))


def test_time_scans(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 400), rng.integers(0, 400_000, 400))] + [(9, 100), (9, 100), (9, 400), (9, 701)]
    df = spark.createDataFrame(rows, "k int, ts long")
    for r in D.forward_counts(df, ["k"], "ts", 300).collect():
        assert r.in_window == sum(1 for k, t in rows if k == r.k and r.ts <= t <= r.ts + 300)
    distinct = df.distinct()
    for r in D.previous_in_time(distinct, ["k"], "ts", "prev").collect():
        before = [t for k, t in rows if k == r.k and t < r.ts]
        assert r.prev == (max(before) if before else None)
    marks = distinct.withColumn("hit", F.when(F.col("ts") % 5 == 0, F.col("ts")))
    for r in D.next_event(marks, ["k"], "ts", "hit", "nxt").collect():
        later = [t for k, t in rows if k == r.k and t >= r.ts and t % 5 == 0]
        assert r.nxt == (min(later) if later else None)


def test_numbers_in_any_order_with_ties(spark, limit):
    rows = [(float(i % 4), f"c{i:03}") for i in range(300)]
    got = D.number_sorted(spark.createDataFrame(rows, "share double, cell string").repartition(7), [F.desc("share"), F.col("cell")], "rank").collect()
    assert [(r.share, r.cell) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 301))
    assert D.number_sorted(spark.createDataFrame([], "share double, cell string"), [F.desc("share")], "rank").count() == 0


def test_measures_in_runs_and_in_blocks_agree(spark):
    """One sorted run per account gives what the block-wise measures give, null ends, seconds and amounts included."""
    from cashtrail.operators import accounts as acct

    rng = np.random.default_rng(8)
    rows = [(int(s), int(d), float(a), int(t), int(h), int(f)) for s, d, a, t, h, f in zip(rng.integers(0, 6, 400), rng.integers(0, 9, 400), rng.integers(1, 90, 400), rng.integers(0, 300_000, 400), rng.integers(1, 5, 400), rng.integers(0, 2, 400))]
    rows += [(None, 3, 5.0, 50, 1, 1), (2, None, 7.0, 60, 1, 1), (1, 4, 2.0, None, 2, 1), (1, 1, None, 500, 3, 1), (7, 20, 1.0, 10, 1, 0), (0, 3, 1.0, 100, 1, 0), (0, 3, 1.0, 100, 1, 0)]
    moves = acct.moved(spark.createDataFrame(rows, "src_account long, dst_account long, amount double, ts_s long, hop_depth long, is_fraud int"))
    names = ["account_id", "total_received", "in_degree", "distinct_senders", "total_sent", "out_degree", "distinct_receivers", "avg_txn_amount", "night_txn_ratio", "median_dwell_seconds", "burst_out_5min", "hop_depth"]

    def got(df):
        return sorted(tuple(None if v is None else round(float(v), 9) for v in r) for r in df.filter("account_id is not null").select(*names).collect())

    want = acct.account_totals(moves)
    for part in (acct.night_ratio, acct.median_dwell, acct.burst_5min, acct.max_hop):
        want = want.join(part(moves), "account_id", "left")
    want = got(want)
    assert len(want) == 12  # a null sender and a null receiver stand under id 0 beside it
    assert got(acct.measured(moves)) == want
    assert got(acct.measured(moves, busy_sides=100)) == want


def test_the_ledger_of_the_features_is_computed_once(spark):
    """The view behind the ledger is read in one write; every measure starts from the written rows."""
    from cashtrail.operators import accounts as acct

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(1, 2, 5.0, 10, 1, 1, 1), (2, 3, 4.0, 20, 2, 0, 2)]
    ledger = spark.createDataFrame(rows, "src_account long, dst_account long, amount double, ts_s long, hop_depth long, is_fraud int, txn_id long")
    people = spark.createDataFrame([(i, 1, "X", 1.0, 2.0, 30, 0) for i in (1, 2, 3)], "account_id long, bank_id long, city string, lat double, lon double, account_age_days long, is_mule_label int")
    assert acct.account_features(ledger.mapInArrow(count, ledger.schema), people).count() == 3
    assert seen.value == len(rows)
