"""Streams that keep something between ticks: delivery retries and the stored posterior."""

import time

import pytest
from pyspark.sql import functions as F

from cashtrail.operators import alerts, surface
from cashtrail.sources import tables
from cashtrail.streaming import jobs, retry
from cashtrail.streaming.posterior import PosteriorStore

OUTCOMES = "delivery_id long, channel string, ok boolean, error string, at_s long"
T0 = 1_700_000_000


def deliver(spark, folder, rows, replay=True, **options):
    """One more file, and the query started anew over what is there."""
    spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.file_stream(spark, f"{folder}/in", spark.createDataFrame([], OUTCOMES).schema)

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    jobs.start(retry.retry_stream(stream, replay, **options), sink, f"{folder}/checkpoint", "update", once=True).awaitTermination()
    return spark.read.schema(retry.CHANGE).parquet(f"{folder}/out").drop("epoch").collect()


def test_retries_over_three_files_equal_the_batch_rule(spark, tmp_path):
    files = [[(1, "sms", False, "a", T0), (2, "fax", True, "", T0 + 5), (3, "email", False, "b", T0 + 1), (3, "email", True, "", T0 + 200)],
             [(1, "sms", False, "c", T0 + 300), (4, "webhook", False, "d", T0 + 400), (3, "email", False, "after the end", T0 + 410)],
             [(1, "sms", False, "e", T0 + 900), (1, "sms", False, "f", T0 + 2000), (1, "sms", True, "too late", T0 + 2100), (4, "webhook", True, "", T0 + 1000)]]
    for rows in files:
        got = deliver(spark, str(tmp_path), rows)
    seen = {(r.delivery_id, r.attempts): (r.state, r.last_error, r.next_retry_s) for r in got if r.kind == "attempted"}
    state, want = {}, {}
    for d, channel, ok, error, at in sorted((r for rows in files for r in rows), key=lambda r: r[4]):
        attempts, now = state.get(d, (0, "queued"))
        if now in ("sent", "dead"):
            continue
        one = spark.createDataFrame([(d, channel, attempts)], "delivery_id long, channel string, attempts int")
        r = alerts.advance_deliveries(one, spark.createDataFrame([(d, ok, error)], "delivery_id long, ok boolean, error string"), F.lit(at)).head()
        state[d] = r.attempts, r.state
        want[d, r.attempts] = r.state, r.last_error, r.next_retry_s
    assert seen == want and want[1, 4][0] == "dead" and [want[1, n][2] - t for n, t in ((1, T0), (2, T0 + 300), (3, T0 + 900))] == [120, 240, 480]


def live(spark, folder, rows, done):
    """The query by the clock until its rows satisfy ``done``, then stopped: the next call starts it anew."""
    spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = retry.retry_stream(jobs.file_stream(spark, f"{folder}/in", spark.createDataFrame([], OUTCOMES).schema), unit_s=1)

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            assert query.isActive, query.exception()
            try:
                found = spark.read.schema(retry.CHANGE).parquet(f"{folder}/out").collect()
            except Exception:  # nothing written yet, or an epoch just being written
                continue
            if done(found):
                return found
        raise AssertionError("the rows never came")
    finally:
        query.stop()


def test_a_wait_ends_by_timer_after_a_restart(spark, tmp_path):
    now = int(time.time())
    live(spark, str(tmp_path), [(1, "sms", False, "x", now + 20), (2, "sms", True, "", now)], lambda rows: len(rows) == 2)
    got = live(spark, str(tmp_path), [(3, "sms", True, "", now)], lambda rows: any(r.kind == "due" for r in rows) and any(r.delivery_id == 3 for r in rows))
    assert [(r.delivery_id, r.attempts, r.at_s) for r in got if r.kind == "due"] == [(1, 1, now + 22)]
    assert {(r.delivery_id, r.state) for r in got if r.kind == "attempted"} == {(1, "failed"), (2, "sent"), (3, "sent")}


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_three_deliveries_leave_the_store_of_one(spark, domain, tmp_path):
    complaints = domain.complaints.select("ticket_id", "stolen_amount", "filed_s", "fraud_type", "state", "city")
    attached, accounts, directory = tables.attached_only(domain.ledger), domain.accounts, domain.cashpoints
    one, three = PosteriorStore(spark, str(tmp_path / "one"), directory), PosteriorStore(spark, str(tmp_path / "three"), directory)
    one.append(complaints, 0, attached, accounts)
    for epoch in range(3):
        # every delivery repeats some of the one before
        part = complaints.filter((F.col("ticket_id") % 3 == epoch) | ((F.col("ticket_id") % 3 == epoch - 1) & (F.col("ticket_id") % 2 == 0)))
        three.append(part, epoch, attached, accounts)
        if epoch:
            three.append(part, epoch, attached, accounts)   # an epoch that runs again
    rows = rounded(one.rows())
    assert rows and rounded(three.rows()) == rows and rounded(three.probs()) == rounded(one.probs()) and rounded(three.dropped()) == rounded(one.dropped())
    made, _ = surface.posteriors(complaints, attached, accounts, directory, one.membership)
    assert rounded(made.select(*one.rows().columns)) == rows
    kept = {r.complaint_id for r in one.rows().select("complaint_id").collect()}
    lost = {r.complaint_id: r.reason for r in one.dropped().collect()}
    assert set(lost) == {r.ticket_id for r in complaints.collect()} - kept and set(lost.values()) == {"no transfers"}


def test_a_case_waits_for_its_transfers(spark, domain, tmp_path):
    accounts = spark.createDataFrame([(1, 1, 12.0, 77.0), (2, 1, *surface.CENTROID)], "account_id long, bank_id int, lat double, lon double")
    ledger = spark.createDataFrame([(7, "c1", 9, 1, 1.0, T0, 1, 1, 3, 5), (8, "c2", 9, 2, 1.0, T0, 1, 1, 3, 5), (9, "c3", 9, 404, 1.0, T0, 1, 1, 3, 5)],
                                   "txn_id long, complaint_id string, src_account long, dst_account long, amount double, ts_s long, hop_depth int, is_terminal int, cashout_atm_id long, time_to_cashout_min int")
    filed = spark.createDataFrame([(f"c{i}", 10.0, T0, "f", "s", "c") for i in (1, 2, 3)], "ticket_id string, stolen_amount double, filed_s long, fraud_type string, state string, city string")
    store = PosteriorStore(spark, str(tmp_path), domain.cashpoints)
    store.append(filed, 0, ledger.limit(0), accounts)
    assert store.rows().count() == 0 and {r.reason for r in store.dropped().collect()} == {"no transfers"}
    store.append(filed, 1, ledger, accounts)
    assert [r.complaint_id for r in store.rows().collect()] == ["c1"]
    assert {(r.complaint_id, r.reason) for r in store.dropped().collect()} == {("c2", "on the centroid"), ("c3", "no account")}
    assert store.probs().agg(F.sum("p")).head()[0] == pytest.approx(1.0)
    again = PosteriorStore(spark, str(tmp_path), domain.cashpoints)   # opened anew: cells are read, not built
    assert again.rows().count() == 1 and again.cells.count() == store.cells.count()
