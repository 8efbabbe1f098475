"""Structured Streaming jobs. Batch operators do the work; only what needs memory across ticks keeps state."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import timing
from ..operators import alerts, cases, surface
from ..operators.rules import DEFAULT_RULES
from ..session import cut_lineage, shared_folder
from .posterior import PosteriorStore

TICK = "60 seconds"
OPEN_WATERMARK = "120 minutes"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(fmt).load(folder)


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Run ``sink`` on every micro-batch: once over what is there, or every minute."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)).start()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a table of the shared folder and read it back.

    A batch is written under its own id, so a batch that is run again after a failure
    replaces its rows instead of doubling them.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    schema = stream.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    start(stream, sink, f"{base}/checkpoint", mode, once=True).awaitTermination()
    try:
        return spark.read.schema(schema).parquet(f"{base}/rows").select(*schema.names)
    except Exception as error:  # no batch ever ran
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


# --- intake ------------------------------------------------------------------------------------

def intake(complaints: DataFrame, states: DataFrame, aliases: DataFrame, local_zone: str = "UTC") -> DataFrame:
    """Raw complaints with instant, canonical city, state and reasons for refusal. Stateless."""
    stamped = complaints.withColumn("filed_at", timing.normalise_timestamp(F.col("complaint_timestamp"), local_zone))
    judged = cases.complaint_quality(cases.canonical_city(stamped, states, aliases))
    no_time = F.when(F.col("filed_at").isNull(), F.array(F.lit("timestamp not readable"))).otherwise(F.array().cast("array<string>"))
    return (judged.withColumn("reasons", F.concat("reasons", no_time)).withColumn("accepted", F.size("reasons") == 0)
            .drop("canonical_city", "directory_state"))


def split_intake(target: str, rejects: str, late: str, arrived: str = "received_at") -> Callable[[DataFrame, int], None]:
    """Sink of the intake: accepted rows, refused rows, and rows already past the open window on arrival.

    A row is late by its own arrival time, where it has one, so batching makes no difference. Rows without one are measured
    against the newest filing of all earlier epochs, which every epoch writes down; a replayed epoch finds the same mark.
    """
    marks = f"{target.rstrip('/')}-marks"

    def high_water(spark, epoch: int) -> datetime | None:
        try:
            return spark.read.parquet(marks).filter(F.col("epoch") < epoch).agg(F.max("filed_at")).head()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            spark = batch.sparkSession
            mark = F.lit(high_water(spark, epoch)).cast("timestamp")
            seen = F.coalesce(F.col(arrived), mark) if arrived in batch.columns else mark
            stale = F.col("filed_at") < seen - F.expr(f"interval {OPEN_WATERMARK}")
            good = batch.filter("accepted").withColumn("__late", F.coalesce(stale, F.lit(False)))
            good.filter(~F.col("__late")).drop("__late").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
            good.filter("__late").drop("__late").write.mode("overwrite").parquet(f"{late}/epoch={epoch}")
            batch.filter(~F.col("accepted")).write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
            good.agg(F.max("filed_at").alias("filed_at")).write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
        finally:
            batch.unpersist()

    return sink


# --- the national tick ---------------------------------------------------------------------------

def alert_pass(rows: DataFrame, cell_probs: DataFrame, cells: DataFrame, prior: DataFrame, as_of_s: Column | int,
               existing: DataFrame | None = None, hits: DataFrame | None = None, rules=DEFAULT_RULES,
               open_minutes: int = surface.OPEN_MINUTES) -> DataFrame:
    """One rule pass over the cases open at ``as_of_s``: open filter, surface, rules, dedupe."""
    as_of = as_of_s if isinstance(as_of_s, Column) else F.lit(as_of_s)
    age = (as_of - F.col("filed_s")) / 60.0
    picture = surface.forward_surface(rows.filter((age >= 0) & (age <= open_minutes)), cell_probs, cells, prior, as_of)
    raised = alerts.evaluate_rules(alerts.alert_candidates(picture, hits), F.timestamp_seconds(as_of), rules)
    return alerts.dedupe_alerts(raised, existing)


def alert_sink(store: PosteriorStore, transfers: Callable[[], DataFrame], accounts: DataFrame, prior: Callable[[int], DataFrame], target: str,
               as_of: Callable[[DataFrame], int | None], registry: DataFrame | None = None, failures: list | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of the national tick: the batch's complaints go into the store, then the rules pass over the cases open now.

    ``as_of`` reads the instant off the batch (live: the clock; a tick without an instant raises nothing), ``prior`` gives the cells'
    shares at an instant, ``transfers`` the attached transfers known by now. With a ``registry`` of marked accounts the hits in the
    open cases' chains count. What was raised in an earlier epoch is not raised again. A failed pass is recorded and raised again:
    the epoch is not committed and runs anew when the query restarts, over the same epoch folders.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            attached = transfers()
            store.append(batch, epoch, attached, accounts)
            now = as_of(batch)
            if now is None:
                return
            age = (F.lit(now) - F.col("filed_s")) / 60.0
            rows, probs = cut_lineage(store.rows().filter((age >= 0) & (age <= surface.OPEN_MINUTES))), store.probs()
            hits = None
            if registry is not None:
                chains = attached.join(rows.select("complaint_id"), "complaint_id", "left_semi")
                hits = alerts.registry_hits(chains, registry, surface.case_cells(rows, probs, now))
            try:
                earlier = spark.read.parquet(target).filter(F.col("epoch") < epoch)
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                earlier = None
            alert_pass(rows, probs, store.cells, prior(now), now, earlier, hits).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
        except Exception as error:
            if failures is not None:
                failures.append((epoch, str(error)[:500]))
            raise
        finally:
            batch.unpersist()

    return sink


# --- stateful pieces --------------------------------------------------------------------------------

def dedupe_stream(alert_stream: DataFrame, event_time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """One alert per rule, cell, window start and hour across ticks; state leaves with the watermark."""
    keyed = alert_stream.withColumn("dedupe_bucket", timing.hour_bucket(F.col(event_time)))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(alerts.DEDUPE_KEY)


def burst_windows(transfers: DataFrame, event_time: str = "ts", delay: str = "10 minutes", more_than: int = 2) -> DataFrame:
    """Sources with more than two transfers in a sliding five-minute window (the exact rule runs in batch).

    Counts combine before the shuffle, so a hot source arrives as one row per task and window.
    """
    w = F.window(event_time, "5 minutes", "1 minute")
    return (transfers.withWatermark(event_time, delay).groupBy(w.alias("w"), "src_account").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > more_than).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_account", "n"))


def change_feed(rows: DataFrame, kind: str, key: str, at: str) -> DataFrame:
    """Typed change rows (kind, key, at, body) for a file or message sink."""
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.to_json(F.struct(*rows.columns)).alias("body"))

