"""Readers and writers for the domain tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, timing
from . import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet when the path says so, else CSV with a header. The schema is never guessed."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_ledger(spark: SparkSession, path: str, local_zone: str = "UTC") -> DataFrame:
    raw = _read(spark, path, schemas.LEDGER)
    return (raw.withColumn("ts", timing.normalise_timestamp(F.col("timestamp"), local_zone))
            .withColumn("ts_s", F.unix_timestamp("ts"))
            .withColumn("complaint_id", text.clean_absent(F.col("complaint_id")))
            .withColumn("cashout_atm_id", text.clean_absent(F.col("cashout_atm_id")))
            .withColumnRenamed("long", "lon"))


def read_complaints(spark: SparkSession, path: str, local_zone: str = "UTC") -> DataFrame:
    raw = _read(spark, path, schemas.COMPLAINTS)
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in
             ("victim_name", "victim_bank", "victim_account", "fraud_type", "city", "state")}
    return (raw.withColumns(blank).withColumn("stolen_amount", F.coalesce("stolen_amount", F.lit(0.0)))
            .withColumn("status", F.coalesce("status", F.lit("ACTIVE")))
            .withColumn("filed_at", timing.normalise_timestamp(F.col("complaint_timestamp"), local_zone))
            .withColumn("filed_s", F.unix_timestamp("filed_at")))


def read_cashpoints(spark: SparkSession, path: str) -> DataFrame:
    """Directory rows whose position is not a finite number are dropped."""
    raw = _read(spark, path, schemas.CASHPOINTS)
    lat, lon = F.col("lat").try_cast("double"), F.col("long").try_cast("double")
    placed = raw.withColumn("lat", lat).withColumn("lon", lon).drop("long")
    inf = F.lit(float("inf"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf) for c in ("lat", "lon")]
    return (placed.filter(finite[0] & finite[1])
            .withColumn("opens_min", timing.minutes_of_day(F.col("opening_time")))
            .withColumn("closes_min", timing.minutes_of_day(F.col("closing_time"))))


def read_account_features(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.ACCOUNT_FEATURES).withColumnRenamed("long", "lon")


def city_index(accounts: DataFrame) -> DataFrame:
    """(city_key, account_id): the index by city as rows, so one big city is never one array."""
    return accounts.select(F.lower(F.trim("city")).alias("city_key"), "account_id").filter(F.col("city_key") != "")


def edge_projection(ledger: DataFrame) -> DataFrame:
    return ledger.select("src_account", "dst_account", "amount", "ts_s", "hop_depth", "is_terminal", "complaint_id")


def attached_only(ledger: DataFrame) -> DataFrame:
    return ledger.filter(text.clean_absent(F.col("complaint_id")).isNotNull())


def read_recipients(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, schemas.RECIPIENTS).filter(F.coalesce(F.trim("name"), F.lit("")) != "")
    scopes = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("scope_state", "scope_district")}
    return raw.withColumns(scopes).withColumn("active", F.lit(1))


def seed_once(df: DataFrame, target: str) -> bool:
    """Write a roster only where none exists yet."""
    spark = df.sparkSession
    try:
        if not spark.read.parquet(target).isEmpty():
            return False
    except Exception as error:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    df.write.mode("overwrite").parquet(target)
    return True


def read_suspect_registry(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.REGISTRY).filter(text.clean_absent(F.col("account_id")).isNotNull())


def read_city_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(city, state) and (alias, city) tables from the directory JSON."""
    raw = spark.read.schema(schemas.CITIES).option("multiLine", True).json(path)
    states = raw.select(F.explode("city_to_state").alias("city", "state"))
    aliases = raw.select(F.explode("aliases").alias("alias", "city"))
    return states, aliases


def read_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """(stored_name, content, length) of every stored file."""
    return (spark.read.format("binaryFile").load(folder)
            .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("stored_name"), "content", "length"))


# --- metrics ledger -------------------------------------------------------------------

def write_metrics(section: str, df: DataFrame, source: str, path: str) -> None:
    """Append one section's report rows as JSON, stamped with producer and time."""
    (df.select(F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("payload"),
               F.lit(source).alias("source"), F.current_timestamp().alias("measured_at"))
     .write.mode("append").parquet(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest write of every section (all rows of that write)."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("section").agg(F.max("measured_at").alias("measured_at"))
    return rows.join(newest, ["section", "measured_at"], "left_semi")


def require_metric(spark: SparkSession, path: str, section: str, field: str, producer: str):
    """One value of a section; a missing one is an error that names the job to run."""
    row = (read_metrics(spark, path).filter(F.col("section") == section)
           .select(F.get_json_object("payload", f"$.{field}").alias("v")).filter(F.col("v").isNotNull()).head())
    if row is None:
        raise KeyError(f"metric {section}.{field} is missing; run {producer}")
    return row.v


# --- writers ----------------------------------------------------------------------------

def write_tables(tables: Mapping[str, DataFrame], root: str, partition_by: Mapping[str, list[str]] | None = None) -> str:
    """Write a set of tables all-or-nothing.

    Every table goes to a fresh version folder; a one-row marker is written last. Readers use
    ``current_version`` and so never see half a set.
    """
    import uuid

    version = uuid.uuid4().hex[:12]
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        writer = df.write.mode("errorifexists")
        columns = (partition_by or {}).get(name)
        if columns:
            writer = writer.partitionBy(*columns)
        writer.parquet(f"{root}/versions/{version}/{name}")
    (spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>")
     .withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/_complete"))
    return version


def current_version(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/_complete").agg(F.max_by("version", "finished_at")).head()[0]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/{name}")


def export_node_link(nodes: DataFrame, edges: DataFrame, leaves: DataFrame, velocity: DataFrame, split: DataFrame) -> DataFrame:
    """The graph as JSON lines: (kind, id, body). One row per node or edge, never one document."""
    flags = (nodes.join(leaves.select("account_id").withColumn("is_terminal", F.lit(True)), "account_id", "left")
             .join(velocity.select("account_id").withColumn("velocity_anomaly", F.lit(True)), "account_id", "left")
             .join(split.select("account_id").withColumn("fund_split", F.lit(True)), "account_id", "left")
             .na.fill(False, ["is_terminal", "velocity_anomaly", "fund_split"]))
    data = [c for c in flags.columns if c != "account_id"]
    node_rows = flags.select(F.lit("node").alias("kind"), F.col("account_id").cast("string").alias("id"),
                             F.to_json(F.struct(F.col("account_id").alias("id"), F.struct(*data).alias("data"))).alias("body"))
    extra = [c for c in edges.columns if c not in ("src_account", "dst_account")]
    edge_rows = edges.select(F.lit("edge").alias("kind"), F.col("txn_id").cast("string").alias("id"),
                             F.to_json(F.struct(F.col("txn_id").alias("id"), F.col("src_account").alias("source"),
                                                F.col("dst_account").alias("target"), F.struct(*extra).alias("data"))).alias("body"))
    return node_rows.unionByName(edge_rows)
