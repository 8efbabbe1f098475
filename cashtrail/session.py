"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side as soon as it is clearly out of line with its siblings.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    # A table sent to every task passes through the driver and takes many times its written size there.
    "spark.sql.autoBroadcastJoinThreshold": "2MB",
    # Sorted and hashed rows take many times their shuffled size in a task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # Parts that are read in one task each stay tasks of their own in a union.
    "spark.sql.unionOutputPartitioning": "false",
}

#: shuffle files of a query go when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(name: str = "cashtrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may do without the setting."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="cashtrail-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, *folders: str) -> DataFrame:
    """Write the rows as a table in the shared folder, in folders by the columns named, and go on from there.

    Iterative jobs do this once per round and branching jobs before they branch, so a lost
    executor re-reads files and never re-runs what came before. Unlike a checkpointed RDD the
    table knows its size, so the optimizer broadcasts it when, and only when, it is small. What the
    write has shuffled is not needed after it and goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.partitionBy(*folders) if folders else df.write
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
