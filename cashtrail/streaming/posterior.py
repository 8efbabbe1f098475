"""The posterior of every filed complaint as a stored table that grows epoch by epoch, with the cells and place spreads beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import choice, spatial, surface
from ..session import cut_lineage

PLACE = ["lat", "lon", "bank_id"]
CASE = ["complaint_id", "amount", "filed_s", "fraud_type", "state", "city"]
REASONS = ("no transfers", "no account", "on the centroid")


class PosteriorStore:
    """Tables under one folder: ``membership`` and ``cells`` of the directory, and per epoch ``cases``, ``places`` (cell spread of a
    place and bank), ``waits`` (its expected minutes) and ``dropped`` (complaints that could not be placed, with the reason).

    Every epoch is a folder of its own that is overwritten when the epoch runs again, and an epoch only looks at earlier ones, so a
    replay leaves the same tables. A place is scored once, however many complaints end there, and a complaint is taken once. A
    complaint without transfers is dropped for now: it is looked at again when it is delivered again.
    """

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame):
        self.spark, self.folder, self.directory = spark, folder.rstrip("/"), directory
        if not self._has("cells"):
            membership = cut_lineage(spatial.build_cells(directory))
            cells = spatial.describe_cells(directory, membership).withColumnRenamed("leader_id", "cell")
            membership.withColumn("cell", F.col("leader_id")).write.mode("overwrite").parquet(f"{self.folder}/membership")
            # written last: where it stands, the store is whole
            cells.write.mode("overwrite").parquet(f"{self.folder}/cells")
        self.membership, self.cells = (spark.read.parquet(f"{self.folder}/{n}") for n in ("membership", "cells"))

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, like: DataFrame | None = None, before: int | None = None) -> DataFrame | None:
        """Rows of a table, of epochs before the given one; where nothing is stored yet, an empty one like ``like`` or None."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None if like is None else like.limit(0)
        return (rows if before is None else rows.filter(F.col("epoch") < before)).drop("epoch")

    def _write(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}/epoch={epoch}")

    def append(self, complaints: DataFrame, epoch: int, attached: DataFrame, accounts: DataFrame) -> None:
        """Take up the complaints of one epoch (``ticket_id stolen_amount filed_s fraud_type state city``)."""
        asked = complaints.select(F.col("ticket_id").alias("complaint_id"), F.col("stolen_amount").alias("amount"), *CASE[2:]).dropDuplicates(["complaint_id"])
        held = self._read("cases", before=epoch)
        new = cut_lineage(asked if held is None else asked.join(held.select("complaint_id"), "complaint_id", "left_anti"))
        ends = choice.case_terminals(attached.join(new.select("complaint_id"), "complaint_id", "left_semi")).select("complaint_id", "account_id")
        found = cut_lineage(new.join(ends, "complaint_id", "left").join(accounts.select("account_id", *PLACE), "account_id", "left"))
        centroid = (F.round("lat", 4) == surface.CENTROID[0]) & (F.round("lon", 4) == surface.CENTROID[1])
        reason = F.when(F.col("account_id").isNull(), REASONS[0]).when(F.col("lat").isNull() | F.col("lon").isNull(), REASONS[1]).when(centroid, REASONS[2])
        judged = found.withColumn("reason", reason)
        self._write(judged.filter("reason is not null").select("complaint_id", "reason"), "dropped", epoch)
        placed = judged.filter("reason is null")
        places = placed.select(*PLACE).distinct()
        scored_before = self._read("waits", before=epoch)
        if scored_before is not None:
            places = places.join(scored_before.select(*PLACE), [places[c].eqNullSafe(scored_before[c]) for c in PLACE], "left_anti")
        scored = cut_lineage(choice.fixed_scores(cut_lineage(places), self.directory))
        wait = (surface.DOOR_MIN + surface.MIN_PER_KM * F.col("dist_km")).alias("m")
        self._write(surface.project_to_cells(scored, self.membership, PLACE), "places", epoch)
        self._write(scored.filter(F.col("choice_rank") == 1).select(*PLACE, wait), "waits", epoch)
        # last: a case stands only when all that belongs to it does
        self._write(placed.select(*CASE, "account_id", *PLACE), "cases", epoch)

    def rows(self) -> DataFrame:
        """Case rows as ``surface.posteriors`` gives them."""
        cases, waits = self._read("cases"), self._read("waits")
        return (cases.join(waits, PLACE).withColumn("lo", F.col("m") * surface.BAND_LOW).withColumn("hi", F.col("m") * surface.BAND_HIGH))

    def probs(self) -> DataFrame:
        return self._read("places")

    def dropped(self) -> DataFrame:
        """Complaints that are not in the store, with the reason of their last delivery."""
        empty = self.spark.createDataFrame([], T.StructType([T.StructField("complaint_id", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("epoch", T.IntegerType())]))
        try:
            every = self.spark.read.parquet(f"{self.folder}/dropped")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            every = empty
        last = every.groupBy("complaint_id").agg(F.max_by("reason", "epoch").alias("reason"))
        held = self._read("cases")
        return last if held is None else last.join(held.select("complaint_id"), "complaint_id", "left_anti")
