"""Written intermediate tables and numbering, shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one run in the shared folder: lineage ends at each, and a table no longer read can go."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.parquet(self.path(name), **options)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def ranked(df: DataFrame, order: list[Column], out: str, scratch: Scratch, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without bringing the rows into one task.

    Rows are range-sorted; a row's number is its place in its partition plus the sizes of the
    partitions before it, and only those sizes (one per partition) are put in sequence.
    """
    placed = (df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id())
              .withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1)))
    placed = scratch.keep(placed, name)
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    # one row per partition of the sort: bounded by the partition count
    return placed.join(F.broadcast(starts), "__p").withColumn(out, F.col("__s") + F.col("__i")).drop("__m", "__p", "__i", "__s")


def as_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def low_labels(links: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, comp) of every end of the links (a, b): the smallest node within ``rounds`` links.

    Nodes of one label are connected; connected nodes may still differ. That is enough to leave pairs of one label out, and
    takes a fixed number of shuffles where full components take as many as the longest chain asks for.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    label = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp"))
    for _ in range(rounds - 1):
        around = both.join(label.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        label = label.join(around, "node").select("node", F.least("comp", "near").alias("comp"))
    return label
