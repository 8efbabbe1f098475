"""From raw documents to a training mix: quality, repeated lines, near copies, test items, source shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm import decontaminate, line_join, mixing, ngram_join, rule_quality
from cashtrail.llm.queries import table
from cashtrail.llm.tables import Scratch

#: near copies of the stage: Jaccard 4/5 of five-word runs, wider than op1's 9/10 of three-word runs
COPY_WORDS, COPY_NUM, COPY_DEN = 5, 4, 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones, rejects go.

    An ensemble without a rule has learned nothing (no label, none that meets a document, or one class only): all documents stay.
    """
    ensemble = rule_quality.learn(docs, table(spark, sf_dir, "labels"))
    if not ensemble.weights:
        return docs
    names = docs.columns
    scored = rule_quality.with_statistics(docs.select("*", F.col("text").cast("string").alias("__text")), "__text")
    return scored.filter(ensemble.score() >= rule_quality.CUT).select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line stays where it stands first; documents of which no word is left go."""
    had = F.coalesce(F.col("text").rlike(r"[^\s]"), F.lit(False))
    rows = line_join.dedup_lines(docs.withColumn("__had", had))
    return rows.filter(~F.col("__had") | F.col("text").rlike(r"[^\s]")).drop("__had")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, once; of rows without doc_id one for each text."""
    groups = ngram_join.ngram_join(docs, COPY_WORDS, COPY_NUM, COPY_DEN, paired=0)
    first = F.col("doc_id") == F.col("component_id")
    stays = groups.filter(first).select("doc_id").distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.join(stays, "doc_id", "left_semi").withColumn("__text", key).dropDuplicates(["doc_id", "__text"])
    nameless = docs.filter("doc_id is null").withColumn("__text", key).dropDuplicates(["__text"])
    return named.unionByName(nameless).drop("__text").select(*docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that copies or edits a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_test_items),
    ("source_mix", mix_sources),
]

#: A fitted classifier is no SQL; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
