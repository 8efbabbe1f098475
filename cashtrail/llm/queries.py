"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_pairs, decontaminate, host_rules, language, line_join, mixing, ngram_join, packing, rule_quality, secrets, token_align, warc_zip, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": lambda s, d: ngram_join.ngram_join(table(s, d, "documents")),
        "op2_decontaminate": lambda s, d: decontaminate.contamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_rule_quality": lambda s, d: rule_quality.classify(table(s, d, "documents"), table(s, d, "labels")),
        "op4_preference_pairs": lambda s, d: chat_pairs.preferences(table(s, d, "conversations")),
        "op5_warc_zip": lambda s, d: warc_zip.round_trip(table(s, d, "pages")),
        "op6_host_rules": lambda s, d: host_rules.host_rules(table(s, d, "documents")),
        "op7_mix_sources": lambda s, d: mixing.mix(table(s, d, "documents")).withColumn("shard_words", F.array_join(F.expr("transform(shard_words, x -> cast(x as string))"), ",")),
        "op8_secret_scan": lambda s, d: secrets.scan(table(s, d, "documents")),
        "op9_language": lambda s, d: language.identify(table(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_join.line_report(table(s, d, "documents")),
        "op11_token_alignment": lambda s, d: token_align.token_alignment(table(s, d, "documents")),
        # the contract's column is a long: null where a long cannot hold the sum
        "op12_whitening": lambda s, d: whitening.whiten(table(s, d, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)")),
        "op13_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_preference_pairs": chat_pairs.preferences_sql(), "op5_warc_zip": warc_zip.round_trip_sql(), "op6_host_rules": host_rules.host_rules_sql(),
            "op7_mix_sources": mixing.mix_sql(), "op8_secret_scan": secrets.scan_sql()}
