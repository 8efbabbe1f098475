"""Chain of custody: hashing, linking, verification, certificates and withdrawals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .distribution import first_rows

MIN_REASON = 4


def custody_records(artefacts: DataFrame) -> DataFrame:
    """First copy per (case, digest), with id and per-case order.

    ``artefacts``: evidence_no (unique number), case_id, content, size_bytes, collected_by, collected_s.
    """
    digested = artefacts.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    keep = ["evidence_no", "size_bytes", "collected_by", "collected_s"]
    one = first_rows(digested.select("case_id", "sha256", *keep), ["case_id", "sha256"], "evidence_no", keep)
    return one.withColumn("id", text.numbered_id("EVD", F.col("evidence_no")))


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Carry (case, position, hash) over rows sorted by case and order; memory stays one batch."""
    case, seq, prev = None, 0, ""
    for pdf in batches:
        seqs, prevs, hashes = [], [], []
        for own_case, head, tail in zip(pdf["case_id"], pdf["head"], pdf["tail"]):
            if own_case != case:
                case, seq, prev = own_case, 0, ""
            seq += 1
            entry = hashlib.sha256(f"{prev}|{head}|{tail}".encode()).hexdigest()
            seqs.append(seq)
            prevs.append(prev)
            hashes.append(entry)
            prev = entry
        out = pdf.drop(columns=["head", "tail"])
        out["seq"], out["prev_hash"], out["entry_hash"] = seqs, prevs, hashes
        yield out[["case_id", "id", "seq", "sha256", "size_bytes", "collected_by", "collected_s", "prev_hash", "entry_hash"]]


def _types(df: DataFrame) -> str:
    return df.schema["case_id"].dataType.simpleString()


def _entry_text() -> tuple[Column, Column]:
    return F.concat_ws("|", "id", F.col("case_id").cast("string"), "sha256"), F.concat_ws("|", "collected_by", F.col("collected_s").cast("string"))


def link_chain(records: DataFrame, order: str = "evidence_no") -> DataFrame:
    """entry = sha256(previous | id | case | digest | by | at), in sequence per case.

    A hash chain is sequential inside its case by definition. Cases run in parallel and a
    case streams through its task in Arrow batches, so no case is ever held as one group.
    """
    head, tail = _entry_text()
    sorted_rows = (records.withColumn("head", head).withColumn("tail", tail).repartition("case_id").sortWithinPartitions("case_id", order)
                   .select("case_id", "id", "sha256", "size_bytes", "collected_by", "collected_s", "head", "tail"))
    schema = (f"case_id {_types(records)}, id string, seq long, sha256 string, size_bytes long, collected_by string, "
              "collected_s long, prev_hash string, entry_hash string")
    return sorted_rows.mapInPandas(_link, schema)


def verify_chain(records: DataFrame) -> DataFrame:
    """(case_id, id, seq, ok): a row is sound if it follows the row before it and its hash is that of its content.

    Damage spreads downstream: everything from a case's first unsound row on is not ok. Rows are compared with the
    stored hash of their predecessor by an equi-join, so no case is walked.
    """
    head, tail = _entry_text()
    before = records.select("case_id", (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("__prev"))
    joined = records.join(before, ["case_id", "seq"], "left")
    prev = F.when(F.col("seq") == 1, F.lit("")).otherwise(F.col("__prev"))
    sound = F.coalesce((F.col("prev_hash") == prev) & (F.col("entry_hash") == F.sha2(F.concat_ws("|", prev, head, tail), 256)), F.lit(False))
    marked = joined.select("case_id", "id", "seq", sound.alias("sound"))
    first = marked.filter(~F.col("sound")).groupBy("case_id").agg(F.min("seq").alias("broken_at"))
    return marked.join(first, "case_id", "left").select("case_id", "id", "seq", (F.col("broken_at").isNull() | (F.col("seq") < F.col("broken_at"))).alias("ok"))


def verify_content(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Re-hash stored bytes (``id``, ``content``) against the records; missing and altered bytes are told apart."""
    actual = stored.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("actual"))
    reason = F.when(F.col("actual").isNull(), "bytes missing from the store").when(F.col("actual") != F.col("sha256"), "content hash mismatch").otherwise("")
    return records.join(actual, "id", "left").withColumn("reason", reason).withColumn("ok", F.col("reason") == "").select("case_id", "id", "sha256", "actual", "ok", "reason")


def withdrawals(records: DataFrame, events: DataFrame) -> DataFrame:
    """First valid withdrawal per artefact (reason of at least four characters); hashes stay as they are."""
    valid = events.filter(F.length(F.trim("reason")) >= MIN_REASON)
    first = valid.groupBy("id").agg(F.min_by(F.struct("actor", "at_s", "reason"), F.struct("at_s", "actor")).alias("w"))
    return (records.join(first, "id", "left").withColumn("withdrawn", F.col("w").isNotNull()).withColumn("withdrawn_by", F.col("w.actor"))
            .withColumn("withdrawn_s", F.col("w.at_s")).withColumn("withdrawn_reason", F.coalesce("w.reason", F.lit(""))).drop("w"))


def evidence_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("withdrawn").cast("long")).alias("withdrawn"),
                       F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.countDistinct("case_id").alias("cases"))


def certificate(records: DataFrame, content: DataFrame, chain: DataFrame) -> DataFrame:
    """Per case: live and withdrawn counts, live bytes and the outcome of both checks."""
    live = ~F.col("withdrawn")
    base = records.groupBy("case_id").agg(F.sum(live.cast("long")).alias("artefact_count"), F.sum(F.col("withdrawn").cast("long")).alias("withdrawn_count"),
                                          F.sum(F.when(live, F.col("size_bytes")).otherwise(0)).alias("total_bytes"))
    content_ok = content.groupBy("case_id").agg(F.min(F.col("ok").cast("int")).alias("content_ok"))
    chain_ok = chain.groupBy("case_id").agg(F.min(F.col("ok").cast("int")).alias("chain_ok"))
    return (base.join(content_ok, "case_id", "left").join(chain_ok, "case_id", "left")
            .withColumn("intact", F.least("content_ok", "chain_ok")))
