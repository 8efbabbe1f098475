"""Language identification by nearest centroid over normalised TF-IDF vectors of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .words import LOWER, SPACE, pieces

DIMS = 4096
CLUSTERS = 3
SAMPLE = 2000               # training texts per language for the clustering; weights of n-grams use all of them
ROUNDS = 4
ROWS = 256                  # documents whose vectors are held at once
FOLDS, HELD_OUT = 5, 0
SPREAD = 4.0                # a text further out than this many deviations of its centroid's texts is rejected
UNKNOWN = "und"
FOLD = np.where(SPACE, 32, LOWER).astype(np.uint32)
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def _slots(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code + np.uint32(salt)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIMS counts of hashed byte 1-, 2- and 3-grams, letters A-Z folded, white space as one kind."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    code, found = FOLD[data], []
    for n in (1, 2, 3):
        if len(code) < n:
            break
        joint = code[: len(code) - n + 1].copy()
        for k in range(1, n):
            joint = joint << np.uint32(8) | code[k:len(code) - n + 1 + k]
        same = row[: len(joint)] == row[n - 1:]
        found.append((row[: len(joint)] * DIMS + _slots(joint, n << 24))[same])
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.bincount(flat, minlength=rows * DIMS).reshape(rows, DIMS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.maximum(norm, 1e-12)[:, None]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    found = before[offsets[1:]] > before[offsets[:-1]]
    for i in np.flatnonzero(~found):
        raw = data[offsets[i]:offsets[i + 1]]
        if (raw > 127).any():
            found[i] = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    """Centroids (one row each), their languages, the n-gram weights and each centroid's least similarity."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMS + 1, np.int64), 0
    for batch in batches:
        for _, data, offsets in pieces(batch.column(0), ROWS):
            seen[:DIMS] += (gram_counts(data, offsets) > 0).sum(axis=0)
        n += batch.num_rows
    seen[DIMS] = n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(seen)], ["slot", "n"])


def _assign(langs: list[str], idf: np.ndarray, centroids: np.ndarray):
    """Sums per nearest centroid of its own language: (centroid, slot, value); slots past DIMS hold n, similarity and its square."""
    names = np.array(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), DIMS + 3))
        for batch in batches:
            own = np.array(batch.column(1).to_pylist())
            for first, data, offsets in pieces(batch.column(0), ROWS):
                vectors = unit_vectors(gram_counts(data, offsets), idf)
                alike = vectors @ centroids.T
                alike[own[first:first + len(vectors), None] != names[None, :]] = -1
                best = alike.argmax(axis=1)
                for c in np.unique(best):
                    mine = best == c
                    score = alike[mine, c]
                    sums[c, :DIMS] += vectors[mine].sum(axis=0)
                    sums[c, DIMS:] += [mine.sum(), score.sum(), (score * score).sum()]
        c, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(slot), pa.array(sums[c, slot])], ["c", "slot", "value"])

    return run


def fit(docs: DataFrame, scratch: Scratch) -> Model:
    """Learn from rows (text, lang, key) with a language: weights over all rows, centroids by k-means on a bounded sample.

    The sample takes texts by hash of their key, about ``SAMPLE`` per language. What reaches the driver is
    DIMS counts and clusters x languages x DIMS sums, whatever the input.
    """
    counted = docs.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(DIMS + 1)
    seen[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    idf = (np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1).astype(np.float32)
    totals = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not totals:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0))
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / n)))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
    sample = scratch.keep(docs.filter(drawn & (F.length(F.trim("text")) > 0)).select("text", "lang", "key"), "sample")
    firsts = sample.groupBy("lang").agg(F.min_by(F.col("text"), F.xxhash64("key", F.lit(0))).alias("t0"), *[
        F.min_by(F.col("text"), F.xxhash64("key", F.lit(i))).alias(f"t{i}") for i in range(1, CLUSTERS)]).orderBy("lang").collect()
    langs, seeds = [], []
    for r in firsts:
        for i in range(CLUSTERS):
            if r[f"t{i}"] not in seeds[-i:] or i == 0:
                langs.append(r["lang"])
                seeds.append(r[f"t{i}"])
    centroids = np.concatenate([unit_vectors(gram_counts(d, o), idf) for _, d, o in pieces(pa.array(seeds), ROWS)])
    least = np.zeros(len(langs))
    for _ in range(ROUNDS):
        sums = sample.select("text", "lang").mapInArrow(_assign(langs, idf, centroids), "c long, slot long, value double").groupBy("c", "slot").agg(F.sum("value").alias("value")).toArrow()
        table = np.zeros((len(langs), DIMS + 3))
        table[sums["c"].to_numpy(), sums["slot"].to_numpy()] = sums["value"].to_numpy()
        n = np.maximum(table[:, DIMS], 1)
        mean = table[:, DIMS + 1] / n
        least = mean - SPREAD * np.sqrt(np.maximum(table[:, DIMS + 2] / n - mean * mean, 0))
        norm = np.sqrt((table[:, :DIMS] ** 2).sum(axis=1))
        centroids = np.where((norm > 0)[:, None], table[:, :DIMS] / np.maximum(norm, 1e-12)[:, None], centroids).astype(np.float32)
    return Model(langs, idf, centroids, least)


def _predict(model: Model):
    names = np.array(model.langs, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, far = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for first, data, offsets in pieces(batch.column(1), ROWS):
                known = np.flatnonzero(has_letter(data, offsets)) if len(names) else np.zeros(0, np.int64)
                if not len(known):
                    continue
                alike = unit_vectors(gram_counts(data, offsets), model.idf)[known] @ model.centroids.T
                best = alike.argmax(axis=1)
                top = alike[np.arange(len(known)), best]
                lang[first + known], score[first + known], far[first + known] = names[best], np.clip(top, 0, 1), top < model.least[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """Predicted language of every whole text: (doc_id, held_out, lang_pred, score, rejected).

    Learned from rows with a language whose crc32(doc_id) mod 5 is not 0; prediction reads the text alone.
    ``score`` is the cosine to the nearest centroid; ``rejected`` marks texts too far from it.

    Defined results: null text or text without a letter is ``und`` with score 0, as is everything when no row
    has a language; a null doc_id counts as the empty string in the fold; ties go to the first language by name; repeated
    rows are predicted each; an empty table gives an empty result; only doc_id, text and lang are read.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held = F.pmod(F.crc32(key.cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), key.alias("key"))
    model = fit(rows.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", "key"), scratch)
    found = rows.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
    again = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return found.select("doc_id", (F.pmod(F.crc32(again.cast("binary")), F.lit(FOLDS)) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
