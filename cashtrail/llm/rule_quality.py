"""Quality classifier: rules read off trees, weighted by lasso logistic regression, compiled to column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .words import pieces, word_hashes, word_spans

FOLDS, HELD_OUT = 4, 2
SAMPLE = 20_000             # labelled rows to learn from, taken by hash of doc_id
TREES, DEPTH, SEED = 24, 3, 7
LASSO = 0.0005
CUT = 0.7
#: names of the statistics' columns start with two underscores, so they do not meet a document's own columns
STATISTICS = tuple(f"__{name}" for name in ("words", "word_bytes", "symbols", "upper", "digits", "stops", "marks", "bars", "lines", "line_words", "repeats", "distinct", "top_word", "longest"))
#: byte classes counted per document
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "mark": b"!", "bar": b"|", "symbol": b"#*$%&<>~^_=+@/\\{}[]", "line": b"\n"}
CLASS_OF = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES.values(), 1):
    CLASS_OF[list(_chars)] = _i


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column is the text; the others pass through, followed by STATISTICS."""
    for batch in batches:
        out = np.zeros((len(STATISTICS), batch.num_rows))
        for first, data, offsets in pieces(batch.column(batch.num_columns - 1), 2048):
            rows, last = len(offsets) - 1, first + len(offsets) - 1
            row = np.repeat(np.arange(rows), np.diff(offsets))
            kinds = np.bincount(row * 8 + CLASS_OF[data], minlength=rows * 8).reshape(rows, 8)
            starts, ends, at = word_spans(data, offsets)
            hashes, n = word_hashes(data, starts, ends), np.diff(at)
            many = np.maximum(n, 1)
            owner = np.repeat(np.arange(rows), n)
            size = np.bincount(owner, ends - starts, rows)
            again = np.bincount(owner[1:], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), rows) if len(owner) > 1 else np.zeros(rows)
            keyed = np.sort(owner.astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(12))
            runs = np.flatnonzero(np.diff(keyed, prepend=keyed[:1] + np.uint64(1))) if len(keyed) else np.zeros(0, np.int64)
            run_row = (keyed[runs] >> np.uint64(52)).astype(np.int64)
            top, longest = np.zeros(rows), np.zeros(rows)
            np.maximum.at(top, run_row, np.diff(runs, append=len(keyed)))
            np.maximum.at(longest, owner, ends - starts)
            lines = kinds[:, 7] + 1
            out[:, first:last] = (n, size / many, kinds[:, 6] / many, kinds[:, 1] / many, kinds[:, 2] / many, kinds[:, 3] / many, kinds[:, 4] / many,
                                  kinds[:, 5] / many, lines, n / lines, again / many, np.bincount(run_row, minlength=rows) / many, top / many, longest)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x) for x in out)], [*batch.schema.names[:-1], *STATISTICS])


def with_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """``text``, which must be the last column, replaced by STATISTICS of the whole text (null: empty)."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    return rows.mapInArrow(_statistics, ", ".join(x for x in (kept, *(f"`{s}` double" for s in STATISTICS)) if x))


Rule = tuple[tuple[str, str, float], ...]       # conditions (statistic, "<=" or ">", cut), sorted


def tree_rules(description: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """Every path from a root to an inner node or leaf of the printed trees, as a conjunction without repeats."""
    rules: dict[Rule, None] = {}
    path: list[tuple[str, str, float]] = []
    for line in description.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (names[int(m[3])], m[4], float(m[5]))))
        tight: dict[tuple[str, str], float] = {}
        for _, (name, op, cut) in path:
            tight[name, op] = (min if op == "<=" else max)(tight.get((name, op), cut), cut)
        rules[tuple(sorted((name, op, cut) for (name, op), cut in tight.items()))] = None
    return list(rules)


def rule_column(rule: Rule) -> Column:
    test = F.lit(True)
    for name, op, cut in rule:
        test = test & ((F.col(name) <= cut) if op == "<=" else (F.col(name) > cut))
    return test


@dataclass
class Ensemble:
    """Intercept and the rules whose lasso weight is not zero."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights.items():
            total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame) -> Ensemble:
    """Learn from rows of STATISTICS and ``quality``; at most about SAMPLE rows, so the fit does not grow with the input."""
    n, good = labelled.agg(F.count(F.lit(1)), F.sum("quality")).head()
    if not n or good in (0, n):
        # nothing to tell apart: the share of label 1, or an even chance without a label
        share = (float(good or 0) + 0.5) / (n + 1)
        return Ensemble(math.log(share / (1 - share)), {})
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled.withColumn("label", F.col("quality").cast("double")))
    share = good / n
    table = table.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(table.coalesce(8))
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return Ensemble(math.log(share / (1 - share)), {})
    bits = table.select("label", F.array(*[F.when(rule_column(r), 1.0).otherwise(0.0) for r in rules]).alias("bits"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60)
    model = lasso.fit(bits.select("label", array_to_vector("bits").alias("features")).coalesce(8))
    weights = {r: w for r, w in zip(rules, model.coefficients.toArray().tolist()) if abs(w) > 1e-9}
    return Ensemble(model.intercept, weights)


def _held(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fit on labelled documents outside the held-out fold. Of repeated labels the lowest counts."""
    scratch = Scratch(docs.sparkSession)
    marks = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")))
    n = marks.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample / max(n, 1))))
    marks = marks.filter(drawn)  # about ``sample`` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").select("quality", F.col("text").cast("string").alias("text"))
    return fit(scratch.keep(with_statistics(rows), "labelled"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; ``score`` is a probability of label 1.

    Defined results: null or empty text is scored on statistics of 0; without labels every score is 0.5; a
    null doc_id counts as the empty string in the fold and is never learned from; repeated rows are scored each; an
    empty table gives an empty result; only doc_id and text of documents and doc_id and quality of labels are read.
    """
    ensemble = learn(docs, labels)
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scored = rows.select("doc_id", _held(F.col("doc_id")).alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
