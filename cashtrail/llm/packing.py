"""Packing documents into sequences: few-document length patterns by non-negative least squares, best fit for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Scratch, as_text
from .vocab import BYTE_FILE, byte_tokens, vocabulary

SIZE, END_ID = 2048, 0
#: longest pattern in documents, patterns enumerated of each number of documents, steps of the fit
MOST_DOCS, PATTERNS, STEPS = 4, 8192, 1000


# ---- pieces ---------------------------------------------------------------------------------------------------

def cut_pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): ``nth`` numbers the pieces of one length within a task, ``part`` the task."""
    key = docs.schema["doc_id"].dataType
    longs = T.LongType()
    out = T.StructType([T.StructField("doc_id", key), T.StructField("piece", T.IntegerType()), *(T.StructField(c, longs) for c in ("start", "length", "ids_crc32", "part", "nth"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, part = byte_tokens(path, False), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py()) + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                edges = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    of.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[4 * a:4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                             names=out.names)

    return docs.select("doc_id", as_text()).mapInArrow(run, out)


# ---- the plan, on the histogram of lengths alone ----------------------------------------------------------------

class Group(NamedTuple):
    """``count`` sequences that hold the same (length, times), in this order."""

    count: int
    holds: tuple[tuple[int, int], ...]


def patterns(size: int, most_docs: int = MOST_DOCS, wanted: int = PATTERNS) -> np.ndarray:
    """Falling lengths of 2 to ``most_docs`` documents that fill a sequence to the last token, zeros behind; at most about ``wanted`` of
    each number of documents, thinned evenly by a lattice over the lengths."""
    found = []
    for docs in range(2, most_docs + 1):
        heads = np.arange(-(-size // docs), size - docs + 2)[:, None]
        for left in range(docs - 1, 0, -1):
            rest = size - heads.sum(1)
            low, high = -(-rest // left), np.minimum(heads[:, -1], rest - left + 1)
            if left == 1:
                keep = (rest >= 1) & (rest <= heads[:, -1])
                heads = np.hstack([heads[keep], rest[keep, None]])
                break
            n = np.maximum(high - low + 1, 0)
            step = max(1, int(n.sum()) // (wanted if left == 2 else 8 * wanted))
            first = (-heads @ (np.arange(heads.shape[1]) * 2 + 3) - low) % step
            n = np.maximum((n - first + step - 1) // step, 0)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            heads = np.hstack([np.repeat(heads, n, 0), (np.repeat(low + first, n) + step * at)[:, None]])
        found.append(np.pad(heads, ((0, 0), (0, most_docs - docs))))
    return np.concatenate(found) if found else np.zeros((0, most_docs), np.int64)


def fit_counts(table: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often each pattern is laid: non-negative least squares against the histogram, by projected gradients with momentum."""
    have = histogram.astype(float)
    have[0] = 0
    scale = have.max() or 1.0
    target, n = have / scale, len(histogram)
    usable = (table == 0) | (have[table] > 0)
    table = np.where(usable.all(1)[:, None], table, 0)
    if not table.any():
        return np.zeros(len(table))
    uses = np.bincount(table.ravel(), minlength=n)
    uses[0] = 0
    # the largest row sum of A A' bounds the steepest direction
    rate = 1.0 / (uses.max() * table.shape[1])
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(steps):
        laid = np.bincount(table.ravel(), np.repeat(y, table.shape[1]), minlength=n)
        miss = target - laid
        miss[0] = 0
        step = np.maximum(0.0, y + rate * miss[table].sum(1))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = step + (t - 1) / after * (step - x), step, after
    return np.where(table.any(1), x, 0) * scale


def whole_counts(table: np.ndarray, fitted: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Fitted counts rounded down, and taken back where a length has not so many pieces."""
    counts, left = np.floor(fitted + 1e-9).astype(np.int64), histogram.astype(np.int64).copy()
    for p in np.argsort(-counts, kind="stable"):
        if counts[p] == 0:
            break
        lengths, times = np.unique(table[p][table[p] > 0], return_counts=True)
        counts[p] = max(0, min(counts[p], int((left[lengths] // times).min())))
        left[lengths] -= times * counts[p]
    return counts


def best_fit(left: np.ndarray, size: int) -> list[Group]:
    """Best fit by falling length, whole groups of equal sequences at a time; exactly what piece by piece would give."""
    open_at: list[list[Group]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        n = int(left[length])
        room = length
        while n:
            while room < size and not open_at[room]:
                room += 1
            group = open_at[room].pop() if open_at[room] else Group(-(-n // (size // length)), ())
            each = room // length
            full = min(group.count, n // each)
            if full:
                open_at[room - each * length].append(Group(full, (*group.holds, (length, each))))
            n -= full * each
            rest = group.count - full
            if n and rest:
                open_at[room - n * length].append(Group(1, (*group.holds, (length, n))))
                n, rest = 0, rest - 1
            if rest and group.holds:
                open_at[room].append(Group(rest, group.holds))
    return [g for groups in open_at for g in groups]


def plan(histogram: np.ndarray) -> list[Group]:
    """Groups of sequences for all pieces; ``histogram[l]`` pieces have length l, the last entry those that fill a sequence."""
    size = len(histogram) - 1
    table = patterns(size)
    counts = whole_counts(table, fit_counts(table, histogram), histogram)
    left, groups = histogram.astype(np.int64).copy(), []
    for p in np.flatnonzero(counts):
        lengths, times = np.unique(table[p][table[p] > 0], return_counts=True)
        groups.append(Group(int(counts[p]), tuple(zip(lengths.tolist(), times.tolist()))))
        left[lengths] -= times * counts[p]
    return groups + best_fit(left, size)


def slots(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, times), by length and rank: where the pieces of a length go in order of their rank."""
    rows, sequence = [], 0
    for group in groups:
        offset = 0
        for length, times in group.holds:
            rows.append((length, group.count * times, sequence, offset, times))
            offset += length * times
        sequence += group.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    before = np.cumsum(table[:, 1]) - table[:, 1]
    firsts = before[np.searchsorted(table[:, 0], table[:, 0])] if len(table) else before
    table[:, 1] = before - firsts
    return table


# ---- the operator -----------------------------------------------------------------------------------------------

def place(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    """Sequence and offset of every piece by its length and ``rank`` among the pieces of that length."""
    out = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keep = [f.name for f in ranked.schema.fields if f.name != "rank"]
    # one row per part of a pattern: bounded by the enumeration and the number of lengths, not by the documents
    shared = ranked.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        starts = np.searchsorted(rows[:, 0], np.arange(rows[:, 0].max() + 2 if len(rows) else 1))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            low, high = starts[length], starts[length + 1] - 1
            while (low < high).any():
                middle = (low + high + 1) // 2
                fits = rows[middle, 1] <= rank
                low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
            inside = rank - rows[low, 1]
            sequence, offset = rows[low, 2] + inside // rows[low, 4], rows[low, 3] + inside % rows[low, 4] * length
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(sequence), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(run, out)


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """Place of every piece of every document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Texts are read once; the pieces' lengths are counted per task, and only the histogram of lengths (``size`` rows) reaches the
    driver, where the patterns are fitted. A piece's rank among those of its length is its number in its task plus the pieces of that
    length in tasks before, so no length is gathered, however common.

    Defined results: null and empty texts are one piece that holds the end id alone; a text longer than a sequence starts with the
    short piece, if there is one; repeated rows and null doc_id are rows of their own; an empty table gives an empty result; columns
    other than doc_id and text are not read. ``tokenizer`` is the place of a byte-level vocabulary that every executor can open.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(cut_pieces(docs, tokenizer or vocabulary(BYTE_FILE), size), "pieces")
    counts = scratch.keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return place(ranked, slots(plan(histogram)))
