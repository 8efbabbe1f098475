"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .words import GOLD, SPACE, mix64, pieces, shingles, word_hashes, word_spans

SEED_WORDS = 3
RARE_SHARE = 0.0005         # a seed in at most this share of the documents is rare; what frequent seeds find is bounded before it is aligned
CONTAMINATED = 0.5          # of the score of an exact copy
MATCH, MISMATCH, GAP = 2, -1, 1
SLACK = 0.3                 # words around a seed's expected place, as a share of the item
BLOCK_WORDS = 300_000       # words of test items sent to the tasks at once; more items go in further blocks
WINDOWS = 64
#: white space and ASCII punctuation part words, so neither changes a match
PARTS = SPACE.copy()
PARTS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


@dataclass
class Items:
    """A block of test items: ids, hashed words, and their seeds sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray       # distinct, sorted
    at: np.ndarray          # seed place, item, position
    rare: np.ndarray | None = None      # of the distinct seeds, those in few documents


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[Items]:
    """Items in order, as many in a block as its words allow; an item longer than that is a block of its own."""
    ids, words, total = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        for _, data, offsets in pieces(pa.array([row["text"] or ""])):
            starts, ends, _ = word_spans(data, offsets, PARTS)
            own = word_hashes(data, starts, ends)
            if not len(own):
                continue
            if ids and total + len(own) > block_words:
                yield _items(ids, words)
                ids, words, total = [], [], 0
            ids.append(row["item_id"])
            words.append(own)
            total += len(own)
    if ids:
        yield _items(ids, words)


def _items(ids: list, words: list[np.ndarray]) -> Items:
    grams = [shingles(w, SEED_WORDS) for w in words]
    flat = np.concatenate(grams)
    seeds, place = np.unique(flat, return_inverse=True)
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    position = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(place, kind="stable")
    return Items(ids, words, seeds, np.stack([place[order], item[order], position[order]]))


def _hits(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
    """(row, word position in the row, seed place) of every seed in the rows, and the rows' word hashes."""
    starts, ends, at = word_spans(data, offsets, PARTS)
    hashes = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    found = []
    for size in range(1, SEED_WORDS + 1):
        # shorter runs only count where they are a whole row, as a short item is one seed
        if len(hashes) < size:
            break
        runs = np.full(len(hashes) - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            runs = mix64(runs * GOLD + hashes[k:len(hashes) - size + 1 + k])
        first = np.arange(len(runs))
        good = row[first] == row[first + size - 1]
        if size < SEED_WORDS:
            good &= np.diff(at)[row[first]] == size
        place = np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)
        good &= seeds[place] == runs
        hit = np.flatnonzero(good)
        found.append(np.stack([row[hit], hit - at[row[hit]], place[hit]]))
    return (np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)), hashes, at


def _seed_documents(items: Items):
    """(seed place, documents that hold it) within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(items.seeds), np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                hits, _, _ = _hits(data, offsets, items.seeds)
                pairs = np.unique(hits[0] * len(items.seeds) + hits[2])
                seen += np.bincount(pairs % len(items.seeds), minlength=len(items.seeds))
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["seed", "n"])

    return run


def rare_seeds(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Seeds in few documents. They only spare the bound of ``promising``: every seed is searched, whatever its frequency."""
    return frequency <= max(1.0, RARE_SHARE * documents)


def promising(item: np.ndarray, windows: np.ndarray, least: float) -> list[list[tuple[int, int]]]:
    """Of each window (rows, padded with 0) the ranges outside which no alignment scores ``least``.

    A word of an alignment adds ``MATCH`` if the item holds it and costs at least one if not, so the best sum of a run of words bounds
    the score of every alignment that ends with it. M matches leave 2 M - least for other words, so a run has 3 n - least words at most.
    """
    own = np.unique(item)
    held = own[np.minimum(np.searchsorted(own, windows), len(own) - 1)] == windows
    sums = np.zeros((len(windows), windows.shape[1] + 1), np.int32)
    np.cumsum(np.where(held, MATCH, -1), axis=1, out=sums[:, 1:])
    span = max(1, min((MATCH + 1) * len(item) - int(np.ceil(least)), windows.shape[1]))
    low, width = sums[:, :-1].copy(), 1
    while width < span:
        step = min(width, span - width)
        low[:, step:] = np.minimum(low[:, step:], low[:, :-step])
        width += step
    good = held & (sums[:, 1:] - low >= least)
    out: list[list[tuple[int, int]]] = [[] for _ in windows]
    for x, end in zip(*np.nonzero(good)):
        a, b = max(0, int(end) + 1 - span), int(end) + 1
        if out[x] and a <= out[x][-1][1]:
            a = out[x].pop()[0]
        out[x].append((a, b))
    return out


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of an item with each window (rows, padded with 0): (score, end in the window).

    Row by row of the Smith-Waterman table for all windows at once; a gap along a row is a running maximum.
    """
    n = windows.shape[1]
    slope = GAP * np.arange(n, dtype=np.int32)
    above = np.zeros(windows.shape, np.int32)
    best, where = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    for word in item:
        fresh = np.where(windows == word, MATCH, MISMATCH).astype(np.int32)
        fresh[:, 1:] += above[:, :-1]
        fresh = np.maximum(np.maximum(fresh, above - GAP), 0)
        above = np.maximum.accumulate(fresh + slope, axis=1) - slope
        top = above.argmax(axis=1)
        score = above[np.arange(len(windows)), top]
        where = np.where(score > best, top, where)
        best = np.maximum(best, score)
    return best, where


def _windows(positions: np.ndarray, places: np.ndarray, rare: np.ndarray, size: int, words: int) -> list[tuple[int, int, bool]]:
    """Merged word ranges of a row in which the item is expected from its seeds' positions, and whether all those seeds are rare."""
    slack = int(SLACK * size) + SEED_WORDS
    begin = np.maximum(0, positions - places - slack)
    end = np.minimum(words, positions - places + size + slack)
    merged: list[tuple[int, int, bool]] = []
    for a, b, plain in sorted(zip(begin.tolist(), end.tolist(), rare.tolist())):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), plain and merged[-1][2])
        else:
            merged.append((a, b, plain))
    return merged


def _table(spans: list[tuple], hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    table = np.zeros((len(spans), max(s[2] - s[1] for s in spans)), np.uint64)
    for x, (r, a, b, *_) in enumerate(spans):
        table[x, :b - a] = hashes[at[r] + a:at[r] + b]
    return table


def _narrowed(item: np.ndarray, spans: list[tuple], hashes: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Spans (row, begin, end) to align: those of rare seeds as they are, of the others what is promising."""
    out, wide = [s[:3] for s in spans if s[3]], sorted((s for s in spans if not s[3]), key=lambda s: s[2] - s[1])
    for k in range(0, len(wide), WINDOWS):
        part = wide[k:k + WINDOWS]
        for (r, a, _, _), ranges in zip(part, promising(item, _table(part, hashes, at), least)):
            out += [(r, a + x, a + y) for x, y in ranges]
    return out


def _align_documents(items: Items, least: float):
    """(doc_id, item_id, score, first_word, last_word): the best passage of every document for every item, from ``least`` on."""
    place, item, position = items.at
    bounds = np.searchsorted(place, np.arange(len(items.seeds) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, scores, firsts, lasts = [], [], [], [], []
            for first, data, offsets in pieces(batch.column(1)):
                hits, hashes, at = _hits(data, offsets, items.seeds)
                many = bounds[hits[2] + 1] - bounds[hits[2]]
                each = np.repeat(np.arange(hits.shape[1]), many)
                which = np.concatenate([np.arange(bounds[s], bounds[s + 1]) for s in hits[2]]) if len(each) else np.zeros(0, np.int64)
                row, spot, one, inside, rare = hits[0][each], hits[1][each], item[which], position[which], items.rare[hits[2][each]]
                order = np.lexsort((row, one))
                jobs: dict[int, list[tuple[int, int, int, bool]]] = {}
                ends = np.flatnonzero(np.diff(one[order] * len(offsets) + row[order], append=-1)) + 1
                begin = 0
                for end in ends:
                    part = order[begin:end]
                    begin = end
                    r, i = int(row[part[0]]), int(one[part[0]])
                    jobs.setdefault(i, []).extend((r, *w) for w in _windows(spot[part], inside[part], rare[part], len(items.words[i]), int(at[r + 1] - at[r])))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for i, wide in jobs.items():
                    full = MATCH * len(items.words[i])
                    spans = sorted(_narrowed(items.words[i], wide, hashes, at, least * full), key=lambda s: s[2] - s[1])
                    for k in range(0, len(spans), WINDOWS):
                        part = spans[k:k + WINDOWS]
                        score, where = align(items.words[i], _table(part, hashes, at))
                        for x in np.flatnonzero(score >= least * full):
                            r, a, b = part[x]
                            new = (float(score[x]) / full, a, a + int(where[x]))
                            if new > best.get((r, i), (0.0, 0, 0)):
                                best[r, i] = new
                for (r, i), (score, a, b) in sorted(best.items()):
                    rows.append(first + r)
                    found.append(items.ids[i])
                    scores.append(score)
                    firsts.append(a)
                    lasts.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64()), pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())],
                                             ["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = CONTAMINATED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Passages of whole documents that copy, edit or paraphrase a test item: (doc_id, item_id, score, first_word, last_word).

    ``score`` is the Smith-Waterman score of words over that of an exact copy. Items go to the tasks in blocks of bounded size, each
    against all documents; seed frequencies are counted over all documents. Nothing is shuffled but one count per seed and task.
    Every seed is searched: around rare ones the passage is aligned at once, around frequent ones where a bound on its score allows it,
    so an edited copy that stands in many documents is found in each of them.

    Defined results: null or empty texts and items match nothing; an item of fewer than three words only matches a
    document of just these words; repeated rows match each; null doc_id and item_id are passed on; of equally good passages
    the later one counts; empty tables give an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    out, total = docs.sparkSession.createDataFrame([], schema), None
    for items in item_blocks(benchmark, block_words):
        if total is None:
            total = rows.count()
        counted = rows.select("text").mapInArrow(_seed_documents(items), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(len(items.seeds), np.int64)
        frequency[counted["seed"].to_numpy()] = counted["n"].to_numpy()
        items.rare = rare_seeds(frequency, total)
        out = out.unionByName(rows.mapInArrow(_align_documents(items, least), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a contaminated passage, all columns kept.

    A document goes by its doc_id; rows without one are kept unless they are contaminated themselves, which is decided by their text.
    """
    marked = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    hit = contamination(marked.select(F.col("__key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__key")).distinct()
    hit = Scratch(docs.sparkSession).keep(hit, "contaminated")
    return marked.join(hit, "__key", "left_anti").drop("__key")
