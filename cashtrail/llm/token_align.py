"""Token boundaries of two tokenizers over the same text: galloping intersection of end offsets, and linked ids over the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Scratch, as_text
from .vocab import BYTE_FILE, PIECE_FILE, byte_tokens, piece_tokens, units_of, vocabulary

#: texts aligned at once in a task; links of a group written out one by one; most pairs that are looked up by broadcast (16 bytes each)
BLOCK_BYTES, SMALL_GROUP, FREQUENT = 1 << 20, 256, 1 << 18
#: an octave of counts falls into so many levels
LEVELS = 8
#: every so many ends of the shorter list are searched first and bound the ones between
STRIDE = 4


# ---- end offsets ------------------------------------------------------------------------------------------------

def forward_search(long: np.ndarray, values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First index from ``start`` on whose end is not below the value: steps of 1, 2, 4, ... and then halves. All searches advance
    together; a value is never above the last end of its document, so none leaves it by more than the array's end."""
    low, high, last, step = start.copy(), start.copy(), len(long) - 1, 1
    live = np.flatnonzero(long[high] < values)
    while live.size:
        low[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step, last)
        live = live[long[high[live]] < values[live]]
        step *= 2
    live = np.flatnonzero(low < high)
    while live.size:
        middle = (low[live] + high[live]) >> 1
        below = long[middle] < values[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return high


def gallop(short: np.ndarray, long: np.ndarray, short_starts: np.ndarray, long_starts: np.ndarray) -> np.ndarray:
    """For every end of the shorter list where it is in the longer one, -1 if nowhere. Ends rise through all documents; document d has
    its first at ``short_starts[d]`` and ``long_starts[d]``.

    The shorter list drives. Every STRIDE^k-th of its ends is sought first, from where the one before it in the coarser round was
    found, so the steps of the last round are few.
    """
    counts = np.diff(np.append(short_starts, len(short)))
    place = np.arange(len(short)) - np.repeat(short_starts, counts)
    found = np.repeat(long_starts, counts)
    stride = STRIDE ** int(np.log(max(2, counts.max(initial=0))) / np.log(STRIDE))
    while stride:
        now = np.flatnonzero(place % stride == 0) if stride > 1 else np.arange(len(short))
        coarse = place[now] % (stride * STRIDE)
        found[now] = forward_search(long, short[now], found[now - coarse])
        stride = stride // STRIDE
    return np.where(long[found] == short, found, -1) if len(short) else found


def common_ends(a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into both end lists of the offsets that they share; in each document the shorter list drives into the longer."""
    a_first, b_first = np.cumsum(a_counts) - a_counts, np.cumsum(b_counts) - b_counts
    at_a, at_b = [], []
    for drives, mine, other, mine_first, other_first, mine_counts, other_counts, out in (
            (a_counts <= b_counts, a, b, a_first, b_first, a_counts, b_counts, (at_a, at_b)),
            (a_counts > b_counts, b, a, b_first, a_first, b_counts, a_counts, (at_b, at_a))):
        picked = np.flatnonzero(np.repeat(drives, mine_counts))
        n, m = mine_counts[drives], other_counts[drives]
        searched = np.flatnonzero(np.repeat(drives, other_counts))
        if not len(picked):
            continue
        hit = gallop(mine[picked], other[searched], np.cumsum(n) - n, np.cumsum(m) - m)
        out[0].append(picked[hit >= 0])
        out[1].append(searched[hit[hit >= 0]])
    return (np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (at_a, at_b))


# ---- a block of documents ---------------------------------------------------------------------------------------

class Aligner:
    """Both tokenizers of a task and what is looked up by id."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = byte_tokens(byte_path, True), piece_tokens(piece_path)
        self.bytes_a, self.bytes_b = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        # an id and the mark behind it: "," within a group, "|" between the sides, ";" before the next group
        self.shown = [f"{i}{mark}" for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]

    def tokens(self, text: str | None) -> tuple[bytes, bytes] | None:
        """Ids of both sides, None where they do not spell the text with a space before it."""
        if not text:
            return None
        units = units_of(text)
        (a, a_spells), (b, b_spells) = self.a.spaced(text, units), self.b.spaced(text, units)
        return (a, b) if a_spells and b_spells else None

    def block(self, found: list[tuple[bytes, bytes]]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts per document, hashes, and the documents' distinct linked pairs: offsets, keys (A id times size of B, plus B id), times."""
        counts = [np.array([len(x[side]) // 4 for x in found], np.int64) for side in (0, 1)]
        ids = [np.frombuffer(b"".join(x[side] for x in found), "<u4").astype(np.int64) for side in (0, 1)]
        ends = [np.cumsum(size[i]) for size, i in zip((self.bytes_a, self.bytes_b), ids)]
        at = list(common_ends(*ends, *counts))
        doc = np.repeat(np.arange(len(found)), counts[0])[at[0]]
        n_groups = np.bincount(doc, minlength=len(found))
        sizes = [np.diff(x, prepend=-1) for x in at]
        links = sizes[0] * sizes[1]
        before = np.concatenate([[0], np.cumsum(links)])
        group_ends = np.cumsum(n_groups)
        n_links = before[group_ends] - before[group_ends - n_groups]
        return [*counts, n_groups, n_links], self._hashes(ids, at, sizes, n_groups), *self._pairs(ids, at, sizes, links, doc, len(found))

    def _hashes(self, ids, at, sizes, n_groups) -> list[str]:
        """Group by group the A ids and then the B ids, each with the mark behind it."""
        n = [len(i) for i in ids]
        order = np.empty(n[0] + n[1], np.int64)
        before_a, before_b = np.cumsum(sizes[0]) - sizes[0], np.cumsum(sizes[1]) - sizes[1]
        codes = [ids[0].copy(), ids[1] + 2 * self.n_a]
        codes[0][at[0]] += self.n_a
        codes[1][at[1]] += self.n_b
        order[np.arange(n[0]) + np.repeat(before_b, sizes[0])] = codes[0]
        order[np.arange(n[1]) + np.repeat(before_a + sizes[0], sizes[1])] = codes[1]
        tokens = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
        last = np.cumsum(n_groups)
        edges = tokens[np.concatenate([[0], last])]
        shown, out = self.shown, []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            text = "".join(map(shown.__getitem__, order[low:high].tolist()))
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest())
        return out

    def _pairs(self, ids, at, sizes, links, doc, n_docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Small groups give their pairs one by one; of a large one each side's distinct ids are paired with the product of their counts."""
        span = self.n_a * self.n_b
        first = [x - s + 1 for x, s in zip(at, sizes)]
        small = np.flatnonzero(links <= SMALL_GROUP)
        n = links[small]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(sizes[1][small], n)
        keys = [np.repeat(doc[small], n) * span + ids[0][np.repeat(first[0][small], n) + nth // wide] * self.n_b + ids[1][np.repeat(first[1][small], n) + nth % wide]]
        times = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(links > SMALL_GROUP):
            (ua, ca), (ub, cb) = (np.unique(i[f[g]:f[g] + s[g]], return_counts=True) for i, f, s in zip(ids, first, sizes))
            keys.append((doc[g] * span + ua[:, None] * self.n_b + ub).ravel())
            times.append(np.outer(ca, cb).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        if len(times) and times.max() > 1:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            heads = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, times = keys[heads], np.add.reduceat(times, heads)
        else:
            keys, times = np.unique(keys, return_counts=True)
        return np.searchsorted(keys, np.arange(n_docs + 1) * span), keys % span, times


ALIGNED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())]
                       + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "times")])


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The columns of ``docs`` but its last, the text, and ALIGNED: groups and distinct linked pairs of every document, one scan."""
    out = T.StructType(docs.schema.fields[:-1] + ALIGNED.fields)

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
        texts, size, start = [], 0, 0
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= BLOCK_BYTES:
                yield start, texts
                texts, size, start = [], 0, i + 1
        if texts:
            yield start, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            for start, texts in blocks(batch):
                found = [aligner.tokens(t) for t in texts]
                have = np.array([f is not None for f in found])
                counts, hashes, edges, keys, times = aligner.block([f for f in found if f is not None])
                columns = []
                for c in counts:
                    full = np.zeros(len(texts), np.int64)
                    full[have] = c
                    columns.append(pa.array(full))
                names = iter(hashes)
                columns.append(pa.array([next(names) if h else "" for h in have], pa.string()))
                sizes = np.zeros(len(texts) + 1, np.int64)
                sizes[1:][have] = np.diff(edges)
                offsets = pa.array(np.cumsum(sizes).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([c.slice(start, len(texts)) for c in batch.columns[:-1]] + columns, names=out.names)

    return docs.mapInArrow(run, out)


# ---- counts over the corpus -------------------------------------------------------------------------------------

def frequent_from(counts: DataFrame, most: int = FREQUENT) -> int:
    """Lowest level of counts from which on at most ``most`` pairs are left; a level is an eighth of an octave, so few rows reach the driver."""
    levels = counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("level").desc()).collect()
    low, total = (levels[0]["level"] + 1) if levels else 0, 0
    for level, n in levels:
        total += n
        if total > most:
            break
        low = level
    return low


def look_up(aligned: DataFrame, frequent: tuple[np.ndarray, np.ndarray], best: np.ndarray, n_b: int) -> DataFrame:
    """Sums over the links whose pair is frequent, and the pairs and times that are left, per row of ``aligned``."""
    keep = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    longs = T.ArrayType(T.LongType())
    out = T.StructType(keep + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("pairs", longs), T.StructField("times", longs)])
    # bounded: FREQUENT pairs, and one count per id of the first vocabulary
    shared = aligned.sparkSession.sparkContext.broadcast((*frequent, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, tops = shared.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            edges = pairs.offsets.to_numpy().astype(np.int64)
            keys, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            edges = edges - edges[0]
            place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
            count = np.where(hit, counts[place], 0) if len(known) else np.zeros(len(keys), np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * (hit & (count == tops[keys // n_b])), n * count)]
            left = np.concatenate([[0], np.cumsum(~hit)])[edges].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in keep] + [pa.array(s[edges[1:]] - s[edges[:-1]]) for s in sums] + rest, names=out.names)

    return aligned.mapInArrow(run, out)


def token_alignment(docs: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None, most_frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A scan tokenizes by both vocabularies, cuts the tokens at the ends both share and writes each document's distinct linked pairs. A
    pair's count is the number of documents that hold it. Counts of frequent pairs go out by broadcast, at most ``most_frequent``
    of them; the other pairs are joined with their counts by a shuffle, in which no key can be frequent.

    Defined results: null and empty texts, and texts that the tokens of a side do not spell, have zeros and the empty string; repeated
    rows and null doc_id are documents of their own; an empty table gives an empty result; columns other than doc_id and text are not
    read. The vocabularies are places that every executor can open.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    paths = byte_vocabulary or vocabulary(BYTE_FILE), piece_vocabulary or vocabulary(PIECE_FILE)
    tokens_a, n_b = byte_tokens(paths[0], True), len(piece_tokens(paths[1]).bytes_of)
    aligned = scratch.keep(align(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", as_text()), *paths), "aligned", compression="zstd")
    level = F.floor(F.log2("docs") * LEVELS)
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = scratch.keep(counts.withColumn("level", level), "counts")
    best = scratch.keep(counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("docs").alias("top")), "best")
    low = frequent_from(counts, most_frequent)
    known = counts.filter(F.col("level") >= low).select("pair", "docs").orderBy("pair").toArrow()
    top = best.toArrow()
    tops = np.zeros(len(tokens_a.bytes_of), np.int64)
    tops[top["a"].to_numpy()] = top["top"].to_numpy()
    looked = scratch.keep(look_up(aligned, (known["pair"].to_numpy(), known["docs"].to_numpy()), tops, n_b), "looked", compression="zstd")
    rare = (looked.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
            .join(counts.filter(F.col("level") < low).select("pair", "docs"), "pair").withColumn("a", F.expr(f"pair div {n_b}"))
            # one row per id of a vocabulary
            .join(F.broadcast(best), "a").groupBy("row")
            .agg(F.sum(F.when(F.col("docs") == F.col("top"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("docs")).alias("more")))
    return (looked.drop("pairs", "times").join(rare, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256"))
