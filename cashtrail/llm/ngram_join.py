"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip), linked into groups."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .tables import Scratch, low_labels
from .words import GOLD, mix64, row_shingles

SHINGLE = 3
NUM, DEN = 9, 10                # of op1: link when DEN * intersection >= NUM * union
SLOTS = 1 << 18                 # counters of the frequency order; bounds what is sent to the tasks (1 MB)
LONG_LIST = 32                  # lists over this length are left out of merging where the threshold allows it
SPARE = 20                      # one list in so many is merged beyond the shortest prefix, for thresholds over 1 / SPARE
PAIRED = 4 * SPARE              # smaller sets meet under two listed grams at once: one spare list is no evidence among texts of one template
BLOCK = 512                     # documents of one inverted block
PER_PART = 2000                 # candidates of one query that one task takes
STAR_ROUNDS = 2
SIGNS = tuple(f"s{k}" for k in range(4))      # columns of a set's parity bitmap, 64 bits each
MU = 0.0085                     # weight of probing against merging when the long lists are chosen


def _set_key(grams: np.ndarray) -> tuple[int, int]:
    """(class key, hash) of a set of hashes."""
    if not len(grams):
        return 0, 0
    # an order-free hash of the whole set
    sums = np.array([np.add.reduce(grams), np.bitwise_xor.reduce(grams), len(grams)], np.uint64)
    mixed = mix64(sums * GOLD)
    return int(np.bitwise_xor.reduce(mix64(mixed + np.arange(3, dtype=np.uint64))).astype(np.int64)), len(grams)


def _parity(grams: np.ndarray) -> np.ndarray:
    """A bitmap of a set: a bit for each slot that an odd number of its grams falls into."""
    slots = (mix64(grams) >> np.uint64(64 - 8)).astype(np.int64)  # 8 bits number the 64 * len(SIGNS) slots
    return np.packbits((np.bincount(slots, minlength=64 * len(SIGNS)) & 1).astype(np.uint8)).view(np.int64)


def _describe(size: int):
    """Rows (doc_id, cls, n, bitmap) for documents and (slot, null, count, zeros) for the frequency counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            keys, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            signs = np.zeros((batch.num_rows, len(SIGNS)), np.int64)
            for row, grams in row_shingles(batch.column(1), size):
                grams = np.unique(grams)
                keys[row], sizes[row] = _set_key(grams)
                signs[row] = _parity(grams)
                _count(slots, grams)
            yield described(batch.column(0).cast(pa.int64()), keys, sizes, False, signs)
        held = np.flatnonzero(slots)
        yield described(pa.array(held), np.zeros(len(held), np.int64), slots[held], True, np.zeros((len(held), len(SIGNS)), np.int64))

    def described(ids: pa.Array, keys: np.ndarray, sizes: np.ndarray, counter: bool, signs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(sizes), pa.array(np.full(len(keys), counter)), *map(pa.array, np.ascontiguousarray(signs.T))], ["id", "cls", "n", "counter", *SIGNS])

    return run


def _count(slots: np.ndarray, grams: np.ndarray) -> None:
    # sorted hashes have sorted slots, so runs are counted by their ends
    at = (grams >> np.uint64(46)).astype(np.int64)
    ends = np.flatnonzero(np.diff(at, append=-1))
    slots[at[ends]] += np.diff(ends, prepend=-1)


def _paired_below(num: int, den: int, paired: int) -> int:
    """Sets under this size are listed under pairs of grams too, since a partner may be smaller than ``paired``."""
    return (paired - 1) * den // num + 1


def _short_lists(size: int, num: int, den: int, paired_to: int, frequency):
    """Rows (gram, cls, n, i, paired): the first grams of every set in order of frequency, once per set and task; i counts from 1.

    A set of ``paired_to`` grams or more is listed under its first n - T + spare grams. Smaller ones, and those that may have a smaller
    partner, are listed under every two of their first n - T + 2 grams, of which partners share two; i is the place of the later one.
    """
    names = ["gram", "cls", "n", "i", "paired"]

    def rows(found, paired: bool) -> pa.RecordBatch:
        lengths = [len(g) for g, _, _, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g for g, _, _, _ in found]).astype(np.int64)), pa.array(np.repeat([k for _, _, k, _ in found], lengths)),
                                           pa.array(np.repeat(np.array([n for _, _, _, n in found], np.int32), lengths)), pa.array(np.concatenate([i for _, i, _, _ in found]).astype(np.int32)),
                                           pa.array(np.full(sum(lengths), paired))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequency.value, set()
        for batch in batches:
            single, double = [], []
            for _, grams in row_shingles(batch.column(0), size):
                grams = np.unique(grams)
                key, n = _set_key(grams)
                if not n or key in seen:
                    continue
                seen.add(key)
                need = -(-num * n // den)
                order = np.lexsort((grams, counts[(grams >> np.uint64(46)).astype(np.int64)]))
                if n >= paired_to:
                    take = min(n, n - need + max(1, n // SPARE))
                    single.append((grams[order[:take]], np.arange(1, take + 1), key, n))
                if n < _paired_below(num, den, paired_to):
                    first, later = np.triu_indices(min(n, n - need + 2), 1)
                    double.append((mix64(grams[order[first]] * GOLD + mix64(grams[order[later]])), later + 1, key, n))
            for found, paired in ((single, False), (double, True)):
                if found:
                    yield rows(found, paired)

    return run


def _sets(size: int):
    """Rows (cls, grams) of the documents asked for, whose set is indeed the one of ``cls``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, keys, sets = batch.column(1).to_numpy(zero_copy_only=False), [], []
            for row, grams in row_shingles(batch.column(0), size):
                grams = np.unique(grams)
                if _set_key(grams)[0] == asked[row]:
                    keys.append(asked[row])
                    sets.append(grams.astype(np.int64))
                if sum(map(len, sets[-64:])) > 1 << 17 or len(sets) >= 256:
                    yield _set_rows(keys, sets)
                    keys, sets = [], []
            if sets:
                yield _set_rows(keys, sets)

    return run


def _set_rows(keys, sets) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["cls", "grams"])


def divide_skip(query: np.ndarray, block: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[int]:
    """Places in ``block`` of the sets whose overlap with ``query`` reaches T = num (|q| + |d|) / (num + den).

    The query's inverted lists over the block are divided: the L longest are skipped, the others merged by a
    heap, and a set seen at least T - L times in the merge is probed in the long lists by binary search.
    """
    sizes = np.array([len(s) for s in block])
    need = -(-num * (len(query) + sizes) // (num + den))
    grams = np.concatenate(block)
    owner = np.repeat(np.arange(len(block)), sizes)
    at = np.minimum(np.searchsorted(query, grams), len(query) - 1)
    held = query[at] == grams
    at, owner = at[held], owner[held]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    lengths = np.bincount(at, minlength=len(query))
    lists = np.split(owner, np.cumsum(lengths)[:-1])
    lists = sorted((x for x in lists if len(x)), key=len)
    if not lists:
        return []
    least = int(need.min())
    skipped = min(int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)), least - 1, len(lists))
    short, long = lists[:len(lists) - skipped], lists[len(lists) - skipped:]
    found = []
    for doc, hits in groupby(heapq.merge(*(x.tolist() for x in short))):
        count = sum(1 for _ in hits)
        missing = need[doc] - count
        if missing > len(long):
            continue
        for i, posting in enumerate(long):
            if missing <= 0 or missing > len(long) - i:
                break
            k = np.searchsorted(posting, doc)
            missing -= k < len(posting) and posting[k] == doc
        if missing <= 0:
            found.append(doc)
    return found


def _search(num: int, den: int):
    """Rows arrive sorted by (query, salt) with the query's own set first; links (a, b) leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "query": None, "cls": [], "sets": []}

        def flush() -> pa.RecordBatch:
            hits = divide_skip(state["query"], state["sets"], num, den) if state["query"] is not None and state["sets"] else []
            rows = pa.RecordBatch.from_arrays([pa.array([state["key"][0]] * len(hits), pa.int64()), pa.array([state["cls"][i] for i in hits], pa.int64())], ["a", "b"])
            state["cls"], state["sets"] = [], []
            return rows

        for batch in batches:
            query, salt, cls = (batch.column(i).to_pylist() for i in range(3))
            grams = batch.column(3)
            values, ends = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
            for i in range(batch.num_rows):
                key, one = (query[i], salt[i]), values[ends[i]:ends[i + 1]].copy()
                if key != state["key"]:
                    if state["sets"]:
                        yield flush()
                    state["key"], state["query"] = key, None
                if cls[i] == query[i]:
                    state["query"] = one
                    continue
                state["cls"].append(cls[i])
                state["sets"].append(one)
                if len(state["sets"]) == BLOCK:
                    yield flush()
        if state["sets"]:
            yield flush()

    return run


class Join:
    """The steps of one join over ``docs`` (doc_id, text) at Jaccard ``num`` / ``den``; every step is a written table."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, paired: int = PAIRED):
        self.num, self.den, self.paired = num, den, paired
        self.spark, self.size, self.scratch, self.turn = docs.sparkSession, size, Scratch(docs.sparkSession), 0
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(self) -> None:
        both = self.scratch.keep(self.docs.mapInArrow(_describe(self.size), ", ".join(["id long, cls long, n long, counter boolean", *[f"{c} long" for c in SIGNS]])), "described")
        self.members = both.filter("not counter").select(F.col("id").alias("doc_id"), "cls", "n")
        # at most SLOTS rows reach the driver and, as one array, the tasks
        counts = both.filter("counter").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        slots = np.zeros(SLOTS, np.int64)
        slots[counts["id"].to_numpy()] = counts["n"].to_numpy()
        self.frequency = self.spark.sparkContext.broadcast(np.minimum(slots, (1 << 31) - 1).astype(np.int32))
        sets = both.filter("not counter and n > 0").groupBy("cls").agg(F.min("id").alias("doc_id"), F.max("n").cast("int").alias("n"), *[F.max(c).alias(c) for c in SIGNS])
        self.classes = self.scratch.keep(sets, "classes")

    def index(self) -> None:
        """Inverted lists of at least two sets: (gram, cls, n, i, paired, cut, own, needy); long ones only hold the sets that need them.

        ``cut`` counts a set's long lists and ``own`` those that hold no other set. Two sets of the required overlap meet in as
        many lists as the smaller one's spare, less the long ones both leave out. A partner has the threshold's share of a set's
        size at least, so a set whose ``cut`` stays under that share of its spare meets every partner in short lists; the others
        (``needy``) stay in the long lists. Lists of paired grams are never cut.
        """
        raw = self.scratch.keep(self.docs.select("text").mapInArrow(_short_lists(self.size, self.num, self.den, self.paired, self.frequency), "gram long, cls long, n int, i int, paired boolean"), "short")
        lists = self.scratch.keep(raw.groupBy("gram").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high"), "lists")
        shared = raw.join(lists.select("gram", (F.col("m") > LONG_LIST).alias("long")), "gram").distinct()
        shared = self.scratch.keep(shared, "shared")
        self.scratch.drop("short", "lists")
        need = F.ceil(F.col("n") * self.num / self.den)
        two = F.least(F.col("n"), F.col("n") - need + 2)
        listed = (F.when(F.col("n") >= self.paired, F.least(F.col("n"), F.col("n") - need + _spare("n"))).otherwise(0)
                  + F.when(F.col("n") < _paired_below(self.num, self.den, self.paired), two * (two - 1) / 2).otherwise(0))
        each = shared.groupBy("cls").agg(F.sum((F.col("long") & ~F.col("paired")).cast("int")).cast("int").alias("cut"), F.count(F.lit(1)).alias("met"), F.max("n").alias("n"))
        each = self.scratch.keep(each.select("cls", "cut", (listed - F.col("met")).cast("int").alias("own")), "each")
        posts = shared.join(each, "cls").withColumn("needy", F.col("cut") >= F.floor(_spare("n") * self.num / self.den))
        self.lists = self.scratch.keep(posts.filter("not long or needy or paired").drop("long"), "postings")
        self.scratch.drop("shared", "each")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among candidate pairs (a, b); a is the query of b's block."""
        self.turn += 1
        name = f"turn{self.turn}"
        pairs = self.scratch.keep(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(self.classes, "cls").select("doc_id", "cls")
        texts = self.docs.join(ids.withColumnRenamed("doc_id", "__id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id"))).select("text", "cls")
        sets = self.scratch.keep(texts.mapInArrow(_sets(self.size), "cls long, grams array<long>"), f"{name}-sets")
        parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / PER_PART).cast("int").alias("parts"))
        salted = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.col("b").alias("cls"))
        heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).withColumn("cls", F.col("a"))
        rows = salted.union(heads).join(sets, "cls").select("a", "salt", "cls", "grams")
        rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("cls") != F.col("a"))
        links = self.scratch.keep(rows.mapInArrow(_search(self.num, self.den), "a long, b long").distinct(), f"{name}-links")
        self.scratch.drop(f"{name}-pairs", f"{name}-sets")
        return links

    def labelled(self, links: DataFrame, turn: int) -> DataFrame:
        """Postings with a label that only connected classes share."""
        posts = self.lists.join(low_labels(links).withColumnRenamed("node", "cls"), "cls", "left")
        return self.scratch.keep(posts.withColumn("comp", F.coalesce("comp", "cls")), f"posts{turn}")

    def close(self, a: str, b: str):
        return self.den * F.least(a, b) >= self.num * F.greatest(a, b)

    def alike(self):
        """Whether the bitmaps allow the required overlap.

        A gram that only one of two sets holds turns one bit of one bitmap, so at least as many grams differ as bits do; sets of n and
        n2 grams that need T in common differ in n + n2 - 2 T grams at most. Two turns of one bit only lower the count.
        """
        need = F.ceil(self.num * (F.col("n") + F.col("n2")) / (self.num + self.den))
        apart = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SIGNS])
        return apart <= F.col("n") + F.col("n2") - 2 * need

    def early(self):
        """Whether a meeting at places i and i2 counts for sets of n and n2 grams that need T in common.

        Of a pair with T common grams the first s, in the order of frequency, stand within n - T + s and n2 - T + s, as T - s others
        follow; s is 2 where grams are paired and else the smaller spare. Common grams come in one order in both sets, so no more than
        min(i, i2) reach up to this one and min(n - i, n2 - i2) follow. The lists are made for the smallest partner; here both sizes are known.
        """
        n, n2, i, i2 = (F.col(c) for c in ("n", "n2", "i", "i2"))
        need = F.ceil(self.num * (n + n2) / (self.num + self.den))
        first = F.when(F.col("paired"), 2).otherwise(F.least(_spare("n"), _spare("n2")))
        return (i <= n - need + first) & (i2 <= n2 - need + first) & (F.least(i, i2) + F.least(n - i, n2 - i2) >= need)


def _spare(n: str):
    return F.greatest(F.lit(1), F.floor(F.col(n) / SPARE))


def jaccard_links(join: Join) -> DataFrame:
    """Links whose groups are those of all links: (a, b) between classes of equal sets.

    Star rounds first tie every list's sets to one set of the list, which folds groups of near copies without
    forming their pairs. What then remains is every pair of sets of different groups that meet in enough
    lists; in each list only sets outside its largest group are paired with the others, and only those whose bitmaps
    allow a link.
    """
    posts, links, tried = join.lists.withColumn("comp", F.col("cls")), None, None
    for turn in range(STAR_ROUNDS):
        # first the set with the fewest lists of its own, which is the plainest of a group of copies; later any
        first = F.shiftleft(F.col("own").cast("long") if turn == 0 else F.lit(0).cast("long"), 40)
        pick = F.min_by("cls", first + F.pmod(F.xxhash64(F.lit(turn), "cls"), F.lit(1 << 40)))
        heads = posts.groupBy("gram").agg(pick.alias("a"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high")
        heads = heads if turn == 0 else heads.filter(F.col("m") > LONG_LIST)
        sizes = join.classes.select(F.col("cls").alias("a"), F.col("n").alias("an"))
        met = posts.join(heads.select("gram", "a"), "gram").filter("a <> cls").groupBy("a", "cls").agg(F.count(F.lit(1)).alias("occ"), F.max("n").alias("n"))
        # a star need not be complete: the promising half is tried, the rest is left to the last step
        met = met.join(sizes, "a").filter(join.close("n", "an") & (2 * F.col("occ") >= F.least(_spare("n"), _spare("an"))))
        pairs = met.select("a", F.col("cls").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = join.scratch.keep(pairs, f"tried{turn}")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        found = join.verify(pairs)
        links = found if links is None else links.union(found)
        posts = join.labelled(links, turn)
    groups = posts.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"))
    most = groups.groupBy("gram").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    left = join.scratch.keep(posts.join(most.select("gram", "main"), "gram").join(join.classes.select("cls", *SIGNS), "cls"), "left")
    ours = left.filter("comp <> main").select("gram", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "i", "cut", "needy", "comp", *SIGNS)])
    # sets that both have lists of single grams meet in those
    met = left.join(ours, "gram").filter((F.col("comp") != F.col("comp2")) & (~F.col("paired") | (F.least("n", "n2") < join.paired)) & ((F.col("comp") == F.col("main")) | (F.col("cls") < F.col("cls2"))) & join.close("n", "n2")
                                         & join.early() & join.alike())
    lost = F.when(F.col("paired") | (F.col("needy") & F.col("needy2")), 0).otherwise(F.least("cut", "cut2"))
    turned = F.col("cls") > F.col("cls2")
    met = met.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"), F.when(turned, F.col("n2")).otherwise(F.col("n")).alias("n"), F.when(turned, F.col("n")).otherwise(F.col("n2")).alias("n2"),
                     F.when(turned, F.col("i2")).otherwise(F.col("i")).alias("i"), F.when(turned, F.col("i")).otherwise(F.col("i2")).alias("i2"), lost.alias("lost"), "paired")
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("occ"), F.max("n").alias("n"), F.max("n2").alias("n2"), F.max("i").alias("i"), F.max("i2").alias("i2"), F.max("lost").alias("lost"), F.max("paired").alias("paired"))
    # what both sets have behind the last list they meet in bounds the overlap from above; k common grams make k - 1 or more pairs
    most = F.col("occ") + F.col("paired").cast("int") + F.col("lost") + F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    enough = (join.num + join.den) * most >= join.num * (F.col("n") + F.col("n2"))
    pairs = pairs.filter((F.col("paired") | (F.col("occ") >= F.least(_spare("n"), _spare("n2")) - F.col("lost"))) & enough).select("a", "b")
    if tried is not None:
        pairs = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    found = join.verify(pairs)
    return found if links is None else links.union(found)


def ngram_join(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, paired: int = PAIRED) -> DataFrame:
    """(doc_id, n_shingles, component_id): groups of documents linked by Jaccard similarity ``num`` / ``den`` of their word n-grams.

    Sets of fewer than ``paired`` grams are listed under pairs of grams (0: none is); the result is the same, the candidates differ.

    Documents with equal sets are one class from the start. Defined results: null or empty text and text
    without a word has an empty set and is linked with nothing; fewer words than ``size`` are one n-gram; repeated rows
    are rows of one class; rows without doc_id are linked like others but name no group (their component is null only
    where the whole group has no id); an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    join = Join(docs, size, num, den, paired)
    join.describe()
    join.index()
    links = join.scratch.keep(jaccard_links(join).distinct(), "links")
    groups = components(links.select(F.col("a").alias("src_account"), F.col("b").alias("dst_account"))).select(F.col("account_id").alias("cls"), "component")
    named = join.classes.select("cls", "doc_id").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = join.scratch.keep(named.join(lowest, "component").select("cls", "component_id"), "labels")
    full = join.members.filter("n > 0").join(labels, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(join.members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
