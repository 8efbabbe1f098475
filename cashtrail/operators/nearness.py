"""Which asked pairs of accounts are at most three links apart, without writing any neighbourhood out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .packed import Accounts, Lists, Packed, spans, whole_in_each

#: links and asked pairs that one task of the grid holds, about
LINKS_A_TASK, PAIRS_A_TASK = 2_000_000, 1_000_000
#: cells of the reach table that a task has open at a time, and links it follows in one go
CELLS, FOLLOWED = 1 << 22, 1 << 18


def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``values`` in the sorted ``known`` (not empty), and which of them are there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def _follow(owner: np.ndarray, node: np.ndarray, start: np.ndarray, ends: np.ndarray):
    """(owner, end) of every link that leaves the nodes, in slices of about FOLLOWED links."""
    sizes = start[node + 1] - start[node]
    total = np.cumsum(sizes)
    first = 0
    while first < len(node):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + FOLLOWED, "right")))
        n = sizes[first:last]
        at = np.repeat(start[node[first:last]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.repeat(owner[first:last], n), ends[at]
        first = last


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """The asked pairs whose closed neighbourhoods of one and two links share an account of this range.

    ``left``: links (u = b, v) of the asked b and the asks (u = b, v = a); ``right``: all links that end in the range.
    """
    ask, u, v = (left[c].to_numpy() for c in ("ask", "u", "v"))
    ask_b, ask_a = u[ask], v[ask]
    if not len(ask_b) or not right.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    source, target = right["u"].to_numpy(), right["v"].to_numpy()
    order = np.argsort(source, kind="stable")
    nodes, start = np.unique(source[order], return_index=True)
    start = np.append(start, len(source))
    spots, ends = np.unique(target[order], return_inverse=True)
    users = np.unique(ask_b)
    order = np.argsort(ask_b, kind="stable")
    ask_b, ask_a = ask_b[order], ask_a[order]
    ask_row = np.searchsorted(users, ask_b)
    link_row, linked = _find(users, u[~ask])
    link_row, link_to = link_row[linked], v[~ask][linked]
    order = np.argsort(link_row, kind="stable")
    link_row, link_to = link_row[order], link_to[order]
    found = np.zeros(len(ask_b), bool)
    height = max(1, CELLS // len(spots))
    for low in range(0, len(users), height):
        high = min(low + height, len(users))
        reach = np.zeros((high - low) * len(spots), bool)
        near = slice(*np.searchsorted(link_row, (low, high)))
        row = np.append(link_row[near], np.arange(low, high)) - low
        to = np.append(link_to[near], users[low:high])  # one link away, and itself
        at, there = _find(spots, to)
        reach[row[there] * len(spots) + at[there]] = True
        at, there = _find(nodes, to)
        for owner, end in _follow(row[there], at[there], start, ends):
            reach[owner * len(spots) + end] = True
        asks = np.arange(*np.searchsorted(ask_row, (low, high)))
        row, to = ask_row[asks] - low, ask_a[asks]
        at, there = _find(spots, to)
        found[asks[there]] = reach[row[there] * len(spots) + at[there]]
        at, there = _find(nodes, to)
        there &= ~found[asks]
        for owner, end in _follow(asks[there], at[there], start, ends):
            found[owner[reach[(ask_row[owner] - low) * len(spots) + end]]] = True
    return pa.table({"a": ask_a[found], "b": ask_b[found]})


def within_three(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The distinct (a, b) of ``pairs`` that are equal or at most three links apart.

    ``links``: distinct (a, b); a way from a to b is a - x - y - b with (b, y), (y, x) and (a, x) among the links, each of which may be
    left out. Work is dealt over a grid: rows are groups of b with their links and asks, columns are ranges of x with the
    links that end there. A task holds one row's and one column's share, whose size is fixed, and opens two-link reaches of
    a few b at a time; none leaves the task. Ids that are no whole numbers are numbered first.
    """
    pairs = pairs.select("a", "b").filter("a is not null and b is not null").distinct()
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for df in (pairs, links) for c in "ab")
    if not whole:
        ids = [df.select(F.col(c).alias("id")) for df in (pairs, links) for c in "ab"]
        ids = cut_lineage(ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct().withColumn("no", F.monotonically_increasing_id()))

        def numbered(df):
            for c in "ab":
                df = df.join(ids.select(F.col("id").alias(c), F.col("no").alias(f"no_{c}")), c)
            return df.select(F.col("no_a").alias("a"), F.col("no_b").alias("b"))

        pairs, links = numbered(pairs), numbered(links)
    pairs, links = (cut_lineage(df.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))) for df in (pairs, links))
    n_pairs, n_links = (df.agg(F.count(F.lit(1))).head()[0] for df in (pairs, links))
    tasks = pairs.sparkSession.sparkContext.defaultParallelism
    columns = max(1, math.ceil(n_links / LINKS_A_TASK))
    rows = max(math.ceil(n_links / LINKS_A_TASK), math.ceil(n_pairs / PAIRS_A_TASK), math.ceil(2 * tasks / columns))

    def dealt(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n))

    every_row, every_column = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (rows, columns))
    users = pairs.select(F.col("b").alias("a")).distinct()
    asks = pairs.select(F.lit(True).alias("ask"), F.col("b").alias("u"), F.col("a").alias("v"))
    steps = links.join(users, "a", "left_semi").select(F.lit(False).alias("ask"), F.col("a").alias("u"), F.col("b").alias("v"))
    left = asks.unionByName(steps).select("ask", "u", "v", dealt("u", rows).alias("r"), every_column.alias("c"))
    right = links.select(F.col("a").alias("u"), F.col("b").alias("v"), every_row.alias("r"), dealt("b", columns).alias("c"))
    left, right = (df.withColumn("cell", (F.col("r") * columns + F.col("c")).cast("long")).drop("r", "c") for df in (left, right))
    cells = rows * columns
    left, right = (df.repartition(cells, "cell") for df in (left, right))
    met = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_meet, "a long, b long")
    near = cut_lineage(met.distinct().unionByName(pairs.filter("a = b")).distinct())
    if whole:
        return near
    for c in "ab":
        near = near.join(ids.select(F.col("no").alias(c), F.col("id").alias(f"id_{c}")), c)
    return near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


#: asked rows of one task that sums crews, about
ASKED_A_TASK = 4_000_000


def _sum_crews(n: int, before: dict[int, int], size: int):
    """The work of a task of ``crew_sums``."""
    def work(batches):
        lists, kept = Lists(n, before, size), []
        for batch in batches:
            listed = batch.column("part").is_valid()
            lists.take(batch.filter(listed))
            rows = batch.filter(pa.compute.invert(listed))
            if rows.num_rows:
                kept.append([rows.column("account").to_numpy(), rows.column("machine").to_numpy(), rows.column("n").fill_null(0).to_numpy(), rows.column("n").is_valid().to_numpy(zero_copy_only=False)])
        lists.close()
        if not kept:
            return
        account, machine, times, past = (np.concatenate([k[i] for k in kept]) for i in range(4))
        kept.clear()
        order = np.lexsort((account[past], machine[past]))
        users, weight, at = account[past][order], times[past][order], machine[past][order]
        machines, first = np.unique(at, return_index=True)
        first = np.append(first, len(at))
        asks = np.unique(np.stack([account[~past].astype(np.int64), machine[~past].astype(np.int64)], axis=1), axis=0)
        del account, machine, times, past, order, at
        if not len(asks) or not len(machines):
            return
        where, there = _find(machines, asks[:, 1])
        asks, where = asks[there], where[there]
        people, begin = np.unique(asks[:, 0], return_index=True)
        begin = np.append(begin, len(asks))
        s, start, degree = lists.s, lists.start, lists.degree
        near, out = np.zeros(size + 1, bool), []

        def ends(nodes):
            """Neighbours of the nodes, in slices of about FOLLOWED links, and how far the nodes are done."""
            total, low = np.cumsum(degree[nodes]), 0
            while low < len(nodes):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + FOLLOWED, "right")))
                yield low, high, s[spans(start[nodes[low:high]], degree[nodes[low:high]])]
                low = high

        for i, a in enumerate(people.tolist()):
            mine = where[begin[i]:begin[i + 1]]
            size_of = first[mine + 1] - first[mine]
            at = spans(first[mine], size_of)
            b = users[at]
            around = s[start[a]:start[a + 1]]
            touched = [np.append(around, a)]
            near[touched[0]] = True
            for _, _, z in ends(around):
                near[z] = True
                touched.append(z)
            found = near[b]
            open_ = np.flatnonzero(~found)
            links = int(degree[b[open_]].sum())
            if links > 4 * len(s):
                # many past users: the third step is taken once, and each user looked up
                second = np.unique(np.concatenate(touched))
                for _, _, z in ends(second):
                    near[z] = True
                found = near[b]
                near[:] = False
            else:
                for low, high, z in ends(b[open_]):
                    hit, sizes = near[z], degree[b[open_[low:high]]]
                    some = np.flatnonzero(sizes)
                    if len(some):
                        found[open_[low:high][some]] = np.logical_or.reduceat(hit, (np.cumsum(sizes) - sizes)[some])
                for z in touched:
                    near[z] = False
            lead = np.cumsum(size_of) - size_of
            got, hits = np.add.reduceat(np.where(found, weight[at], 0), lead), np.flatnonzero(np.logical_or.reduceat(found, lead))
            if len(hits):
                out.append((np.full(len(hits), a, np.int32), asks[begin[i]:begin[i + 1], 1][hits], got[hits]))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], ["account", "machine", "crew_prior"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], ["account", "machine", "crew_prior"])

    return work


def crew_sums(targets: DataFrame, past: DataFrame, links: Packed, accounts: Accounts) -> DataFrame:
    """(account_id, atm_id, crew_prior): per row of ``targets`` the sum of n over the past users of the machine at most three links from the account.

    ``targets``: (account, machine) and ``past``: (account, machine, n) by number, ``links``: both ways. A task takes a share of the accounts and reads all
    links and past users; marks of the two-link surroundings of one account are open at a time, so neither pairs nor surroundings are written.
    """
    tasks = targets.sparkSession.sparkContext.defaultParallelism
    n_asked = targets.agg(F.count(F.lit(1))).head()[0]
    tasks = max(min(2 * tasks, math.ceil(n_asked / 100_000)), math.ceil(n_asked / ASKED_A_TASK), 1)
    share = F.pmod(F.xxhash64("account"), F.lit(tasks)).cast("int")
    own = targets.select(share.alias("task"), "account", "machine", F.lit(None).cast("long").alias("n")).unionByName(past.select(F.lit(-1).alias("task"), "account", "machine", F.col("n").cast("long")))
    return whole_in_each(tasks, links, cut_lineage(own, "task"), _sum_crews(links.n, links.before, accounts.size), "account int, machine long, crew_prior long")
