"""Exact order statistics and time-ordered scans that never put a whole group into one task.

A key may hold a third of all rows. So values are first counted (map-side combined), the
counts are range-partitioned by key and value, and only one summary row per key and
partition is ever put in sequence. Every key takes this way, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DAY_S = 86_400


def count_values(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (keys, value) with its multiplicity ``n``."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("long").alias("n"))


def _over(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _in_blocks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows, written, with the ``block`` they fall in when range-partitioned by keys and value.

    Blocks are of even size and in order, and their number follows the session's partition settings: a
    key with many values spans many blocks, many small keys share one.
    """
    spread = cut_lineage(counts).repartitionByRange(*keys, value)
    return cut_lineage(spread.withColumn("block", F.spark_partition_id()))


def _before(blocked: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, block) with ``__b_<measure>``, the sum over the key's earlier blocks, and ``__s_<measure>``, its own."""
    part = keys + ["block"]
    sums = blocked.groupBy(*part).agg(*[F.sum(m).alias(f"__s_{m}") for m in measures])
    # one row per key and partition it spans
    earlier = _over(keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*part, *[F.coalesce(F.sum(f"__s_{m}").over(earlier), F.lit(0)).alias(f"__b_{m}") for m in measures], *[f"__s_{m}" for m in measures])


def cumulative(counts: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """Running totals of ``measures`` over ``value`` within ``keys``, as ``cum_<measure>`` (inclusive).

    ``counts`` holds one row per (keys, value).
    """
    blocked, part = _in_blocks(counts, keys, value), keys + ["block"]
    inside = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = _before(blocked, keys, measures).drop(*[f"__s_{m}" for m in measures])
    return (blocked.join(sums, part).withColumns({f"cum_{m}": F.col(f"__b_{m}") + F.sum(m).over(inside) for m in measures})
            .drop("block", *[f"__b_{m}" for m in measures]))


def _values_at(counts: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """Value at 0-based ranks: keys, slot, at_rank. ``ranks``: keys, slot, rank."""
    blocked, part = _in_blocks(counts, keys, value), keys + ["block"]
    sizes = _before(blocked, keys, ["n"])
    lands = (F.col("rank") >= F.col("__b_n")) & (F.col("rank") < F.col("__b_n") + F.col("__s_n"))
    # a few ranks per key
    wanted = sizes.join(ranks, keys).filter(lands) if keys else sizes.join(F.broadcast(ranks), lands)
    wanted = wanted.select(*part, "slot", "rank", "__b_n")
    # only blocks that hold a wanted rank are put in order
    ends = (blocked.join(wanted.select(*part).distinct(), part, "left_semi")
            .withColumn("__in", F.sum("n").over(Window.partitionBy(*part).orderBy(value))))
    end = F.col("__b_n") + F.col("__in")
    return (ends.join(wanted, part).filter((F.col("rank") < end) & (F.col("rank") >= end - F.col("n")))
            .select(*keys, "slot", F.col(value).alias("at_rank")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    pick: str = "linear", weight: str | None = None) -> DataFrame:
    """Exact quantiles per key as array ``q``.

    ``pick='linear'`` interpolates; ``pick='index'`` returns sorted[min(n-1, floor(p*n))].
    Values are counted once and written out in blocks, so no buffer grows with a key.
    """
    rows = df.select(*keys, F.col(value).alias("__val"), *([F.col(weight).alias("__wt")] if weight else []))
    counts = cut_lineage(count_values(rows, keys, "__val", "__wt" if weight else None))
    return _picked(counts, keys, "__val", probs, pick)


def _picked(counts: DataFrame, keys: list[str], value: str, probs: list[float], pick: str) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__t")).filter(F.col("__t") > 0)
    slots = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("__t") - 1)
        low = F.least(F.col("__t") - 1, F.floor(F.lit(p) * F.col("__t"))) if pick == "index" else F.floor(pos)
        slots.append(F.struct(F.lit(2 * i).alias("slot"), low.cast("long").alias("rank")))
        if pick == "linear":
            slots.append(F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(pos).cast("long").alias("rank")))
    ranks = totals.select(*keys, "__t", F.explode(F.array(*slots)).alias("s")).select(*keys, "s.slot", "s.rank")
    found = _values_at(counts, keys, value, ranks)
    picked = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("at_rank").cast("double")))).alias("__v"))
    joined = picked.join(totals, keys) if keys else picked.filter(F.size("__v") > 0).withColumn("__t", totals.scalar())
    out = []
    for i, p in enumerate(probs):
        low = F.col("__v")[2 * i]
        pos = F.lit(p) * (F.col("__t") - 1)
        out.append(low if pick == "index" else low + (F.col("__v")[2 * i + 1] - low) * (pos - F.floor(pos)))
    return joined.select(*keys, F.array(*out).alias("q"))


def scalar_quantile(df: DataFrame, value: str, p: float, pick: str = "index") -> Column:
    """One number over the whole table as a scalar subquery."""
    return exact_quantiles(df, [], value, [p], pick).select(F.col("q")[0]).scalar()


def value_at_rank(df: DataFrame, value: str, rank: Column) -> Column:
    """The value at a 0-based rank over the whole table, as a scalar subquery; NULL when out of range.

    ``rank`` may use ``t``, the number of rows.
    """
    counts = cut_lineage(count_values(df.select(F.col(value).alias("__val")), [], "__val"))
    value = "__val"
    ranks = counts.groupBy().agg(F.sum("n").alias("t")).select(F.lit(0).alias("slot"), rank.cast("long").alias("rank"))
    return _values_at(counts, [], value, ranks).agg(F.max("at_rank")).scalar()


def forward_counts(df: DataFrame, keys: list[str], ts: str, width_s: int) -> DataFrame:
    """Per (keys, ts): ``n`` rows at that second and ``in_window`` rows in [ts, ts + width_s].

    Rows are counted per second first, then scanned in time blocks of ``width_s``: a scan
    never sees more than two blocks of distinct seconds of a key.
    """
    per_s = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col(ts) / width_s)
    spread = per_s.withColumn("__own", own).withColumn("__home", F.explode(F.array(own, own - 1)))
    w = Window.partitionBy(*keys, "__home").orderBy(ts).rangeBetween(0, width_s)
    return (spread.withColumn("in_window", F.sum("n").over(w))
            .filter(F.col("__home") == F.col("__own")).drop("__own", "__home"))


def previous_in_time(distinct_ts: DataFrame, keys: list[str], ts: str, out: str, block_s: int = DAY_S) -> DataFrame:
    """Adds the previous distinct ``ts`` of the same keys, scanning one time block at a time."""
    blocked = distinct_ts.withColumn("__b", F.floor(F.col(ts) / block_s))
    last = blocked.groupBy(*keys, "__b").agg(F.max(ts).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__b")
    carry = last.select(*keys, "__b", F.lag("__last").over(w).alias("__carry"))
    inside = Window.partitionBy(*keys, "__b").orderBy(ts)
    return (blocked.withColumn("__prev", F.lag(ts).over(inside)).join(carry, keys + ["__b"])
            .withColumn(out, F.coalesce("__prev", "__carry")).drop("__b", "__prev", "__carry"))


def next_event(marks: DataFrame, keys: list[str], ts: str, event: str, out: str, block_s: int = DAY_S) -> DataFrame:
    """Adds the first ``event`` time at or after ``ts``; ``event`` is a column holding the time or NULL.

    ``marks`` has one row per (keys, ts).
    """
    blocked = marks.withColumn("__b", F.floor(F.col(ts) / block_s))
    firsts = blocked.groupBy(*keys, "__b").agg(F.min(event).alias("__first"))
    # read backwards: a frame that only grows is linear, one that shrinks from the front is added up anew for every row
    later = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.select(*keys, "__b", F.last("__first", ignorenulls=True).over(later).alias("__carry"))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    return (blocked.withColumn("__in", F.last(event, ignorenulls=True).over(inside)).join(carry, keys + ["__b"])
            .withColumn(out, F.coalesce("__in", "__carry")).drop("__b", "__in", "__carry"))


def number_rows(df: DataFrame, order: str, out: str, start: Column | int = 1) -> DataFrame:
    """Consecutive numbers over a unique numeric column without a single global sort."""
    ones = df.select(order).withColumn("n", F.lit(1))
    numbers = cumulative(ones, [], order, ["n"]).select(order, (F.col("cum_n") - 1 + start).alias(out))
    return df.join(numbers, order)


def number_sorted(df: DataFrame, order: list[Column], out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in an order that may be over any columns, ties included: rows are range-sorted and written, and only the sizes
    of the sorted partitions are put in sequence."""
    place = F.monotonically_increasing_id()
    rows = cut_lineage(df.orderBy(*order).withColumn("__part", F.shiftright(place, 33)).withColumn("__in", place.bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per sorted partition
    return rows.join(F.broadcast(sizes.select("__part", before.alias("__b"))), "__part").withColumn(out, F.col("__b") + F.col("__in") + start).drop("__part", "__in", "__b")


def first_rows(df: DataFrame, keys: list[str], by: Column | str, keep: list[str], order: str = "min") -> DataFrame:
    """One row per key: the ``keep`` columns of the row with the smallest (or largest) ``by``. Combines map-side."""
    pick = F.min_by if order == "min" else F.max_by
    key = F.col(by) if isinstance(by, str) else by
    return df.groupBy(*keys).agg(pick(F.struct(*keep), key).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in keep])
