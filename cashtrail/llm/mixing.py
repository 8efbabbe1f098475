"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, Scratch, as_text, ranked

MAX_REPEAT = 3
BLOCK_TOKENS = 32
SHARDS = 8
SEED = "mix-1"
#: primes of which the seed picks one per source as step of the block order; each is coprime to every smaller block count
PRIMES = tuple((1 << n) - d for n, d in ((61, 1), (60, 93), (59, 55), (58, 27), (57, 13), (56, 5), (55, 55), (54, 33)))


def token_count(text: str = "text") -> Column:
    return F.regexp_count(as_text(text), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, scratch: Scratch, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, source, source_size, weight, cap, target): shares by weight, none above ``max_repeat`` times its size.

    The excess of capped sources is reshared in rounds; a round is one small aggregate of which
    only four sums reach the driver, and it ends when no further source is above its cap.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = ranked(sizes, [F.col("source").asc_nulls_last()], "src", scratch, "sources")
    table = numbered.withColumn("weight", (F.col("src") % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    total = table.agg(F.sum("source_size")).head()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        fixed, free, n = table.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))),
                                   F.sum(above.cast("long"))).head()
        if n is None or n == capped or not free:
            break
        capped, level = n, (total - fixed) / free
    return table.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), F.col("cap").cast("double")))


def shard_seats(targets: DataFrame, total: int, block_tokens: int, shards: int = SHARDS) -> DataFrame:
    """(src, shard, seats): blocks of a source in shards 1..shard together, by highest quotients target / (2 s + 1).

    House sizes grow with the shard, and the method never takes a seat back as the house grows, so a
    shard's quota is the difference to the shard before. Only the seats that a divisor bound leaves
    open (at most two per source and shard) are ranked; ties go to the earlier source.
    """
    house = F.floor(F.lit(total // block_tokens) * F.col("shard") / F.lit(shards))
    rows = (targets.select("src", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard"))
            .withColumn("h", house.cast("long")))
    whole = targets.agg(F.sum("target").alias("t"), F.count(F.lit(1)).alias("n")).head()
    t, n = float(whole["t"] or 0.0), int(whole["n"])
    won = lambda twice: F.floor((F.col("target") * twice / F.lit(t) + 1) / 2).cast("long")
    if t == 0.0:
        return rows.select("src", "shard", F.lit(0).cast("long").alias("seats"))
    rows = (rows.withColumn("sure", F.when(2 * F.col("h") - n > 0, won((2 * F.col("h") - n).cast("double"))).otherwise(F.lit(0).cast("long")))
            .withColumn("most", won((2 * F.col("h") + n).cast("double"))))
    rest = rows.groupBy("shard").agg((F.max("h") - F.sum("sure")).alias("open"))
    open_seats = (rows.filter("most > sure").select("src", "shard", "target", F.explode(F.sequence("sure", F.col("most") - 1)).alias("s"))
                  .withColumn("quotient", F.col("target") / (2 * F.col("s") + 1)))
    order = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), F.col("src"))
    taken = (open_seats.withColumn("place", F.row_number().over(order)).join(rest, "shard").filter("place <= open")
             .groupBy("src", "shard").agg(F.count(F.lit(1)).alias("more")))
    return rows.join(taken, ["src", "shard"], "left").select("src", "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))


def block_order(seed: str) -> tuple[int, int]:
    """(first prime, offset) of a seed's block permutations, both from its CRC-32."""
    drawn = zlib.crc32(seed.encode())
    return drawn % len(PRIMES), drawn // len(PRIMES)


def mix(docs: DataFrame, seed: str = SEED, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """How many words of every document each shard of a mix of ``sources`` by weights 1, 2, 3, 1, ... takes.

    A source's documents stand in seeded hash order and are cut into blocks of ``block_tokens`` words. Its seats in shard 1,
    in shard 2 and so on go through the blocks in a seeded permutation ((step * block + offset) modulo the number of blocks)
    and begin again when every block was taken, so a shard's integer quota picks blocks that the shards before it left, and
    a block is in the mix floor or ceil of seats / blocks times. ``shard_words`` holds the words per shard, ``taken`` their
    sum. Running totals are taken per (source, hash bucket) and stitched with one row per bucket, so a source with a
    third of all rows is spread over 4096 windows.

    Defined results: null text has size 0; a null source is a source of its own, last in order; null
    doc_id is kept as null; repeated rows are rows of their own; a document of size 0 has taken 0; an
    empty table gives an empty result. Only doc_id, text and source are read, other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(as_text())))
    sized = scratch.keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), token_count().alias("size"), key.alias("h")), "sized")
    targets = scratch.keep(source_targets(sized, scratch, max_repeat), "targets")
    total = int(targets.agg(F.sum("source_size")).head()[0] or 0)
    first, offset = block_order(seed)
    steps = F.array(*[F.lit(p) for p in PRIMES])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_tokens)).cast("long")
    # seats of shards 1..shard together, one entry per shard, of a source; a house never takes a seat back
    quotas = (shard_seats(targets, total, block_tokens, shards).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("shard", "seats"))).alias("q"))
              .select("src", F.col("q.seats").alias("seats")))
    plan = (targets.withColumn("blocks", blocks).join(quotas, "src")
            .select(F.col("source").alias("__source"), "src", "source_size", "target", "blocks",
                    F.transform("seats", lambda s: F.least(s, F.col("blocks") * max_repeat)).alias("seats"),
                    (F.get(steps, ((F.col("src") + first) % len(PRIMES)).cast("int")) % F.col("blocks")).alias("step")))
    plan = scratch.keep(plan, "plan")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn("bucket", F.substring("h", 1, 3))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (rows.withColumn("end", F.sum("size").over(inside)).join(starts, ["src", "bucket"])
          .withColumn("end", F.col("end") + F.col("start")).withColumn("begin", F.col("end") - F.col("size")))
    # a block's place in the permutation, in decimals: step * block may pass 2^63
    place = f"cast((cast(step as decimal(19,0)) * cast(b as decimal(18,0)) + {offset}) % blocks as bigint)"
    overlap = f"least(end, (b + 1) * {block_tokens}) - greatest(begin, b * {block_tokens})"
    parts = F.expr(f"if(size = 0, cast(array() as array<struct<r: bigint, o: bigint>>), "
                   f"transform(sequence(begin div {block_tokens}, (end - 1) div {block_tokens}), b -> struct({place} as r, {overlap} as o)))")
    # of the first s seats, those on a block of place r are (s - r + blocks - 1) div blocks
    upto = F.expr("transform(seats, s -> aggregate(parts, 0L, (a, x) -> a + x.o * ((s - x.r + blocks - 1) div blocks)))")
    each = F.expr("transform(upto, (x, i) -> x - if(i = 0, 0L, get(upto, i - 1)))")
    return (at.withColumn("parts", parts).withColumn("upto", upto)
            .select("doc_id", "size", "source_size", "target", F.element_at("upto", -1).alias("taken"), each.alias("shard_words")))


def mix_sql(seed: str = SEED, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, max_repeat: int = MAX_REPEAT) -> str:
    """The same for DuckDB, shards joined by commas: caps found in order of cap / weight, seats by ranking every quotient."""
    first, offset = block_order(seed)
    return rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
         md5('{seed}|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as src from sized group by source),
w as (select *, src % 3 + 1 as weight, source_size * {max_repeat} as cap from s),
r as (select *, ((select sum(source_size) from s) - coalesce(sum(cap) over o, 0))::double
        / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as lvl
      from w window o as (order by cap / weight, src rows between unbounded preceding and 1 preceding)),
l as (select coalesce(arg_min(lvl, cap / weight) filter (where cap >= weight * lvl), 0) as lvl from r),
t as (select w.*, least(weight * l.lvl, cap::double) as target from w, l),
q as (select src, row_number() over (order by target / (2 * n + 1) desc, src) as place
      from (select src, target, unnest(range(0, (target / {block_tokens})::bigint + 3)) as n from t)),
hs as (select shard, ((select sum(source_size) from s) // {block_tokens} * shard // {shards})::bigint as house from range(1, {shards} + 1) x(shard)),
won as (select t.src, hs.shard, count(q.place) as seats from t cross join hs left join q on q.src = t.src and q.place <= hs.house group by all),
seats as (select src, list(least(seats, greatest(1, ceil(source_size / {block_tokens}.0))::bigint * {max_repeat})::bigint order by shard) as seats
          from won join t using (src) group by src),
p as (select t.*, greatest(1, ceil(source_size / {block_tokens}.0))::bigint as blocks, seats from t join seats using (src)),
pl as (select *, {list(PRIMES)}[(src + {first}) % {len(PRIMES)} + 1] % blocks as step from p),
placed as (select z.*, pl.* exclude (source), sum(size) over (partition by src order by h, size rows unbounded preceding)::bigint as fin
       from sized z join pl on z.source is not distinct from pl.source),
cut as (select *, case when size = 0 then [] else list_transform(range((fin - size) // {block_tokens}, (fin - 1) // {block_tokens} + 1),
    lambda k: {{'r': ((step::hugeint * k + {offset}) % blocks)::bigint, 'o': least(fin, (k + 1) * {block_tokens}) - greatest(fin - size, k * {block_tokens})}}) end as parts from placed),
sofar as (select *, list_transform(seats, lambda s: coalesce(list_sum(list_transform(parts, lambda x: x.o * ((s - x.r + blocks - 1) // blocks))), 0)::bigint) as upto from cut)
select doc_id, size, source_size, target, upto[{shards}] as taken,
  array_to_string(list_transform(range(1, {shards} + 1), lambda i: upto[i] - case when i = 1 then 0 else upto[i - 1] end), ',') as shard_words
from sofar"""
