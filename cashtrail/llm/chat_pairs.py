"""Preference formatting: the shared opening of two conversations once as prompt, then two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

TAIL = "<|end|>\n"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns in order of turn, role, text; null role and text become empty."""
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text")


def opening_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): of conversations with an equal first turn the smallest id is chosen, each other one rejected.

    One pair per further conversation, never all pairs; the smallest id of an opening is a map-side minimum.
    """
    first = turns.filter("pos = 1").select("conv_id", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("opening"))
    lead = first.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return first.join(lead, "opening").filter("conv_id <> chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(TAIL))


def retakes(turns: DataFrame) -> DataFrame:
    """Every conversation once more with its last assistant turn replaced by the assistant's reply before it (empty if none).

    A stale reply is the rejected side of a conversation that has no other take. Conversations without an assistant turn have none.
    """
    said = turns.filter("role = 'assistant'")
    last = said.groupBy("conv_id").agg(F.max("pos").alias("last"))
    before = said.join(last, "conv_id").filter("pos < last").groupBy("conv_id").agg(F.max_by("text", "pos").alias("stale"))
    swap = last.join(before, "conv_id", "left").select("conv_id", "last", F.coalesce("stale", F.lit("")).alias("stale"))
    return turns.join(swap, "conv_id").select("conv_id", "pos", "role", F.when(F.col("pos") == F.col("last"), F.col("stale")).otherwise(F.col("text")).alias("text"))


def preference_segments(chosen: DataFrame, rejected: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered segments of every pair: (chosen_id, rejected_id, part, pos, role, segment, train_start, train_end).

    ``chosen`` and ``rejected`` hold numbered turns, ``pairs`` names a conversation of each. ``part`` is prompt (the longest
    common prefix of turns, once), chosen or rejected (what follows it). Only assistant turns of the completions are
    trained on: ``train_start``/``train_end`` are code-point positions in the segment over its text and end mark; elsewhere
    both are null. A conversation is never gathered into one value, so one that holds a third of all turns is still only rows.
    """
    theirs = pairs.join(rejected.withColumnRenamed("conv_id", "rejected_id"), "rejected_id")
    lead = chosen.join(pairs.select(F.col("chosen_id").alias("conv_id")).distinct(), "conv_id", "left_semi")
    against = lead.select(F.col("conv_id").alias("chosen_id"), "pos", F.col("role").alias("c_role"), F.col("text").alias("c_text"))
    # the first turn that differs from the chosen side, or lies beyond it
    differs = theirs.join(against, ["chosen_id", "pos"], "left").filter("not (role <=> c_role and text <=> c_text)")
    first = differs.groupBy("chosen_id", "rejected_id").agg(F.min("pos").alias("differs_at"))
    length = theirs.groupBy("chosen_id", "rejected_id").agg(F.max("pos").alias("last"))
    shared = (length.join(first, ["chosen_id", "rejected_id"], "left")
              .select("chosen_id", "rejected_id", (F.coalesce("differs_at", F.col("last") + 1) - 1).alias("shared")))
    ours = shared.join(chosen.withColumnRenamed("conv_id", "chosen_id"), "chosen_id").withColumn("part", F.when(F.col("pos") <= F.col("shared"), "prompt").otherwise("chosen"))
    theirs = theirs.join(shared, ["chosen_id", "rejected_id"]).filter("pos > shared").withColumn("part", F.lit("rejected"))
    names = ["chosen_id", "rejected_id", "part", "pos", "role", "text"]
    rows = ours.select(*names).unionByName(theirs.select(*names))
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    begin = F.length("role") + 5
    return rows.select("chosen_id", "rejected_id", "part", F.col("pos").cast("long").alias("pos"), "role", _rendered(F.col("role"), F.col("text")).alias("segment"),
                       F.when(trained, begin.cast("long")).alias("train_start"),
                       F.when(trained, (begin + F.length("text") + len(TAIL)).cast("long")).alias("train_end"))


def preferences(conversations: DataFrame) -> DataFrame:
    """Segments of all conversations that share an opening, and of the others against their retake (chosen_id = rejected_id).

    Defined results: turns without conv_id belong to no conversation; repeated turn numbers are ordered by role
    and text; null role or text is empty; a conversation that shares no opening and has no assistant turn makes no pair; equal
    sides have only a prompt; an empty table gives an empty result; columns beyond conv_id, turn, role and text are not read.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.keep(numbered_turns(conversations), "turns")
    pairs = scratch.keep(opening_pairs(turns), "pairs")
    taken = pairs.select(F.col("chosen_id").alias("conv_id")).union(pairs.select("rejected_id")).distinct()
    alone = scratch.keep(retakes(turns.join(taken, "conv_id", "left_anti")), "retakes")
    single = alone.select(F.col("conv_id").alias("chosen_id")).distinct().withColumn("rejected_id", F.col("chosen_id"))
    return preference_segments(turns, turns, pairs).unionByName(preference_segments(turns, alone, single))


def preferences_sql() -> str:
    return """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls last, coalesce(role, ''), coalesce(text, '')) as pos,
  coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
f as (select conv_id, min(conv_id) over (partition by role, text) as chosen_id from t where pos = 1),
p as (select chosen_id, conv_id as rejected_id from f where conv_id <> chosen_id),
z as (select conv_id, max(pos) as lastpos from t where role = 'assistant' and conv_id not in (select chosen_id from p union all select rejected_id from p) group by conv_id),
w as (select z.*, coalesce((select arg_max(text, pos) from t where t.conv_id = z.conv_id and role = 'assistant' and pos < lastpos), '') as stale from z),
alt as (select false as re, conv_id, pos, role, text from t union all
  select true, t.conv_id, pos, role, case when pos = lastpos then stale else text end from t join w using (conv_id)),
pp as (select false as re, * from p union all select true, conv_id, conv_id from z),
l as (select pp.*, coalesce((select min(r.pos) from alt r left join t c on c.conv_id = pp.chosen_id and c.pos = r.pos
  where r.re = pp.re and r.conv_id = pp.rejected_id and (c.pos is null or c.role <> r.role or c.text <> r.text)),
  (select max(pos) + 1 from alt r where r.re = pp.re and r.conv_id = pp.rejected_id)) - 1 as shared from pp),
s as (select chosen_id, rejected_id, case when pos <= shared then 'prompt' else 'chosen' end as part, pos, role, text from l join t on conv_id = chosen_id
  union all select chosen_id, rejected_id, 'rejected', pos, role, text from l join alt on l.re = alt.re and conv_id = rejected_id where pos > shared)
select chosen_id, rejected_id, part, pos::bigint as pos, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as segment,
  case when part <> 'prompt' and role = 'assistant' then length(role) + 5 end::bigint as train_start,
  case when part <> 'prompt' and role = 'assistant' then length(role) + 5 + length(text) + 8 end::bigint as train_end from s"""
