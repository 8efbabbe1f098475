"""Secret scan: Boolean trigram queries derived from the rules, a trigram index to intersect, and verification."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, as_text

#: kind -> (pattern, least length of the group that counts, that group); in the order that ties go by. Fixed values.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": (ASSIGN, 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    # a run shorter than the least length never holds a longer one, so the length can stand in the pattern
    "hex": (r"[0-9a-f]{24,}", 24, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 39, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 20, 0),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, 0),
}
BASE = ("assign", "access", "hex")
MOST_TEXTS = 64             # alternatives followed before a piece counts as unknown
MOST_TRIGRAMS = 4           # a conjunction keeps its first trigrams; fewer conditions only admit more candidates


def _strings(node) -> set[str] | None:
    """The lower-cased strings a single-width node can match, or None when there are too many."""
    op, arg = node
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN and arg[0][0] is not K.NEGATE:
        out: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                out.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _alternatives(seq) -> list[str]:
    """What a parsed pattern can match, lower-cased, with a gap (NUL) wherever the text is open."""
    alts = [""]
    for node in seq:
        op, arg = node
        if op is K.SUBPATTERN:
            pieces = _alternatives(arg[3])
        elif op is K.BRANCH:
            pieces = [p for branch in arg[1] for p in _alternatives(branch)]
        elif op is K.MAX_REPEAT and arg[0] == 0:
            pieces = ["", *_alternatives(arg[2])] if arg[1] == 1 else ["\0"]
        elif op is K.MAX_REPEAT:
            pieces = [p + "\0" for p in _alternatives(arg[2])]
        else:
            pieces = sorted(_strings(node) or {"\0"})
        pieces = list(dict.fromkeys(pieces))
        alts = [a + p for a in alts for p in pieces] if len(alts) * len(pieces) <= MOST_TEXTS else [a + "\0" for a in alts]
    return list(dict.fromkeys(alts))


def mandatory_runs(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern, each the literal runs (lower case) that every match of it contains."""
    return [[run for run in alt.split("\0") if run] for alt in _alternatives(_parser.parse(pattern))]


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of trigrams that every match implies; None when some alternative has none and must be scanned."""
    query = []
    for runs in mandatory_runs(pattern):
        grams = list(dict.fromkeys(run[i:i + 3] for run in runs for i in range(len(run) - 2)))[:MOST_TRIGRAMS]
        if not grams:
            return None
        if grams not in query:
            query.append(grams)
    # a conjunction that holds all trigrams of another adds no candidate
    return [c for c in query if not any(set(o) < set(c) for o in query)]


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, key) of the queries' trigrams; ``key`` is a hash of the text, so copies share postings.

    Two texts under one key only make candidates of each other: every candidate is verified.
    """
    low = docs.select(F.xxhash64("text").alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]], grams: list[str]) -> DataFrame:
    """(key, c_<rule>...): postings intersected per key as bits, 60 trigrams to a number."""
    parts = range(-(-len(grams) // 60))
    bits = [F.bit_or(F.when(F.floor(F.col("gram") / 60) == p, F.expr("shiftleft(1L, gram % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"b{p}") for p in parts]
    found = index.groupBy("key").agg(*bits)

    def every(conjunction: list[str]) -> Column:
        ids = [grams.index(g) for g in conjunction]
        test = F.lit(True)
        for p in parts:
            mask = sum(1 << (i % 60) for i in ids if i // 60 == p)
            test = test & (F.col(f"b{p}").bitwiseAND(F.lit(mask)) == mask) if mask else test
        return test

    def some(query: list[list[str]]) -> Column:
        test = F.lit(False)
        for conjunction in query:
            test = test | every(conjunction)
        return test

    flags = found.select("key", *[some(q).alias(f"c_{r}") for r, q in queries.items()])
    anything = F.lit(False)
    for r in queries:
        anything = anything | F.col(f"c_{r}")
    return flags.filter(anything)


def _spans(rule: str, when: Column) -> list[Column]:
    """Match texts, pieces between them and counted values of one rule, where ``when`` holds."""
    pattern, _, group = RULES[rule]
    wrapped, shift = (pattern, 0) if group else (f"({pattern})", 0)
    hit = when & F.col("text").rlike(pattern)
    none = F.array().cast("array<string>")
    return [F.when(hit, F.regexp_extract_all("text", F.lit(wrapped), 0)).otherwise(none).alias(f"m_{rule}"),
            F.when(hit, F.split("text", pattern, -1)).otherwise(none).alias(f"p_{rule}"),
            F.when(hit, F.regexp_extract_all("text", F.lit(wrapped), group + shift)).otherwise(none).alias(f"g_{rule}")]


def _placed(rule: str, rank: int) -> Column:
    """Array of (start, rank, kind, end) of the matches that are long enough, in code points."""
    m, p, g = f"m_{rule}", f"p_{rule}", f"g_{rule}"
    ends = (f"aggregate(sequence(1, size({m})), cast(array() as array<bigint>), (a, i) -> array_append(a, "
            f"coalesce(element_at(a, -1), 0L) + length({p}[i - 1]) + length({m}[i - 1])))")
    made = f"transform({ends}, (e, i) -> struct(e - length({m}[i]) as start, {rank} as rank, '{rule}' as kind, e as fin, length({g}[i]) as n))"
    empty = "cast(array() as array<struct<start: bigint, rank: int, kind: string, fin: bigint, n: int>>)"
    # element_at of an empty array is an error, so the first end is found apart
    made = made.replace("coalesce(element_at(a, -1), 0L)", "if(size(a) = 0, 0L, a[size(a) - 1])")
    return F.expr(f"if(size({m}) = 0, {empty}, filter({made}, x -> x.n >= {RULES[rule][1]}))")


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in whole texts: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    Rules whose every alternative has a trigram are looked up in a written index and verified on the
    candidates; the others (runs of hex digits) scan each text once. Positions come from the pieces
    between the matches, so everything stays in built-in functions.

    Defined results: null text is empty and has no spans; null and repeated doc_id are kept row by row; spans
    that start together go in the rules' order; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    queries = {r: trigram_query(p) for r, (p, _, _) in RULES.items()}
    known = {r: q for r, q in queries.items() if q}
    grams = sorted({g for q in known.values() for c in q for g in c})
    rows = docs.select("doc_id", as_text().alias("text"))
    index = scratch.keep(trigram_index(rows, grams), "index")
    found = scratch.keep(candidates(index, known, grams), "candidates")
    joined = rows.withColumn("key", F.xxhash64("text")).join(found, "key", "left")
    tried = {r: F.coalesce(f"c_{r}", F.lit(False)) if r in known else F.lit(True) for r in RULES}
    cut = joined.select("doc_id", *[c for r in RULES for c in _spans(r, tried[r])])
    cut = cut.select("doc_id", *[_placed(r, i).alias(r) for i, r in enumerate(RULES)])
    joined_up = lambda names: F.array_join(F.transform(F.sort_array(F.concat(*names)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["fin"].cast("string"))), ",")
    return cut.select("doc_id", *[F.size(r).cast("long").alias(f"n_{r}") for r in BASE],
                      F.sha2(joined_up(BASE), 256).alias("base_sha256"), joined_up(RULES).alias("spans"))


def scan_sql() -> str:
    """The same in DuckDB by scanning every text with every rule."""
    parts = []
    for i, (rule, (pattern, least, group)) in enumerate(RULES.items()):
        quoted = pattern.replace("'", "''")
        outer = f"({quoted})" if not group else quoted
        parts.append(f"select rid, '{rule}' as kind, {i} as rnk, {least} as least, regexp_extract_all(text, '{outer}', 0) as m, "
                     f"regexp_extract_all(text, '{outer}', {group}) as g, string_split_regex(text, '{re.sub(r'\((?=\[Pp\])', '(?:', quoted).replace('([A-Za-z0-9+/_.=-]+)', '[A-Za-z0-9+/_.=-]+')}') as p from d where regexp_matches(text, '{quoted}')")
    one = lambda which: f"string_agg(kind || ':' || s || ':' || e, ',' order by s, rnk){which}"
    base = "rnk < 3"
    return f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
hits as ({" union all ".join(parts)}),
placed as (select rid, kind, rnk, least, length(g[i]) as n, e - length(m[i]) as s, e from (
  select rid, kind, rnk, least, m, g, unnest(range(1, len(m) + 1)) as i,
    unnest(list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x)))))::bigint as e from hits)),
good as (select * from placed where n >= least),
agg as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
  count(*) filter (where kind = 'hex') as n_hex, {one(f" filter (where {base})")} as base, {one("")} as spans from good group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join agg using (rid)"""
