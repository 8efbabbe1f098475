"""Host-level quality rules: failure rates by domain, shrunk towards a beta prior, joined back to documents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, Scratch, as_text

SYMBOLS = "#*$%&|<>"
TIMES = 2.0            # a refused host's odds of failing a rule, as a multiple of the average host's
LEAST_RATE = 0.25      # no host goes for a rule that fewer of its documents fail
CERTAIN = 1.645        # standard deviations below the mean: the lower 5 % bound of a normal posterior
#: rule -> (Spark and DuckDB condition over the base columns)
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def _statistics(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """The base columns. Windows and positions stay in the document's own row, as hashed 64-bit numbers."""
    text = as_text()
    step = docs.select(*carry, text.alias("__text"))
    step = step.select("*", F.regexp_extract_all("__text", F.lit(f"({WORD})"), 1).alias("__words"),
                       F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)).alias("__lines"))
    windows = F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))")
    step = step.select("*", windows.alias("__w"))
    step = step.select("*", (F.size("__w") > F.size(F.array_distinct("__w"))).alias("__again"))
    ordered = F.expr("if(__again, sort_array(transform(__w, (h, i) -> struct(h as h, i as i))), cast(null as array<struct<h: bigint, i: int>>))")
    step = step.select("*", ordered.alias("__o")).drop("__w")
    twice = F.expr("filter(transform(__o, (x, k) -> if(x.h = get(__o, k - 1).h or x.h = get(__o, k + 1).h, x.i, cast(null as int))), p -> p is not null)")
    step = step.select("*", twice.alias("__twice")).drop("__o")
    covered = F.expr("if(__again, size(array_distinct(flatten(transform(__twice, p -> array(p, p + 1, p + 2))))), 0)")
    in_words = F.length(F.translate("__text", " \t\n\x0b\x0c\r", ""))
    return step.select(
        *[c for c in step.columns if not c.startswith("__") or c == "__host"],
        F.size("__words").cast("long").alias("n_words"), in_words.cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"))


def host_rates(stats: DataFrame) -> DataFrame:
    """One row per host: documents and, per rule, the mean of the hosts' rates (``m_``), the failure rate shrunk
    with an empirical beta prior (``rate_``) and the lower 5 % bound of its posterior (``low_``).

    The prior of a rule has the mean of the hosts' rates, every host counted once, so that a host with most of the rows is no
    norm for itself; its strength comes from the spread of the host rates beyond what sampling explains (method of
    moments), held between 2 and 1,000,000. The bound is
    that of the normal distribution with the posterior's mean and deviation.
    """
    fails = [F.sum(F.expr(f"if({rule}, 1L, 0L)")).alias(f"k_{name}") for name, rule in RULES.items()]
    hosts = stats.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), *fails)
    means = hosts.agg(*[F.avg(F.col(f"k_{r}") / F.col("n")).alias(f"m_{r}") for r in RULES], F.avg(1 / F.col("n")).alias("inv"))
    joined = hosts.join(F.broadcast(means))  # one row
    spread = joined.agg(*[F.avg(F.pow(F.col(f"k_{r}") / F.col("n") - F.col(f"m_{r}"), 2)).alias(f"v_{r}") for r in RULES])
    joined = joined.join(F.broadcast(spread))  # one row
    for r in RULES:
        m = F.col(f"m_{r}")
        excess = F.greatest(F.col(f"v_{r}") - m * (1 - m) * F.col("inv"), F.lit(1e-12))
        strength = F.least(F.greatest(m * (1 - m) / excess - 1, F.lit(2.0)), F.lit(1e6))
        joined = joined.withColumn("__s", strength).withColumn(f"rate_{r}", (F.col(f"k_{r}") + m * F.col("__s")) / (F.col("n") + F.col("__s")))
        deviation = F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (F.col("n") + F.col("__s") + 1))
        joined = joined.withColumn(f"low_{r}", F.col(f"rate_{r}") - F.lit(CERTAIN) * deviation)
    return joined.select("__host", "n", *[f"{kind}_{r}" for r in RULES for kind in ("m", "rate", "low")])


def host_rules(docs: DataFrame, host: str = "source", times: float = TIMES, least: float = LEAST_RATE) -> DataFrame:
    """Base statistics of every document, its own verdict and its host's: (doc_id, ..., base_failed, kept).

    Rule by rule a host is judged by its posterior against the prior: it is refused when the lower 5 % bound of its
    failure rate is over ``least`` and the odds of that bound are over ``times`` those of the prior mean. Where most hosts
    fail a rule alike (a script without spaces, say) that rule refuses none. Failures are counted per host with map-side sums, so a host
    with a third of all rows costs no more than any other.

    Defined results: null or empty text has no words and fails; a null host is a host of its own; null and
    repeated doc_id are kept row by row; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    stats = scratch.keep(_statistics(docs, [F.col("doc_id"), F.col(host).cast("string").alias("__host")]), "stats")
    bad = reduce(or_, [F.col(f"low_{r}") > F.greatest(times * F.col(f"m_{r}") / (1 + (times - 1) * F.col(f"m_{r}")), F.lit(least)) for r in RULES])
    verdicts = host_rates(stats).select(F.col("__host").alias("__h"), bad.alias("refused"))
    base = F.expr(f"({RULES['short']}) or ({RULES['repeats']})")
    return (stats.join(verdicts, F.col("__host").eqNullSafe(F.col("__h")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (~base & ~F.col("refused")).alias("kept")))


def host_rules_sql(times: float = TIMES, least: float = LEAST_RATE) -> str:
    fails = ", ".join(f"sum(case when {rule} then 1 else 0 end)::double as k_{name}" for name, rule in RULES.items())
    rates = []
    for r in RULES:
        m = f"avg(k_{r} / n) over ()"
        rates.append(f"k_{r} / n as r_{r}, {m} as m_{r}")
    spread = ", ".join(f"avg(pow(r_{r} - m_{r}, 2)) over () as v_{r}" for r in RULES)
    def strength(r: str) -> str:
        return f"least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * inv, 1e-12) - 1, 2.0), 1e6) as s_{r}"
    strengths = ", ".join(strength(r) for r in RULES)
    rates2 = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) as p_{r}" for r in RULES)
    bad = " or ".join(f"p_{r} - {CERTAIN} * sqrt(p_{r} * (1 - p_{r}) / (n + s_{r} + 1)) > greatest({times} * m_{r} / (1 + ({times} - 1) * m_{r}), {least})" for r in RULES)
    base = f"(({RULES['short']}) or ({RULES['repeats']}))"
    return rf"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from documents),
e as (select *, row_number() over () as rid, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as win from d),
w as (select rid, unnest(win) as w, unnest(range(0, len(win))) as p from e),
again as (select rid, p from (select *, count(*) over (partition by rid, w) as c from w) where c > 1),
cov as (select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from again) group by rid),
s as (select doc_id, source, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines
      from e left join cov using (rid)),
h as (select source, count(*)::double as n, {fails} from s group by source),
a as (select *, avg(1 / n) over () as inv, {", ".join(rates)} from h),
b as (select *, {spread} from a),
t as (select *, {strengths} from b),
u as (select *, {rates2} from t),
v as (select source, ({bad}) as refused from u)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} as base_failed, not {base} and not refused as kept
from s join v on s.source is not distinct from v.source"""
