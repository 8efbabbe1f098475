"""How good is it: classifier, ranking, zone, countdown and replay reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, timing
from ..session import cut_lineage
from .distribution import cumulative, exact_quantiles, number_sorted

K_GRID = (1, 3, 5, 10)
OPEN_MINUTES = 120
ACTION_MIN, PIPELINE_MIN = 15.0, 1.0


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _div(a, b) -> Column:
    return _ratio(F.col(a), F.col(b))


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp, fp, fn, tn columns."""
    return (df.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
            .withColumn("f1", _ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")))
            .withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))))


def confusion(df: DataFrame, threshold: float, score="score", label="label") -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    return with_rates(df.agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn")))


def score_steps(df: DataFrame, score="score", label="label") -> DataFrame:
    """One row per distinct score with running totals from the lowest score up."""
    steps = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return cumulative(steps.filter(F.col(score).isNotNull()), [], score, ["n", "pos"])


def roc_auc(df: DataFrame, score="score", label="label") -> DataFrame:
    """Mann-Whitney statistic with mid-ranks on ties; ``auc_any`` ignores the direction."""
    s = score_steps(df, score, label)
    mid = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    p, n = F.sum("pos"), F.sum("n")
    auc = F.when((p > 0) & (p < n), (F.sum(mid * F.col("pos")) - p * (p + 1) / 2.0) / (p * (n - p))).otherwise(0.5)
    return s.agg(auc.alias("auc")).withColumn("auc_any", F.greatest("auc", 1 - F.col("auc")))


def average_precision(df: DataFrame, score="score", label="label") -> DataFrame:
    """Step sum over distinct scores from the top."""
    s = score_steps(df.withColumn("__neg", -F.col(score)), "__neg", label)
    return s.agg(_ratio(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), F.sum("pos")).alias("average_precision"))


def threshold_sweep(df: DataFrame, score="score", label="label", probs=tuple(i / 100 for i in range(1, 100))) -> DataFrame:
    """Confusion and rates at every distinct quantile threshold."""
    cuts = (exact_quantiles(df, [], score, list(probs)).select(F.explode("q").alias("threshold")).distinct())
    steps = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    # at most one threshold per probability: every score is counted once, under the highest threshold it reaches
    cuts = cut_lineage(cuts)
    grid = cuts.agg(F.array_sort(F.collect_list("threshold")).alias("__c"))
    reached = steps.withColumn("__c", grid.scalar()).withColumn("threshold", F.element_at("__c", F.nullif(F.size(F.filter("__c", lambda c: c <= F.col(score))), F.lit(0))))
    own = reached.filter(F.col("threshold").isNotNull()).groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    hit = cuts.join(own, "threshold", "left").na.fill(0, ["n", "pos"]).select("threshold", F.sum("n").over(up).alias("flagged"), F.sum("pos").over(up).alias("tp"))
    totals = steps.agg(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos"))).scalar()
    out = cuts.join(hit, "threshold", "left").na.fill(0, ["flagged", "tp"]).withColumn("__t", totals)
    return with_rates(out.withColumn("fp", F.col("flagged") - F.col("tp")).withColumn("fn", F.col("__t.pos") - F.col("tp"))
                      .withColumn("tn", F.col("__t.n") - F.col("flagged") - F.col("fn")).drop("__t", "flagged"))


def best_threshold(df: DataFrame, score="score", label="label") -> DataFrame:
    sweep = threshold_sweep(df, score, label)
    best = F.struct((-F.col("f1")).alias("f"), F.col("threshold"))
    return sweep.agg(F.min_by(F.struct("threshold", "f1"), best).alias("b")).select("b.threshold", "b.f1")


def prevalence_projection(counts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Precision and queue per 100,000 screened at other base rates; a NULL prevalence means the measured one."""
    one = counts.select(F.struct(_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), _ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                                 ((F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))).alias("base"))).scalar()
    s = scenarios.withColumn("__m", one).withColumn("p", F.coalesce("prevalence", "__m.base"))
    flagged = F.col("__m.tpr") * F.col("p") + F.col("__m.fpr") * (1 - F.col("p"))
    return s.select("scenario", F.round("p", 6).alias("prevalence"), F.round(_ratio(F.col("__m.tpr") * F.col("p"), flagged), 4).alias("precision"),
                    F.round(flagged * 100000, 1).alias("flagged_per_100k"), F.round(F.col("__m.tpr") * F.col("p") * 100000, 1).alias("true_per_100k"),
                    F.round(F.col("__m.fpr") * (1 - F.col("p")) * 100000, 1).alias("innocent_per_100k"))


def precision_at(df: DataFrame, budgets=(100, 500, 1000), score="score", label="label", tie="account_id") -> DataFrame:
    """Precision, recall and lift among the K highest scores (a top-K report: K is the budget)."""
    top = df.select(score, label, tie).orderBy(F.desc(score), tie).limit(max(budgets))
    # at most max(budgets) rows from here on
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), tie)))
    base = df.agg(F.struct(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))).scalar()
    grid = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in budgets]))).filter(F.col("r") <= F.col("k"))
    out = grid.groupBy("k").agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count(F.lit(1)).alias("k_eff")).withColumn("__b", base)
    precision = F.col("hits") / F.greatest(F.lit(1), F.col("k_eff"))
    return out.select("k", "hits", precision.alias("precision"), (F.col("hits") / F.greatest(F.lit(1), F.col("__b.pos"))).alias("recall"),
                      F.when(F.col("__b.pos") > 0, precision / (F.col("__b.pos") / F.col("__b.n"))).alias("lift"))


def containment_curve(truth_ranks: DataFrame, n_machines: Column, ks=tuple(range(1, 11))) -> DataFrame:
    """Share of cash-outs whose machine is in the top K, by score and by distance.

    ``truth_ranks``: one row per cash-out with ``rank`` and ``dist_rank`` (NULL = not among the candidates).
    """
    n, found = F.count(F.lit(1)), F.count("rank")
    per = [F.struct(F.lit(k).alias("k"), F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.count(F.when(F.col("dist_rank") <= k, 1)).alias("base")) for k in ks]
    one = truth_ranks.agg(n.alias("n"), found.alias("found"), F.array(*per).alias("c"))
    return (one.select("n", "found", F.explode("c").alias("c")).select(
        "c.k", F.round(F.col("c.hits") / F.col("n"), 4).alias("containment"), F.round(F.col("c.base") / F.col("n"), 4).alias("baseline"),
        F.round(1 - F.col("c.k") / n_machines, 6).alias("reduction"), (F.col("n") - F.col("found")).alias("retrieval_failures"),
        (F.col("found") - F.col("c.hits")).alias("ranking_failures")))


TAIL_TERMS = 4096       # binomial terms below k; the next one is then under 2^-53 of the sum, or there is none


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 10 on, exact below."""
    x = n + F.lit(1.0)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    exact = F.element_at(F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(10)]), (F.least(n, F.lit(9)) + 1).cast("int"))
    return F.when(n < 10, exact).otherwise(series)


def mcnemar(pairs: DataFrame, model="model_hit", baseline="baseline_hit") -> DataFrame:
    """Discordant counts and the exact two-sided p value.

    The tail is summed downwards from k. Each term is the one above times i / (n - i + 1); where k is near n / 2 the
    terms fall like a bell of width sqrt(n), so the number of terms follows sqrt(n), not n.
    """
    b = F.count(F.when(F.col(model) & ~F.col(baseline), 1))
    c = F.count(F.when(~F.col(model) & F.col(baseline), 1))
    counts = pairs.agg(b.alias("b"), c.alias("c")).withColumn("n", F.col("b") + F.col("c")).withColumn("k", F.least("b", "c"))
    n, k = F.col("n"), F.col("k")
    # beyond ten standard deviations nothing adds to a double
    terms = F.least(k, F.greatest(F.lit(TAIL_TERMS), F.ceil(5 * F.sqrt(n.cast("double")))).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("s"))

    def step(acc, j):
        i = k - j + 1
        term = acc["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (acc["s"] + term).alias("s"))

    js = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    relative = F.aggregate(js, start, step, lambda acc: acc["s"])
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0)
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * relative * F.exp(top)))
    return counts.withColumn("p_value", p)


def regression_report(df: DataFrame, actual="actual", predicted="predicted", low="lo", high="hi") -> DataFrame:
    """MAE, R2, the mean baseline and the coverage and width of the band."""
    mean = df.agg(F.avg(actual)).scalar()
    a, p = F.col(actual), F.col(predicted)
    ss_res, ss_tot = F.sum(F.pow(a - p, 2)), F.sum(F.pow(a - F.col("__mean"), 2))
    return df.withColumn("__mean", mean).agg(
        F.avg(F.abs(a - p)).alias("mae"), F.when(ss_tot > 0, 1 - ss_res / ss_tot).otherwise(0.0).alias("r2"), F.avg(F.abs(a - F.col("__mean"))).alias("mean_mae"),
        F.avg(((a >= F.col(low)) & (a <= F.col(high))).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"))


def lead_time_report(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Median lead after the pipeline allowance, the share that can be acted on, and how often that call was right."""
    rows = df.withColumn("lead", F.greatest(F.lit(0.0), F.col(actual) - PIPELINE_MIN)).withColumn("called", F.col(predicted) - PIPELINE_MIN >= ACTION_MIN)
    median = exact_quantiles(rows, [], "lead", [0.5]).select(F.col("q")[0]).scalar()
    ok = F.col("lead") >= ACTION_MIN
    return (rows.agg(F.avg(ok.cast("double")).alias("actionable_share"), F.avg(F.when(F.col("called"), ok.cast("double"))).alias("call_precision"), F.count(F.lit(1)).alias("n"))
            .withColumn("median_lead", median))


def delay_distribution(df: DataFrame, column: str) -> DataFrame:
    q = exact_quantiles(df, [], column, [0.05, 0.5, 0.95]).select("q").scalar()
    v = F.col(column)
    return (df.filter(v.isNotNull()).agg(F.avg(v).alias("mean"), F.avg((v < 15).cast("double")).alias("under_15"), F.avg((v < 5).cast("double")).alias("under_5"))
            .withColumn("p05", q[0]).withColumn("p50", q[1]).withColumn("p95", q[2]))


# --- replay ---------------------------------------------------------------------------

def open_pairs(events: DataFrame, minutes: int = OPEN_MINUTES) -> DataFrame:
    """Open cases per filing instant: (at_s, n_open). Range join on time buckets, instants deduplicated.

    Cases are counted per second first, so both sides hold one row per distinct second.
    """
    width = minutes * 60
    per_s = events.groupBy("filed_s").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.floor(F.col("filed_s") / width)
    asks = per_s.select(F.col("filed_s").alias("at_s")).withColumn("b", F.explode(F.array(F.floor(F.col("at_s") / width), F.floor(F.col("at_s") / width) - 1)))
    return (asks.join(per_s.withColumn("b", bucket), "b").filter(F.col("filed_s").between(F.col("at_s") - width, F.col("at_s")))
            .groupBy("at_s").agg(F.sum("n").alias("n_open")))


def epoch_cell_scores(events: DataFrame, cell_probs: DataFrame, minutes: int = OPEN_MINUTES) -> DataFrame:
    """Live rupees per (filing instant, cell): every instant's surface, each built once.

    Open cases fold per (instant, place, bank) before the cell spread is joined, so a busy
    place is one row per instant.
    """
    width = minutes * 60
    instants = events.select(F.col("filed_s").alias("at_s")).distinct().withColumn("b", F.floor(F.col("at_s") / width))
    # cases of one second, place, bank and countdown share their elapsed time and window mass
    groups = events.groupBy("filed_s", "lat", "lon", "bank_id", "m", "lo", "hi").agg(F.sum("amount").alias("amount"))
    cases = groups.withColumn("b", F.explode(F.array(F.floor(F.col("filed_s") / width), F.floor(F.col("filed_s") / width) + 1)))
    pairs = (cases.join(instants, "b").filter(F.col("at_s").between(F.col("filed_s"), F.col("filed_s") + width))
             .withColumn("elapsed_min", (F.col("at_s") - F.col("filed_s")) / 60.0))
    timed = timing.add_window_mass(timing.explode_windows(pairs))
    spread = (timed.groupBy("at_s", "lat", "lon", "bank_id").agg(F.sum(F.col("window_mass") * F.col("amount")).alias("rupees")).filter(F.col("rupees") > 0))
    return (spread.join(cell_probs, ["lat", "lon", "bank_id"]).groupBy("at_s", "cell").agg(F.sum(F.col("rupees") * F.col("p")).alias("rupees")))


def _live_ahead(live: DataFrame, asks: DataFrame, live_value: Column, ask_value: Column, out: str) -> DataFrame:
    """Per (at_s, cell) ask: live rows of the instant with a strictly larger value. One scan per instant."""
    rows = (live.select("at_s", F.lit(None).cast("string").alias("ask"), live_value.alias("v"), F.lit(1).alias("n"))
            .unionByName(asks.select("at_s", F.col("cell").cast("string").alias("ask"), ask_value.alias("v"), F.lit(0).alias("n"))))
    upto = Window.partitionBy("at_s").orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("at_s", "v")
    return (rows.withColumn(out, F.sum("n").over(upto) - F.sum("n").over(ties)).filter(F.col("ask").isNotNull())
            .select("at_s", F.col("ask").alias("cell_text"), out))


def replay_truth_ranks(events: DataFrame, scores: DataFrame, cells: DataFrame, prior: DataFrame, prior_weight: float = 0.15) -> DataFrame:
    """Rank of the true cell among all cells at the instant of filing: (event_id, rank).

    The rank is 1 + the cells that score higher. Live cells are compared inside the instant;
    cells with prior mass only are counted in the one prior order, so no instant ever lists
    every cell.
    """
    totals = scores.groupBy("at_s").agg(F.sum("rupees").alias("total"))
    priors = cells.select("cell").join(prior, "cell", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    live = (scores.join(priors, "cell").join(totals, "at_s").withColumn("score", F.col("rupees") + prior_weight * F.col("share") * F.col("total")))
    truth = events.select("event_id", F.col("filed_s").alias("at_s"), F.col("truth_cell").alias("cell"))
    asks = (truth.select("at_s", "cell").distinct().join(priors, "cell").join(totals, "at_s")
            .join(live.select("at_s", "cell", "score"), ["at_s", "cell"], "left")
            # the share a cell needs for its prior part alone to beat the true cell
            .withColumn("mine", F.coalesce("score", prior_weight * F.col("share") * F.col("total")))
            .withColumn("need", F.when(F.col("score").isNull(), F.col("share")).otherwise(F.col("mine") / (prior_weight * F.col("total")))))
    levels = (priors.select((-F.col("share")).alias("v"), F.lit(1).alias("n")).unionByName(asks.select((-F.col("need")).alias("v"), F.lit(0).alias("n")))
              .groupBy("v").agg(F.sum("n").alias("n")))
    order = cumulative(levels, [], "v", ["n"]).select((-F.col("v")).alias("need"), (F.col("cum_n") - F.col("n")).alias("prior_ahead"))
    ahead = _live_ahead(live, asks, F.col("score"), F.col("mine"), "live_ahead")
    both = _live_ahead(live, asks, F.col("share"), F.col("need"), "counted_twice")
    ranked = (asks.withColumn("cell_text", F.col("cell").cast("string")).join(ahead, ["at_s", "cell_text"]).join(both, ["at_s", "cell_text"]).join(order, "need")
              .withColumn("rank", 1 + F.col("live_ahead") + F.col("prior_ahead") - F.col("counted_twice")))
    return truth.join(ranked.select("at_s", "cell", "rank"), ["at_s", "cell"])


def hit_table(ranks: DataFrame, amounts: DataFrame, ks=K_GRID) -> DataFrame:
    """hit@k and rupees covered from (event_id, rank) and (event_id, amount)."""
    rows = amounts.join(ranks.select("event_id", "rank"), "event_id")
    per = [F.struct(F.lit(k).alias("k"), F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.sum(F.when(F.col("rank") <= k, F.col("amount")).otherwise(0.0)).alias("rupees")) for k in ks]
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.array(*per).alias("c"))
    return one.select("n", "total", F.explode("c").alias("c")).select(
        "c.k", "n", "c.hits", F.round(F.col("c.hits") / F.col("n"), 4).alias("hit_rate"), F.round(F.col("c.rupees") / F.col("total"), 4).alias("rupees_covered"))


def flagged_shares(events: DataFrame, scores: DataFrame, cells: DataFrame, prior: DataFrame, n_machines: Column, ks=K_GRID, prior_weight: float = 0.15) -> DataFrame:
    """Mean share of all machines that the k best cells of an event's instant hold: (k, share).

    A cell with prior mass alone is among the k best only if it is among the k largest priors, because every cell with
    a larger prior is ahead of it. So an instant lists its live cells and max(ks) others.
    """
    most = max(ks)
    totals = scores.groupBy("at_s").agg(F.sum("rupees").alias("total")).filter("total > 0")
    size = cells.select("cell", "atm_count")
    live = (scores.join(totals, "at_s").join(prior.select("cell", "share"), "cell", "left")
            .select("at_s", "cell", (F.col("rupees") + prior_weight * F.coalesce("share", F.lit(0.0)) * F.col("total")).alias("score")))
    # max(ks) rows
    best = prior.select("cell", "share").filter("share > 0").orderBy(F.desc("share"), "cell").limit(most)
    rest = (totals.join(F.broadcast(best)).select("at_s", "cell", (prior_weight * F.col("share") * F.col("total")).alias("score"))
            .join(scores.select("at_s", "cell"), ["at_s", "cell"], "left_anti"))
    order = Window.partitionBy("at_s").orderBy(F.desc("score"), "cell")
    top = live.unionByName(rest).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).join(size, "cell")
    per = [F.sum(F.when(F.col("r") <= k, F.col("atm_count")).otherwise(0)).alias(f"k{k}") for k in ks]
    held = events.select("event_id", F.col("filed_s").alias("at_s")).join(top.groupBy("at_s").agg(*per), "at_s")
    one = held.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.avg(F.col(f"k{k}")).alias("machines")) for k in ks]).alias("c"))
    return one.select(F.explode("c").alias("c")).select("c.k", (F.col("c.machines") / n_machines).alias("share"))


def forecast_table(hits: DataFrame, shares: DataFrame, leads: DataFrame, radius_km: float) -> DataFrame:
    """Hit table with the predictive accuracy index, the share of machines and area flagged, and the mean lead of the hits."""
    return (hits.join(shares, "k").join(leads, "k", "left")
            .withColumn("pai", F.when((F.col("share") > 0) & (F.col("n") > 0), F.round(F.col("hits") / F.col("n") / F.col("share"), 3)).otherwise(0.0))
            .withColumn("flagged_atm_share", F.round("share", 5)).withColumn("flagged_area_km2", F.round(F.col("k") * math.pi * radius_km * radius_km, 1)).drop("share"))


def mean_leads(ranks: DataFrame, delays: DataFrame, ks=K_GRID) -> DataFrame:
    """(k, mean_lead_min): minutes from filing to withdrawal of the events hit at k."""
    rows = ranks.select("event_id", "rank").join(delays, "event_id")
    one = rows.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.avg(F.when(F.col("rank") <= k, F.col("delay_min"))), 2).alias("lead")) for k in ks]).alias("c"))
    return one.select(F.explode("c").alias("c")).select("c.k", F.col("c.lead").alias("mean_lead_min"))


def coverage_table(hits: DataFrame) -> DataFrame:
    """Precision, false cells per hit and cells searched per hit."""
    tries = F.col("k") * F.col("n")
    return (hits.withColumn("precision", F.round(F.col("hits") / tries, 5))
            .withColumn("false_cells_per_hit", F.when(F.col("hits") > 0, F.round((tries - F.col("hits")) / F.col("hits"), 2)).otherwise(0.0))
            .withColumn("cells_per_hit", F.when(F.col("hits") > 0, F.round(tries / F.col("hits"), 2)).otherwise(0.0)))


def static_rank(truth: DataFrame, order: DataFrame) -> DataFrame:
    """Rank of every true cell in one fixed cell order (decayed prior or plain counts); ties by cell."""
    ranked = number_sorted(order.select("cell", "share"), [F.desc("share"), F.col("cell")], "rank")
    return truth.join(ranked.select("cell", "rank"), truth.truth_cell == ranked.cell).select("event_id", "rank")


def distance_rank(truth: DataFrame, cells: DataFrame) -> DataFrame:
    """Rank of the true cell by distance from (lat, lon): 1 + the cells that are nearer.

    Counted as points in a circle, so no position is compared with every cell.
    """
    from . import spatial

    mine = (truth.join(cells.select(F.col("cell").alias("truth_cell"), F.col("lat").alias("clat"), F.col("lon").alias("clon")), "truth_cell")
            .withColumn("d", geo.haversine_km("lat", "lon", "clat", "clon")).withColumn("km", F.greatest(F.lit(0.0), F.col("d") - 1e-9)))
    nearer = spatial.count_in_circles(mine.select("lat", "lon", "km"), cells, "nearer")
    return mine.join(nearer, ["lat", "lon", "km"]).select("event_id", (F.col("nearer") + 1).alias("rank"))


def city_positions(directory: DataFrame) -> DataFrame:
    return directory.groupBy("city", "state").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def seed_stability(runs: DataFrame) -> DataFrame:
    """Per metric over repeated runs: mean, std, min, max, and whether the mean clears the spread."""
    out = runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("runs"))
    return out.withColumn("stable", F.abs("mean") > 2 * F.col("std"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
