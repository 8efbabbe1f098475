"""The forward cash-out surface: cells x time windows in rupees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..session import cut_lineage
from . import choice
from .distribution import scalar_quantile

PRIOR_WEIGHT, EPS_CASE, MAX_IDS, OPEN_MINUTES = 0.15, 1e-4, 25, 120
CENTROID = (20.5937, 78.9629)
# Fixed values of the untrained countdown: minutes at the door, minutes per km, band factors.
DOOR_MIN, MIN_PER_KM, BAND_LOW, BAND_HIGH = 22.0, 1.9, 0.4, 2.2


def open_complaints(complaints: DataFrame, as_of_s: Column | int, open_minutes: int = OPEN_MINUTES,
                    fraud_types: str = "", state: str = "") -> DataFrame:
    """Complaints filed within the window, before any scoring touches them."""
    as_of = as_of_s if isinstance(as_of_s, Column) else F.lit(as_of_s)
    age = (as_of - F.col("filed_s")) / 60.0
    out = complaints.filter((age >= 0) & (age <= open_minutes))
    wanted = [t.strip() for t in fraud_types.split(",") if t.strip()]
    if wanted:
        out = out.filter(F.col("fraud_type").isin(wanted))
    return out.filter(F.col("state") == state) if state else out


def pick_windows(start: int = 0, end: int = 120) -> tuple[tuple[int, int], ...]:
    """Forecast windows inside the request; all of them when none fits."""
    fit = tuple(w for w in timing.WINDOWS if w[0] >= start and w[1] <= end)
    return fit or timing.WINDOWS


def project_to_cells(scored: DataFrame, membership: DataFrame, group: list[str]) -> DataFrame:
    return scored.join(membership.select("atm_id", "cell"), "atm_id").groupBy(*group, "cell").agg(F.sum("p").alias("p"))


def posteriors(cases: DataFrame, attached: DataFrame, accounts: DataFrame, directory: DataFrame,
               membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case rows with countdown, per-place cell probabilities).

    Case rows: complaint_id, amount, filed_s, fraud_type, state, city, lat, lon, bank_id, m, lo, hi.
    Cell rows: lat, lon, bank_id, cell, p. They meet only inside the aggregation, so the
    spread is stored once per place and bank instead of once per case. Cases on the fallback
    centroid are left out; see ``dropped_cases``.
    """
    chains = attached.join(cases.select(F.col("ticket_id").alias("complaint_id")), "complaint_id", "left_semi")
    ends = choice.case_terminals(chains)
    # one row per open case, and one candidate set per place and bank: each is read twice below
    placed = cut_lineage(ends.join(accounts.select("account_id", "bank_id", "lat", "lon"), "account_id")
                         .filter((F.round("lat", 4) != CENTROID[0]) | (F.round("lon", 4) != CENTROID[1])))
    scored = cut_lineage(choice.fixed_scores(placed, directory))
    best = scored.filter(F.col("choice_rank") == 1).select("lat", "lon", "bank_id", (DOOR_MIN + MIN_PER_KM * F.col("dist_km")).alias("m"))
    rows = (cases.withColumnRenamed("ticket_id", "complaint_id").select("complaint_id", F.col("stolen_amount").alias("amount"), "filed_s", "fraud_type", "state", "city")
            .join(placed.select("complaint_id", "account_id", "lat", "lon", "bank_id"), "complaint_id")
            .join(best, ["lat", "lon", "bank_id"])
            .withColumn("lo", F.col("m") * BAND_LOW).withColumn("hi", F.col("m") * BAND_HIGH))
    return rows, project_to_cells(scored, membership, ["lat", "lon", "bank_id"])


def dropped_cases(cases: DataFrame, kept: DataFrame) -> DataFrame:
    """Open cases that could not be placed (no ledger, no account, or on the centroid)."""
    return cases.withColumnRenamed("ticket_id", "complaint_id").join(kept.select("complaint_id"), "complaint_id", "left_anti")


def case_windows(rows: DataFrame, as_of_s: Column | int, windows=timing.WINDOWS) -> DataFrame:
    as_of = as_of_s if isinstance(as_of_s, Column) else F.lit(as_of_s)
    aged = rows.withColumn("elapsed_min", (as_of - F.col("filed_s")) / 60.0).filter(F.col("elapsed_min") >= 0)
    return timing.add_window_mass(timing.explode_windows(aged, windows)).filter(F.col("window_mass") > 0)


def _masses(rows: DataFrame, cell_probs: DataFrame, as_of_s, windows) -> DataFrame:
    keys = [c for c in ("complaint_id", "lat", "lon", "bank_id") if c in cell_probs.columns]
    timed = case_windows(rows, as_of_s, windows)
    return timed.join(cell_probs, keys).withColumn("mass", F.col("p") * F.col("window_mass")).filter(F.col("mass") > 0)


def case_cells(rows: DataFrame, cell_probs: DataFrame, as_of_s: Column | int, windows=timing.WINDOWS) -> DataFrame:
    """Distinct (cell, complaint_id) of the cases that count in a cell."""
    return _masses(rows, cell_probs, as_of_s, windows).filter(F.col("mass") > EPS_CASE).select("cell", "complaint_id").distinct()


def forward_surface(rows: DataFrame, cell_probs: DataFrame, cells: DataFrame, prior: DataFrame, as_of_s: Column | int,
                    windows=timing.WINDOWS, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """One row per (cell, window): live rupees, capped prior rupees, case count.

    ``cells`` needs ``cell`` and its attributes, ``prior`` needs (cell, share).
    """
    mass = _masses(rows, cell_probs, as_of_s, windows)
    # one row per (cell, window, case) first: the hot cell is summed from partials
    per_case = (mass.groupBy("cell", "window_start_min", "window_end_min", "complaint_id")
                .agg(F.sum(F.col("mass") * F.col("amount")).alias("rupees"), F.max("mass").alias("mass")))
    live = per_case.groupBy("cell", "window_start_min", "window_end_min").agg(
        F.sum("rupees").alias("conditional_rupees"), F.sum((F.col("mass") > EPS_CASE).cast("long")).alias("case_count"))
    # cells x windows rows, read by the totals, the national sum and the final join
    live = cut_lineage(live)
    # at most one row per window
    totals = live.groupBy("window_start_min", "window_end_min").agg(F.sum("conditional_rupees").alias("window_total"))
    grand = F.coalesce(live.agg(F.sum("conditional_rupees")).scalar(), F.lit(0.0))
    spine = timing.explode_windows(cells.join(prior, "cell", "left").withColumn("share", F.coalesce("share", F.lit(0.0))), windows)
    keys = ["cell", "window_start_min", "window_end_min"]
    full = (spine.join(live, keys, "left").join(F.broadcast(totals), ["window_start_min", "window_end_min"], "left")
            .na.fill(0.0, ["conditional_rupees", "window_total"]).na.fill(0, ["case_count"])
            .withColumn("degraded", grand <= 0))
    prior_rupees = F.when(F.col("degraded"), F.col("share")).otherwise(prior_weight * F.col("share") * F.col("window_total"))
    both = F.col("conditional_rupees") + F.col("prior_rupees")
    full = (full.withColumn("prior_rupees", prior_rupees).withColumn("score", both)
            .withColumn("prior_share", F.when(both > 0, F.col("prior_rupees") / both).when(F.col("degraded"), 1.0).otherwise(0.0)))
    # a cell without any mass in any window is not on the surface; a cell has one row per window
    present = F.sum("score").over(Window.partitionBy("cell")) > 0
    return full.withColumn("__on", present).filter("__on").drop("share", "window_total", "__on")


def contributing_ids(rows: DataFrame, cell_probs: DataFrame, as_of_s: Column | int, windows=timing.WINDOWS, limit: int = MAX_IDS) -> DataFrame:
    """The first ``limit`` contributing complaint ids per cell in order, as (cell, complaint_ids).

    Ranks are cut before the shuffle, so a hot cell never gathers more than the limit per task.
    """
    ids = _masses(rows, cell_probs, as_of_s, windows).filter(F.col("mass") > EPS_CASE).select("cell", "complaint_id").distinct()
    w = Window.partitionBy("cell").orderBy("complaint_id")
    kept = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit)
    return kept.groupBy("cell").agg(F.sort_array(F.collect_list("complaint_id")).alias("complaint_ids"))


def cell_summary(surface: DataFrame) -> DataFrame:
    """Cells over all windows: sums, and the largest case count of a window."""
    names = [c for c in ("cell_id", "lat", "lon", "district", "state", "city", "atm_count") if c in surface.columns]
    c, p = F.sum("conditional_rupees"), F.sum("prior_rupees")
    return (surface.groupBy("cell", *names).agg(
        F.sum("score").alias("score"), c.alias("conditional_rupees"), p.alias("prior_rupees"),
        F.when(c + p > 0, p / (c + p)).otherwise(1.0).alias("prior_share"), F.max("case_count").alias("case_count")))


def surface_totals(surface: DataFrame) -> DataFrame:
    c, p = F.sum("conditional_rupees"), F.sum("prior_rupees")
    return surface.agg(F.countDistinct("cell").alias("n_cells"), c.alias("total_conditional_rupees"), p.alias("total_prior_rupees"),
                       F.when(c + p > 0, p / (c + p)).otherwise(1.0).alias("prior_share_national"), F.max(F.col("degraded").cast("int")).alias("degraded"))


def roll_up(summary: DataFrame, case_cells: DataFrame) -> DataFrame:
    """National, state, district and cell rows in one pass over grouping sets.

    ``case_cells``: distinct (cell, complaint_id). Distinct cases are counted per level on
    their own keys.
    """
    w = F.greatest(F.col("score"), F.lit(0.0))
    base = summary.withColumn("wlat", F.col("lat") * w).withColumn("wlon", F.col("lon") * w)
    sets = [[F.col("state"), F.col("district"), F.col("cell_id")], [F.col("state"), F.col("district")], [F.col("state")], []]
    total = [F.sum(c).alias(c) for c in ("score", "conditional_rupees", "prior_rupees", "atm_count", "wlat", "wlon")]
    level = F.element_at(F.create_map(*[F.lit(x) for x in (0, "cell", 1, "district", 3, "state", 7, "national")]), F.grouping_id().cast("int"))
    sums = base.groupingSets(sets, "state", "district", "cell_id").agg(level.alias("level"), F.count(F.lit(1)).alias("cells"), *total)
    names = summary.select("cell", "cell_id", "state", "district")
    joined = case_cells.join(names, "cell").drop("cell")
    levels = {"cell": ["state", "district", "cell_id"], "district": ["state", "district"], "state": ["state"], "national": []}
    counted = None
    for level, keys in levels.items():
        rest = [F.lit(None).cast("string").alias(c) for c in ("state", "district", "cell_id") if c not in keys]
        part = (joined.select(*keys, "complaint_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("case_count"))
                .select(F.lit(level).alias("level"), *keys, *rest, "case_count"))
        counted = part if counted is None else counted.unionByName(part)
    same = [sums[c].eqNullSafe(counted[c]) for c in ("level", "state", "district", "cell_id")]
    out = sums.join(counted, same, "left").select(*[sums[c] for c in sums.columns], F.coalesce(counted["case_count"], F.lit(0)).alias("case_count"))
    both = F.col("conditional_rupees") + F.col("prior_rupees")
    return (out.withColumn("lat", F.when(F.col("score") > 0, F.col("wlat") / F.col("score")).otherwise(0.0))
            .withColumn("lon", F.when(F.col("score") > 0, F.col("wlon") / F.col("score")).otherwise(0.0))
            .withColumn("prior_share", F.when(both > 0, F.col("prior_rupees") / both).otherwise(1.0)).drop("wlat", "wlon"))


def national_cuts(summary: DataFrame) -> DataFrame:
    """Band 0..4 of every cell against cuts of the whole surface (sorted[floor(q*n)])."""
    from .distribution import exact_quantiles

    cuts = exact_quantiles(summary, [], "score", [0.95, 0.85, 0.70, 0.50], pick="index").select("q").scalar()
    return summary.withColumn("__cuts", cuts).withColumn("band", F.size(F.filter("__cuts", lambda c: F.col("score") < c))).drop("__cuts")
