"""Data audits: leakage, overlap, correlation, linkage and report invariants."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distribution import exact_quantiles
from .evaluation import average_precision, roc_auc, union_all, with_rates

LEAK_LIMIT, REDUNDANT = 0.95, 0.85
LEAK_PROBS = tuple(0.02 + 0.96 * i / 39 for i in range(40))


def stack_features(df: DataFrame, columns, keep=("account_id", "label")) -> DataFrame:
    """(keep..., feature, value): one row per feature value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")
    return df.select(*keep, pairs).select(*keep, "s.feature", "s.value")


def single_feature_f1(df: DataFrame, columns, probs=LEAK_PROBS) -> DataFrame:
    """Best F1 any one threshold on any one feature reaches: (feature, best_f1, leak)."""
    long = stack_features(df, columns)
    cuts = (exact_quantiles(long, ["feature"], "value", list(probs)).select("feature", F.explode("q").alias("threshold")).distinct())
    steps = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    totals = steps.groupBy("feature").agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))
    # a feature has at most len(probs) thresholds
    above = (steps.join(F.broadcast(cuts), "feature").filter(F.col("value") > F.col("threshold")).groupBy("feature", "threshold")
             .agg(F.sum("n").alias("flagged"), F.sum("pos").alias("tp")))
    grid = cuts.join(above, ["feature", "threshold"], "left").na.fill(0, ["flagged", "tp"]).join(totals, "feature")
    side = F.explode(F.array(F.struct(F.col("flagged").alias("flagged"), F.col("tp").alias("tp")),
                             F.struct((F.col("total") - F.col("flagged")).alias("flagged"), (F.col("total_pos") - F.col("tp")).alias("tp")))).alias("s")
    both = grid.select("feature", "total", "total_pos", side).select("feature", "total", "total_pos", "s.flagged", "s.tp")
    both = both.filter((F.col("flagged") > 0) & (F.col("flagged") < F.col("total")))
    f1 = F.when(F.col("flagged") + F.col("total_pos") > 0, 2.0 * F.col("tp") / (F.col("flagged") + F.col("total_pos"))).otherwise(0.0)
    return both.groupBy("feature").agg(F.max(f1).alias("best_f1")).withColumn("leak", F.col("best_f1") >= LEAK_LIMIT)


def class_overlap(df: DataFrame, columns, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """p5-p95 of every feature per label."""
    q = exact_quantiles(stack_features(df, columns), ["feature", "label"], "value", [low, high])
    return q.select("feature", "label", F.col("q")[0].alias("p_low"), F.col("q")[1].alias("p_high"))


def _pearson(a: str, b: str) -> Column:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def correlation_pairs(df: DataFrame, columns) -> DataFrame:
    """Pearson r of every feature pair in one pass; a constant column gives NULL."""
    pairs = list(itertools.combinations(columns, 2))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _pearson(a, b).alias("r")) for a, b in pairs]).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.a", "p.b", "p.r")


def redundant_pairs(df: DataFrame, columns, signal: DataFrame, limit: float = REDUNDANT) -> DataFrame:
    """Near-duplicate features and which of the two to drop: the one with the weaker AUC."""
    auc = signal.select("feature", "auc_any")
    hit = correlation_pairs(df, columns).filter(F.abs("r") >= limit)
    both = (hit.join(auc.select(F.col("feature").alias("a"), F.col("auc_any").alias("auc_a")), "a").join(auc.select(F.col("feature").alias("b"), F.col("auc_any").alias("auc_b")), "b"))
    return both.select("a", "b", "r", F.when(F.col("auc_a") < F.col("auc_b"), F.col("a")).otherwise(F.col("b")).alias("drop"))


def feature_auc(df: DataFrame, columns) -> DataFrame:
    """AUC of every single feature, either direction: (feature, auc, auc_any)."""
    from .distribution import cumulative

    long = stack_features(df, columns)
    steps = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    s = cumulative(steps, ["feature"], "value", ["n", "pos"])
    mid = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    p, n = F.sum("pos"), F.sum("n")
    auc = F.when((p > 0) & (p < n), (F.sum(mid * F.col("pos")) - p * (p + 1) / 2.0) / (p * (n - p))).otherwise(0.5)
    return s.groupBy("feature").agg(auc.alias("auc")).withColumn("auc_any", F.greatest("auc", 1 - F.col("auc")))


def mutual_information(df: DataFrame, columns, bins: int = 20) -> DataFrame:
    """Mutual information of each feature, in equal-share bins, with the label (nats)."""
    long = stack_features(df, columns)
    cuts = exact_quantiles(long, ["feature"], "value", [i / bins for i in range(1, bins)])
    # one short array per feature
    binned = (long.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(cuts), "feature")
              .withColumn("bin", F.size(F.filter("q", lambda c: c < F.col("value")))).groupBy("feature", "bin", "label").agg(F.sum("n").alias("n")))
    by_bin = binned.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_label = binned.groupBy("feature", "label").agg(F.sum("n").alias("nl"))
    total = binned.groupBy("feature").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return (binned.join(by_bin, ["feature", "bin"]).join(by_label, ["feature", "label"]).join(total, "feature")
            .groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("nl")))).alias("mutual_information")))


def signal_table(df: DataFrame, columns) -> DataFrame:
    """Point-biserial r, AUC and mutual information per feature."""
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(_pearson(c, "label"), F.lit(0.0)).alias("r")) for c in columns]).alias("p"))
    r = one.select(F.explode("p").alias("p")).select("p.feature", "p.r")
    return r.join(feature_auc(df, columns), "feature").join(mutual_information(df, columns), "feature")


def attainable_ceiling(labels: DataFrame, missed_rate: float, false_rate: float) -> DataFrame:
    """Best precision, recall and F1 a perfect model can show under label noise."""
    pos = F.sum((F.col("label") == 1).cast("double"))
    neg = F.sum((F.col("label") == 0).cast("double"))
    kept, false = pos * (1 - missed_rate), neg * false_rate
    return (labels.agg(pos.alias("pos"), kept.alias("kept"), false.alias("false_reports"))
            .withColumn("precision", F.col("kept") / F.col("pos")).withColumn("recall", F.col("kept") / (F.col("kept") + F.col("false_reports")))
            .withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def calibration_bands(df: DataFrame, score="score", label="label", bands: int = 10) -> DataFrame:
    """True rate per equal-width score band."""
    band = F.least(F.lit(bands), F.width_bucket(F.col(score), F.lit(0.0), F.lit(1.0), F.lit(bands)))
    return df.groupBy(band.cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("true_rate"), F.avg(score).alias("mean_score"))


def calibration_breaks(bands: DataFrame) -> DataFrame:
    """Bands whose true rate falls below the band before (bands are few)."""
    from pyspark.sql import Window

    before = F.lag("true_rate").over(Window.partitionBy(F.lit(0)).orderBy("band"))
    return bands.withColumn("before", before).filter(F.col("true_rate") < F.col("before"))


def linkage_audit(complaints: DataFrame, ledger: DataFrame, accounts: DataFrame, directory: DataFrame) -> DataFrame:
    """Row counts, orphans and coverage between the tables: (check, n)."""
    def n(name, df):
        return df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))

    attached = ledger.filter(F.col("complaint_id").isNotNull())
    ids = complaints.select(F.col("ticket_id").alias("complaint_id"))
    ends = ledger.select(F.col("src_account").alias("account_id")).union(ledger.select("dst_account")).distinct()
    outs = ledger.filter(F.col("cashout_atm_id").isNotNull()).select(F.col("cashout_atm_id").alias("atm_id"))
    return union_all([
        n("complaints", complaints), n("transfers", ledger), n("accounts", accounts), n("machines", directory),
        n("transfers_without_complaint", attached.join(ids, "complaint_id", "left_anti")),
        n("complaints_without_transfers", ids.join(attached.select("complaint_id").distinct(), "complaint_id", "left_anti")),
        n("unknown_accounts", ends.join(accounts.select("account_id"), "account_id", "left_anti")),
        n("unknown_machines", outs.join(directory.select("atm_id"), "atm_id", "left_anti")),
        n("machines_never_used", directory.select("atm_id").join(outs.distinct(), "atm_id", "left_anti"))])


def ledger_violations(counts: DataFrame, projection: DataFrame) -> DataFrame:
    """Report invariants as rows that break them (empty is good).

    Confusion counts must add up, rates must lie in [0, 1], and the projection at the measured
    base rate must give the measured precision.
    """
    rated = with_rates(counts)
    bad = [rated.filter(~F.col(c).between(0, 1)).select(F.lit(f"{c} outside [0,1]").alias("violation")) for c in ("precision", "recall", "f1", "accuracy")]
    measured = rated.select("precision").scalar()
    bad.append(projection.filter((F.col("scenario") == "measured") & (F.abs(F.col("precision") - measured) > 5e-4)).select(F.lit("projection disagrees with the measured precision").alias("violation")))
    return union_all(bad)


def dataset_summary(ledger: DataFrame, accounts: DataFrame, complaints: DataFrame) -> DataFrame:
    from .accounts import accounts_seen

    busy = (ledger.select(F.col("src_account").alias("a")).unionAll(ledger.select("dst_account")).groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    q = exact_quantiles(busy, [], "n", [0.5, 0.95]).select("q").scalar()
    return (ledger.agg(F.count(F.lit(1)).alias("transfers"), F.sum(F.col("is_fraud").cast("long")).alias("fraud_transfers"))
            .withColumn("accounts_active", accounts_seen(ledger).agg(F.count(F.lit(1))).scalar())
            .withColumn("mule_prevalence", accounts.agg(F.avg(F.col("is_mule_label").cast("double"))).scalar())
            .withColumn("complaints", complaints.agg(F.count(F.lit(1))).scalar())
            .withColumn("activity_p50", q[0]).withColumn("activity_p95", q[1]).withColumn("quiet_share", busy.agg(F.avg((F.col("n") <= 2).cast("double"))).scalar()))

