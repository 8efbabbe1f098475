"""Learning jobs on MLlib: splits, scaling, account risk, calibration, countdown and its band."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .distribution import exact_quantiles
from .evaluation import average_precision, best_threshold, confusion, roc_auc, union_all


def _unit(key: Column, seed: int | Column) -> Column:
    """A repeatable number in [0, 1) per key: the first twelve hex digits of md5('seed|key')."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    digits = F.substring(F.md5(F.concat_ws("|", seed, key.cast("string"))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 48)


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Zero mean and unit population deviation, measured on training rows only."""
    stats = df.filter(train).agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("st")).select("st").scalar()
    out = df.withColumn("__st", stats)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"__st.{c}.m")) / F.when(F.col(f"__st.{c}.s") > 0, F.col(f"__st.{c}.s")).otherwise(1.0))
    return out.drop("__st")


def stratified_split(df: DataFrame, key: str = "account_id", label: str = "label", parts=(0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``part`` in train/val/test at the same label rate: exact hash-order cuts within each label."""
    u = df.withColumn("__u", _unit(F.col(key), seed))
    cuts = exact_quantiles(u, [label], "__u", [parts[0], parts[0] + parts[1]], pick="index").withColumnRenamed("q", "__q")
    # one short array per label value
    out = u.join(F.broadcast(cuts), label)
    part = F.when(F.col("__u") < F.col("__q")[0], "train").when(F.col("__u") < F.col("__q")[1], "val").otherwise("test")
    return out.withColumn("part", part).drop("__u", "__q")


def split_by_complaint(df: DataFrame, test_share: float = 0.20, seed: int = 42, key: str = "complaint_id") -> DataFrame:
    """``part`` train/test with no complaint on both sides; exactly the lowest hashes are the test share."""
    ids = df.select(key).distinct().withColumn("__u", _unit(F.col(key), seed))
    cut = exact_quantiles(ids, [], "__u", [test_share], pick="index").select(F.col("q")[0]).scalar()
    marked = ids.withColumn("part", F.when(F.col("__u") < cut, "test").otherwise("train")).drop("__u")
    return df.join(marked, key)


def split_by_seeds(df: DataFrame, seeds: list[int], test_share: float = 0.20, key: str = "complaint_id") -> DataFrame:
    """(key, run, part) for every seed, each as ``split_by_complaint`` with that seed, in one pass over the distinct keys."""
    runs = F.array(*[F.lit(s) for s in seeds])
    ids = df.select(key).distinct().select(key, F.explode(runs).alias("run"))
    ids = ids.withColumn("__u", _unit(F.col(key), F.col("run")))
    cuts = exact_quantiles(ids, ["run"], "__u", [test_share], pick="index")
    # one row per seed
    marked = ids.join(F.broadcast(cuts), "run")
    return marked.select(key, "run", F.when(F.col("__u") < F.col("q")[0], "test").otherwise("train").alias("part"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    clean, mule = F.sum((F.col(label) == 0).cast("long")), F.sum((F.col(label) == 1).cast("long"))
    return df.agg(clean.alias("n_clean"), mule.alias("n_mule"), (clean / F.greatest(F.lit(1), mule)).alias("pos_weight"))


def _weighted(df: DataFrame) -> DataFrame:
    weight = class_weight(df).select("pos_weight").scalar()
    return df.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))


def _score(model: Model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    raw = vector_to_array("probability")[1]
    return out.withColumn("score", raw).drop("rawPrediction", "probability", "prediction")


CLASSIFIERS = {
    "logistic": lambda seed: LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=100, regParam=1e-3),
    "boosted": lambda seed: GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=30, maxDepth=4, seed=seed),
    "forest": lambda seed: RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=60, maxDepth=10, seed=seed),
}


def graph_features(features: DataFrame, edges: DataFrame, columns: list[str], rounds: int = 2) -> tuple[DataFrame, list[str]]:
    """Own, one-hop and two-hop mean features: the graph part of the account model."""
    names = [*columns, *[f"{c}_hop{i}" for i in range(1, rounds + 1) for c in columns]]
    spread = graph.neighbour_mean(features, edges, columns, rounds)
    return features.select("account_id", "label").join(spread, "account_id"), names


def fit_risk(df: DataFrame, columns: list[str], kind: str = "boosted", seed: int = 42) -> DataFrame:
    """Train on part = 'train' with class weights; every row comes back with ``score``."""
    scaled = VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep").transform(standardise(df, columns, F.col("part") == "train"))
    model = CLASSIFIERS[kind](seed).fit(_weighted(scaled.filter(F.col("part") == "train")))
    return _score(model, scaled).drop("x")


def calibrate(scored: DataFrame) -> DataFrame:
    """Monotone map fitted on validation rows; ``calibrated`` for every row."""
    model = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(
        scored.filter(F.col("part") == "val").withColumn("label", F.col("label").cast("double")))
    return model.transform(scored)


def apply_isotonic(df: DataFrame, boundaries: list[float], predictions: list[float], score: str = "score", out: str = "calibrated") -> DataFrame:
    """Piecewise-linear map with clipped ends from a model's break points (a short list)."""
    xs, ys = F.array(*[F.lit(float(v)) for v in boundaries]), F.array(*[F.lit(float(v)) for v in predictions])
    s = F.col(score)
    i = F.greatest(F.lit(1), F.least(F.lit(len(boundaries) - 1), F.size(F.filter(xs, lambda b: b <= s))))
    x0, x1 = F.element_at(xs, i), F.element_at(xs, i + 1)
    y0, y1 = F.element_at(ys, i), F.element_at(ys, i + 1)
    line = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (s - x0) / (x1 - x0))
    return df.withColumn(out, F.when(s <= boundaries[0], float(predictions[0])).when(s >= boundaries[-1], float(predictions[-1])).otherwise(line))


def logistic_score(df: DataFrame, vector: str, weights: list[float], bias: float, out: str = "risk") -> DataFrame:
    """Stable sigmoid of a dot product; 0.0 without a vector."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = F.aggregate(F.zip_with(F.col(vector), w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v) + bias
    sigmoid = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return df.withColumn(out, F.when(F.col(vector).isNull(), 0.0).otherwise(sigmoid))


def risk_report(scored: DataFrame, name: str) -> DataFrame:
    """Test-part metrics at the threshold that is best on validation."""
    val, test = scored.filter(F.col("part") == "val"), scored.filter(F.col("part") == "test")
    cut = best_threshold(val).head().threshold
    counts = confusion(test, cut)
    return (counts.withColumn("model", F.lit(name)).withColumn("threshold", F.lit(cut)).withColumn("auc", roc_auc(test).select("auc").scalar())
            .withColumn("average_precision", average_precision(test).scalar()))


def baselines(df: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """Majority, best single feature, logistic and forest without the graph, on the same test rows."""
    from .audits import single_feature_f1, stack_features

    test = df.filter(F.col("part") == "test")
    majority = confusion(test.withColumn("score", F.lit(1.0)), 0.5).withColumn("model", F.lit("majority"))
    best = single_feature_f1(df.filter(F.col("part") == "train"), columns).orderBy(F.desc("best_f1"), "feature").head().feature
    column = F.col(best).cast("double")
    # direction and cut come from training and validation rows
    sign = 1.0 if (df.filter("part <> 'test'").withColumn("score", column).transform(roc_auc).head().auc >= 0.5) else -1.0
    single = df.withColumn("score", column * sign).withColumn("part", F.when(F.col("part") == "test", "test").otherwise("val"))
    reports = [risk_report(single, "single_feature"), risk_report(fit_risk(df, columns, "logistic", seed), "logistic"), risk_report(fit_risk(df, columns, "forest", seed), "forest")]
    keep = ["model", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"]
    return union_all([majority.select(*keep), *[r.select(*keep) for r in reports]])


def experiment_table(df: DataFrame, columns: list[str], configs: Iterable[dict], path: str | None = None) -> DataFrame:
    """One row of validation metrics per configuration, one thing changed at a time; appended to ``path``."""
    rows = []
    for config in configs:
        scored = fit_risk(df, config.get("columns", columns), config.get("kind", "boosted"), config.get("seed", 42))
        val = scored.filter(F.col("part") == "val")
        best = best_threshold(val)
        rows.append(best.select(F.lit(config["name"]).alias("name"), "threshold", "f1").withColumn("auc", roc_auc(val).select("auc").scalar()))
    table = union_all(rows)
    if path:
        table.withColumn("measured_at", F.current_timestamp()).write.mode("append").parquet(path)
    return table


# --- countdown --------------------------------------------------------------------------

def fit_countdown(df: DataFrame, columns: list[str], label: str = "time_to_cashout_min", rounds: int = 40, depth: int = 4, seed: int = 42):
    """Boosted trees on absolute error, stopped early on a 15 % slice of the training complaints."""
    train = df.filter(F.col("part") == "train").withColumn("hold", _unit(F.col("complaint_id"), seed + 1) < 0.15).withColumn("y", F.col(label).cast("double"))
    x = VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep")
    model = GBTRegressor(featuresCol="x", labelCol="y", lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed,
                         validationIndicatorCol="hold", predictionCol="m").fit(x.transform(train))
    return PipelineModel([x, model])


def countdown_band(scored: DataFrame, calibration: DataFrame, label: str = "time_to_cashout_min", bins: int = 5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """q05/q95 around ``m`` from residual quantiles per band of predicted value; ordered and floored at 1 minute.

    Residuals come from ``calibration`` rows (their own slice), never from the rows reported on.
    """
    cuts = exact_quantiles(calibration, [], "m", [i / bins for i in range(1, bins)]).select("q").scalar()

    def binned(df):
        return df.withColumn("__cuts", cuts).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col("m")))).drop("__cuts")

    resid = binned(calibration).withColumn("__r", F.col(label).cast("double") - F.col("m"))
    bands = exact_quantiles(resid, ["__bin"], "__r", [low, high])
    # one row per bin
    out = binned(scored).join(F.broadcast(bands), "__bin", "left").withColumn("__a", F.col("m") + F.col("q")[0]).withColumn("__b", F.col("m") + F.col("q")[1])
    return (out.withColumn("lo", F.greatest(F.lit(1.0), F.least("__a", "__b"))).withColumn("hi", F.greatest(F.lit(1.0), F.greatest("__a", "__b")))
            .withColumn("m", F.greatest(F.lit(1.0), F.col("m"))).drop("__bin", "q", "__a", "__b", "x"))


def tune_countdown(train: DataFrame, columns: list[str], grid: Iterable[dict], label: str = "time_to_cashout_min", seed: int = 42) -> DataFrame:
    """Validation MAE per setting on an inner complaint split of the training rows; test rows are never read."""
    from .evaluation import regression_report

    inner = split_by_complaint(train.drop("part"), 0.25, seed + 7)
    rows = []
    for g in grid:
        model = fit_countdown(inner, columns, label, g.get("rounds", 20), g.get("depth", 4), seed)
        val = model.transform(inner.filter(F.col("part") == "test")).withColumn("lo", F.col("m")).withColumn("hi", F.col("m"))
        rows.append(regression_report(val, label, "m").select(F.lit(str(sorted(g.items()))).alias("setting"), "mae"))
    return union_all(rows)


def save_bundle(path: str, model, **tables: DataFrame) -> None:
    """An MLlib model and its side tables (priors, weights, scaler) under one folder."""
    model.write().overwrite().save(f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_bundle(spark, path: str, *tables: str) -> tuple[PipelineModel, dict[str, DataFrame]]:
    return PipelineModel.load(f"{path}/model"), {t: spark.read.parquet(f"{path}/tables/{t}") for t in tables}
