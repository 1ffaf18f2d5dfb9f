"""MLlib baselines on the flattened history matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators import forests
from wardgrid.operators.metrics import ranking_quality, threshold_metrics
from wardgrid.operators.scaling import Scaler
from wardgrid.operators.targets import is_window
from wardgrid.operators.timeline import Timeline
from wardgrid.operators.windows import history_ticks
from wardgrid.session import store


def seeded_sample(rows: DataFrame, n: int, seed: int = 42, ids: Sequence[str] = ("stay_id", "tick")) -> DataFrame:
    """At most n rows in seeded hash order (a top-n, never a full sort)."""
    order = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    return rows.withColumn("_h", order).orderBy("_h", *ids).limit(n).drop("_h")


def as_vectors(windows: DataFrame) -> DataFrame:
    """history x features flattened into one vector column."""
    return windows.withColumn("features", array_to_vector(F.flatten("X").cast("array<double>")))


def classifier(kind: str):
    if kind == "logistic_regression":
        return LogisticRegression(labelCol="deterioration", maxIter=500)
    if kind == "random_forest":
        return RandomForestClassifier(labelCol="deterioration", numTrees=50, maxDepth=8, seed=42)
    raise ValueError(f"unknown classifier {kind}")


def classify(windows: DataFrame, kind: str, split: str = "test", sample: int = 3000) -> DataFrame:
    """Fit on a seeded train sample with a valid target; probabilities of the wanted split."""
    valid = windows.where("deterioration_mask = 1")
    train = store(as_vectors(seeded_sample(valid.where("split = 'train'"), sample)).select("features", "deterioration"))
    model = classifier(kind).fit(train)
    scored = model.transform(as_vectors(valid.where(F.col("split") == split)))
    return scored.select("stay_id", "tick", "deterioration", vector_to_array("probability")[1].alias("score"))


def scored_facts(scored: DataFrame, kind: str, label: str = "deterioration") -> DataFrame:
    """Rows, positives, probabilities within 0 and 1, and how far the report's rates are from plain averages over the rows."""
    hit, truth = F.col("score") >= 0.5, F.col(label) == 1
    rows = scored.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.count_if(F.col("score").between(0, 1)).alias("in_range"),
        F.avg((hit == truth).cast("double")).alias("_accuracy"), F.avg(F.when(hit, truth.cast("double"))).alias("_precision"),
        F.avg(F.when(truth, hit.cast("double"))).alias("_recall"), F.lit(0).alias("_k"))
    gaps = [F.abs(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0))) for c in ("accuracy", "precision", "recall")]
    # both have one row
    return rows.join(classification_report(scored, kind).withColumn("_k", F.lit(0)), "_k").select(
        "model", "n", "positives", "in_range", F.round(F.greatest(*gaps), 9).alias("rate_gap"))


def evaluated(scored: DataFrame, kind: str, label: str = "deterioration") -> DataFrame:
    """The classification report of scored rows, with their number and that of the positives."""
    rows = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.lit(0).alias("_k"))
    # both have one row
    return rows.join(classification_report(scored, kind).withColumn("_k", F.lit(0)), "_k").drop("_k")


def classification_report(scored: DataFrame, kind: str) -> DataFrame:
    ranks = ranking_quality(scored, [], "score", "deterioration").withColumn("_k", F.lit(0))
    rates = threshold_metrics(scored.withColumn("_k", F.lit(0)), ["_k"], "score", "deterioration", F.lit(0.5))
    return ranks.join(rates, "_k").select(
        F.lit(kind).alias("model"), "auroc", "average_precision", "accuracy", "precision", "recall", "f1")


def forest_forecasts(t: Timeline, scaler: Scaler, split: str = "test", channels: Sequence[str] = tuple(fx.FORECAST_CHANNELS),
                     steps: Sequence[int] = (1, 2, 3, 4), trees: int = 30, depth: int = 8) -> DataFrame:
    """One forest for all channels and steps, fitted on all train windows of a timeline with features, targets and split; targets that
    were not observed take no part.

    Rows (stay_id, tick, channel, step, y, p) of the valid future points of the wanted split.
    """
    width = len(fx.FORECAST_CHANNELS)
    ticks = history_ticks(t.with_df(t.df.where(F.col("split").isin("train", split))), keep=is_window(t), others=[
        F.col("split"), F.xxhash64("stay_id", "tick").alias("key"), F.flatten("forecast").alias("y"), F.flatten("forecast_mask").alias("mask")])
    forest, kept = forests.fit_runs(ticks, fx.FEATURES, t.spec.history, width * t.spec.horizon, trees, depth, scaler=scaler)
    scored = forests.predicted_runs(kept.where(F.col("split") == split), forest, t.spec.history)
    cells = [F.struct(F.lit(c).alias("channel"), F.lit(k).alias("step"), *[
        F.col(v)[(k - 1) * width + fx.FORECAST_CHANNELS.index(c)].alias(n) for v, n in (("y", "y"), ("predicted", "p"), ("mask", "_m"))])
        for c in channels for k in steps]
    return scored.select("stay_id", "tick", F.explode(F.array(*cells)).alias("c")).where("c._m = 1").select("stay_id", "tick", "c.*").drop("_m")
