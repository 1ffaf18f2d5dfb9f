"""Evaluation metrics, class weights and baseline forecasts as aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import fixed_values as fx
from wardgrid.operators.slices import running_totals
from wardgrid.operators.timeline import TICKS, Timeline
from wardgrid.session import store


def ranking_quality(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """AUROC (average ranks for ties) and average precision (equal scores form one step) per key.

    Equal scores collapse before anything is ordered; running totals go by ranges of scores, so no
    task orders all scores, however close they lie. One class only gives NULL.
    """
    keys = list(keys)
    group = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    steps = rows.groupBy(*group, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    steps = store(steps)
    run = running_totals(steps, group, ["_s"], {"_cp": "_pos", "_cn": "_neg"})
    totals = steps.groupBy(*group).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    joined = run.join(totals, group)
    below = F.col("_cn") - F.col("_neg")
    at_least = F.col("_p") - F.col("_cp") + F.col("_pos")
    wrong = F.col("_n") - below
    out = joined.groupBy(*group).agg(
        F.max("_p").alias("positives"), F.max("_n").alias("negatives"),
        F.sum(F.col("_pos") * (below + F.col("_neg") / 2.0)).alias("_u"),
        F.sum(F.col("_pos") * at_least / (at_least + wrong)).alias("_ap"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.select(
        *keys, "positives", "negatives",
        F.when(both, F.col("_u") / (F.col("positives") * F.col("negatives"))).alias("auroc"),
        F.when(both, F.col("_ap") / F.col("positives")).alias("average_precision"))


def macro_micro(scores: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Macro (mean of the defined classes, 0.5 if none) and micro (all pairs together) AUROC."""
    macro = ranking_quality(scores, [key], score, label).agg(
        F.coalesce(F.avg("auroc"), F.lit(0.5)).alias("macro_auroc"), F.lit(0).alias("_k"))
    micro = ranking_quality(scores, [], score, label).select(
        F.col("auroc").alias("_micro"), F.lit(0).alias("_k"))
    return macro.join(micro, "_k").select(
        "macro_auroc", F.coalesce("_micro", "macro_auroc").alias("micro_auroc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def threshold_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: Column) -> DataFrame:
    """Confusion counts and rates at a threshold; a zero denominator gives 0."""
    hit, truth = F.col(score) >= threshold, F.col(label) == 1
    out = df.groupBy(*keys).agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"), F.count_if(~hit & ~truth).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2.0 * tp, 2.0 * tp + fp + fn), "specificity": _ratio(tn, tn + fp),
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "prevalence": _ratio(tp + fn, tp + fp + fn + tn)})


def brier(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    error = F.pow(F.col(score) - F.col(label), 2)
    return df.groupBy(*keys).agg(F.avg(error).alias("brier"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width score bin."""
    number = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed_rate"))


def comparison_table(results: DataFrame, model: str = "model", metric: str = "metric", value: str = "value",
                     metrics: Sequence[str] = ("auroc", "average_precision", "f1")) -> DataFrame:
    """One row per model, one column per metric."""
    return results.groupBy(model).pivot(metric, list(metrics)).agg(F.max(value))


# ---- weights -------------------------------------------------------------------------------------

def positive_weights(labels: DataFrame, columns: Sequence[str], low: float = 1.0, high: float = 25.0) -> DataFrame:
    """Negatives / positives per label, cut to [low, high]; 1 without positives."""
    counts = labels.agg(*[F.struct(F.count_if(F.col(c) == 1).alias("p"), F.count(F.lit(1)).alias("n")).alias(c)
                          for c in columns])
    tall = counts.unpivot([], list(columns), "label", "c")
    p, n = F.col("c.p"), F.col("c.n")
    weight = F.when(p > 0, (n - p) / (p + 1e-6)).otherwise(1.0)
    return tall.select("label", F.least(F.greatest(weight, F.lit(low)), F.lit(high)).alias("weight"))


def prevalence(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = labels.agg(*[F.struct(F.count_if(F.col(c) == 1).alias("p"), F.count(F.lit(1)).alias("n")).alias(c)
                          for c in columns])
    tall = counts.unpivot([], list(columns), "label", "c")
    pct = F.round(F.col("c.p") * 100.0 / F.greatest(F.col("c.n"), F.lit(1)), 2)
    return tall.select("label", F.col("c.p").alias("positives"), pct.alias("prevalence_pct"))


def class_weights(windows: DataFrame, column: str, classes: int = 3, mask: str | None = None) -> DataFrame:
    """n / (classes * max(count, 1)) for every class, over masked rows only if a mask is given."""
    rows = windows.where(F.col(mask) == 1) if mask else windows
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col(column) == k).alias(f"class_{k}") for k in range(classes)])
    weights = F.array(*[F.struct(F.lit(k).alias("class"), (
        F.col("n") / (float(classes) * F.greatest(F.col(f"class_{k}"), F.lit(1)))).alias("weight"))
        for k in range(classes)])
    return counts.select(F.explode(weights).alias("w")).select("w.*")


def deterioration_weight(windows: DataFrame) -> DataFrame:
    positives = F.count_if(F.col("deterioration") == 1)
    return windows.agg(((F.count(F.lit(1)) - positives) / F.greatest(F.lit(1), positives)).alias("pos_weight"))


def forecast_points(windows: DataFrame, ids: Sequence[str] = (), channels: Sequence[str] = tuple(fx.FORECAST_CHANNELS),
                    predicted: Mapping[str, Column] | None = None, steps: int = 4) -> DataFrame:
    """Valid future points as rows (ids, channel, step, y[, prediction columns])."""
    cells = []
    for i, c in enumerate(channels):
        for k in range(steps):
            fields = [F.lit(c).alias("channel"), F.lit(k + 1).alias("step"), F.col("forecast")[k][i].alias("y"),
                      F.col("forecast_mask")[k][i].alias("_m")]
            if predicted is not None:
                fields.append(predicted[c].alias("p"))
            cells.append(F.struct(*fields))
    rows = windows.select(*ids, F.explode(F.array(*cells)).alias("c")).where("c._m = 1")
    return rows.select(*ids, "c.*").drop("_m")


def channel_variance(points: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Population variance of the valid targets per channel, its share of the sum, and the loss scale."""
    stats = points.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.var_pop("y").alias("variance"))
    share = F.col("variance") * 100.0 / F.sum("variance").over(Window.partitionBy(F.lit(0)))
    return stats.withColumns({"share_pct": share, "scale": F.greatest("variance", F.lit(floor))})


# ---- baselines -----------------------------------------------------------------------------------

def baseline_predictions(t: Timeline, medians: Mapping[str, float], channels: Sequence[str] = tuple(fx.FORECAST_CHANNELS),
                         rows: int = 4) -> Timeline:
    """Causal forecasts: `last_c` repeats the current value, `avg_c` is the mean of the last rows.

    Without a value both fall back to the train median.
    """
    frame = f"{TICKS} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
    return t.with_df(t.df.selectExpr(
        "*", *[f"coalesce({c}, {medians[c]!r}D) AS last_{c}" for c in channels],
        *[f"coalesce(avg({c}) OVER ({frame}), {medians[c]!r}D) AS avg_{c}" for c in channels]))


def forecast_errors(points: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """MAE, RMSE and R2 per key and overall ('all'); R2 is 0 with one point or no spread."""
    error = F.col("p") - F.col("y")
    def summarise(group: DataFrame) -> DataFrame:
        out = group.agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
            F.sum(error * error).alias("_sse"), F.var_pop("y").alias("_v"))
        r2 = F.when((F.col("n") > 1) & (F.col("_v") > 1e-6), 1.0 - F.col("_sse") / (F.col("_v") * F.col("n"))).otherwise(0.0)
        return out.withColumn("r2", r2).drop("_sse", "_v")

    overall = summarise(points.groupBy(F.lit("all").alias(keys[0]), *keys[1:]))
    return summarise(points.groupBy(*keys)).unionByName(overall)
