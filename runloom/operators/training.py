"""Training scalars: per-tag summaries, series, preferred metrics and the join with evaluations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.plans.ordering import ordered_position

# Tags that can hold a metric, in order of preference.
PREFERRED_TAGS = {
    "train_loss": ["train_loss", "train/loss", "loss", "train_loss_epoch"],
    "val_loss": ["val_loss", "val/loss", "validation_loss", "val_loss_epoch"],
    "epoch": ["epoch", "epochs"],
    "lr": ["lr", "learning_rate", "lr-AdamW", "train/lr"],
}


def scalar_summary(scalars: DataFrame, by: Sequence[str] = ("exp_id", "tag"), step: str = "step",
                   value: str = "value") -> DataFrame:
    """Last value and step, min, max and count per tag; of a repeated step the largest value counts as the last."""
    return scalars.groupBy(*by).agg(
        F.max_by(F.col(value), F.struct(step, value)).alias("last_value"), F.max(step).alias("last_step"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.count(F.lit(1)).alias("num_values"))


def scalar_series(scalars: DataFrame, by: Sequence[str] = ("exp_id", "tag"), step: str = "step",
                  value: str = "value", block: int = 1 << 20) -> DataFrame:
    """Every point with its 0-based position by step, then value (the ordered series, one row a point)."""
    numbered = ordered_position(scalars, by, [F.col(step), F.col(value)], [("range", F.floor(F.col(step) / block))], "_position")
    return numbered.withColumn("position", F.col("_position") - 1).drop("_position")


def series_chunks(series: DataFrame, by: Sequence[str] = ("exp_id", "tag"), step: str = "step",
                  value: str = "value", size: int = 65536) -> DataFrame:
    """The series as step and value arrays of at most ``size`` points per row, whole over all chunks."""
    keyed = series.withColumn("chunk", F.floor(F.col("position") / size))
    points = F.array_sort(F.collect_list(F.struct(step, value)))
    return (keyed.groupBy(*by, "chunk").agg(points.alias("_p"))
            .select(*by, "chunk", F.col(f"_p.{step}").alias("steps"), F.col(f"_p.{value}").alias("values")))


def training_summary(summary: DataFrame, exp_id: str = "exp_id",
                     preferred: Mapping[str, Sequence[str]] = PREFERRED_TAGS) -> DataFrame:
    """Per experiment: loss and rate columns, each from its first tag that is present."""

    def pick(metric: str, column: str) -> Column:
        return F.coalesce(*[F.max(F.when(F.col("tag") == tag, F.col(column))) for tag in preferred[metric]])

    return summary.groupBy(exp_id).agg(
        pick("train_loss", "last_value").alias("train_loss_last"),
        pick("train_loss", "min_value").alias("train_loss_min"),
        pick("val_loss", "last_value").alias("val_loss_last"),
        pick("val_loss", "min_value").alias("val_loss_min"),
        pick("epoch", "last_value").cast("bigint").alias("epochs"),
        pick("lr", "last_value").alias("final_lr"))


def with_log_values(summary: DataFrame, parsed_logs: DataFrame, exp_id: str = "exp_id") -> DataFrame:
    """Experiments without scalars take epochs and losses from their parsed training log."""
    logs = parsed_logs.select(exp_id, F.col("epochs").alias("_e"), F.col("train_loss").alias("_t"),
                              F.col("val_loss").alias("_v"))
    joined = summary.withColumn("_own", F.lit(True)).join(logs, exp_id, "full_outer")
    own = F.col("_own").isNotNull()
    return joined.withColumns({
        "train_loss_last": F.when(own, F.col("train_loss_last")).otherwise(F.col("_t")),
        "val_loss_last": F.when(own, F.col("val_loss_last")).otherwise(F.col("_v")),
        "epochs": F.when(own, F.col("epochs")).otherwise(F.col("_e")),
    }).drop("_own", "_e", "_t", "_v")


def merge_evaluations(training: DataFrame, evaluations: DataFrame, exp_id: str = "exp_id",
                      metrics: str | None = None, metric_names: Sequence[str] = ()) -> DataFrame:
    """Training ⟗ evaluation; an empty side leaves the other alone. Map metrics become ``eval_*``."""
    if metrics is not None:
        lifted = [F.try_element_at(F.col(metrics), F.lit(m)).alias(f"eval_{m}") for m in metric_names]
        evaluations = evaluations.select(*[c for c in evaluations.columns if c != metrics], *lifted)
    return training.join(evaluations, exp_id, "full_outer")


def split_prefixed(evaluations: DataFrame, names: Sequence[str], exp_id: str = "exp_id", split: str = "eval_split",
                   metric: str = "metric", value: str = "value") -> DataFrame:
    """Long metrics as one row per experiment with ``{split}_{metric}`` columns.

    The prefix is left off for an unknown split. Column names are given, so one pass suffices.
    """
    known = F.col(split).isNotNull() & ~F.col(split).isin("", "unknown")
    label = F.when(known, F.concat(F.col(split), F.lit("_"), F.col(metric))).otherwise(F.col(metric))
    columns = [F.max(F.when(label == n, F.col(value))).alias(n) for n in names]
    return evaluations.filter(F.col(metric) != "num_scenarios").groupBy(exp_id).agg(*columns)
