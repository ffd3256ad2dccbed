"""Attempt groups: order and summary of repeated runs of one configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.ids import attempt_group_id
from runloom.plans.ordering import ordered_position, time_blocks


def with_group(runs: DataFrame, keys: Sequence[Column], exp_id: str = "exp_id") -> DataFrame:
    return runs.withColumn("attempt_group_id", attempt_group_id(F.col(exp_id), keys))


def assign_orders(runs: DataFrame, stamp: str = "attempt_timestamp", seq: str = "seq",
                  group: str = "attempt_group_id", block: int = 1 << 20) -> DataFrame:
    """1-based attempt order per group by time stamp text (missing first), then ``seq``."""
    return ordered_position(
        runs.filter(F.col(group).isNotNull()), [group],
        [F.coalesce(F.col(stamp), F.lit("")), F.col(seq)],
        time_blocks(stamp, seq, block), "attempt_order")


def build_summaries(runs: DataFrame, score: str = "avg_score", stamp: str = "attempt_timestamp", seq: str = "seq",
                    run: str = "run_id", exp_id: str = "exp_id", group: str = "attempt_group_id") -> DataFrame:
    """One row per group; statistics over positive scores, counts over all attempts.

    Best is the highest score (missing counts as 0), the earlier attempt on ties. All parts are
    partial aggregates: a hot group costs one buffer per task.
    """
    positive = F.when(F.col(score) > 0, F.col(score))
    time = F.coalesce(F.col(stamp), F.lit(""))
    value = F.coalesce(F.col(score), F.lit(0.0))
    zero = F.lit(0.0)
    # Earliest among the best: the smallest (-score, time, seq).
    return runs.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.max_by(F.col(exp_id), F.struct(time, F.col(seq))).alias("exp_id"),
        F.count(F.lit(1)).alias("attempts_count"),
        F.coalesce(F.avg(positive), zero).alias("mean_score"),
        F.coalesce(F.stddev_samp(positive), zero).alias("std_score"),
        F.coalesce(F.min(positive), zero).alias("min_score"),
        F.coalesce(F.max(positive), zero).alias("max_score"),
        F.max_by(F.col(run), F.struct(time, F.col(seq))).alias("latest_attempt_id"),
        F.min_by(F.col(run), F.struct(-value, time, F.col(seq))).alias("best_attempt_id"))


#: Fields of a group's partial summary, which two of a group can be merged in.
PARTIAL = ("n long, scored long, mean double, m2 double, low double, high double, "
           "latest struct<time:string,seq:{seq},exp_id:string,run:string>, best struct<score:double,time:string,seq:{seq},run:string>")


def partial_summaries(runs: DataFrame, score: str = "avg_score", stamp: str = "attempt_timestamp", seq: str = "seq",
                      run: str = "run_id", exp_id: str = "exp_id", group: str = "attempt_group_id") -> DataFrame:
    """Counts, moments, extremes, latest and best run of each group, in a form that further runs can be merged into."""
    positive = F.when(F.col(score) > 0, F.col(score))
    time, value = F.coalesce(F.col(stamp), F.lit("")), F.coalesce(F.col(score), F.lit(0.0))
    return runs.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count(positive).alias("scored"), F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(positive) * F.count(positive), F.lit(0.0)).alias("m2"), F.min(positive).alias("low"), F.max(positive).alias("high"),
        F.max(F.struct(time.alias("time"), F.col(seq).alias("seq"), F.col(exp_id).alias("exp_id"), F.col(run).alias("run"))).alias("latest"),
        F.min(F.struct((-value).alias("score"), time.alias("time"), F.col(seq).alias("seq"), F.col(run).alias("run"))).alias("best"))


def merge_partials(before: DataFrame, delta: DataFrame, group: str = "attempt_group_id") -> DataFrame:
    """Partial summaries of both; moments are merged about the common mean, so nothing cancels."""
    names = [c for c in delta.columns if c != group]
    a, b = (df.select(F.col(group), F.struct(*names).alias(side)) for df, side in ((before, "a"), (delta, "b")))
    count = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(0))
    scored = count("a", "scored") + count("b", "scored")
    apart = count("b", "mean") - count("a", "mean")
    share = F.when(scored > 0, count("b", "scored") / scored).otherwise(0.0)
    # greatest and least skip NULLs.
    return a.join(b, group, "full").select(
        group, (count("a", "n") + count("b", "n")).alias("n"), scored.alias("scored"), (count("a", "mean") + apart * share).alias("mean"),
        (count("a", "m2") + count("b", "m2") + apart * apart * share * count("a", "scored")).alias("m2"),
        F.least("a.low", "b.low").alias("low"), F.greatest("a.high", "b.high").alias("high"),
        F.when(F.col("a.n").isNull() | (F.col("b.latest") >= F.col("a.latest")), F.col("b.latest")).otherwise(F.col("a.latest")).alias("latest"),
        F.when(F.col("a.n").isNull() | (F.col("b.best") < F.col("a.best")), F.col("b.best")).otherwise(F.col("a.best")).alias("best"))


def finish_summaries(partials: DataFrame, group: str = "attempt_group_id") -> DataFrame:
    """The columns of ``build_summaries`` from partial summaries."""
    zero = F.lit(0.0)
    return partials.select(
        group, F.col("latest.exp_id").alias("exp_id"), F.col("n").alias("attempts_count"), F.col("mean").alias("mean_score"),
        F.when(F.col("scored") > 1, F.sqrt(F.col("m2") / (F.col("scored") - 1))).otherwise(zero).alias("std_score"),
        F.coalesce("low", zero).alias("min_score"), F.coalesce("high", zero).alias("max_score"),
        F.col("latest.run").alias("latest_attempt_id"), F.col("best.run").alias("best_attempt_id"))
