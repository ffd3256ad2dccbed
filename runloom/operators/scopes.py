"""Aggregation of evaluation rows per scope, and of scopes per experiment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.plans.ordering import top_per_group

SUMMARY_TOKEN = "average_all_frames"


@dataclass(frozen=True)
class ScopeRules:
    """What evaluation rows look like.

    ``columns`` maps a short metric name to candidate source columns, tried in order. Where both
    ``comfort`` columns exist, their composite replaces the metric ``comfort_name``.
    """

    scopes: Sequence[str] = ()
    columns: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"score": ["score"]})
    primary: str = "score"
    overall: str = "all"
    token: str = "token"
    summary_token: str = SUMMARY_TOKEN
    keep: Callable[[DataFrame], Column] | None = None
    comfort: tuple[str, str] | None = None
    comfort_name: str = "C"


def without_summary_rows(df: DataFrame, rules: ScopeRules = ScopeRules()) -> DataFrame:
    """Drop summary rows, if there is a token column at all; NULL tokens stay."""
    if rules.keep is not None:
        return df.filter(rules.keep(df))
    if rules.token not in df.columns:
        return df
    return df.filter(~F.col(rules.token).eqNullSafe(F.lit(rules.summary_token)))


def newest_per(df: DataFrame, group: Sequence[str], stamp: str, tie: str) -> DataFrame:
    """Newest file or directory per group, ties by the larger path."""
    return top_per_group(df, group, [F.col(stamp).desc_nulls_last(), F.col(tie).desc()])


def scope_means(df: DataFrame, rules: ScopeRules, by: Sequence[str] = ("exp_id", "scope")) -> DataFrame:
    """Row count and metric means per scope; NULL values and NaN do not count.

    A metric takes its first candidate column that has any value in the scope. Means are built
    from per-task partial sums, so one scope may hold most of the rows.
    """
    rows = without_summary_rows(df, rules)
    means = []
    for short, candidates in rules.columns.items():
        pair = rules.comfort if short == rules.comfort_name else None
        if pair and all(c in df.columns for c in pair):
            means.append(comfort(*[_number(c) for c in pair]).alias(short))
            continue
        parts = [F.avg(_number(c)) for c in candidates if c in df.columns]
        means.append((F.coalesce(*parts) if parts else F.lit(None).cast("double")).alias(short))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("scenarios"), *means)


def _number(column: str) -> Column:
    """The column as DOUBLE with NaN read as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def comfort(first: Column, second: Column) -> Column:
    """Aggregate: mean of two comfort columns' means, missing values counted as 1."""
    return (F.avg(F.coalesce(first, F.lit(1.0))) + F.avg(F.coalesce(second, F.lit(1.0)))) / 2


def weighted_scores(means: DataFrame, metrics: Sequence[str], overall: str = "all", by: Sequence[str] = ("exp_id",),
                    strict_weights: bool = False) -> DataFrame:
    """Scenario-weighted metric means over the scopes other than the overall one.

    The weight total counts all scenarios of those scopes even where a metric is missing, unless
    ``strict_weights`` asks for covered scenarios only.
    """
    counted = F.col("scope") != overall
    n = F.when(counted, F.col("scenarios"))
    columns = []
    for m in metrics:
        weight = F.sum(F.when(F.col(m).isNotNull(), n)) if strict_weights else F.sum(n)
        total = F.coalesce(F.sum(F.col(m) * n), F.lit(0.0))
        columns.append(F.when(weight > 0, total / weight).alias(m))
    return means.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias("total_scenarios"), *columns)


def headline(means: DataFrame, rules: ScopeRules, by: Sequence[str] = ("exp_id",)) -> DataFrame:
    """Per experiment: overall score if there is one, else the weighted one, and its scenarios.

    Scopes are few (the declared ones and the overall), so a map of them per experiment is small.
    """
    means = means.filter(F.col("scenarios") > 0)
    m = F.col(rules.primary)
    is_overall = F.col("scope") == rules.overall
    n = F.when(~is_overall, F.col("scenarios"))
    overall_n = F.max(F.when(is_overall, F.col("scenarios")))
    total = F.coalesce(F.sum(n), F.lit(0).cast("bigint"))
    weighted = F.when(F.sum(n) > 0, F.coalesce(F.sum(m * n), F.lit(0.0)) / F.sum(n))
    metrics = list(rules.columns)
    return means.groupBy(*by).agg(
        F.max(F.when(is_overall, m)).alias("overall_score"),
        weighted.alias("weighted_score"),
        F.coalesce(F.max(F.when(is_overall, m)), weighted).alias("primary_score"),
        F.coalesce(overall_n, total).alias("total_scenarios"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("scope", F.struct("scenarios", *metrics))))).alias("scopes"))


def with_empty(ids: DataFrame, summary: DataFrame, by: Sequence[str] = ("exp_id",)) -> DataFrame:
    """Experiments without any scope keep an empty record (no score, 0 scenarios)."""
    return ids.join(summary, list(by), "left").withColumn(
        "total_scenarios", F.coalesce(F.col("total_scenarios"), F.lit(0).cast("bigint")))


def cross_scope_summary(scopes: DataFrame, metrics: Sequence[str], score: str = "score", overall: str = "all",
                        by: Sequence[str] = ("exp_id",)) -> DataFrame:
    """Totals over per-scope results with a ``status``.

    Only SUCCESS scopes with scenarios enter the weighted mean and the total; without any the
    overall scope stands alone, else 0. Sub-metric means are unweighted over the per-scope
    results, or over the overall one when it is the only result.
    """
    is_overall = F.col("scope") == overall
    used = (F.col("status") == "SUCCESS") & (F.col("scenarios") > 0) & ~is_overall
    used_n = F.sum(F.when(used, F.col("scenarios")))
    used_score = F.sum(F.when(used, F.coalesce(F.col(score), F.lit(0.0)) * F.col("scenarios")))
    overall_n = F.max(F.when(is_overall, F.col("scenarios")))
    overall_score = F.max(F.when(is_overall, F.coalesce(F.col(score), F.lit(0.0))))
    has_parts = F.max((~is_overall).cast("int")) == 1
    subs = [F.when(has_parts, F.avg(F.when(~is_overall, F.col(m)))).otherwise(F.avg(m)).alias(f"avg_{m}")
            for m in metrics]
    return scopes.groupBy(*by).agg(
        F.coalesce(F.when(used_n > 0, used_n), overall_n, F.lit(0).cast("bigint")).alias("total_scenarios"),
        F.coalesce(F.when(used_n > 0, used_score / used_n), overall_score, F.lit(0.0)).alias("average_score"),
        *subs)


def scope_status(score: Column, log_status: Column | None = None) -> Column:
    """SUCCESS for a positive score, unless the log says SUCCESS or FAILED."""
    guess = F.when(score > 0, "SUCCESS").otherwise("UNKNOWN")
    if log_status is None:
        return guess
    return F.when(log_status.isin("SUCCESS", "FAILED"), log_status).otherwise(guess)


def with_log_fallback(dirs: DataFrame, csv_results: DataFrame, log_results: DataFrame,
                      keys: Sequence[str] = ("exp_id", "scope")) -> DataFrame:
    """Scope results from CSV rows; a scope without readable rows takes its parsed log's values."""
    own = csv_results.select(*keys, F.col("scenarios").alias("_n"), F.col("score").alias("_s"),
                             F.col("status").alias("_st"))
    logs = log_results.select(*keys, F.col("scenarios").alias("_ln"), F.col("score").alias("_ls"),
                              F.col("status").alias("_lst"))
    joined = dirs.select(*keys).join(own, list(keys), "left").join(logs, list(keys), "left")
    from_csv = F.col("_n") > 0
    return joined.filter(from_csv | F.col("_lst").isNotNull()).select(
        *keys,
        F.when(from_csv, F.col("_n")).otherwise(F.col("_ln")).alias("scenarios"),
        F.coalesce(F.when(from_csv, F.col("_s")).otherwise(F.col("_ls")), F.lit(0.0)).alias("score"),
        F.when(from_csv, F.col("_st")).otherwise(F.col("_lst")).alias("status"),
        F.when(from_csv, "csv").otherwise("log").alias("source"))


def generalisation_gap(scopes: DataFrame, home: str, score: str = "score", by: Sequence[str] = ("exp_id",),
                       count_overall: bool = True, overall: str = "all") -> DataFrame:
    """Score on the home scope, mean score elsewhere and the gap in percent of the former.

    The overall scope counts as elsewhere unless ``count_overall`` is off.
    """
    trained = F.lower(F.trim(F.coalesce(F.col(home), F.lit(""))))
    at_home = (F.col("scope") == trained) & ~trained.isin("", overall)
    elsewhere = F.col("scope") != trained
    if not count_overall:
        elsewhere = elsewhere & (F.col("scope") != overall)
    inside = F.max(F.when(at_home, F.col(score)))
    outside = F.avg(F.when(elsewhere, F.col(score)))
    return scopes.groupBy(*by).agg(
        inside.alias("in_dist_score"), outside.alias("out_dist_avg"),
        F.when(inside != 0, (inside - outside) / inside * 100).alias("gap_percent"))
