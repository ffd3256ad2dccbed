"""Querying a table of experiment documents: filter, search, rank, compare, summarise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.plans.filters import all_of, created_between, matches
from runloom.plans.ordering import exact_median
from runloom.plans.paths import field, numeric_field, with_parsed


def newest_first(df: DataFrame, created: str, key: str) -> DataFrame:
    """Full scan, newest first; rows without a date last, ties by key."""
    return df.orderBy(F.col(created).desc_nulls_last(), F.col(key))


def query(df: DataFrame, filters: Mapping[str, Any] | None = None, doc: str = "doc", exact: bool = False) -> DataFrame:
    return df.filter(matches(df, filters, doc, exact)) if filters else df


def count_matching(df: DataFrame, filters: Mapping[str, Any] | None = None, doc: str = "doc") -> DataFrame:
    return query(df, filters, doc).agg(F.count(F.lit(1)).alias("n"))


def search(df: DataFrame, status: str | None = None, partition: str | None = None,
           min_metric: Mapping[str, float] | None = None, max_metric: Mapping[str, float] | None = None,
           created_after: str | None = None, created_before: str | None = None, *,
           status_field: str = "status", partition_field: str = "slurm.partition",
           created: str = "created_at", doc: str = "doc", exact: bool = False) -> DataFrame:
    """All given conditions at once; metric bounds and dates are inclusive."""
    filters = [(path, wanted) for path, wanted in ((status_field, status), (partition_field, partition)) if wanted]
    filters += [(path, f">={float(v)!r}") for path, v in (min_metric or {}).items()]
    filters += [(path, f"<={float(v)!r}") for path, v in (max_metric or {}).items()]
    bounds = []
    if created_after is not None or created_before is not None:
        bounds.append(created_between(df, created, created_after, created_before))
    return df.filter(matches(df, filters, doc, exact) & all_of(bounds))


def with_status(df: DataFrame, status: str, column: str = "status") -> DataFrame:
    """Exact status; ``'all'`` keeps everything, a missing status counts as ``'unknown'``."""
    if status == "all":
        return df
    if status == "unknown":
        return df.filter(F.col(column).isNull() | (F.col(column) == status))
    return df.filter(F.col(column) == status)


def with_any_tag(df: DataFrame, tags: Sequence[str], column: str = "tags") -> DataFrame:
    return df.filter(F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in tags])))


def with_attributes(df: DataFrame, **wanted: Any) -> DataFrame:
    """Equality on plain attributes; ``None`` means no condition."""
    return df.filter(all_of([F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]))


def in_known_set(df: DataFrame, column: str, known: Sequence[str] | DataFrame) -> DataFrame:
    """Keep rows whose value is in a list, or in the one column of a table."""
    if isinstance(known, DataFrame):
        return df.join(known.select(F.col(known.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(list(known)))


def best(df: DataFrame, metric: str, n: int = 10, ascending: bool = True, *,
         created: str = "created_at", key: str = "key", doc: str = "doc") -> DataFrame:
    """The N best by a numeric path; no value drops out, ties go to the newer document."""
    value = numeric_field(df, metric, doc)
    order = value.asc() if ascending else value.desc()
    return df.filter(value.isNotNull()).orderBy(order, F.col(created).desc_nulls_last(), F.col(key)).limit(n)


def first_newest(df: DataFrame, n: int = 10, filters: Mapping[str, Any] | None = None, *,
                 created: str = "created_at", key: str = "key", doc: str = "doc") -> DataFrame:
    return newest_first(query(df, filters, doc), created, key).limit(n)


def largest(df: DataFrame, score: str, n: int, key: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), F.col(key)).limit(n)


def best_row_per(df: DataFrame, group: Sequence[str], score: str, key: str) -> DataFrame:
    """The row with the highest score of each group, the smaller key on ties; keys may be text."""
    rank = F.struct(-F.col(score), F.col(key))
    others = [c for c in df.columns if c not in group]
    picked = (df.filter(F.col(score).isNotNull()).groupBy(*group)
              .agg(F.min_by(F.struct(*others), rank).alias("_row")))
    return picked.select(*group, "_row.*")


def listed_first(df: DataFrame, column: str, priority: Sequence[str]) -> DataFrame:
    """Rows named in ``priority`` first, each part sorted by name."""
    return df.orderBy(~F.col(column).isin(list(priority)), F.col(column))


def compare(df: DataFrame, requested: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Requested experiments side by side in the requested order; unknown ids are left out."""
    return requested.join(df, key).orderBy(position)


def request_list(df: DataFrame, ids: Sequence[Any], key: str, position: str = "position") -> DataFrame:
    """A requested-ids table typed like ``df``'s key."""
    kind = df.schema[key].dataType.simpleString()
    rows = list(enumerate(map(str, ids)))
    return (df.sparkSession.createDataFrame(rows, f"`{position}` int, `{key}` string")
            .withColumn(key, F.col(key).cast(kind)))


def metric_statistics(df: DataFrame, metrics: Sequence[str], doc: str = "doc", with_median: bool = True) -> DataFrame:
    """count, min, max, mean, median and sample deviation per numeric metric.

    One row per metric that has any value; the deviation of a single value is 0. All metrics
    share one scan by unpivoting; the median is exact and never gathers a metric in one task.
    """
    arms = F.array(*[F.struct(F.lit(m).alias("metric"), numeric_field(df, m, doc).alias("value")) for m in metrics])
    values = df.select(F.explode(arms).alias("_m")).select("_m.*").filter("value IS NOT NULL")
    summary = values.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))
    if not with_median:
        return summary
    return summary.join(exact_median(values, ["metric"], "value", groups_at_most=len(metrics)), "metric")


def group_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                               F.count(value).alias("count"))


def project_fields(df: DataFrame, paths: Sequence[str], doc: str = "doc") -> DataFrame:
    """Dotted paths as text columns named like the paths."""
    parsed, value = with_parsed(df, paths, doc)
    return parsed.select(*[value(p).alias(p) for p in paths])
