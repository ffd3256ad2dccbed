"""Log files: choosing the latest, parsing, last lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.logtext import (EPOCH_LOSS_PATTERN, VAL_LOSS_PATTERN, LogPatterns, last_lines, log_result, parse_log,
                                       parse_training_log)
from runloom.functions.names import file_name
from runloom.plans.ordering import null_safe_join, top_per_group


def latest_log(logs: DataFrame, by: Sequence[str] = ("exp_id",), path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Per group the log with the highest ``_<digits>.out`` number, then the newest, then by path."""
    job = F.coalesce(F.nullif(F.regexp_extract(file_name(F.col(path)), r"_(\d+)\.out$", 1), F.lit(""))
                     .try_cast("bigint"), F.lit(0).cast("bigint"))
    return logs.groupBy(*by).agg(F.max_by(F.col(path), F.struct(job, F.col(mtime), F.col(path))).alias(path))


def newest_log(logs: DataFrame, by: Sequence[str] = ("exp_id",), path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Per group the newest log by modification time only."""
    return logs.groupBy(*by).agg(F.max_by(F.col(path), F.struct(F.col(mtime), F.col(path))).alias(path))


def parsed(logs: DataFrame, text: str = "value", patterns: LogPatterns = LogPatterns()) -> DataFrame:
    return logs.withColumn("_p", parse_log(F.col(text), patterns)).select(
        *[c for c in logs.columns if c != text], "_p.*")


def parsed_training(logs: DataFrame, text: str = "value") -> DataFrame:
    return logs.withColumn("_p", parse_training_log(F.col(text))).select(
        *[c for c in logs.columns if c != text], "_p.*")


def tail_lines(logs: DataFrame, n: int = 50, text: str = "value", key: str = "path") -> DataFrame:
    """Last ``n`` lines of every log; cut inside the row, so nothing is sorted or shuffled."""
    lines, total = last_lines(F.col(text), n)
    cut = logs.select(key, lines.alias("_lines"), total.alias("_total"))
    numbered = cut.select(key, (F.col("_total") - F.size("_lines")).alias("_before"),
                          F.posexplode("_lines").alias("_i", "line"))
    return numbered.select(key, (F.col("_before") + F.col("_i") + 1).cast("bigint").alias("line_no"), "line")


def _matched(pattern: str, group: int, text: str, place: Sequence[str], latest: bool = False) -> Column:
    """Aggregate: a group of the pattern's match in the first line that has one, or of the last match in the last such line."""
    line = F.struct(*place)
    if latest:
        found = F.try_element_at(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), F.lit(-1))
        return F.max_by(found, F.when(F.col(text).rlike(pattern), line))
    return F.min_by(F.regexp_extract(text, pattern, group), F.when(F.col(text).rlike(pattern), line))


def _every_log(found: DataFrame, logs: DataFrame | None, key: str) -> DataFrame:
    if logs is None:
        return found
    return logs.select(key).distinct().join(found, key, "left")


def parsed_lines(lines: DataFrame, patterns: LogPatterns = LogPatterns(), logs: DataFrame | None = None, key: str = "path",
                 place: Sequence[str] = ("start", "line"), text: str = "value") -> DataFrame:
    """(key, score, scenarios, status) of logs given as lines; the same as :func:`parsed` where no match spans lines.

    The first match of each pattern is an aggregate over the lines' places, pre-aggregated per task, so no row, task or
    group holds a whole log. ``logs`` (with the key) adds those without lines, as UNKNOWN; a NULL line matches nothing.
    """
    def hits(wanted: Sequence[str], name: str) -> list[Column]:
        return [_matched(p, 1, text, place).alias(f"_{name}{i}") for i, p in enumerate(wanted)]

    def number(wanted: Sequence[str], name: str, kind: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"_{name}{i}"), F.lit("")).try_cast(kind) for i in range(len(wanted))])

    found = lines.groupBy(key).agg(
        *hits(patterns.scores, "score"), *hits(patterns.scenarios, "scenario"),
        F.bool_or(F.col(text).rlike(patterns.failure)).alias("_failed"), F.bool_or(F.col(text).rlike(patterns.success)).alias("_succeeded"))
    result = log_result(number(patterns.scores, "score", "double"), number(patterns.scenarios, "scenario", "bigint"),
                        F.col("_failed"), F.col("_succeeded"))
    return _every_log(found, logs, key).select(key, result.alias("_p")).select(key, "_p.*")


def parsed_training_lines(lines: DataFrame, logs: DataFrame | None = None, key: str = "path",
                          place: Sequence[str] = ("start", "line"), text: str = "value") -> DataFrame:
    """(key, epochs, train_loss, val_loss) of training logs given as lines, as :func:`parsed_training`."""
    found = lines.groupBy(key).agg(
        *[_matched(EPOCH_LOSS_PATTERN, group, text, place, latest=True).alias(f"_{name}") for group, name in ((1, "epoch"), (2, "loss"))],
        _matched(VAL_LOSS_PATTERN, 1, text, place, latest=True).alias("_val"))
    return _every_log(found, logs, key).select(
        key, (F.col("_epoch").try_cast("bigint") + 1).alias("epochs"), F.col("_loss").try_cast("double").alias("train_loss"),
        F.col("_val").try_cast("double").alias("val_loss"))


def tail_of_lines(lines: DataFrame, n: int = 50, key: str = "path", place: Sequence[str] = ("start", "line"),
                  text: str = "value") -> DataFrame:
    """(key, line_no, line): the last ``n`` lines of logs given as lines.

    Spark cuts every task to ``n`` lines a log before the shuffle; numbers come from a count of the lines. Only the cut is
    numbered, so a log may have any size.
    """
    last = top_per_group(lines.select(key, *place, text), [key], [F.col(p).desc() for p in place], n)
    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    below = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*place, text))).alias("_lines"))
    numbered = null_safe_join(below, counts, [key]).select(key, (F.col("_total") - F.size("_lines")).alias("_before"),
                                                           F.posexplode("_lines").alias("_i", "_line"))
    return numbered.select(key, (F.col("_before") + F.col("_i") + 1).cast("bigint").alias("line_no"), F.col("_line")[text].alias("line"))
