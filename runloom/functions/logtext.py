"""Scores, counts and states read out of log text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log patterns, in the order they are tried.
SCORE_PATTERNS = (
    r"Final average score of valid results:\s*([0-9]+\.?[0-9]*)",
    r"PDMS:\s*([0-9.]+)",
    r"final[_ ]score[=:\s]+([0-9]+\.?[0-9]*)",
)
SCENARIO_PATTERNS = (
    r"Number of successful scenarios:\s*(\d+)",
    r"scenarios[_ ]evaluated[=:\s]+(\d+)",
)
SUCCESS_PATTERN = r"Status:\s*SUCCESS"
FAILURE_PATTERN = r"Status:\s*FAILED"
EPOCH_LOSS_PATTERN = r"(?i)Epoch\s+(\d+).*?(?:train_loss|loss)[=:]\s*([\d.]+)"
VAL_LOSS_PATTERN = r"(?i)(?:val_loss|validation)[=:]\s*([\d.]+)"


@dataclass(frozen=True)
class LogPatterns:
    """What a log parser looks for; the first readable pattern of a list wins."""

    scores: Sequence[str] = SCORE_PATTERNS
    scenarios: Sequence[str] = SCENARIO_PATTERNS
    success: str = SUCCESS_PATTERN
    failure: str = FAILURE_PATTERN


def _first_number(text: Column, patterns: Sequence[str], as_type: str) -> Column:
    return F.coalesce(*[
        F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast(as_type) for p in patterns])


def log_result(score: Column, scenarios: Column, failed: Column, succeeded: Column) -> Column:
    """struct(score, scenarios, status): FAILED beats SUCCESS, a positive score implies SUCCESS."""
    return F.struct(
        score.alias("score"), F.coalesce(scenarios, F.lit(0).cast("bigint")).alias("scenarios"),
        F.when(failed, "FAILED").when(succeeded, "SUCCESS").when(score > 0, "SUCCESS").otherwise("UNKNOWN").alias("status"))


def parse_log(text: Column, patterns: LogPatterns = LogPatterns()) -> Column:
    """struct(score, scenarios, status); FAILED beats SUCCESS, a positive score implies SUCCESS.

    NULL text (an unreadable file) gives no score, 0 scenarios and UNKNOWN.
    """
    return log_result(_first_number(text, patterns.scores, "double"), _first_number(text, patterns.scenarios, "bigint"),
                      text.rlike(patterns.failure), text.rlike(patterns.success))


def parse_training_log(text: Column) -> Column:
    """struct(epochs, train_loss, val_loss) from the last matching entries; epochs count from 1."""

    def last(pattern: str, group: int) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))

    return F.struct(
        (last(EPOCH_LOSS_PATTERN, 1).try_cast("bigint") + 1).alias("epochs"),
        last(EPOCH_LOSS_PATTERN, 2).try_cast("double").alias("train_loss"),
        last(VAL_LOSS_PATTERN, 1).try_cast("double").alias("val_loss"),
    )


def last_lines(text: Column, n: int = 50) -> tuple[Column, Column]:
    """The last ``n`` lines as an array, and the number of all lines.

    Only the tail of the text is split.
    """
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    total = F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1
    return F.split(F.substring_index(body, "\n", -n), "\n"), total
