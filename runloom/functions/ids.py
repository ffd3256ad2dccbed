"""Stable identifiers of runs, attempt groups and evaluation batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_id(exp_id: Column, stamp: Column, job_id: Column | None = None) -> Column:
    parts = [exp_id, stamp]
    if job_id is not None:
        parts.append(F.nullif(job_id, F.lit("")))
    return F.concat_ws("__", *parts)


def attempt_group_id(exp_id: Column, keys: Sequence[Column]) -> Column:
    """``ag__`` and 16 hex digits of SHA-256 over id and key values joined by ``|``; NULL keys are ''."""
    texts = [F.coalesce(key.cast("string"), F.lit("")) for key in keys]
    return F.concat(F.lit("ag__"), F.substring(F.sha2(F.concat_ws("|", exp_id.cast("string"), *texts), 256), 1, 16))


def eval_batch_id(job_ids: Column, stamp: Column, job_id: Column) -> Column:
    """``batch__`` and the sorted job ids; without any, the time stamp and the job id."""
    joined = F.array_join(F.array_sort(F.transform(job_ids, lambda j: j.cast("string"))), "_")
    fallback = F.concat_ws("_", F.nullif(stamp, F.lit("")), F.nullif(job_id, F.lit("")))
    return F.concat(F.lit("batch__"), F.when(F.size(F.coalesce(job_ids, F.array())) > 0, joined).otherwise(fallback))


def scope_key(scopes: Column) -> Column:
    """Sorted scope names of a scope map, joined by commas."""
    return F.array_join(F.array_sort(F.map_keys(scopes)), ",")
