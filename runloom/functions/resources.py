"""Durations, batch shapes, allocation scores and job states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheduler state codes and the five states they stand for.
JOB_STATES = {
    "queued": ["PD", "CF", "PENDING", "CONFIGURING", "S", "SUSPENDED"],
    "running": ["R", "RUNNING", "CG", "COMPLETING"],
    "completed": ["CD", "COMPLETED"],
    "failed": ["F", "FAILED", "TO", "TIMEOUT", "OOM", "OUT_OF_MEMORY", "BF", "BOOT_FAIL", "DL", "DEADLINE",
               "NF", "NODE_FAIL", "PR", "PREEMPTED"],
    "cancelled": ["CA", "CANCELLED"],
}


def job_state(code: Column, other: Column | None = None) -> Column:
    """Normalised job state; unlisted codes give ``other`` ('unknown' by default)."""
    upper = F.upper(code)
    chain = F.coalesce(*[F.when(upper.isin(codes), F.lit(state)) for state, codes in JOB_STATES.items()])
    return F.coalesce(chain, other if other is not None else F.lit("unknown"))


def duration_hours(text: Column) -> Column:
    """``D-HH:MM:SS``, ``D-HH:MM``, ``D-HH``, ``HH:MM:SS``, ``MM:SS`` or minutes, as hours; bad text gives 0."""
    at = F.instr(text, "-")
    dash = at > 0
    days = F.when(dash, F.substring_index(text, "-", 1).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    clock = F.substring(text, at + 1, F.length(text))

    def part(i: int) -> Column:
        return F.split_part(clock, F.lit(":"), F.lit(i)).try_cast("bigint").cast("double")

    n = F.length(clock) - F.length(F.replace(clock, F.lit(":"))) + 1
    plain = clock.try_cast("double")
    hours = (
        F.when(n == 3, days * 24 + part(1) + part(2) / 60 + part(3) / 3600)
        .when((n == 2) & dash, days * 24 + part(1) + part(2) / 60)
        .when(n == 2, part(1) / 60 + part(2) / 3600)
        .when((n == 1) & dash, days * 24 + part(1))
        .when(n == 1, plain / 60)
    )
    return F.coalesce(hours, F.lit(0.0))


def batch_split(target: Column, gpus: Column, cap: Column | int = 48) -> Column:
    """Global batch as struct(per_gpu_batch, accumulation): floor, then cap and accumulate."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    per_gpu = F.floor(target / gpus)
    fits = per_gpu <= cap
    return F.struct(
        F.when(fits, per_gpu).otherwise(cap).cast("bigint").alias("per_gpu_batch"),
        F.when(fits, 1).otherwise(F.ceil(target / (cap * gpus))).cast("bigint").alias("accumulation"),
    )


def allocation_score(available: Column, per_node: Column, queue: Column, wait: Column, gpus: Column,
                     same_partition: Column, same_gpus: Column) -> Column:
    """100, less shortage, queue, wait and multi-node penalties, plus full-node and match bonuses."""
    nodes = F.ceil(gpus / per_node)
    score = (
        F.lit(100.0)
        - F.when(available < gpus, 30).otherwise(0)
        - F.least(queue * 2, F.lit(30))
        - F.coalesce(F.least(wait / 10, F.lit(20.0)), F.lit(0.0))
        + F.when(gpus == per_node, 10).otherwise(0)
        - F.when(nodes > 1, (nodes - 1) * 5).otherwise(0)
        + F.when(same_partition, 15).otherwise(0)
        + F.when(same_gpus, 10).otherwise(0)
    )
    return F.greatest(score.cast("double"), F.lit(0.0))


def eval_resources(workers: Column, mem: Column, time: Column, *, default_workers: int = 32,
                   default_time: str = "06:00:00", gb_per_worker: int = 4, gb_overhead: int = 32,
                   gb_cap: int = 200) -> Column:
    """Workers, memory and time of an evaluation job; explicit (non-empty) values win."""
    chosen = F.coalesce(F.nullif(workers.cast("bigint"), F.lit(0)), F.lit(default_workers).cast("bigint"))
    scaled = F.least(chosen * gb_per_worker + gb_overhead, F.lit(gb_cap).cast("bigint"))
    return F.struct(
        chosen.alias("workers"),
        F.coalesce(F.nullif(mem, F.lit("")), F.concat(scaled.cast("string"), F.lit("G"))).alias("mem"),
        F.coalesce(F.nullif(time, F.lit("")), F.lit(default_time)).alias("time"),
    )


def availability_band(available_gpus: Column, ready: int = 4) -> Column:
    return F.when(available_gpus >= ready, "ready").when(available_gpus > 0, "limited").otherwise("none")
