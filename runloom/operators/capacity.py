"""Sizing: batch preview, queue state, access lists, resource recommendations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.resources import allocation_score, batch_split, duration_hours

# Fixed values: (GPUs, nodes) shapes that are considered, and the texts of a recommendation.
GPU_SHAPES = [(4, 1), (2, 1), (8, 2), (1, 1)]
TEXTS = {
    "free": " {free} GPUs available now",
    "short": " Only {free} GPUs available ({gpus} needed)",
    "empty": "empty queue",
    "queued": "{queue} jobs queued",
    "full": "full node (efficient)",
    "gpus": "GPU count changed from {wanted} to {gpus}. Verify global batch size matches for reproducibility.",
    "type": "GPU type changed from {wanted} to {type}. May affect precision/performance. Consider locking precision mode.",
    "accumulation": "Gradient accumulation ({n}x) required to maintain global batch. May affect training dynamics slightly.",
    "precision": "bf16",
    "precision_fp8": "bf16 or fp8 (H200 supports FP8, but changes training algorithm)",
}


def filled(template: str, **values: Column) -> Column:
    """A text with ``{name}`` replaced by columns."""
    parts = re.split(r"{(\w+)}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def preview_items(requested: DataFrame, registered: DataFrame, configs: DataFrame, key: str = "exp_id") -> DataFrame:
    """Per requested id: readiness, warning, GPUs and GPU hours."""
    joined = (requested.select(key)
              .join(registered.select(key, F.lit(True).alias("_r")).distinct(), key, "left")
              .join(configs.select(key, "num_gpus", "num_nodes", "time_limit", "partition",
                                   F.lit(True).alias("_c")), key, "left"))
    ready = F.col("_r").isNotNull() & F.col("_c").isNotNull()
    gpus = F.coalesce("num_gpus", F.lit(1)) * F.coalesce("num_nodes", F.lit(1))
    hours = duration_hours(F.coalesce("time_limit", F.lit("0")))
    text = F.col(key).cast("string")
    return joined.select(
        key, ready.alias("ready"),
        F.when(F.col("_r").isNull(), F.concat(text, F.lit(": not registered in metadata")))
        .when(F.col("_c").isNull(), F.concat(text, F.lit(": YAML config missing"))).alias("warning"),
        F.when(ready, gpus).otherwise(0).cast("bigint").alias("gpus"),
        F.when(ready, gpus * hours).otherwise(F.lit(0.0)).alias("gpu_hours"),
        F.when(ready, F.coalesce("partition", F.lit("unknown"))).alias("partition"))


def preview_totals(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total_experiments"), F.count_if("ready").alias("ready"),
        F.count_if(~F.col("ready")).alias("not_ready"),
        F.coalesce(F.sum("gpus"), F.lit(0)).cast("bigint").alias("total_gpus"),
        F.round(F.coalesce(F.sum("gpu_hours"), F.lit(0.0)), 2).alias("estimated_gpu_hours"))


def preview_partitions(items: DataFrame) -> DataFrame:
    return items.filter("ready").groupBy("partition").agg(F.count(F.lit(1)).alias("experiments"))


def queue_status(partitions: DataFrame, nodes: DataFrame, queue: DataFrame) -> DataFrame:
    """Per configured partition: nodes, GPUs, queue length and expected wait.

    ``partitions``: partition, gpus_per_node, total_nodes (default when no node is listed), ….
    ``nodes``: partition, count, state. ``queue``: partition, one row a job. Wait is 0 with free
    GPUs, else 30 minutes per queued job, else unknown.
    """
    free = F.contains(F.lower("state"), F.lit("idle")) | F.contains(F.lower("state"), F.lit("mix"))
    seen = nodes.groupBy("partition").agg(
        F.sum("count").alias("_total"), F.coalesce(F.sum(F.when(free, F.col("count"))), F.lit(0)).alias("_free"))
    jobs = queue.groupBy("partition").agg(F.count(F.lit(1)).alias("_jobs"))
    joined = partitions.join(seen, "partition", "left").join(jobs, "partition", "left")
    total = F.coalesce(F.nullif("_total", F.lit(0)), F.col("total_nodes")).cast("bigint")
    available = F.coalesce("_free", F.lit(0)).cast("bigint")
    gpus = (available * F.col("gpus_per_node")).cast("bigint")
    length = F.coalesce("_jobs", F.lit(0)).cast("bigint")
    kept = [c for c in partitions.columns if c != "total_nodes"]
    return joined.select(
        *kept, total.alias("total_nodes"), available.alias("available_nodes"),
        (total * F.col("gpus_per_node")).cast("bigint").alias("total_gpus"), gpus.alias("available_gpus"),
        length.alias("queue_length"),
        F.when(gpus > 0, F.lit(0)).when(length > 0, length * 30).cast("bigint").alias("wait_mins"))


def access_pairs(attempts: DataFrame, partition: str = "partition", account: str = "account", allowed: str = "allowed") -> DataFrame:
    """Distinct accessible (partition, account) pairs: the access map in both directions."""
    return attempts.filter(F.col(allowed)).select(partition, account).distinct()


def access_counts(pairs: DataFrame, by: str) -> DataFrame:
    other = next(c for c in pairs.columns if c != by)
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias(f"{other}s"), F.min(other).alias(f"first_{other}"))


def account_for_partition(pairs: DataFrame, order: str = "position") -> DataFrame:
    """Account used for each partition: the first whose name holds a word of the partition's name, else the first."""
    words = F.split(F.lower("partition"), "_")
    named = F.exists(words, lambda w: F.contains(F.lower("account"), w))
    return pairs.groupBy("partition").agg(F.min_by("account", F.struct(~named, F.col(order))).alias("account"))


def select_pair(partitions: DataFrame, accounts: DataFrame, by: Sequence[str] = (), prefer_public: bool = True,
                order: str = "position") -> DataFrame:
    """Best (partition, account): +10 for a public partition, +5 without a GPU rule, first on ties."""
    public = F.contains(F.lower("partition"), F.lit("public"))
    score = (F.when(public & F.lit(prefer_public), 10).otherwise(0)
             + F.when(~F.coalesce("requires_gpu", F.lit(True)), 5).otherwise(0))
    scored = partitions.join(accounts, "partition").withColumn("score", score.cast("bigint"))
    best = F.max_by(F.struct("partition", "account", "score"), F.struct(F.col("score"), -F.col(order)))
    return scored.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*").filter("partition IS NOT NULL")


def fitting_shapes(partitions: DataFrame, shapes: Sequence[tuple[int, int]] = tuple(GPU_SHAPES)) -> DataFrame:
    """Partition × GPU shape, where the GPUs fit the nodes. Shapes are a short list: exploded in place."""
    arms = F.array(*[F.struct(F.lit(g).alias("num_gpus"), F.lit(n).alias("num_nodes")) for g, n in shapes])
    return (partitions.withColumn("_s", F.explode(arms)).select("*", "_s.*").drop("_s")
            .filter(F.col("num_gpus") <= F.col("gpus_per_node") * F.col("num_nodes")))


def recommendations(shapes: DataFrame, target_batch: int = 192, max_per_gpu: int = 48,
                    wanted_partition: Column | None = None, wanted_gpus: Column | None = None,
                    wanted_gpu_type: Column | None = None) -> DataFrame:
    """Score, batch shape, wait, reason, warnings and precision of every fitting shape.

    Order the result with :func:`ranked`. A ``fp8_support`` column widens the precision advice.
    """
    gpus, free, queue = F.col("num_gpus"), F.col("available_gpus"), F.col("queue_length")
    no = F.lit(False)
    same_partition = (F.col("partition") == wanted_partition) if wanted_partition is not None else no
    same_gpus = (gpus == wanted_gpus) if wanted_gpus is not None else no
    accumulation = F.col("_b.accumulation")

    reason = F.concat_ws(
        ", ",
        F.when(free >= gpus, filled(TEXTS["free"], free=free)).otherwise(filled(TEXTS["short"], free=free, gpus=gpus)),
        F.when(queue == 0, TEXTS["empty"]).otherwise(filled(TEXTS["queued"], queue=queue)),
        F.when(gpus == F.col("gpus_per_node"), TEXTS["full"]))
    warnings = []
    if wanted_gpus is not None:
        warnings.append(F.when(gpus != wanted_gpus, filled(TEXTS["gpus"], wanted=wanted_gpus, gpus=gpus)))
    if wanted_partition is not None and wanted_gpu_type is not None:
        changed = filled(TEXTS["type"], wanted=wanted_gpu_type, type=F.col("gpu_type"))
        warnings.append(F.when(F.col("partition") != wanted_partition, changed))
    warnings.append(F.when(accumulation > 1, filled(TEXTS["accumulation"], n=accumulation)))
    fp8 = F.coalesce(F.col("fp8_support"), no) if "fp8_support" in shapes.columns else no
    return shapes.withColumn("_b", batch_split(F.lit(target_batch), gpus, max_per_gpu)).withColumns({
        "global_batch": F.lit(target_batch),
        "per_gpu_batch": F.col("_b.per_gpu_batch"),
        "accumulation": accumulation,
        "estimated_wait_mins": F.coalesce(F.col("wait_mins"), F.lit(0).cast("bigint")),
        "score": allocation_score(free, F.col("gpus_per_node"), queue, F.col("wait_mins"), gpus,
                                  F.coalesce(same_partition, no), F.coalesce(same_gpus, no)),
        "reason": F.concat(F.col("gpu_type"), F.lit(" ("), reason, F.lit(")")),
        "warnings": F.array_compact(F.array(*warnings)),
        "precision": F.when(fp8, TEXTS["precision_fp8"]).otherwise(TEXTS["precision"]),
    }).drop("_b")


def ranked(scored: DataFrame, *tie: str) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), *tie)
