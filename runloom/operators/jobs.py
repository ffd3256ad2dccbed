"""Experiments and the live job queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.names import id_prefixes, is_name_of

# Live states in order of precedence. Both spellings of "not started" count.
LIVE_ORDER = ["running", "pending", "queued", "configuring", "completing"]


def job_ids(state: DataFrame, key: str = "exp_id", train: str = "train_job_id", evaluation: str = "eval_job_id",
            many: str | None = None) -> DataFrame:
    """Recorded job ids, one row each, with the job type."""
    arms = [F.struct(F.lit("train").alias("job_type"), F.col(train).cast("string").alias("job_id")),
            F.struct(F.lit("eval").alias("job_type"), F.col(evaluation).cast("string").alias("job_id"))]
    ids = F.array(*arms)
    if many is not None:
        extra = F.transform(F.coalesce(F.col(many).cast("array<string>"), F.array().cast("array<string>")),
                            lambda j: F.struct(F.lit("eval").alias("job_type"), j.alias("job_id")))
        ids = F.concat(ids, extra)
    return (state.select(key, F.explode(ids).alias("_j")).select(key, "_j.*")
            .filter(F.coalesce("job_id", F.lit("")) != ""))


def live_jobs(ids: DataFrame, queue: DataFrame) -> DataFrame:
    """Queue entries of known experiments, with the experiment and job type."""
    return queue.join(ids, "job_id")


def live_overlay(state: DataFrame, ids: DataFrame, queue: DataFrame, key: str = "exp_id", status: str = "status",
                 order: Sequence[str] = tuple(LIVE_ORDER)) -> DataFrame:
    """Stored status, replaced by the foremost live state among the experiment's jobs."""
    live = F.lower("state")
    rank = F.coalesce(*[F.when(live == s, F.lit(i)) for i, s in enumerate(order)])
    # The queue's own state is aggregated per experiment first: one row per experiment remains.
    best = (ids.join(queue.select("job_id", live.alias("_live"), rank.alias("_rank")), "job_id")
            .filter("_rank IS NOT NULL").groupBy(key).agg(F.min_by("_live", "_rank").alias("_live")))
    return (state.join(best, key, "left")
            .withColumn(status, F.coalesce("_live", F.coalesce(F.col(status), F.lit("unknown")))).drop("_live"))


def jobs_by_name(queue: DataFrame, experiments: DataFrame, key: str = "exp_id", name: str = "name") -> DataFrame:
    """Queue entries whose name is the id, or the id followed by ``_ - .``; an equi-join on name prefixes."""
    return queue.withColumn(key, F.explode(id_prefixes(F.col(name)))).join(experiments, key)


def anchored(experiments: DataFrame, key: str = "exp_id", anchor: str = "_anchor") -> DataFrame:
    """Experiments with the ``_``-delimited token of their id that the fewest ids hold; the first of equals."""
    tokens = experiments.select(key).distinct().select(key, F.explode(F.array_distinct(F.split(key, "_"))).alias(anchor))
    counts = tokens.groupBy(anchor).agg(F.count(F.lit(1)).alias("_ids"))
    rarest = tokens.join(counts, anchor).groupBy(key).agg(F.min(F.struct("_ids", anchor))[anchor].alias(anchor))
    return experiments.join(rarest, key)


def dirs_by_id(dirs: DataFrame, experiments: DataFrame, key: str = "exp_id", name: str = "dir_name") -> DataFrame:
    """Directories holding an id as whole ``_``-delimited tokens.

    Each id stands in the index under its rarest token; a name probes it once for each of its different tokens and the whole id
    is compared with the name. Names are not shuffled more often than they have tokens.
    """
    probes = dirs.drop(key).withColumn("_anchor", F.explode(F.array_distinct(F.split(name, "_"))))
    met = probes.join(anchored(experiments, key), "_anchor").filter(is_name_of(F.col(name), F.col(key)))
    return met.select(key, *[c for c in met.columns if c not in (key, "_anchor")])


def cancel_set(ids: DataFrame, queue: DataFrame, experiments: DataFrame, key: str = "exp_id") -> DataFrame:
    """Job ids to cancel per experiment: recorded ones and those related by name."""
    by_name = jobs_by_name(queue, experiments.select(key), key).select(key, F.col("job_id").cast("string"))
    recorded = ids.join(experiments.select(key), key, "left_semi").select(key, "job_id")
    return recorded.union(by_name).distinct().orderBy(key, "job_id")
