"""Choosing checkpoints, registrations, resume numbers and resume lineage."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.names import file_name, number_in_name
from runloom.plans.ordering import ordered_position
from runloom.session import shared_dir

# Checkpoint file names, "best" ones in order of preference.
BEST_NAMES = ["checkpoint_best.pth", "best_checkpoint.pth", "model_best.pth"]
LATEST_NAMES = ["latest_checkpoint.pth"]
LATEST_STARTS = ["checkpoint_", "epoch_"]
LATEST_END = ".pth"
LATEST_ANY_END = ".ckpt"


def is_latest_name(name: Column) -> Column:
    started = functools.reduce(Column.__or__, [F.startswith(name, F.lit(s)) for s in LATEST_STARTS])
    return (started & F.endswith(name, F.lit(LATEST_END))) | F.endswith(name, F.lit(LATEST_ANY_END)) | name.isin(LATEST_NAMES)


def evaluation_file_kind(name: Column) -> Column:
    """Rank of the file forms an evaluation may load, the preferred one first; NULL for others."""
    forms = [F.endswith(name, F.lit(".ckpt")), F.endswith(name, F.lit(".pth")), F.contains(name, F.lit("best")),
             F.endswith(name, F.lit(".safetensors"))]
    return F.coalesce(*[F.when(form, F.lit(rank)) for rank, form in enumerate(forms)])


def latest_or_best(files: DataFrame, by: Sequence[str] = ("exp_id",), path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Per experiment a "best" file if there is one, else the newest checkpoint: path, epoch, type."""
    name = F.col("_name")
    rank = F.coalesce(*[F.when(name == b, F.lit(len(BEST_NAMES) - i)) for i, b in enumerate(BEST_NAMES)],
                      F.when(is_latest_name(name), F.lit(0)), F.lit(-1))
    ranked = files.withColumn("_name", file_name(F.col(path))).withColumn("_rank", rank)
    # Other files rank below all and drop out after the aggregation: a filter in front of it would
    # evaluate the name rules once more per row.
    picked = ranked.groupBy(*by).agg(
        F.max_by(F.struct(path, "_rank"), F.struct("_rank", mtime, path)).alias("_c")).filter("_c._rank >= 0")
    chosen = F.col(f"_c.{path}")
    return picked.select(*by, chosen.alias(path), number_in_name(chosen, "core", None).alias("epoch"),
                         F.when(F.col("_c._rank") > 0, "best").otherwise("latest").alias("type"))


def resolve(files: DataFrame, strategy: str = "mtime", by: Sequence[str] = ("exp_id",), path: str = "path",
            mtime: str = "mtime") -> DataFrame:
    """One file per group: newest (``mtime``), highest epoch (``name_epoch``) or step (``name_step``)."""
    rank = strategy_rank(F.col(path), F.col(mtime), strategy)
    return files.groupBy(*by).agg(F.max_by(F.col(path), rank).alias(path))


def resolve_all(files: DataFrame, by: Sequence[str] = ("exp_id",), path: str = "path", mtime: str = "mtime") -> DataFrame:
    """All files, newest first within their group (one range sort)."""
    return files.orderBy(*by, F.col(mtime).desc(), F.col(path))


def strategy_rank(path: Column, mtime: Column, strategy: str) -> Column:
    if strategy == "name_epoch":
        return F.struct(number_in_name(path, "resolver"), mtime, path)
    if strategy == "name_step":
        return F.struct(number_in_name(path, "step"), mtime, path)
    return F.struct(mtime, path)


def highest_epoch(files: DataFrame, by: Sequence[str] = ("exp_id",), path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Highest epoch number; files without one only count when no file has it, then the newest."""
    epoch = number_in_name(F.col(path), "lightning", None)
    rank = F.struct(F.coalesce(epoch, F.lit(-1).cast("bigint")), F.col(mtime), F.col(path))
    return (files.groupBy(*by).agg(F.max_by(F.col(path), rank).alias(path))
            .withColumn("epoch", number_in_name(F.col(path), "lightning", None)))


def registered(registry: DataFrame, prefer_best: bool = True, by: Sequence[str] = ("exp_id",), path: str = "path",
               pos: str = "pos", val_loss: str = "val_loss") -> DataFrame:
    """Registered checkpoint: lowest validation loss (first on ties), else the last registration."""
    last = F.max_by(F.col(path), F.col(pos))
    if not prefer_best:
        return registry.groupBy(*by).agg(last.alias(path))
    loss = F.when(~F.isnan(val_loss), F.col(val_loss))
    best = F.min_by(F.col(path), F.when(loss.isNotNull(), F.struct(loss, F.col(pos))))
    return registry.groupBy(*by).agg(F.coalesce(best, last).alias(path))


def for_evaluation(ids: DataFrame, registry: DataFrame, eval_configs: DataFrame, files: DataFrame,
                   key: str = "exp_id") -> DataFrame:
    """Checkpoint to evaluate per experiment, with its epoch and source.

    Order: registry text, then the first evaluation config that names one (``checkpoint_path``,
    else ``agent_checkpoint_path``), then files by pattern and highest epoch.
    """
    reg = (registry.withColumn("_p", F.nullif(F.trim("path"), F.lit("")))
           .groupBy(key).agg(F.max("_p").alias("_registry")))
    named = F.coalesce(F.nullif(F.col("checkpoint_path"), F.lit("")),
                       F.nullif(F.col("agent_checkpoint_path"), F.lit("")))
    cfg = (eval_configs.withColumn("_p", named).filter("_p IS NOT NULL")
           .groupBy(key).agg(F.min_by("_p", "position").alias("_config")))
    # Other files come last in the order and give no path.
    kind = F.col("_k")
    rank = F.struct(-F.coalesce(kind, F.lit(99)), number_in_name(F.col("path")), F.col("path"))
    glob = (files.withColumn("_name", file_name(F.col("path"))).withColumn("_k", evaluation_file_kind(F.col("_name")))
            .groupBy(key).agg(F.max_by(F.when(kind.isNotNull(), F.col("path")), rank).alias("_glob")))
    joined = ids.select(key).join(reg, key, "left").join(cfg, key, "left").join(glob, key, "left")
    chosen = F.coalesce("_registry", "_config", "_glob")
    epoch = number_in_name(chosen)
    return joined.select(
        key, chosen.alias("checkpoint_path"),
        F.when(epoch >= 0, epoch).alias("checkpoint_epoch"),
        F.when(F.col("_registry").isNotNull(), "registry").when(F.col("_config").isNotNull(), "eval_config")
        .when(F.col("_glob").isNotNull(), "glob").alias("source"))


def number_resumes(requests: DataFrame, sources: DataFrame, source: str = "source_id", seq: str = "seq",
                   block: int = 1 << 20) -> DataFrame:
    """Ids ``{root}_resume{n}`` for a batch of resume requests.

    ``n`` continues the source's ``resume_count``; the root is the source's own
    ``resume_from_exp_id`` when it was itself resumed.
    """
    blocks = [("range", F.floor(F.col(seq) / block))]
    numbered = ordered_position(requests, [source], [F.col(seq)], blocks, "_n")
    facts = sources.select(F.col("exp_id").alias(source), "resume_count", "resume_from_exp_id")
    n = (F.coalesce("resume_count", F.lit(0)) + F.col("_n")).cast("bigint")
    root = F.coalesce(F.nullif(F.col("resume_from_exp_id"), F.lit("")), F.col(source))
    return (numbered.join(facts, source)
            .withColumn("resume_number", n)
            .withColumn("new_exp_id", F.concat(root, F.lit("_resume"), n.cast("string")))
            .drop("_n", "resume_count", "resume_from_exp_id"))


def resume_lineage(edges: DataFrame, child: str = "exp_id", parent: str = "resume_from_exp_id") -> DataFrame:
    """Root and depth of every experiment along its resume pointers.

    Pointer doubling: each round joins unfinished rows with the pointers of the same round, so a
    chain of length L takes about log2(L) rounds. Every round is written to the shared folder,
    which cuts the lineage. Pointers in a cycle never reach a root and raise.
    """
    spark = edges.sparkSession
    start = edges.select(F.col(child).alias("id"), F.col(parent).alias("up"))
    known = start.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    current = (start.join(known, "up", "left")
               .select("id", F.when(F.col("_known"), F.col("up")).alias("up"),
                       F.when(F.col("_known"), 1).otherwise(0).cast("bigint").alias("depth"),
                       F.coalesce(F.when(F.col("_known"), F.col("up")), F.col("id")).alias("root")))
    base = shared_dir(spark, "lineage")
    rounds = 0
    while True:
        path = f"{base}/round={rounds}"
        current.write.parquet(path)
        current = spark.read.parquet(path)
        if current.filter("up IS NOT NULL").isEmpty():
            return current.select(F.col("id").alias(child), "root", "depth")
        if rounds == 0:
            longest = current.count().bit_length()
        rounds += 1
        if rounds > longest + 1:
            raise ValueError("resume pointers form a cycle")
        ahead = current.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"),
                               F.col("root").alias("_root"))
        moving = current.filter("up IS NOT NULL").join(ahead, "up").select(
            "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_root").alias("root"))
        current = current.filter("up IS NULL").unionByName(moving)
