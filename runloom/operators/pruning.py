"""Duplicate and invalid experiment directories. The result is an action table; nothing is moved."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.names import base_and_stamp, id_suffixes
from runloom.plans.ordering import top_per_group

# Names that count as checkpoints and as results.
CHECKPOINT_STARTS = ["checkpoint", "model"]
CHECKPOINT_ENDS = [".pth", ".pt"]
CHECKPOINT_ANY_END = ".ckpt"
RESULT_NAMES = ["results.json", "metrics.json", "eval_results.json", "metrics.txt", "results.txt"]
RESULT_END = "_results.json"


def any_of(test, text: Column, values: list[str]) -> Column:
    return functools.reduce(Column.__or__, [test(text, F.lit(v)) for v in values])


def is_checkpoint_name(name: Column) -> Column:
    named = any_of(F.startswith, name, CHECKPOINT_STARTS) & any_of(F.endswith, name, CHECKPOINT_ENDS)
    return named | F.endswith(name, F.lit(CHECKPOINT_ANY_END))


def is_result_name(name: Column) -> Column:
    return name.isin(RESULT_NAMES) | F.endswith(name, F.lit(RESULT_END))


def label_duplicates(dirs: DataFrame, keep_n: int = 1, name: str = "dir_name") -> DataFrame:
    """``action`` keep or prune: the newest ``keep_n`` per base name stay, undated ones are oldest.

    The kept rows come from a per-task top-N; all others are labelled by a join on the unique
    name, so a base name with very many runs is never sorted as one group.
    """
    split = base_and_stamp(F.col(name))
    named = dirs.withColumns({"base_name": split["base"], "stamp": split["stamp"]})
    kept = top_per_group(named.select(name, "base_name", "stamp"), ["base_name"],
                         [F.col("stamp").desc_nulls_last(), F.col(name)], keep_n)
    return (named.join(kept.select(name, F.lit(True).alias("_kept")), name, "left")
            .withColumn("action", F.when(F.col("_kept"), "keep").otherwise("prune")).drop("_kept"))


def keep_newest(rows: DataFrame, group: list[str], order: list[Column], key: str, keep_n: int) -> DataFrame:
    """The same labelling for rows that already have group and order columns."""
    kept = top_per_group(rows, group, order, keep_n).select(key, F.lit(True).alias("_kept"))
    return (rows.join(kept, key, "left")
            .withColumn("action", F.when(F.col("_kept"), "keep").otherwise("prune")).drop("_kept"))


def dir_sizes(files: DataFrame, by: str = "dir_name", length: str = "length") -> DataFrame:
    return files.groupBy(by).agg((F.sum(length) / F.lit(1024 * 1024)).alias("size_mb"))


def eval_dir_of(train: DataFrame, evals: DataFrame, name: str = "dir_name", mtime: str = "mtime") -> DataFrame:
    """Evaluation directory of each training directory.

    ``eval_*_{name}`` goes before ``eval_{name}`` before ``*_{name}``; the newest within the first
    form that hits. Suffixes of the evaluation names turn the pattern match into an equi-join.
    """
    forms = evals.select(
        F.col(name).alias("eval_dir"), F.col(mtime).alias("_mtime"), F.explode(id_suffixes(F.col(name))).alias(name))
    evalish = F.startswith("eval_dir", F.lit("eval_"))
    prefix = F.length("eval_dir") - F.length(name)
    form = F.when(evalish & (prefix >= 6), 1).when(evalish & (prefix == 5), 2).otherwise(3)
    hits = train.select(name).join(forms.withColumn("_form", form), name)
    return hits.groupBy(name).agg(
        F.max_by("eval_dir", F.struct(-F.col("_form"), F.col("_mtime"), F.col("eval_dir"))).alias("eval_dir"))


def validity(dirs: DataFrame, files: DataFrame, evals: DataFrame | None = None, eval_files: DataFrame | None = None,
             require_checkpoint: bool = True, require_eval: bool = True, required_epochs: int | None = None,
             name: str = "dir_name") -> DataFrame:
    """``valid`` and the reasons against it per training directory.

    File tables hold (dir_name, file_name, length) of everything below a directory.
    """
    file = F.col("file_name")
    good = is_checkpoint_name(file)
    if required_epochs is not None:
        good = good & file.rlike(rf"(epoch_|e){int(required_epochs)}(?!\d)")
    result = is_result_name(file) & (F.col("length") > 0)
    own = files.groupBy(name).agg(F.bool_or(good).alias("_ckpt"), F.bool_or(result).alias("_res"))
    checked = dirs.join(own, name, "left")
    has_result = F.coalesce("_res", F.lit(False))
    if evals is not None and eval_files is not None:
        found = eval_files.groupBy(F.col(name).alias("eval_dir")).agg(F.bool_or(result).alias("_eres"))
        checked = checked.join(eval_dir_of(dirs, evals, name), name, "left").join(found, "eval_dir", "left")
        has_result = has_result | F.coalesce("_eres", F.lit(False))
    reasons = []
    if require_checkpoint:
        reasons.append(F.when(~F.coalesce("_ckpt", F.lit(False)), F.lit("missing checkpoint")))
    if require_eval:
        reasons.append(F.when(~has_result, F.lit("missing eval results")))
    text = F.concat_ws(", ", *reasons) if reasons else F.lit("")
    return (checked.withColumn("reasons", text).withColumn("valid", F.col("reasons") == "")
            .drop("_ckpt", "_res", "_eres", "eval_dir"))


def prune_all(checked: DataFrame, keep_n: int = 1, name: str = "dir_name") -> DataFrame:
    """Invalid directories first, then duplicates among the valid ones: action and reason per directory."""
    split = base_and_stamp(F.col(name))
    named = checked.select(name, "valid", split["base"].alias("_base"), split["stamp"].alias("_stamp"))
    kept = top_per_group(named.filter("valid"), ["_base"], [F.col("_stamp").desc_nulls_last(), F.col(name)], keep_n)
    labelled = named.join(kept.select(name, F.lit(True).alias("_kept")), name, "left")
    return labelled.select(
        name, F.when(F.col("_kept"), "keep").otherwise("prune").alias("action"),
        F.when(F.col("_kept"), "").when(F.col("valid"), "duplicate").otherwise("invalid").alias("reason"))


def prune_statistics(actions: DataFrame, sizes: DataFrame | None = None, name: str = "dir_name") -> DataFrame:
    """One row: found, kept, pruned, duplicates, invalid and the megabytes pruned."""
    pruned = F.col("action") == "prune"
    if sizes is not None:
        actions = actions.join(sizes, name, "left")
        freed = F.coalesce(F.sum(F.when(pruned, F.col("size_mb"))), F.lit(0.0))
    else:
        freed = F.lit(0.0)
    return actions.agg(
        F.count(F.lit(1)).alias("total_found"), F.count_if(~pruned).alias("kept"), F.count_if(pruned).alias("pruned"),
        F.count_if(pruned & (F.col("reason") == "duplicate")).alias("duplicates_removed"),
        F.count_if(pruned & (F.col("reason") == "invalid")).alias("invalid_removed"),
        freed.alias("space_freed_mb"))
