"""Run records: grouping of evaluation results into runs, history, collection counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.ids import run_id
from runloom.functions.names import display_stamp, experiment_in_name, parse_eval_dir


def attribute_dirs(dirs: DataFrame, scopes: Sequence[str], name: str = "dir_name") -> DataFrame:
    """Evaluation directories with their parsed parts.

    The run stamp falls back to the directory name, the scope to ``all``.
    """
    parsed = dirs.withColumn("_p", parse_eval_dir(F.col(name), scopes))
    return parsed.withColumns({
        "exp_id": F.col("_p.exp_id"),
        "eval_split": F.col("_p.eval_split"),
        "scope": F.coalesce(F.nullif(F.col("_p.scope"), F.lit("")), F.lit("all")),
        "stamp": F.coalesce(F.nullif(F.col("_p.timestamp"), F.lit("")), F.col(name)),
        "job_id": F.col("_p.slurm_job_id"),
    }).drop("_p")


def parsed_id_join(dirs: DataFrame, experiments: DataFrame, key: str = "exp_id", name: str = "dir_name",
                   scopes: Sequence[str] = ()) -> DataFrame:
    """Directories of known experiments, matched by the id in front of ``_eval_``."""
    return attribute_dirs(dirs, scopes, name).join(experiments, key)


def run_records(results: DataFrame, overall: str = "all") -> DataFrame:
    """One record per (experiment, stamp) from per-directory results.

    Input columns: exp_id, stamp, scope, dir_name, job_id, score, scenarios. A later directory of
    the same scope wins. The average is unweighted over positive scores of the scopes (the
    overall scope only when alone); the scenario total counts every scope.
    """
    chosen = results.groupBy("exp_id", "stamp", "scope").agg(
        F.max_by(F.struct(F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), "scenarios"),
                 F.col("dir_name")).alias("_r"),
        F.min_by(F.struct(F.col("dir_name"), F.col("job_id")), F.col("dir_name")).alias("_first"))
    is_overall = F.col("scope") == overall
    score = F.col("_r.score")
    positive = F.when(score > 0, score)
    has_parts = F.max((~is_overall).cast("int")) == 1
    first = F.min_by(F.col("_first.job_id"), F.col("_first.dir_name"))
    return (
        chosen.groupBy("exp_id", "stamp")
        .agg(first.alias("job_id"),
             F.coalesce(F.when(has_parts, F.avg(F.when(~is_overall, positive))).otherwise(F.avg(positive)),
                        F.lit(0.0)).alias("avg_score"),
             F.coalesce(F.sum("_r.scenarios"), F.lit(0)).cast("bigint").alias("total_scenarios"),
             F.map_from_entries(F.array_sort(F.collect_list(F.struct("scope", "_r")))).alias("scopes"))
        .withColumn("run_id", run_id(F.col("exp_id").cast("string"), F.col("stamp"), F.col("job_id")))
    )


def with_experiment(runs: DataFrame, record: DataFrame, config_fields: Sequence[str]) -> DataFrame:
    """Run records joined with status, git and selected configuration of their experiment."""
    kept = [F.col(c) for c in record.columns if c not in config_fields or c == "exp_id"]
    config = F.struct(*[F.col(c) for c in config_fields]).alias("config")
    return (runs.join(record.select(*kept, config), "exp_id", "left")
            .withColumn("harvested_at", F.current_timestamp()))


def skip_stored(new: DataFrame, stored: DataFrame, key: str | Sequence[str] = "run_id", force: bool = False) -> DataFrame:
    """Rows whose key is not stored yet; ``force`` keeps all."""
    if force:
        return new
    keys = [key] if isinstance(key, str) else list(key)
    return new.join(stored.select(*keys), keys, "left_anti")


def run_counts(runs: DataFrame, by: str = "exp_id") -> DataFrame:
    """Runs per experiment and the grand total (NULL id)."""
    return runs.rollup(by).agg(F.count(F.lit(1)).alias("runs"))


def run_history(runs: DataFrame, exp_id: str = "exp_id", stamp: str = "stamp", tie: str = "run_id") -> DataFrame:
    """Runs in time order per experiment with a display date; a range sort, no per-group task."""
    return (runs.withColumn("date", display_stamp(F.col(stamp)))
            .orderBy(exp_id, F.coalesce(F.col(stamp), F.lit("")), tie))


def latest_run_scopes(runs: DataFrame, exp_id: str = "exp_id", stamp: str = "stamp", tie: str = "run_id",
                      scopes: str = "scopes") -> DataFrame:
    """The scopes of each experiment's last run, one row per scope."""
    last = runs.groupBy(exp_id).agg(F.max_by(F.struct(tie, scopes), F.struct(stamp, tie)).alias("_r"))
    return last.select(exp_id, F.col(f"_r.{tie}"), F.explode(F.col(f"_r.{scopes}")).alias("scope", "result"))


def distinct_ids(names: Sequence[DataFrame]) -> DataFrame:
    """Distinct experiment ids found in one-column name tables, sorted."""
    parts = [d.select(experiment_in_name(F.col(d.columns[0])).alias("exp_id")) for d in names]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.filter("exp_id IS NOT NULL").distinct().orderBy("exp_id")
