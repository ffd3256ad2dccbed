"""Configurations against runtime state: merge, drift, registration, renaming, repair, artifacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.merging import override_map
from runloom.functions.names import id_candidates, id_prefixes
from runloom.session import shared_dir


def experiment_records(state: DataFrame, configs: DataFrame, key: str = "exp_id") -> DataFrame:
    """Registered experiments with configuration and state merged; state values win.

    ``state`` has ``state`` and ``embedded_config`` maps, ``configs`` a ``config`` map. The
    embedded copy is used only where no configuration exists.
    """
    joined = state.join(configs, key, "left")
    config = F.coalesce(F.col("config"), F.col("embedded_config"))
    return joined.select(key, override_map(config, F.col("state")).alias("record"))


PATH_FIELDS = ("train_script_path", "eval_script_path")


def broken_fields(state: DataFrame, paths: DataFrame, key: str = "exp_id",
                  path_fields: Sequence[str] = PATH_FIELDS) -> DataFrame:
    """Per id the path fields (``broken``) that point to no existing file.

    The path columns are unpivoted without their empty values and checked by one anti-join, so
    the file list is read once and missing paths never meet as one join key.
    """
    pairs = F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("path")) for p in path_fields])
    used = state.select(key, F.explode(pairs).alias("_p")).select(key, "_p.*")
    gone = used.filter(F.coalesce("path", F.lit("")) != "").join(paths.select("path"), "path", "left_anti")
    return gone.groupBy(key).agg(F.collect_set("field").alias("broken"))


def consistency_flags(state: DataFrame, configs: DataFrame, paths: DataFrame, key: str = "exp_id",
                      path_fields: Sequence[str] = PATH_FIELDS, embedded: str = "has_config_copy") -> DataFrame:
    """One row per known id with a flag per kind of drift. ``paths`` lists existing files (``path``)."""
    both = (state.withColumn("_state", F.lit(True))
            .join(configs.select(key, F.lit(True).alias("_config")), key, "full_outer"))
    joined = both.join(broken_fields(state, paths, key, path_fields), key, "left")
    in_state, in_config = F.col("_state").isNotNull(), F.col("_config").isNotNull()
    return joined.select(
        key,
        (in_state & ~in_config).alias("missing_config"),
        (~in_state & in_config).alias("orphan_config"),
        F.coalesce(F.col(embedded), F.lit(False)).alias("stale_copy"),
        F.col("broken").isNotNull().alias("broken_path"))


ISSUES = ["missing_config", "orphan_config", "stale_copy", "broken_path"]


def consistency_issues(flags: DataFrame, key: str = "exp_id") -> DataFrame:
    """The id lists of the report as rows (id, issue)."""
    found = F.array_compact(F.array(*[F.when(F.col(i), F.lit(i)) for i in ISSUES]))
    return flags.select(key, F.explode(found).alias("issue"))


def consistency_report(flags: DataFrame) -> DataFrame:
    """One row: how many ids per issue, and ``ok`` when there are none."""
    counts = [F.count_if(F.col(i)).alias(i) for i in ISSUES]
    return flags.agg(*counts).withColumn("ok", sum((F.col(i) for i in ISSUES), F.lit(0)) == 0)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of ``left`` that ``right`` does not have."""
    return left.select(key).join(right.select(key), key, "left_anti").distinct()


def register(candidates: DataFrame, configs: DataFrame, state: DataFrame, key: str = "exp_id", force: bool = False) -> DataFrame:
    """Outcome per candidate: ``yaml_missing``, ``already_present`` or ``registered``."""
    joined = (candidates.join(configs.select(key, F.lit(True).alias("_c")).distinct(), key, "left")
              .join(state.select(key, F.lit(True).alias("_s")).distinct(), key, "left"))
    outcome = F.when(F.col("_c").isNull(), "yaml_missing")
    if not force:
        outcome = outcome.when(F.col("_s"), "already_present")
    return joined.withColumn("outcome", outcome.otherwise("registered")).drop("_c", "_s")


def created_rows(outcomes: DataFrame, key: str = "exp_id") -> DataFrame:
    """Fresh state rows for the registered candidates."""
    empty = F.lit(None).cast("string")
    return outcomes.filter(F.col("outcome") == "registered").select(
        key, F.lit("created").alias("status"), empty.alias("train_script_path"),
        empty.alias("eval_script_path"), empty.alias("run_id"))


def rename_errors(renames: DataFrame, state: DataFrame, key: str = "exp_id") -> DataFrame:
    """Why a rename map (old_id, new_id) cannot be applied; no rows means it can."""
    ids = state.select(key)
    unknown = renames.join(ids, renames.old_id == ids[key], "left_anti").select(
        F.col("old_id").alias("id"), F.lit("not found").alias("error"))
    taken = renames.join(ids, renames.new_id == ids[key], "left_semi").select(F.col("new_id").alias("id"))
    # A target that is itself a rename target of the map is allowed only as such, so only ids
    # that stay in use under their own name are errors.
    staying = taken.join(renames.select(F.col("old_id").alias("id")), "id", "left_anti").withColumn(
        "error", F.lit("already exists as target"))
    doubled = (renames.groupBy(F.col("new_id").alias("id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
               .select("id", F.lit("used twice as target").alias("error")))
    return unknown.unionByName(staying).unionByName(doubled)


def replace_id(text: Column, old: Column, new: Column) -> Column:
    """The id replaced where it stands alone: next to no letter or digit, and not before a ``-``."""
    alone = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), old, F.lit(r"\E(?![A-Za-z0-9-])"))
    literal = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, alone, literal)


def apply_renames(state: DataFrame, renames: DataFrame, key: str = "exp_id",
                  text_fields: Sequence[str] = PATH_FIELDS) -> DataFrame:
    """State under the new ids, the old id replaced inside path texts. Validate first."""
    joined = state.join(renames.select(F.col("old_id").alias(key), "new_id"), key, "left")
    renamed = F.col("new_id").isNotNull()
    changed = {f: F.when(renamed, replace_id(F.col(f), F.col(key), F.col("new_id"))).otherwise(F.col(f))
               for f in text_fields}
    return (joined.withColumns(changed).withColumn(key, F.coalesce("new_id", F.col(key))).drop("new_id"))


def bulk_rename(state: DataFrame, renames: DataFrame, key: str = "exp_id",
                text_fields: Sequence[str] = PATH_FIELDS) -> DataFrame:
    """All-or-nothing rename: written as a new version only when the map is valid."""
    problems = rename_errors(renames, state, key).count()
    if problems:
        raise ValueError(f"{problems} errors in the map; rename_errors lists them")
    path = shared_dir(state.sparkSession, "renamed")
    apply_renames(state, renames, key, text_fields).write.parquet(path)
    return state.sparkSession.read.parquet(path)


def rename_dirs(dirs: DataFrame, renames: DataFrame, name: str = "dir_name") -> DataFrame:
    """New names of directories that belong to a renamed experiment.

    Related: the id itself, the id followed by ``_`` or ``-``, or the id as a ``_``-delimited part.
    """
    candidates = F.array_union(id_candidates(F.col(name)), F.coalesce(
        F.filter(id_prefixes(F.col(name)),
                 lambda p: F.substring(F.col(name), F.length(p) + 1, F.lit(1)).isin("", "_", "-")),
        F.array().cast("array<string>")))
    # A directory that holds several renamed ids belongs to the longest one.
    found = dirs.withColumn("old_id", F.explode(candidates)).join(renames, "old_id")
    longest = found.groupBy(*dirs.columns).agg(F.max_by(
        F.struct("old_id", "new_id"), F.struct(F.length("old_id"), "old_id")).alias("_r")).select(*dirs.columns, "_r.*")
    start = F.when(F.startswith(F.col(name), F.col("old_id")), F.concat(
        F.col("new_id"), F.substring(F.col(name), F.length("old_id") + 1, F.length(name))))
    return longest.withColumn("new_name", F.coalesce(start, replace_id(F.col(name), F.col("old_id"), F.col("new_id"))))


def repaired_state(state: DataFrame, flags: DataFrame, paths: DataFrame, key: str = "exp_id",
                   path_fields: Sequence[str] = PATH_FIELDS, embedded: str = "has_config_copy") -> DataFrame:
    """State after repair: copies stripped, orphans registered as ``unknown``, broken paths NULL."""
    joined = state.join(broken_fields(state, paths, key, path_fields), key, "left")
    cleared = {f: F.when(~F.coalesce(F.array_contains("broken", f), F.lit(False)), F.col(f)) for f in path_fields}
    fixed = joined.withColumns(cleared).withColumn(embedded, F.lit(False)).select(*state.columns)
    added = flags.filter("orphan_config").select(key, F.lit("unknown").alias("status"))
    return fixed.unionByName(added, allowMissingColumns=True)


def migration_plan(state: DataFrame, configs: DataFrame, key: str = "exp_id", embedded: str = "has_config_copy") -> DataFrame:
    """Per id: ``skipped`` without an embedded copy, else ``migrated``; ``warning`` when a config must be written."""
    joined = state.join(configs.select(key, F.lit(True).alias("_c")).distinct(), key, "left")
    copy = F.coalesce(F.col(embedded), F.lit(False))
    return joined.select(key, F.when(copy, "migrated").otherwise("skipped").alias("outcome"),
                         (copy & F.col("_c").isNull()).alias("config_written"))


def missing_artifacts(ids: DataFrame, registered: DataFrame, present: DataFrame, required: Mapping[str, str],
                      key: str = "exp_id") -> DataFrame:
    """Missing (id, artifact, reason) rows; an unregistered id gives one row only.

    ``present`` lists (id, artifact) pairs; ``required`` maps artifact to the reason text. Each id
    is exploded over the short required list, then one anti-join removes what is present.
    """
    marked = ids.select(key).join(registered.select(key, F.lit(True).alias("_r")).distinct(), key, "left")
    unregistered = marked.filter("_r IS NULL").select(
        key, F.lit("").alias("artifact"), F.lit("not registered in metadata").alias("reason"))
    wanted = F.array(*[F.struct(F.lit(a).alias("artifact"), F.lit(r).alias("reason")) for a, r in required.items()])
    needed = marked.filter("_r").select(key, F.explode(wanted).alias("_w")).select(key, "_w.*")
    return unregistered.unionByName(needed.join(present, [key, "artifact"], "left_anti").select(key, "artifact", "reason"))


def missing_fields(configs: DataFrame, required: Sequence[str], paths: DataFrame, name: str = "name") -> DataFrame:
    """Per configuration (a ``fields`` map): required fields that are absent or point to no file."""
    wanted = F.array(*[F.lit(f) for f in required])
    needed = configs.select(name, "fields", F.explode(wanted).alias("field")).select(
        name, "field", F.coalesce(F.try_element_at("fields", F.col("field")), F.lit("")).alias("pattern"))
    absent = needed.filter("pattern = ''").withColumn(
        "reason", F.concat(F.lit("field '"), F.col("field"), F.lit("' missing")))
    quoted = F.when(F.col("field").isin("checkpoint", "exp_config"), F.col("field")).otherwise(
        F.concat(F.lit("'"), F.col("field"), F.lit("'")))
    unknown = (needed.filter("pattern <> ''").join(paths.select(F.col("path").alias("pattern")), "pattern", "left_anti")
               .withColumn("reason", F.concat(quoted, F.lit(" not found"))))
    return absent.unionByName(unknown).select(name, "field", "reason", "pattern")


def reevaluation_plan(requested: DataFrame, state: DataFrame, key: str = "exp_id") -> DataFrame:
    """Requested ids as ``planned``, or ``skipped`` when they are not registered."""
    known = state.select(key, F.lit(True).alias("_s")).distinct()
    return requested.join(known, key, "left").withColumn(
        "outcome", F.when(F.col("_s"), "planned").otherwise("skipped")).drop("_s")


def validation_report(ids: DataFrame, missing: DataFrame, key: str = "exp_id") -> DataFrame:
    """One row: ids without anything missing, all ids, number of missing items, ready."""
    bad = missing.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return ids.select(key).join(bad, key, "left").agg(
        F.count_if(F.col("_n").isNull()).alias("found"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("missing")).withColumn(
        "ready", F.col("found") == F.col("total"))


def where_present(df: DataFrame, key: str, artifact: str, present: Column) -> DataFrame:
    """(id, artifact) rows of the ids for which a condition holds."""
    return df.filter(present).select(key, F.lit(artifact).alias("artifact"))
