"""Parameter grids: expansion, naming, registry lookup, status and leave-one-out splits."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.merging import override_map
from runloom.session import shared_dir


def grid_points(base: DataFrame, axes: Mapping[str, Sequence[Any]], position: str = "position") -> DataFrame:
    """Every base row with every combination of the axis values, first axis slowest.

    Axes are short parameter lists, so each is exploded in place: no join and no shuffle.
    ``position`` numbers the combinations from 0 in axis order.
    """
    if not axes:
        raise ValueError("a grid needs at least one axis")
    points = base.withColumn(position, F.lit(0).cast("bigint"))
    for name, values in axes.items():
        arms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])
        points = (points.withColumn("_axis", F.explode(arms))
                  .withColumn(name, F.col("_axis.v"))
                  .withColumn(position, F.col(position) * len(values) + F.col("_axis.i"))
                  .drop("_axis"))
    return points


def point_comment(axes: Sequence[str]) -> Column:
    """``k=v  k=v`` over the axes."""
    return F.concat_ws("  ", *[F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in axes])


def duplicate_ids(points: DataFrame, exp_id: str = "exp_id") -> DataFrame:
    return points.groupBy(exp_id).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def unique_ids(points: DataFrame, exp_id: str = "exp_id") -> DataFrame:
    """The points unchanged; the query fails when an id occurs twice."""
    doubled = duplicate_ids(points, exp_id)
    joined = points.join(doubled, exp_id, "left")
    message = F.concat(F.lit("naming rule gives id twice: "), F.col(exp_id))
    checked = F.when(F.col("times").isNotNull(), F.raise_error(message)).otherwise(F.col(exp_id))
    return joined.withColumn(exp_id, checked).select(*points.columns)


def point_configs(points: DataFrame, axes: Sequence[str], base: str = "config", exp_id: str = "exp_id") -> DataFrame:
    """Base config map, overridden by the axis values and the id."""
    items = []
    for axis in axes:
        items += [F.lit(axis), F.col(axis).cast("string")]
    own = F.create_map(*items, F.lit("exp_id"), F.col(exp_id).cast("string"))
    return points.withColumn(base, override_map(F.col(base), own))


def inject_registry(points: DataFrame, registry: DataFrame, param: str, config: str = "config") -> DataFrame:
    """Add checkpoint path and key to the configs whose ``param`` value is registered.

    ``registry``: value, path, key, arch_desc, path_field, key_field (the latter default to
    ``{value}_checkpoint_path`` and ``_key``). ``arch_desc`` only fills a gap.
    """
    spec = registry.select(F.col("value").alias(param), F.struct(*registry.columns).alias("_s"))
    joined = points.join(spec, param, "left")
    value = F.col("_s.value")
    path_field = F.coalesce(F.nullif("_s.path_field", F.lit("")), F.concat(value, F.lit("_checkpoint_path")))
    key_field = F.coalesce(F.nullif("_s.key_field", F.lit("")), F.concat(value, F.lit("_checkpoint_key")))
    added = F.create_map(path_field, F.col("_s.path"))
    added = override_map(added, F.when(F.nullif("_s.key", F.lit("")).isNotNull(),
                                       F.create_map(key_field, F.col("_s.key"))))
    gap = F.when(F.nullif("_s.arch_desc", F.lit("")).isNotNull(), F.create_map(F.lit("arch_desc"), F.col("_s.arch_desc")))
    merged = override_map(gap, override_map(F.col(config), added))
    return joined.withColumn(config, F.when(value.isNotNull(), merged).otherwise(F.col(config))).drop("_s")


def _glob_regex(glob: Column) -> Column:
    """The pattern of a wildcard path or of one part of it."""
    pattern = F.regexp_replace(glob, r"([.+()\[\]{}^$|\\])", r"\\$1")
    for wild, regex in ((r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(.*/)?"), ("\u0002", ".*")):
        pattern = F.regexp_replace(pattern, wild, regex)
    return F.concat(F.lit("^"), pattern, F.lit("$"))


def _trie(paths: DataFrame) -> DataFrame:
    """(parent, part, node, ends): every beginning of a ``path`` by whole parts, each with a ``/`` in front; the root is empty."""
    parts = F.split("path", "/")
    upto = lambda n: F.concat_ws("/", F.lit(""), F.slice(parts, 1, n))
    edges = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.when(n == 1, F.lit("")).otherwise(upto(n - 1)).alias("parent"), F.get(parts, n - 1).alias("part"), upto(n).alias("node"),
        (n == F.size(parts)).alias("ends")))
    return paths.select(F.inline(edges)).groupBy("parent", "part", "node").agg(F.max("ends").alias("ends"))


def _matched_globs(globs: DataFrame, files: DataFrame) -> DataFrame:
    """Those of the distinct wildcard ``path`` values that match a file.

    Patterns and files are tries that are walked together, a part at a time, so what patterns share is matched once. A plain part
    meets its folder's entries by equality; one with ``*`` or ``?`` meets those that begin as it does, and only these are
    tested; ``**`` goes to all folders below. States of a level are a table: a row for each two beginnings that match.
    """
    spark = globs.sparkSession

    def saved(df: DataFrame, label: str) -> DataFrame:
        path = shared_dir(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    wild = F.col("part").rlike(r"[*?]")
    head = F.regexp_extract("part", r"^[^*?]*", 0)
    steps = saved(_trie(globs).select("parent", "part", F.col("node").alias("glob"), "ends", (F.col("part") == "**").alias("deep"),
                                      wild.alias("wild"), head.alias("head"), _glob_regex(F.col("part")).alias("regex")), "globs")
    entries = saved(_trie(files), "entries")
    lengths = [r[0] for r in steps.filter("wild AND NOT deep").select(F.length("head")).distinct().collect()]  # of file names
    depth = globs.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    begins = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("part")),
                         lambda n: F.struct(n.alias("n"), F.substring("part", F.lit(1), n).alias("begin")))
    folder, place = F.col("node").alias("_folder"), F.col("node").alias("place")
    plain = entries.select(F.col("parent").alias("_folder"), F.col("part").alias("_part"), place)
    begun = entries.select(F.col("parent").alias("_folder"), F.col("part").alias("_part"), place, F.explode(begins).alias("b")).select(
        "_folder", "_part", "place", "b.begin") if lengths else None
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = entries.select(F.explode(above).alias("_folder"), place)
    leaves = entries.filter("ends").select(folder)
    states = spark.range(1).select(F.lit("").alias("glob"), F.lit("").alias("place"), F.lit(True).alias("strict"))
    found = []
    for _ in range(depth):
        at = states.select(F.col("glob").alias("parent"), F.col("place").alias("at")).join(steps, "parent")
        stays = [at.filter("deep").select("glob", F.col("at").alias("place"), F.lit(False).alias("strict"))]
        on = F.col("at") == F.col("_folder")
        moves = [at.filter("NOT wild").join(plain, on & (F.col("part") == F.col("_part"))), at.filter("deep").join(below, on)]
        if begun is not None:
            moves.append(at.filter("wild AND NOT deep").join(begun, on & (F.col("head") == F.col("begin"))).filter("_part RLIKE regex"))
        reached = functools.reduce(DataFrame.union, stays + [m.select("glob", "place", F.lit(True)) for m in moves])
        states = saved(reached.groupBy("glob", "place").agg(F.max("strict").alias("strict")), "states")
        # A closing ** stands for at least one part: the folder itself is no match.
        found.append(states.filter("strict").join(leaves, F.col("place") == F.col("_folder"), "left_semi").select("glob"))
    if not found:
        return globs.limit(0)
    ends = functools.reduce(DataFrame.union, found).distinct()
    return globs.join(ends, F.concat(F.lit("/"), F.col("path")) == F.col("glob"), "left_semi")


def missing_prerequisites(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registry entries whose path matches no file.

    ``*`` and ``?`` stand for characters of one path part, ``**`` for any parts. Plain paths are an anti-join, wildcard paths
    are walked through the tree of the files. Beside a name in its own part ``**`` is tested against whole paths below the
    folder in front of the first wildcard.
    """
    wild = F.col("path").rlike(r"[*?]")
    plain = registry.filter(~wild).join(files.select("path"), "path", "left_anti").select("value", "path")
    before = F.regexp_extract("path", r"^([^*?]*/)?[^/]*[*?]", 1)
    globs = registry.filter(wild).select("path").distinct().withColumn("_below", before)
    parts = F.split("path", "/")
    below = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    folders = files.select(F.col("path").alias("_file"), F.explode(F.array_distinct(below)).alias("_folder"))
    glued = F.exists(parts, lambda p: F.contains(p, F.lit("**")) & (p != "**"))
    held = folders.join(globs.filter(~glued).select(F.col("_below").alias("_folder")).distinct(), "_folder", "left_semi")
    matched = _matched_globs(globs.filter(~glued).select("path"), held.select(F.col("_file").alias("path")).distinct())
    whole = globs.filter(glued).withColumn("_regex", _glob_regex(F.col("path")))
    listed = folders.join(whole.select(F.col("_below").alias("_folder")).distinct(), "_folder", "left_semi")
    matched = matched.union(whole.join(listed, F.expr("_below = _folder AND _file RLIKE _regex"), "left_semi").select("path"))
    return plain.unionByName(registry.filter(wild).join(matched, "path", "left_anti").select("value", "path"))


def status_grid(points: DataFrame, state: DataFrame, exp_id: str = "exp_id", status: str = "status") -> DataFrame:
    """Points with the status of their experiment, ``—`` when it is not registered."""
    known = state.select(exp_id, F.col(status).alias("_status"))
    return points.join(known, exp_id, "left").withColumn(status, F.coalesce("_status", F.lit("—"))).drop("_status")


def two_axis_view(cells: DataFrame, rows: str, columns: str, values: Sequence[str], cell: str = "status") -> DataFrame:
    """Row axis × column axis; the column values are given, so one aggregation suffices."""
    return cells.groupBy(rows).pivot(columns, list(values)).agg(F.max(cell))


def known_points(points: DataFrame, state: DataFrame, exp_id: str = "exp_id") -> DataFrame:
    """Points whose experiment is registered."""
    return points.join(state.select(exp_id), exp_id, "left_semi")


def leave_one_out(rows: DataFrame, scope: str, scopes: Sequence[str], prefix: str = "loo_") -> DataFrame:
    """Training rows of each split: ``all``, each scope alone, and each scope left out."""
    splits = [F.lit("all"), F.col(scope)] + [
        F.when(F.col(scope) != s, F.lit(prefix + s)) for s in scopes]
    return rows.withColumn("split", F.explode(F.array_compact(F.array(*splits))))


def zero_shot_scopes(split_scopes: DataFrame, scope: str, scopes: Sequence[str], split: str = "split") -> DataFrame:
    """Scopes a split never saw in training."""
    pairs = split_scopes.select(split, scope).distinct()
    wanted = pairs.select(split).distinct().withColumn(scope, F.explode(F.array(*[F.lit(s) for s in scopes])))
    return wanted.join(pairs, [split, scope], "left_anti")


def split_sizes(rows: DataFrame, split: str = "split") -> DataFrame:
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
