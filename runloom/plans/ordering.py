"""Ranking that holds when one group owns a large share of all rows.

* ``top_per_group`` keeps N rows per group. Spark cuts each task's rows to N per group before the
  shuffle (WindowGroupLimit), so a hot group costs N rows per task.
* ``ordered_position`` numbers *every* row of a group. The group is split into ordered blocks;
  counts per block are summed into offsets, and rows are numbered inside their block only.
* ``exact_median`` brackets the median by a sketch with a guaranteed rank error, counts what lies
  below the bracket and sorts only the values inside it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import shared_dir

#: Groups whose brackets are sent to all tasks.
BROADCAST_GROUPS = 1_000_000
GROUP_LIMIT_KEY = "spark.sql.optimizer.windowGroupLimitThreshold"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL on both sides; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return left.join(other, functools.reduce(Column.__and__, same)).drop(*[f"_key_{i}" for i in range(len(keys))])


def range_blocks(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "_part") -> DataFrame:
    """The rows with the number of their range partition along group and order, as a written table.

    A hot group spans many partitions, and the numbers rise along its order.
    """
    path = shared_dir(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn(name, F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1,
                  blocks: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (which must break ties).

    Beyond the number that Spark cuts per task, rows are numbered by ``blocks``, or by range
    partitions where none are given.
    """
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT_KEY, "1000"))
    if n > limit:
        if not blocks:
            df, blocks = range_blocks(df, group, order), [("part", F.col("_part"))]
        ranked = ordered_position(df, group, order, blocks, "_rank").drop("_part")
    else:
        window = Window.partitionBy(*group).orderBy(*order)
        ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def ordered_position(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                     blocks: Sequence[tuple[str, Column]], name: str = "position") -> DataFrame:
    """1-based position of every row in its group; NULL groups and blocks are values like others.

    ``blocks`` are columns, coarse to fine, each non-decreasing (NULL first) along ``order`` among
    rows equal in the coarser ones: e.g. day, then second, then id range. Windows run over the
    coarse blocks of a group, over the finer blocks of one coarse block, or over the rows of one
    finest block, never over the rows of a group. Rows are shuffled once, by group and block.
    """
    group = list(group)
    names = [f"_block_{i}" for i in range(len(blocks))]
    keyed = df.withColumns({name_: column for name_, (_, column) in zip(names, blocks)})
    sizes = keyed.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_size"))

    def running(inside: list[str], along: list[str]) -> Column:
        window = Window.partitionBy(*inside).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(window), F.lit(0))

    coarse = [*group, names[0]]
    if len(names) == 1:
        offsets = sizes.withColumn("_before", running(group, names))
    else:
        inner = sizes.withColumn("_before", running(coarse, names[1:]))
        outer = (sizes.groupBy(*coarse).agg(F.sum("_size").alias("_size"))
                 .withColumn("_outer", running(group, names[:1])).drop("_size"))
        offsets = null_safe_join(inner, outer, coarse).withColumn("_before", F.col("_before") + F.col("_outer")).drop("_outer")
    keys = group + names
    window = Window.partitionBy(*keys).orderBy(*order)
    return (null_safe_join(keyed, offsets.drop("_size"), keys)
            .withColumn(name, F.row_number().over(window) + F.col("_before"))
            .drop(*names, "_before"))


def time_blocks(stamp: str, seq: str, width: int = 1 << 20) -> list[tuple[str, Column]]:
    """Blocks for rows ordered by a ``YYYYMMDD_HHMMSS``-like text and then by a number."""
    text = F.coalesce(F.col(stamp).cast("string"), F.lit(""))
    return [("day", F.substring(text, 1, 8)), ("stamp", text),
            ("range", F.floor(F.coalesce(F.col(seq), F.lit(0)) / width))]


def exact_median(df: DataFrame, group: Sequence[str], value: str, name: str = "median",
                 accuracy: int = 20_000, groups_at_most: int | None = None) -> DataFrame:
    """Exact median of ``value`` per (non-null) group without gathering a group.

    A quantile sketch gives two values between which the median must lie, as its ranks are at most
    1/``accuracy`` of the rows off. Values below are only counted; those inside, a few
    ten-thousandths of the rows whatever their distribution, are counted per value and sorted.

    The brackets (a row a group) are broadcast and the values never shuffled by group. ``groups_at_most``
    is the caller's proof that there are few groups; otherwise the brackets are written and counted, and
    more than ``BROADCAST_GROUPS`` are joined as Spark decides.
    """
    # Without a group all rows share one constant key, joined against one row.
    keyed = df.withColumn("_all", F.lit(1))
    small = F.broadcast if not group or groups_at_most else (lambda t: t)
    keys = [*group, "_all"]
    rows = keyed.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    margin = 2.0 / accuracy
    brackets = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", [0.5 - margin, 0.5 + margin], accuracy).alias("_range"))
    if group and not groups_at_most:
        # A shuffle by group would bring a hot group's rows to one task, so counted brackets are sent to the rows instead.
        path = shared_dir(df.sparkSession, "median-brackets")
        brackets.write.parquet(path)
        brackets = df.sparkSession.read.schema(brackets.schema).parquet(path)
        if brackets.count() <= BROADCAST_GROUPS:
            small = F.broadcast
    # Values below the bracket count as one value each group.
    low, high = F.col("_range")[0], F.col("_range")[1]
    shown = F.when(F.col("_x") >= low, F.col("_x"))
    counted = (rows.join(small(brackets), keys).filter(F.col("_x") <= high)
               .groupBy(*keys, "_n", shown.alias("_v")).agg(F.count(F.lit(1)).alias("_in")))
    along = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("_in").over(along))
    ranks = [F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)]
    hits = [(F.col("_upto") > r) & (F.col("_upto") - F.col("_in") <= r) for r in ranks]
    weight = hits[0].cast("int") + hits[1].cast("int")
    return (placed.filter(hits[0] | hits[1]).groupBy(*keys)
            .agg((F.sum(F.col("_v") / 2 * weight)).alias(name)).drop("_all"))
