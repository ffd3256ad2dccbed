"""Incremental harvest: new results become run records, stored ones are left alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.attempts import PARTIAL, build_summaries, finish_summaries, merge_partials, partial_summaries
from runloom.operators.runs import run_records, skip_stored
from runloom.sources.keyed import KeyedTable, replaced


def _folder(batch: DataFrame, path: str, batch_id: int) -> tuple[str, Column]:
    """Folder of one micro-batch, and the condition for rows stored before it.

    A batch repeated after a failure overwrites its own folder only. The query's id is part of
    the name, so a query started with new progress cannot touch an older one's batches.
    """
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    earlier = (F.col("query") != query_id) | (F.col("batch") < batch_id)
    return f"{path}/query={query_id}/batch={batch_id}", earlier


def _stored(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one before the first batch."""
    spark = df.sparkSession
    full = T.StructType([*schema.fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    return spark.read.schema(full).parquet(path) if exists else spark.createDataFrame([], full)


def harvest(stream: DataFrame, to_runs: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
            key: str = "run_id") -> None:
    """Turn the rows that are there into run records and append those whose key is not stored."""

    def store(batch: DataFrame, batch_id: int) -> None:
        runs = to_runs(batch)
        target, earlier = _folder(batch, path, batch_id)
        stored = _stored(batch, path, runs.schema).filter(earlier)
        skip_stored(runs, stored, key).write.mode("overwrite").parquet(target)

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def materialise_summaries(stream: DataFrame, runs_path: str, summaries_path: str, checkpoint: str,
                          group: str = "attempt_group_id", **columns: str) -> None:
    """Store new runs and rebuild the summaries of the groups they touch, from all stored runs.

    Summaries are appended per batch; :func:`current_summaries` picks each group's latest.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        target, earlier = _folder(batch, runs_path, batch_id)
        batch.write.mode("overwrite").parquet(target)
        own = batch.sparkSession.read.schema(batch.schema).parquet(target)
        before = _stored(batch, runs_path, batch.schema).filter(earlier).select(*batch.columns)
        touched = own.select(group).distinct()
        runs = before.join(touched, group, "left_semi").unionByName(own)
        summaries = build_summaries(runs, group=group, **columns).withColumn("updated_at", F.current_timestamp())
        summaries.write.mode("overwrite").parquet(_folder(batch, summaries_path, batch_id)[0])

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def current_summaries(summaries: DataFrame, group: str = "attempt_group_id") -> DataFrame:
    others = [c for c in summaries.columns if c not in (group, "query", "batch")]
    latest = F.max_by(F.struct(*others), F.struct("updated_at", "batch"))
    return summaries.groupBy(group).agg(latest.alias("_s")).select(group, "_s.*")


#: Results of evaluation directories, and the key of the run that a directory belongs to.
DIRECTORIES = "exp_id string, stamp string, scope string, dir_name string, job_id string, score double, scenarios long"
RUN_KEY = ["exp_id", "stamp"]


def _commit_name(batch: DataFrame, batch_id: int) -> str:
    """A name that a repeated batch of the same query has again."""
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    return f"{query_id}-{batch_id}"


def harvest_directories(stream: DataFrame, to_directories: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Runs from directory results that may arrive in any order and in any batches.

    Results are kept by directory, a later one replacing an earlier one of the same directory. The runs (experiment, stamp)
    that a batch touches are derived anew from all their directories, and only the buckets of such runs are read and written.
    """
    spark = stream.sparkSession
    directories = KeyedTable(spark, f"{path}/directories", DIRECTORIES, RUN_KEY)

    def newest(before: DataFrame, delta: DataFrame) -> DataFrame:
        return replaced(before, delta.dropDuplicates([*RUN_KEY, "dir_name"]), [*RUN_KEY, "dir_name"])

    def store(batch: DataFrame, batch_id: int) -> None:
        name = _commit_name(batch, batch_id)
        found = to_directories(batch).select(*directories.schema.names)
        touched = directories.commit(name, found, newest)
        keys = found.select(*RUN_KEY).distinct()
        derived = run_records(directories.rows(touched).join(keys, RUN_KEY, "left_semi"))
        KeyedTable(spark, f"{path}/runs", derived.schema, RUN_KEY).commit(name, derived, lambda before, delta: replaced(before, delta, RUN_KEY))

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def harvested_runs(spark: SparkSession, path: str) -> DataFrame:
    """The current run records of ``harvest_directories``."""
    schema = run_records(spark.createDataFrame([], DIRECTORIES)).schema
    return KeyedTable(spark, f"{path}/runs", schema, RUN_KEY).rows()


def _partials(spark: SparkSession, path: str, seq: str, group: str) -> KeyedTable:
    return KeyedTable(spark, path, f"{group} string, {PARTIAL.format(seq=seq)}", [group])


def fold_summaries(stream: DataFrame, path: str, checkpoint: str, group: str = "attempt_group_id", seq: str = "seq", **columns: str) -> None:
    """Keep the partial summary of every group; a batch is summed up and merged into those of the groups it touches.

    No stored run is read again. The table at ``path`` belongs to one progress folder: a stream started anew counts anew.
    """
    table = _partials(stream.sparkSession, path, stream.schema[seq].dataType.simpleString(), group)

    def store(batch: DataFrame, batch_id: int) -> None:
        delta = partial_summaries(batch, seq=seq, group=group, **columns)
        table.commit(_commit_name(batch, batch_id), delta, lambda before, new: merge_partials(before, new, group))

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def folded_summaries(spark: SparkSession, path: str, group: str = "attempt_group_id", seq: str = "bigint") -> DataFrame:
    """The current summaries of ``fold_summaries``."""
    return finish_summaries(_partials(spark, path, seq, group).rows(), group)
