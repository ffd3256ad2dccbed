"""Put, patch and delete of documents as an append-only log, and the current view over it.

A log row is (key, op, doc, seq, ts): ``put`` replaces the document, ``patch`` merges top-level
fields into it, ``delete`` removes it. ``seq`` orders the changes of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import shared_dir

LOG_COLUMNS = ["key", "op", "doc", "seq", "ts"]


def append(log: DataFrame, path: str) -> None:
    log.select(*LOG_COLUMNS).write.mode("append").parquet(path)


def current_fields(log: DataFrame) -> DataFrame:
    """Current value (JSON text) of each top-level field: key, field, value.

    Both aggregates are per-task partial ones, so a key may own most of the log. The last put or
    delete of a key is applied to the folded fields, not to the raw rows.
    """
    reset = F.col("op").isin("put", "delete")
    bounds = log.groupBy("key").agg(F.max(F.when(reset, F.col("seq"))).alias("_reset"))
    changes = log.filter(F.col("op") != "delete").select(
        "key", "seq", F.explode(F.from_json("doc", "map<string,variant>")).alias("field", "_v"))
    latest = changes.groupBy("key", "field").agg(
        F.max("seq").alias("_seq"), F.max_by(F.to_json("_v"), "seq").alias("value"))
    joined = latest.join(bounds, "key")
    return joined.filter(F.col("_reset").isNull() | (F.col("_seq") >= F.col("_reset"))).select("key", "field", "value")


def live_keys(log: DataFrame) -> DataFrame:
    """Existing keys with created_at (first change since the last delete) and updated_at.

    ``last`` has one row per key, so a hot key splits on the log side of the join only.
    """
    last = log.groupBy("key").agg(
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_deleted"))
    since = log.filter(F.col("op") != "delete").join(last, "key").filter(
        F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted")))
    return since.groupBy("key").agg(
        F.min_by("ts", "seq").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"))


def current_view(log: DataFrame) -> DataFrame:
    """Current documents (key, doc map of JSON values, created_at, updated_at)."""
    fields = current_fields(log).groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("doc"))
    empty = F.create_map().cast("map<string,string>")
    return live_keys(log).join(fields, "key", "left").withColumn("doc", F.coalesce("doc", empty))


def compact(log: DataFrame, path: str | None = None) -> DataFrame:
    """Write the current view as a new table and return it; the log is left as it is."""
    path = path or shared_dir(log.sparkSession, "documents")
    current_view(log).write.parquet(path)
    return log.sparkSession.read.parquet(path)


def snapshot(df: DataFrame, root: str, label: str) -> DataFrame:
    """Copy of a table in its own ``version=`` folder before a bulk change."""
    path = f"{root.rstrip('/')}/version={label}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def register_checkpoints(rows: DataFrame, path: str) -> None:
    """Append registrations (exp_id, pos, path, registered_at, epoch, metrics)."""
    rows.write.mode("append").parquet(path)
