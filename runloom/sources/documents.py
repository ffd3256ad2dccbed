"""Documents under put, patch and delete as a base table and deltas.

``apply`` folds a delta of log rows (key, op, doc, seq, ts) into the base: only the buckets with changed keys are read and
rewritten, the delta is scanned once for its fields and once for the times of documents made anew after a delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.sources.keyed import BUCKETS, KeyedTable


def folded(delta: DataFrame) -> DataFrame:
    """One row a key: fields after the last put or delete, whether there was one, and times of the living document.

    Both groupings are pre-aggregated, first by (key, field), then by key; an array holds the fields of one document.
    """
    change = F.col("op") != "delete"
    parts = delta.filter(F.col("key").isNotNull()).select("key", "op", "seq", "ts", F.explode_outer(
        F.when(change, F.from_json("doc", "map<string,variant>"))).alias("field", "_v"))
    by_field = parts.groupBy("key", "field").agg(
        F.max(F.when(F.col("op").isin("put", "delete"), F.col("seq"))).alias("reset"), F.max(F.when(~change, F.col("seq"))).alias("deleted"),
        F.max(F.when(change, F.col("seq"))).alias("seq"), F.max_by(F.to_json("_v"), "seq").alias("value"),
        F.min(F.when(change, F.struct("seq", "ts"))).alias("first"), F.max(F.when(change, F.struct("seq", "ts"))).alias("last"))
    whole = by_field.groupBy("key").agg(
        F.max("reset").alias("reset"), F.max("deleted").alias("deleted"), F.max("seq").alias("seq"), F.min("first")["ts"].alias("first"),
        F.max("last")["ts"].alias("last"), F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value", "seq"))).alias("f"))
    kept = F.filter("f", lambda x: F.col("reset").isNull() | (x["seq"] >= F.col("reset")))
    living = F.col("seq").isNotNull() & (F.col("deleted").isNull() | (F.col("seq") > F.col("deleted")))
    rows = whole.select("key", "reset", "deleted", "first", "last", F.coalesce(living, F.lit(False)).alias("living"), F.map_from_entries(
        F.transform(kept, lambda x: F.struct(x["field"], x["value"]))).alias("fields"))
    again = rows.filter("living AND deleted IS NOT NULL").select("key", "deleted")
    since = delta.filter(change).join(again, "key").filter(F.col("seq") > F.col("deleted")).groupBy("key").agg(F.min_by("ts", "seq").alias("since"))
    return rows.join(since, "key", "left")


def overlaid(old: Column, new: Column) -> Column:
    """Fields of both maps, those of ``new`` first."""
    return F.map_concat(F.map_filter(old, lambda name, _: ~F.map_contains_key(new, name)), new)


def merge(before: DataFrame, delta: DataFrame) -> DataFrame:
    """The documents after the changes of ``delta``."""
    new = folded(delta)
    both = before.join(new, "key", "full")
    empty = F.create_map().cast("map<string,string>")
    kept = F.when(F.col("reset").isNull(), F.coalesce("doc", empty)).otherwise(empty)
    untouched = F.col("living").isNull()
    # A document keeps its time unless it was deleted; one that the base does not have begins with the delta.
    created = F.when(F.col("deleted").isNotNull(), F.col("since")).otherwise(F.coalesce("created_at", "first"))
    return both.filter(untouched | F.col("living")).select(
        "key", F.when(untouched, F.col("doc")).otherwise(overlaid(kept, F.coalesce("fields", empty))).alias("doc"),
        F.when(untouched, F.col("created_at")).otherwise(created).alias("created_at"),
        F.when(untouched, F.col("updated_at")).otherwise(F.col("last")).alias("updated_at"))


class DocumentTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "string", time: str = "timestamp", buckets: int = BUCKETS):
        self.table = KeyedTable(spark, path, f"key {key}, doc map<string,string>, created_at {time}, updated_at {time}", ["key"], buckets)

    def apply(self, name: str, delta: DataFrame) -> list[int]:
        """Fold a delta in; deltas come in the order of ``seq``, the same name again changes nothing. The rewritten buckets."""
        return self.table.commit(name, delta.filter(F.col("key").isNotNull()), merge)

    def current(self) -> DataFrame:
        """(key, doc, created_at, updated_at) of the living documents."""
        return self.table.rows()
