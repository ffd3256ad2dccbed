"""Document tables kept in PostgreSQL or MongoDB, read through Spark's connectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.plans.paths import safe_identifier


def jdbc_options(url: str, table: str, *, key_bounds: tuple[str, int, int, int] | None = None,
                 properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of a JDBC document scan; ``key_bounds`` is (column, low, high, partitions)."""
    options = {"url": url, "dbtable": safe_identifier(table), "fetchsize": "10000", **(properties or {})}
    if key_bounds:
        column, low, high, parts = key_bounds
        options.update(partitionColumn=safe_identifier(column), lowerBound=str(low), upperBound=str(high),
                       numPartitions=str(parts))
    return options


def read_jdbc_documents(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """Documents as (key, doc text, created_at, updated_at); plain-column predicates reach the server."""
    raw = spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()
    return raw.select(F.col("exp_id").alias("key"), F.col("data").cast("string").alias("doc"), "created_at", "updated_at")


def read_mongo_documents(spark: SparkSession, uri: str, database: str, collection: str) -> DataFrame:
    """Collection documents with a ``doc`` text column. Needs the MongoDB connector on the class path."""
    raw = (spark.read.format("mongodb").option("connection.uri", uri)
           .option("database", safe_identifier(database)).option("collection", safe_identifier(collection)).load())
    body = [c for c in raw.columns if c != "_id"]
    return raw.select(F.col("_id").cast("string").alias("key"), F.to_json(F.struct(*body)).alias("doc"), *body)
