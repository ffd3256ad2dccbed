"""Registration of queries and the shared view of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import runloom

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Python workers get the package's own functions with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(runloom)


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(digits: int, *columns: str) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def exact_average(average: str, count: str) -> Column:
    """Average of values in cents, free of the order they were summed in."""
    return (F.round(F.col(average) * F.col(count), 2) / F.col(count)).alias(average)


def text(*parts: Column | str) -> Column:
    """Concatenation of literals and columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c(name: str) -> Column:
    return F.col(name)


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of files."""
    folder, file = sf_dir.rstrip("/"), f"{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{file}")
    return reader.option("pathGlobFilter", file).parquet(folder)
