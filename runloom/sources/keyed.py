"""Keyed tables: rows in buckets by the hash of their key; a commit rewrites only the buckets that it touches.

Rows lie below ``rows/version=…/bucket=…``, and ``manifest`` says for every commit which buckets it wrote. The current rows
of a bucket are those of its last commit, so a reader opens one version of each wanted bucket and no other file. A commit
has a name; the same name again replaces its own rows and reads what was there before it, so retries change nothing. Rows
without a manifest entry, as after a lost driver, are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table: what is listed on the driver is a row for each.
BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def commits(self) -> DataFrame:
        """(version, bucket, seq) of all commits."""
        schema = "bucket int, seq long, version string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """The current rows, or those before a commit, of all buckets or some. Buckets and versions are partition filters."""
        commits = self.commits() if before is None else self.commits().filter(F.col("seq") < before)
        if buckets is not None:
            commits = commits.filter(F.col("bucket").isin(list(buckets)))
        last: dict[str, list[int]] = {}
        for r in commits.groupBy("bucket").agg(F.max_by("version", "seq").alias("version")).collect():  # at most a row for each bucket
            last.setdefault(r["version"], []).append(r["bucket"])
        if not last:
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema.fields, T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
        wanted = reduce(lambda a, b: a | b, [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in last.items()])
        return self.spark.read.schema(full).parquet(f"{self.path}/rows").filter(wanted).select(*self.schema.names)

    def commit(self, name: str, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the buckets that ``delta`` has keys of by ``merge(their rows, delta)``; these buckets."""
        touched = [r[0] for r in self.with_bucket(delta).select("bucket").distinct().collect()]
        own = self.commits().agg(F.max(F.when(F.col("version") == name, F.col("seq"))).alias("own"), F.max("seq").alias("last")).first()
        seq = own["own"] if own["own"] is not None else (own["last"] or 0) + 1
        merged = self.with_bucket(merge(self.rows(touched, seq), delta).select(*self.schema.names))
        # One task a bucket and hash of the key, so files do not multiply and a large bucket is not one task.
        merged.repartition("bucket", *self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={name}")
        done = self.spark.createDataFrame([(b, seq) for b in touched], "bucket int, seq long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={name}")
        return touched


def replaced(before: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``delta``, and those of ``before`` whose key it does not have."""
    on = [before[k].eqNullSafe(delta[k]) for k in key]
    return before.join(delta, reduce(lambda a, b: a & b, on), "left_anti").unionByName(delta)
