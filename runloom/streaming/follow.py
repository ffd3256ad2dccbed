"""Following log folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines of new log files as a stream. Bytes appended to a file already read are not seen."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and append it to a table; a repeated run adds only new files."""
    (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start(path).awaitTermination())
