"""Helpers shared by the operators: folds, fresh column names, bounded samples, word splitting, written tables."""

import pickle
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import shared_dir

#: Remainder of crc32(doc_id as text) mod 4 whose rows no model learns from.
HELD_OUT_FOLD = 2
#: Remainder used to calibrate thresholds; the other two train.
CALIBRATION_FOLD = 3
#: Words are runs of anything but these ASCII blanks (the ones ``bytes.split()`` splits on, too).
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 4; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no model may learn from; a NULL id is not held out."""
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of ``df`` has it (ignoring case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, label: str, spark: SparkSession | None = None, group_rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and lost executors cost no recomputation.

    ``group_rows``: most rows of a row group. A reader holds up to 4,096 rows of one group at once, so long rows need small groups.
    """
    spark = spark or df.sparkSession
    path = shared_dir(spark, f"{label}-{uuid.uuid4().hex[:8]}")
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_share(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) fixed by the key: the row's place in every sample."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(df: DataFrame, key: Column, expected: int, seed: int) -> DataFrame:
    """Rows chosen by the hash of their key, about ``expected`` of them; all rows of a smaller table.

    The count is a distributed aggregate; no row is ordered or collected. The share depends on the count
    alone, so the sample has the same expected size at every scale.
    """
    total = df.count()
    return df if total <= expected else df.filter(hashed_share(key, seed) < F.lit(expected / total))


def shipped(spark: SparkSession, model) -> Callable:
    """Broadcast a fitted model; the returned function gives it back inside a task, the package need not be installed there."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(packed.value)


#: Key tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of narrow rows, broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
