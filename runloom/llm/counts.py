"""Token counts as rollups that deltas maintain: totals by source, language and tokenizer version.

A batch holds signed rows: +1 document and its tokens for an insert, -1 and minus its tokens for a delete, the difference
of the tokens for a revision. A batch is summed per (source, lang, tokenizer) before it is stored, in a folder of its own
named by the batch id; committing a batch again overwrites that folder, so a repeated or retried commit changes nothing.
Totals are the sums over all stored batches. ``compact`` folds them into one and stores the ids it holds beside it; a folded
batch is final, so committing its id again changes nothing.

NULL sources and languages are groups of their own. NULL texts count as no tokens; a NULL count as 0. Empty batches are
stored with their ids and sum to nothing; a rollup without batches has no totals. The counts may be of any tokenizer; the
registered query counts two word rules, as its SQL cannot count BPE tokens. Repeated rows within a batch count as often as they occur. Groups whose totals are all zero are
left out. Sums are pre-aggregated per task, so a source with a third of all rows is a row per task.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.text import WORD

KEYS = ("source", "lang", "tokenizer")
#: Names of two counting rules that need no vocabulary: words between blanks, and words of letters and digits.
BLANK_WORDS, PLAIN_WORDS = "words-1", "words-2"


def blank_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def signed(df: DataFrame, sign: int, tokenizer: str, tokens: Column) -> DataFrame:
    """Rows of inserts (+1) or deletes (-1)."""
    return df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"),
                     (sign * F.coalesce(tokens.cast("long"), F.lit(0))).alias("tokens"))


def revised(df: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    """Rows of revisions: the document stays, its tokens change."""
    return df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"),
                     (F.coalesce(after.cast("long"), F.lit(0)) - F.coalesce(before.cast("long"), F.lit(0))).alias("tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Batches below one folder that all executors reach."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, rows: DataFrame) -> None:
        """Store a batch; the same id again replaces it, unless it has been folded."""
        if not batch or "/" in batch or "=" in batch:
            raise ValueError(f"not a batch id: {batch!r}")
        if self.folded().filter(F.col("batch") == batch).limit(1).count():
            return
        summed(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        # The id is a row of its own, so that a batch without rows has one, too.
        self.spark.createDataFrame([(batch,)], "id string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_ids/of={batch}")

    def _stored(self, path: str, schema: str) -> DataFrame:
        """The table at a path, an empty one before the first commit."""
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all batches."""
        return summed(self._stored(self.path, self.SCHEMA)).filter((F.col("docs") != 0) | (F.col("tokens") != 0))

    def batches(self) -> DataFrame:
        """The ids of the batches, those without rows included."""
        return self._stored(f"{self.path}/_ids", "id string").select(F.col("id").alias("batch")).distinct()

    def folded(self) -> DataFrame:
        """The ids of the batches that ``compact`` has folded into this rollup."""
        return self._stored(f"{self.path}/_folded", "batch string")

    def compact(self, path: str) -> "Rollup":
        """All batches as one batch in a new folder, with their ids beside it."""
        out = Rollup(self.spark, path)
        self.folded().unionByName(self.batches()).distinct().write.parquet(f"{out.path}/_folded")
        out.commit(f"base-{uuid.uuid4().hex}", self.totals())
        return out
