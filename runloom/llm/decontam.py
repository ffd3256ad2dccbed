"""Benchmark decontamination: word windows of test items looked up in every training text. Column functions only.

A window is ``n`` consecutive words of an item (lower-cased A-Z, words of ASCII letters, digits and non-ASCII characters);
an item with fewer words, but not none, is one window. The distinct windows are a broadcast hash set where their size is
within ``BROADCAST_BYTES``, else the other side of a shuffled join on the window. Windows are compared as their words, not
as hashes, so every hit is verified by the join itself. Documents are cut into blocks of windows, so a very long text is
never expanded at once.

NULL and empty texts have no words. Repeated document rows give the same row each; documents are told apart by id and text,
so NULL and repeated ids are fine. An item with a NULL id marks its words as hit but is not listed. Empty tables give an
empty or hitless result. Extra columns are ignored by ``scan`` and kept by ``remove_documents`` and ``remove_spans``.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import fresh, q, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of a text before lower-casing.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Words of a window.
WINDOW = 10
#: Windows per row while a text is scanned.
BLOCK = 2048
#: Largest set of windows that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def joined(words: Column, start: Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (window, size, item): every window of every item."""
    w = F.col("words")
    size = F.least(F.size(w), F.lit(n))
    return (benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
            .filter(F.size(w) > 0)
            .select("item", size.alias("size"), F.explode(F.transform(
                F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: joined(w, i, size))).alias("window"))
            .distinct())


def row_key(df: DataFrame) -> list[Column]:
    """What a document is told apart by: its id and its text."""
    return [F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_text")]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document (start 0) and one per window hit: key_id, key_text, n_words, start, size, item.

    One scan: the document's own row travels as the empty window, which the set of windows contains once.
    """
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, n), "windows", spark)
    facts = windows.agg(F.sum(F.octet_length("window") + F.octet_length(F.coalesce("item", F.lit(""))) + 64).alias("bytes"),
                        F.collect_set("size").alias("sizes")).first()
    sizes = sorted(facts["sizes"])  # at most n different ones
    wanted = windows.select("window", "item").unionByName(
        spark.range(1).select(F.lit("").alias("window"), F.lit(None).cast("string").alias("item")))
    w, own = F.col("words"), F.col("own")
    blocks = (docs.select(*row_key(docs), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
              .select("key_id", "key_text", F.size(w).alias("n_words"), "words")
              .select("key_id", "key_text", "n_words", "words", F.explode(
                  F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words") - 1), F.lit(BLOCK))).alias("base"))
              .select("key_id", "key_text", "n_words", "base", F.slice(w, F.col("base") + 1, BLOCK + n - 1).alias("own")))
    kind = "array<struct<start:int,size:int,window:string>>"
    none = F.array().cast(kind)
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("window")))

    def of_size(size: int) -> Column:
        last = F.least(F.lit(BLOCK), F.size(own) - (size - 1))
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
            (F.col("base") + i).alias("start"), F.lit(size).alias("size"), joined(own, i, size).alias("window")))).otherwise(none)

    found = [F.when(F.col("base") == 0, first).otherwise(none), *map(of_size, sizes)]
    scanned = blocks.select("key_id", "key_text", "n_words", F.inline(F.concat(*found)))
    small = (facts["bytes"] or 0) <= BROADCAST_BYTES
    return scanned.join(F.broadcast(wanted) if small else wanted, "window").drop("window")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per distinct (id, text): n_words, ``positions`` of hit words (from 1, ascending) and ``items`` found (sorted)."""
    hit = F.col("start") > 0
    return (hits(docs, benchmark, n).groupBy("key_id", "key_text")
            .agg(F.max("n_words").cast("long").alias("n_words"),
                 F.count(F.when(~hit, 1)).alias("copies"),
                 F.collect_set(F.when(hit, F.struct("start", "size"))).alias("found"),
                 F.array_sort(F.collect_set("item")).alias("items"))
            .select("key_id", "key_text", "n_words", "copies", "items", F.array_sort(F.array_distinct(F.flatten(
                F.transform("found", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))).alias("positions")))


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (text, comma-joined), contaminated."""
    per_text = scan(docs, benchmark, n)
    return per_text.select(
        F.col("key_id").alias("doc_id"), "n_words", F.size("positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"),
        (F.size("positions") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _marked(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, str]:
    """The documents with the positions of their hit words in a new column; NULL where none is hit."""
    a, b, p = fresh(docs, "key_a", "key_b", "positions")
    found = scan(docs, benchmark, n).filter(F.size("positions") > 0).select(
        F.col("key_id").alias(a), F.col("key_text").alias(b), F.col("positions").alias(p))
    joined = docs.join(found, q("doc_id").eqNullSafe(q(a)) & (F.xxhash64("text") == q(b)), "left")
    return joined.drop(a, b), p


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    marked, p = _marked(docs, benchmark, n)
    return marked.filter(q(p).isNull()).drop(p)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents; each hit word is cut out with the separator before it, the rest of the text stays as it is."""
    marked, p = _marked(docs, benchmark, n)
    pieces, rest = fresh(marked, "pieces", "rest")
    return (marked.withColumn(pieces, F.regexp_extract_all(F.col("text"), F.lit(f"[{SEPARATORS}]*[^{SEPARATORS}]+"), F.lit(0)))
            .withColumn(rest, F.regexp_extract(F.col("text"), rf"[{SEPARATORS}]*\z", 0))
            .withColumn("text", F.when(q(p).isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.filter(
                q(pieces), lambda _, i: ~F.array_contains(q(p), (i + 1).cast("int"))), ""), q(rest))))
            .drop(p, pieces, rest))
