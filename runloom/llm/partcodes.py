"""Vector codes: vectors cut into parts, each part the number of its nearest codebook entry.

Components become the integers floor(SCALE * x), so all distances are exact. A codebook starts as the parts of the vectors
with the smallest ids; every round assigns all distinct parts, counted once by Spark, and moves each entry to the floored
mean of its parts. A task lays its distinct parts out as a lexicographic trie: sorted rows with a common prefix share the
vector of squared distances that this prefix has to all entries, a depth-first walk adds the further components, and leaves
take the first least entry and add their counted components to its sums. Only sums of entries leave a task.

Rows whose vector is NULL, empty, of a length that ``parts`` does not divide or other than that of the smallest kept id, or
that hold a NULL or non-finite component are dropped. NULL ids are coded but never seed a codebook; of an id with several
vectors the lexicographically least seeds. Repeated rows count and return as often as they occur. Tables without a kept id
give no rows. Components of LIMIT and more fail, as their distances would not fit 64 bits. Other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import shipped, small_side, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Absolute value that no scaled component may reach.
LIMIT = 1 << 26
#: Parts that a task lays out as one trie, and leaves whose distances it holds at a time.
TRIE, LEAVES = 50_000, 4_096


def integers(vector: Column) -> Column:
    """The floors of the scaled components; NULL if one is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    small = F.forall(scaled, lambda x: F.abs(x) < LIMIT)
    return F.when(finite, F.when(small, scaled).otherwise(F.raise_error(F.lit(f"scaled components reach {LIMIT}"))))


def kept_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, x): the whole-numbered vectors that can be cut into the parts."""
    kept = vectors.select("vec_id", "label", integers(F.col("embedding")).alias("x"))
    return kept.filter((F.size("x") > 0) & (F.size("x") % parts == 0))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry and squared distance of each of the lexicographically sorted rows."""
    n, width = rows.shape
    high = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * high * high * width < 1 << 53 else np.int64  # whole numbers are exact in either
    rows, book = rows.astype(kind), book.astype(kind)
    entry, far = np.empty(n, np.int64), np.empty(n, np.int64)

    def leaves(at: np.ndarray, depth: int, shared: np.ndarray) -> None:
        rest = book[:, depth:]
        base = shared + (rest * rest).sum(1)
        for k in range(0, len(at), LEAVES):
            own = rows[at[k:k + LEAVES], depth:]
            all_far = base + (own * own).sum(1)[:, None] - 2 * (own @ rest.T)
            entry[at[k:k + LEAVES]] = all_far.argmin(1)
            far[at[k:k + LEAVES]] = all_far.min(1)

    walk = [(0, n, 0, np.zeros(len(book), kind))] if n else []
    while walk:
        low, high, depth, shared = walk.pop()
        differs = rows[low, depth:] != rows[high - 1, depth:]  # the prefix that the ends of a sorted run share, all share
        end = depth + int(differs.argmax()) if differs.any() else width
        if end > depth:
            shared = shared + ((book[:, depth:end] - rows[low, depth:end]) ** 2).sum(1)
        if end == width:
            entry[low:high], far[low:high] = shared.argmin(), shared.min()
            continue
        starts = low + np.flatnonzero(np.diff(rows[low:high, end], prepend=rows[low, end] - 1))
        ends = np.append(starts[1:], high)
        leaves(starts[ends - starts == 1], end, shared)
        walk += [(a, b, end, shared) for a, b in zip(starts[::-1].tolist(), ends[::-1].tolist()) if b - a > 1]
    return entry, far


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def by_trie(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of rows in any order."""
    order = np.lexsort(rows.T[::-1])
    entry, far = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    entry[order], far[order] = nearest(rows[order], book)
    return entry, far


def entry_sums(books):
    """Function of batches (pos, part, n): (pos, entry, sums), of each used entry the count and the sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books()
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in own]
        held, n = [], 0

        def add() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            pos, rows, times = table["pos"].to_numpy(), matrix(table["part"].combine_chunks()), table["n"].to_numpy()
            for k in np.unique(pos):
                mine = pos == k
                entry, _ = by_trie(rows[mine], own[k])
                np.add.at(sums[k], entry, np.column_stack([times[mine], rows[mine] * times[mine, None]]))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TRIE:
                add()
                held, n = [], 0
        if n:
            add()
        used = [(k, e) for k in range(len(own)) for e in np.flatnonzero(sums[k][:, 0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()),
             pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64()))], ["pos", "entry", "sums"])

    return run


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one for each part position: at most ``entries`` rows of whole numbers; none for an empty table.

    What reaches the driver is of the codebooks' size: the seeds, and each round's sums by entry.
    """
    spark = kept.sparkSession
    named = kept.filter(F.col("vec_id").isNotNull())
    seeds = [r[0] for r in named.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not seeds:
        return []
    first = {r[0]: r[1] for r in named.filter(F.col("vec_id").isin(seeds)).groupBy("vec_id").agg(F.min("x")).collect()}
    size = len(first[seeds[0]])
    whole = np.array([first[i] for i in seeds if len(first[i]) == size], np.int64)
    width = size // parts
    books = [whole[:, k * width:(k + 1) * width].copy() for k in range(parts)]
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("x", k * width + 1, F.lit(width)))
    distinct = kept.filter(F.size("x") == size).select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(
        F.count("*").alias("n"))
    # Ranges of the order keep common prefixes in one task.
    sorted_parts = written(distinct.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "parts", spark)
    for _ in range(rounds):
        found = sorted_parts.mapInArrow(entry_sums(shipped(spark, books)), "pos int, entry int, sums array<long>")
        sums = found.select("pos", "entry", F.posexplode("sums").alias("at", "v")).groupBy("pos", "entry", "at").agg(F.sum("v").alias("v"))
        totals = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for r in sums.collect():
            totals[r["pos"]][r["entry"], r["at"]] = r["v"]
        for book, total in zip(books, totals):
            used = total[:, 0] > 0
            book[used] = total[used, 1:] // total[used, :1]
    return books


def assign(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, codes, error) of every vector of the codebooks' length, in one pass without a shuffle."""
    width, own = books[0].shape[1], shipped(kept.sparkSession, books)
    fields = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = own()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(2))
            found = [by_trie(rows[:, k * width:(k + 1) * width], book) for k, book in enumerate(tables)]
            codes = np.column_stack([e for e, _ in found]).astype(np.int32)
            offsets = pa.array(np.arange(0, codes.size + 1, len(tables)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())),
                 pa.array(sum(f for _, f in found))], ["vec_id", "label", "codes", "error"])

    whole = kept.filter(F.size("x") == width * len(books)).select("vec_id", "label", "x")
    return whole.mapInArrow(run, f"vec_id {fields['vec_id']}, label {fields['label']}, codes array<int>, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error, label_error) and the codebooks; label_error sums the errors of equal labels, NULLs together."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, parts)
    books = fit(kept, parts, entries, rounds)
    if not books:
        nothing = kept.limit(0).select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return nothing.withColumn("label_error", F.col("error")), books
    coded = written(assign(kept, books), "codes", spark)
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors", spark)
    joined = coded.join(small_side(sums, sums.count()), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.drop("of"), books
