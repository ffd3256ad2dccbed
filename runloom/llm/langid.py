"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams in a bounded sample of documents per language (``DOCS_PER_LANGUAGE``), split over tasks and summed
by Spark per language and bucket. The smoothed log-probability matrix (languages x buckets) is sent to the tasks, where a
batch of texts becomes a sparse count matrix that numpy multiplies with it.

A text is lower-cased; runs of anything but letters count as one blank. A text without a letter, empty or NULL, is ``und``
with score 0. Rows without a language, without a letter or held out teach nothing; without any teaching rows every text
is ``und``. Repeated rows give a row each; ties go to the alphabetically first language; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import hashed_share, held_out, shipped

#: Documents per language that teach (expected number).
DOCS_PER_LANGUAGE = 3000
SIZES = (2, 3)
BUCKET_BITS = 14
SMOOTHING = 0.5
UNKNOWN = "und"
#: Texts are hashed in pieces of so many characters, so memory does not grow with a text.
PIECE = 1 << 20
#: Largest matrix that is sent to the tasks.
MATRIX_BYTES = 256 << 20


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters as code points with single zeros between words and at both ends."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    if low.isascii():
        letter = (codes >= 97) & (codes <= 122)
    else:
        kinds, inverse = np.unique(codes, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds], bool)[inverse]
    out = np.zeros(len(codes) + 2, np.uint32)
    out[1:-1] = np.where(letter, codes, 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def buckets(codes: np.ndarray) -> np.ndarray:
    """Occurrences of every n-gram bucket in a run of codes."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    wide = codes.astype(np.uint64)
    for n in SIZES:
        if len(wide) >= n:
            key = np.full(len(wide) - n + 1, n, np.uint64)
            for i in range(n):
                key = key * np.uint64(1_000_003) + wide[i:len(wide) - n + 1 + i]
            key *= np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
    return counts


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts of one text; none if it has no letter."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    overlap = max(SIZES) - 1
    codes = letter_codes(text) if text else np.zeros(0, np.uint32)
    if codes.any():
        for start in range(0, len(codes), PIECE):
            piece = codes[start:start + PIECE + overlap]
            total += buckets(piece)
            if len(codes) > start + PIECE:  # n-grams that begin in the overlap belong to the next piece
                total -= buckets(codes[start + PIECE:start + PIECE + overlap])
    found = np.flatnonzero(total)
    return found, total[found]


def count_grams(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (lang, bucket, n) over all its texts; at most languages x buckets rows."""
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame.column(0), frame.column(1)):
            own = sums.setdefault(lang.as_py(), np.zeros(1 << BUCKET_BITS, np.int64))
            found, n = gram_counts(text.as_py())
            own[found] += n
    for lang, own in sums.items():
        found = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(own[found], pa.int64())],
            ["lang", "bucket", "n"])


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed log-probabilities per bucket.

    The shares come from the languages' document counts; a language with few documents is taken whole. What reaches the
    driver is the matrix itself, whose size is checked against ``MATRIX_BYTES``.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(100_000).collect()}
    if 8 * len(sizes) << BUCKET_BITS > MATRIX_BYTES:
        raise ValueError(f"{len(sizes)} languages make a matrix of more than {MATRIX_BYTES} bytes")
    if not sizes:
        return [], np.zeros((0, 1 << BUCKET_BITS))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, docs_per_language / n)) for k, n in sizes.items()], "lang string, share double")
    sample = known.join(F.broadcast(shares), "lang").filter(hashed_share(F.col("doc_id"), seed) < F.col("share"))
    counts = (sample.select("lang", "text").mapInArrow(count_grams, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts.lang.unique())
    matrix = np.full((len(langs), 1 << BUCKET_BITS), SMOOTHING)
    matrix[counts.lang.map({k: i for i, k in enumerate(langs)}).to_numpy(int), counts.bucket.to_numpy(int)] += counts.n.to_numpy(float)
    return langs, np.log(matrix / matrix.sum(1, keepdims=True))


def predictor(model):
    """Column function text -> struct(lang_pred, score): the likeliest language and its posterior probability."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, logs = model()
        table = np.ascontiguousarray(logs.T)
        for batch in batches:
            rows = [gram_counts(text.as_py()) for text in batch]
            names, scores = [UNKNOWN] * len(rows), np.zeros(len(rows))
            full = [i for i, (found, _) in enumerate(rows) if len(found) and langs]
            for part in range(0, len(full), 256):  # sparse rows of 256 texts times the matrix
                own = full[part:part + 256]
                starts = np.cumsum([0, *(len(rows[i][0]) for i in own)])[:-1]
                at = np.concatenate([rows[i][0] for i in own])
                n = np.concatenate([rows[i][1] for i in own])
                total = np.add.reduceat(table[at] * n[:, None], starts, axis=0)
                best = total.argmax(1)
                odds = np.exp(total - total.max(1, keepdims=True))
                for k, i in enumerate(own):
                    names[i], scores[i] = langs[best[k]], odds[k, best[k]] / odds[k].sum()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, **sizes) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    own = shipped(docs.sparkSession, model or fit(docs, **sizes))
    return docs.select("doc_id", held_out().alias("held_out"), predictor(own)("text").alias("guess")).select(
        "doc_id", "held_out", "guess.*")
