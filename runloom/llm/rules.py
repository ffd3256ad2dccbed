"""Quality rules: counts per text, two fixed limits, and an isolation forest over the rule statistics.

Random splits isolate unusual documents early, so a short mean path means an anomaly. By the method each tree draws its splits
from ``ROWS_PER_TREE`` documents of its own, drawn from the whole table. What a leaf holds, and so its path length, is counted over
all documents by Spark. The limit on the anomaly score comes from all labelled rows: the lowest limit that rejects at most
``MAX_FALSE_REJECTS`` of the rows labelled good, moved half-way to the next row labelled bad. Only the drawn rows, a number
for each node and the limit reach the driver.

NULL and empty texts have no words, so the fixed limits reject them. NULL ids cannot be labelled. Repeated rows give a row
each. Without labelled rows ``DEFAULT_LIMIT`` is used; with an empty table the forest is empty and never asked. Extra
columns stay in ``keep_good`` and are ignored by ``report``.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import bounded_sample, fresh, q, shipped, small_side, written

TREES = 100
ROWS_PER_TREE = 256
MAX_FALSE_REJECTS = 0.002
DEFAULT_LIMIT = 0.7
#: Fixed limits: fewest words, and the largest share of repeated words (per cent).
LEAST_WORDS = 50
MOST_REPEATED = 50

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
N_FEATURES = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def byte_classes() -> np.ndarray:
    """0 other ASCII, 1 upper case, 2 lower case, 3 digit, 4 blank, 5 beyond ASCII."""
    out = np.zeros(256, np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = 1, 2, 3, 5
    out[[ord(c) for c in BLANKS]] = 4
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    v = len(numbers)
    pairs = ids[:-1] * v + ids[1:]
    if v > 1 << 20:
        pairs, v = np.unique(pairs, return_inverse=True)[1].astype(np.int64), n
        keys = pairs[:-1] * v + ids[2:]
    else:
        keys = pairs[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift:n - 2 + shift] |= twice
    return int(hit.sum())


def measure(text: str | None, classes: np.ndarray) -> tuple[list[int], list[float]]:
    """The rule counts of a text and the statistics the forest looks at."""
    text = text or ""
    body = text.encode()
    words = body.split()
    n = len(words)
    lines = [line for line in body.split(b"\n") if line.strip()]
    n_dup = len(lines) - len(set(lines))
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    kinds = np.bincount(classes[np.frombuffer(body, np.uint8)], minlength=6) if body else np.zeros(6, int)
    letters = max(1, kinds[1] + kinds[2] + kinds[5])
    inner = max(1, chars)
    return [n, chars, symbols, n_dup, repeats], [
        chars / max(1, n), symbols / inner, repeats / max(1, n), kinds[1] / letters, kinds[0] / inner]


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows; in between for an expected number that is not whole."""
    if n <= 2:
        return max(0.0, n - 1.0)
    far = max(n, 3.0)
    path = 2 * (np.log(far - 1) + 0.5772156649) - 2 * (far - 1) / far
    return path if n >= 3 else 1 + (n - 2) * (path - 1)


class Forest:
    """Trees as flat arrays: feature, split value, children, path length where a node is a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = ROWS_PER_TREE, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        self.depth = int(np.ceil(np.log2(max(2, size)))) + 2
        self.size, self.typical = size, mean_path(size) or 1.0
        self.feature, self.value, self.child, self.length, self.roots = [], [], [], [], []
        for _ in range(trees if len(rows) > 1 else 0):
            self.roots.append(self._grow(rows[rng.choice(len(rows), size, replace=False)], 0, rng))
        self.feature, self.value = np.array(self.feature, int), np.array(self.value, float)
        self.child, self.length = np.array(self.child, int).reshape(-1, 2), np.array(self.length, float)

    def _grow(self, rows: np.ndarray, depth: int, rng) -> int:
        me = len(self.feature)
        self.feature.append(0), self.value.append(0.0), self.child.append([me, me])
        self.length.append(depth + mean_path(len(rows)))
        low, high = rows.min(0), rows.max(0)
        usable = np.flatnonzero(high > low)
        if depth < self.depth and len(usable):
            f = int(rng.choice(usable))
            v = rng.uniform(low[f], high[f])
            left = rows[:, f] < v
            self.feature[me], self.value[me] = f, v
            self.child[me] = [self._grow(rows[left], depth + 1, rng), self._grow(rows[~left], depth + 1, rng)]
        return me

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        node = np.repeat(np.array(self.roots, int)[None], len(rows), 0)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth + 1):
            node = self.child[node, (rows[at, self.feature[node]] >= self.value[node]).astype(int)]
        return node

    def settle(self, nodes: np.ndarray, held: np.ndarray, total: int):
        """Path lengths by what the leaves hold of all ``total`` rows, as numbers among a tree's own rows."""
        depth = np.zeros(len(self.feature))
        for me, (left, right) in enumerate(self.child):  # children come after their parent
            if left != me:
                depth[[left, right]] = depth[me] + 1
        own = np.zeros(len(self.feature))
        own[nodes] = held * (self.size / total)
        self.length = depth + np.array([mean_path(n) for n in own])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1 for each row."""
        if not self.roots or not len(rows):
            return np.zeros(len(rows))
        return 2.0 ** (-self.length[self.leaves(rows)].mean(1) / self.typical)


STATS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",features:array<double>,anomaly:double>"


def measurer(model=None):
    """Column function text -> counts, statistics and (with a forest sent to the tasks) the anomaly score."""

    @F.arrow_udf(STATS_TYPE)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes = byte_classes()
        forest = model() if model else None
        for batch in batches:
            got = [measure(text.as_py(), classes) for text in batch]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(COUNTS))
            features = np.array([f for _, f in got], float).reshape(len(got), N_FEATURES)
            score = forest.score(features) if forest else np.zeros(len(got))
            columns = [pa.array(c) for c in counts.T] if len(got) else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.StructArray.from_arrays(
                [*columns, pa.array(list(features), pa.list_(pa.float64())), pa.array(score, pa.float64())],
                [*COUNTS, "features", "anomaly"])

    return stats


def feature_rows(features: pa.Array) -> np.ndarray:
    return np.asarray(features.flatten(), float).reshape(len(features), N_FEATURES)


def anomaly(model):
    """Column function features -> anomaly score."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forest = model()
        for batch in batches:
            yield pa.array(forest.score(feature_rows(batch)), pa.float64())

    return score


def leaf_counts(stats: DataFrame, model) -> DataFrame:
    """(node, n): the rows at every leaf, counted in each task first."""

    def count_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model()
        held = np.zeros(len(forest.feature), np.int64)
        for batch in batches:
            held += np.bincount(forest.leaves(feature_rows(batch.column(0))).ravel(), minlength=len(held))
        nodes = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(held[nodes])], ["node", "n"])

    return stats.select("features").mapInArrow(count_leaves, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the rule counts and the features of every document, as a written table."""
    return written(docs.select("doc_id", measurer()("text").alias("s")).select("doc_id", *[f"s.{c}" for c in COUNTS], "s.features"), "rule-counts")


def fit(stats: DataFrame, labels: DataFrame, max_false_rejects: float = MAX_FALSE_REJECTS, seed: int = 11) -> tuple[Forest, float]:
    """The forest of all documents and the limit from all labelled ones; ``stats`` as ``measured`` gives them."""
    total = stats.count()
    drawn = bounded_sample(stats, F.struct("doc_id", *COUNTS), TREES * ROWS_PER_TREE, seed).select("features").toPandas()
    features = np.array(drawn.features.tolist(), float).reshape(len(drawn), N_FEATURES)
    forest = Forest(features[np.lexsort(features.T)], seed=seed)
    if forest.roots:
        held = leaf_counts(stats, shipped(stats.sparkSession, forest)).toPandas()
        forest.settle(held.node.to_numpy(), held.n.to_numpy(), total)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias("known_id")).agg(F.max("quality").alias("good"))
    known = small_side(known, known.count())
    scored = written(stats.filter(F.col("n_words") >= LEAST_WORDS).join(known, F.col("doc_id") == F.col("known_id")).select(
        "good", anomaly(shipped(stats.sparkSession, forest))("features").alias("anomaly")), "rule-scores")
    good = scored.filter("good = 1").select("anomaly")
    n_good = good.count()
    if not n_good:
        return forest, DEFAULT_LIMIT
    lowest = good.orderBy(F.desc("anomaly")).offset(int(np.floor(n_good * max_false_rejects))).limit(1).first()["anomaly"]
    bad = scored.filter((F.col("good") == 0) & (F.col("anomaly") > lowest)).agg(F.min("anomaly").alias("least")).first()["least"]
    return forest, float(lowest + 1e-9 if bad is None else (lowest + bad) / 2)


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def report(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """doc_id, the counts, base_failed, kept and anomaly of every document."""
    stats = measured(docs)
    forest, limit = fit(stats, labels, **sizes)
    judged = stats.withColumn("anomaly", anomaly(shipped(stats.sparkSession, forest))("features"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") <= limit)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """The documents that the fixed limits and the forest accept, with all their columns."""
    forest, limit = fit(measured(docs), labels, **sizes)
    raw, = fresh(docs, "rule_stats")
    s = q(raw)
    return docs.withColumn(raw, measurer(shipped(docs.sparkSession, forest))("text")).filter(
        ~base_failed(s["n_words"], s["n_repeat_words"]) & (s["anomaly"] <= limit)).drop(raw)
