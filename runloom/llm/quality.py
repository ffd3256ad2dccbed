"""Quality by co-training: a text-content and a page-metadata classifier teach each other, then score together.

The content view is a hashed bag of word shapes and repeats; the metadata view is source, language, length and line
layout. Views are computed once for every document and written. Both classifiers are logistic regressions, trained in numpy
on a bounded sample of labelled rows (``LABELLED``) and on pseudo-labels. Every unlabelled document of the corpus stands in
the pool of one of the ``ROUNDS`` rounds; there both views score it, and those that a view is sure of are candidates for the
other. Of these, each label takes an expected ``PICKS`` to learn from, in equal parts from all pairs of source and language
(all candidates of a pair that has too few). Each view is then calibrated on a fold of its own (Platt), and a last logistic layer joins the calibrated
views. Fold 2 of the id's crc32 is held out from all of it.

NULL and empty texts have an empty content view and are scored by their metadata. Without rows of both labels every score
is 0.5. Ids labelled twice take the higher label; NULL ids teach nothing, and of several texts under a labelled id one
does (the lowest by hash). Repeated rows give a row each and teach once. Columns besides
doc_id, text, source, lang and n_chars are ignored.
"""

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import CALIBRATION_FOLD, HELD_OUT_FOLD, bounded_sample, fold, hashed_share, held_out, shipped, written

LABELLED, PICKS = 4000, 150
SHAPE_BUCKETS, NAME_BUCKETS = 512, 64
ROUNDS, SURE = 4, 0.95
CACHE_WORDS = 200_000
#: Features of each view.
WIDTHS = {"content": SHAPE_BUCKETS + 3, "meta": 2 * NAME_BUCKETS + 4}
FEATURES = "struct<content:array<float>,meta:array<float>>"


class Shapes(dict):
    """Word -> bucket of its shape: letters as A or a, digits as 0, runs shortened to two."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        form = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", word))
        form = re.sub(r"(.)\1{2,}", r"\1\1", form)
        out = self[word] = crc32(form.encode("utf-8", "surrogatepass")) % SHAPE_BUCKETS
        return out


def content_view(text: str | None, shapes: Shapes) -> np.ndarray:
    out = np.zeros(WIDTHS["content"])
    words = text.split() if text else []
    if words:
        ids = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
        out[:SHAPE_BUCKETS] = np.sqrt(np.bincount(ids, minlength=SHAPE_BUCKETS) / len(words))
        out[-3] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[-2] = len(set(words)) / len(words) ** 0.75
        out[-1] = sum(map(len, words)) / len(words) / 10
    return out


def meta_view(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(WIDTHS["meta"])
    for k, name in enumerate((source, lang)):
        if name is not None:
            out[k * NAME_BUCKETS + crc32(name.encode()) % NAME_BUCKETS] = 1
    lines = (text or "").split("\n")
    length = len(text or "") if n_chars is None else n_chars
    out[-4:] = np.log1p(max(0, length)) / 10, np.log1p(len(lines)) / 5, np.log1p(max(map(len, lines))) / 10, \
        np.log1p(sum(map(len, lines)) / len(lines)) / 10
    return out


class Logistic:
    """L2-regularised logistic regression, fitted by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-4:
                break

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Two views, their calibrations, and the layer that joins them."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, calibrates: np.ndarray):
        self.known, self.y, self.calibrates = views, y, calibrates
        self.rows = [[v[~calibrates]] for v in views]
        self.labels = [[y[~calibrates]] for _ in views]

    def fits(self) -> list[Logistic]:
        return [Logistic(np.concatenate(rows), np.concatenate(labels)) for rows, labels in zip(self.rows, self.labels)]

    def learn(self, k: int, rows: np.ndarray, labels: np.ndarray) -> None:
        """Pseudo-labelled rows for the k-th view."""
        self.rows[k].append(rows)
        self.labels[k].append(labels)

    def finish(self) -> "CoTrained":
        """Calibrate and join the views; what they learned from is let go."""
        self.views, y, calibrates = self.fits(), self.y, self.calibrates
        check = calibrates if len(set(y[calibrates])) == 2 else ~calibrates
        self.platt = [Logistic(v.odds(x[check])[:, None], y[check]) for v, x in zip(self.views, self.known)]
        self.joint = Logistic(np.c_[*(self._calibrated(k, v[check]) for k, v in enumerate(self.known))], y[check])
        del self.known, self.y, self.calibrates, self.rows, self.labels
        return self

    def _calibrated(self, k: int, x: np.ndarray) -> np.ndarray:
        return self.platt[k].odds(self.views[k].odds(x)[:, None])

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        odds = [self._calibrated(k, v) for k, v in enumerate(views)]
        return sigmoid(self.joint.odds(np.c_[*odds])), [sigmoid(o) for o in odds]


def arrays(text, source, lang, n_chars, shapes):
    got = list(zip(text.to_pylist(), source.to_pylist(), lang.to_pylist(), n_chars.to_pylist()))
    content = np.array([content_view(t, shapes) for t, *_ in got]).reshape(len(got), WIDTHS["content"])
    meta = np.array([meta_view(*row) for row in got]).reshape(len(got), WIDTHS["meta"])
    return content, meta


def featurizer():
    """Column function of INPUTS -> the two views of a row."""

    @F.arrow_udf(FEATURES)
    def features(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shapes = Shapes()
        for batch in batches:
            views = arrays(*batch, shapes)
            yield pa.StructArray.from_arrays([pa.array(list(v), pa.list_(pa.float32())) for v in views], ["content", "meta"])

    return features


INPUTS = ("text", "source", "lang", "n_chars")


def viewed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, key, content, meta): the two views of every row, written; key is a hash of what they show."""
    own = docs.select("doc_id", "source", "lang", F.xxhash64(*INPUTS).alias("key"), featurizer()(*INPUTS).alias("f"))
    return written(own.select("doc_id", "source", "lang", "key", "f.*"), "quality-views")


def matrices(content: pa.Array, meta: pa.Array) -> list[np.ndarray]:
    return [v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), w) for v, w in zip((content, meta), WIDTHS.values())]


def voter(fits):
    """Column function of the views -> the probability of a good document by each."""

    @F.arrow_udf("array<double>")
    def votes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = fits()
        for batch in batches:
            p = np.c_[*(sigmoid(fit.odds(x)) for fit, x in zip(own, matrices(*batch)))]
            yield pa.array(list(p), pa.list_(pa.float64()))

    return votes


def picked(pool: DataFrame, fits: list[Logistic], picks: int, seed: int) -> DataFrame:
    """(view, label, content, meta): confident rows of the pool for the view that learns from them.

    Expected are at most ``picks`` for each view and label, spread evenly over the pairs of source and language. Only numbers
    of the candidates are shuffled; the views of the few picked ones are fetched by key.
    """
    views = range(len(fits))
    told = F.array(*[F.struct(F.lit(1 - k).alias("view"), F.lit(label).alias("label"), (p if label else 1 - p).alias("sure"))
                     for k in views for label, p in ((1, F.col("p")[k]), (0, F.col("p")[k]))])
    sure = written(pool.select("key", "source", "lang", voter(shipped(pool.sparkSession, fits))("content", "meta").alias("p"))
                   .select("key", "source", "lang", F.inline(told)).filter(F.col("sure") >= SURE).drop("sure"), "quality-sure")
    pair = F.xxhash64("source", "lang").alias("pair")
    counts = sure.groupBy("view", "label", pair).agg(F.count("*").alias("n"))
    pairs = counts.groupBy("view", "label").agg(F.count("*").alias("pairs"))
    share = counts.join(pairs, ["view", "label"]).select("view", "label", "pair", (F.lit(picks) / F.col("pairs") / F.col("n")).alias("share"))
    chosen = (sure.select("view", "label", "key", pair).join(share, ["view", "label", "pair"])
              .filter(hashed_share(F.col("key"), seed) < F.col("share")).select("view", "label", "key").distinct())
    return (pool.select("key", "content", "meta").join(chosen, "key").groupBy("view", "label", "key")
            .agg(F.first(F.struct("content", "meta")).alias("v")).select("view", "label", "key", "v.*"))


def fit(views: DataFrame, labels: DataFrame, labelled: int = LABELLED, picks: int = PICKS, seed: int = 29) -> CoTrained | None:
    """Co-train on the written views of all documents; None without rows of both labels.

    To the driver come at most the labelled sample, a row for each id, and the picked rows of each round.
    """
    rated = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("rated_id"))
             .agg(F.max("quality").alias("quality")).filter(fold("rated_id") != HELD_OUT_FOLD))
    chosen = F.broadcast(bounded_sample(rated, F.col("rated_id"), labelled, seed))
    learns = views.filter(fold() != HELD_OUT_FOLD)
    own = F.col("doc_id") == F.col("rated_id")
    rows = (learns.join(chosen, own).groupBy("doc_id", "quality").agg(F.min_by(F.struct("content", "meta"), "key").alias("v"))
            .select("doc_id", "quality", fold().alias("part"), "v.*").toPandas().sort_values("doc_id", kind="stable"))
    known = [np.array(rows[c].tolist(), float).reshape(len(rows), width) for c, width in WIDTHS.items()]
    y, calibrates = rows.quality.to_numpy(float), (rows.part == CALIBRATION_FOLD).to_numpy()
    if len(set(y[~calibrates])) < 2:
        return None
    model, unlabelled = CoTrained(known, y, calibrates), learns.join(chosen, own, "left_anti")
    for turn in range(ROUNDS):
        pool = unlabelled.filter(F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(ROUNDS)) == turn)
        taught = picked(pool, model.fits(), picks, seed + 2).toPandas().sort_values("key", kind="stable")
        for k, (name, width) in enumerate(WIDTHS.items()):
            mine = taught[taught.view == k]
            model.learn(k, np.array(mine[name].tolist(), float).reshape(len(mine), width), mine.label.to_numpy(float))
    return model.finish()


def scorer(model):
    @F.arrow_udf("struct<score:double,content_score:double,meta_score:double>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = model()
        for batch in batches:
            n = len(batch[0])
            joint, parts = (np.full(n, 0.5), [np.full(n, 0.5)] * 2) if own is None or not n else own.score(matrices(*batch))
            yield pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in (joint, *parts)], ["score", "content_score", "meta_score"])

    return score


def score(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """doc_id, held_out, score, predicted and the two calibrated views of every document."""
    views = viewed(docs)
    model = shipped(docs.sparkSession, fit(views, labels, **sizes))
    return views.select("doc_id", held_out().alias("held_out"), scorer(model)("content", "meta").alias("s")).select(
        "doc_id", "held_out", "s.*", (F.col("s.score") >= 0.5).cast("int").alias("predicted"))
