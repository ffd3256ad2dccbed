"""Near duplicates by fast similarity sketching: shingle sets, sketches, banding, exact checks, components.

Sketch: in round i every shingle is hashed to one of the coordinates and to a value; a coordinate keeps the value of the
earliest round that reached it, the smallest of that round. A set of many shingles fills all coordinates in a few rounds;
after as many rounds as coordinates, round i fills coordinate i itself, so every coordinate is filled for every set. The
share of equal coordinates estimates the similarity with the concentration of as many independent samples.

Links: documents with equal sets are one class (compared by a 128-bit digest of the set); classes that share a band are
candidates. Star rounds check every class against one other class of its buckets and contract what they confirm, so a
group of near copies costs one check a class. Buckets that then still hold more than one component are checked in full, in
blocks: a task gets two blocks of a bucket with their sets, and returns a spanning forest of the links between different
components. No pair of unlinked classes leaves a task, and no bucket is capped.

Similarity is checked on whole sets of 64-bit shingle hashes: 100 * intersection >= PERCENT * union.

Texts without words, empty or NULL, have an empty set and are linked with nothing. A NULL id cannot be linked: its
component is NULL and the row is kept. Repeated rows have equal sets, hence one component. Ties cannot arise: a component
is named by its smallest id. Other columns stay in ``keep_first`` and are ignored by ``classes``.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.components import components
from runloom.llm.text import fresh, q, small_side, written

PERCENT = 80
#: Words of a shingle, unless the caller says otherwise.
WORDS = 4
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^40 < 6e-6.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Classes of a block while a bucket is checked in full.
BLOCK = 256
#: Star rounds go on while they resolve at least this share of the open bucket rows.
PROGRESS = 0.2
#: Shingles sketched at once, and word hashes remembered by a task.
PIECE = 400_000
CACHE_WORDS = 200_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


def shingle_set(text: str | None, known: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle."""
    found = text.encode().translate(LOWER).split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, n)
    width = min(size, n)
    key = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        key = mixed(key) * np.uint64(0x9E3779B97F4A7C15) + h[i:n - width + 1 + i]
    return np.unique(mixed(key))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, a row of COORDINATES values each."""
    t = COORDINATES
    out = np.full((len(sets), t), FULL)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    open_ = np.ones(len(sets), bool)
    for i in range(2 * t):
        r = mixed(h + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        at = ((r >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, owner * t + at, np.uint64(i << 32) | (r & np.uint64(0xFFFFFFFF)))
        now = (out == FULL).any(1)
        if not now.any():
            break
        if (now != open_).any():
            keep = now[owner]
            owner, h, open_ = owner[keep], h[keep], now
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


SKETCH_TYPE = "struct<n:int,digest:binary,bands:array<bigint>>"


def sketched(batches: Iterator[pa.Array], size: int = WORDS) -> Iterator[pa.Array]:
    known = WordHashes()
    for batch in batches:
        sizes, digests, bands, part, weight = [], [], [], [], 0
        for i, text in enumerate(batch):
            own = shingle_set(text.as_py(), known, size)
            sizes.append(len(own))
            digests.append(blake2b(own.tobytes(), digest_size=16).digest())
            if len(own):
                part.append(own)
                weight += len(own)
            if part and (weight >= PIECE or i == len(batch) - 1):
                bands.append(band_keys(sketches(part)))
                part, weight = [], 0
        if part:
            bands.append(band_keys(sketches(part)))
        ends = np.concatenate([[0], np.cumsum([BANDS * (n > 0) for n in sizes])]).astype(np.int32)
        flat = np.concatenate(bands).reshape(-1) if bands else np.zeros(0, np.int64)
        yield pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["n", "digest", "bands"])


def set_lists(batches: Iterator[pa.Array], size: int = WORDS) -> Iterator[pa.Array]:
    known = WordHashes()
    for batch in batches:
        rows = [shingle_set(text.as_py(), known, size).view(np.int64) for text in batch]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def similar(a: Column, b: Column) -> Column:
    """100 * intersection >= PERCENT * union, on arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def block_links(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one pair of blocks of a bucket: a spanning forest of the links between different components."""
    table = pa.Table.from_batches(list(frames))
    nodes, comps = table["node"].to_numpy(), table["component"].to_numpy()
    sets = [np.asarray(s, np.int64) for s in table["hashes"].to_numpy()]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[part], column[part] - low] = 1
        both += x @ x.T
    both = np.rint(both).astype(np.int64)
    linked = (100 * both >= PERCENT * (sizes[:, None] + sizes[None] - both)) & (comps[:, None] != comps[None])
    label = {c: c for c in comps.tolist()}

    def root(c):
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked))):
        x, y = root(int(comps[i])), root(int(comps[j]))
        if x != y:
            label[max(x, y)] = min(x, y)
            out.append((int(nodes[i]), int(nodes[j])))
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The bucket rows (key, node) with the node's current component."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_rows(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the buckets that hold more than one component: key, node, component, the bucket's size, and a node of another
    component (the first by component and id; for the first component's own nodes the last)."""
    own = with_components(buckets.select("key", "node"), labels)
    facts = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"),
                                   F.min(F.struct("component", "node")).alias("first"), F.max(F.struct("component", "node")).alias("last"))
    facts = facts.filter(F.col("low") != F.col("high"))
    return own.join(facts, "key").select(
        "key", "node", "component", "size",
        F.when(F.col("component") != F.col("low"), F.col("first.node")).otherwise(F.col("last.node")).alias("other"))


def of_size(lists, size: int):
    """``sketched`` or ``set_lists`` for shingles of so many words."""

    def sized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lists(batches, size)

    return sized


def linked_classes(reps: DataFrame, docs: DataFrame, size: int = WORDS) -> DataFrame | None:
    """(node, component) of the classes (node, bands) that are linked with others; None if no two share a band."""
    spark = docs.sparkSession
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = written(keys.join(shared, "key"), "buckets", spark)
    candidates = written(buckets.select("node").distinct(), "candidates", spark)
    n_candidates = candidates.count()
    if not n_candidates:
        return None
    texts = docs.select("doc_id", "text").join(
        small_side(candidates, n_candidates), F.col("doc_id") == F.col("node"), "left_semi")
    hashes = F.arrow_udf(of_size(set_lists, size), "array<bigint>")
    # A class is its smallest id with that id's set; an id repeated with different texts has a row for each.
    sets = written(texts.select(F.col("doc_id").alias("node"), hashes("text").alias("hashes")).distinct(), "sets", spark)

    links, labels = None, None
    rows = written(open_rows(buckets, labels), "open", spark)
    n_rows, turn = rows.count(), 0
    while n_rows:
        # First towards the smallest node known, so that groups share a centre; later by a bucket that changes every turn.
        rank = F.lit(0) if turn == 0 else F.xxhash64(F.lit(turn), "key")
        turn += 1
        pairs = rows.groupBy("node").agg(F.min(F.struct(rank.alias("rank"), "other")).alias("best")).select(
            "node", F.col("best.other").alias("other")).select(
            F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        found = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
                 .filter(similar(F.col("left"), F.col("right"))).select("a", "b"))
        links = written(found if links is None else links.unionByName(found), "links", spark)
        labels = components(links)
        rows = written(open_rows(rows, labels), "open", spark)
        before, n_rows = n_rows, rows.count()
        if before - n_rows < PROGRESS * before:
            break
    if n_rows:
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
        spread = (rows.select("key", "node", "component", blocks.alias("blocks"), mine.alias("mine"))
                  .select("key", "node", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
                  .select("key", "node", "component", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j")))
        more = (spread.join(sets, "node").groupBy("key", "i", "j").applyInArrow(block_links, "a long, b long"))
        links = written(links.unionByName(more).distinct(), "links", spark)
        labels = components(links)
    return labels


def classes(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; shingles have ``size`` words."""
    spark = docs.sparkSession
    sketch = F.arrow_udf(of_size(sketched, size), SKETCH_TYPE)
    rows = written(docs.select("doc_id", sketch("text").alias("s")).select("doc_id", "s.*"), "sketches", spark)
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = full.groupBy("digest").agg(F.min("doc_id").alias("node"))
    bands = full.join(reps.select(F.col("node").alias("doc_id"), F.col("digest").alias("own")), "doc_id").filter(
        F.col("digest") == F.col("own")).select(F.col("doc_id").alias("node"), "bands").distinct()
    labels = linked_classes(bands, docs, size)
    named = with_components(reps, labels).select(F.col("digest").alias("of"), "component")
    joined = rows.join(named, (F.col("digest") == F.col("of")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """The documents of each component's smallest id, with all their columns; rows repeated under that id stay together."""
    spark = docs.sparkSession
    (gone,) = fresh(docs, "gone_id")
    dropped = written(classes(docs, size).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct(), "dropped", spark)
    return docs.join(small_side(dropped, dropped.count()), q("doc_id") == q(gone), "left_anti")
