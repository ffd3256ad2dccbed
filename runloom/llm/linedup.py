"""Fuzzy line deduplication by MinHash, in column functions alone.

A line is compared in lower case without blanks at its ends. Its shingles are all runs of ``SHINGLE`` characters (a shorter
line is one shingle), cut from its UTF-32 form in linear time and compared by 64-bit hashes. Equal lines are one class from the start: distinct lines are found by a 64-bit hash,
pre-aggregated per task, so a line that a third of all documents hold is a row per task. Each class has ``BANDS * ROWS``
minima over independent hashes of its shingles; classes that share a band are candidates, and a pair counts as linked only if
100 * intersection >= PERCENT * union of the whole shingle sets. A pair at the limit is missed with probability
(1 - 0.8^2)^8 < 3e-4, one of similarity 0.9 with 2e-6.

Every class is first checked against the centre of each of its buckets, the class that meets the most others. Star rounds then
check it against one drawn class of each and contract what they confirm. Buckets that still hold several components are at last
checked in full, in blocks of ``BLOCK`` x ``BLOCK`` classes, first by sizes and bitmaps of the sets, which rule pairs out without
loss, then by the whole sets. A pair is checked once, however many buckets hold it. A distributed union-find names the components, and of each component the first line by (doc_id, line number) stays.

Blank lines are no lines: they always stay. NULL and empty texts have none. NULL ids come last in the order. Rows repeated
whole share their verdict, so their lines stay or go together. Ties between texts under one id are broken by the text's
hash. Other columns stay in ``drop_repeated`` and are ignored by ``report``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.components import components
from runloom.llm.text import fresh, q, small_side, written

PERCENT = 80
SHINGLE = 12
#: A band is the two halves of one 64-bit hash.
BANDS, ROWS = 8, 2
BLOCK = 256
#: 64-bit words of a set's bitmap; with fewer, sets of some hundred shingles would fill it and rule nothing out.
MAPS = 32
#: Words of the bitmaps of lines that are compared in blocks: the fewer elements share a bit, the fewer pairs are left to the sets.
FINE_MAPS = 64
#: Star rounds go on while they remove at least this share of the components in open buckets.
PROGRESS = 0.03
LAST = (1 << 63) - 1


def lines(docs: DataFrame) -> DataFrame:
    """(doc, text_key, at, norm, node) of every line that is not blank; doc is the id, NULL ids last."""
    norm = F.lower(F.btrim("line", F.lit(" \t\r\v\f")))
    return (docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"),
                        F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .select("doc", "text_key", "at", norm.alias("norm")).filter(F.col("norm") != "")
            .withColumn("node", F.xxhash64("norm")))


def fixed_width(norm: Column) -> Column:
    """The line with four bytes for each character, so that any run of characters is cut in constant time."""
    return F.encode(norm, "UTF-32")


def starts(body: Column) -> Column:
    """Byte numbers, from 1, of the characters that shingles begin at."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(body) - 4 * SHINGLE + 1), F.lit(4))


def shingle_at(body: Column, at: Column) -> Column:
    """The hash of the shingle that begins at a byte."""
    return F.xxhash64(F.substring(body, at, F.lit(4 * SHINGLE)))


def shingle_hashes(norm: Column) -> Column:
    """The hashes of all shingles of a line, repeated ones as often as they occur."""
    # The outer transform binds the encoded line: inside the inner one it would be encoded again for every shingle.
    return F.flatten(F.transform(F.array(fixed_width(norm)), lambda body: F.transform(starts(body), lambda at: shingle_at(body, at))))


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, h): a row for each shingle of a line. They are rows only inside the task that holds the line."""
    body = F.col("body")
    return (texts.select("node", fixed_width(F.col("norm")).alias("body")).select("node", "body", F.explode(starts(body)).alias("at"))
            .select("node", shingle_at(body, F.col("at")).alias("h")))


def signatures(distinct: DataFrame) -> DataFrame:
    """(node, bands): hashed bands of minima."""
    # One hash per shingle, hashed again with a constant for every band; its halves are the band's two coordinates. Flipping
    # bits alone would not do: with complementary top bits, a shingle alone in its half of the range decides every band.
    h = F.col("h")
    hashed = shingle_rows(distinct).select("node", *[F.xxhash64(h.bitwiseXOR(F.lit(hash_constant(b)))).alias(f"h{b}") for b in range(BANDS)])
    minima = hashed.groupBy("node").agg(*[m for b in range(BANDS) for m in (
        F.min(F.shiftright(f"h{b}", 32)).alias(f"high{b}"), F.min(F.col(f"h{b}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low{b}"))])
    return minima.select("node", F.array(*[F.xxhash64(F.lit(b), f"high{b}", f"low{b}") for b in range(BANDS)]).alias("bands"))


def hash_constant(k: int) -> int:
    """The k-th 64-bit constant of a golden-ratio sequence, as a signed number; successive ones are far apart."""
    x = (k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def similar(a: Column, b: Column) -> Column:
    """100 * intersection >= PERCENT * union."""
    return 100 * F.size(F.array_intersect(a, b)).cast("long") >= PERCENT * F.size(F.array_union(a, b))


def bitmaps(texts: DataFrame, words: int = MAPS) -> DataFrame:
    """(node, n, b0, …): the number of each line's shingles, repeated ones too, and the bitmap of their set, one bit for each hash."""
    h = F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    slots = shingle_rows(texts).groupBy("node", F.shiftright(h, 6).bitwiseAND(F.lit(words - 1)).alias("slot")).agg(
        F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    return slots.groupBy("node").agg(F.sum("n").alias("n"), *[
        F.bit_or(F.when(F.col("slot") == k, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(words)])


def fine_bitmaps(texts: DataFrame) -> DataFrame:
    """Bitmaps of ``FINE_MAPS`` words with the size of the set itself as n."""
    sizes = texts.select("node", F.size(F.array_distinct(shingle_hashes(F.col("norm")))).alias("n"))
    return bitmaps(texts, FINE_MAPS).drop("n").join(sizes, "node")


def bits_apart(x: Column, y: Column, words: int = MAPS) -> Column:
    """Bits in which the first words of two bitmaps differ, summed as a balanced tree: array functions walk it for every pair."""
    terms = [F.bit_count(x[f"b{k}"].bitwiseXOR(y[f"b{k}"])) for k in range(words)]
    while len(terms) > 1:
        terms = [sum(terms[k + 1:k + 2], terms[k]) for k in range(0, len(terms), 2)]
    return terms[0]


def may_be_similar(x: Column, y: Column, words: int = MAPS) -> Column:
    """False only for sets that cannot reach the limit: every bit in which their bitmaps differ is an element of one only.

    The sets have at most ``n`` elements each.
    """
    return (100 + PERCENT) * bits_apart(x, y, words) <= (100 - PERCENT) * (x["n"] + y["n"])


def with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def open_rows(buckets: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Rows of buckets with more than one component: key, node, component, size, and a node of another component.

    The node compared with is drawn from all nodes of the bucket anew in every turn, so a large component is met at a member that
    changes, and by most of the rest. The members of the drawn node's component meet another component, drawn as well.
    """
    own = with_components(buckets.select("key", "node"), labels)
    member = F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("by"), "node", "component")
    # A component is named by one of its nodes, so the drawn components are nodes to compare with.
    drawn = F.struct(F.xxhash64(F.lit(turn), "key", "component").alias("by"), "component")
    ends = own.groupBy("key").agg(F.min(member).alias("met"), F.min(drawn)["component"].alias("low"), F.max(drawn)["component"].alias("high"),
                                  F.count("*").alias("size"))
    return own.join(ends.filter(F.col("low") != F.col("high")), "key").select(
        "key", "node", "component", "size", F.when(F.col("component") != F.col("met.component"), F.col("met.node"))
        .when(F.col("component") != F.col("low"), F.col("low")).otherwise(F.col("high")).alias("other"))


def open_components(rows: DataFrame) -> int:
    """Components in open buckets, counted once a bucket."""
    return rows.select("key", "component").distinct().count()


def centre_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of every node with the one of its bucket whose own buckets hold the most rows.

    In a group of near copies that is a line near all others, and mostly the same one in all of the group's buckets.
    """
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = buckets.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    return (buckets.join(centres, "key").filter(F.col("node") != F.col("centre"))
            .select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())


def not_ruled_out(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""
    return (pairs.join(maps.select(F.struct("*").alias("x")), F.col("a") == F.col("x.node"))
            .join(maps.select(F.struct("*").alias("y")), F.col("b") == F.col("y.node"))
            .filter(may_be_similar(F.col("x"), F.col("y"))).select("a", "b"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends (a, b) lie in different components (at_a, at_b); other columns stay."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"at_{end}"))
    return (pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
            .withColumns({"at_a": F.coalesce("at_a", "a"), "at_b": F.coalesce("at_b", "b")}).filter("at_a != at_b"))


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after the links ``found``: only the components that these join are named anew."""
    joined = components(apart(found, labels).select(F.col("at_a").alias("a"), F.col("at_b").alias("b")).distinct())
    named = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("name")), "component", "left").select(
        "node", F.coalesce("name", "component").alias("component"))
    return written(named.unionByName(joined.join(labels, "node", "left_anti")), "line-labels", labels.sparkSession)


def linked_lines(own: DataFrame) -> DataFrame | None:
    """(node, component) of the classes of ``lines`` that are linked with others; None if no band is shared."""
    spark = own.sparkSession
    distinct = own.groupBy("node").agg(F.max("norm").alias("norm"))
    signed = written(signatures(distinct), "line-bands", spark)
    keys = signed.select("node", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "line-keys", spark)
    n_shared = shared.count()
    if not n_shared:
        return None
    buckets = written(keys.join(small_side(shared, n_shared), "key"), "line-buckets", spark)
    candidates = written(buckets.select("node").distinct(), "line-candidates", spark)
    wanted = small_side(candidates, candidates.count())
    texts = written(own.select("node", "norm").join(wanted, "node", "left_semi").groupBy("node").agg(
        F.max("norm").alias("norm")), "line-texts", spark)

    # A line's bitmap is built once, however many buckets hold the line.
    maps = written(bitmaps(texts), "line-maps", spark)
    labels = components(written(confirmed(not_ruled_out(centre_pairs(buckets), maps), texts), "line-links", spark))
    # The only pair of a bucket of two has been checked.
    rows = written(open_rows(buckets.filter("n > 2"), labels, 0), "line-open", spark)
    n_open, turn = open_components(rows), 0
    while n_open:
        turn += 1
        pairs = rows.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        labels = merged(labels, written(confirmed(not_ruled_out(pairs, maps), texts), "line-links", spark))
        rows = written(open_rows(rows, labels, turn), "line-open", spark)
        before, n_open = n_open, open_components(rows)
        if before - n_open < PROGRESS * before:
            break
    if n_open:
        still_open = rows.select("node").distinct()
        fine = written(fine_bitmaps(texts.join(still_open, "node", "left_semi")), "line-fine-maps", spark)
        pairs = written(block_pairs(rows, fine), "line-pairs", spark)
        # One pair for each two components first, the one of the closest bitmaps: most pairs then lie within one component.
        first = pairs.groupBy("of_a", "of_b").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b")
        labels = merged(labels, written(confirmed(first, texts), "line-links", spark))
        rest = apart(pairs.select("a", "b"), labels).select("a", "b").join(first, ["a", "b"], "left_anti")
        labels = merged(labels, written(confirmed(rest, texts), "line-links", spark))
    return labels


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of lines (a, b) whose whole sets are similar."""
    return (pairs.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("left")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("norm").alias("right")), "b")
            .select("a", "b", shingle_hashes(F.col("left")).alias("left"), shingle_hashes(F.col("right")).alias("right"))
            .filter(similar(F.col("left"), F.col("right"))).select("a", "b"))


def block_pairs(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in the open buckets that their bitmaps do not rule out, with these (of_a, of_b).

    A bucket's classes are dealt to blocks; a row holds the numbers and bitmaps of two blocks' lines and compares these inside
    array functions. The arrays have at most about ``BLOCK`` members each, whatever the bucket's size. A pair comes out once,
    in the smallest key that both have: near copies share most of their buckets, and all that hold both are open.
    The bucket's largest component has blocks of its own, which meet the others' blocks alone.
    """
    words = len(maps.columns) - 2
    shares = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    in_main, n_rest, n_main = F.col("component") == F.col("main.component"), blocks(F.col("size") - F.col("main.n")), blocks(F.col("main.n"))
    place = F.xxhash64("node", "key")
    dealt = rows.join(largest, "key").select(
        "key", "node", "component", F.when(in_main, n_rest).otherwise(n_rest + n_main).alias("blocks"),
        F.when(in_main, n_rest + F.pmod(place, n_main)).otherwise(F.pmod(place, n_rest)).cast("int").alias("mine"))
    keys = rows.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most BANDS of them
    spread = (dealt.join(maps.join(keys, "node"), "node")
              .select("key", F.struct("node", "component", "mine", "n", "keys", *[f"b{k}" for k in range(words)]).alias("member"),
                      "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
              .select("key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "member"))
    groups = spread.groupBy("key", "i", "j").agg(F.collect_list("member").alias("members"))

    def of(side: str) -> Column:
        return F.filter("members", lambda m: m["mine"] == F.col(side)).alias(f"of_{side}")

    def possible(x: Column, y: Column) -> Column:
        # The cheap tests come first: sizes, a quarter of the bitmap, all of it.
        sizes = (100 * x["n"] >= PERCENT * y["n"]) & (100 * y["n"] >= PERCENT * x["n"])
        once = F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")
        return ((x["component"] != y["component"]) & (~F.col("same") | (x["node"] < y["node"])) & sizes
                & may_be_similar(x, y, words // 4) & may_be_similar(x, y, words) & once)

    def pair(x: Column, y: Column) -> Column:
        higher, by_component = x["node"] > y["node"], [x["component"], y["component"]]
        return F.struct(F.when(higher, x["node"]).otherwise(y["node"]).alias("a"), F.when(higher, y["node"]).otherwise(x["node"]).alias("b"),
                        F.greatest(*by_component).alias("of_a"), F.least(*by_component).alias("of_b"), bits_apart(x, y, words).alias("apart"))

    sides = groups.select("key", (F.col("i") == F.col("j")).alias("same"), of("i"), of("j"))
    pairs = F.flatten(F.transform("of_i", lambda x: F.transform(F.filter("of_j", lambda y: possible(x, y)), lambda y: pair(x, y))))
    return sides.select(F.inline(pairs))


def removed(docs: DataFrame) -> DataFrame:
    """(doc, text_key, at) of every line that goes: all of a component but its first by (doc, text_key, at)."""
    whole = written(lines(docs), "lines", docs.sparkSession)  # texts are cut and hashed once
    own = whole.select("doc", "text_key", "at", "node")
    labels = linked_lines(whole)
    own = own.withColumn("component", F.col("node")) if labels is None else with_components(own, labels)
    # Most lines are alone: the smallest id and the count need numbers only, and what follows sees repeated lines alone.
    first = own.groupBy("component").agg(F.min("doc").alias("keep_doc"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = written(own.join(first, "component"), "line-repeats", docs.sparkSession)
    at_first = F.col("doc") == F.col("keep_doc")
    kept = again.filter(at_first).groupBy("component").agg(F.min(F.struct("text_key", "at")).alias("keep"))
    within = again.filter(at_first).join(kept, "component").filter(F.struct("text_key", "at") != F.col("keep"))
    return again.filter(~at_first).select("doc", "text_key", "at").unionByName(within.select("doc", "text_key", "at"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc, text_key, gone): the ascending numbers (from 0) of each text's lines that go."""
    return removed(docs).groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    doc, key, gone = fresh(docs, "line_doc", "line_key", "line_gone")
    found = positions(docs).toDF(doc, key, gone)
    return docs.join(found, (F.coalesce(q("doc_id"), F.lit(LAST)) == q(doc)) & (F.xxhash64("text") == q(key)), "left").drop(doc, key), gone


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (blank ones too), n_removed, removed (numbers from 0, comma-joined) of every document."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("own_key"),
                         F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    found = positions(docs)
    return narrow.join(found, (F.coalesce("doc_id", F.lit(LAST)) == F.col("doc")) & (F.col("own_key") == F.col("text_key")), "left").select(
        "doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


def drop_repeated(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; their texts without the lines that go. A text that loses all lines is empty."""
    marked, gone = _marked(docs)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(q(gone), i)), "\n")
    return marked.withColumn("text", F.when(q(gone).isNull(), F.col("text")).otherwise(kept)).drop(gone)
