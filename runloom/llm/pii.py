"""Personal data: fixed base patterns, and identifiers found by bootstrapped contexts.

The base spans are the seeds. The one or two words before an identifier are a lexical pattern, the identifier is an instance, and
both make a graph with an edge for each pattern and instance seen together, base spans and identifier-like strings alike. Spark
scores it in rounds. A pattern is as good as the share of its occurrences as words that trusted instances follow; it is promoted
from ``LEAST_CONFIDENCE`` on, with ``LEAST_SEEDS`` different trusted instances, however small its share of all. An instance that is
no seed is as good, for a pattern, as the best promoted pattern that ends in another word. So promoted patterns trust unseen
instances, and these promote further patterns that no seed was ever seen with. Patterns promoted in the last round mark the
identifier-like strings behind them as personal data, of the kind that most of their trusted instances have. Base spans always stay.

Occurrences are counted for those patterns that could still be promoted if every instance seen behind two different words were
trusted; this loses none. Tasks hold these patterns if their counted bytes fit; else all words and contexts are counted and
joined with them, and the same goes for the promoted ones at the end.

NULL and empty texts have no spans. Empty tables and corpora without seeds have no patterns. Repeated rows count as often
as they occur and give a row each; found spans never overlap base spans; of kinds with equal weight the later name counts.
Other columns are ignored.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import shipped, small_side, written

KINDS = ("email", "ip", "card", "phone")
#: An address is this run, an @ and this domain; the run is looked for backwards from each @, so long texts cost linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: No match can begin inside a run of digits, as one from the run's first digit would hold it.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier of unknown form: a run of these with an @ or a digit; the match begins at the first such.
FROM_DIGIT = re.compile(r"[0-9@][\w.%+@/-]*")
IN_RUN = re.compile(r"[\w.%+@/-]")
LEAST_LENGTH, LEAST_DIGITS = 6, 4

#: Different trusted instances, seeds included, that a promoted pattern must have been seen with.
LEAST_SEEDS = 5
LEAST_CONFIDENCE = 0.6
ROUNDS = 4
#: Patterns of up to so many bytes, with ``PATTERN_BYTES`` for each besides its text, are sent to the tasks.
BROADCAST_BYTES = 32_000_000
PATTERN_BYTES = 300


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap: from each @, the domain behind it and the run in front of it."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > free and LOCAL.match(text, start - 1):
            start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    out += [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def word_form(word: str) -> str:
    """A context word: lower case, digits as 0."""
    return re.sub("[0-9]", "0", word.lower())


def contexts(text: str, start: int) -> list[str]:
    """The patterns before a place: the last word, and the last two."""
    forms: list[str] = []
    end = start
    while len(forms) < 2:
        while end and text[end - 1].isspace():
            end -= 1
        if not end:
            break
        at = end
        while at and not text[at - 1].isspace():
            at -= 1
        forms.insert(0, word_form(text[at:end]))
        end = at
    return [" ".join(forms[i:]) for i in range(len(forms) - 1, -1, -1)]


def instance_form(s: str) -> str:
    return s.lower()


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like runs outside the base spans."""
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in FROM_DIGIT.finditer(text):
        a, b = m.span()
        while a and IN_RUN.match(text, a - 1):
            a -= 1
        while b > a and text[b - 1] in ".-/%+":
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a < LEAST_LENGTH or k < len(taken) and taken[k][0] < b:
            continue
        if "@" in text[a:b] or len(digits_of(text[a:b])) >= LEAST_DIGITS:
            yield a, b


def summed(found: Counter, names: list[str]) -> pa.RecordBatch:
    """A batch of the counter's keys, tuples of strings, and their counts."""
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))]
                                      + [pa.array([found[k] for k in keys], pa.int64())], [*names, "n"])


def edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, instance, kind, n) of base spans and, with kind '', of identifier-like runs, summed per batch."""
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0):
            text = text.as_py()
            if not text:
                continue
            base = base_spans(text)
            for kind, a, b in [*base, *(("", a, b) for a, b in candidates(text, base))]:
                for pattern in contexts(text, a):
                    found[pattern, instance_form(text[a:b]), kind] += 1
        yield summed(found, ["pattern", "instance", "kind"])


def word_rows(patterns):
    """Function of batches: (pattern, n), how often each pattern occurs as words.

    ``patterns`` gives the patterns to look for, None stands for all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = patterns() if patterns else None
        ones = {p for p in wanted or () if " " not in p}
        firsts = defaultdict(set)
        for p in wanted or ():
            if " " in p:
                a, b = p.split(" ")
                firsts[b].add(a)
        forms: dict[str, str] = {}
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                last = None
                for word in (text.as_py() or "").split():
                    form = forms.get(word)
                    if form is None:
                        if len(forms) > 200_000:
                            forms.clear()
                        form = forms[word] = word_form(word)
                    if wanted is None or form in ones:
                        found[form,] += 1
                    if last is not None if wanted is None else last in firsts.get(form, ()):
                        found[f"{last} {form}",] += 1
                    last = form
            yield summed(found, ["pattern"])

    return count


def fits(patterns: DataFrame) -> bool:
    """True if a task can hold the patterns."""
    return (patterns.agg(F.sum(F.octet_length("pattern") + PATTERN_BYTES)).first()[0] or 0) <= BROADCAST_BYTES


def promoted(graph: DataFrame, totals: DataFrame, rounds: int) -> DataFrame:
    """(pattern, kind, score) of the patterns that end above the limits.

    ``graph``: pattern, head (its last word), instance, kind ('' if no seed), n; ``totals``: pattern, total. One row a pattern.
    """
    spark = graph.sparkSession
    trusted = graph.filter("kind != ''").withColumn("trust", F.lit(1.0))
    for k in range(rounds):
        per_kind = trusted.groupBy("pattern", "head", "kind").agg(
            F.sum(F.col("n") * F.col("trust")).alias("good"), F.count("*").alias("instances"))
        per_pattern = per_kind.groupBy("pattern", "head").agg(
            F.sum("good").alias("good"), F.sum("instances").alias("instances"), F.max(F.struct("good", "kind"))["kind"].alias("kind"))
        score = F.round(F.col("good") / F.col("total"), 9)
        best = written(per_pattern.filter(F.col("instances") >= LEAST_SEEDS).join(totals, "pattern").withColumn("score", score)
                       .filter(F.col("score") >= LEAST_CONFIDENCE).select("pattern", "kind", "score"), "promoted", spark)
        n_best = best.count()
        if not n_best or k == rounds - 1:
            break
        # Nothing confirms itself: "order" and "the order" are seen at the same places, so neither speaks for the other.
        unseen = graph.filter("kind = ''").drop("kind")
        by_head = unseen.join(small_side(best, n_best), "pattern").groupBy("instance", "head").agg(F.max(F.struct("score", "kind")).alias("s"))
        top = by_head.groupBy("instance").agg(F.max(F.struct("s.score", "head", "s.kind")).alias("top"))
        second = by_head.join(top, "instance").filter(F.col("head") != F.col("top.head")).groupBy("instance").agg(F.max("s").alias("second"))
        other = F.col("top.head") != F.col("head")
        more = unseen.join(top, "instance").join(second, "instance", "left").select(
            "pattern", "head", "instance", F.when(other, F.col("top.kind")).otherwise(F.col("second.kind")).alias("kind"), "n",
            F.when(other, F.col("top.score")).otherwise(F.col("second.score")).alias("trust")).filter("trust IS NOT NULL")
        trusted = graph.filter("kind != ''").withColumn("trust", F.lit(1.0)).unionByName(more)
    return best


def learned(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind) of the trusted patterns: the kind of identifier each announces."""
    spark = docs.sparkSession
    texts = docs.select("text").filter(F.col("text").isNotNull())
    edges = written(texts.mapInArrow(edge_rows, "pattern string, instance string, kind string, n long")
                    .groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "edges", spark)
    head = F.element_at(F.split("pattern", " "), -1)
    # An unseen instance with one word before it everywhere can never be trusted; it only counts as an occurrence.
    several = edges.filter("kind = ''").groupBy("instance").agg(F.min(head).alias("a"), F.max(head).alias("b")).filter("a != b").select("instance")
    alive = edges.filter("kind != ''").unionByName(edges.filter("kind = ''").join(several, "instance", "left_semi"))
    matches = edges.groupBy("pattern").agg(F.sum("n").alias("matches"))
    kept = written(alive.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("alive")).filter(F.col("instances") >= LEAST_SEEDS)
                   .join(matches, "pattern").filter(F.col("alive") >= F.col("matches") * LEAST_CONFIDENCE).select("pattern", "matches"), "patterns", spark)
    if kept.isEmpty():
        return kept.select("pattern", F.lit("").alias("kind"))
    held = fits(kept)
    count = word_rows(shipped(spark, {r["pattern"] for r in kept.select("pattern").collect()}) if held else None)
    words = texts.mapInArrow(count, "pattern string, n long")
    words = (words if held else words.join(kept.select("pattern"), "pattern", "left_semi")).groupBy("pattern").agg(F.sum("n").alias("words"))
    totals = written(kept.join(words, "pattern", "left").select(
        "pattern", F.greatest("matches", F.coalesce("words", F.lit(0))).alias("total")), "totals", spark)
    graph = written(alive.join(small_side(totals.select("pattern"), totals.count()), "pattern", "left_semi").withColumn("head", head), "graph", spark)
    return promoted(graph, totals, rounds).select("pattern", "kind")


def learn(docs: DataFrame, rounds: int = ROUNDS) -> dict[str, str]:
    """The trusted patterns and the kind of identifier each announces, on the driver."""
    return {r["pattern"]: r["kind"] for r in learned(docs, rounds).collect()}


def finder(patterns):
    """Column function text -> struct(base, found): arrays of kind, start, end."""

    span = "array<struct<kind:string,start:int,end:int>>"

    @F.arrow_udf(f"struct<base:{span},found:{span}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trusted = patterns()
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def rows(spans):
            return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        for batch in batches:
            bases, more = [], []
            for text in batch:
                text = text.as_py()
                base = base_spans(text)
                own = []
                if text and trusted:
                    for a, b in candidates(text, base):
                        hits = [trusted[p] for p in contexts(text, a) if p in trusted]
                        if hits:
                            own.append((hits[-1], a, b))
                bases.append(rows(base))
                more.append(rows(own))
            yield pa.StructArray.from_arrays([pa.array(bases, kind_of), pa.array(more, kind_of)], ["base", "found"])

    return find


def all_contexts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The contexts of every identifier-like run outside the base spans."""
    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("pattern", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch:
            text = text.as_py()
            rows.append([{"start": a, "end": b, "words": k, "pattern": p} for a, b in candidates(text, base_spans(text))
                         for k, p in enumerate(contexts(text, a))] if text else [])
        yield pa.array(rows, kind_of)


def joined_spans(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """As ``spans``, for patterns that no task can hold: contexts meet them in a join, once for each different text."""
    key = F.sha2("text", 256)
    every = F.arrow_udf(all_contexts, "array<struct<start:int,end:int,words:int,pattern:string>>")
    own, texts = docs.select("doc_id", "text", key.alias("key")), docs.select(key.alias("key"), every("text").alias("c"))
    hits = texts.select("key", F.inline("c")).distinct().join(trusted, "pattern")
    by_place = hits.groupBy("key", "start", "end").agg(F.max(F.struct("words", "kind"))["kind"].alias("kind"))
    found = by_place.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("f")).select(
        F.col("key").alias("of"), F.transform("f", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("f"))
    base = finder(shipped(docs.sparkSession, {}))
    return own.join(found, F.col("key") == F.col("of"), "left").select("doc_id", base("text").alias("s"), "f").select(
        "doc_id", "s.base", F.coalesce("f", "s.found").alias("found"))


def spans(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """doc_id, base and found spans (arrays of kind, start, end) of every document."""
    if patterns is None:
        trusted = learned(docs)
        if not fits(trusted):
            return joined_spans(docs, trusted)
        patterns = {r["pattern"]: r["kind"] for r in trusted.collect()}
    own = shipped(docs.sparkSession, patterns)
    return docs.select("doc_id", finder(own)("text").alias("s")).select("doc_id", "s.*")
