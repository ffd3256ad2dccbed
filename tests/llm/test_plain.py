"""Operators against plain Python on small tables, and their edge cases."""

import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import bpe, components, counts, decontam, linedup, neardup, pii, queries, rules
from runloom.llm.text import fold
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())


def union_find(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(edges, {n for e in edges for n in e})
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)


# --- BPE

ODD = ["", " ", "a<|endoftext|>B <|startoftext|>x", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ß ẞ", "é  x\u0085y z \x1c\x1d q", "don't I'LL x'S 12²½ ٣ Ⅳ",
       "日本語テキスト🙂🙂", "a" * 3000, "_foo__bar-- ++", "ﬁ Å K", "it's'sd 've", "ab\x00cd", "ª º µ"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] if os.path.isdir(SF) else ODD
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert rows == {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert rows[i]["ids"] == want and rows[i]["text"] == library.decode(want, skip_special_tokens=False), text[:40]
    assert rows[-1]["ids"] == [] and rows[-1]["text"] == ""


def test_forced_cuts_change_nothing():
    tables_ = bpe.Tables(public_tokenizers.path(queries.TOKENIZER))
    cut, whole = bpe.Encoder(tables_), bpe.Encoder(tables_, boundaries=False)
    rng = random.Random(1)
    words = ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.randrange(1, 300))) for _ in range(300)] + ["żółć", "\x00\x01é", "qzx"]
    assert any(len(cut.cut(w.encode())) > 1 for w in words)
    assert all(cut[w] == whole[w] for w in words)
    for w in words[:60]:
        ids = [tables_.inner[b] for b in w.encode()]
        assert bpe.merge_short(list(ids), tables_.merges) == bpe.merge_long(list(ids), tables_.merges)


# --- near duplicates and lines


def near_classes(rows, size=4):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()
    ids = sorted(sets)
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union_find(links, ids).items()}


def near_texts(seed, groups=6, members=40):
    """Groups of copies with so many edits that similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(30, 160))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    return [(i, t) for i, t in enumerate(out + ["", None, "one two", "ONE  two", "one two three four", " \n"])]


@pytest.mark.parametrize("block", [neardup.BLOCK, 8])
def test_near_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PROGRESS", 2.0)  # one star round, the blocks do the rest
    rows = near_texts(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_classes(rows)


def test_near_dedup_stage_links_on_five_words(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(42)]
    # One changed word of 42: 35 of 43 shared shingles of four words (0.81), 33 of 43 of five (0.77). At the end: 38 of 40, 37 of 39.
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, " ".join([*words[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 2}
    assert {r["doc_id"] for r in neardup.keep_first(docs, 4).collect()} == {1}


def test_sketches_fill_every_coordinate_and_estimate():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 2, 5, 300, 5000)]
    both = rng.integers(0, 1 << 62, 800).astype(np.uint64)
    a, b = np.concatenate([both, sets[3][:100]]), np.concatenate([both, sets[4][:100]])
    got = neardup.sketches([*sets, a, b])
    assert (got != neardup.FULL).all()
    assert abs((got[-1] == got[-2]).mean() - 0.8) < 0.12
    alone = [neardup.sketches([s])[0] for s in sets]
    assert all((x == y).all() for x, y in zip(alone, got))


@pytest.mark.parametrize("progress", [linedup.PROGRESS, 2.0])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, progress):
    monkeypatch.setattr(linedup, "PROGRESS", progress)
    monkeypatch.setattr(linedup, "BLOCK", 8)
    texts = [t for _, t in near_texts(9, groups=3, members=20) if t]
    rows = [(i, "\n".join(texts[i * 2:i * 2 + 2] + ["Shared  line of all", "", f"own {i}", "x"])) for i in range(30)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linedup.report(docs).collect()}
    want = line_verdict(rows)
    assert {i: r["removed"] for i, r in got.items() if r["n_removed"]} == {i: ",".join(map(str, v)) for i, v in want.items()}
    assert got[0]["n_lines"] == 6 and got[90]["n_lines"] == 0 and got[91]["n_lines"] == 1
    kept = {r["doc_id"]: r["text"] for r in linedup.drop_repeated(docs).collect()}
    for i, text in rows:
        assert kept[i] == (text and "\n".join(line for at, line in enumerate(text.split("\n")) if at not in want.get(i, [])))


def line_verdict(rows):
    """Numbers of the lines that go, by document; every run of characters is a shingle, every pair of lines compared."""
    size = linedup.SHINGLE
    found = [(i, at, line.strip(" \t\r\v\f").lower()) for i, text in rows if text for at, line in enumerate(text.split("\n"))
             if line.strip(" \t\r\v\f")]
    sets = {n: frozenset(n[k:k + size] for k in range(max(1, len(n) - size + 1))) for _, _, n in found}
    norms = sorted(sets)
    label = union_find([(a, b) for k, b in enumerate(norms) for a in norms[:k]
                        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], norms)
    seen, gone = set(), {}
    for i, at, n in sorted(found):
        if label[n] in seen:
            gone.setdefault(i, []).append(at)
        seen.add(label[n])
    return gone


@pytest.mark.parametrize("progress", [linedup.PROGRESS, 2.0])
def test_line_dedup_takes_every_run_of_characters(spark, monkeypatch, progress):
    monkeypatch.setattr(linedup, "PROGRESS", progress)
    monkeypatch.setattr(linedup, "BLOCK", 8)
    rng = random.Random(6)
    unspaced = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)) for _ in range(4)]
    near = [s[:at] + chr(0x3042 + at % 50) + s[at:] for s in unspaced for at in (1, 7, 200, 399)]
    prose = [t for _, t in near_texts(9, groups=3, members=20) if t]
    lines = unspaced + near + prose + ["a\U0001F642" * 30, "b" + "a\U0001F642" * 30, "short", "x"]
    rows = [(i, "\n".join(lines[i * 3:i * 3 + 3])) for i in range(-(-len(lines) // 3))]
    want = line_verdict(rows)
    assert sum(map(len, want.values())) >= len(near)
    got = {r["doc_id"]: r["removed"] for r in linedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert got == {i: ",".join(map(str, v)) for i, v in want.items()}


def test_star_rounds_meet_many_members_of_a_large_component(spark):
    buckets = spark.createDataFrame([(7, i) for i in range(120)], "key long, node long")
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "node long, component long")
    met = [linedup.open_rows(buckets, labels, turn).filter("node >= 100").select("other").distinct().collect() for turn in range(12)]
    assert len({r["other"] for rows in met for r in rows if r["other"] < 100}) >= 5  # component 0 was met at its node 0 alone


def test_blocks_of_the_largest_component_meet_the_others_alone(spark, monkeypatch):
    monkeypatch.setattr(linedup, "BLOCK", 4)
    base = [f"{i} the quick brown fox jumps over the lazy dog and runs away {i % 3}" for i in range(70)]
    texts = spark.createDataFrame(list(enumerate(base)), "node long, norm string")
    rows = spark.createDataFrame([(1, i, 0 if i < 60 else i, 70) for i in range(70)], "key long, node long, component long, size long")
    got = linedup.block_pairs(rows, linedup.bitmaps(texts))
    sets = [frozenset(t[k:k + linedup.SHINGLE] for k in range(len(t) - linedup.SHINGLE + 1)) for t in base]
    near = {(a, b) for a in range(60, 70) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = [(r["a"], r["b"]) for r in got.collect()]
    assert near and near <= set(found) and len(found) == len(set(found)) and all(a >= 60 for a, _ in found)


def test_copies_of_a_line_meet_its_centre_in_all_buckets(spark):
    # 0 is in all four buckets, every other node in two: each meets 0 alone, and a pair in two buckets comes once.
    rows = [(k, 0, 60) for k in range(4)] + [(k, i, 60) for i in range(1, 119) for k in ((0, 1) if i % 2 else (2, 3))]
    got = linedup.centre_pairs(spark.createDataFrame(rows, "key long, node long, n long"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(i, 0) for i in range(1, 119)]


def test_a_pair_comes_out_of_one_of_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(linedup, "BLOCK", 4)
    texts = spark.createDataFrame([(i, f"the quick brown fox jumps over the lazy dog and runs away {i}") for i in range(12)], "node long, norm string")
    rows = spark.createDataFrame([(key, i, i, 12) for key in range(5) for i in range(12)], "key long, node long, component long, size long")
    got = linedup.block_pairs(rows, linedup.fine_bitmaps(texts))
    assert "Aggregate" not in got._jdf.queryExecution().analyzed().toString().split("Generate inline")[0]  # not made five times and thinned
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(a, b) for a in range(12) for b in range(a)]


def test_fine_bitmaps_count_repeated_shingles_once(spark):
    texts = spark.createDataFrame([(1, "en. " * 40), (2, "short")], "node long, norm string")
    assert {r["node"]: r["n"] for r in linedup.fine_bitmaps(texts).collect()} == {1: 4, 2: 1}


def test_line_bands_meet_as_often_as_stated_on_small_sets(spark):
    # Four of five shingles are shared: (1 - 0.8^2)^8 < 3e-4 of such pairs may miss, so about one of 4,000.
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [word(linedup.SHINGLE + 3) for _ in range(4000)]
    pairs = [(2 * i + k, s) for i, t in enumerate(lines) for k, s in enumerate((t, t + word(1)))]
    signed = linedup.signatures(spark.createDataFrame(pairs, "node long, norm string"))
    bands = {r["node"]: set(r["bands"]) for r in signed.collect()}
    assert sum(not bands[2 * i] & bands[2 * i + 1] for i in range(len(lines))) <= 8


# --- decontamination, rules, counts, personal data


def test_decontam_spans_short_items_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 4)
    item = "One two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "Tiny Item"), (None, "nameless item here"), (3, None), (4, "!!"), (2, "tiny item")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"before, {item.upper()}! after", "a"), (2, "a tiny-item and a TINY item", "b"), (3, "two three four", "c"), (4, None, "d"),
        (5, "the nameless item here.", "e"), (1, f"before, {item.upper()}! after", "a"), (None, "x tiny item", "f")], "doc_id long, text string, size string")
    got = sorted((tuple(r) for r in decontam.report(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 13, 11, 1, "1", True)] * 2 + [(2, 7, 4, 1, "2", True), (3, 3, 0, 0, "", False), (4, 0, 0, 0, "", False),
                          (5, 4, 3, 0, "", True), (None, 3, 2, 1, "2", True)], key=repr)
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, bench).collect()}
    assert cut == {1: "before! after", 2: "a and a", 3: "two three four", 4: None, 5: "the.", None: "x"}
    assert sorted(r["doc_id"] for r in decontam.remove_documents(docs, bench).collect()) == [3, 4]
    assert decontam.remove_documents(docs, bench).columns == docs.columns
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted((tuple(r) for r in decontam.report(docs, bench).collect()), key=repr) == got
    assert decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_rule_counts():
    classes = rules.byte_classes()
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "é ", "a b c ", "\n", "#$ ", "\t", " ", "x"]) for _ in range(rng.randrange(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        assert rules.measure(text, classes)[0] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                                                   len(lines) - len(set(lines)), len(hit)]


def test_rules_count_all_rows_and_learn_the_limit_from_all_labels(spark):
    roll = lambda k: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000).alias(f"f{k}")
    stats = spark.range(30_000).select(F.col("id").alias("doc_id"), *[F.lit(60).cast("long").alias(c) for c in rules.COUNTS],
                                       F.array(*[roll(k) for k in range(rules.N_FEATURES)]).alias("features"))
    labels = stats.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(9)) > 0).cast("int").alias("quality"))
    forest, limit = rules.fit(stats, labels)
    got = stats.join(labels, "doc_id").toPandas()
    features, good = np.array(got.features.tolist()), got.quality.to_numpy() == 1
    leaves = forest.leaves(features)
    own = np.bincount(leaves.ravel(), minlength=len(forest.feature)) * (forest.size / len(features))
    is_leaf = forest.child[:, 0] == np.arange(len(forest.child))
    assert own[is_leaf].sum() == pytest.approx(forest.size * len(forest.roots))
    lengths = forest.length.copy()
    nodes = np.unique(leaves)
    forest.settle(nodes, np.bincount(leaves.ravel())[nodes], len(features))
    assert np.allclose(lengths, forest.length)
    scores = forest.score(features)
    assert (scores[good] > limit).sum() <= good.sum() * rules.MAX_FALSE_REJECTS
    lowest = np.sort(scores[good])[::-1][int(good.sum() * rules.MAX_FALSE_REJECTS)]
    bad = scores[~good & (scores > lowest)]
    assert limit == pytest.approx((lowest + bad.min()) / 2 if len(bad) else lowest + 1e-9, abs=1e-12)


@tables
def test_rules_keep_good_and_reject_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = rules.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rated = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rated}
    assert share[1] > 0.99 and share[0] < 0.2


def test_rollup(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", "en", "three"), (3, None, None, None)], "doc_id long, source string, lang string, text string")
    roll = counts.Rollup(spark, str(tmp_path / "r"))
    tokens = counts.blank_words(F.col("text"))
    roll.commit("1", counts.signed(docs, 1, "v", tokens))
    roll.commit("2", counts.signed(docs.filter("doc_id = 2"), -1, "v", tokens))
    roll.commit("3", counts.revised(docs.filter("doc_id = 1"), "v", tokens, F.lit(5)))
    for again in ("2", "3"):
        roll.commit(again, counts.signed(docs.filter("doc_id = 2"), -1, "v", tokens) if again == "2" else counts.revised(docs.filter("doc_id = 1"), "v", tokens, F.lit(5)))
    roll.commit("4", counts.signed(docs.limit(0), 1, "v", tokens))
    want = [(None, None, "v", 1, 0), ("a", "en", "v", 1, 5)]
    assert sorted(map(tuple, roll.totals().collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, roll.compact(str(tmp_path / "c")).totals().collect()), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        roll.commit("a/b", docs)


def test_replay_after_compaction_counts_once(spark, tmp_path):
    """Tokens are those of the BPE operator."""
    path = public_tokenizers.path(queries.TOKENIZER)
    texts = spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", "en", "three")], "doc_id long, source string, lang string, text string")
    docs = texts.drop("text").join(bpe.encode(texts, path).select("doc_id", F.size("ids").alias("n")), "doc_id")
    total = docs.agg(F.sum("n")).first()[0]
    load, gone = counts.signed(docs, 1, "bpe", F.col("n")), counts.signed(docs.filter("doc_id = 2"), -1, "bpe", F.col("n"))
    roll = counts.Rollup(spark, str(tmp_path / "r"))
    roll.commit("1", load)
    once = roll.compact(str(tmp_path / "c"))
    once.commit("1", load)
    assert [tuple(r) for r in once.totals().collect()] == [("a", "en", "bpe", 2, total)]
    for _ in range(2):
        once.commit("2", gone)
    twice = once.compact(str(tmp_path / "d"))
    for again, rows in (("1", load), ("2", gone)):
        twice.commit(again, rows)
    assert [tuple(r)[:4] for r in twice.totals().collect()] == [("a", "en", "bpe", 1)]
    twice.commit("base", load)
    assert [tuple(r)[:4] for r in twice.totals().collect()] == [("a", "en", "bpe", 3)]


def test_base_spans():
    text = "Mail a.b@x.org, b@y and 1.2.3.4 or 1.2.3.456; 4111 1111-1111 1111; 4111111111111112 call +1 (743) 555-3824 or +12 é"
    spans = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", "a.b@x.org"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert pii.base_spans(None) == [] and pii.base_spans("1" * 5000 + ".1.1.1") == []


def test_base_spans_equal_the_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("a1_.@- +9") for _ in range(rng.randrange(0, 40)))
        got = pii.base_spans(text)
        assert [s[1:] for s in got if s[0] == "email"] == [m.span() for m in email.finditer(text)]
        assert [s[1:] for s in got if s[0] == "ip"] == [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for long in ("a" * 300_000 + "@", "1" * 300_000, "+1" + "(" * 300_000, "a-" * 200_000 + " 1"):
        assert pii.base_spans(long) == [] and len(list(pii.candidates(long, []))) <= 1


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(5)
    rows = [(i, f"words the of {i} here. Customer phone: +1 ({200 + i}) 555-{1000 + i} and the rest of it") for i in range(30)]
    rows += [(100, "Customer phone: 0655-123-456 is odd, the 20240101-99 is not"), (101, None), (102, ""), (103, "no data")]
    rows += [(200 + i, f"the {rng.randrange(10)} of the words of") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    found = [rows[30][1][s["start"]:s["end"]] for s in got[100]["found"]]
    assert found == ["0655-123-456"] and got[100]["found"][0]["kind"] == "phone"
    assert all(not got[i]["found"] for i in got if i != 100) and len(got[0]["base"]) == 1
    assert pii.learn(docs.limit(0)) == {}


def test_a_pattern_does_not_confirm_itself(spark):
    # Three of ten words behind "order" are addresses; the numbers behind it are seen nowhere else.
    rng = random.Random(4)
    ip = lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    texts = [f"the order {ip()} came" if i % 10 < 3 else f"the order 77-{100000 + i} came" for i in range(200)]
    texts += [f"from server {ip()} again" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not {"order", "the order"} & set(pii.learn(docs)) and pii.learn(docs)["server"] == "ip"
    assert not any(r["found"] for r in pii.spans(docs).collect())


def plain_patterns(texts, rounds):
    """The promoted patterns and their kinds, by loops over the whole graph."""
    edges, seen, words = {}, {}, {}
    for text in texts:
        base = pii.base_spans(text)
        for kind, a, b in [*base, *(("", a, b) for a, b in pii.candidates(text, base))]:
            for p in pii.contexts(text, a):
                k, n = edges.get((p, text[a:b].lower()), ("", 0))
                edges[p, text[a:b].lower()] = max(k, kind), n + 1
                seen[p] = seen.get(p, 0) + 1
        forms = [pii.word_form(w) for w in text.split()]
        for p in forms + [f"{a} {b}" for a, b in zip(forms, forms[1:])]:
            words[p] = words.get(p, 0) + 1
    best = {}
    for _ in range(rounds):
        good, instances = {}, {}
        for (p, i), (kind, n) in edges.items():
            others = [(s, k) for (q, j), (own, _) in edges.items() if j == i and not own and q in best and q.split()[-1] != p.split()[-1]
                      for k, s in [best[q]]]
            trust, kind = (1.0, kind) if kind else max(others, default=(0, ""))
            if trust:
                good.setdefault(p, {}).setdefault(kind, 0)
                good[p][kind] += n * trust
                instances[p] = instances.get(p, 0) + 1
        best = {p: (max((g, k) for k, g in by.items())[1], round(sum(by.values()) / max(seen[p], words.get(p, 0)), 9))
                for p, by in good.items() if instances[p] >= pii.LEAST_SEEDS}
        best = {p: (k, s) for p, (k, s) in best.items() if s >= pii.LEAST_CONFIDENCE}
    return {p: k for p, (k, _) in best.items()}


@pytest.mark.parametrize("limit", [None, 0])
def test_found_instances_induce_patterns(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    # "node" never stands before an address: it is learned through the hosts that "server" announces too, "box" through "node".
    texts = [f"the server 10.0.{i}.7 runs" for i in range(40)] + [f"a server HOST-{2000 + i} runs" for i in range(8)]
    texts += [f"one node HOST-{2000 + i} fell" for i in range(8)] + [f"one node NODE-{3000 + i} fell" for i in range(2)]
    texts += [f"in box HOST-{2000 + i} was" for i in range(6)] + [f"in box NODE-{3000 + i} was" for i in range(2)]
    texts += [f"room ROOM-{4000 + i} is free" for i in range(9)] + ["that node XY-9999-1 fell", "some box QQ-8888 was", "order HOST-2001"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.learn(docs)
    assert got == plain_patterns(texts, pii.ROUNDS) and got["node"] == got["server"] == "ip" and "room" not in got
    assert "node" not in pii.learn(docs, 1)
    found = {texts[r["doc_id"]][s["start"]:s["end"]] for r in pii.spans(docs).collect() for s in r["found"]}
    assert {"HOST-2001", "XY-9999-1", "QQ-8888"} <= found and not any(f.startswith("ROOM") for f in found)


def test_patterns_equal_the_plain_graph(spark):
    rng = random.Random(11)
    for _ in range(2):
        names = [f"id-{1000 + i}" for i in range(25)] + [f"10.1.{i}.1" for i in range(15)] + [f"u{i}@x.org" for i in range(12)]
        texts = [f"{rng.choice('pq')} {w} {rng.choice(names[k::4] if rng.random() < 0.8 else names)} end" for k, w in enumerate("abcd") for _ in range(60)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert pii.learn(docs) == plain_patterns(texts, pii.ROUNDS)


def test_contexts_take_whole_words():
    assert pii.contexts("a" * 500 + " b:\t1", 504) == ["b:", "a" * 500 + " b:"]
    assert pii.contexts(" x", 1) == [] and pii.contexts("", 0) == []


def test_rollup_without_batches_and_with_empty_ones(spark, tmp_path):
    rollup = counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == rollup.batches().count() == rollup.folded().count() == 0
    none = spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
    rollup.commit("empty", none)
    assert rollup.totals().count() == 0 and [r[0] for r in rollup.batches().collect()] == ["empty"]
    small = rollup.compact(str(tmp_path / "s"))
    small.commit("empty", spark.createDataFrame([("s", "l", "t", 1, 5)], none.schema))
    assert small.totals().count() == 0


def test_toxic_words_of_a_rare_language_are_learned():
    import numpy as np

    from runloom.llm import toxicity

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    big, small = ([word() for _ in range(400)] for _ in range(2))
    big_bad, small_bad = [word() for _ in range(5)], [word() for _ in range(3)]

    def text(words, bad):
        out = [rng.choice(words) for _ in range(rng.randrange(15, 40))]
        for w in rng.sample(bad, 2) if bad else ():
            out.insert(rng.randrange(len(out)), w)
        return " ".join(out)

    rows = [(text(big, big_bad if i % 3 == 0 else None), i % 3 == 0, "big") for i in range(3600)]
    rows += [(text(small, small_bad if i % 3 == 0 else None), i % 3 == 0, "small") for i in range(30)]
    rng.shuffle(rows)
    model = toxicity.learn([toxicity.word_ids(r[0], toxicity.Rows()) for r in rows], np.array([r[1] for r in rows], np.float32),
                           [r[2] for r in rows], np.arange(len(rows)) % 3 == 2)
    tables_, known = model.network.tables(), toxicity.Rows(model.row_of_hash)
    share = lambda words, bad: np.mean([model.score(toxicity.word_ids(text(words, bad), known), tables_) >= toxicity.CUT
                                        for _ in range(100)])
    assert share(small, small_bad) > 0.4 and share(small, None) < 0.05
    assert share(big, big_bad) > 0.95 and share(big, None) < 0.05


@pytest.mark.parametrize("own_rows", [1 << 17, 3000])
def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch, own_rows):
    from runloom.llm import toxicity

    monkeypatch.setattr(toxicity, "OWN_ROWS", own_rows)
    rng = random.Random(4)
    words = [f"plain{i}" for i in range(40)]
    bad = lambda i: i % 4 == 0
    rows = [(i, " ".join([*rng.sample(words, 5), *(["awful"] if bad(i) else []), f"own{i}"]), "en") for i in range(9000)]
    rows += [(9000, None, "en"), (9001, "", None), (None, "awful", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[0] is None or bad(r[0]))) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, piece_words=6000)  # five pieces
    taught = [r["doc_id"] for r in docs.filter(fold().isin(0, 1) & (F.col("doc_id") < 9000)).select("doc_id").collect()]
    rows_of = toxicity.Rows(model.row_of_hash, model.shared)
    held = [rows_of[f"own{i}"] for i in taught]
    assert len(taught) > 4200 and all(held)  # each of these words stands in one document
    assert (sum(r >= model.shared for r in held) > 1000) if own_rows == 3000 else model.shared == 0
    got = toxicity.score(docs, labels, piece_words=6000).filter("doc_id < 9000 and held_out")
    assert got.filter((F.col("predicted") == 1) != (F.col("doc_id") % 4 == 0)).count() < 0.01 * got.count()


def test_toxicity_sums_of_pieces_do_not_depend_on_partitions(spark):
    import numpy as np

    from runloom.llm import toxicity

    rng = random.Random(8)
    rows = [(i % 500, " ".join(rng.choices("abcdefghijklm", k=12)) + (" vile" if i % 5 == 0 else ""), rng.choice(["en", "de", None]))
            for i in range(700)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (toxicity.fit(d, labels, piece_words=900) for d in (docs.repartition(1), docs.repartition(7, "text")))
    assert all(np.array_equal(a, b) for a, b in zip([one.network.embed, *one.network.dense()], [two.network.embed, *two.network.dense()]))
    assert one.thresholds == two.thresholds and one.row_of_hash == two.row_of_hash


def test_toxicity_reads_one_piece_at_a_time(spark, monkeypatch):
    import numpy as np
    from pyarrow import parquet

    from runloom.llm import toxicity

    monkeypatch.setattr(toxicity, "trained", lambda texts, *_: texts)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 20), "id").alias("text"), F.lit("en").alias("lang"))
    texts = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), piece_words=1000)
    words = texts.words()
    texts.place(np.unique(words["word"]).astype(np.int32), 0)

    def groups(df):
        files = [parquet.read_metadata(f.removeprefix("file:")) for f in df.inputFiles()]
        return [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]

    assert set(groups(texts.train)) == {1} and len(groups(texts.train)) == texts.train.count() + texts.judged.count() > 30
    assert max(groups(texts.rows)) <= 512 and sum(groups(texts.rows)) == texts.rows.count() > 1200
    assert words["n"].sum() == sum(int(p["words"]) for p in texts.train.selectExpr("size(ids) words").collect())


@pytest.mark.parametrize("limit", [None, 0])
def test_contexts_of_few_seeds_count_beside_a_hot_kind(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    rows = [(i, " ".join(f"write to a{i}x{k}@example.org" for k in range(100))) for i in range(80)]
    rows += [(1000 + i, f"her Kundennummer: 10.0.0.{i} is this") for i in range(6)]
    odd = "her Kundennummer: 77-1234-5678 is this, and 20240101-99 not"
    rows += [(2000, odd), (2000, odd), (None, odd), (2001, None), (2002, "")]
    got = sorted(((r["doc_id"] or 0, r["found"]) for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
                  if r["found"]), key=str)
    assert [(i, [(s["kind"], odd[s["start"]:s["end"]]) for s in f]) for i, f in got] == [(i, [("ip", "77-1234-5678")]) for i in (0, 2000, 2000)]


# --- all operators on the awkward table


def test_edges(spark, edge_docs, edge_labels, no_docs, no_labels):
    from runloom.llm import langid, quality, toxicity

    n = edge_docs.count()
    bench = spark.createDataFrame([(1, "word1 of1 the line1 word2 of2 the line2 word3 of3 the")], "item_id long, text string")
    for docs, labels, size in ((edge_docs, edge_labels, n), (no_docs, no_labels, 0), (edge_docs, no_labels, n)):
        assert toxicity.score(docs, labels).filter("score >= 0 and score <= 1").count() == size
        assert quality.score(docs, labels).filter("score >= 0 and score <= 1").count() == size
        assert langid.predict(docs).count() == size
        assert neardup.classes(docs).count() == size
        assert linedup.report(docs).count() == size
        assert decontam.report(docs, bench).count() == size
        assert rules.report(docs, labels).count() == size
        assert pii.spans(docs).count() == size
        assert queries.token_digests(docs, public_tokenizers.path(queries.TOKENIZER)).count() == size
        for kept in (rules.keep_good(docs, labels), linedup.drop_repeated(docs), neardup.keep_first(docs), decontam.remove_documents(docs, bench),
                     decontam.remove_spans(docs, bench)):
            assert kept.columns == docs.columns
            kept.collect()
    guess = {r["doc_id"]: r["lang_pred"] for r in langid.predict(edge_docs).collect()}
    assert guess[2] == guess[3] == guess[4] == "und"
    near = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.classes(edge_docs).collect()}
    assert near[2, 0] == (2, True) and {v for k, v in near.items() if k[0] is None} == {(None, True)}
    assert [v for k, v in near.items() if k[0] == 6] == [(1, False)]


@tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows, before = after.collect(), docs.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "near_dedup":
            want = near_classes([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.NEAR_WORDS)
            assert ids == {i for i, (_, c) in want.items() if i == c}
        if name == "line_dedup":
            gone = line_verdict([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: "\n".join(
                line for at, line in enumerate(r["text"].split("\n")) if at not in gone.get(r["doc_id"], [])) for r in before}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


@tables
def test_learned_operators_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.QUERIES["op3_language"](spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.filter("lang = lang_pred").count() / lang.count() > 0.97
    good = queries.QUERIES["op2_quality"](spark, sf).filter("held_out").join(labels, "doc_id")
    assert good.filter("quality = predicted").count() / good.count() > 0.9
    sf = "/root/testdata/sf0.1"  # toxic rows are few in the smaller tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = "trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron"
    tox = queries.QUERIES["op1_toxicity"](spark, sf).filter("held_out").join(docs, "doc_id").withColumn(
        "rude", F.regexp_count(F.lower("text"), F.lit(rf"\b({words})\b")) > 1)
    tox = tox.cache()
    rude = tox.filter("rude")
    assert rude.filter("predicted = 1").count() / rude.count() > 0.85
    clean = tox.filter("not rude")
    assert clean.filter("predicted = 1").count() / clean.count() < 0.05


def test_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select(F.col("id").alias("doc_id"), fold().alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in got)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pseudo_labels_come_from_all_pairs_and_copies_teach_once(spark):
    import numpy as np

    from runloom.llm import quality

    rows = [(i, f"Good words number {i % 50} stand here.", "hot", "en", None) for i in range(400)] + [
        (1000 + i, f"Good words stand {i}.", f"rare{i}", "fr", None) for i in range(6)]
    views = quality.viewed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"))
    sure = quality.Logistic(np.zeros((2, quality.WIDTHS["content"])), np.array([1.0, 1.0]))
    unsure = quality.Logistic(np.zeros((2, quality.WIDTHS["meta"])), np.array([1.0, 0.0]))
    got = quality.picked(views, [sure, unsure], 70, 3).toPandas()
    assert set(zip(got.view, got.label)) == {(1, 1)}  # only the sure view teaches, and only the other one
    assert got.key.is_unique
    rare = {r["key"] for r in views.filter("lang = 'fr'").collect()}
    assert rare <= set(got.key) and len(set(got.key) - rare) <= 50
