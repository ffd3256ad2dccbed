"""Vector codes, URL filters and conversation repair against plain Python, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import dialogues, partcodes, queries, urlrules

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(codes, error) by row and the codebooks, every distance computed by itself."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in good:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    width = len(good[0][1]) // parts
    cut = lambda v, k: tuple(v[k * width:(k + 1) * width])
    books = [[cut(first[i], k) for i in sorted(first)[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, book: min(range(len(book)), key=lambda e: (far(p, book[e]), e))
    for _ in range(rounds):
        for k, book in enumerate(books):
            members = defaultdict(list)
            for _, v in good:
                members[best(cut(v, k), book)].append(cut(v, k))
            for e, own in members.items():
                book[e] = tuple(sum(column) // len(own) for column in zip(*own))
    coded = []
    for i, v in good:
        codes = [best(cut(v, k), book) for k, book in enumerate(books)]
        coded.append((i, codes, sum(far(cut(v, k), books[k][c]) for k, c in enumerate(codes))))
    return coded, books


@pytest.mark.parametrize("spread", [0.002, 1.0])
def test_vector_codes_equal_plain_ones(spark, monkeypatch, spread):
    monkeypatch.setattr(partcodes, "TRIE", 50)
    monkeypatch.setattr(partcodes, "LEAVES", 3)
    dice = random.Random(4)
    value = lambda: float(np.float32(dice.uniform(-spread, spread)))
    rows = [(i, [value() for _ in range(8)], dice.choice([None, 1, 2])) for i in range(150)]
    rows += [rows[3], (rows[5][0], rows[6][1], 1), (None, rows[7][1], None), (900, None, 1), (901, [math.nan] + [0.0] * 7, 1),
             (902, [None] + [0.0] * 7, 1), (903, [math.inf] * 8, 1), (904, [], 1), (905, [0.5] * 7, 1)]
    got, books = partcodes.compress(spark.createDataFrame(rows, VECTORS), entries=20)
    want, plain_books = plain_codes(rows, entries=20)
    assert [b.tolist() for b in books] == [[list(e) for e in b] for b in plain_books]
    own = got.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["vec_id"], r["codes"], r["error"]) for r in own), key=key) == sorted(want, key=key)
    by_label = defaultdict(int)
    for r in own:
        by_label[r["label"]] += r["error"]
    assert all(r["label_error"] == by_label[r["label"]] for r in own)


def test_trie_in_whole_numbers_beyond_floats():
    dice = np.random.default_rng(1)
    rows = np.unique(dice.integers(-partcodes.LIMIT, partcodes.LIMIT, (60, 12)) // 7, axis=0)
    book = rows[::9]
    entry, far = partcodes.nearest(rows, book)
    plain = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (entry == plain.argmin(1)).all() and (far == plain.min(1)).all()


def test_vector_codes_edges(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert partcodes.compress(nothing)[0].count() == 0
    no_ids = spark.createDataFrame([(None, [1.0] * 8, 1)], VECTORS)
    assert partcodes.compress(no_ids)[0].count() == 0
    clash = spark.createDataFrame([(1, [1.0] * 8, 1)], VECTORS).withColumns({n: F.lit(1) for n in ("x", "codes", "error", "label_error", "of")})
    row = partcodes.compress(clash)[0].first()
    assert (row["codes"], row["error"], row["label_error"]) == ([0] * 4, 0, 0)
    with pytest.raises(Exception, match="scaled components"):
        partcodes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS))


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, _, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[len(host):]
    fits = [(len(h + (p or "")), len(h), h + (p or ""), a) for h, p, a in rules if h is not None and a is not None
            and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else urlrules.DEFAULT


URLS = "page_id long, url string"
RULES = "host string, path string, action string"


@pytest.mark.parametrize("per_block", [2, 256])
def test_urls_equal_all_rules(spark, monkeypatch, per_block):
    monkeypatch.setattr(urlrules, "RULES", per_block)
    dice = random.Random(8)
    hosts = [".".join(dice.choice(["a", "b", "net", "x-y", "é"]) for _ in range(dice.randint(1, 4))) for _ in range(25)] + ["a..net", "net."]
    paths = ["/" + "".join(dice.choice("ab/") for _ in range(dice.randint(0, 5))) for _ in range(25)] + [""]
    rules = list({(dice.choice(hosts), dice.choice(paths)): dice.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, a) for (h, p), a in rules] + [(None, "/", "block"), ("b", "/", None)]
    pages = [(i, f"{dice.choice(['http', 'HTTPS'])}://{dice.choice(['', 'www.', 'M.'])}{dice.choice(hosts)}{dice.choice(paths)}"
              f"{dice.choice(['', 'a', '?q=://z/a', '#x/y'])}") for i in range(300)]
    pages += [(1, None), (1, ""), (None, "no scheme/a"), (2, "://"), (2, "http://A.NET"), (2, "x://y://a/b"), (3, "http://a/" + "ab" * 30_000)] + [(4, "http://b.a/ab")] * 50
    got = urlrules.judge(spark.createDataFrame(pages, URLS), spark.createDataFrame(rules, RULES)).collect()
    want = [(i, *plain_verdict(url, rules)) for i, url in pages]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_url_edges(spark):
    rules, page = spark.createDataFrame([("a", None, "allow"), ("a", "", "block")], RULES), spark.createDataFrame([(1, "x://b.a/c")], URLS)
    assert tuple(urlrules.judge(page, rules).first()) == (1, "b.a", "/c", "a", "block")
    assert tuple(urlrules.judge(page, rules.limit(0)).first()) == (1, "b.a", "/c", None, urlrules.DEFAULT)
    assert urlrules.judge(page.limit(0), rules).count() == 0
    clash = page.withColumns({n: F.lit("z") for n in ("host", "path", "key", "group", "kind", "row", "stack", "rule", "verdict", "range")})
    assert tuple(urlrules.judge(clash, rules).first()) == (1, "b.a", "/c", "a", "block")


def plain_audit(rows):
    """Least (cost, audit) from the last row backwards; the rest of an audit is compared as a whole text."""
    rest = {0: (0, ""), 1: None, 2: None, 3: (0, "")}

    def with_inserts(held):
        for _ in range(4):
            for state in range(4):
                for initial, to in dialogues.NEXT[state].items():
                    if initial != "s" and held[to] is not None:
                        found = held[to][0] + 2, "I" + held[to][1]
                        if held[state] is None or found < held[state]:
                            held[state] = found
        return held

    rest = with_inserts(rest)
    for initial, fault in reversed(rows):
        new = {}
        for state in range(4):
            ways = [(rest[state][0] + 3, "D" + rest[state][1])]
            if fault not in (dialogues.BLANK, dialogues.DUPLICATE):
                more = fault == dialogues.TRUNCATED
                for other, to in dialogues.NEXT[state].items():
                    if other == initial:
                        ways.append((rest[to][0] + more, "K" + rest[to][1]))
                    if other != "s":
                        ways.append((rest[to][0] + 2 + more, "R" + rest[to][1]))
                if not initial:
                    ways.append((rest[state][0] + more, "K" + rest[state][1]))
            new[state] = min(ways)
        rest = with_inserts(new)
    return rest[0]


@pytest.mark.parametrize("prime,settle", [((1 << 61) - 1, 512), (3, 512), ((1 << 61) - 1, 3), (2, 5)])
def test_search_equals_whole_text_search(monkeypatch, prime, settle):
    monkeypatch.setattr(dialogues, "PRIME", prime)  # small: most hashes collide
    monkeypatch.setattr(dialogues, "SETTLE", settle)
    dice = random.Random(5)
    for n in [0, 1, 2, 3] * 60 + [10, 40, 200] * 8:
        rows = [(dice.choice("suuaaut") if dice.random() < .97 else "", dice.choice([0, 1, 2, 3, 3, 3, 3])) for _ in range(n)]
        search = dialogues.Search()
        for initial, fault in rows:
            search.row(initial, fault)
        assert search.result() == plain_audit(rows)


def plain_repair(rows):
    """The contract's columns of conversations (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own[conv] += [] if kind == 0 else [(turn, role, text)] * (1 + (kind == 3))
    out = []
    for conv, turns in own.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            faults.append(dialogues.BLANK if not bare else dialogues.DUPLICATE if (role, text) in seen
                          else dialogues.SOUND if bare[-1] in ".!?" else dialogues.TRUNCATED)
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        cost, audit = plain_audit(list(zip(initials, faults)))
        lines, left = [], iter(turns)
        for edit in audit:
            turn = None if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit != "K":
                state = "".join(x[:1] for x in lines)
                role = "user" if state[-1:] in ("", "s", "a") else "assistant"
            lines.append(f"{turn[1]}:{turn[2]}" if edit == "K" else f"{role}:{turn[2] if turn else ''}")
        known = [r[0] for r in turns if r[0] is not None]
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count(0), faults.count(1), faults.count(2),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def digests(df):
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return sorted((tuple(r) for r in df.withColumn("sha", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired").collect()), key=repr)


def test_conversations_equal_plain_ones(spark):
    dice = random.Random(2)
    text = lambda: dice.choice(["Yes.", "No!", "well", "", " \t", "a b? ", "x\u00a0", None, "é…", str(dice.random()) + "."])
    role = lambda: dice.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
    rows = [(c, dice.choice([None, *range(12)]) if dice.random() < .2 else t, role(), text())
            for c in [None, *range(70)] for t in range(dice.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t % 9}{'.' * (t % 5 > 0)}") for t in range(1500)] + rows[:20]
    got = dialogues.repair(dialogues.damaged(spark.createDataFrame(rows, TURNS).repartition(5)))
    assert digests(got) == plain_repair(rows)


def test_conversation_query_and_edges(spark):
    for sf in ("/root/testdata/sf0.01",):
        df = queries.op13_conversation_repair(spark, sf)
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert sorted(map(tuple, df.collect()), key=repr) == plain_repair(rows)
    nothing = spark.createDataFrame([], TURNS)
    assert dialogues.repair(dialogues.damaged(nothing)).count() == 0
    clash = spark.createDataFrame([(1, 1, "user", "A."), (1, 2, "assistant", "B.")], TURNS).withColumns(
        {n: F.lit("z") for n in ("damage", "copy", "present", "same", "of", "first", "repeats")})
    undamaged = dialogues.repair(dialogues.rows_of(clash)).first()
    assert (undamaged["audit"], undamaged["cost"], len(undamaged["repaired"])) == ("KK", 0, 2)
    long_text = spark.createDataFrame([(1, 1, "user", "A" * 2_000_000), (1, 2, "assistant", " " * 2_000_000)], TURNS)
    assert dialogues.repair(dialogues.rows_of(long_text)).first()["audit"] in ("DD", "KID", "KDI")
