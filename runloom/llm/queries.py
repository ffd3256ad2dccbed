"""One query per operator over the whole tables, and the SQL that gives the same rows where SQL can express them."""

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import (bpe, counts, decontam, dialogues, langid, linedup, neardup, partcodes, pii, quality, rules, toxicity,
                         urlrules)
from runloom.llm.text import BROADCAST_ROWS, small_side, written
from runloom.session import shared_dir

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, from the ids and the text the operator gives back."""
    coded = bpe.round_trip(docs, tokenizer)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), 4)


OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT * FROM r)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT row_no, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT row_no, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT row_no, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
p AS (SELECT row_no, count(DISTINCT spot) AS n_hit FROM (SELECT row_no, unnest(range(i, i + k)) AS spot FROM h) GROUP BY 1),
t AS (SELECT row_no, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (row_no) LEFT JOIN t USING (row_no)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizer versions loaded, documents of low quality deleted, toxic ones revised to their text without digits.

    The deletions are committed twice, as after a lost answer; the totals count them once.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules_of = {counts.BLANK_WORDS: counts.blank_words, counts.PLAIN_WORDS: counts.plain_words}
    low = labels.filter("quality = 0").select("doc_id").distinct()
    toxic = labels.filter("toxic = 1").select("doc_id").distinct().join(low, "doc_id", "left_anti")
    # All counts come from one scan of the texts, so that only numbers meet the labels; digits go in toxic texts alone, where
    # the ids of these are few enough for every task to hold.
    texts, chosen = docs.select("doc_id", "source", "lang", "text"), F.lit(True)
    if (n_toxic := toxic.count()) <= BROADCAST_ROWS:
        texts, chosen = texts.join(small_side(toxic.withColumn("toxic", F.lit(True)), n_toxic), "doc_id", "left"), F.col("toxic")
    clean = F.regexp_replace("text", "[0-9]+", "")
    counted = written(texts.select("doc_id", "source", "lang", *[f(F.col("text")).alias(v) for v, f in rules_of.items()],
                                   *[F.when(chosen, f(clean)).alias(f"clean-{v}") for v, f in rules_of.items()]), "counts", spark)
    redacted = counted.join(toxic, "doc_id", "left_semi")
    rollup = counts.Rollup(spark, shared_dir(spark, "rollup"))
    for version in rules_of:
        tokens = F.col(f"`{version}`")
        rollup.commit(f"load-{version}", counts.signed(counted, 1, version, tokens))
        gone = counts.signed(counted.join(low, "doc_id", "left_semi"), -1, version, tokens)
        rollup.commit(f"takedown-{version}", gone)
        rollup.commit(f"redact-{version}", counts.revised(redacted, version, tokens, F.col(f"`clean-{version}`")))
        rollup.commit(f"takedown-{version}", gone)
    return rollup.totals()


OP9_SQL = r"""
WITH c AS (SELECT doc_id, source, lang, text, regexp_replace(text, '[0-9]+', '', 'g') AS clean FROM documents),
low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), tox AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
k AS (SELECT source, lang, CASE WHEN tox.doc_id IS NULL THEN text ELSE clean END AS text
    FROM c LEFT JOIN low ON c.doc_id = low.doc_id LEFT JOIN tox ON c.doc_id = tox.doc_id WHERE low.doc_id IS NULL),
n AS (SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM k
    UNION ALL SELECT source, lang, 'words-2', coalesce(len(regexp_extract_all(text,
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) FROM k)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM n GROUP BY ALL
"""


def span_text(spans: str) -> Column:
    """kind:start:end of an array of spans, by kind as listed, then start."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s), s["start"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents")).withColumn("every", F.concat("base", "found"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(span_text("base"), 256).alias("base_sha256"),
                        span_text("every").alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = partcodes.compress(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(str(x) for book in books for x in book.ravel())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error",
                        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 4) -> str:
    """Every round as two tables: the nearest entries of all parts, and the entries moved to their parts' means."""
    nearest = """SELECT vec_id, label, row_no, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM
        (SELECT x.vec_id, x.label, x.row_no, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b ON x.p = b.p AND x.i = b.i
            GROUP BY ALL) GROUP BY ALL"""
    steps = "".join(f"""
a{k} AS MATERIALIZED ({nearest.format(k=k)}),
b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, b{k}.i, coalesce(m.v, b{k}.v) AS v FROM b{k} LEFT JOIN
    (SELECT x.p, a.e, x.i, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN a{k} a ON x.row_no = a.row_no AND x.p = a.p GROUP BY ALL) m
    ON b{k}.p = m.p AND b{k}.e = m.e AND b{k}.i = m.i),""" for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS row_no, len(embedding) // 4 AS w,
    list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0),
x AS MATERIALIZED (SELECT vec_id, label, row_no, (n - 1) // w AS p, (n - 1) % w AS i, v[n] AS v
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS n FROM v)),
s AS (SELECT row_no, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id, arg_min(row_no, v) AS row_no FROM v
    WHERE vec_id IS NOT NULL GROUP BY 1) ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, e, i, v FROM x JOIN s USING (row_no)),{steps}
f AS MATERIALIZED ({nearest.format(k=rounds)}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id, label, row_no)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256 FROM c
"""


#: Host, path and action of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, action string"))


OP12_SQL = r"""
WITH r(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')),
u AS (SELECT page_id, row_number() OVER () AS row_no, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
    coalesce(arg_max(action, (length(rule_host || rule_path), length(rule_host))), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, row_no, host, path
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = dialogues.repair(dialogues.damaged(table(spark, sf_dir, "conversations")))
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return repaired.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_personal_data": op10_personal_data,
    "op11_vector_codes": op11_vector_codes,
    "op12_url_filter": op12_url_filter,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op4_near_duplicates": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op9_token_counts": OP9_SQL,
    "op11_vector_codes": _op11_sql(),
    "op12_url_filter": OP12_SQL,
}
