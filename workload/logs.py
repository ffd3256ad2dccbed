"""Log texts written from order columns, and the documents as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions.logtext import LogPatterns
from runloom.operators import logs as L
from runloom.session import shared_dir
from runloom.sources import readers as S
from workload.base import c, query, table, text


def eval_logs(spark, sf):
    """One log per order; the wording depends on the status, some logs hold nothing."""
    score = F.lpad(c("o_custkey").cast("string"), 8, "0")
    prio = F.substring("o_orderpriority", 1, 1)
    body = (F.when(c("o_orderstatus") == "F", text(
                "start\nNumber of successful scenarios: ", c("o_orderkey"), ".\nFinal average score of valid results: 0.", score, "\n"))
            .when(c("o_orderstatus") == "O", text("start\nscenarios_evaluated = ", c("o_custkey"), "\nPDMS: 0.", score, "\n"))
            .otherwise("start\n"))
    state = F.when(prio == "1", "Status: SUCCESS\n").when(prio == "2", "Status:  FAILED\nStatus: SUCCESS\n").otherwise("")
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("key"), F.when(prio != "5", F.concat(body, state)).alias("value"))


@query("""SELECT o_orderkey AS key, CASE WHEN p = '5' OR o_orderstatus = 'P' THEN NULL ELSE s END AS score,
  CASE WHEN p = '5' THEN 0 WHEN o_orderstatus = 'F' THEN o_orderkey WHEN o_orderstatus = 'O' THEN o_custkey ELSE 0 END AS scenarios,
  CASE WHEN p = '5' THEN 'UNKNOWN' WHEN p = '2' THEN 'FAILED' WHEN p = '1' THEN 'SUCCESS'
    WHEN o_orderstatus <> 'P' AND s > 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status
  FROM (SELECT *, o_orderpriority[1:1] AS p, CAST('0.' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS DOUBLE) AS s FROM orders)""")
def log_parse(spark, sf):
    return L.parsed(eval_logs(spark, sf))


@query("""SELECT doc_id AS key, CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE) AS score,
  CASE WHEN contains(text, 'the ') THEN 'FAILED' WHEN CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE) > 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status FROM documents""")
def log_parse_custom(spark, sf):
    patterns = LogPatterns(scores=["([0-9]+)"], scenarios=[r"scenes (\d+)"], success="^$", failure="the ")
    logs = table(spark, sf, "documents").select(c("doc_id").alias("key"), c("text").alias("value"))
    return L.parsed(logs, patterns=patterns).select("key", "score", "status")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS epochs,
  CASE WHEN o_orderstatus = 'F' THEN CAST('1.' || o_custkey AS DOUBLE) END AS train_loss,
  CASE WHEN o_orderstatus <> 'P' THEN CAST('2.' || o_orderkey AS DOUBLE) END AS val_loss FROM orders""")
def train_log_parse(spark, sf):
    first = text("Epoch 0: train_loss=9.5, val_loss=9.1\nEpoch ", c("o_custkey"), ": loss: 1.", c("o_custkey"), "\n")
    tail = text("validation=2.", c("o_orderkey"), "\n")
    body = F.when(c("o_orderstatus") == "F", F.concat(first, tail)).when(c("o_orderstatus") == "O", tail).otherwise("nothing\n")
    logs = table(spark, sf, "orders").select(c("o_orderkey").alias("key"), body.alias("value"))
    return L.parsed_training(logs)


PATH = """CASE WHEN o_orderstatus = 'P' THEN 'logs/eval_' || o_custkey || '.out'
  ELSE 'logs/eval_' || o_custkey || '_' || (o_orderkey // 2) || '.out' END"""
NUMBER = "CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey // 2 END"


def log_files(spark, sf):
    end = F.when(c("o_orderstatus") == "P", F.lit(".out")).otherwise(text("_", F.floor(c("o_orderkey") / 2), ".out"))
    return table(spark, sf, "orders").select(
        c("o_custkey").alias("exp_id"), text("logs/eval_", c("o_custkey"), end).alias("path"), c("o_orderdate").alias("mtime"))


@query(f"SELECT o_custkey AS exp_id, arg_max({PATH}, ({NUMBER}, o_orderdate, {PATH})) AS path FROM orders GROUP BY 1")
def latest_log(spark, sf):
    return L.latest_log(log_files(spark, sf))


@query(f"SELECT o_custkey AS exp_id, arg_max({PATH}, (o_orderdate, {PATH})) AS path FROM orders GROUP BY 1")
def newest_log(spark, sf):
    return L.newest_log(log_files(spark, sf))


@query("""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS a FROM documents),
  l AS (SELECT doc_id, len(a) AS n, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM t)
  SELECT doc_id AS key, CAST(i AS BIGINT) AS line_no, line FROM l WHERE i > n - 3""")
def tail_lines(spark, sf):
    logs = table(spark, sf, "documents").select(c("doc_id").alias("key"), c("text").alias("value"))
    return L.tail_lines(logs, 3, key="key")


def large_logs(spark, sf):
    """The documents, one after the other, as a few large log files; their lines are read back."""
    path = shared_dir(spark, "large-logs")
    texts = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(8)).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    ordered = texts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value")
    ordered.write.partitionBy("part").option("lineSep", "\n").text(path)
    lines = S.read_log_lines(spark, path)
    return lines.withColumn("key", S.dir_of(c("path"), "part").cast("bigint"))


LARGE = "(SELECT doc_id % 8 AS key, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1)"


@query(f"""SELECT CAST(key AS BIGINT) AS key, s AS score, coalesce(TRY_CAST(nullif(regexp_extract(t, '([0-9]+) [a-z]', 1), '') AS BIGINT), 0) AS scenarios,
  CASE WHEN contains(t, 'zzzz') THEN 'FAILED' WHEN contains(t, 'the ') THEN 'SUCCESS' WHEN s > 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(t, '([0-9]+)', 1), '') AS DOUBLE) AS s FROM {LARGE})""")
def log_parse_lines(spark, sf):
    patterns = LogPatterns(scores=["([0-9]+)"], scenarios=["([0-9]+) [a-z]"], success="the ", failure="zzzz")
    return L.parsed_lines(large_logs(spark, sf), patterns, key="key")


@query(f"""WITH l AS (SELECT key, len(a) AS n, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT key, string_split(t, chr(10)) AS a FROM {LARGE}))
  SELECT CAST(key AS BIGINT) AS key, CAST(i AS BIGINT) AS line_no, line FROM l WHERE i > n - 20""")
def tail_large_logs(spark, sf):
    return L.tail_of_lines(large_logs(spark, sf), 20, key="key")
