"""Names, identifiers and durations built from the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import names as N
from runloom.functions.ids import attempt_group_id, eval_batch_id, run_id, scope_key
from runloom.functions.resources import (
    availability_band, batch_split, duration_hours, eval_resources, job_state)
from workload.base import c, query, table, text

SCOPES = ["boston", "vegas", "pittsburgh", "singapore"]


def eval_dirs(spark, sf):
    """Orders as evaluation directory names in all the supported forms, and some that are none."""
    orders = table(spark, sf, "orders")
    day, time = F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(c("o_custkey").cast("string"), 6, "0")
    scope = F.when(c("o_orderstatus") == "F", "boston").when(c("o_orderstatus") == "O", "atlantis")
    job = F.when(c("o_orderpriority") < "3", c("o_orderkey").cast("string"))
    name = F.concat_ws("_", text("E", c("o_custkey"), "_eval_navtest"), scope, day, time, job)
    odd = F.when(c("o_orderpriority") == "5-LOW", text("E", c("o_custkey"), "-run"))
    return orders.select("o_orderkey", "o_custkey", F.coalesce(odd, name).alias("dir_name"))


NAMES_SQL = """WITH dirs AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  strftime(o_orderdate, '%Y%m%d') AS d, CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 6
    THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE CAST(o_custkey AS VARCHAR)[1:6] END AS t,
  CASE WHEN o_orderpriority < '3' THEN CAST(o_orderkey AS VARCHAR) END AS job,
  o_orderpriority = '5-LOW' AS odd, 'E' || o_custkey AS e FROM orders)"""


@query(NAMES_SQL + """ SELECT o_orderkey AS key, CASE WHEN odd THEN e || '-run' ELSE e END AS exp_id,
  CASE WHEN NOT odd THEN 'navtest' END AS eval_split,
  CASE WHEN NOT odd AND o_orderstatus = 'F' THEN 'boston' END AS scope,
  CASE WHEN odd THEN NULL WHEN o_orderstatus = 'O' THEN 'atlantis_' || d ELSE d || '_' || t END AS stamp,
  CASE WHEN odd THEN NULL WHEN o_orderstatus = 'O' THEN t ELSE job END AS job_id FROM dirs""")
def parse_eval_dir(spark, sf):
    parsed = eval_dirs(spark, sf).withColumn("p", N.parse_eval_dir(c("dir_name"), SCOPES))
    return parsed.select(c("o_orderkey").alias("key"), "p.exp_id", "p.eval_split", "p.scope",
                         c("p.timestamp").alias("stamp"), c("p.slurm_job_id").alias("job_id"))


@query("""SELECT o_orderkey AS key,
  CASE WHEN o_orderstatus = 'F' THEN 'B' || o_custkey
       WHEN o_orderstatus = 'O' THEN 'B' || o_custkey || '_20241399_120000' ELSE 'B' || o_custkey || '_x' END AS base,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') || ' 01:47:07' END AS stamp FROM orders""")
def base_name_ts(spark, sf):
    tail = (F.when(c("o_orderstatus") == "F", text("_", F.date_format("o_orderdate", "yyyyMMdd"), "_014707"))
            .when(c("o_orderstatus") == "O", "_20241399_120000").otherwise("_x"))
    rows = table(spark, sf, "orders").select("o_orderkey", text("B", c("o_custkey"), tail).alias("name"))
    split = rows.withColumn("s", N.base_and_stamp(c("name")))
    return split.select(c("o_orderkey").alias("key"), "s.base",
                        F.date_format("s.stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("""SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'boston' WHEN 'O' THEN 'las-vegas' ELSE 'all' END AS scope,
  CASE o_orderstatus WHEN 'F' THEN 'boston' WHEN 'O' THEN 'vegas' ELSE 'boston' END AS city FROM orders""")
def scope_label(spark, sf):
    word = F.when(c("o_orderstatus") == "F", "Boston").when(c("o_orderstatus") == "O", "LAS-VEGAS").otherwise("Bostonian")
    rows = table(spark, sf, "orders").select("o_orderkey", text("E", c("o_custkey"), "-eval_", word, "_2024").alias("n"))
    return rows.select(c("o_orderkey").alias("key"), N.scope_label(c("n"), ["boston", "las-vegas"]).alias("scope"),
                       N.substring_label(c("n"), ["boston", "vegas"]).alias("city"))


@query("""SELECT l_orderkey AS key, l_linenumber AS line,
  CAST(CASE l_returnflag WHEN 'A' THEN l_partkey WHEN 'N' THEN l_partkey ELSE -1 END AS BIGINT) AS resolver,
  CAST(CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN l_partkey ELSE l_partkey END AS BIGINT) AS core,
  CAST(CASE l_returnflag WHEN 'A' THEN l_suppkey ELSE -1 END AS BIGINT) AS step,
  CAST(CASE l_returnflag WHEN 'A' THEN l_partkey END AS BIGINT) AS in_path FROM lineitem""")
def epoch_of(spark, sf):
    name = (F.when(c("l_returnflag") == "A", text("epoch=", c("l_partkey"), "-step=", c("l_suppkey"), ".ckpt"))
            .when(c("l_returnflag") == "N", text("Epoch_", c("l_partkey"), ".pth"))
            .otherwise(text("checkpoint_", c("l_partkey"), ".pth")))
    rows = table(spark, sf, "lineitem").withColumn("p", text("runs/x", c("l_orderkey"), "/", name))
    return rows.select(c("l_orderkey").alias("key"), c("l_linenumber").alias("line"),
                       N.number_in_name(c("p"), "resolver").alias("resolver"),
                       N.number_in_name(c("p"), "core", None).alias("core"),
                       N.number_in_name(c("p"), "step").alias("step"), N.epoch_in_path(c("p")).alias("in_path"))


@query("""SELECT doc_id AS key, coalesce(nullif(trim(regexp_replace(lower(strip_accents(source || ' / ' || lang || '.É-' || n_chars)),
  '[^a-z0-9_]+', '_', 'g'), '_'), ''), 'experiment') AS slug FROM documents""")
def slug(spark, sf):
    name = text(c("source"), " / ", c("lang"), ".É-", c("n_chars"))
    return table(spark, sf, "documents").select(c("doc_id").alias("key"), N.slug(name).alias("slug"))


@query("""SELECT l_orderkey AS key, l_linenumber AS line, round(CASE l_returnflag
  WHEN 'A' THEN l_linenumber * 24 + l_suppkey % 24 + 30 / 60.0 + 15 / 3600.0
  WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN l_suppkey + 5 / 60.0 ELSE l_linenumber / 60.0 + 9 / 3600.0 END
  ELSE CASE WHEN l_linestatus = 'F' THEN l_suppkey / 60.0 ELSE 0 END END, 9) AS hours FROM lineitem""")
def duration_of(spark, sf):
    flag, closed = c("l_returnflag"), c("l_linestatus") == "F"
    limit = (F.when(flag == "A", text(c("l_linenumber"), "-", c("l_suppkey") % 24, ":30:15"))
             .when(flag == "N", F.when(closed, text(c("l_suppkey"), ":05:00")).otherwise(text(c("l_linenumber"), ":09")))
             .otherwise(F.when(closed, c("l_suppkey").cast("string")).otherwise("soon")))
    rows = table(spark, sf, "lineitem").select(c("l_orderkey").alias("key"), c("l_linenumber").alias("line"), limit.alias("limit"))
    return rows.select("key", "line", F.round(duration_hours(c("limit")), 9).alias("hours"))


@query("""SELECT event_id AS key, CASE event_type WHEN 'error' THEN '-' WHEN 'view' THEN strftime(ts, '%Y%m%d')
  ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events""")
def ts_format(spark, sf):
    raw = (F.when(c("event_type") == "error", "").when(c("event_type") == "view", F.date_format("ts", "yyyyMMdd"))
           .otherwise(F.date_format("ts", "yyyyMMdd_HHmmss")))
    return table(spark, sf, "events").select(c("event_id").alias("key"), N.display_stamp(raw).alias("shown"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'navtest' END AS eval_split,
  CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'B' || o_custkey END AS exp_id,
  CASE WHEN o_orderstatus = 'P' THEN 'navhard' ELSE 'navtest' END AS seen,
  CASE WHEN o_orderstatus = 'P' THEN 'exp_B' || o_custkey END AS found FROM orders""")
def split_of(spark, sf):
    name = F.when(c("o_orderstatus") == "P", text("run-NAVHARD_exp_B", c("o_custkey"), "z")).otherwise(
        text("eval_navtest_B", c("o_custkey"), "_", F.date_format("o_orderdate", "yyyyMMdd")))
    rows = table(spark, sf, "orders").withColumn("n", name).withColumn("p", N.eval_name_parts(c("n")))
    return rows.select(c("o_orderkey").alias("key"), "p.eval_split", "p.exp_id", N.split_in_name(c("n")).alias("seen"),
                       N.experiment_in_name(c("n")).alias("found"))


@query("""SELECT p_partkey AS key, CASE WHEN length(t) > 50 THEN t[1:47] || '...' ELSE t END AS short
  FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' - ' || p_name || repeat(' x', p_size // 4) AS t FROM part)""")
def short_desc(spark, sf):
    long = text(c("p_name"), " ", c("p_brand"), " ", c("p_type"), " - ", c("p_name"),
                F.repeat(F.lit(" x"), F.floor(c("p_size") / 4).cast("int")))
    return table(spark, sf, "part").select(c("p_partkey").alias("key"), N.short_text(long).alias("short"))


@query("""SELECT s_suppkey AS key, '/scratch/' || s_name || '/n' || s_nationkey || '/${other}' AS path FROM supplier""")
def env_substitute(spark, sf):
    template = F.lit("${scratch_dir}/${name}/n${nation}/${other}")
    path = N.substitute_vars(template, {"scratch_dir": "/scratch", "name": c("s_name"), "nation": c("s_nationkey")})
    return table(spark, sf, "supplier").select(c("s_suppkey").alias("key"), path.alias("path"))


@query("""SELECT event_id AS key, 'U' || user_id || '__' || strftime(ts, '%Y%m%d_%H%M%S') ||
  CASE WHEN event_type = 'view' THEN '' ELSE '__' || event_id END AS run_id FROM events""")
def run_ids(spark, sf):
    job = F.when(c("event_type") == "view", "").otherwise(c("event_id").cast("string"))
    rid = run_id(text("U", c("user_id")), F.date_format("ts", "yyyyMMdd_HHmmss"), job)
    return table(spark, sf, "events").select(c("event_id").alias("key"), rid.alias("run_id"))


@query("""SELECT event_id AS key, 'ag__' || substr(sha256('U' || user_id || '|' || coalesce(nullif(event_type, 'view'), '')
  || '|' || json_extract_string(props, '$.k')), 1, 16) AS attempt_group_id FROM events""")
def attempt_ids(spark, sf):
    keys = [F.nullif("event_type", F.lit("view")), F.get_json_object("props", "$.k")]
    gid = attempt_group_id(text("U", c("user_id")), keys)
    return table(spark, sf, "events").select(c("event_id").alias("key"), gid.alias("attempt_group_id"))


@query("""SELECT o_orderkey AS key, 'batch__' || CASE o_orderstatus
  WHEN 'F' THEN array_to_string(list_sort([CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), '7']), '_')
  WHEN 'O' THEN strftime(o_orderdate, '%Y%m%d') || '_' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS batch FROM orders""")
def batch_ids(spark, sf):
    ids = F.when(c("o_orderstatus") == "F", F.array(c("o_custkey"), c("o_orderkey"), F.lit(7).cast("bigint")))
    stamp = F.when(c("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("key"), eval_batch_id(ids, stamp, c("o_custkey").cast("string")).alias("batch"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus < o_orderpriority THEN o_orderstatus || ',' || o_orderpriority
  ELSE o_orderpriority || ',' || o_orderstatus END AS scopes FROM orders""")
def scope_keys(spark, sf):
    scopes = F.create_map(c("o_orderstatus"), c("o_totalprice"), c("o_orderpriority"), c("o_totalprice"))
    return table(spark, sf, "orders").select(c("o_orderkey").alias("key"), scope_key(scopes).alias("scopes"))


@query("""SELECT event_type AS code, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued'
  WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'unknown' END AS state, CAST(count(*) AS BIGINT) AS n
  FROM events GROUP BY 1, 2""")
def state_map(spark, sf):
    code = (F.when(c("event_type") == "click", "cg").when(c("event_type") == "view", "SUSPENDED")
            .when(c("event_type") == "error", "node_fail").when(c("event_type") == "purchase", "CD").otherwise("ZZ"))
    return table(spark, sf, "events").groupBy(c("event_type").alias("code"), job_state(code).alias("state")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS key, l_linenumber AS line, CAST(CASE WHEN g // l_linenumber <= 48 THEN g // l_linenumber ELSE 48 END AS BIGINT) AS per_gpu,
  CAST(CASE WHEN g // l_linenumber <= 48 THEN 1 ELSE (g + 48 * l_linenumber - 1) // (48 * l_linenumber) END AS BIGINT) AS accumulation
  FROM (SELECT *, CAST(l_quantity * 8 AS BIGINT) AS g FROM lineitem)""")
def batch_shapes(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "b", batch_split((c("l_quantity") * 8).cast("bigint"), c("l_linenumber")))
    return rows.select(c("l_orderkey").alias("key"), c("l_linenumber").alias("line"),
                       c("b.per_gpu_batch").alias("per_gpu"), "b.accumulation")


@query("""SELECT p_partkey AS key, w AS workers, CASE WHEN p_type = 'SMALL' THEN '64G' ELSE least(w * 4 + 32, 200) || 'G' END AS mem,
  CASE WHEN p_type = 'ECONOMY' THEN '08:00:00' ELSE '06:00:00' END AS time
  FROM (SELECT *, CAST(CASE WHEN p_size > 40 THEN 32 ELSE p_size END AS BIGINT) AS w FROM part)""")
def eval_resource_rule(spark, sf):
    workers = F.when(c("p_size") <= 40, c("p_size"))
    rule = eval_resources(workers, F.when(c("p_type") == "SMALL", "64G"), F.when(c("p_type") == "ECONOMY", "08:00:00"))
    return table(spark, sf, "part").withColumn("r", rule).select(c("p_partkey").alias("key"), "r.*")


@query("""SELECT p_partkey AS key, CASE WHEN p_size - 20 >= 4 THEN 'ready' WHEN p_size - 20 > 0 THEN 'limited' ELSE 'none' END AS band FROM part""")
def availability_bands(spark, sf):
    return table(spark, sf, "part").select(c("p_partkey").alias("key"), availability_band(c("p_size") - 20).alias("band"))
