"""Joins of names, jobs and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import names as N
from runloom.functions.merging import layered, layered_maps, override_map
from runloom.operators import consistency as K
from runloom.operators import jobs as J
from runloom.operators import runs as R
from workload.base import c, query, table, text


def experiments(spark, sf):
    """Two ids per customer; one contains the separator."""
    ids = F.explode(F.array(text("C", c("c_custkey")), text("C", c("c_custkey"), "_F")))
    return table(spark, sf, "customer").select(ids.alias("exp_id"))


EXPERIMENTS = "(SELECT 'C' || c_custkey AS exp_id FROM customer UNION ALL SELECT 'C' || c_custkey || '_F' FROM customer)"
DIR = "'eval_C' || o_custkey || '_' || o_orderstatus || CASE WHEN o_orderpriority < '3' THEN '-b' ELSE '_' || o_orderkey END"


@query(f"""SELECT o_orderkey AS key, e.exp_id FROM (SELECT o_orderkey, {DIR} AS name FROM orders) d
  JOIN {EXPERIMENTS} e ON contains('_' || d.name || '_', '_' || e.exp_id || '_')""")
def strict_id_join(spark, sf):
    tail = F.when(c("o_orderpriority") < "3", "-b").otherwise(text("_", c("o_orderkey")))
    dirs = table(spark, sf, "orders").select(
        c("o_orderkey").alias("key"), text("eval_C", c("o_custkey"), "_", c("o_orderstatus"), tail).alias("dir_name"))
    return J.dirs_by_id(dirs, experiments(spark, sf)).select("key", "exp_id")


def queue(spark, sf):
    """Orders as queued jobs named after a customer."""
    sep = F.when(c("o_orderstatus") == "F", "_F.").when(c("o_orderstatus") == "O", "-").otherwise("x")
    state = F.when(c("o_orderpriority") < "2", "RUNNING").when(c("o_orderpriority") < "4", "queued").otherwise("done")
    return table(spark, sf, "orders").select(
        c("o_orderkey").cast("string").alias("job_id"), text("C", c("o_custkey"), sep, "eval").alias("name"), state.alias("state"))


JOB = "'C' || o_custkey || CASE o_orderstatus WHEN 'F' THEN '_F.' WHEN 'O' THEN '-' ELSE 'x' END || 'eval'"
RELATED = f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, exp_id FROM (SELECT o_orderkey, {JOB} AS name FROM orders) q JOIN {EXPERIMENTS} e
  ON q.name = e.exp_id OR (starts_with(q.name, e.exp_id) AND q.name[length(e.exp_id) + 1:length(e.exp_id) + 1] IN ('_', '-', '.'))"""


@query(RELATED)
def job_name_join(spark, sf):
    return J.jobs_by_name(queue(spark, sf), experiments(spark, sf)).select("job_id", "exp_id")


@query(f"""SELECT o_orderkey AS key, {DIR} AS name FROM orders WHERE {DIR} = 'C7' OR {DIR} LIKE 'C7\\_%' ESCAPE '\\'
  OR {DIR} LIKE '%\\_C7' ESCAPE '\\' OR {DIR} LIKE '%\\_C7\\_%' ESCAPE '\\'""")
def strict_id_filter(spark, sf):
    tail = F.when(c("o_orderpriority") < "3", "-b").otherwise(text("_", c("o_orderkey")))
    dirs = table(spark, sf, "orders").select(
        c("o_orderkey").alias("key"), text("eval_C", c("o_custkey"), "_", c("o_orderstatus"), tail).alias("name"))
    return dirs.filter(N.is_name_of(c("name"), F.lit("C7")))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, {JOB} AS name FROM orders WHERE {JOB} = 'C7' OR (starts_with({JOB}, 'C7') AND ({JOB})[3:3] IN ('_', '-', '.'))""")
def job_name_filter(spark, sf):
    return queue(spark, sf).filter(N.is_job_of(c("name"), F.lit("C7"))).select("job_id", "name")


def state_with_jobs(spark, sf):
    """Customers with a training job, an evaluation job and a list of further ones."""
    key = c("c_custkey")
    return table(spark, sf, "customer").select(
        text("C", key).alias("exp_id"), key.alias("train_job_id"), F.when(c("c_acctbal") > 0, key + 7).alias("eval_job_id"),
        F.when(c("c_acctbal") > 5000, F.array((key * 2).cast("string"), (key * 3).cast("string"))).alias("eval_job_ids"),
        F.when(c("c_nationkey") > 2, c("c_mktsegment")).alias("status"))


IDS = """(SELECT 'C' || c_custkey AS exp_id, 'train' AS job_type, CAST(c_custkey AS VARCHAR) AS job_id FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'eval', CAST(c_custkey + 7 AS VARCHAR) FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT 'C' || c_custkey, 'eval', CAST(c_custkey * 2 AS VARCHAR) FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT 'C' || c_custkey, 'eval', CAST(c_custkey * 3 AS VARCHAR) FROM customer WHERE c_acctbal > 5000)"""


def recorded_jobs(spark, sf):
    return J.job_ids(state_with_jobs(spark, sf), many="eval_job_ids")


@query(f"""SELECT exp_id, job_id FROM {IDS} UNION SELECT exp_id, job_id FROM
  ({RELATED}) WHERE exp_id NOT LIKE '%\\_F' ESCAPE '\\'""")
def cancel_set(spark, sf):
    known = state_with_jobs(spark, sf).select("exp_id")
    return J.cancel_set(recorded_jobs(spark, sf), queue(spark, sf), known)


@query(f"""SELECT exp_id, job_type, job_id, CASE WHEN o_orderpriority < '2' THEN 'RUNNING' WHEN o_orderpriority < '4' THEN 'queued' ELSE 'done' END AS state
  FROM {IDS} JOIN orders ON CAST(o_orderkey AS VARCHAR) = job_id""")
def live_jobs(spark, sf):
    return J.live_jobs(recorded_jobs(spark, sf), queue(spark, sf)).select("exp_id", "job_type", "job_id", "state")


@query(f"""SELECT 'C' || c_custkey AS exp_id, coalesce(live, CASE WHEN c_nationkey > 2 THEN c_mktsegment ELSE 'unknown' END) AS status FROM customer
  LEFT JOIN (SELECT exp_id, CASE min(r) WHEN 1 THEN 'running' WHEN 2 THEN 'queued' END AS live FROM
    (SELECT exp_id, CASE WHEN o_orderpriority < '2' THEN 1 WHEN o_orderpriority < '4' THEN 2 END AS r
     FROM {IDS} JOIN orders ON CAST(o_orderkey AS VARCHAR) = job_id) GROUP BY 1) l ON l.exp_id = 'C' || c_custkey""")
def live_overlay(spark, sf):
    state = state_with_jobs(spark, sf).select("exp_id", "status")
    return J.live_overlay(state, recorded_jobs(spark, sf), queue(spark, sf))


@query("""SELECT o_orderkey AS key, 'C' || o_custkey AS exp_id, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderpriority <> '1-URGENT'""")
def parsed_id_join(spark, sf):
    mid = F.when(c("o_orderpriority") == "1-URGENT", "_run_").otherwise("_eval_")
    dirs = table(spark, sf, "orders").select(
        c("o_orderkey").alias("key"), text("C", c("o_custkey"), mid, "navtest_", F.date_format("o_orderdate", "yyyyMMdd"), "_000000").alias("dir_name"))
    known = table(spark, sf, "customer").select(text("C", c("c_custkey")).alias("exp_id"), c("c_mktsegment").alias("segment"))
    return R.parsed_id_join(dirs, known).select("key", "exp_id", "segment")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE coalesce(c_mktsegment, 'embedded') END AS status,
  coalesce(CAST(c_nationkey AS VARCHAR), 'e' || o_custkey) AS nation, o_orderpriority AS priority FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def state_config_merge(spark, sf):
    own = F.create_map(F.lit("priority"), c("o_orderpriority"))
    done = F.create_map(F.lit("priority"), c("o_orderpriority"), F.lit("status"), F.lit("done"))
    state = table(spark, sf, "orders").select(
        "o_orderkey", c("o_custkey").alias("config_id"), F.when(c("o_orderstatus") == "F", done).otherwise(own).alias("state"),
        F.create_map(F.lit("status"), F.lit("embedded"), F.lit("nation"), text("e", c("o_custkey"))).alias("embedded_config"))
    configs = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        c("c_custkey").alias("config_id"), F.create_map(F.lit("status"), c("c_mktsegment"), F.lit("nation"),
                                                        c("c_nationkey").cast("string")).alias("config"))
    # The state's key stays beside the configuration's, as several orders share one configuration.
    keyed = state.withColumn("state", override_map(c("state"), F.create_map(F.lit("key"), c("o_orderkey").cast("string"))))
    merged = K.experiment_records(keyed, configs, "config_id")
    r = c("record")
    return merged.select(r["key"].cast("bigint").alias("key"), r["status"].alias("status"), r["nation"].alias("nation"),
                         r["priority"].alias("priority"))


@query("""SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS brand, p_type AS kind,
  CASE WHEN p_size > 25 THEN p_name END AS note FROM part""")
def override_merge(spark, sf):
    base = F.create_map(F.lit("brand"), c("p_brand"), F.lit("kind"), c("p_type"))
    over = F.when(c("p_size") > 25, F.create_map(F.lit("brand"), F.lit("big"), F.lit("note"), c("p_name")))
    m = table(spark, sf, "part").withColumn("m", override_map(base, over))
    return m.select(c("p_partkey").alias("key"), c("m.brand"), c("m.kind"), F.try_element_at("m", F.lit("note")).alias("note"))


@query("""SELECT c_custkey AS key, coalesce(CASE WHEN c_acctbal > 8000 THEN 'own' END, CASE WHEN c_nationkey < 9 THEN 'template' END, 'default') AS account,
  coalesce(CASE WHEN c_acctbal > 8000 THEN 'own' END, CASE WHEN c_nationkey < 9 THEN 'template' END, 'default') || '/' || c_mktsegment AS both FROM customer""")
def layered_defaults(spark, sf):
    own, template = F.when(c("c_acctbal") > 8000, "own"), F.when(c("c_nationkey") < 9, "template")
    maps = [F.create_map(F.lit("account"), F.lit("default"), F.lit("segment"), c("c_mktsegment"))] + [
        F.when(layer.isNotNull(), F.create_map(F.lit("account"), layer)) for layer in (template, own)]
    rows = table(spark, sf, "customer").withColumn("m", layered_maps(maps))
    return rows.select(c("c_custkey").alias("key"), layered([F.lit("default"), template, own]).alias("account"),
                       text(c("m.account"), "/", c("m.segment")).alias("both"))
