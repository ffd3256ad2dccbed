"""Drift between state and configuration: orders against line items and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import consistency as K
from workload.base import c, query, table, text


def state(spark, sf):
    """Orders as registered experiments with script paths and, for some, an embedded copy."""
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("exp_id"), c("o_orderstatus").alias("status"),
        F.when(c("o_orderstatus") != "P", text("scripts/", c("o_custkey"), "_x", c("o_orderkey"), ".sh")).alias("train_script_path"),
        text("scripts/", c("o_custkey"), ".sh").alias("eval_script_path"), (c("o_orderpriority") == "1-URGENT").alias("has_config_copy"))


def configs(spark, sf):
    """Line items' orders and each part as configurations."""
    lines = table(spark, sf, "lineitem").select(c("l_orderkey").alias("exp_id"))
    return lines.union(table(spark, sf, "part").select((-c("p_partkey") - 1).alias("exp_id"))).distinct()


def paths(spark, sf):
    """Existing script files: those of orders not urgent, and of customers in credit."""
    own = table(spark, sf, "orders").filter(c("o_orderpriority") != "2-HIGH").select(
        text("scripts/", c("o_custkey"), "_x", c("o_orderkey"), ".sh").alias("path"))
    shared = table(spark, sf, "customer").filter("c_acctbal > 0").select(text("scripts/", c("c_custkey"), ".sh").alias("path"))
    return own.union(shared)


CONFIGS = "(SELECT DISTINCT l_orderkey AS exp_id FROM lineitem UNION SELECT -p_partkey - 1 FROM part)"
FLAGS = f"""SELECT coalesce(s.exp_id, g.exp_id) AS exp_id, s.exp_id IS NOT NULL AND g.exp_id IS NULL AS missing_config,
  s.exp_id IS NULL AS orphan_config, coalesce(copy, FALSE) AS stale_copy, coalesce(broken, FALSE) AS broken_path FROM
  (SELECT o_orderkey AS exp_id, o_orderpriority = '1-URGENT' AS copy,
    (o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH') OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS broken FROM orders) s
  FULL JOIN {CONFIGS} g ON s.exp_id = g.exp_id"""


def flags(spark, sf):
    return K.consistency_flags(state(spark, sf), configs(spark, sf), paths(spark, sf))


@query(FLAGS)
def consistency_flags(spark, sf):
    return flags(spark, sf)


@query(" UNION ALL ".join(f"SELECT exp_id, '{i}' AS issue FROM ({FLAGS}) WHERE {i}" for i in K.ISSUES))
def consistency_issues(spark, sf):
    return K.consistency_issues(flags(spark, sf))


@query("SELECT " + ", ".join(f"CAST(count(*) FILTER ({i}) AS BIGINT) AS {i}" for i in K.ISSUES)
       + f", count(*) FILTER ({' OR '.join(K.ISSUES)}) = 0 AS ok FROM ({FLAGS})")
def consistency_report(spark, sf):
    return K.consistency_report(flags(spark, sf))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark, sf):
    left = table(spark, sf, "orders").select(c("o_orderkey").alias("key"))
    return K.orphans(left, table(spark, sf, "lineitem").select(c("l_orderkey").alias("key")), "key")


@query("SELECT DISTINCT l_suppkey AS key FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def missing(spark, sf):
    lines = table(spark, sf, "lineitem").select(c("l_suppkey").alias("key"))
    return K.orphans(lines, table(spark, sf, "supplier").filter("s_acctbal > 5000").select(c("s_suppkey").alias("key")), "key")


def candidates(spark, sf):
    return table(spark, sf, "events").select(c("event_id").alias("exp_id"))


@query(f"""SELECT event_id AS exp_id, CASE WHEN event_id NOT IN (SELECT exp_id FROM {CONFIGS}) THEN 'yaml_missing'
  WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'already_present' ELSE 'registered' END AS outcome FROM events""")
def register(spark, sf):
    known = state(spark, sf).filter(c("status") == "F")
    return K.register(candidates(spark, sf), configs(spark, sf), known)


@query(f"""SELECT event_id AS exp_id, 'created' AS status, CAST(NULL AS VARCHAR) AS run_id FROM events
  WHERE event_id IN (SELECT exp_id FROM {CONFIGS})""")
def register_forced(spark, sf):
    outcomes = K.register(candidates(spark, sf), configs(spark, sf), state(spark, sf), force=True)
    return K.created_rows(outcomes).select("exp_id", "status", "run_id")


@query("""SELECT event_id AS exp_id, CASE WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'planned' ELSE 'skipped' END AS outcome FROM events""")
def reevaluation_plan(spark, sf):
    return K.reevaluation_plan(candidates(spark, sf), state(spark, sf).filter(c("status") != "P"))


def renames(spark, sf):
    """Customers in credit get a new id; the target of some is taken."""
    return table(spark, sf, "customer").filter("c_acctbal > 0").select(
        text("C", c("c_custkey")).alias("old_id"),
        F.when(c("c_nationkey") == 3, text("C", c("c_custkey") + 1)).otherwise(text("N", c("c_custkey"))).alias("new_id"))


def named_state(spark, sf):
    name = text("C", c("c_custkey"))
    return table(spark, sf, "customer").select(
        name.alias("exp_id"), text("runs/", name, "_train.sh").alias("train_script_path"),
        F.when(c("c_nationkey") > 9, text("runs/", name, ".sh")).alias("eval_script_path"))


@query("""SELECT 'C' || c_custkey AS exp_id, CASE WHEN c_acctbal > 0 THEN 'runs/N' || c_custkey ELSE 'runs/C' || c_custkey END || '_train.sh' AS train,
  CASE WHEN c_nationkey > 9 THEN CASE WHEN c_acctbal > 0 THEN 'runs/N' || c_custkey ELSE 'runs/C' || c_custkey END || '.sh' END AS eval,
  CASE WHEN c_acctbal > 0 THEN 'N' ELSE 'C' END || c_custkey AS new_id FROM customer""")
def rename(spark, sf):
    plain = renames(spark, sf).withColumn("new_id", F.concat(F.lit("N"), F.substring(c("old_id"), F.lit(2), F.length("old_id"))))
    done = K.bulk_rename(named_state(spark, sf), plain)
    return done.select(F.concat(F.lit("C"), F.substring(c("exp_id"), F.lit(2), F.length("exp_id"))).alias("exp_id"),
                       c("train_script_path").alias("train"), c("eval_script_path").alias("eval"), c("exp_id").alias("new_id"))


@query("""WITH r AS (SELECT 'C' || c_custkey AS o, CASE WHEN c_nationkey = 3 THEN 'C' || (c_custkey + 1) ELSE 'N' || c_custkey END AS n FROM customer WHERE c_acctbal > 0)
  SELECT n AS id, 'already exists as target' AS error FROM r WHERE n IN (SELECT 'C' || c_custkey FROM customer) AND n NOT IN (SELECT o FROM r)
  UNION ALL SELECT n, 'used twice as target' FROM r GROUP BY n HAVING count(*) > 1
  UNION ALL SELECT o, 'not found' FROM r WHERE o NOT IN (SELECT 'C' || c_custkey FROM customer)""")
def rename_check(spark, sf):
    return K.rename_errors(renames(spark, sf), named_state(spark, sf))


@query("""SELECT 'N' || c_custkey AS exp_id, 'runs/C' || c_custkey || '0/N' || c_custkey || '_train.sh C' || c_custkey || '-b' AS train FROM customer WHERE c_acctbal > 0""")
def rename_delimited(spark, sf):
    """An id inside a longer id, or before a dash, is another experiment's and stays."""
    name = text("C", c("c_custkey"))
    state = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        name.alias("exp_id"), text("runs/", name, "0/", name, "_train.sh ", name, "-b").alias("train"))
    plain = renames(spark, sf).withColumn("new_id", F.concat(F.lit("N"), F.substring(c("old_id"), F.lit(2), F.length("old_id"))))
    return K.apply_renames(state, plain, text_fields=["train"])


@query("""SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'run_N' || o_custkey || '_x' WHEN 'O' THEN 'N' || o_custkey || '-v2' END AS new_name
  FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderstatus <> 'P'""")
def rename_dirs(spark, sf):
    ident = text("C", c("o_custkey"))
    name = F.when(c("o_orderstatus") == "F", text("run_", ident, "_x")).when(c("o_orderstatus") == "O", text(ident, "-v2")).otherwise(text(ident, ".v2"))
    dirs = table(spark, sf, "orders").select(c("o_orderkey").alias("key"), name.alias("dir_name"))
    plain = renames(spark, sf).withColumn("new_id", F.concat(F.lit("N"), F.substring(c("old_id"), F.lit(2), F.length("old_id"))))
    return K.rename_dirs(dirs, plain).select("key", "new_name")


@query(f"""SELECT o_orderkey AS exp_id, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '2-HIGH'
    THEN 'scripts/' || o_custkey || '_x' || o_orderkey || '.sh' END AS train_script_path,
  CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'scripts/' || o_custkey || '.sh' END AS eval_script_path FROM orders
  UNION ALL SELECT exp_id, 'unknown', NULL, NULL FROM ({FLAGS}) WHERE orphan_config""")
def repair(spark, sf):
    fixed = K.repaired_state(state(spark, sf), flags(spark, sf), paths(spark, sf))
    return fixed.select("exp_id", "status", "train_script_path", "eval_script_path")


@query(f"""SELECT outcome, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (w) AS BIGINT) AS written FROM
  (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'migrated' ELSE 'skipped' END AS outcome,
    o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT exp_id FROM {CONFIGS}) AS w FROM orders) GROUP BY 1""")
def migration(spark, sf):
    plan = K.migration_plan(state(spark, sf), configs(spark, sf))
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("config_written").alias("written"))


REQUIRED = {"checkpoint": "no checkpoint found", "yaml": "YAML config missing", "results": "results empty"}
MISSING = """SELECT event_id AS exp_id, '' AS artifact, 'not registered in metadata' AS reason FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL SELECT event_id, a, r FROM events JOIN orders ON o_orderkey = event_id AND o_orderstatus <> 'P'
  CROSS JOIN (VALUES ('checkpoint', 'no checkpoint found', 1), ('yaml', 'YAML config missing', 2), ('results', 'results empty', 3)) v(a, r, i)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_linenumber = i)"""


def artifacts(spark, sf):
    """Line numbers 1 to 3 of an order stand for its checkpoint, configuration and results."""
    kind = F.when(c("l_linenumber") == 1, "checkpoint").when(c("l_linenumber") == 2, "yaml").when(c("l_linenumber") == 3, "results")
    present = table(spark, sf, "lineitem").select(c("l_orderkey").alias("exp_id"), kind.alias("artifact")).filter("artifact IS NOT NULL")
    registered = state(spark, sf).filter(c("status") != "P")
    return K.missing_artifacts(candidates(spark, sf), registered, present, REQUIRED)


@query(MISSING)
def artifact_check(spark, sf):
    return artifacts(spark, sf)


@query(f"""SELECT CAST(count(*) FILTER (m IS NULL) AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS total, CAST(coalesce(sum(m), 0) AS BIGINT) AS missing,
  count(m) = 0 AS ready FROM events LEFT JOIN (SELECT exp_id, count(*) AS m FROM ({MISSING}) GROUP BY 1) ON exp_id = event_id""")
def validation_report(spark, sf):
    return K.validation_report(candidates(spark, sf), artifacts(spark, sf))


@query("""SELECT p_partkey AS name, f AS field, CASE WHEN p = '' THEN 'field ''' || f || ''' missing' WHEN f = 'notes' THEN '''notes'' not found' ELSE f || ' not found' END AS reason, p AS pattern
  FROM (SELECT p_partkey, f, CASE f WHEN 'checkpoint' THEN 'ck/' || p_brand WHEN 'exp_config' THEN CASE WHEN p_size > 10 THEN 'cfg/' || p_type ELSE '' END
    ELSE 'n/' || p_size END AS p FROM part CROSS JOIN (VALUES ('checkpoint'), ('exp_config'), ('notes')) v(f))
  WHERE p = '' OR p NOT IN (SELECT 'ck/Brand#' || n_nationkey FROM nation UNION ALL SELECT 'cfg/' || p_type FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT 'n/' || n_nationkey FROM nation)""")
def config_fields_check(spark, sf):
    fields = F.create_map(F.lit("checkpoint"), text("ck/", c("p_brand")), F.lit("exp_config"),
                          F.when(c("p_size") > 10, text("cfg/", c("p_type"))), F.lit("notes"), text("n/", c("p_size")))
    rows = table(spark, sf, "part").select(c("p_partkey").alias("name"), fields.alias("fields"))
    nation = table(spark, sf, "nation")
    files = (nation.select(text("ck/Brand#", c("n_nationkey")).alias("path")).union(nation.select(text("n/", c("n_nationkey"))))
             .union(table(spark, sf, "part").filter("p_type <> 'SMALL'").select(text("cfg/", c("p_type"))).distinct()))
    return K.missing_fields(rows, ["checkpoint", "exp_config", "notes"], files)
