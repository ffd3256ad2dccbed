"""Duplicate and invalid directories, checkpoints, resumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import checkpoints as C
from runloom.operators import pruning as P
from workload.base import c, query, table, text


def train_dirs(spark, sf):
    """Orders as training directories ``C{customer}_{date}_{time}``; some carry no date."""
    stamp = text("_", F.date_format("o_orderdate", "yyyyMMdd"), "_000000")
    tail = F.when(c("o_orderpriority") == "5-LOW", text("-", c("o_orderkey"))).otherwise(stamp)
    return table(spark, sf, "orders").select(c("o_orderkey").alias("key"), text("C", c("o_custkey"), tail).alias("dir_name"))


@query("""SELECT o_orderkey AS key, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3
  THEN 'keep' ELSE 'prune' END AS action FROM orders""")
def keep_n(spark, sf):
    rows = table(spark, sf, "orders").select(c("o_orderkey").alias("key"), "o_custkey", "o_orderdate")
    return P.keep_newest(rows, ["o_custkey"], [c("o_orderdate").desc(), c("key")], "key", 3).select("key", "action")


@query("""SELECT o_orderkey AS key, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= 1500
  THEN 'keep' ELSE 'prune' END AS action FROM orders""")
def keep_n_large(spark, sf):
    """More rows per group than Spark cuts per task: numbered over range partitions."""
    rows = table(spark, sf, "orders").select(c("o_orderkey").alias("key"), "o_orderpriority", "o_orderdate")
    return P.keep_newest(rows, ["o_orderpriority"], [c("o_orderdate").desc(), c("key")], "key", 1500).select("key", "action")


NAME = """CASE WHEN o_orderpriority = '5-LOW' THEN 'C' || o_custkey || '-' || o_orderkey
  ELSE 'C' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') || '_000000' END"""
BASE = "CASE WHEN o_orderpriority = '5-LOW' THEN 'C' || o_custkey || '-' || o_orderkey ELSE 'C' || o_custkey END"


@query(f"""SELECT name AS dir_name, base AS base_name, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY d DESC) <= 2 THEN 'keep' ELSE 'prune' END AS action
  FROM (SELECT DISTINCT {NAME} AS name, {BASE} AS base, o_orderdate AS d FROM orders)""")
def duplicate_dirs(spark, sf):
    labelled = P.label_duplicates(train_dirs(spark, sf).select("dir_name").distinct(), 2)
    return labelled.select("dir_name", "base_name", "action")


def train_files(spark, sf):
    """Line items as files below their order's directory."""
    kind = (F.when(c("l_returnflag") == "A", text("model_e", c("l_linenumber"), ".pth")).when(c("l_returnflag") == "N", "notes.txt")
            .otherwise(text("run", c("l_linenumber"), "_results.json")))
    return table(spark, sf, "lineitem").select(
        text("D", c("l_orderkey")).alias("dir_name"), kind.alias("file_name"),
        F.when(c("l_discount") > 0.02, c("l_quantity")).otherwise(0).cast("bigint").alias("length"))


def eval_dirs(spark, sf):
    """Evaluation directories of the urgent and high orders, under the three name forms."""
    prefix = (F.when(c("o_orderstatus") == "F", "eval_navtest_").when(c("o_orderstatus") == "O", "eval_").otherwise("x_"))
    return table(spark, sf, "orders").filter(c("o_orderpriority") < "3").select(
        text(prefix, "D", c("o_orderkey")).alias("dir_name"), c("o_orderdate").alias("mtime"), "o_orderstatus", "o_orderkey")


def checked(spark, sf, **options):
    dirs = table(spark, sf, "orders").select(text("D", c("o_orderkey")).alias("dir_name"))
    evals = eval_dirs(spark, sf)
    eval_files = evals.select("dir_name", F.lit("metrics.json").alias("file_name"),
                              F.when(c("o_orderstatus") == "F", 10).otherwise(0).cast("bigint").alias("length"))
    return P.validity(dirs, train_files(spark, sf), evals.select("dir_name", "mtime"), eval_files, **options)


def _valid_sql(epoch=""):
    return f"""SELECT 'D' || o_orderkey AS dir_name, coalesce(ck, FALSE) AS ck, coalesce(rs, FALSE) OR (o_orderpriority < '3' AND o_orderstatus = 'F') AS rs,
      o_orderdate, o_custkey FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'A' {epoch}) AS ck,
      bool_or(l_returnflag = 'R' AND l_discount > 0.02 AND CAST(l_quantity AS BIGINT) > 0) AS rs FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


REASONS = "concat_ws(', ', CASE WHEN NOT ck THEN 'missing checkpoint' END, CASE WHEN NOT rs THEN 'missing eval results' END)"


@query(f"SELECT dir_name, {REASONS} AS reasons, ck AND rs AS valid FROM ({_valid_sql()})")
def invalid_runs(spark, sf):
    return checked(spark, sf).select("dir_name", "reasons", "valid")


@query(f"""SELECT dir_name, CASE WHEN NOT ck THEN 'missing checkpoint' ELSE '' END AS reasons FROM ({_valid_sql("AND l_linenumber = 2")})""")
def invalid_runs_epoch(spark, sf):
    return checked(spark, sf, require_eval=False, required_epochs=2).select("dir_name", "reasons")


@query("""SELECT 'D' || o_orderkey AS dir_name, CASE o_orderstatus WHEN 'F' THEN 'eval_navtest_' WHEN 'O' THEN 'eval_' ELSE 'x_' END || 'D' || o_orderkey AS eval_dir
  FROM orders WHERE o_orderpriority < '3'""")
def eval_dir_match(spark, sf):
    dirs = table(spark, sf, "orders").select(text("D", c("o_orderkey")).alias("dir_name"))
    return P.eval_dir_of(dirs, eval_dirs(spark, sf).select("dir_name", "mtime"))


def all_actions(spark, sf):
    """Validity by order, then duplicates among the valid directories of a customer and day."""
    dirs = table(spark, sf, "orders").select(
        text("D", c("o_orderkey")).alias("dir_name"),
        text("C", c("o_custkey"), "_", F.date_format("o_orderdate", "yyyyMMdd"), "_", F.lpad((c("o_orderkey") % 60).cast("string"), 6, "0")).alias("full"))
    named = checked(spark, sf).join(dirs, "dir_name").groupBy(c("full").alias("dir_name")).agg(F.bool_and("valid").alias("valid"))
    return P.prune_all(named)


ACTIONS = f"""SELECT name AS dir_name, CASE WHEN NOT valid OR r > 1 THEN 'prune' ELSE 'keep' END AS action,
  CASE WHEN NOT valid THEN 'invalid' WHEN r > 1 THEN 'duplicate' ELSE '' END AS reason FROM
  (SELECT *, row_number() OVER (PARTITION BY valid, o_custkey ORDER BY name DESC) AS r FROM
    (SELECT 'C' || v.o_custkey || '_' || strftime(v.o_orderdate, '%Y%m%d') || '_' || lpad(CAST(CAST(substr(dir_name, 2) AS BIGINT) % 60 AS VARCHAR), 6, '0') AS name,
      v.o_custkey, bool_and(ck AND rs) AS valid FROM ({_valid_sql()}) v GROUP BY 1, 2))"""


@query(ACTIONS)
def prune_all(spark, sf):
    return all_actions(spark, sf)


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total_found, CAST(count(*) FILTER (action = 'keep') AS BIGINT) AS kept, CAST(count(*) FILTER (action = 'prune') AS BIGINT) AS pruned,
  CAST(count(*) FILTER (reason = 'duplicate') AS BIGINT) AS duplicates_removed, CAST(count(*) FILTER (reason = 'invalid') AS BIGINT) AS invalid_removed,
  round(coalesce(sum(CASE WHEN action = 'prune' THEN length(dir_name) / 4.0 END), 0), 2) AS space_freed_mb FROM ({ACTIONS})""")
def prune_stats(spark, sf):
    actions = all_actions(spark, sf)
    sizes = actions.select("dir_name", (F.length("dir_name") / 4.0).alias("size_mb"))
    return P.prune_statistics(actions, sizes).withColumn("space_freed_mb", F.round("space_freed_mb", 2))


@query("SELECT 'D' || l_orderkey AS dir_name, round(sum(CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) / 1048576.0, 12) AS size_mb FROM lineitem GROUP BY 1")
def dir_size(spark, sf):
    return P.dir_sizes(train_files(spark, sf)).withColumn("size_mb", F.round("size_mb", 12))


def checkpoint_files(spark, sf):
    """Line items as checkpoint files of their part."""
    flag, line = c("l_returnflag"), c("l_linenumber")
    name = (F.when((flag == "A") & (line == 1) & (c("l_discount") > 0.08), "model_best.pth")
            .when(flag == "A", text("checkpoint_epoch_", c("l_suppkey"), ".pth"))
            .when(flag == "N", text("epoch=", line, "-step=", c("l_orderkey"), ".ckpt")).otherwise(text("optimizer", line, ".bin")))
    return table(spark, sf, "lineitem").select(
        c("l_partkey").alias("exp_id"), text("ck/", c("l_partkey"), "/", c("l_orderkey"), "/", name).alias("path"), c("l_shipdate").alias("mtime"))


CK = """(SELECT l_partkey AS exp_id, l_shipdate AS mtime, l_returnflag AS f, l_linenumber AS line, l_orderkey AS o, l_suppkey AS s,
  l_returnflag = 'A' AND l_linenumber = 1 AND l_discount > 0.08 AS best,
  'ck/' || l_partkey || '/' || l_orderkey || '/' || CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 AND l_discount > 0.08 THEN 'model_best.pth'
    WHEN l_returnflag = 'A' THEN 'checkpoint_epoch_' || l_suppkey || '.pth' WHEN l_returnflag = 'N' THEN 'epoch=' || l_linenumber || '-step=' || l_orderkey || '.ckpt'
    ELSE 'optimizer' || l_linenumber || '.bin' END AS path FROM lineitem)"""


@query(f"""SELECT exp_id, path, CAST(CASE WHEN b OR f = 'N' THEN NULL ELSE s END AS BIGINT) AS epoch, CASE WHEN b THEN 'best' ELSE 'latest' END AS type FROM
  (SELECT exp_id, arg_max(path, (best, mtime, path)) AS path, arg_max(best, (best, mtime, path)) AS b, arg_max(f, (best, mtime, path)) AS f,
    arg_max(s, (best, mtime, path)) AS s FROM {CK} WHERE f <> 'R' GROUP BY 1)""")
def ckpt_latest(spark, sf):
    return C.latest_or_best(checkpoint_files(spark, sf))


EPOCH = "CASE WHEN best OR f = 'R' THEN -1 WHEN f = 'A' THEN s ELSE line END"


@query(f"""SELECT exp_id, arg_max(path, (mtime, path)) AS by_time, arg_max(path, ({EPOCH}, mtime, path)) AS by_epoch,
  arg_max(path, (CASE WHEN f = 'N' THEN o ELSE -1 END, mtime, path)) AS by_step FROM {CK} GROUP BY 1""")
def ckpt_resolve(spark, sf):
    files = checkpoint_files(spark, sf)
    picks = {"by_time": "mtime", "by_epoch": "name_epoch", "by_step": "name_step"}
    # One pass: the three strategies are three aggregates over the same groups.
    ranked = [F.max_by("path", C.strategy_rank(c("path"), c("mtime"), s)).alias(n) for n, s in picks.items()]
    return files.groupBy("exp_id").agg(*ranked)


@query(f"""SELECT exp_id, path, CAST(e AS BIGINT) AS epoch FROM (SELECT exp_id, arg_max(path, ({EPOCH}, mtime, path)) AS path,
  nullif(max({EPOCH}), -1) AS e FROM {CK} WHERE f <> 'R' GROUP BY 1)""")
def ckpt_best(spark, sf):
    files = checkpoint_files(spark, sf).filter(~F.contains("path", F.lit("optimizer")))
    return C.highest_epoch(files)


@query(f"SELECT exp_id, path, strftime(mtime, '%Y-%m-%d') AS day FROM {CK} WHERE f = 'N' ORDER BY exp_id, mtime DESC, path")
def ckpt_all(spark, sf):
    files = checkpoint_files(spark, sf).filter(F.endswith("path", F.lit(".ckpt")))
    return C.resolve_all(files).select("exp_id", "path", F.date_format("mtime", "yyyy-MM-dd").alias("day"))


def registry(spark, sf):
    return table(spark, sf, "lineitem").select(
        c("l_partkey").alias("exp_id"), c("l_orderkey") * 10 + c("l_linenumber"), text("reg/", c("l_orderkey"), "/", c("l_linenumber")).alias("path"),
        F.when((c("l_tax") > 0.05), c("l_tax")).alias("val_loss")).toDF("exp_id", "pos", "path", "val_loss")


REG = """(SELECT l_partkey AS exp_id, l_orderkey * 10 + l_linenumber AS pos, 'reg/' || l_orderkey || '/' || l_linenumber AS path,
  CASE WHEN l_tax > 0.05 THEN l_tax END AS loss FROM lineitem)"""


@query(f"""SELECT exp_id, coalesce(arg_min(path, (loss, pos)) FILTER (loss IS NOT NULL), arg_max(path, pos)) AS best, arg_max(path, pos) AS last FROM {REG} GROUP BY 1""")
def ckpt_registered(spark, sf):
    rows = registry(spark, sf)
    best = C.registered(rows).withColumnRenamed("path", "best")
    return best.join(C.registered(rows, prefer_best=False).withColumnRenamed("path", "last"), "exp_id")


@query(f"""WITH g AS (SELECT exp_id, arg_max(path, (f = 'N', {EPOCH}, path)) AS path, arg_max(CASE WHEN f = 'N' THEN line WHEN best THEN NULL ELSE s END, (f = 'N', {EPOCH}, path)) AS e
    FROM {CK} WHERE f <> 'R' GROUP BY 1),
  r AS (SELECT p_partkey AS exp_id, 'reg/epoch-' || p_size || '.ckpt' AS path, p_size AS e FROM part WHERE p_size < 10),
  h AS (SELECT p_partkey AS exp_id, 'cfg/last.ckpt' AS path FROM part WHERE p_size < 20)
  SELECT p_partkey AS exp_id, coalesce(r.path, h.path, g.path) AS checkpoint_path, CAST(CASE WHEN r.path IS NOT NULL THEN r.e WHEN h.path IS NOT NULL THEN NULL ELSE g.e END AS BIGINT) AS checkpoint_epoch,
  CASE WHEN r.path IS NOT NULL THEN 'registry' WHEN h.path IS NOT NULL THEN 'eval_config' WHEN g.path IS NOT NULL THEN 'glob' END AS source
  FROM part LEFT JOIN r ON r.exp_id = p_partkey LEFT JOIN h ON h.exp_id = p_partkey LEFT JOIN g ON g.exp_id = p_partkey""")
def ckpt_multi_source(spark, sf):
    part = table(spark, sf, "part")
    ids = part.select(c("p_partkey").alias("exp_id"))
    reg = part.filter("p_size < 10").select(c("p_partkey").alias("exp_id"), text(" reg/epoch-", c("p_size"), ".ckpt\n").alias("path"))
    reg = reg.withColumn("path", F.regexp_replace("path", r"\s", ""))
    cfg = part.filter("p_size < 20").select(c("p_partkey").alias("exp_id"), F.lit(0).alias("position"),
                                            F.lit("").alias("checkpoint_path"), F.lit("cfg/last.ckpt").alias("agent_checkpoint_path"))
    return C.for_evaluation(ids, reg, cfg, checkpoint_files(spark, sf))


@query("""SELECT o_orderkey AS seq, CAST(CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 0 END + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS resume_number,
  CASE WHEN c_nationkey = 3 THEN 'root' ELSE 'C' || o_custkey END || '_resume' || (CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 0 END + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS new_exp_id
  FROM orders JOIN customer ON c_custkey = o_custkey""")
def resume_numbers(spark, sf):
    requests = table(spark, sf, "orders").select(text("C", c("o_custkey")).alias("source_id"), c("o_orderkey").alias("seq"))
    sources = table(spark, sf, "customer").select(
        text("C", c("c_custkey")).alias("exp_id"), F.when(c("c_acctbal") > 0, c("c_nationkey")).alias("resume_count"),
        F.when(c("c_nationkey") == 3, "root").alias("resume_from_exp_id"))
    return C.number_resumes(requests, sources).select("seq", "resume_number", "new_exp_id")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS id, p_partkey // 3 AS up, p_partkey // 3 <> p_partkey AND p_size > 4 AS has FROM part),
  w AS (SELECT id, id AS root, 0 AS depth, CASE WHEN has THEN up END AS up FROM e UNION ALL
        SELECT w.id, e.id, w.depth + 1, CASE WHEN e.has THEN e.up END FROM w JOIN e ON e.id = w.up)
  SELECT id AS exp_id, root, CAST(depth AS BIGINT) AS depth FROM w WHERE up IS NULL""")
def resume_lineage(spark, sf):
    up = F.floor(c("p_partkey") / 3)
    edges = table(spark, sf, "part").select(
        c("p_partkey").alias("exp_id"), F.when((up != c("p_partkey")) & (c("p_size") > 4), up).alias("resume_from_exp_id"))
    return C.resume_lineage(edges)
