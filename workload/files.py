"""Round trips: a table is written in a source's format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.functions.logtext import parse_log
from runloom.operators import grids as G
from runloom.operators import records as R
from runloom.plans.paths import field
from runloom.session import shared_dir
from runloom.sources import changelog as L
from runloom.sources import documents as D
from runloom.sources import exports as X
from runloom.sources import readers as S
from workload.base import c, query, table, text


@query("""SELECT o_orderkey || s AS exp_id, CASE s WHEN 'a' THEN o_orderstatus END AS status, CAST(o_custkey AS BIGINT) AS train_job_id
  FROM orders CROSS JOIN (VALUES ('a'), ('b')) v(s)""")
def read_state_json(spark, sf):
    path = shared_dir(spark, "state")
    first = F.struct(c("o_orderstatus").alias("status"), c("o_custkey").alias("train_job_id"))
    second = F.struct(F.lit(None).cast("string").alias("status"), c("o_custkey").alias("train_job_id"))
    state = F.create_map(text(c("o_orderkey"), "a"), first, text(c("o_orderkey"), "b"), second)
    table(spark, sf, "orders").select(F.to_json(state).alias("value")).write.text(path)
    return S.state_columns(S.read_state(spark, path, whole=False), {"status": "string", "train_job_id": "bigint"})


#: Rows of a table for each object of a group: objects stay large, but one task writes no whole group.
OBJECT_ROWS = 4_000_000


def object_files(df, label, group, key, entry):
    """JSON objects, as many a group as the table's rows ask for, a member a line; the first opens with a member named after the group."""
    path = shared_dir(df.sparkSession, label)
    blocks = max(1, -(-df.count() // OBJECT_ROWS))
    groups = df.select(group.alias("g")).distinct()
    lines = df.select(group.alias("g"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), text('"', key, '" : ', F.to_json(entry)).alias("value"))
    lines = lines.union(groups.select("g", F.lit(0), text(' {"all, {', c("g"), '\\"": []'))).union(
        groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.lit("}")))
    # The lines' order: the opening member begins with a blank, members with a quote; the closing bracket follows.
    first = F.row_number().over(Window.partitionBy("g", "block").orderBy(c("value").asc_nulls_last())) == 1
    opened = F.when(c("value").startswith(" "), "").when(first & (c("block") > 0), " {").when(c("value") == "}", "").otherwise(", ")
    lines.select("g", "block", F.concat(opened, "value").alias("value")).write.partitionBy("g", "block").text(path)
    return path


OBJECT_KEYS = "SELECT DISTINCT 'all, {' || o_orderstatus || '\"' AS exp_id, NULL AS comment, NULL AS train_job_id FROM orders"


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS exp_id, '}},{{"' || o_orderpriority AS comment, CAST(o_custkey AS BIGINT) AS train_job_id FROM orders
  UNION ALL {OBJECT_KEYS}""")
def read_state_object(spark, sf):
    """Few large objects, read at their members; brackets, commas and quotes stand inside of strings too."""
    entry = F.struct(text('},{"', c("o_orderpriority")).alias("comment"), c("o_custkey").alias("train_job_id"), F.array(F.lit(1), F.lit(2)).alias("more"))
    path = object_files(table(spark, sf, "orders"), "state-object", c("o_orderstatus"), c("o_orderkey"), entry)
    return S.state_columns(S.read_state(spark, path), {"comment": "string", "train_job_id": "bigint"})


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS exp_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'ck/' || o_custkey || ',x' ELSE 'ck/[last' END AS path,
  CASE i WHEN 0 THEN CAST(o_custkey AS INTEGER) END AS epoch FROM orders CROSS JOIN (VALUES (0), (1)) v(i)""")
def read_registry_object(spark, sf):
    first = F.struct(text("ck/", c("o_custkey"), ",x").alias("path"), c("o_custkey").cast("int").alias("epoch"))
    last = F.struct(F.lit("ck/[last").alias("path"), F.lit(None).cast("int").alias("epoch"))
    path = object_files(table(spark, sf, "orders"), "registry-object", c("o_orderstatus"), c("o_orderkey"), F.array(first, last))
    return S.read_registry(spark, path).select("exp_id", "pos", "path", "epoch")


@query("""SELECT p_brand AS exp_id, CAST(count(*) AS BIGINT) AS num, max(p_name) AS backbone, CAST(min(p_size) + 0.5 AS DOUBLE) AS rate, p_brand AS tag, '[1,2]' AS sizes FROM part GROUP BY p_brand""")
def read_yaml(spark, sf):
    path = shared_dir(spark, "configs")
    body = text("# configuration\nnum: ", c("n"), "\nbackbone: ", c("name"), "\nrate: ", c("low"), ".5\ntags:\n  - \"", c("p_brand"), "\"\n  - x\nsizes: [1, 2]\n")
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_name").alias("name"), F.min("p_size").alias("low"))
    brands.select(c("p_brand").alias("exp_id"), body.alias("value")).write.partitionBy("exp_id").option("lineSep", "\n").text(path)
    configs = S.read_configs(spark, path, "*.txt", partition_key="exp_id")

    def get(at, kind="string"):
        return F.try_variant_get("config", at, kind)

    return configs.select("exp_id", get("$.num", "bigint").alias("num"), get("$.backbone").alias("backbone"), get("$.rate", "double").alias("rate"),
                          get("$.tags[0]").alias("tag"), F.to_json(F.try_variant_get("config", "$.sizes", "variant")).alias("sizes"))


DIR = "'E' || l_linenumber || '_eval_navtest_' || lower(l_returnflag) || '_20260101_000000'"


def eval_files(spark, sf, *versions):
    """Line items as evaluation CSVs, one directory per line number and scope: a CSV for each version's columns and rows."""
    path = shared_dir(spark, "evaluations")
    name = text("E", c("l_linenumber"), "_eval_navtest_", F.lower("l_returnflag"), "_20260101_000000")
    for columns, rows in versions:
        chosen = table(spark, sf, "lineitem").filter(rows).select(name.alias("eval_dir"), text(c("l_orderkey")).alias("token"), *columns)
        chosen.repartition("eval_dir").write.mode("append").partitionBy("eval_dir").option("header", "true").csv(path)
    return path


@query(f"""SELECT {DIR} AS dir_name, CAST(count(*) AS BIGINT) AS scenarios, round(avg(l_discount), 6) AS score, max(l_tax) AS nc FROM lineitem GROUP BY 1""")
def read_csv_dirs(spark, sf):
    # The run of each directory was repeated; the first CSV holds other values.
    old, new = [(c("l_discount") + 1).alias("score"), c("l_quantity").alias("nc")], [c("l_discount").alias("score"), c("l_tax").alias("nc")]
    path = eval_files(spark, sf, (old, "true"), (new, "true"))
    rows = S.read_eval_rows(spark, path, "token string, score double, nc double", partition_key="eval_dir")
    return rows.groupBy("dir_name").agg(F.count(F.lit(1)).alias("scenarios"), F.round(F.avg("score"), 6).alias("score"), F.max("nc").alias("nc"))


@query(f"""SELECT {DIR} AS dir_name, CAST(count(*) AS BIGINT) AS scenarios, round(avg(l_discount), 6) AS score, max(l_tax) FILTER (l_linenumber > 3) AS nc,
  CAST(NULL AS DOUBLE) AS absent FROM lineitem GROUP BY 1""")
def read_csv_mixed(spark, sf):
    # Older files with other columns everywhere; the newest ones have no nc up to line number 3 and another column order.
    score, nc = c("l_discount").alias("score"), c("l_tax").alias("nc")
    path = eval_files(spark, sf, ([c("l_quantity").alias("absent")], "true"), ([nc, score], "l_linenumber > 3"), ([score], "l_linenumber <= 3"))
    rows = S.read_eval_rows_mixed(spark, path, ["score", "nc", "absent"], partition_key="eval_dir")
    return rows.groupBy("dir_name").agg(F.count(F.lit(1)).alias("scenarios"), F.round(F.avg("score"), 6).alias("score"), F.max("nc").alias("nc"),
                                        F.max("absent").alias("absent"))


@query("SELECT c_custkey AS exp_id, c_name AS name, c_acctbal AS accuracy, c_nationkey AS epochs FROM customer")
def read_json(spark, sf):
    path = shared_dir(spark, "results")
    table(spark, sf, "customer").select(c("c_custkey").alias("exp_id"), c("c_name").alias("name"), F.struct(
        c("c_acctbal").alias("accuracy"), c("c_nationkey").alias("epochs")).alias("metrics")).write.json(path)
    rows = S.read_json_results(spark, path, "exp_id bigint, name string, metrics struct<accuracy: double, epochs: int>", multi_line=False)
    return rows.select("exp_id", "name", "metrics.accuracy", "metrics.epochs")


@query("SELECT 'U' || user_id AS exp_id, event_type AS tag, event_id AS step, value FROM events")
def read_scalars(spark, sf):
    path = shared_dir(spark, "scalars")
    table(spark, sf, "events").select(text("U", c("user_id")).alias("exp_id"), c("event_type").alias("tag"), c("event_id").alias("step"), "value") \
        .write.option("header", "true").csv(path)
    return S.read_scalars(spark, path, "csv")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'C' || o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' END AS state,
  '12:0' || o_orderstatus AS time_limit FROM orders WHERE o_orderstatus <> 'P'""")
def read_queue(spark, sf):
    path = shared_dir(spark, "queue")
    code = F.when(c("o_orderstatus") == "F", "TIMEOUT").otherwise("PD")
    line = F.concat_ws("|", c("o_orderkey").cast("string"), code, text("C", c("o_custkey")), F.lit("gpu"), F.lit("1:00"), text("12:0", c("o_orderstatus")))
    short = F.concat_ws("|", c("o_orderkey").cast("string"), code)
    table(spark, sf, "orders").select(F.when(c("o_orderstatus") == "P", short).otherwise(line).alias("value")).write.text(path)
    return S.read_queue(spark, path).select("job_id", "name", "state", "time_limit")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'C' || o_custkey AS name, 'RUNNING' AS state, CASE WHEN o_orderstatus = 'F' THEN 'node7' ELSE '' END AS nodelist
  FROM orders WHERE o_orderstatus <> 'P'""")
def read_queue_spaces(spark, sf):
    path = shared_dir(spark, "queue")
    line = text("   ", c("o_orderkey"), "  gpu   C", c("o_custkey"), "  RUNNING", F.when(c("o_orderstatus") == "F", "   1:00 1  node7").otherwise(""))
    table(spark, sf, "orders").select(F.when(c("o_orderstatus") == "P", "  1 gpu").otherwise(line).alias("value")).write.text(path)
    return S.read_queue(spark, path, "spaces").select("job_id", "name", "state", "nodelist")


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS exp_id, i AS pos, CASE i WHEN 0 THEN 'ck/' || l_partkey ELSE 'ck/last' END AS path,
  CASE i WHEN 0 THEN l_linenumber END AS epoch, CASE i WHEN 0 THEN l_tax END AS val_loss FROM lineitem CROSS JOIN (VALUES (0), (1)) v(i)""")
def read_registry(spark, sf):
    path = shared_dir(spark, "registry")
    none = F.lit(None)
    first = F.struct(text("ck/", c("l_partkey")).alias("path"), F.lit("2026-01-01").alias("registered_at"), c("l_linenumber").alias("epoch"),
                     F.create_map(F.lit("val_loss"), c("l_tax")).alias("metrics"))
    last = F.struct(F.lit("ck/last").alias("path"), none.cast("string").alias("registered_at"), none.cast("int").alias("epoch"),
                    F.create_map().cast("map<string,double>").alias("metrics"))
    key = text(c("l_orderkey"), "-", c("l_linenumber"), "-", c("l_partkey"))
    table(spark, sf, "lineitem").select(F.to_json(F.create_map(key, F.array(first, last))).alias("value")).write.text(path)
    rows = S.read_registry(spark, path, whole=False)
    return rows.select("exp_id", "pos", "path", "epoch", F.try_element_at("metrics", F.lit("val_loss")).alias("val_loss"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'GPU ' || event_type AS name, value AS util_gpu, CAST(user_id AS DOUBLE) AS mem_used FROM events""")
def read_telemetry(spark, sf):
    path = shared_dir(spark, "telemetry")
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS")
    table(spark, sf, "events").select(
        stamp.alias("timestamp"), text(" GPU ", c("event_type")).alias("name"), text(" ", c("value"), " %").alias("utilization.gpu [%]"),
        F.lit(" [N/A]").alias("utilization.memory [%]"), text(" ", c("user_id"), " MiB").alias("memory.used [MiB]"), F.lit(" 81559 MiB").alias("memory.total [MiB]")) \
        .write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    rows = S.read_telemetry(spark, path)
    return rows.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "name", "util_gpu", "mem_used")


@query("""SELECT 'A' || c_custkey AS analysis, i AS position, CASE i WHEN 0 THEN 'big model' ELSE c_name END AS name, CASE i WHEN 0 THEN NULL ELSE 'ck/*.pth' END AS checkpoint,
  CASE i WHEN 0 THEN 'missing: exp_config, checkpoint' END AS error FROM customer CROSS JOIN (VALUES (0), (1)) v(i)""")
def read_analysis_def(spark, sf):
    path = shared_dir(spark, "analyses")
    line = text("{pipeline_name: A", c("c_custkey"), ", experiments: [{name: big model}, {name: '", c("c_name"), "', exp_config: cfg.yaml, checkpoint: 'ck/*.pth'}]}")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return S.read_analysis_definition(spark, path, glob=None, whole=False).select("analysis", "position", "name", "checkpoint", "error")


@query("SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS dir_name, TRUE AS filled FROM orders")
def list_files(spark, sf):
    path = shared_dir(spark, "inventory")
    table(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(path)
    files = S.list_files(spark, path, "*.parquet")
    return files.groupBy("dir_name").agg(F.bool_and(c("length") > 0).alias("filled"))


@query("""SELECT 'o_orderstatus=' || o_orderstatus AS dir_name, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes, TRUE AS placed, TRUE AS dated
  FROM orders GROUP BY 1""")
def list_files_sizes(spark, sf):
    """Sizes, paths and times of an inventory: each line is a key and its end."""
    path = shared_dir(spark, "inventory-sizes")
    table(spark, sf, "orders").select("o_orderstatus", c("o_orderkey").cast("string").alias("value")).write.partitionBy("o_orderstatus").option("lineSep", "\n").text(path)
    now = F.current_timestamp()
    return S.list_files(spark, path, "*.txt").groupBy("dir_name").agg(
        F.sum("length").alias("bytes"), F.bool_and(c("path").endswith(F.concat_ws("/", F.lit(""), "dir_name", "file_name"))).alias("placed"),
        F.bool_and(c("mtime").between(now - F.expr("INTERVAL 1 DAY"), now + F.expr("INTERVAL 1 DAY"))).alias("dated"))


@query("""SELECT count(*) / 10000.0 AS score, CAST(count(*) AS BIGINT) AS scenarios, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCESS' END AS status
  FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def read_logs(spark, sf):
    path = shared_dir(spark, "logs")
    n = c("n")
    body = text("INFO begin\nNumber of successful scenarios: ", n, "\nFinal average score of valid results: ", F.format_string("%.6f", n / 10000.0),
                F.when(c("o_orderstatus") == "P", "\nStatus: FAILED").otherwise("\nbye"))
    table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat_ws("_", F.lit("run"), "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("log"), body.alias("value")).write.partitionBy("log").text(path)
    return S.read_logs(spark, path).select(parse_log(c("value")).alias("p")).select("p.*")


def order_documents(spark, sf):
    return table(spark, sf, "orders").select(
        c("o_orderkey").cast("string").alias("exp_id"), c("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        text('{"metrics": {"total": ', c("o_totalprice"), '}, "who": "', c("o_custkey"), '"}').alias("doc"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS exp_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS absent FROM orders WHERE o_orderstatus = 'F'")
def export_csv(spark, sf):
    path = shared_dir(spark, "export")
    X.export_csv(order_documents(spark, sf), path, ["exp_id", "status", "who", "absent"], {"status": "==F"})
    return spark.read.option("header", "true").schema("exp_id string, status string, who string, absent string").csv(path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS exp_id, o_totalprice AS total FROM orders WHERE o_totalprice > 300000")
def export_json(spark, sf):
    path = shared_dir(spark, "export")
    X.export_json(order_documents(spark, sf), path, {"metrics.total": ">300000"})
    rows = spark.read.schema("exp_id string, status string, created_at string, doc string").json(path)
    return rows.select("exp_id", field(rows, "metrics.total", "double").alias("total"))


@query("""SELECT CASE WHEN p_size > 25 THEN 'PHASE_1' ELSE 'BASELINES' END AS "Phase", 'P' || p_partkey AS "ID", p_brand AS "Backbone", p_retailprice AS "Avg_PDMS", CAST(p_size AS BIGINT) AS "Freeze_%", p_name AS "Notes" FROM part""")
def spreadsheet(spark, sf):
    path = shared_dir(spark, "spreadsheet")
    doc = F.to_json(F.struct(
        F.struct(c("p_brand").alias("backbone"), c("p_size").alias("freeze_percentage")).alias("architecture"),
        F.struct(c("p_retailprice").alias("avg_pdm_score")).alias("evaluation"), c("p_name").alias("notes")))
    docs = table(spark, sf, "part").select(text("P", c("p_partkey")).alias("exp_id"), F.when(c("p_size") > 25, "PHASE_1").otherwise("BASELINES").alias("phase"), doc.alias("doc"))
    X.write_table(R.spreadsheet(docs), path, "json")
    names = ", ".join(f"`{n}` string" for n in R.SPREADSHEET)
    rows = spark.read.schema(names).json(path)
    return rows.select("Phase", "ID", "Backbone", c("Avg_PDMS").cast("double").alias("Avg_PDMS"), c("`Freeze_%`").cast("bigint").alias("Freeze_%"), "Notes")


@query("""SELECT c_custkey AS exp_id, c_mktsegment AS status, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS DOUBLE) END AS seed,
  CASE WHEN c_acctbal <= 0 THEN CAST(1.5 AS DOUBLE) END AS loss FROM customer""")
def wide_results(spark, sf):
    path = shared_dir(spark, "wide")
    results = F.when(c("c_acctbal") > 0, F.create_map(F.lit("score"), c("c_acctbal"), F.lit("seed"), c("c_nationkey").cast("double"))).otherwise(
        F.create_map(F.lit("loss"), F.lit(1.5)))
    records = table(spark, sf, "customer").select(c("c_custkey").alias("exp_id"), c("c_mktsegment").alias("status"), results.alias("results"))
    X.write_table(R.wide_results(records, R.result_keys(records)), path)
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(c("exp_id").cast("bigint"), "status", *[c(k).cast("double") for k in ("score", "seed", "loss")])


@query("""SELECT 'S' || s_suppkey || '-' || (seed - 1) AS exp_id, seed FROM supplier CROSS JOIN (VALUES (1), (2)) v(seed)
  WHERE 'S' || s_suppkey || '-' || (seed - 1) NOT IN (SELECT 'S' || l_suppkey || '-0' FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07)""")
def grid_files(spark, sf):
    path = shared_dir(spark, "grid")
    points = G.grid_points(table(spark, sf, "supplier").select("s_suppkey"), {"seed": [1, 2]})
    named = points.select(text("S", c("s_suppkey"), "-", c("position")).alias("exp_id"), "seed")
    existing = table(spark, sf, "lineitem").filter("l_discount > 0.09 AND l_tax > 0.07").select(text("S", c("l_suppkey"), "-0").alias("exp_id")).distinct()
    X.write_grid(named, path, existing)
    return spark.read.schema("exp_id string, seed int").json(path)


@query("""SELECT l_partkey AS exp_id, l_orderkey AS pos, 'ck/' || l_linenumber || '.pth' AS path, strftime(l_shipdate, '%Y-%m-%d') AS registered_at,
  l_linenumber AS epoch, l_tax AS val_loss FROM lineitem UNION ALL SELECT p_partkey, -1, p_name, NULL, p_size, p_retailprice FROM part""")
def register_ckpt(spark, sf):
    path = shared_dir(spark, "registry")
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    L.register_checkpoints(lines.select(
        c("l_partkey").alias("exp_id"), c("l_orderkey").alias("pos"), text("ck/", c("l_linenumber"), ".pth").alias("path"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("registered_at"), c("l_linenumber").cast("int").alias("epoch"), c("l_tax").alias("val_loss")), path)
    L.register_checkpoints(parts.select(
        c("p_partkey").alias("exp_id"), F.lit(-1).cast("bigint").alias("pos"), c("p_name").alias("path"), F.lit(None).cast("string").alias("registered_at"),
        c("p_size").cast("int").alias("epoch"), c("p_retailprice").alias("val_loss")), path)
    return spark.read.parquet(path)


@query("SELECT c_custkey AS exp_id, c_mktsegment AS status FROM customer")
def snapshot(spark, sf):
    rows = table(spark, sf, "customer").select(c("c_custkey").alias("exp_id"), c("c_mktsegment").alias("status"))
    return L.snapshot(rows, shared_dir(spark, "backup"), "before_rename").select("exp_id", "status")


@query("""SELECT CAST(count(*) AS BIGINT) AS n, strftime(o_orderdate, '%Y-%m') AS month FROM orders GROUP BY 2""")
def document_table(spark, sf):
    path = shared_dir(spark, "documents")
    docs = order_documents(spark, sf).withColumnRenamed("exp_id", "key")
    X.write_document_table(docs.withColumn("created_at", c("created_at").cast("timestamp")), path)
    return spark.read.parquet(path).groupBy(c("created_month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def change_log(spark, sf):
    """Events as changes of their user's document."""
    op = F.when(c("event_type").isin("signup", "purchase"), "put").when(c("event_type") == "error", "delete").otherwise("patch")
    doc = F.when(c("event_type").isin("purchase", "click"), text('{"k": ', F.get_json_object("props", "$.k"), ', "kind": "', c("event_type"), '"}')).otherwise(
        text('{"v": ', c("event_id"), "}"))
    return table(spark, sf, "events").select(c("user_id").alias("key"), op.alias("op"), F.when(op != "delete", doc).alias("doc"), c("event_id").alias("seq"), "ts")


LOG = """(SELECT user_id AS key, event_id AS seq, ts, event_type IN ('signup', 'purchase', 'error') AS reset, event_type = 'error' AS gone,
  CASE WHEN event_type IN ('purchase', 'click') THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_type IN ('purchase', 'click') THEN event_type END AS kind,
  CASE WHEN event_type IN ('view', 'signup') THEN event_id END AS v FROM events)"""
FOLD = f"""SELECT l.key, arg_max(k, seq) FILTER (k IS NOT NULL AND seq >= r) AS k, arg_max(kind, seq) FILTER (kind IS NOT NULL AND seq >= r) AS kind,
  max(v) FILTER (seq >= r) AS v, strftime(min(ts) FILTER (seq > d), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated
  FROM {LOG} l JOIN (SELECT key, coalesce(max(seq) FILTER (reset), -1) AS r, coalesce(max(seq) FILTER (gone), -1) AS d, max(seq) AS m FROM {LOG} GROUP BY 1) b
  ON b.key = l.key WHERE m > d GROUP BY 1"""


def _as_row(view):
    def get(key):
        return F.try_element_at("doc", F.lit(key))

    def shown(stamp):
        return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")

    return view.select("key", get("k").alias("k"), F.get_json_object(get("kind"), "$").alias("kind"), get("v").cast("bigint").alias("v"),
                       shown("created_at").alias("created"), shown("updated_at").alias("updated"))


@query(FOLD)
def doc_put_patch_delete(spark, sf):
    return _as_row(L.current_view(change_log(spark, sf)))


@query(FOLD)
def doc_log_round_trip(spark, sf):
    path = shared_dir(spark, "log")
    L.append(change_log(spark, sf), path)
    return _as_row(L.compact(spark.read.parquet(path)))


@query(FOLD)
def doc_base_and_deltas(spark, sf):
    # The log in three parts by its order: the first makes the base, the others are folded in.
    log = change_log(spark, sf)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    docs, step = D.DocumentTable(spark, shared_dir(spark, "document-table"), "bigint", log.schema["ts"].dataType.simpleString()), ((high or 0) - (low or 0)) // 3 + 1
    for part in range(3):
        docs.apply(f"part-{part}", log.filter(F.floor((c("seq") - (low or 0)) / step) == part))
    return _as_row(docs.current())


@query(f"""SELECT {DIR} AS dir_name, l_orderkey || chr(10) || l_comment || '", x' AS token, l_discount AS score, CASE WHEN l_linenumber > 3 THEN l_tax END AS nc
  FROM (SELECT *, 'c' || l_partkey AS l_comment FROM lineitem)""")
def read_csv_quoted(spark, sf):
    # Tokens with a line break, a quote and a comma; two headers; every directory has several files.
    path, wide = shared_dir(spark, "quoted"), c("l_linenumber") > 3
    name = text("E", c("l_linenumber"), "_eval_navtest_", F.lower("l_returnflag"), "_20260101_000000")
    rows = table(spark, sf, "lineitem").select(name.alias("eval_dir"), wide.alias("wide"), c("l_tax").alias("nc"), c("l_discount").alias("score"),
                                               text(c("l_orderkey"), "\n", "c", c("l_partkey"), '", x').alias("token"))
    for is_wide, columns in ((True, ["nc", "token", "score"]), (False, ["score", "token"])):
        rows.filter(c("wide") == is_wide).select("eval_dir", *columns).write.mode("append").partitionBy("eval_dir") \
            .option("header", "true").option("escape", '"').csv(path)
    return S.read_eval_rows_mixed(spark, path, ["score", "nc"], newest_only=False, partition_key="eval_dir")
