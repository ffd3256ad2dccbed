"""Nested records, derived labels and user code."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import analysis as U
from runloom.operators import records as R
from runloom.session import shared_dir
from runloom.sources import exports as X
from runloom.sources import readers as S
from workload.base import c, query, table, text

AGENTS = ["transfuser_agent", "diffusiondrive_ijepa_agent", "ego_status_mlp_agent", "my_constant_velocity", "law_agent", "other"]
METHODS = ["resnet", "ijepa", "dinov2", "mae", "own-net"]


def configs(spark, sf):
    """Parts as experiment configurations covering every label rule."""
    size = c("p_size")

    def choose(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    entries = {
        "agent": choose(AGENTS, c("p_partkey")), "backbone": choose(METHODS, F.floor(c("p_partkey") / 6)),
        "vit_arch": F.when(size > 35, "vit_base").when(size > 30, "vit_odd"), "vit_patch_size": F.when(size % 2 == 0, "16"),
        "vit_backend": F.when(size % 3 == 0, "custom"), "phase": F.when(size < 5, "given"),
        "num_gpus": (size % 4 + 1).cast("string"), "batch_size": F.when(size > 10, "64"),
        "pc_trainable_ijepa_layers": F.when(size > 20, "0.25"), "pc_trainable_mae_layers": F.lit("1.0"),
        "use_native_resolution": F.when(size > 25, "false"),
        "ijepa_checkpoint_path": F.when(size > 40, "w/IN1K.pth"), "mae_checkpoint_path": F.when(size > 15, "w/nuScenes/m.pth"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in entries.items()])
    config = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    prefix = choose(["A", "P", "F", "L", "exp_b", "exp_c", "Z"], F.floor(c("p_partkey") / 30))
    return table(spark, sf, "part").select(c("p_partkey").alias("key"), text(prefix, c("p_partkey")).alias("exp_id"), config.alias("config"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


BASE = f"""(SELECT p_partkey AS key, p_size AS z, {_list(AGENTS)}[p_partkey % 6 + 1] AS agent, {_list(METHODS)}[(p_partkey // 6) % 5 + 1] AS bb,
  {_list(["A", "P", "F", "L", "exp_b", "exp_c", "Z"])}[(p_partkey // 30) % 7 + 1] AS px FROM part)"""


@query(f"""SELECT key, CASE WHEN z < 5 THEN 'given' ELSE CASE px WHEN 'A' THEN 'BASELINES' WHEN 'P' THEN 'Transfuser' WHEN 'F' THEN 'Latent Transfuser' WHEN 'L' THEN 'LAW'
    WHEN 'exp_b' THEN 'PHASE_1' WHEN 'exp_c' THEN 'PHASE_2' ELSE 'UNKNOWN' END END AS phase,
  CASE agent WHEN 'transfuser_agent' THEN 'TransFuser' WHEN 'diffusiondrive_ijepa_agent' THEN 'DiffusionDrive' WHEN 'ego_status_mlp_agent' THEN 'EgoStatusMLP'
    WHEN 'my_constant_velocity' THEN 'ConstantVelocity' WHEN 'law_agent' THEN 'LawAgent' ELSE 'Unknown' END AS architecture,
  CASE WHEN bb = 'own-net' THEN bb WHEN agent IN ('transfuser_agent', 'diffusiondrive_ijepa_agent') THEN
      CASE WHEN z > 30 AND bb <> 'resnet' THEN CASE bb WHEN 'ijepa' THEN 'I-JEPA' WHEN 'dinov2' THEN 'DINOv2' ELSE 'MAE' END || ' ' || CASE WHEN z > 35 THEN 'ViT-B' ELSE 'vit_odd' END
        || CASE WHEN z % 2 = 0 THEN '/16' ELSE '' END || CASE WHEN z % 3 = 0 THEN ' (nuScenes)' ELSE '' END
      ELSE CASE bb WHEN 'resnet' THEN 'ResNet34' WHEN 'ijepa' THEN 'I-JEPA ViT-H/14' WHEN 'dinov2' THEN 'DINOv2 ViT-S/14' ELSE 'MAE ViT-L/16' END
        || CASE WHEN z % 3 = 0 AND bb <> 'resnet' THEN ' (custom)' ELSE '' END END
    WHEN agent = 'law_agent' THEN 'ResNet34' ELSE '' END AS backbone,
  CASE agent WHEN 'transfuser_agent' THEN 'RNN' WHEN 'diffusiondrive_ijepa_agent' THEN 'Diffusion' WHEN 'law_agent' THEN 'RNN' ELSE '' END AS backbone_type,
  CAST(CASE WHEN agent IN ('transfuser_agent', 'diffusiondrive_ijepa_agent') AND bb = 'ijepa' AND z > 20 THEN 75 ELSE 0 END AS DOUBLE) AS freeze,
  CAST((z % 4 + 1) * CASE WHEN z > 10 THEN 64 ELSE 32 END AS BIGINT) AS batch, CASE WHEN bb <> 'resnet' THEN CASE WHEN z > 25 THEN 'square' ELSE 'rect' END END AS resolution,
  CASE WHEN bb = 'resnet' THEN 'ImageNet (supervised)' WHEN z > 40 THEN 'ImageNet' WHEN z > 15 THEN 'nuScenes' ELSE 'ImageNet' END AS weights FROM {BASE}""")
def enrich_record(spark, sf):
    rich = R.enrich(configs(spark, sf), R.describe_architecture)
    return rich.select("key", "phase", c("architecture_name").alias("architecture"), c("backbone_label").alias("backbone"),
                       c("backbone_kind").alias("backbone_type"), c("freeze_percentage").alias("freeze"), c("effective_batch_size").alias("batch"),
                       c("resolution_type").alias("resolution"), c("weight_source").alias("weights"))


@query("""SELECT o_orderkey AS exp_id, o_orderstatus AS status, o_orderpriority AS partition, c_name AS "commit", TRUE AS stamped
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def record_sections(spark, sf):
    flat = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"), "left").select(
        c("o_orderkey").alias("exp_id"), c("o_orderstatus").alias("status"), c("o_orderpriority").alias("partition"), c("o_custkey").alias("train_job_id"), c("c_name").alias("commit"))
    record = R.build_record(flat, ["exp_id", "status"], {"slurm": ["partition", "train_job_id"], "git": ["commit"]})
    return record.select("exp_id", "status", "slurm.partition", "git.commit", c("stored_at").isNotNull().alias("stamped"))


@query("""SELECT l_suppkey AS exp_id, upper(r[1:1]) || lower(substr(r, 2)) AS "City", CAST(count(*) AS BIGINT) AS "Scenarios", round(avg(l_quantity), 6) AS "PDMS", max(l_tax) AS "NC", 'SUCCESS' AS "Status"
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'boston' WHEN 'R' THEN 'VEGAS' ELSE 'all' END AS r FROM lineitem) GROUP BY l_suppkey, r""")
def scope_csv_rows(spark, sf):
    scope = F.when(c("l_returnflag") == "A", "boston").when(c("l_returnflag") == "R", "VEGAS").otherwise("all")
    results = table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("exp_id"), scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("scenarios"), F.avg("l_quantity").alias("score"), F.max("l_tax").alias("NC")).withColumn("status", F.lit("SUCCESS"))
    flat = R.scope_table(results.withColumn("_id", c("exp_id")), ["_id", "NC"])
    return flat.select(c("_id").alias("exp_id"), "City", "Scenarios", F.round("PDMS", 6).alias("PDMS"), "NC", "Status")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS exp_id, upper(r[1:1]) || lower(substr(r, 2)) AS "City", CAST(count(*) AS BIGINT) AS "Scenarios", round(avg(l_quantity), 6) AS "PDMS", max(l_tax) AS "NC", 'SUCCESS' AS "Status"
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'boston' WHEN 'R' THEN 'VEGAS' ELSE 'all' END AS r FROM lineitem) GROUP BY l_suppkey, r""")
def scope_csv_files(spark, sf):
    scope = F.when(c("l_returnflag") == "A", "boston").when(c("l_returnflag") == "R", "VEGAS").otherwise("all")
    results = table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("exp_id"), scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("scenarios"), F.avg("l_quantity").alias("score"), F.max("l_tax").alias("NC")).withColumn("status", F.lit("SUCCESS"))
    path = shared_dir(spark, "scopes")
    X.export_scopes(results, path, metrics=["NC"])
    rows = S.read_scopes(spark, path, ["NC"])
    return rows.select(c("exp_id").cast("bigint"), "City", c("Scenarios").cast("bigint").alias("Scenarios"), F.round(c("PDMS").cast("double"), 6).alias("PDMS"),
                       c("NC").cast("double").alias("NC"), "Status")


@query("""SELECT l_suppkey AS exp_id, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n,
  max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY 1""")
def comparison_pivot(spark, sf):
    wide = R.comparison_columns(table(spark, sf, "lineitem"), "l_suppkey", ["A", "N", "R"], "l_returnflag", "l_quantity")
    return wide.toDF("exp_id", "a", "n", "r")


def analysis_results(spark, sf):
    """A handler over every document: it counts words and fails on empty prose of one language."""

    def handler(row):
        if row["lang"] == "de":
            raise ValueError(f"no model for {row['lang']}")
        return {"chars": len(row["text"]), "lang": row["lang"]}

    docs = table(spark, sf, "documents").select(
        text("Doc ", c("doc_id")).alias("name"), text("ck/", c("source")).alias("checkpoint"),
        F.when(c("lang") != "es", text("ck/", c("source"), "/last.ckpt")).alias("resolved_checkpoint"),
        (c("source") != "src3").alias("config_found"), "lang", "text")
    return U.run_handler(docs, handler, "out")


DONE = "lang <> 'es' AND source <> 'src3'"


@query(f"""SELECT 'Doc ' || doc_id AS name, {DONE} AND lang <> 'de' AS success, CASE WHEN {DONE} THEN 'ck/' || source || '/last.ckpt' ELSE 'ck/' || source END AS checkpoint_path,
  CASE WHEN {DONE} THEN 'out/doc_' || doc_id ELSE '' END AS output_dir,
  CASE WHEN lang = 'es' THEN 'checkpoint not found' WHEN source = 'src3' THEN 'exp_config could not be loaded' WHEN lang = 'de' THEN 'no model for de' ELSE '' END AS error,
  CASE WHEN {DONE} AND lang <> 'de' THEN CAST(length(text) AS VARCHAR) END AS chars FROM documents""")
def analysis_table(spark, sf):
    return U.summary_table(analysis_results(spark, sf), ["chars"])


@query(f"""SELECT 'Doc ' || doc_id AS name, {DONE} AND lang <> 'de' AS success, CASE WHEN lang = 'es' THEN 'checkpoint not found' WHEN source = 'src3' THEN 'exp_config could not be loaded' WHEN lang = 'de' THEN 'no model for de' END AS error,
  CASE WHEN {DONE} AND lang <> 'de' THEN CAST(length(text) AS BIGINT) END AS chars, CASE WHEN {DONE} AND lang <> 'de' THEN lang END AS lang,
  'name,success,checkpoint_path,output_dir,error,chars,lang' AS header FROM documents""")
def analysis_export(spark, sf):
    path = shared_dir(spark, "analysis-csv")
    X.export_analysis(analysis_results(spark, sf), path)
    rows = spark.read.option("header", "true").csv(path)
    return rows.select("name", c("success").cast("boolean"), "error", c("chars").cast("bigint"), "lang", F.lit(",".join(rows.columns)).alias("header"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER ({DONE} AND lang <> 'de') AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (NOT ({DONE} AND lang <> 'de')) AS BIGINT) AS failed FROM documents""")
def analysis_totals(spark, sf):
    return U.summarise(analysis_results(spark, sf))


@query("""SELECT 'p' || page_id AS path, CASE WHEN contains(html, 'noscript') THEN 'script-free page' END AS error, CASE WHEN NOT contains(html, 'noscript') THEN CAST(length(html) AS BIGINT) END AS chars FROM pages""")
def parse_user_files(spark, sf):
    def parser(path, body):
        if "noscript" in body:
            raise ValueError("script-free page")
        return [{"chars": len(body)}]

    pages = table(spark, sf, "pages").select(text("p", c("page_id")).alias("path"), c("html").alias("content"))
    return U.parse_files(pages, parser, "chars bigint")


@query("""SELECT l_suppkey AS exp_id, 'mean_qty' AS metric, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1""")
def user_harvester(spark, sf):
    def harvester(df):
        return df.groupBy(c("l_suppkey").alias("exp_id")).agg(F.round(F.avg("l_quantity"), 6).alias("value")).withColumn("metric", F.lit("mean_qty"))

    return U.harvest(table(spark, sf, "lineitem"), harvester).select("exp_id", "metric", "value")
