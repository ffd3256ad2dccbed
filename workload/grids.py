"""Parameter grids over the given tables' rows as base configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions.labels import cell_status
from runloom.operators import grids as G
from runloom.operators import rules as U
from workload.base import c, query, table, text

AXES = {"lr": [0.001, 0.0001], "seed": [1, 2, 3]}
SCOPES = ["AFRICA", "AMERICA", "ASIA"]


def points(spark, sf):
    base = table(spark, sf, "supplier").select(
        "s_suppkey", F.create_map(F.lit("name"), c("s_name"), F.lit("seed"), F.lit("0")).alias("config"))
    grid = G.grid_points(base, AXES)
    return grid.withColumn("exp_id", text("S", c("s_suppkey"), "-", c("position")))


GRID = """(SELECT s_suppkey, s_name, s_nationkey, lr, seed, CAST(i * 3 + seed - 1 AS BIGINT) AS position, 'S' || s_suppkey || '-' || (i * 3 + seed - 1) AS exp_id
  FROM supplier CROSS JOIN (VALUES (CAST(0.001 AS DOUBLE), 0), (CAST(0.0001 AS DOUBLE), 1)) a(lr, i) CROSS JOIN (VALUES (1), (2), (3)) b(seed))"""


@query(f"SELECT s_suppkey AS key, exp_id, position, lr, seed FROM {GRID}")
def grid(spark, sf):
    return G.unique_ids(points(spark, sf)).select(c("s_suppkey").alias("key"), "exp_id", "position", "lr", "seed")


@query(f"""SELECT exp_id, s_name AS name, CAST(seed AS VARCHAR) AS seed, exp_id AS own_id,
  'seed=' || seed || '  position=' || position AS comment FROM {GRID}""")
def grid_config(spark, sf):
    made = G.point_configs(points(spark, sf), ["lr", "seed"])
    return made.select("exp_id", c("config.name"), c("config.seed"), c("config.exp_id").alias("own_id"),
                       G.point_comment(["seed", "position"]).alias("comment"))


@query("""SELECT n_name AS name, CAST(count(*) AS BIGINT) AS times FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 HAVING count(*) > 1""")
def grid_duplicates(spark, sf):
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("n_name").alias("name"))
    return G.duplicate_ids(named, "name")


def grid_state(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_returnflag").alias("status"))
    return lines.select(text("S", c("l_suppkey"), "-", c("l_linenumber")).alias("exp_id"), "status")


STATE = "(SELECT 'S' || l_suppkey || '-' || l_linenumber AS exp_id, max(l_returnflag) AS status FROM lineitem GROUP BY 1)"


@query(f"SELECT g.exp_id, coalesce(s.status, '—') AS status FROM {GRID} g LEFT JOIN {STATE} s ON s.exp_id = g.exp_id")
def grid_status(spark, sf):
    return G.status_grid(points(spark, sf), grid_state(spark, sf)).select("exp_id", "status")


@query(f"""SELECT s_suppkey AS key, max(CASE WHEN seed = 1 THEN st END) AS s1, max(CASE WHEN seed = 2 THEN st END) AS s2, max(CASE WHEN seed = 3 THEN st END) AS s3
  FROM (SELECT g.*, coalesce(s.status, '—') AS st FROM {GRID} g LEFT JOIN {STATE} s ON s.exp_id = g.exp_id) GROUP BY 1""")
def grid_view(spark, sf):
    cells = G.status_grid(points(spark, sf), grid_state(spark, sf))
    view = G.two_axis_view(cells, "s_suppkey", "seed", [1, 2, 3])
    return view.toDF("key", "s1", "s2", "s3")


@query(f"SELECT exp_id FROM {GRID} WHERE exp_id IN (SELECT exp_id FROM {STATE})")
def grid_known(spark, sf):
    return G.known_points(points(spark, sf), grid_state(spark, sf)).select("exp_id")


@query("""SELECT p_partkey AS key, CASE WHEN p_type = 'SMALL' THEN 'w/small' WHEN p_type = 'PROMO' THEN 'w/promo' END AS path,
  CASE WHEN p_type = 'SMALL' THEN 'teacher' END AS key_value, CASE WHEN p_type = 'SMALL' THEN coalesce(CASE WHEN p_size > 20 THEN 'own' END, 'tiny') WHEN p_size > 20 THEN 'own' END AS arch
  FROM part""")
def registry_lookup(spark, sf):
    # The registry has one row per part type, derived from the table itself.
    kinds = table(spark, sf, "part").select(c("p_type").alias("value")).filter(c("value").isin("SMALL", "PROMO")).distinct()
    small = c("value") == "SMALL"
    registry = kinds.select("value", text("w/", F.lower("value")).alias("path"), F.when(small, "teacher").alias("key"),
                            F.when(small, "tiny").alias("arch_desc"), F.when(~small, "promo_path").alias("path_field"), F.lit("").alias("key_field"))
    config = F.when(c("p_size") > 20, F.create_map(F.lit("arch_desc"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    made = G.inject_registry(table(spark, sf, "part").withColumn("config", config), registry, "p_type")

    def get(key):
        return F.try_element_at("config", F.lit(key))

    return made.select(c("p_partkey").alias("key"), F.coalesce(get("SMALL_checkpoint_path"), get("promo_path")).alias("path"),
                       get("SMALL_checkpoint_key").alias("key_value"), get("arch_desc").alias("arch"))


@query("""SELECT p_partkey AS value FROM part WHERE (p_size <= 25 AND 'ck/' || p_type || '/' || p_size NOT IN (SELECT 'ck/' || p_type || '/' || (p_size + 3) FROM part))
  OR (p_size > 25 AND p_brand || 'x' NOT IN (SELECT 'Brand#' || n_nationkey || 'x' FROM nation))""")
def grid_prerequisites(spark, sf):
    part = table(spark, sf, "part")
    path = F.when(c("p_size") <= 25, text("ck/", c("p_type"), "/", c("p_size"))).otherwise(text("b/", c("p_brand"), "?*"))
    registry = part.select(c("p_partkey").alias("value"), path.alias("path"))
    files = part.select(text("ck/", c("p_type"), "/", c("p_size") + 3).alias("path")).union(
        table(spark, sf, "nation").select(text("b/Brand#", c("n_nationkey"), "x").alias("path"))).distinct()
    return G.missing_prerequisites(registry, files).select("value")


@query("""SELECT p_partkey AS value FROM part WHERE CASE p_partkey % 3 WHEN 0 THEN p_size NOT IN (SELECT p_size + 3 FROM part)
  WHEN 1 THEN p_size <> 7 ELSE TRUE END""")
def grid_wildcards(spark, sf):
    """Wildcards in folder parts: ``ck/*/n``, ``**/n`` (only 7 lies at depth three) and a folder that is not there."""
    part = table(spark, sf, "part")
    path = F.when(c("p_partkey") % 3 == 0, text("ck/*/", c("p_size"))).when(c("p_partkey") % 3 == 1, text("deep/**/", c("p_size"))).otherwise(
        text("c?/none/*", c("p_size")))
    files = part.select(text("ck/", c("p_type"), "/", c("p_size") + 3).alias("path")).union(part.select(text("deep/a/", c("p_type"), "/7"))).distinct()
    return G.missing_prerequisites(part.select(c("p_partkey").alias("value"), path.alias("path")), files).select("value")


LOO = """(SELECT r_name, 'all' AS split FROM b UNION ALL SELECT r_name, r_name FROM b UNION ALL SELECT r_name, 'loo_' || s FROM b
  CROSS JOIN (VALUES ('AFRICA'), ('AMERICA'), ('ASIA')) v(s) WHERE r_name <> s)"""
REGIONAL = "WITH b AS (SELECT r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def loo_rows(spark, sf):
    rows = (table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
            .join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey")))
    return G.leave_one_out(rows.select("r_name"), "r_name", SCOPES)


@query(f"{REGIONAL} SELECT split, CAST(count(*) AS BIGINT) AS n FROM {LOO} GROUP BY 1")
def split_sizes(spark, sf):
    return G.split_sizes(loo_rows(spark, sf))


@query(f"""{REGIONAL} SELECT d.split, s AS r_name FROM (SELECT DISTINCT split FROM {LOO}) d CROSS JOIN (VALUES ('AFRICA'), ('AMERICA'), ('ASIA')) v(s)
  WHERE NOT EXISTS (SELECT 1 FROM {LOO} x WHERE x.split = d.split AND x.r_name = s)""")
def leave_one_out(spark, sf):
    return G.zero_shot_scopes(loo_rows(spark, sf), "r_name", SCOPES)


@query("""SELECT p_brand AS method, p_type AS dataset, CASE WHEN max(p_size) > 48 THEN 'DONE' WHEN max(p_size) > 45 THEN 'RUNNING' WHEN max(p_size) > 40 THEN 'EMPTY' ELSE '—' END AS status
  FROM part GROUP BY 1, 2""")
def cell_states(spark, sf):
    cells = table(spark, sf, "part").groupBy(c("p_brand").alias("method"), c("p_type").alias("dataset")).agg(F.max("p_size").alias("m"))
    return cells.select("method", "dataset", cell_status(c("m") > 40, c("m") > 48, c("m") > 45).alias("status"))


@query("""SELECT s_suppkey AS key, seed, CASE WHEN seed < 3 OR s_acctbal >= 0 THEN 'S' || s_suppkey || '-' || upper(s_name[1:4]) || seed END AS exp_id,
  CASE WHEN seed = 3 AND s_acctbal < 0 THEN 'no third seed in debt' END AS rule_error FROM supplier CROSS JOIN (VALUES (1), (2), (3)) b(seed)""")
def grid_named(spark, sf):
    def rule(point):
        if point["seed"] == 3 and point["s_acctbal"] < 0:
            raise ValueError("no third seed in debt")
        return f"S{point['s_suppkey']}-{point['s_name'][:4].upper()}{point['seed']}"

    grid = G.grid_points(table(spark, sf, "supplier"), {"seed": [1, 2, 3]})
    named = U.name_points(grid, rule, ["s_suppkey", "s_name", "s_acctbal", "seed"])
    return named.select(c("s_suppkey").alias("key"), "seed", "exp_id", "rule_error")


@query("""SELECT p_partkey AS key, CAST(CASE WHEN p_size > 45 THEN NULL ELSE greatest(4, p_size // 2) END AS BIGINT) AS workers,
  CASE WHEN p_size <= 45 THEN CASE WHEN p_type = 'SMALL' THEN '64G' ELSE (greatest(4, p_size // 2) * 2) || 'G' END END AS mem,
  CASE WHEN p_size <= 45 THEN '01:30:00' END AS time, CASE WHEN p_size > 45 THEN 'no node of size ' || p_size END AS rule_error FROM part""")
def eval_resources_custom(spark, sf):
    def advisor(config):
        size = int(config["size"])
        if size > 45:
            raise ValueError(f"no node of size {size}")
        workers = max(4, size // 2)
        return {"workers": workers, "mem": config.get("mem") or f"{2 * workers}G", "time": "01:30:00"}

    mem = F.when(c("p_type") == "SMALL", F.create_map(F.lit("mem"), F.lit("64G"))).otherwise(F.create_map(F.lit("mem"), F.lit("")))
    configs = table(spark, sf, "part").select(c("p_partkey").alias("key"), F.map_concat(F.create_map(F.lit("size"), c("p_size").cast("string")), mem).alias("config"))
    return U.recommend_resources(configs, advisor).drop("config")
