"""Sizing: suppliers as node groups, nations as partitions, orders as queued jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import capacity as Q
from workload.base import c, query, table, text


def preview(spark, sf):
    """Orders' parts as requested experiments: parts in stock are registered, sized ones configured."""
    requested = table(spark, sf, "lineitem").select((c("l_partkey") + F.when(c("l_returnflag") == "A", 0).otherwise(3)).alias("exp_id")).distinct()
    part = table(spark, sf, "part")
    registered = part.filter("p_size > 5").select(c("p_partkey").alias("exp_id"))
    limit = F.when(c("p_type") == "SMALL", "1-12:00:00").when(c("p_type") == "PROMO", text(c("p_size"), ":30:00")).when(c("p_type") == "LARGE", "90")
    configs = part.filter("p_size < 45").select(
        c("p_partkey").alias("exp_id"), F.when(c("p_size") < 40, c("p_size") % 8 + 1).alias("num_gpus"), (c("p_size") % 3 + 1).alias("num_nodes"),
        limit.alias("time_limit"), F.when(c("p_size") > 8, c("p_type")).alias("partition"))
    return Q.preview_items(requested, registered, configs)


PREVIEW = """(SELECT r.exp_id, p_partkey IS NOT NULL AND p_size > 5 AND p_size < 45 AS ready,
  CASE WHEN p_partkey IS NULL OR p_size <= 5 THEN r.exp_id || ': not registered in metadata' WHEN p_size >= 45 THEN r.exp_id || ': YAML config missing' END AS warning,
  CASE WHEN p_size > 5 AND p_size < 45 THEN CASE WHEN p_size < 40 THEN p_size % 8 + 1 ELSE 1 END * (p_size % 3 + 1) ELSE 0 END AS gpus,
  CASE p_type WHEN 'SMALL' THEN 36 WHEN 'PROMO' THEN p_size + 0.5 WHEN 'LARGE' THEN 1.5 ELSE 0 END AS h,
  CASE WHEN p_size > 5 AND p_size < 45 THEN CASE WHEN p_size > 8 THEN p_type ELSE 'unknown' END END AS part
  FROM (SELECT DISTINCT l_partkey + CASE WHEN l_returnflag = 'A' THEN 0 ELSE 3 END AS exp_id FROM lineitem) r LEFT JOIN part ON p_partkey = r.exp_id)"""


@query(f"SELECT exp_id, ready, warning, CAST(gpus AS BIGINT) AS gpus, round(CAST(gpus * h AS DOUBLE), 6) AS gpu_hours, part AS partition FROM {PREVIEW}")
def batch_preview_items(spark, sf):
    return preview(spark, sf).withColumn("gpu_hours", F.round("gpu_hours", 6))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total_experiments, CAST(count(*) FILTER (ready) AS BIGINT) AS ready, CAST(count(*) FILTER (NOT ready) AS BIGINT) AS not_ready,
  CAST(sum(gpus) AS BIGINT) AS total_gpus, round(CAST(sum(gpus * h) AS DOUBLE), 2) AS estimated_gpu_hours FROM {PREVIEW}""")
def batch_preview(spark, sf):
    return Q.preview_totals(preview(spark, sf))


@query(f"SELECT part AS partition, CAST(count(*) AS BIGINT) AS experiments FROM {PREVIEW} WHERE ready GROUP BY 1")
def batch_preview_partitions(spark, sf):
    return Q.preview_partitions(preview(spark, sf))


def queues(spark, sf):
    partitions = table(spark, sf, "nation").select(
        c("n_name").alias("partition"), (c("n_regionkey") + 1).alias("gpus_per_node"), F.lit(10).alias("total_nodes"), text("G", c("n_regionkey")).alias("gpu_type"))
    state = F.when(c("s_acctbal") > 8000, "Idle").when(c("s_acctbal") > 7000, "mixed").otherwise("alloc")
    nation = table(spark, sf, "nation").select(c("n_nationkey"), c("n_name").alias("partition"))
    nodes = table(spark, sf, "supplier").join(nation, c("s_nationkey") == c("n_nationkey")).select(
        "partition", (F.floor(c("s_acctbal") / 5000) + 2).alias("count"), state.alias("state"))
    jobs = (table(spark, sf, "orders").filter(c("o_orderstatus") == "P").join(table(spark, sf, "customer"), c("c_custkey") == c("o_custkey"))
            .join(nation, c("c_nationkey") == c("n_nationkey")).select("partition"))
    return Q.queue_status(partitions, nodes, jobs)


QUEUE = """(SELECT n_name AS partition, n_regionkey + 1 AS gpn, 'G' || n_regionkey AS gpu_type, coalesce(nullif(t, 0), 10) AS total, coalesce(fr, 0) AS free, coalesce(q, 0) AS q FROM nation
  LEFT JOIN (SELECT s_nationkey, sum(floor(s_acctbal / 5000) + 2) AS t, sum(CASE WHEN s_acctbal > 7000 THEN floor(s_acctbal / 5000) + 2 END) AS fr FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS q FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY 1) ON c_nationkey = n_nationkey)"""
WAIT = "CASE WHEN free * gpn > 0 THEN 0 WHEN q > 0 THEN q * 30 END"


@query(f"""SELECT partition, gpn AS gpus_per_node, gpu_type, CAST(total AS BIGINT) AS total_nodes, CAST(free AS BIGINT) AS available_nodes, CAST(total * gpn AS BIGINT) AS total_gpus,
  CAST(free * gpn AS BIGINT) AS available_gpus, CAST(q AS BIGINT) AS queue_length, CAST({WAIT} AS BIGINT) AS wait_mins FROM {QUEUE}""")
def queue_status(spark, sf):
    return queues(spark, sf)


def attempts(spark, sf):
    """Line items as access probes of a part brand (partition) by a supplier (account)."""
    part = table(spark, sf, "part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "#", "_public")).alias("partition"))
    return table(spark, sf, "lineitem").join(part, c("l_partkey") == c("p_partkey")).select(
        "partition", text("acct", c("l_suppkey")).alias("account"), (c("l_discount") > 0.09).alias("allowed"))


PAIRS = """(SELECT DISTINCT lower(replace(p_brand, '#', '_public')) AS partition, 'acct' || l_suppkey AS account FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.09)"""


@query(f"SELECT partition, account FROM {PAIRS}")
def access_map(spark, sf):
    return Q.access_pairs(attempts(spark, sf))


@query(f"SELECT account, CAST(count(*) AS BIGINT) AS partitions, min(partition) AS first_partition FROM {PAIRS} GROUP BY 1")
def access_inverse(spark, sf):
    return Q.access_counts(Q.access_pairs(attempts(spark, sf)), "account")


def named_pairs(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", text("Region", c("n_regionkey"), "_gpu").alias("partition"))
    return table(spark, sf, "supplier").join(nation, c("s_nationkey") == c("n_nationkey")).select(
        "partition", F.when(c("s_acctbal") > 6000, text("team_gpu_", c("s_suppkey"))).otherwise(text("team", c("s_suppkey"))).alias("account"),
        c("s_suppkey").alias("position"))


@query("""SELECT 'Region' || n_regionkey || '_gpu' AS partition, CASE WHEN bool_or(s_acctbal > 6000) THEN 'team_gpu_' || min(CASE WHEN s_acctbal > 6000 THEN s_suppkey END)
  ELSE 'team' || min(s_suppkey) END AS account FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey""")
def account_choice(spark, sf):
    return Q.account_for_partition(named_pairs(spark, sf))


@query("""SELECT p_type AS gpu_type, arg_max(p_partkey, (s, -p_partkey)) AS partition, 'acct' || arg_max(p_partkey, (s, -p_partkey)) AS account, CAST(max(s) AS BIGINT) AS score FROM
  (SELECT *, CASE WHEN contains(lower(p_name), 'red') THEN 10 ELSE 0 END + CASE WHEN p_size > 30 THEN 5 ELSE 0 END AS s FROM part) GROUP BY 1""")
def pair_select(spark, sf):
    part = table(spark, sf, "part")
    name = F.when(F.contains(F.lower("p_name"), F.lit("red")), text("Public_", c("p_partkey"))).otherwise(text("own_", c("p_partkey")))
    partitions = part.select(name.alias("partition"), c("p_type").alias("gpu_type"), (c("p_size") <= 30).alias("requires_gpu"), c("p_partkey").alias("position"))
    accounts = part.select(name.alias("partition"), text("acct", c("p_partkey")).alias("account"))
    best = Q.select_pair(partitions, accounts, ["gpu_type"])
    return best.withColumn("partition", F.substring_index("partition", "_", -1).cast("bigint"))


SHAPES = f"(SELECT * FROM {QUEUE} CROSS JOIN (VALUES (4, 1), (2, 1), (8, 2), (1, 1)) v(g, n) WHERE g <= gpn * n)"


@query(f"SELECT partition, g AS num_gpus, n AS num_nodes FROM {SHAPES}")
def shapes(spark, sf):
    return Q.fitting_shapes(queues(spark, sf)).select("partition", "num_gpus", "num_nodes")


PER = "CASE WHEN 192 // g <= 48 THEN 192 // g ELSE 48 END"
ACC = "CASE WHEN 192 // g <= 48 THEN 1 ELSE (192 + 48 * g - 1) // (48 * g) END"


@query(f"""SELECT partition, g AS num_gpus, CAST({PER} AS BIGINT) AS per_gpu_batch, CAST({ACC} AS BIGINT) AS accumulation,
  CAST(greatest(100.0 - CASE WHEN free * gpn < g THEN 30 ELSE 0 END - least(q * 2, 30) - coalesce(least({WAIT} / 10.0, 20), 0) + CASE WHEN g = gpn THEN 10 ELSE 0 END
    - CASE WHEN ceil(g / gpn) > 1 THEN (ceil(g / gpn) - 1) * 5 ELSE 0 END + CASE WHEN partition = 'NATION_3' THEN 15 ELSE 0 END + CASE WHEN g = 4 THEN 10 ELSE 0 END, 0) AS DOUBLE) AS score,
  gpu_type || ' (' || CASE WHEN free * gpn >= g THEN ' ' || CAST(free * gpn AS BIGINT) || ' GPUs available now' ELSE ' Only ' || CAST(free * gpn AS BIGINT) || ' GPUs available (' || g || ' needed)' END
    || ', ' || CASE WHEN q = 0 THEN 'empty queue' ELSE q || ' jobs queued' END || CASE WHEN g = gpn THEN ', full node (efficient)' ELSE '' END || ')' AS reason,
  concat_ws('; ', CASE WHEN g <> 4 THEN 'GPU count changed from 4 to ' || g || '. Verify global batch size matches for reproducibility.' END, CASE WHEN partition <> 'NATION_3' THEN 'GPU type changed from G1 to ' || gpu_type || '. May affect precision/performance. Consider locking precision mode.' END,
    CASE WHEN {ACC} > 1 THEN 'Gradient accumulation (' || ({ACC}) || 'x) required to maintain global batch. May affect training dynamics slightly.' END) AS warnings, CAST(coalesce({WAIT}, 0) AS BIGINT) AS wait_mins, 'bf16' AS precision FROM {SHAPES}""")
def alloc_score(spark, sf):
    scored = Q.recommendations(Q.fitting_shapes(queues(spark, sf)), wanted_partition=F.lit("NATION_3"), wanted_gpus=F.lit(4), wanted_gpu_type=F.lit("G1"))
    return Q.ranked(scored, "partition", "num_gpus").select("partition", "num_gpus", "per_gpu_batch", "accumulation", "score", "reason", F.array_join("warnings", "; ").alias("warnings"),
                                                        c("estimated_wait_mins").alias("wait_mins"), "precision")
