"""Runs and attempts: events of a user and day as one run's evaluation directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import attempts as A
from runloom.operators import runs as R
from workload.base import c, query, rounded, table, text

SCOPES = ["click", "error", "purchase", "signup"]


def result_dirs(spark, sf):
    """One directory per user, day and event type; 'view' is the evaluation without a scope."""
    per_day = table(spark, sf, "events").groupBy(
        "user_id", F.date_format("ts", "yyyyMMdd").alias("day"), "event_type").agg(
        F.avg(F.when(c("value") > 20, c("value"))).alias("score"), F.count(F.lit(1)).alias("scenarios"),
        F.min("event_id").alias("first_id"))
    scope = F.when(c("event_type") != "view", c("event_type"))
    job = F.when(c("event_type") != "error", c("first_id").cast("string"))
    name = F.concat_ws("_", text("U", c("user_id"), "_eval_navtest"), scope, c("day"), F.lit("000000"), job)
    return per_day.select(name.alias("dir_name"), "score", "scenarios")


def records(spark, sf):
    return R.run_records(R.attribute_dirs(result_dirs(spark, sf), SCOPES))


DIRS = """SELECT 'U' || user_id AS exp_id, strftime(ts, '%Y%m%d') || '_000000' AS stamp,
  CASE event_type WHEN 'view' THEN 'all' ELSE event_type END AS scope, coalesce(avg(CASE WHEN value > 20 THEN value END), 0) AS score,
  count(*) AS scenarios, CASE WHEN event_type <> 'error' THEN CAST(min(event_id) AS VARCHAR) END AS job,
  concat_ws('_', 'U' || user_id || '_eval_navtest', nullif(event_type, 'view'), strftime(ts, '%Y%m%d'), '000000',
    CASE WHEN event_type <> 'error' THEN CAST(min(event_id) AS VARCHAR) END) AS name
  FROM events GROUP BY user_id, strftime(ts, '%Y%m%d'), event_type"""
RUNS = f"""SELECT exp_id, stamp, arg_min(coalesce(job, ''), name) AS job,
  coalesce(CASE WHEN bool_or(scope <> 'all') THEN avg(CASE WHEN scope <> 'all' AND score > 0 THEN score END)
    ELSE avg(CASE WHEN score > 0 THEN score END) END, 0) AS avg_score, CAST(sum(scenarios) AS BIGINT) AS total_scenarios,
  string_agg(scope, ',' ORDER BY scope) AS scopes FROM ({DIRS}) GROUP BY 1, 2"""
RUN_ID = "exp_id || '__' || stamp || CASE WHEN job = '' THEN '' ELSE '__' || job END"


@query(f"""SELECT exp_id, {RUN_ID} AS run_id, stamp, round(avg_score, 6) AS avg_score, total_scenarios, scopes FROM ({RUNS})""")
def run_records(spark, sf):
    return records(spark, sf).select("exp_id", "run_id", "stamp", F.round("avg_score", 6).alias("avg_score"), "total_scenarios",
                                     F.array_join(F.array_sort(F.map_keys("scopes")), ",").alias("scopes"))


@query(f"""SELECT exp_id, CAST(count(*) AS BIGINT) AS runs FROM ({RUNS}) GROUP BY ROLLUP (exp_id)""")
def run_counts(spark, sf):
    return R.run_counts(records(spark, sf))


@query(f"""SELECT exp_id, {RUN_ID} AS run_id, stamp[1:4] || '-' || stamp[5:6] || '-' || stamp[7:8] || ' 00:00' AS date,
  round(avg_score, 6) AS avg_score FROM ({RUNS})""")
def run_history(spark, sf):
    return R.run_history(records(spark, sf)).select("exp_id", "run_id", "date", F.round("avg_score", 6).alias("avg_score"))


@query(f"""SELECT d.exp_id, d.scope, round(d.score, 6) AS score, CAST(d.scenarios AS BIGINT) AS scenarios FROM ({DIRS}) d
  JOIN (SELECT exp_id, max(stamp) AS stamp FROM ({DIRS}) GROUP BY 1) l ON l.exp_id = d.exp_id AND l.stamp = d.stamp""")
def latest_run_scopes(spark, sf):
    last = R.latest_run_scopes(records(spark, sf))
    return last.select("exp_id", "scope", F.round("result.score", 6).alias("score"), "result.scenarios")


@query(f"""SELECT r.exp_id, {RUN_ID} AS run_id, c_mktsegment AS segment, c_nationkey AS nation, total_scenarios FROM ({RUNS}) r
  LEFT JOIN customer ON 'U' || c_custkey = r.exp_id""")
def run_with_experiment(spark, sf):
    facts = table(spark, sf, "customer").select(text("U", c("c_custkey")).alias("exp_id"), "c_mktsegment", "c_nationkey")
    joined = R.with_experiment(records(spark, sf), facts, ["c_nationkey"])
    return joined.select("exp_id", "run_id", c("c_mktsegment").alias("segment"), c("config.c_nationkey").alias("nation"), "total_scenarios")


@query("""SELECT o_orderkey AS key, o_custkey AS exp_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def skip_existing(spark, sf):
    new = table(spark, sf, "orders").select(c("o_orderkey").alias("key"), c("o_custkey").alias("exp_id"))
    return R.skip_stored(new, table(spark, sf, "lineitem").select(c("l_orderkey").alias("key")), "key")


@query("""SELECT DISTINCT exp_id FROM (
  SELECT 'exp_' || lower(c_mktsegment[1:1]) || (c_custkey % 50) AS exp_id FROM customer UNION ALL
  SELECT 'EXP_' || o_orderstatus || (o_custkey % 70) FROM orders WHERE o_orderpriority <> '5-LOW') ORDER BY 1""")
def distinct_ids(spark, sf):
    train = table(spark, sf, "customer").select(
        text("run-exp_", F.lower(F.substring("c_mktsegment", 1, 1)), c("c_custkey") % 50, "_2024").alias("n"))
    evals = table(spark, sf, "orders").select(F.when(c("o_orderpriority") == "5-LOW", "nothing here").otherwise(
        text("eval_EXP_", c("o_orderstatus"), c("o_custkey") % 70, "-x")).alias("n"))
    return R.distinct_ids([train, evals])


def attempts(spark, sf):
    """Events as attempts: the group is user and event type, errors have no time stamp."""
    events = table(spark, sf, "events").select(
        text("U", c("user_id")).alias("exp_id"), text("r", c("event_id")).alias("run_id"), c("event_id").alias("seq"), "event_type",
        (c("value") - 20).alias("avg_score"),
        F.when(c("event_type") != "error", F.date_format("ts", "yyyyMMdd_HHmmss")).alias("attempt_timestamp"))
    return A.with_group(events, [c("event_type")])


ATTEMPTS = """SELECT 'U' || user_id AS exp_id, 'r' || event_id AS run_id, event_id AS seq, value - 20 AS s,
  CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y%m%d_%H%M%S') ELSE '' END AS t,
  'ag__' || substr(sha256('U' || user_id || '|' || event_type), 1, 16) AS attempt_group_id FROM events"""


@query(f"""SELECT run_id, attempt_group_id, CAST(row_number() OVER (PARTITION BY attempt_group_id ORDER BY t, seq) AS BIGINT)
  AS attempt_order FROM ({ATTEMPTS})""")
def attempt_order(spark, sf):
    return A.assign_orders(attempts(spark, sf)).select("run_id", "attempt_group_id", c("attempt_order").cast("bigint"))


@query(f"""SELECT run_id, CAST(row_number() OVER (PARTITION BY exp_id ORDER BY t, seq) AS BIGINT) AS attempt_order FROM ({ATTEMPTS})""")
def attempt_order_blocks(spark, sf):
    """The same numbering per experiment, through the blocks that large tables need."""
    grouped = A.assign_orders(attempts(spark, sf), group="exp_id", block=4096)
    return grouped.select("run_id", c("attempt_order").cast("bigint"))


@query(f"""SELECT attempt_group_id, arg_max(exp_id, (t, seq)) AS exp_id, CAST(count(*) AS BIGINT) AS attempts_count,
  round(coalesce(avg(CASE WHEN s > 0 THEN s END), 0), 6) AS mean_score,
  round(coalesce(stddev_samp(CASE WHEN s > 0 THEN s END), 0), 6) AS std_score,
  round(coalesce(min(CASE WHEN s > 0 THEN s END), 0), 6) AS min_score, round(coalesce(max(CASE WHEN s > 0 THEN s END), 0), 6) AS max_score,
  arg_max(run_id, (t, seq)) AS latest_attempt_id, arg_min(run_id, (-s, t, seq)) AS best_attempt_id FROM ({ATTEMPTS}) GROUP BY 1""")
def attempt_summary(spark, sf):
    s = A.build_summaries(attempts(spark, sf))
    return s.select("attempt_group_id", "exp_id", "attempts_count", *rounded(6, "mean_score", "std_score", "min_score", "max_score"),
                    "latest_attempt_id", "best_attempt_id")
