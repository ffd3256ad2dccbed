"""Scopes: line items as evaluation rows, return flags as scopes ('N' is the overall one)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import scopes as S
from runloom.operators.scopes import ScopeRules
from workload.base import c, query, rounded, table, text

RULES = ScopeRules(columns={"score": ["absent", "l_discount"], "tax": ["some_tax", "l_tax"], "qty": ["l_quantity"]})


def eval_rows(spark, sf):
    flag = F.lower("l_returnflag")
    return table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("exp_id"), F.when(flag == "n", "all").otherwise(flag).alias("scope"),
        F.when(c("l_linenumber") == 7, S.SUMMARY_TOKEN).when(c("l_linenumber") < 7, c("l_orderkey").cast("string")).alias("token"),
        "l_discount", "l_tax", "l_quantity", F.when(c("l_returnflag") == "A", c("l_tax") * 2).alias("some_tax"))


ROWS = """SELECT l_suppkey AS exp_id, CASE l_returnflag WHEN 'N' THEN 'all' ELSE lower(l_returnflag) END AS scope,
  l_discount, l_tax, l_quantity FROM lineitem WHERE l_linenumber <> 7"""
MEANS = f"""SELECT exp_id, scope, CAST(count(*) AS BIGINT) AS scenarios, avg(l_discount) AS score,
  avg(l_tax) * CASE WHEN scope = 'a' THEN 2 ELSE 1 END AS tax, avg(l_quantity) AS qty FROM ({ROWS}) GROUP BY 1, 2"""


def means(spark, sf):
    return S.scope_means(eval_rows(spark, sf), RULES)


@query(f"SELECT exp_id, scope, scenarios, round(score, 6) AS score, round(tax, 6) AS tax, round(qty, 6) AS qty FROM ({MEANS})")
def scope_means(spark, sf):
    return means(spark, sf).select("exp_id", "scope", "scenarios", *rounded(6, "score", "tax", "qty"))


@query(f"""SELECT exp_id, CAST(sum(scenarios) AS BIGINT) AS total_scenarios, round(sum(score * scenarios) / sum(scenarios), 6) AS score,
  round(sum(tax * scenarios) / sum(scenarios), 6) AS tax FROM ({MEANS}) WHERE scope <> 'all' GROUP BY 1""")
def scope_weighted(spark, sf):
    scored = S.weighted_scores(means(spark, sf), ["score", "tax"])
    return scored.select("exp_id", "total_scenarios", *rounded(6, "score", "tax"))


@query(f"""SELECT exp_id, round(sum(x * scenarios) / sum(scenarios), 6) AS loose,
  round(sum(x * scenarios) / sum(CASE WHEN x IS NOT NULL THEN scenarios END), 6) AS strict
  FROM (SELECT *, CASE WHEN scope = 'a' THEN score END AS x FROM ({MEANS})) WHERE scope <> 'all' GROUP BY 1""")
def scope_weights(spark, sf):
    gaps = means(spark, sf).withColumn("score", F.when(c("scope") == "a", c("score")))
    loose = S.weighted_scores(gaps, ["score"]).select("exp_id", F.round("score", 6).alias("loose"))
    strict = S.weighted_scores(gaps, ["score"], strict_weights=True).select("exp_id", F.round("score", 6).alias("strict"))
    return loose.join(strict, "exp_id")


# Suppliers with a low balance have no overall scope.
HEAD = f"""(SELECT m.* FROM ({MEANS}) m JOIN supplier ON s_suppkey = exp_id WHERE scope <> 'all' OR s_acctbal > 3000)"""


@query(f"""SELECT exp_id, round(max(CASE WHEN scope = 'all' THEN score END), 6) AS overall_score,
  round(sum(CASE WHEN scope <> 'all' THEN score * scenarios END) / sum(CASE WHEN scope <> 'all' THEN scenarios END), 6) AS weighted_score,
  round(coalesce(max(CASE WHEN scope = 'all' THEN score END),
    sum(CASE WHEN scope <> 'all' THEN score * scenarios END) / sum(CASE WHEN scope <> 'all' THEN scenarios END)), 6) AS primary_score,
  CAST(coalesce(max(CASE WHEN scope = 'all' THEN scenarios END), sum(CASE WHEN scope <> 'all' THEN scenarios END)) AS BIGINT) AS total_scenarios,
  string_agg(scope, ',' ORDER BY scope) AS scopes FROM {HEAD} GROUP BY 1""")
def scope_headline(spark, sf):
    rich = table(spark, sf, "supplier").select(c("s_suppkey").alias("exp_id"), (c("s_acctbal") > 3000).alias("rich"))
    kept = means(spark, sf).join(rich, "exp_id").filter((c("scope") != "all") | c("rich"))
    head = S.headline(kept, RULES)
    return head.select("exp_id", *rounded(6, "overall_score", "weighted_score", "primary_score"), "total_scenarios",
                       F.array_join(F.array_sort(F.map_keys("scopes")), ",").alias("scopes"))


@query("""SELECT c_custkey AS exp_id, CAST(coalesce(n, 0) AS BIGINT) AS total_scenarios, round(s, 6) AS primary_score FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def scope_empty_records(spark, sf):
    rows = table(spark, sf, "orders").filter(c("o_orderstatus") == "F").select(
        c("o_custkey").alias("exp_id"), F.lit("f").alias("scope"), c("o_totalprice").alias("score"))
    rules = ScopeRules()
    head = S.headline(S.scope_means(rows, rules), rules)
    ids = table(spark, sf, "customer").select(c("c_custkey").alias("exp_id"))
    return S.with_empty(ids, head).select("exp_id", "total_scenarios", F.round("primary_score", 6).alias("primary_score"))


STATUS = f"(SELECT *, CASE WHEN tax < 0.04 THEN 'FAILED' WHEN score > 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status FROM ({MEANS}))"


@query(f"""SELECT exp_id,
  CAST(coalesce(sum(CASE WHEN used THEN scenarios END), max(CASE WHEN scope = 'all' THEN scenarios END), 0) AS BIGINT) AS total_scenarios,
  round(coalesce(sum(CASE WHEN used THEN score * scenarios END) / sum(CASE WHEN used THEN scenarios END),
    max(CASE WHEN scope = 'all' THEN score END), 0), 6) AS average_score,
  round(CASE WHEN bool_or(scope <> 'all') THEN avg(CASE WHEN scope <> 'all' THEN tax END) ELSE avg(tax) END, 6) AS avg_tax,
  round(CASE WHEN bool_or(scope <> 'all') THEN avg(CASE WHEN scope <> 'all' THEN qty END) ELSE avg(qty) END, 6) AS avg_qty
  FROM (SELECT *, status = 'SUCCESS' AND scope <> 'all' AS used FROM {STATUS}) GROUP BY 1""")
def cross_scope_summary(spark, sf):
    log = F.when(c("tax") < 0.04, "FAILED")
    rows = means(spark, sf).withColumn("status", S.scope_status(c("score"), log))
    summary = S.cross_scope_summary(rows, ["tax", "qty"])
    return summary.select("exp_id", "total_scenarios", *rounded(6, "average_score", "avg_tax", "avg_qty"))


@query("""SELECT l_suppkey AS exp_id, lower(l_returnflag) AS scope, CAST(count(*) AS BIGINT) AS scenarios,
  round((avg(coalesce(CASE WHEN l_linestatus = 'F' THEN l_discount END, 1)) + avg(coalesce(CASE WHEN l_quantity > 25 THEN l_tax END, 1))) / 2, 6) AS comfort
  FROM lineitem GROUP BY 1, 2""")
def comfort(spark, sf):
    rules = ScopeRules(columns={"score": ["l_discount"], "C": ["first"]}, comfort=("first", "second"))
    rows = table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("exp_id"), F.lower("l_returnflag").alias("scope"), "l_discount",
        F.when(c("l_linestatus") == "F", c("l_discount")).alias("first"),
        F.when(c("l_quantity") > 25, c("l_tax")).alias("second"))
    return S.scope_means(rows, rules).select("exp_id", "scope", "scenarios", F.round("C", 6).alias("comfort"))


GAP = f"""(SELECT m.*, CASE WHEN s_acctbal < 3000 THEN 'a' WHEN s_acctbal < 7000 THEN 'r' ELSE 'all' END AS home
  FROM ({MEANS}) m JOIN supplier ON s_suppkey = exp_id)"""


@query(f"""SELECT exp_id, round(i, 6) AS in_dist_score, round(o, 6) AS out_dist_avg, round((i - o) / i * 100, 4) AS gap_percent FROM
  (SELECT exp_id, max(CASE WHEN scope = home AND home <> 'all' THEN qty END) AS i, avg(CASE WHEN scope <> home THEN qty END) AS o
   FROM {GAP} GROUP BY 1)""")
def gen_gap(spark, sf):
    home = F.when(c("s_acctbal") < 3000, " A").when(c("s_acctbal") < 7000, "r").otherwise("all")
    homes = table(spark, sf, "supplier").select(c("s_suppkey").alias("exp_id"), home.alias("home"))
    gap = S.generalisation_gap(means(spark, sf).join(homes, "exp_id"), "home", "qty")
    return gap.select("exp_id", *rounded(6, "in_dist_score", "out_dist_avg"), *rounded(4, "gap_percent"))


PATH = "l_orderkey || '/' || l_linenumber || '/' || l_partkey"


@query(f"""SELECT l_suppkey AS exp_id, l_returnflag AS scope, arg_max({PATH}, (l_shipdate, {PATH})) AS path,
  strftime(max(l_shipdate), '%Y-%m-%d') AS shipped FROM lineitem GROUP BY 1, 2""")
def newest_per_scope(spark, sf):
    files = table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("exp_id"), c("l_returnflag").alias("scope"), "l_shipdate",
        text(c("l_orderkey"), "/", c("l_linenumber"), "/", c("l_partkey")).alias("path"))
    newest = S.newest_per(files, ["exp_id", "scope"], "l_shipdate", "path")
    return newest.select("exp_id", "scope", "path", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


@query("""SELECT s_suppkey AS exp_id, CAST(coalesce(n, s_nationkey + 1) AS BIGINT) AS scenarios,
  round(coalesce(q, s_nationkey / 100.0), 6) AS score, CASE WHEN n IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN n IS NULL THEN 'log' ELSE 'csv' END AS source FROM supplier LEFT JOIN
  (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 AND s_nationkey > 5 GROUP BY 1)
  ON l_suppkey = s_suppkey""")
def scope_log_fallback(spark, sf):
    suppliers = table(spark, sf, "supplier")
    dirs = suppliers.select(c("s_suppkey").alias("exp_id"), F.lit("all").alias("scope"))
    good = suppliers.filter((c("s_acctbal") > 0) & (c("s_nationkey") > 5)).select(c("s_suppkey").alias("exp_id"))
    rows = table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("exp_id"), F.lit("all").alias("scope"), c("l_quantity").alias("score")).join(good, "exp_id")
    own = S.scope_means(rows, ScopeRules()).withColumn("status", S.scope_status(c("score")))
    logs = suppliers.select(c("s_suppkey").alias("exp_id"), F.lit("all").alias("scope"),
                            (c("s_nationkey") + 1).cast("bigint").alias("scenarios"),
                            (c("s_nationkey") / 100.0).alias("score"), F.lit("FAILED").alias("status"))
    return S.with_log_fallback(dirs, own, logs).select("exp_id", "scenarios", F.round("score", 6).alias("score"), "status", "source")
