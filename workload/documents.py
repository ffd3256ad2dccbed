"""Documents: orders and event properties as experiment documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import documents as D
from runloom.plans.filters import condition
from runloom.plans.ordering import exact_median
from runloom.plans.paths import field
from workload.base import c, query, rounded, table, text


def orders_as_documents(spark, sf):
    """Orders with promoted columns and a nested partition field."""
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("key"), c("o_orderstatus").alias("status"),
        F.struct(c("o_orderpriority").alias("partition")).alias("slurm"),
        c("o_totalprice").alias("total"), c("o_orderdate").alias("created_at"))


def events_as_documents(spark, sf):
    return table(spark, sf, "events").select(
        c("event_id").alias("key"), "event_type", "value", c("ts").alias("created_at"), c("props").alias("doc"))


K = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"


@query("""SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS total,
          strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey""")
def scan_newest_first(spark, sf):
    rows = D.newest_first(orders_as_documents(spark, sf), "created_at", "key")
    return rows.select("key", "status", "total", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(f"SELECT event_id AS key, event_type, {K} AS k FROM events WHERE {K} >= 50")
def doc_filter_numeric(spark, sf):
    docs = events_as_documents(spark, sf)
    return D.query(docs, {"k": ">=50"}).select("key", "event_type", field(docs, "k", "double").alias("k"))


@query(f"SELECT event_id AS key, value FROM events WHERE event_type = 'purchase' AND {K} < 20 AND value > 10")
def doc_filter_exact(spark, sf):
    docs = events_as_documents(spark, sf)
    return D.query(docs, {"event_type": "==purchase", "k": "<20", "value": ">10"}).select("key", "value")


@query("""SELECT o_orderkey AS key, o_orderpriority AS priority FROM orders
          WHERE contains(lower(o_orderpriority), 'not')""")
def doc_filter_contains(spark, sf):
    docs = orders_as_documents(spark, sf)
    return D.query(docs, {"slurm.partition": "Not"}).select("key", c("slurm.partition").alias("priority"))


@query(f"SELECT event_id AS key, value FROM events WHERE {K} = 42")
def doc_filter_typed(spark, sf):
    return D.query(events_as_documents(spark, sf), {"k": 42}).select("key", "value")


@query(f"""SELECT event_id AS key, event_type AS kind, json_extract_string(props, '$.k') AS k,
           CAST(NULL AS VARCHAR) AS absent FROM events WHERE {K} > 30 AND {K} <= 60""")
def doc_filter_nested(spark, sf):
    docs = events_as_documents(spark, sf).select(
        "key", text('{"run": {"kind": "', c("event_type"), '", "props": ', c("doc"), "}}").alias("doc"))
    hits = D.query(D.query(docs, {"run.props.k": ">30"}), {"run.props.k": "<=60"})
    return hits.select("key", field(hits, "run.kind").alias("kind"), field(hits, "run.props.k").alias("k"),
                       field(hits, "run.nothing.there").alias("absent"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' AND {K} >= 90")
def doc_filter_count(spark, sf):
    return D.count_matching(events_as_documents(spark, sf), {"event_type": "==click", "k": ">=90"})


@query("""SELECT o_orderkey AS key, o_totalprice AS total FROM orders
          WHERE contains(lower(o_orderstatus), 'f') AND contains(lower(o_orderpriority), 'high')
          AND o_totalprice >= 100000 AND o_totalprice <= 400000
          AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'""")
def doc_search(spark, sf):
    hits = D.search(orders_as_documents(spark, sf), status="F", partition="high", min_metric={"total": 100000},
                    max_metric={"total": 400000}, created_after="1996-01-01", created_before="1999-12-31")
    return hits.select("key", "total")


@query("SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def status_filter(spark, sf):
    return D.with_status(orders_as_documents(spark, sf), "O").select("key", "total")


@query("""SELECT coalesce(event_type, 'unknown') AS status, CAST(count(*) AS BIGINT) AS n
          FROM (SELECT nullif(event_type, 'error') AS event_type FROM events) GROUP BY 1""")
def status_all(spark, sf):
    rows = table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("status"))
    kept = D.with_status(rows, "all")
    return kept.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS key, p_name AS name FROM part
          WHERE list_has_any(string_split(p_name, ' '), ['red', 'bolt'])""")
def tag_overlap(spark, sf):
    parts = table(spark, sf, "part").withColumn("tags", F.split("p_name", " "))
    return D.with_any_tag(parts, ["red", "bolt"]).select(c("p_partkey").alias("key"), c("p_name").alias("name"))


@query("SELECT p_partkey AS key, p_size AS size FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def attr_filter(spark, sf):
    hits = D.with_attributes(table(spark, sf, "part"), p_brand="Brand#2", p_type="ECONOMY", p_size=None)
    return hits.select(c("p_partkey").alias("key"), c("p_size").alias("size"))


@query("""SELECT s_suppkey AS key, s_name AS name FROM supplier
          WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))""")
def known_set(spark, sf):
    regions = D.in_known_set(table(spark, sf, "nation"), "n_regionkey", [1, 3])
    hits = D.in_known_set(table(spark, sf, "supplier"), "s_nationkey", regions.select("n_nationkey"))
    return hits.select(c("s_suppkey").alias("key"), c("s_name").alias("name"))


def _best_sql(direction):
    return f"""SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_totalprice IS NOT NULL
               ORDER BY o_totalprice {direction}, o_orderdate DESC, o_orderkey LIMIT 10"""


@query(_best_sql("ASC"))
def best_n_asc(spark, sf):
    return D.best(orders_as_documents(spark, sf), "total", 10).select("key", "total")


@query(_best_sql("DESC"))
def best_n_desc(spark, sf):
    return D.best(orders_as_documents(spark, sf), "total", 10, ascending=False).select("key", "total")


@query("SELECT event_id AS key, event_type AS kind FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 10")
def recent_10(spark, sf):
    return D.first_newest(events_as_documents(spark, sf), 10).select("key", c("event_type").alias("kind"))


@query("""SELECT o_orderkey AS key, o_totalprice AS total FROM orders WHERE o_orderstatus = 'P'
          AND o_totalprice > 200000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def first_n(spark, sf):
    return D.first_newest(orders_as_documents(spark, sf), 25, {"status": "==P", "total": ">200000"}).select("key", "total")


@query("""SELECT c_custkey AS key, c_acctbal AS balance FROM customer WHERE c_acctbal IS NOT NULL
          ORDER BY c_acctbal DESC, c_custkey LIMIT 5""")
def n_largest(spark, sf):
    rows = table(spark, sf, "customer").select(c("c_custkey").alias("key"), c("c_acctbal").alias("balance"))
    return D.largest(rows, "balance", 5, "key")


@query("""SELECT o_orderpriority AS priority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS key,
          max(o_totalprice) AS total FROM orders GROUP BY 1""")
def best_row(spark, sf):
    rows = table(spark, sf, "orders").select(
        c("o_orderpriority").alias("priority"), c("o_orderkey").alias("key"), c("o_totalprice").alias("total"))
    return D.best_row_per(rows, ["priority"], "total", "key")


@query("""SELECT p_brand AS brand, p_partkey AS key FROM part
          ORDER BY p_brand NOT IN ('Brand#9', 'Brand#3'), p_brand""")
def listed_first(spark, sf):
    rows = table(spark, sf, "part").select(c("p_brand").alias("brand"), c("p_partkey").alias("key"))
    return D.listed_first(rows, "brand", ["Brand#9", "Brand#3"])


@query("""SELECT l.doc_id, -l.doc_id AS position, d.lang, d.source, d.n_chars FROM labels l
          JOIN documents d ON d.doc_id = l.doc_id ORDER BY position""")
def compare_ids(spark, sf):
    wanted = table(spark, sf, "labels").select("doc_id", (-c("doc_id")).alias("position"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return D.compare(docs, wanted, "doc_id")


def _stats_sql(metric, column, table_name):
    return f"""SELECT '{metric}' AS metric, CAST(count({column}) AS BIGINT) AS count, min({column}) AS min,
               max({column}) AS max, round(avg({column}), 4) AS mean, round(coalesce(stddev_samp({column}), 0), 4) AS stdev,
               round(median({column}), 6) AS median FROM {table_name}"""


def _stats(df, metrics):
    stats = D.metric_statistics(df, metrics)
    return stats.select("metric", "count", "min", "max", *rounded(4, "mean", "stdev"), *rounded(6, "median"))


@query(_stats_sql("total", "o_totalprice", "orders"))
def metric_stats(spark, sf):
    return _stats(orders_as_documents(spark, sf), ["total"])


@query(" UNION ALL ".join(_stats_sql(m, m, "lineitem") for m in
                          ["l_quantity", "l_discount", "l_tax"]))
def metric_stats_multi(spark, sf):
    return _stats(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query(f"""SELECT 'k' AS metric, CAST(count({K}) AS BIGINT) AS count, min({K}) AS min, max({K}) AS max,
           round(avg({K}), 4) AS mean, round(stddev_samp({K}), 4) AS stdev, round(median({K}), 6) AS median
           FROM events""")
def metric_stats_nested(spark, sf):
    return _stats(events_as_documents(spark, sf), ["k"])


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_discount), 6) AS mean,
          round(stddev_samp(l_discount), 6) AS std, CAST(count(l_discount) AS BIGINT) AS count
          FROM lineitem GROUP BY 1, 2""")
def group_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"), "l_discount")
    stats = D.group_statistics(rows, ["flag", "status"], "l_discount")
    return stats.select("flag", "status", *rounded(6, "mean", "std"), "count")


@query("""SELECT s AS priority, min('K' || o_orderkey) AS key, t AS total FROM (SELECT o_orderpriority AS s, o_orderkey, floor(o_totalprice / 10000) AS t,
  max(floor(o_totalprice / 10000)) OVER (PARTITION BY o_orderpriority) AS m FROM orders) WHERE t = m GROUP BY 1, 3""")
def best_row_text(spark, sf):
    """Ties on the score go to the smaller text key."""
    rows = table(spark, sf, "orders").select(c("o_orderpriority").alias("priority"), text("K", c("o_orderkey")).alias("key"),
                                             F.floor(c("o_totalprice") / 10000).cast("double").alias("total"))
    return D.best_row_per(rows, ["priority"], "total", "key")


@query("""SELECT event_id AS key, contains(event_type, 'c') AS by_type, FALSE AS by_value, FALSE AS by_k FROM events""")
def text_conditions(spark, sf):
    """Substring and == conditions meet text fields only, never numbers."""
    docs = events_as_documents(spark, sf)

    def hit(path, wanted):
        return F.coalesce(condition(docs, path, wanted), F.lit(False))

    return docs.select("key", hit("event_type", "C").alias("by_type"), hit("value", "1").alias("by_value"), hit("k", "==5").alias("by_k"))


@query("""SELECT l_returnflag AS flag, median(CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice * 1e200 WHEN l_orderkey % 7 = 1 THEN -l_extendedprice * 1e150
  ELSE l_extendedprice END) AS median FROM lineitem GROUP BY 1""")
def median_heavy_tail(spark, sf):
    """Exact medians of a metric with outliers 200 orders of magnitude away on both sides."""
    price, kind = c("l_extendedprice"), c("l_orderkey") % 7
    rows = table(spark, sf, "lineitem").select(c("l_returnflag").alias("flag"), F.when(kind == 0, price * 1e200).when(
        kind == 1, -price * 1e150).otherwise(price).alias("v"))
    return exact_median(rows, ["flag"], "v")
