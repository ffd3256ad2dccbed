"""Training scalars: events as (user, tag, step, value) points."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import training as T
from runloom.session import shared_dir
from runloom.sources.exports import write_table
from workload.base import c, query, table

TAGS = {"click": "train_loss", "view": "val/loss", "error": "loss", "purchase": "epoch", "signup": "lr"}


def scalars(spark, sf):
    tag = F.coalesce(*[F.when(c("event_type") == k, F.lit(v)) for k, v in TAGS.items()])
    return table(spark, sf, "events").select(
        c("user_id").alias("exp_id"), tag.alias("tag"), c("event_id").alias("step"), "value")


SCALARS = f"""SELECT user_id AS exp_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items())} END AS tag,
  event_id AS step, value FROM events"""


@query(f"""SELECT exp_id, tag, arg_max(value, step) AS last_value, max(step) AS last_step, min(value) AS min_value,
  max(value) AS max_value, CAST(count(*) AS BIGINT) AS num_values FROM ({SCALARS}) GROUP BY 1, 2""")
def scalar_summary(spark, sf):
    return T.scalar_summary(scalars(spark, sf))


POSITIONS = f"SELECT *, row_number() OVER (PARTITION BY exp_id, tag ORDER BY step) - 1 AS position FROM ({SCALARS})"


@query(f"SELECT exp_id, tag, step, value, CAST(position AS BIGINT) AS position FROM ({POSITIONS})")
def scalar_series(spark, sf):
    return T.scalar_series(scalars(spark, sf), block=1024).select("exp_id", "tag", "step", "value", c("position").cast("bigint"))


@query(f"""SELECT exp_id, tag, CAST(position // 8 AS BIGINT) AS chunk, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS steps,
  CAST(count(value) AS BIGINT) AS points FROM ({POSITIONS}) GROUP BY 1, 2, 3""")
def scalar_chunks(spark, sf):
    chunks = T.series_chunks(T.scalar_series(scalars(spark, sf)), size=8)
    return chunks.select("exp_id", "tag", c("chunk").cast("bigint"), F.array_join(c("steps").cast("array<string>"), ",").alias("steps"),
                         F.size("values").cast("bigint").alias("points"))


def _training_sql():
    def last(tag):
        return f"arg_max(CASE WHEN tag = '{tag}' THEN value END, CASE WHEN tag = '{tag}' THEN step END)"

    def low(tag):
        return f"min(CASE WHEN tag = '{tag}' THEN value END)"

    return f"""SELECT exp_id, coalesce({last('train_loss')}, {last('loss')}) AS train_loss_last,
      coalesce({low('train_loss')}, {low('loss')}) AS train_loss_min, {last('val/loss')} AS val_loss_last, {low('val/loss')} AS val_loss_min,
      CAST(trunc({last('epoch')}) AS BIGINT) AS epochs, {last('lr')} AS final_lr FROM ({SCALARS}) GROUP BY 1"""


@query(_training_sql())
def training_summary(spark, sf):
    return T.training_summary(T.scalar_summary(scalars(spark, sf)))


EVALS = "SELECT l_suppkey + 20 AS exp_id, avg(l_quantity) AS score, max(l_tax) AS nc FROM lineitem GROUP BY 1"


@query(f"""SELECT coalesce(t.exp_id, e.exp_id) AS exp_id, train_loss_last, epochs, round(score, 6) AS score, nc AS eval_nc
  FROM ({_training_sql()}) t FULL JOIN ({EVALS}) e ON t.exp_id = e.exp_id""")
def train_eval_outer(spark, sf):
    evals = table(spark, sf, "lineitem").groupBy((c("l_suppkey") + 20).alias("exp_id")).agg(
        F.avg("l_quantity").alias("score"), F.create_map(F.lit("nc"), F.max("l_tax")).alias("metrics"))
    merged = T.merge_evaluations(T.training_summary(T.scalar_summary(scalars(spark, sf))), evals, metrics="metrics", metric_names=["nc"])
    return merged.select("exp_id", "train_loss_last", "epochs", F.round("score", 6).alias("score"), "eval_nc")


@query(f"""WITH e AS (SELECT l_suppkey + 20 AS exp_id, max(l_tax) AS eval_nc FROM lineitem GROUP BY 1),
  m AS (SELECT coalesce(t.exp_id, e.exp_id) AS exp_id, train_loss_last, epochs, eval_nc FROM ({_training_sql()}) t FULL JOIN e ON t.exp_id = e.exp_id)
  SELECT *, 'csv' AS form FROM m UNION ALL SELECT *, 'json' FROM m""")
def training_export(spark, sf):
    """Training and evaluation columns together, written as CSV and as JSON lines and read back."""
    evals = table(spark, sf, "lineitem").groupBy((c("l_suppkey") + 20).alias("exp_id")).agg(F.create_map(F.lit("nc"), F.max("l_tax")).alias("metrics"))
    merged = T.merge_evaluations(T.training_summary(T.scalar_summary(scalars(spark, sf))), evals, metrics="metrics", metric_names=["nc"])
    forms = []
    for form in ("csv", "json"):
        path = shared_dir(spark, "training")
        write_table(merged, path, form)
        rows = spark.read.schema(merged.schema).option("header", "true").format(form).load(path)
        forms.append(rows.select("exp_id", "train_loss_last", "epochs", "eval_nc", F.lit(form).alias("form")))
    return forms[0].unionByName(forms[1])


@query("""SELECT user_id AS exp_id, max(CASE WHEN event_type = 'click' THEN value END) AS navtest_pdms,
  max(CASE WHEN event_type = 'view' THEN value END) AS navhard_pdms, max(CASE WHEN event_type = 'error' THEN value END) AS pdms
  FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def split_metrics(spark, sf):
    kind = c("event_type")
    split = F.when(kind == "click", "navtest").when(kind == "view", "navhard").when(kind == "error", "unknown").otherwise("other")
    metric = F.when(kind == "signup", "num_scenarios").otherwise("pdms")
    rows = table(spark, sf, "events").select(c("user_id").alias("exp_id"), split.alias("eval_split"), metric.alias("metric"), "value")
    return T.split_prefixed(rows, ["navtest_pdms", "navhard_pdms", "pdms"])


LOGGED = """SELECT o_custkey AS exp_id, max(o_orderkey) + 1 AS epochs, arg_max(o_orderpriority[1:1], o_orderkey) AS loss FROM orders GROUP BY 1"""


@query(f"""SELECT coalesce(t.exp_id, l.exp_id) AS exp_id, CASE WHEN t.exp_id IS NULL THEN CAST('0.' || loss AS DOUBLE) ELSE t.train_loss_last END AS train_loss_last,
  CAST(CASE WHEN t.exp_id IS NULL THEN l.epochs ELSE t.epochs END AS BIGINT) AS epochs
  FROM ({_training_sql()}) t FULL JOIN ({LOGGED}) l ON t.exp_id = l.exp_id""")
def training_from_logs(spark, sf):
    logs = table(spark, sf, "orders").groupBy(c("o_custkey").alias("exp_id")).agg(
        (F.max("o_orderkey") + 1).alias("epochs"), F.max_by(F.concat(F.lit("0."), F.substring("o_orderpriority", 1, 1)), "o_orderkey")
        .cast("double").alias("train_loss"), F.lit(None).cast("double").alias("val_loss"))
    merged = T.with_log_values(T.training_summary(T.scalar_summary(scalars(spark, sf))), logs)
    return merged.select("exp_id", "train_loss_last", "epochs")


