"""Streaming jobs over the event table, run until its files are processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import attempts as A
from runloom.operators import runs as R
from runloom.session import shared_dir
from runloom.streaming import follow, harvest, telemetry
from workload.base import c, exact_average, query, stream_of, table, text
from workload.runs import ATTEMPTS, RUN_ID, RUNS, SCOPES, result_dirs


def in_batches(spark, df, label, *deal):
    """The rows as files and a stream that takes about a third of the files at a time; ``deal`` says which rows share a file."""
    path = shared_dir(spark, label)
    df.repartition(6, *deal).write.parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(path)


@query(f"SELECT exp_id, {RUN_ID} AS run_id, round(avg_score, 6) AS avg_score, total_scenarios FROM ({RUNS})")
def stream_runs(spark, sf):
    # Directories are dealt by their names, so those of a run come in different batches.
    path, checkpoint = shared_dir(spark, "runs"), shared_dir(spark, "runs-progress")
    dirs = in_batches(spark, result_dirs(spark, sf), "result-dirs", "dir_name")
    harvest.harvest_directories(dirs, lambda batch: R.attribute_dirs(batch, SCOPES), path, checkpoint)
    return harvest.harvested_runs(spark, path).select("exp_id", "run_id", F.round("avg_score", 6).alias("avg_score"), "total_scenarios")


@query(f"""SELECT attempt_group_id, CAST(count(*) AS BIGINT) AS attempts_count, arg_max(run_id, (t, seq)) AS latest_attempt_id,
  round(coalesce(avg(CASE WHEN s > 0 THEN s END), 0), 6) AS mean_score, round(coalesce(stddev_samp(CASE WHEN s > 0 THEN s END), 0), 6) AS std_score,
  coalesce(max(CASE WHEN s > 0 THEN round(s, 6) END), 0) AS max_score FROM ({ATTEMPTS}) GROUP BY 1""")
def stream_summaries(spark, sf):
    summaries, checkpoint = (shared_dir(spark, n) for n in ("summaries", "summaries-progress"))
    events = table(spark, sf, "events").select(
        text("U", c("user_id")).alias("exp_id"), text("r", c("event_id")).alias("run_id"), c("event_id").alias("seq"), "event_type",
        (c("value") - 20).alias("avg_score"), F.when(c("event_type") != "error", F.date_format("ts", "yyyyMMdd_HHmmss")).alias("attempt_timestamp"))
    harvest.fold_summaries(in_batches(spark, A.with_group(events, [c("event_type")]), "attempts", "run_id"), summaries, checkpoint)
    current = harvest.folded_summaries(spark, summaries)
    return current.select("attempt_group_id", "attempts_count", "latest_attempt_id", *[F.round(n, 6).alias(n) for n in ("mean_score", "std_score", "max_score")])


@query("""SELECT event_type AS device, strftime(w, '%Y-%m-%d %H:%M') AS window_start, round(sum(value), 2) / count(*) AS avg_value, max(value) AS max_value, CAST(count(*) AS BIGINT) AS samples
  FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS w, max(ts) OVER () AS last FROM events)
  WHERE w + INTERVAL '6 hours' <= date_trunc('millisecond', last) - INTERVAL '10 minutes' GROUP BY event_type, w""")
def stream_telemetry(spark, sf):
    path, checkpoint = shared_dir(spark, "windows"), shared_dir(spark, "windows-progress")
    samples = stream_of(spark, sf, "events").select(c("ts").cast("timestamp").alias("ts"), c("event_type").alias("device"), "value")
    telemetry.append_windows(telemetry.windowed(samples, "ts", "device", "value", "6 hours", "10 minutes"), path, checkpoint)
    rows = spark.read.parquet(path)
    return rows.select("device", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), exact_average("avg_value", "samples"), "max_value", "samples")


@query("""SELECT event_type AS device, strftime(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS window_start, round(sum(value), 2) / count(*) AS avg_value,
  max(value) AS max_value, CAST(count(*) AS BIGINT) AS samples FROM events GROUP BY 1, 2""")
def telemetry_windows(spark, sf):
    samples = table(spark, sf, "events").select(c("ts").cast("timestamp").alias("ts"), c("event_type").alias("device"), "value")
    rows = telemetry.windowed(samples, "ts", "device", "value", "1 hour")
    return rows.select("device", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), exact_average("avg_value", "samples"), "max_value", "samples")


@query("""SELECT line, CAST(count(*) AS BIGINT) AS times FROM (SELECT unnest(string_split(text, chr(10))) AS line, text FROM documents) WHERE line <> '' GROUP BY 1""")
def stream_lines(spark, sf):
    logs, path, checkpoint = (shared_dir(spark, n) for n in ("logs", "lines", "lines-progress"))
    table(spark, sf, "documents").select(c("text").alias("value")).write.text(logs)
    follow.drain(follow.follow_lines(spark, logs), path, checkpoint)
    return spark.read.parquet(path).filter("value <> ''").groupBy(c("value").alias("line")).agg(F.count(F.lit(1)).alias("times"))
