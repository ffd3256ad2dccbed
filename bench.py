"""Time the headline queries (or, with --all, every registered query) and print one JSON line.

Each query runs completely into Spark's no-op sink; the reported time is the median of the
repeats, building the plan included. ``--sql`` adds DuckDB's seconds for the query's SQL.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "doc_filter_numeric", "doc_search", "best_n_desc", "compare_ids", "metric_stats", "metric_stats_multi", "group_stats",
    "scope_means", "scope_headline", "cross_scope_summary", "newest_per_scope", "run_records", "attempt_order", "attempt_summary",
    "scalar_summary", "scalar_series", "training_summary", "train_eval_outer", "parse_eval_dir", "epoch_of", "duration_of", "log_parse",
    "latest_log", "tail_lines", "strict_id_join", "job_name_join", "state_config_merge", "consistency_report", "artifact_check",
    "repair", "keep_n", "prune_all", "ckpt_latest", "ckpt_registered", "ckpt_multi_source", "resume_numbers", "grid_status",
    "registry_lookup", "batch_preview", "alloc_score", "enrich_record", "doc_put_patch_delete", "telemetry_windows",
    "attempt_order_blocks", "keep_n_large", "median_heavy_tail", "read_csv_dirs", "stream_runs", "stream_summaries",
]


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("names", nargs="*")
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--sql", action="store_true")
    parser.add_argument("--repeat", type=int, default=3)
    args = parser.parse_args()

    from runloom.session import build_session
    from workload import ORACLES, QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
    spark.range(1_000_000).selectExpr("sum(id)").collect()

    names = args.names or (list(QUERIES) if args.all else HEADLINE)
    seconds: dict[str, float] = {}
    sql_seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(args.repeat):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    if args.sql:
        import duckdb

        con = duckdb.connect()
        con.execute(f"SET threads = {cpus}")
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        for name in names:
            start = time.perf_counter()
            con.execute(ORACLES[name]).arrow()
            sql_seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    result = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
              "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if sql_seconds:
        result["sql_queries"] = sql_seconds
    print(json.dumps(result))


if __name__ == "__main__":
    main()
