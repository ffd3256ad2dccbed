"""Operators on small hand-made tables."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from runloom.functions.logtext import LogPatterns
from runloom.operators import (
    analysis, attempts, capacity, checkpoints, consistency, documents, grids, jobs, logs, pruning, records, rules, runs, scopes, training)
from runloom.operators.scopes import ScopeRules


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def evaluation(spark, parts, exp="E"):
    data = [(exp, scope, f"t{i}", score) for scope, n, score in parts for i in range(n)]
    return spark.createDataFrame(data, "exp_id string, scope string, token string, score double")


def test_overall_scope_wins(spark):
    df = evaluation(spark, [("a", 10, 0.8), ("b", 10, 0.6), ("all", 20, 0.7)])
    head = scopes.headline(scopes.scope_means(df, ScopeRules()), ScopeRules()).first()
    assert head["primary_score"] == pytest.approx(0.7) and head["weighted_score"] == pytest.approx(0.7) and head["total_scenarios"] == 20


def test_weighted_without_overall(spark):
    df = evaluation(spark, [("a", 100, 0.8), ("b", 50, 0.6)])
    head = scopes.headline(scopes.scope_means(df, ScopeRules()), ScopeRules()).first()
    assert head["primary_score"] == pytest.approx((0.8 * 100 + 0.6 * 50) / 150)
    assert head["overall_score"] is None and head["total_scenarios"] == 150 and set(head["scopes"]) == {"a", "b"}


def test_strict_id_for_evaluations(spark):
    dirs = spark.createDataFrame([("A3_eval_test_all_20260101", 0.5), ("A3-b_eval_test_all_20260101", 0.99)], "dir_name string, s double")
    assert rows(jobs.dirs_by_id(dirs, spark.createDataFrame([("A3",)], "exp_id string")), "exp_id", "s") == [("A3", 0.5)]


def test_summary_rows_and_comfort(spark):
    data = [("E", "a", "t1", 1.0, None, 0.5), ("E", "a", None, 0.0, 1.0, None), ("E", "a", scopes.SUMMARY_TOKEN, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(data, "exp_id string, scope string, token string, score double, h double, t double")
    rules = ScopeRules(columns={"score": ["score"], "C": ["h"]}, comfort=("h", "t"))
    got = scopes.scope_means(df, rules).first()
    assert (got["scenarios"], got["score"]) == (2, 0.5) and got["C"] == pytest.approx(((1 + 1) / 2 + (0.5 + 1) / 2) / 2)
    assert scopes.without_summary_rows(df.drop("token")).count() == 3


def test_own_row_rule(spark):
    df = evaluation(spark, [("a", 2, 0.8), ("a", 1, 0.2)])
    got = scopes.scope_means(df, ScopeRules(keep=lambda d: F.col("score") > 0.5)).first()
    assert got["scenarios"] == 2


def test_cross_scope_rules(spark):
    df = spark.createDataFrame([("E", "a", 10, 0.8, "SUCCESS", 1.0), ("E", "b", 30, 0.4, "FAILED", 0.0), ("E", "all", 40, 0.5, "SUCCESS", 0.5),
                                ("F", "all", 7, 0.3, "SUCCESS", 0.2), ("G", "b", 3, 0.3, "FAILED", None)],
                               "exp_id string, scope string, scenarios bigint, score double, status string, NC double")
    got = {r["exp_id"]: r for r in scopes.cross_scope_summary(df, ["NC"]).collect()}
    assert (got["E"]["total_scenarios"], got["E"]["average_score"], got["E"]["avg_NC"]) == (10, 0.8, 0.5)
    assert (got["F"]["total_scenarios"], got["F"]["average_score"], got["F"]["avg_NC"]) == (7, 0.3, 0.2)
    assert (got["G"]["total_scenarios"], got["G"]["average_score"], got["G"]["avg_NC"]) == (0, 0.0, None)


def test_generalisation_gap(spark):
    df = spark.createDataFrame([("E", "boston", 0.8, " Boston"), ("E", "vegas", 0.4, " Boston"), ("E", "all", 0.6, " Boston")],
                               "exp_id string, scope string, score double, home string")
    assert scopes.generalisation_gap(df, "home").first()["gap_percent"] == pytest.approx(37.5)
    assert scopes.generalisation_gap(df, "home", count_overall=False).first()["gap_percent"] == pytest.approx(50)


def test_run_records(spark):
    df = spark.createDataFrame([("E_eval_nav_boston_20260101_000000_7", 0.8, 10), ("E_eval_nav_vegas_20260101_000000_8", 0.0, 10),
                                ("E_eval_nav_20260101_000000_9", 0.5, 20), ("E_eval_nav_20260102_000000", 0.4, 5)],
                               "dir_name string, score double, scenarios bigint")
    got = {r["stamp"]: r for r in runs.run_records(runs.attribute_dirs(df, ["boston", "vegas"])).collect()}
    first = got["20260101_000000"]
    assert (first["avg_score"], first["total_scenarios"], first["run_id"]) == (0.8, 40, "E__20260101_000000__9")
    assert set(first["scopes"]) == {"boston", "vegas", "all"} and got["20260102_000000"]["run_id"] == "E__20260102_000000"
    assert got["20260102_000000"]["avg_score"] == 0.4
    stored = spark.createDataFrame([(first["run_id"],)], "run_id string")
    records_ = runs.run_records(runs.attribute_dirs(df, ["boston", "vegas"]))
    assert runs.skip_stored(records_, stored).count() == 1 and runs.skip_stored(records_, stored, force=True).count() == 2


def test_attempts(spark):
    df = spark.createDataFrame([("E", "r1", 0.7, "20260101_120000", 1, "g"), ("E", "r2", 0.85, "20260102_120000", 0, "g"), ("E", "r0", None, None, 5, "g"),
                                ("E", "r3", 0.85, "20260103_120000", 9, "g"), ("E", "zz", 1.0, "x", 9, None)],
                               "exp_id string, run_id string, avg_score double, attempt_timestamp string, seq int, attempt_group_id string")
    orders = {r["run_id"]: r["attempt_order"] for r in attempts.assign_orders(df).collect()}
    assert orders == {"r0": 1, "r1": 2, "r2": 3, "r3": 4}
    s = attempts.build_summaries(df).first()
    assert (s["attempts_count"], s["best_attempt_id"], s["latest_attempt_id"]) == (4, "r2", "r3")
    assert s["mean_score"] == pytest.approx(0.8) and s["max_score"] == 0.85
    lone = attempts.build_summaries(df.filter("run_id = 'r0'")).first()
    assert (lone["mean_score"], lone["std_score"], lone["best_attempt_id"]) == (0.0, 0.0, "r0")


def test_scalars(spark):
    df = spark.createDataFrame([("E", "loss", s, float(v)) for s, v in [(3, 1), (1, 5), (2, 0)]] + [("E", "epoch", 1, 9.7)],
                               "exp_id string, tag string, step bigint, value double")
    summary = training.scalar_summary(df)
    got = {r["tag"]: r for r in summary.collect()}["loss"]
    assert (got["last_value"], got["last_step"], got["min_value"], got["max_value"], got["num_values"]) == (1, 3, 0, 5, 3)
    chunks = training.series_chunks(training.scalar_series(df), size=2)
    assert sorted(tuple(r["steps"]) for r in chunks.filter("tag = 'loss'").collect()) == [(1, 2), (3,)]
    t = training.training_summary(summary).first()
    assert (t["train_loss_last"], t["train_loss_min"], t["epochs"], t["val_loss_last"]) == (1, 0, 9, None)
    empty = spark.createDataFrame([], "exp_id string, eval_split string, score double")
    assert training.merge_evaluations(training.training_summary(summary), empty).count() == 1


def test_logs(spark):
    text = "Number of successful scenarios: 1234\nFinal average score of valid results: 0.8472\nStatus: SUCCESS\n"
    df = spark.createDataFrame([("x", text), ("y", None), ("z", "Status: FAILED\nStatus: SUCCESS\nfinal score = 0.5")], "path string, value string")
    assert rows(logs.parsed(df).fillna(-1), "path", "score", "scenarios", "status") == [
        ("x", 0.8472, 1234, "SUCCESS"), ("y", -1.0, 0, "UNKNOWN"), ("z", 0.5, 0, "FAILED")]
    own = LogPatterns(scores=[r"acc (\S+)", r"f1 (\d+)"], scenarios=[r"n=(\d+)"], success="OK", failure="KO")
    df = spark.createDataFrame([("a", "acc bad f1 3 n=4 OK")], "path string, value string")
    assert rows(logs.parsed(df, patterns=own), "score", "scenarios", "status") == [(3.0, 4, "SUCCESS")]
    files = spark.createDataFrame([("E", f"d/exp_eval_{i}.out", t) for i, t in [(1, 9), (2, 8), (99, 1)]], "exp_id string, path string, mtime int")
    assert logs.latest_log(files).first()["path"].endswith("_99.out") and logs.newest_log(files).first()["path"].endswith("_1.out")
    tail = logs.tail_lines(spark.createDataFrame([("p", "a\nb\nc\n"), ("q", "x"), ("r", "")], "path string, value string"), 2)
    assert rows(tail, "path", "line_no", "line") == [("p", 2, "b"), ("p", 3, "c"), ("q", 1, "x"), ("r", 1, "")]
    train = logs.parsed_training(spark.createDataFrame([("t", "Epoch 0: loss=1.5\nEpoch 29: train_loss=0.25, val_loss=0.75\n")], "path string, value string"))
    assert rows(train, "epochs", "train_loss", "val_loss") == [(30, 0.25, 0.75)]


def test_checkpoint_choices(spark):
    files = spark.createDataFrame([("E", "c/checkpoint_epoch_9.pth", 5), ("E", "c/model_best.pth", 1), ("E", "c/x.bin", 99), ("F", "f/epoch_3.pth", 2), ("F", "f/checkpoint_1.pth", 3)],
                                  "exp_id string, path string, mtime int")
    assert rows(checkpoints.latest_or_best(files).fillna(-1), "exp_id", "path", "epoch", "type") == [
        ("E", "c/model_best.pth", -1, "best"), ("F", "f/checkpoint_1.pth", 1, "latest")]
    assert rows(checkpoints.resolve(files, "name_epoch"), "exp_id", "path") == [("E", "c/checkpoint_epoch_9.pth"), ("F", "f/epoch_3.pth")]
    assert rows(checkpoints.resolve(files), "path") == [("c/x.bin",), ("f/checkpoint_1.pth",)]
    reg = spark.createDataFrame([("E", 0, "a", 0.5), ("E", 1, "b", 0.3), ("E", 2, "c", None), ("F", 0, "x", None), ("F", 1, "y", None)], "exp_id string, pos int, path string, val_loss double")
    assert rows(checkpoints.registered(reg), "exp_id", "path") == [("E", "b"), ("F", "y")]
    assert rows(checkpoints.registered(reg, prefer_best=False), "path") == [("c",), ("y",)]


def test_checkpoint_sources(spark):
    ids = spark.createDataFrame([(x,) for x in "RCGN"], "exp_id string")
    reg = spark.createDataFrame([("R", " /some/path/epoch=42-step=100.ckpt\n"), ("C", " ")], "exp_id string, path string")
    cfg = spark.createDataFrame([("R", 0, "no", None), ("C", 1, "late", None), ("C", 0, "", "agent/ep7.ckpt")], "exp_id string, position int, checkpoint_path string, agent_checkpoint_path string")
    files = spark.createDataFrame([("G", "g/epoch=1.ckpt", 1), ("G", "g/epoch=3.ckpt", 0), ("G", "g/epoch=9.pth", 2), ("N", "n/x.txt", 1)], "exp_id string, path string, mtime int")
    got = {r["exp_id"]: (r["checkpoint_path"], r["checkpoint_epoch"], r["source"]) for r in checkpoints.for_evaluation(ids, reg, cfg, files).collect()}
    assert got["R"][1:] == (42, "registry") and got["C"] == ("agent/ep7.ckpt", 7, "eval_config")
    assert got["G"] == ("g/epoch=3.ckpt", 3, "glob") and got["N"] == (None, None, None)


def test_resumes(spark):
    req = spark.createDataFrame([("E", 1), ("E", 2), ("F", 3)], "source_id string, seq int")
    src = spark.createDataFrame([("E", 2, None), ("F", None, "ROOT")], "exp_id string, resume_count int, resume_from_exp_id string")
    assert rows(checkpoints.number_resumes(req, src), "new_exp_id") == [("E_resume3",), ("E_resume4",), ("ROOT_resume1",)]
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 99)], "exp_id int, resume_from_exp_id int")
    got = {r["exp_id"]: (r["root"], r["depth"]) for r in checkpoints.resume_lineage(chain).collect()}
    assert got[39] == (0, 39) and got[0] == (0, 0) and got[100] == (100, 0)
    with pytest.raises(ValueError):
        checkpoints.resume_lineage(spark.createDataFrame([(1, 2), (2, 1)], "exp_id int, resume_from_exp_id int"))


def test_pruning(spark):
    names = ["B_20260101_000000", "B_20260102_000000", "B_20260103_000000", "C"]
    dirs = spark.createDataFrame([(n,) for n in names], "dir_name string")
    assert rows(pruning.label_duplicates(dirs).filter("action = 'keep'"), "dir_name") == [("B_20260103_000000",), ("C",)]
    files = spark.createDataFrame([(names[0], "model_e50.pth", 1), (names[0], "results.json", 1), (names[1], "last.ckpt", 1), (names[1], "results.json", 0),
                                   (names[2], "checkpoint.pt", 1), ("C", "a_results.json", 5)], "dir_name string, file_name string, length bigint")
    evals = spark.createDataFrame([(f"eval_x_{names[2]}", 1), (f"z_{names[2]}", 9), (f"eval_{names[1]}", 1)], "dir_name string, mtime int")
    eval_files = spark.createDataFrame([(f"eval_x_{names[2]}", "metrics.txt", 3)], "dir_name string, file_name string, length bigint")
    checked = pruning.validity(dirs, files, evals, eval_files)
    assert rows(checked, "dir_name", "reasons") == [(names[0], ""), (names[1], "missing eval results"), (names[2], ""), ("C", "missing checkpoint")]
    assert rows(pruning.validity(dirs, files, require_eval=False, required_epochs=5).filter("valid"), "dir_name") == []
    actions = pruning.prune_all(checked)
    assert rows(actions, "dir_name", "reason") == [(names[0], "duplicate"), (names[1], "invalid"), (names[2], ""), ("C", "invalid")]
    sizes = pruning.dir_sizes(spark.createDataFrame([(names[0], 1 << 20), (names[1], 1 << 19)], "dir_name string, length bigint"))
    stats = pruning.prune_statistics(actions, sizes).first()
    assert (stats["total_found"], stats["kept"], stats["pruned"], stats["duplicates_removed"], stats["invalid_removed"], stats["space_freed_mb"]) == (4, 1, 3, 1, 2, 1.5)


def test_consistency_and_repair(spark):
    state = spark.createDataFrame([("a", "done", "x.sh", None, False), ("b", "done", "gone.sh", None, True), ("c", "done", None, None, False)],
                                  "exp_id string, status string, train_script_path string, eval_script_path string, has_config_copy boolean")
    configs = spark.createDataFrame([("a",), ("b",), ("o",)], "exp_id string")
    paths = spark.createDataFrame([("x.sh",)], "path string")
    flags = consistency.consistency_flags(state, configs, paths)
    assert rows(consistency.consistency_issues(flags), "exp_id", "issue") == [("b", "broken_path"), ("b", "stale_copy"), ("c", "missing_config"), ("o", "orphan_config")]
    assert not consistency.consistency_report(flags).first()["ok"]
    fixed = consistency.repaired_state(state, flags, paths)
    after = consistency.consistency_flags(fixed.fillna(False), configs, paths)
    assert rows(consistency.consistency_issues(after), "exp_id", "issue") == [("c", "missing_config")]
    assert rows(fixed, "exp_id", "status")[-1] == ("o", "unknown")


def test_rename(spark):
    state = spark.createDataFrame([("A3", "s/A3_t.sh"), ("A3-b", "s/A3-b.sh")], "exp_id string, train_script_path string")
    good = spark.createDataFrame([("A3", "Z")], "old_id string, new_id string")
    assert rows(consistency.bulk_rename(state, good, text_fields=["train_script_path"]), "exp_id", "train_script_path") == [("A3-b", "s/A3-b.sh"), ("Z", "s/Z_t.sh")]
    for old, new in [("nope", "Z"), ("A3", "A3-b")]:
        with pytest.raises(ValueError):
            consistency.bulk_rename(state, spark.createDataFrame([(old, new)], "old_id string, new_id string"), text_fields=["train_script_path"])
    dirs = spark.createDataFrame([(n,) for n in ["A3_x", "A3-b", "A3.y", "run_A3", "XA3"]], "dir_name string")
    assert rows(consistency.rename_dirs(dirs, good), "new_name") == [("Z-b",), ("Z_x",), ("run_Z",)]
    paths = spark.createDataFrame([("A1", "runs/A10/A1_train.sh A1-b xA1 A1")], "exp_id string, train_script_path string")
    moved = consistency.apply_renames(paths, spark.createDataFrame([("A1", "B$7")], "old_id string, new_id string"), text_fields=["train_script_path"])
    assert moved.first()["train_script_path"] == "runs/A10/B$7_train.sh A1-b xA1 B$7"
    both = consistency.rename_dirs(spark.createDataFrame([("A3_x_y",)], "dir_name string"), spark.createDataFrame(
        [("A3", "Z"), ("A3_x", "W")], "old_id string, new_id string"))
    assert rows(both, "old_id", "new_name") == [("A3_x", "W_y")]


def test_registration_and_artifacts(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "exp_id string")
    configs, state = ids.filter("exp_id <> 'c'"), ids.filter("exp_id = 'a'")
    assert rows(consistency.register(ids, configs, state), "outcome") == [("already_present",), ("registered",), ("yaml_missing",)]
    assert consistency.created_rows(consistency.register(ids, configs, state, force=True)).count() == 2
    present = consistency.where_present(configs, "exp_id", "yaml", F.lit(True))
    missing = consistency.missing_artifacts(ids, configs, present, {"yaml": "no yaml", "checkpoint": "no checkpoint"})
    assert rows(missing, "exp_id", "reason") == [("a", "no checkpoint"), ("b", "no checkpoint"), ("c", "not registered in metadata")]
    report = consistency.validation_report(ids, missing).first()
    assert (report["found"], report["total"], report["missing"], report["ready"]) == (0, 3, 3, False)


def test_grid(spark):
    base = spark.range(1).select(F.create_map(F.lit("seed"), F.lit("0"), F.lit("x"), F.lit("y")).alias("config"))
    points = grids.grid_points(base, {"lr": [1e-3, 1e-4], "seed": [1, 2, 3]}).withColumn("exp_id", F.format_string("g%d", "position"))
    got = points.orderBy("position").collect()
    assert len(got) == 6 and (got[0]["lr"], got[0]["seed"]) == (1e-3, 1) and (got[3]["lr"], got[3]["seed"]) == (1e-4, 1)
    assert grids.unique_ids(points).count() == 6
    with pytest.raises(Exception, match="id twice"):
        grids.unique_ids(points.withColumn("exp_id", F.lit("same"))).collect()
    config = grids.point_configs(points, ["lr", "seed"]).orderBy("position").first()["config"]
    assert config == {"seed": "1", "x": "y", "lr": "0.001", "exp_id": "g0"}
    state = spark.createDataFrame([("g1", "done")], "exp_id string, status string")
    assert rows(grids.status_grid(points, state), "exp_id", "status")[:2] == [("g0", "—"), ("g1", "done")]
    assert rows(grids.known_points(points, state), "exp_id") == [("g1",)]
    named = points.withColumn("exp_id", F.udf(lambda lr, seed: f"u{seed}-{lr}")("lr", "seed"))
    assert grids.unique_ids(named).count() == 6
    with pytest.raises(ValueError):
        grids.grid_points(base, {})


def test_capacity(spark):
    parts = spark.createDataFrame([("p", 4, 10, "G"), ("q", 2, 5, "H")], "partition string, gpus_per_node int, total_nodes int, gpu_type string")
    nodes = spark.createDataFrame([("p", 3, "IDLE"), ("p", 2, "alloc")], "partition string, count int, state string")
    queue = spark.createDataFrame([("q",), ("q",)], "partition string")
    status = capacity.queue_status(parts, nodes, queue)
    assert rows(status, "partition", "total_nodes", "available_gpus", "queue_length", "wait_mins") == [("p", 5, 12, 0, 0), ("q", 5, 0, 2, 60)]
    best = capacity.ranked(capacity.recommendations(capacity.fitting_shapes(status)), "partition").first()
    assert (best["partition"], best["num_gpus"], best["score"]) == ("p", 4, 110.0)
    pairs = spark.createDataFrame([("h200_x", "gen", 0), ("h200_x", "h200_team", 1), ("v", "z", 0)], "partition string, account string, position int")
    assert rows(capacity.account_for_partition(pairs), "partition", "account") == [("h200_x", "h200_team"), ("v", "z")]
    wanted = spark.createDataFrame([("a_public", True, 0), ("b_public", False, 1), ("c", False, 2)], "partition string, requires_gpu boolean, position int")
    accounts = spark.createDataFrame([(p, "acc") for p in ("a_public", "b_public", "c")], "partition string, account string")
    assert rows(capacity.select_pair(wanted, accounts), "partition", "score") == [("b_public", 15)]


def test_preview(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "exp_id string")
    configs = spark.createDataFrame([("a", 4, 2, "1-00:00:00", "gpu")], "exp_id string, num_gpus int, num_nodes int, time_limit string, partition string")
    items = capacity.preview_items(ids, ids.filter("exp_id <> 'c'"), configs)
    assert rows(items.fillna(""), "exp_id", "warning") == [("a", ""), ("b", "b: YAML config missing"), ("c", "c: not registered in metadata")]
    totals = capacity.preview_totals(items).first()
    assert (totals["ready"], totals["total_gpus"], totals["estimated_gpu_hours"]) == (1, 8, 192.0)


def test_live_overlay(spark):
    state = spark.createDataFrame([("a", "submitted", "1", "2"), ("b", None, "3", None)], "exp_id string, status string, train_job_id string, eval_job_id string")
    queue = spark.createDataFrame([("1", "queued"), ("2", "RUNNING"), ("3", "odd")], "job_id string, state string")
    assert rows(jobs.live_overlay(state, jobs.job_ids(state), queue), "exp_id", "status") == [("a", "running"), ("b", "unknown")]


def test_record_sections_and_enrichers(spark):
    df = spark.createDataFrame([("E", "abc", 7, 0.1)], "exp_id string, commit string, train_job_id int, loss double")
    record = records.build_record(df, ["exp_id"], {"git": ["commit"], "slurm": ["train_job_id"], "training": ["loss"]}).first()
    assert record["git"]["commit"] == "abc" and record["slurm"]["train_job_id"] == 7 and record["stored_at"] is not None
    assert records.enrich(df) is df
    assert records.enrich(df, lambda d: d.withColumn("half", F.col("loss") / 2)).first()["half"] == 0.05
    plain = spark.createDataFrame([("L1", "law_agent")], "exp_id string, agent string")
    got = records.describe_architecture(plain).first()
    assert (got["phase"], got["architecture_name"], got["backbone_label"], got["effective_batch_size"]) == ("LAW", "LawAgent", "ResNet34", 32)


def test_analysis_failures_are_rows(spark):
    df = spark.createDataFrame([("Ok One", "c", "c", True), ("Bad", "c", "c", True), ("Lost", "c", None, True), ("Cfg", "c", "c", False)],
                               "name string, checkpoint string, resolved_checkpoint string, config_found boolean")

    def handler(row):
        if row["name"] == "Bad":
            raise RuntimeError("boom")
        return {"dir": row["output_dir"], "n": 1}

    result = analysis.run_handler(df, handler, "/out")
    got = {r["name"]: r for r in result.collect()}
    assert got["Ok One"]["metadata"] == {"dir": "/out/ok_one", "n": "1"} and got["Bad"]["error"] == "boom"
    assert got["Lost"]["error"] == "checkpoint not found" and got["Cfg"]["error"] == "exp_config could not be loaded"
    assert tuple(analysis.summarise(result).first()) == (4, 1, 3)
    assert analysis.metadata_keys(result, "name") == ["dir", "n"]
    with pytest.raises(Exception, match="cannot run"):
        analysis.run_handler(df, handler, "/out", skip_invalid=False).collect()
    with pytest.raises(ValueError):
        analysis.harvest(df, lambda d: d)


def test_registry_prerequisites(spark):
    reg = spark.createDataFrame([("a", "d/x.pth"), ("b", "d/*.pth"), ("c", "e/?.ckpt"), ("d", "d/zz.pth"), ("e", "d/x_%.pth*")], "value string, path string")
    files = spark.createDataFrame([("d/x.pth",), ("e/12.ckpt",)], "path string")
    assert rows(grids.missing_prerequisites(reg, files), "value") == [("c",), ("d",), ("e",)]
    deep = spark.createDataFrame([("a", "ck/*/best.pth"), ("b", "ck/**/best.pth"), ("c", "*/b/best.pth"), ("d", "ck/?/bes[t].pth"), ("e", "**/x.bin"),
                                  ("f", "ck/*.pth")], "value string, path string")
    there = spark.createDataFrame([("ck/a/best.pth",), ("ck/a/b/best.pth",), ("x.bin",)], "path string")
    assert rows(grids.missing_prerequisites(deep, there), "value") == [("c",), ("d",), ("f",)]


def _plain_glob(path):
    for glob, regex in (("**/", "\1"), ("**", "\2"), ("*", "[^/]*"), ("?", "[^/]"), ("\1", "(.*/)?"), ("\2", ".*")):
        path = path.replace(glob, regex)
    return re.compile(path)


def test_wildcards_equal_the_plain_patterns(spark):
    rng = random.Random(6)
    some = lambda parts, most: sorted({rng.choice(["", "", "/"]) + "/".join(rng.choices(parts, k=rng.randrange(1, most))) for _ in range(150)})
    files = some(["a", "ab", "b", "ba", ""], 5)
    globs = some(["a", "ab", "b", "c", "*", "a*", "?", "?b", "**", "**", "*a", "b**", ""], 5)
    reg = spark.createDataFrame([(g, g) for g in globs] + [("none", None)], "value string, path string")
    got = rows(grids.missing_prerequisites(reg, spark.createDataFrame([(f,) for f in files], "path string")), "value")
    assert got == sorted((g,) for g in globs if not any(_plain_glob(g).fullmatch(f) for f in files))
    assert rows(grids.missing_prerequisites(reg.limit(0), spark.createDataFrame([], "path string")), "value") == []


def test_spreadsheet_columns(spark):
    doc = {"phase": "P1", "exp_id": "E", "evaluation": {"all": {"pdm_score": 0.5}, "avg_nc": 0.9}}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    sheet = records.spreadsheet(df)
    row = sheet.first()
    assert len(sheet.columns) == 26 and (row["Phase"], row["ID"], row["Test_All"], row["NC"], row["TTC"]) == ("P1", "E", "0.5", "0.9", None)
    assert sheet._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_listed_first_and_project(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    assert [r["f"] for r in documents.listed_first(df, "f", ["c"]).collect()] == ["c", "a", "b"]


def test_rules_become_columns_with_their_failures(spark):
    df = spark.createDataFrame([(1, "a", {"x": "1"}), (None, "b", None), (3, "c", {"x": None})], "n int, made string, m map<string,string>")

    def rule(row):
        if row["made"] == "c":
            return {"twice": "six"}
        return {"twice": row["n"] and 2 * row["n"], "keys": sorted(row["m"] or {}), "made": row["made"] * 2}

    got = rules.with_rule(df, rule, ["n", "made", "m"], "twice bigint, keys array<string>, made string").orderBy(F.col("n").desc_nulls_last()).collect()
    assert [(r["n"], r["twice"], r["keys"], r["made"], r["rule_error"] is None) for r in got] == [
        (3, None, None, None, False), (1, 2, ["x"], "aa", True), (None, None, [], "bb", True)]
    assert rules.with_rule(df.limit(0), rule, ["n", "made", "m"], "twice bigint").collect() == []
    assert [r["rule_error"] is None for r in rules.with_rule(df, lambda row: 5, ["n"], "v int").collect()] == [False] * 3
    named = rules.name_points(df, lambda p: p["n"] and f"N{p['n']}", ["n"]).orderBy("made").collect()
    assert [(r["exp_id"], r["rule_error"] is None) for r in named] == [("N1", True), (None, False), ("N3", True)]
    flat = spark.createDataFrame([(4,)], "eval_workers int")
    advised = rules.recommend_resources(flat, lambda c: {"workers": c["eval_workers"], "mem": "8G"}).first()
    assert (advised["workers"], advised["mem"], advised["time"], advised["rule_error"]) == (4, "8G", None, None)
