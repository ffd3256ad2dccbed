"""Files, change log, exports and streams."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from runloom.operators import attempts
from runloom.session import shared_dir
from runloom.sources import changelog, documents, exports, external, keyed, readers
from runloom.streaming import follow, harvest, telemetry

yaml = pytest.importorskip("yaml")


def write(path, text, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if mtime:
        os.utime(path, (mtime, mtime))


def test_state_and_registry(spark, tmp_path):
    write(tmp_path / "s.json", '{"e1": {"status": "done", "results": {"x": 1}}, "e2": {"train_job_id": "7"}}')
    state = readers.state_columns(readers.read_state(spark, str(tmp_path)), {"status": "string", "train_job_id": "string"})
    assert sorted(map(tuple, state.collect()), key=str) == [("e1", "done", None), ("e2", None, "7")]
    write(tmp_path / "r" / "reg.json", '{"e": [{"path": "a", "epoch": 1, "metrics": {"val_loss": 0.5}}, {"path": "b"}]}')
    rows = readers.read_registry(spark, str(tmp_path / "r")).orderBy("pos").collect()
    assert [(r["pos"], r["path"], r["epoch"]) for r in rows] == [(0, "a", 1), (1, "b", None)]


def test_large_objects_are_read_at_their_members(spark, tmp_path):
    rng = random.Random(9)
    odd = ['a,"b', "{", "}]", "\\", '\\"', "\n,\n", "é,", "", "x"]
    value = lambda d: rng.choice([rng.randrange(99), None, True, rng.choice(odd), [] if d else [value(d + 1), value(d + 1)],
                                  {} if d else {rng.choice(odd): value(d + 1) for _ in range(3)}])
    want = []
    for i, indent in enumerate([None, 2, None, 0]):
        state = {f"{i}-{k}{rng.choice(odd)}": {"v": value(0), "s": rng.choice(odd), "n": k} for k in range(60)}
        write(tmp_path / f"s{i}.json", json.dumps(state, indent=indent, ensure_ascii=i < 2, separators=(",", ":") if i == 2 else None) + "\n" * (i % 2))
        want += [(k, e["s"], str(e["n"])) for k, e in state.items()]
    write(tmp_path / "empty.json", " { } ")
    write(tmp_path / "nothing.json", "")
    for name, text in (("cut", '{"a": {"n": 1}, "b": {"n"'), ("torn", '{"a": {"n": 1}, "b": "x'), ("bad", '{"a": {"n": 1}, "b": nope, "c": {}}'), ("list", '[1, {"a": 2}]')):
        write(tmp_path / f"{name}.json", text)
    small = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("97", "1000", small[0]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            state = readers.state_columns(readers.read_state(spark, str(tmp_path)), {"s": "string", "n": "string"})
            assert sorted(map(tuple, state.collect())) == sorted(want)
            splits = readers.read_log_lines(spark, str(tmp_path)).select("path", "start").distinct().count()
            assert size == small[0] or splits > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small[0])
        spark.conf.set("spark.sql.files.openCostInBytes", small[1])


def test_no_task_writes_a_whole_group_of_members(spark, monkeypatch):
    from workload import files

    monkeypatch.setattr(files, "OBJECT_ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("g"), F.floor(F.col("id") / 2).alias("k"))  # ids of both groups
    path = files.object_files(df, "objects", F.col("g"), F.col("k"), F.struct(F.col("k").alias("n")))
    written = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).collect()
    assert len(written) == 20
    keys = [k for r in written for k, _ in json.loads(r["value"], object_pairs_hook=list)]
    assert sorted(keys) == sorted([str(i // 2) for i in range(1000)] + ['all, {0"', 'all, {1"'])
    assert readers.read_state(spark, path).count() == 1002


def test_records_are_put_together_without_a_shuffle_of_the_pieces(spark, tmp_path):
    plans = []
    original = readers.written
    write(tmp_path / "a" / "r.csv", 'score,token\n1.5,"x\ny"\n2.5,plain\n')
    write(tmp_path / "s.json", '{"a": {"n": [1, 2]}, "b": {"n": 2}}')

    def kept(df, label, session):
        if label == "records":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, label, session)

    readers.written = kept
    try:
        assert readers.read_eval_rows_mixed(spark, str(tmp_path), ["score"], glob="*.csv").count() == 2
        assert readers.read_state(spark, str(tmp_path), glob="*.json").count() == 2
    finally:
        readers.written = original
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in plan for plan in plans)


@pytest.mark.parametrize("limit", [0, 100])
def test_records_of_many_splits_are_sorted_again(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(readers, "BROADCAST_SPLITS", limit)
    monkeypatch.setattr(readers, "BROADCAST_HEADERS", limit)
    for name in "abc":
        write(tmp_path / name / "r.csv", "score,token\n" + "".join(f'{k},"x{k}\ny"\n' for k in range(50)))
    rows = readers.read_eval_rows_mixed(spark, str(tmp_path), ["score"]).collect()
    assert sorted((r["dir_name"], r["score"], r["token"]) for r in rows) == sorted(
        (name, float(k), f"x{k}\ny") for name in "abc" for k in range(50))


def test_scope_folders_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "FOLDERS_PER_TASK", 10)
    rows = spark.range(100).select(F.col("id").alias("exp_id"), F.lit("all").alias("scope"), F.lit(1).alias("scenarios"),
                                   F.lit(0.5).alias("score"), F.lit("SUCCESS").alias("status"))
    exports.export_scopes(rows, str(tmp_path / "scopes"), metrics=[])
    parts = {re.search(r"part-(\d+)", name)[1] for _, _, names in os.walk(tmp_path / "scopes") for name in names if name.startswith("part-")}
    assert len(parts) > 5 and spark.read.option("header", "true").csv(str(tmp_path / "scopes")).count() == 100


def test_scope_folders_are_read_some_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FOLDERS_AT_ONCE", 7, raising=False)
    ids = [*(f"E{i}" for i in range(20)), "007", "7", "a/b c%2F", "x,{y}[z]*?=\\", "ü 日", None]
    rows = spark.createDataFrame([(i, s, n, 0.1 * n, "SUCCESS", None if n == 2 else n / 7) for i in ids for n, s in ((1, "boston"), (2, "ALL, \"x\""))],
                                 "exp_id string, scope string, scenarios int, score double, status string, NC double")
    exports.export_scopes(rows.unionByName(rows.filter("exp_id = 'E3'")), str(tmp_path / "scopes"), metrics=["NC"])
    indexes = []

    class Reader(type(spark.read)):
        def csv(self, path, *more, **options):
            indexes.append(len(path) if isinstance(path, list) else 0)
            return super().csv(path, *more, **options)

    monkeypatch.setattr(type(spark), "read", property(lambda self: Reader(self)))
    got = readers.read_scopes(spark, str(tmp_path / "scopes"), ["NC"])
    assert got.columns == ["exp_id", "City", "Scenarios", "PDMS", "NC", "Status"] and indexes == [7, 7, 7, 5]
    want = [(i, c, str(n), str(0.1 * n), None if n == 2 else str(n / 7), "SUCCESS") for i in [*ids, "E3"] for n, c in ((1, "Boston"), (2, "All, \"x\""))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_scope_folders_have_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "exp_id string, scope string, scenarios int, score double, status string")
    exports.export_scopes(rows, str(tmp_path / "scopes"), metrics=[])
    assert readers.read_scopes(spark, str(tmp_path / "scopes"), []).collect() == []


def test_configs_keep_odd_names(spark, tmp_path):
    write(tmp_path / "a+b #1.yaml", "lr: 0.1\ntags: [x, y]\n")
    write(tmp_path / "bad.yaml", "a: [1\n")
    got = {r["exp_id"]: r["lr"] for r in readers.read_configs(spark, str(tmp_path)).select(
        "exp_id", F.try_variant_get("config", "$.lr", "double").alias("lr")).collect()}
    assert got == {"a+b #1": 0.1, "bad": None}


def test_only_the_newest_csv_counts(spark, tmp_path):
    write(tmp_path / "E_eval_t_20260101_000000" / "old.csv", "token,score\nx,9\n", 1_000_000)
    write(tmp_path / "E_eval_t_20260101_000000" / "new.csv", "token,score\nx,1\ny,2\n", 2_000_000)
    write(tmp_path / "F_eval_t_20260101_000000" / "only.csv", "token,score\nz,3\n", 1_000_000)
    rows = readers.read_eval_rows(spark, str(tmp_path), "token string, score double").collect()
    assert sorted((r["dir_name"][0], r["score"]) for r in rows) == [("E", 1.0), ("E", 2.0), ("F", 3.0)]


def test_csvs_with_different_headers(spark, tmp_path):
    write(tmp_path / "a" / "r.csv", "score,token\n0.5,x\nbad,y\n")
    write(tmp_path / "b" / "r.csv", "token,extra,nc\nz,1,0.25\n")
    rows = readers.read_eval_rows_mixed(spark, str(tmp_path), ["score", "nc"]).fillna(-1.0).collect()
    assert sorted((r["dir_name"], r["token"], r["score"], r["nc"]) for r in rows) == [("a", "x", 0.5, -1.0), ("a", "y", -1.0, -1.0), ("b", "z", -1.0, 0.25)]


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_quoted_line_breaks_stay_in_their_values(spark, tmp_path, split):
    long = "\n".join(f'part {k}, "" it' for k in range(30))
    write(tmp_path / "a" / "r.csv", f'score,token\n1.5,"x\ny"\n2.5,plain\n3.5,"{long}"\n\n4.5,"say ""hi"", ok"\r\n')
    write(tmp_path / "b" / "r.csv", "token,extra,nc\nz,1,0.25\ntoken,extra,nc\n")
    write(tmp_path / "c" / "empty.csv", "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = readers.read_eval_rows_mixed(spark, str(tmp_path), ["score", "nc"])
        rows = sorted((r["dir_name"], r["token"], r["score"], r["nc"]) for r in df.fillna(-1.0).collect())
        assert df.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == sorted([("a", "x\ny", 1.5, -1.0), ("a", "plain", 2.5, -1.0), ("a", long.replace('""', '"'), 3.5, -1.0),
                           ("a", 'say "hi", ok', 4.5, -1.0), ("b", "z", -1.0, 0.25), ("b", "token", -1.0, -1.0)])
    assert readers.read_eval_rows_mixed(spark, str(tmp_path / "c"), ["score"]).count() == 0


def test_inventory_queue_telemetry(spark, tmp_path):
    write(tmp_path / "d 1" / "x.ckpt", "12345", 1_000_000)
    row = readers.list_files(spark, str(tmp_path), "*.ckpt").first()
    assert (row["dir_name"], row["file_name"], row["length"]) == ("d 1", "x.ckpt", 5)
    write(tmp_path / "q.txt", "1|R|n|gpu|1:00|2:00\n2|PD\n3|zz|n|gpu|0|1\n")
    assert [(r["job_id"], r["state"]) for r in readers.read_queue(spark, str(tmp_path / "q.txt")).collect()] == [("1", "running"), ("3", "zz")]
    write(tmp_path / "g.csv", "timestamp, name, utilization.gpu [%], utilization.memory [%], memory.used [MiB], memory.total [MiB]\n"
          "2026/01/02 03:04:05.678, NVIDIA X, 45 %, 3 %, 1024 MiB, 81559 MiB\n")
    row = readers.read_telemetry(spark, str(tmp_path / "g.csv")).first()
    assert (row["name"], row["util_gpu"], row["mem_total"], row["timestamp"].second) == ("NVIDIA X", 45.0, 81559.0, 5)


def test_analysis_definition(spark, tmp_path):
    write(tmp_path / "d.yaml", "pipeline_name: p\nexperiments:\n  - {name: A, exp_config: c.yaml, checkpoint: '*.ckpt'}\n  - {name: B}\n")
    rows = readers.read_analysis_definition(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["name"], r["error"]) for r in rows] == [("A", None), ("B", "missing: exp_config, checkpoint")]
    with pytest.raises(Exception, match="missing: exp_config"):
        readers.read_analysis_definition(spark, str(tmp_path), strict=True).collect()


def test_jdbc_options_are_checked():
    options = external.jdbc_options("jdbc:postgresql://h/db", "experiments", key_bounds=("id", 0, 100, 4))
    assert options["dbtable"] == "experiments" and options["numPartitions"] == "4"
    with pytest.raises(ValueError):
        external.jdbc_options("jdbc:x", "t; DROP TABLE x")


def test_change_log_equals_dict_updates(spark):
    rng = random.Random(3)
    log, docs, created = [], {}, {}
    for seq in range(400):
        key, op = rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.choice(["put", "patch", "patch", "delete"])
        doc = {rng.choice("xyz"): seq, "n": {"deep": seq}} if rng.random() < 0.8 else {}
        log.append((key, op, None if op == "delete" else str(doc).replace("'", '"'), seq, seq))
        if op == "delete":
            docs.pop(key, None), created.pop(key, None)
        else:
            docs[key] = dict(doc) if op == "put" else {**docs.get(key, {}), **doc}
            created.setdefault(key, seq)
    view = changelog.current_view(spark.createDataFrame(log, "key string, op string, doc string, seq int, ts int")).collect()
    assert {r["key"]: {k: eval(v) for k, v in r["doc"].items()} for r in view} == docs
    assert {r["key"]: r["created_at"] for r in view} == created


def test_documents_from_base_and_deltas_equal_dict_updates(spark, tmp_path):
    rng = random.Random(4)
    docs, created, updated, schema = {}, {}, {}, "key string, op string, doc string, seq int, ts int"
    table = documents.DocumentTable(spark, str(tmp_path / "docs"), time="int", buckets=8)
    assert table.current().count() == 0
    for part in range(4):
        log = []
        for seq in range(part * 100, part * 100 + 100):
            key, op = rng.choice(["hot", "hot", "a", "b", "c", f"k{rng.randrange(20)}"]), rng.choice(["put", "patch", "patch", "delete"])
            doc = {rng.choice("xyz"): seq, "n": {"deep": seq}} if rng.random() < 0.8 else {}
            log.append((key, op, None if op == "delete" else str(doc).replace("'", '"'), seq, seq))
            if op == "delete":
                docs.pop(key, None), created.pop(key, None), updated.pop(key, None)
            else:
                docs[key] = dict(doc) if op == "put" else {**docs.get(key, {}), **doc}
                created.setdefault(key, seq)
                updated[key] = seq
        rng.shuffle(log)
        table.apply(f"part-{part}", spark.createDataFrame(log, schema))
        if part == 1:  # a repeated commit changes nothing
            table.apply("part-1", spark.createDataFrame(log, schema))
        view = table.current().collect()
        assert {r["key"]: {k: eval(v) for k, v in r["doc"].items()} for r in view} == docs
        assert {r["key"]: (r["created_at"], r["updated_at"]) for r in view} == {k: (created[k], updated[k]) for k in docs}
    rewritten = table.apply("one", spark.createDataFrame([("hot", "put", '{"x": 1}', 999, 999), (None, "put", "{}", 1000, 1000)], schema))
    assert len(rewritten) == 1 and table.current().filter("key = 'hot'").first()["doc"] == {"x": "1"}
    assert table.current().count() == len({*docs, "hot"})
    table.apply("gone", spark.createDataFrame([(k, "delete", None, 2000, 2000) for k in {*docs, "hot"}], schema))
    assert table.current().count() == 0


def test_keyed_table_reads_only_wanted_buckets(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=16)
    rows = lambda items: spark.createDataFrame(items, "k string, v int")
    put = lambda before, delta: keyed.replaced(before, delta, ["k"])
    table.commit("1", rows([(f"k{i}", i) for i in range(50)] + [(None, 7)]), put)
    (bucket,) = table.commit("2", rows([("k3", 300)]), put)
    assert {r["k"]: r["v"] for r in table.rows().collect()} == {**{f"k{i}": i for i in range(50)}, None: 7, "k3": 300}
    read = table.rows([bucket])
    found = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert found and all(f"version=2/bucket={bucket}/" in f for f in found)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", read._jdf.queryExecution().executedPlan().toString())[1]
    assert "version" in filters and "bucket" in filters


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("e", "done", '{"m": {"a": 1}}')], "exp_id string, status string, doc string")
    assert exports.export_csv(df, str(tmp_path / "c"), ["exp_id", "m.a"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()[0].asDict() == {"exp_id": "e", "m.a": "1"}
    assert not exports.export_csv(df, str(tmp_path / "none"), ["exp_id"], {"status": "==x"}) and not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        exports.write_table(df, str(tmp_path / "x"), "xml")
    exports.write_grid(df, str(tmp_path / "g"), df)
    assert spark.read.schema("exp_id string").json(str(tmp_path / "g")).count() == 0
    more = df.unionByName(df.withColumn("exp_id", F.lit("other")))
    exports.write_grid(df.withColumn("status", F.lit("new")), str(tmp_path / "v2"), more, overwrite=True)
    grid = spark.read.schema("exp_id string, status string").json(str(tmp_path / "v2"))
    assert sorted(map(tuple, grid.collect())) == [("e", "new"), ("other", "done")]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def _runs(batch):
    return batch.groupBy("exp_id", "stamp").agg(F.avg("score").alias("avg_score")).withColumn("run_id", F.concat_ws("__", "exp_id", "stamp"))


def test_harvest_adds_only_new_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "runs")
    schema = "exp_id string, stamp string, score double"

    def go(progress):
        harvest.harvest(spark.readStream.schema(schema).parquet(source), _runs, out, str(tmp_path / progress))
        return sorted((r["run_id"], r["avg_score"]) for r in spark.read.parquet(out).collect())

    spark.createDataFrame([("E", "1", 0.5), ("E", "2", 0.7)], schema).write.parquet(source)
    first = go("p1")
    assert go("p1") == first and len(first) == 2
    spark.createDataFrame([("E", "2", 0.1), ("E", "3", 0.9)], schema).write.mode("append").parquet(source)
    want = sorted([*first, ("E__3", 0.9)])
    assert go("p1") == want
    # A query that lost its progress sees everything again and still adds nothing.
    assert go("p2") == want


def test_summaries_follow_the_runs(spark, tmp_path):
    schema = "exp_id string, run_id string, avg_score double, attempt_timestamp string, seq int, attempt_group_id string"
    source, runs, out = (str(tmp_path / n) for n in ("in", "runs", "sum"))

    def go():
        stream = spark.readStream.schema(schema).parquet(source)
        harvest.materialise_summaries(stream, runs, out, str(tmp_path / "p"))
        current = harvest.current_summaries(spark.read.parquet(out))
        whole = attempts.build_summaries(spark.read.schema(schema).parquet(source))
        columns = whole.columns
        assert sorted(map(tuple, current.select(*columns).collect())) == sorted(map(tuple, whole.collect()))

    spark.createDataFrame([("E", "r1", 0.5, "1", 1, "g"), ("F", "r2", 0.4, "1", 2, "h")], schema).write.parquet(source)
    go()
    spark.createDataFrame([("E", "r3", 0.9, "2", 3, "g")], schema).write.mode("append").parquet(source)
    go()
    go()


def test_runs_do_not_depend_on_the_arrival_of_their_directories(spark, tmp_path):
    schema, source = harvest.DIRECTORIES, str(tmp_path / "in")
    row = lambda exp, stamp, scope, score, n: (exp, stamp, scope, f"{exp}_eval_t_{scope}_{stamp}", None, score, n)
    batches = [[row("E", "1", "a", 0.5, 10), row("F", "1", "a", 0.3, 5)], [row("E", "1", "b", 0.9, 30)],
               [row("E", "2", "a", 0.1, 1), row("E", "1", "a", 0.7, 20), row("E", "2", "a", 0.1, 1)]]

    def go(progress):
        stream = spark.readStream.schema(schema).parquet(source)
        harvest.harvest_directories(stream, lambda batch: batch, str(tmp_path / "out"), str(tmp_path / progress))
        return {(r["exp_id"], r["stamp"]): (round(r["avg_score"], 6), r["total_scenarios"]) for r in harvest.harvested_runs(spark, str(tmp_path / "out")).collect()}

    want = [{("E", "1"): (0.5, 10), ("F", "1"): (0.3, 5)}, {("E", "1"): (0.7, 40), ("F", "1"): (0.3, 5)},
            {("E", "1"): (0.8, 50), ("F", "1"): (0.3, 5), ("E", "2"): (0.1, 1)}]
    for rows, runs in zip(batches, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        assert go("p") == runs
    assert go("p") == want[-1]


def test_folded_summaries_equal_those_of_all_runs(spark, tmp_path):
    rng = random.Random(1)
    schema = "exp_id string, run_id string, avg_score double, attempt_timestamp string, seq int, attempt_group_id string"
    source, out = str(tmp_path / "in"), str(tmp_path / "sum")
    for part in range(3):
        rows = [(f"E{g}", f"r{part}-{i}", rng.choice([None, -1.0, 0.0, 1e6 + rng.random()]), rng.choice([None, "1", "2"]), part * 100 + i, f"g{g}" if g else None)
                for i in range(40) for g in [rng.randrange(6)]]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        harvest.fold_summaries(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "p"))
    got = {r["attempt_group_id"]: r.asDict() for r in harvest.folded_summaries(spark, out, seq="int").collect()}
    want = {r["attempt_group_id"]: r.asDict() for r in attempts.build_summaries(spark.read.schema(schema).parquet(source)).collect()}
    assert got.keys() == want.keys()
    for group, row in want.items():
        assert got[group] == {k: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for k, v in row.items()}


def test_follow_sees_new_files(spark, tmp_path):
    write(tmp_path / "logs" / "a.out", "one\ntwo\n")

    def go():
        follow.drain(follow.follow_lines(spark, str(tmp_path / "logs"), "*.out"), str(tmp_path / "t"), str(tmp_path / "p"))
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "t")).collect())

    assert go() == ["one", "two"]
    time.sleep(1.1)
    write(tmp_path / "logs" / "b.out", "three\n")
    assert go() == ["one", "three", "two"]


def test_closed_windows_equal_the_batch(spark, tmp_path):
    rows = [(f"2026-01-01 00:{m:02d}:30", "g0", float(m)) for m in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "t string, gpu string, util double").select(F.to_timestamp("t").alias("ts"), "gpu", "util")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    telemetry.append_windows(telemetry.windowed(stream, "ts", "gpu", "util", "10 minutes", "1 minute"), str(tmp_path / "o"), str(tmp_path / "p"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    batch = {tuple(r) for r in telemetry.windowed(df, "ts", "gpu", "util", "10 minutes").collect()}
    assert got < batch and len(batch - got) == 1


def test_log_lines_equal_whole_logs(spark, tmp_path):
    from runloom.operators import logs

    draw = random.Random(5)
    said = ["PDMS: 0.5", "PDMS: 1.2.3", "final_score = 0.75", "Final average score of valid results: 0.25", "Status: SUCCESS", "Status:  FAILED",
            "Number of successful scenarios: 12.", "scenarios_evaluated=7", "", "noise é", "Epoch 3: train_loss=1.5", "epoch 9 loss: 0.5 Epoch 11 loss=.25",
            "val_loss=2.5", "validation: 3.", "Epoch 4 val"]
    for i in range(40):
        write(tmp_path / f"{i}.log", "\n".join(draw.choices(said, k=draw.randint(1, 12))) + draw.choice(["", "\n"]))
    write(tmp_path / "empty.log", "")
    write(tmp_path / "big.log", "start\n" + "x" * 50 + "\n" + "filler line\n" * 20_000 + "PDMS: 0.125\nStatus: SUCCESS\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        whole, lines = readers.read_logs(spark, str(tmp_path)), readers.read_log_lines(spark, str(tmp_path))
        assert lines.filter("path LIKE '%big.log'").select("start").distinct().count() > 5
        columns = ["path", "score", "scenarios", "status"]
        got = logs.parsed_lines(lines, logs=whole).select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.parsed(whole).select(columns).collect()))
        columns = ["path", "epochs", "train_loss", "val_loss"]
        got = logs.parsed_training_lines(lines, logs=whole).select(columns)
        # a loss on a line behind its "Epoch" belongs to no match within a line
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.parsed_training(whole).select(columns).collect()))
        columns = ["path", "line_no", "line"]
        want = [r for r in logs.tail_lines(whole, 4).select(columns).collect() if not r["path"].endswith("empty.log")]
        assert sorted(map(tuple, logs.tail_of_lines(lines, 4).select(columns).collect())) == sorted(map(tuple, want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert logs.parsed_lines(lines.limit(0)).collect() == [] and logs.tail_of_lines(lines.limit(0), 2).collect() == []


def test_analysis_export_has_every_key_once(spark, tmp_path):
    schema = "name string, success boolean, checkpoint_path string, output_dir string, error string, metadata map<string,string>"
    results = spark.createDataFrame([("b", True, "c", "o", None, {"z": "1", "a": "2"}), ("c", False, "c", "", "bad, \"x\"", {}),
                                     ("d", True, "c", "o", None, {"k": "3", "z": "4"}), ("e", True, "c", "o", None, None)], schema)
    keys = exports.export_analysis(results, str(tmp_path / "csv"))
    assert set(keys[:2]) == {"z", "a"} and keys[2:] == ["k"]
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).orderBy("name").collect()
    assert [(r["name"], r["z"], r["a"], r["k"]) for r in back] == [("b", "1", "2", None), ("c", None, None, None), ("d", "4", None, "3"), ("e", None, None, None)]
    assert exports.export_analysis(results, str(tmp_path / "json"), "json") == keys
    assert spark.read.json(str(tmp_path / "json")).filter("metadata.k = '3'").count() == 1
    assert exports.export_analysis(results.limit(0), str(tmp_path / "none")) == []
