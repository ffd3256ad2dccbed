"""Field paths, the filter language and skew-safe ordering against plain Python."""

import json
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.operators import documents as D
from runloom.plans.filters import condition, matches
from runloom.plans.ordering import exact_median, ordered_position, time_blocks, top_per_group
from runloom.plans.paths import field, numeric_field, safe_identifier, with_parsed

DOCS = [
    {"status": "completed", "metrics": {"acc": 0.9, "n": 3}, "ok": True, "slurm": {"partition": "l40s_public"}, "created_at": "2026-01-01T10:00:00"},
    {"status": "not_completed", "metrics": {"acc": 0.5}, "ok": False, "created_at": "2026-01-02T10:00:00"},
    {"status": "Failed", "metrics": {"acc": "0.7"}, "created_at": "bad"},
    {"metrics": None, "status": None},
    {"status": "running", "metrics": {"acc": 0.9}, "created_at": "2026-01-03T10:00:00"},
]


@pytest.fixture(params=["text", "variant"])
def docs(spark, request):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "key int, doc string")
    return rows if request.param == "text" else rows.withColumn("doc", F.parse_json("doc"))


def keys(df):
    return sorted(r["key"] for r in df.collect())


@pytest.mark.parametrize("filters, wanted", [
    ({"status": "completed"}, [0, 1]), ({"status": "==completed"}, [0]), ({"metrics.acc": ">0.6"}, [0, 4]),
    ({"metrics.acc": ">=0.5"}, [0, 1, 4]), ({"metrics.acc": "<0.9"}, [1]), ({"metrics.acc": "<=0.9", "status": "RUN"}, [4]),
    ({"metrics.acc": 0.9}, [0, 4]), ({"metrics.n": 3}, [0]), ({"ok": False}, [1]), ({"slurm.partition": "L40S"}, [0]),
    ({"absent.path": "x"}, []), ({}, [0, 1, 2, 3, 4]),
])
def test_filter_language(docs, filters, wanted):
    assert keys(D.query(docs, filters)) == wanted


def test_text_is_literal_not_a_pattern(spark):
    df = spark.createDataFrame([(1, "a.b%c"), (2, "axbyc")], "key int, name string")
    assert keys(D.query(df, {"name": "a.b%"})) == [1]


def test_exact_status(docs):
    assert keys(D.search(docs.withColumn("created_at", F.lit(None).cast("string")), status="completed", exact=True)) == [0]


def test_search_dates_and_bounds(spark):
    df = spark.createDataFrame([(i, json.dumps(d), d.get("created_at")) for i, d in enumerate(DOCS)], "key int, doc string, created_at string")
    hits = D.search(df, min_metric={"metrics.acc": 0.5}, created_after="2026-01-02", created_before="2026-01-03T10:00:00")
    assert keys(hits) == [1, 4]


def test_unsafe_paths_are_rejected_before_a_job(spark, docs):
    assert safe_identifier("table_name") == "table_name"
    for bad in ["users; DROP TABLE x", "0starts_with_digit", "", "a" * 64, "a\n"]:
        with pytest.raises(ValueError):
            safe_identifier(bad)
    with pytest.raises(ValueError):
        matches(docs, {"users; DROP TABLE x": "completed"})


def test_promoted_column_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i}", i * 1.0) for i in range(10)], "key int, status string, score double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = D.query(df, {"status": "==s3", "score": ">=2"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,s3)" in plan and "GreaterThanOrEqual(score,2.0)" in plan


def test_struct_and_map_paths(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(2).alias("c")).alias("b")).alias("a"), F.create_map(F.lit("k"), F.lit(1.5)).alias("m"))
    row = df.select(field(df, "a.b.c", "bigint").alias("x"), numeric_field(df, "m.k").alias("y"), field(df, "a.z").alias("z")).first()
    assert tuple(row) == (2, 1.5, None)


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 10]], "v double").withColumn("one", F.when(F.col("v") == 1, 5.0))
    rows = {r["metric"]: r for r in D.metric_statistics(df, ["v", "one", "none"]).collect()}
    assert set(rows) == {"v", "one"}
    assert rows["v"]["median"] == 2.5 and rows["v"]["count"] == 4
    assert rows["v"]["stdev"] == pytest.approx(statistics.stdev([3, 1, 2, 10]))
    assert rows["one"]["stdev"] == 0.0


def test_compare_keeps_the_requested_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, v int")
    got = D.compare(df, D.request_list(df, ["c", "zz", "a"], "key"), "key").collect()
    assert [r["key"] for r in got] == ["c", "a"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, 1e-300, 1e300])), min_size=1, max_size=60), st.sampled_from([100, 20_000]))
def test_median_is_exact(spark, values, accuracy):
    df = spark.createDataFrame([(v, "g") for v in values], "v double, g string")
    got = exact_median(df, ["g"], "v", accuracy=accuracy).first()["median"]
    assert got == pytest.approx(statistics.median(values))


def test_median_with_a_dominant_value_and_group(spark):
    rows = [("hot", 7.0)] * 3000 + [("hot", float(i)) for i in range(2000)] + [("cold", 1.0), ("cold", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v", accuracy=500).collect()}
    assert got == {"hot": statistics.median(v for g, v in rows if g == "hot"), "cold": 1.5}


def test_median_brackets_go_to_the_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("v"))
        got = exact_median(df, ["g"], "v", accuracy=500)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r["g"]: r["median"] for r in got.collect()} == {0: 499.5, 1: 499.0, 2: 500.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_positions_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}",
             None if rng.random() < 0.3 else f"2026010{rng.randrange(1, 4)}_12000{rng.randrange(3)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t string, seq int")
    order = [F.coalesce("t", F.lit("")), F.col("seq")]
    got = ordered_position(df, ["g"], order, time_blocks("t", "seq", 64), "p").collect()
    groups = {}
    for g, t, seq in rows:
        groups.setdefault(g, []).append((t or "", seq))
    want = {(g, seq): i + 1 for g, members in groups.items() for i, (_, seq) in enumerate(sorted(members))}
    assert {(r["g"], r["seq"]): r["p"] for r in got} == want


def test_top_beyond_the_pushed_limit(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), "id")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        blocks = [("range", F.floor(F.col("id") / 100))]
        assert top_per_group(df, ["g"], [F.col("id")], 1500, blocks).count() == 1500
        found = top_per_group(df, ["g"], [F.col("id").desc()], 1500)
        assert found.agg(F.min("id"), F.count("*")).first() == (3500, 1500)
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = top_per_group(df, ["g"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_positions_with_null_keys(spark):
    rows = [("a", None, 1), ("a", 5, 2), (None, 7, 3), (None, None, 4), ("a", 900, 5)]
    df = spark.createDataFrame(rows, "g string, step int, id int")
    got = ordered_position(df, ["g"], [F.col("step"), F.col("id")], [("range", F.floor(F.col("step") / 100))], "p").collect()
    assert {r["id"]: r["p"] for r in got} == {1: 1, 2: 2, 5: 3, 4: 1, 3: 2}


def test_text_conditions_match_text_only(spark):
    df = spark.createDataFrame([(1, 12000.0, True, '{"n": 3, "s": "3"}')], "key int, total double, flag boolean, doc string")
    for wanted in ({"total": "12"}, {"n": "==3"}, {"flag": "tru"}, {"n": "3"}):
        assert D.query(df, wanted).count() == 0
    assert D.query(df, {"s": "==3"}).count() == 1


def test_conditions_on_json_text_share_one_parse(spark):
    docs = [
        {"name": "Run A", "n": 5, "m": {"score": 0.5, "tag": "7"}, "ok": True},
        {"name": "run b", "n": "5", "m": {"score": 0.9, "tag": 7}, "ok": "true"},
        {"name": 3, "n": 6.5, "m": {"score": "0.9"}, "ok": False},
        {"name": "RUN", "n": 6, "m": 4},
        {},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(5, None), (6, "{bad")], "k int, doc string")

    def hits(filters, **how):
        shared = matches(df, filters, **how)
        apart = df
        for path, wanted in filters.items():  # the same conditions one after another
            apart = apart.filter(condition(df, path, wanted, **how))
        got = sorted(r["k"] for r in df.filter(shared).collect())
        assert got == sorted(r["k"] for r in apart.collect())
        return got

    assert hits({"name": "run", "n": ">=5"}) == [0, 3]
    assert hits({"n": 5, "m.score": "<0.8"}) == [0]
    assert hits({"ok": True, "n": ">1"}) == [0]
    assert hits({"m.tag": "7", "name": "run"}) == [0]
    assert hits({"name": "Run A", "m.tag": "==7"}, exact=True) == [0]
    assert hits({"m": ">3", "m.score": ">0.1"}) == [] and hits({"m": ">3", "n": ">3"}) == [3]
    assert hits({"k": 1, "m.score": ">0.1", "name": "b"}) == [1]
    plan = df.filter(matches(df, {"name": "run", "n": ">=5", "m.score": ">0"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_parsed_paths_equal_single_ones(spark):
    docs = ['{"a": {"b": 1.50, "c": [1, 2]}, "t": "x", "z": null}', '{"a": "flat", "t": 1e-7}', '{"a": {"b": {"d": 1}}}', "[]", "", None]
    df = spark.createDataFrame([(d, "col") for d in docs], "doc string, own string")
    paths = ["a", "a.b", "a.c", "t", "z", "own", "none"]
    parsed, value = with_parsed(df, paths)
    assert parsed.select(*[value(p) for p in ("a.b", "a.c", "t", "z", "own", "none")]).collect() == df.select(
        *[field(df, p) for p in ("a.b", "a.c", "t", "z", "own", "none")]).collect()
