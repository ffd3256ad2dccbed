"""Name, identifier and duration expressions."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.functions import ids, labels, merging
from runloom.functions import names as N
from runloom.functions import resources as Q
from runloom.operators import jobs as J


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, wanted", [
    ("B1_eval_navtest_boston_20260101_120000_77", ("B1", "navtest", "boston", "20260101_120000", "77")),
    ("B1_eval_navtest_20260101_120000_77", ("B1", "navtest", None, "20260101_120000", "77")),
    ("B1_eval_navtest_boston_20260101_120000", ("B1", "navtest", "boston", "20260101_120000", None)),
    ("B1_eval_navtest_boston_20260101", ("B1", "navtest", "boston", None, None)),
    ("B1-run", ("B1-run", None, None, None, None)), ("a_eval_b_eval_c", ("a_eval_b_eval_c", None, None, None, None)),
])
def test_eval_dir(spark, name, wanted):
    assert tuple(one(spark, N.parse_eval_dir(F.lit(name), ["boston", "vegas"]))) == wanted


@pytest.mark.parametrize("name, base, dated", [
    ("B13_20260124_014707", "B13", True), ("exp_a10_x_100pct_20251127_100715", "exp_a10_x_100pct", True),
    ("B13_20260230_014707", "B13_20260230_014707", False), ("plain", "plain", False), ("B13_2026012_014707", "B13_2026012_014707", False)])
def test_base_name(spark, name, base, dated):
    row = one(spark, N.base_and_stamp(F.lit(name)))
    assert (row["base"], row["stamp"] is not None) == (base, dated)


def test_scope_needs_boundaries(spark):
    for name, scope in [("smallest_run", "all"), ("x_Vegas-1", "vegas"), ("exp-las-vegas_1", "vegas"), ("boston", "boston"), ("bostonian", "all")]:
        assert one(spark, N.scope_label(F.lit(name), ["boston", "vegas"])) == scope


@pytest.mark.parametrize("path, style, number", [
    ("a/epoch=42-step=100.ckpt", "resolver", 42), ("a/epoch5_epoch=7.ckpt", "resolver", 7), ("a/ep3.pt", "resolver", 3), ("a/x.pt", "resolver", -1),
    ("a/checkpoint_12.pth", "core", 12), ("a/EPOCH_4.pth", "core", 4), ("a/epoch=4.pth", "core", None), ("a/epoch=4.pth", "lightning", 4),
    ("a/model_step-9.pt", "step", 9), ("a.epoch9/model.v7.pt", "resolver", -1), ("epoch_1/.ckpt", "resolver", -1)])
def test_number_in_name(spark, path, style, number):
    assert one(spark, N.number_in_name(F.lit(path), style, None if style in ("core", "lightning") else -1)) == number


def test_stem(spark):
    for path, stem in [("a/b.c/x.tar.gz", "x.tar"), ("a/.ckpt", ".ckpt"), ("noext", "noext")]:
        assert one(spark, N.file_stem(F.lit(path))) == stem


@pytest.mark.parametrize("text, hours", [
    ("1-02:30:00", 26.5), ("48:00:00", 48.0), ("30:00", 0.5), ("90", 1.5), ("", 0.0), (None, 0.0), ("soon", 0.0), ("1:2:3:4", 0.0), ("2-12", 60.0), ("2-12:30", 60.5)])
def test_durations(spark, text, hours):
    assert one(spark, Q.duration_hours(F.lit(text).cast("string"))) == pytest.approx(hours)


def test_job_states(spark):
    codes = ["R", "RUNNING", "PD", "COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "OUT_OF_MEMORY", "??"]
    states = ["running", "running", "queued", "completed", "failed", "cancelled", "failed", "failed", "unknown"]
    assert [one(spark, Q.job_state(F.lit(c))) for c in codes] == states


def test_eval_resources(spark):
    none = F.lit(None)
    assert tuple(one(spark, Q.eval_resources(F.lit(16), F.lit("200G"), F.lit("08:00:00")))) == (16, "200G", "08:00:00")
    assert one(spark, Q.eval_resources(F.lit(64), none.cast("string"), none.cast("string")))["mem"] == "200G"
    assert tuple(one(spark, Q.eval_resources(none, F.lit(""), F.lit("")))) == (32, "160G", "06:00:00")


def test_batch_split(spark):
    assert tuple(one(spark, Q.batch_split(F.lit(192), F.lit(4)))) == (48, 1)
    assert tuple(one(spark, Q.batch_split(F.lit(192), F.lit(1)))) == (48, 4)
    assert tuple(one(spark, Q.batch_split(F.lit(100), F.lit(3), 10))) == (10, 4)


def test_group_and_batch_ids(spark):
    first = one(spark, ids.attempt_group_id(F.lit("E1"), [F.lit("/ck"), F.lit(None)]))
    assert first == one(spark, ids.attempt_group_id(F.lit("E1"), [F.lit("/ck"), F.lit("")]))
    assert first.startswith("ag__") and len(first) == 20
    assert first != one(spark, ids.attempt_group_id(F.lit("E2"), [F.lit("/ck"), F.lit(None)]))
    none = F.lit(None).cast("string")
    for jobs in ([12, 11, 13], [13, 12, 11]):
        assert one(spark, ids.eval_batch_id(F.array(*map(F.lit, jobs)), none, none)) == "batch__11_12_13"
    assert one(spark, ids.eval_batch_id(F.lit(None).cast("array<int>"), F.lit("t"), F.lit("9"))) == "batch__t_9"


def test_slug(spark):
    for text, slug in [("I-JEPA ViT-H/14", "i_jepa_vit_h_14"), ("Ünïcode – Näme!", "unicode_name"), ("***", "experiment"), ("a__b", "a__b")]:
        assert one(spark, N.slug(F.lit(text))) == slug


def test_display_stamp(spark):
    assert one(spark, N.display_stamp(F.lit("20260124_014707"))) == "2026-01-24 01:47"
    assert one(spark, N.display_stamp(F.lit("odd"))) == "odd" and one(spark, N.display_stamp(F.lit(""))) == "-"


def test_override(spark):
    base, over = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"))
    assert one(spark, merging.override_map(base, over)) == {"a": "1", "b": "3", "c": "4"}
    assert one(spark, merging.override_map(F.lit(None).cast("map<string,string>"), over)) == {"b": "3", "c": "4"}


def test_phase_rules(spark):
    for exp, given, wanted in [("A1", None, "BASELINES"), ("exp_b3", "UNKNOWN", "PHASE_1"), ("L2", "MINE", "MINE"), ("zz", None, "UNKNOWN"), ("zz", "", "")]:
        assert one(spark, labels.phase(F.lit(exp), F.lit(given).cast("string"))) == wanted


def _strict(name, exp):
    return name == exp or name.startswith(exp + "_") or name.endswith("_" + exp) or f"_{exp}_" in name


def test_strict_join_equals_the_pairwise_rule(spark):
    rng = random.Random(1)
    parts = ["A3", "b", "A3-b", "", "eval", "x"]
    names = sorted({"_".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(120)})
    exps = sorted({"_".join(rng.choices(parts, k=rng.randrange(1, 3))) for _ in range(30)} - {""})
    got = J.dirs_by_id(spark.createDataFrame([(n,) for n in names], "dir_name string"), spark.createDataFrame([(e,) for e in exps], "exp_id string"))
    assert {(r["dir_name"], r["exp_id"]) for r in got.collect()} == {(n, e) for n in names for e in exps if _strict(n, e)}


def test_strict_join_keeps_columns_and_repeated_rows(spark):
    rng = random.Random(3)
    exps = [("_".join(rng.choices(["g1", "g2", "h1", "h2", "seed"], k=rng.randrange(1, 4))), i) for i in range(40)] + [(None, -1)]
    names = [("_".join(["eval", *rng.choices(["g1", "g2", "h1", "h2", "seed"], k=rng.randrange(0, 6))]), i, "old") for i in range(60)] + [(None, -1, "")]
    dirs = spark.createDataFrame(names, "dir_name string, n long, exp_id string")
    got = J.dirs_by_id(dirs, spark.createDataFrame(exps, "exp_id string, m long"))
    assert got.columns == ["exp_id", "dir_name", "n", "m"]
    assert sorted(map(tuple, got.collect())) == sorted((e, d, n, m) for d, n, _ in names[:-1] for e, m in exps[:-1] if _strict(d, e))
    anchors = J.anchored(spark.createDataFrame([("a_x",), ("a_y",), ("a_y_b",), ("y",)], "exp_id string"))
    assert {r["exp_id"]: r["_anchor"] for r in anchors.collect()} == {"a_x": "x", "a_y": "a", "a_y_b": "b", "y": "y"}


def test_job_name_join_equals_the_pairwise_rule(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choices("ab_-.", k=rng.randrange(1, 7))) for _ in range(150)})
    exps = sorted({"".join(rng.choices("ab_-", k=rng.randrange(1, 4))) for _ in range(40)})
    got = J.jobs_by_name(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(e,) for e in exps], "exp_id string"))
    want = {(n, e) for n in names for e in exps if n == e or (n.startswith(e) and n[len(e)] in "_-.")}
    assert {(r["name"], r["exp_id"]) for r in got.collect()} == want


def test_substitution(spark):
    got = one(spark, N.substitute_vars(F.lit("${a}/${b}/${c}"), {"a": "/x", "b": F.lit(3), "c": F.lit(None).cast("string")}))
    assert got == "/x/3/${c}"


def test_slug_folds_letters_and_ligatures(spark):
    df = spark.createDataFrame([("ﬁne ＡB ǆ",), ("Ünï - x",), ("日本",), ("plain Name",)], "t string")
    assert [r[0] for r in df.select(N.slug(F.col("t"))).collect()] == ["fine_ab_dz", "uni_x", "experiment", "plain_name"]
