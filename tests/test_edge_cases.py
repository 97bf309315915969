"""Cases outside the fixture: missing values, reordered headers, constant and
wide inputs, late files, long dictionaries, wrong configs."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF_SMALL
from tidemark.functions import scalar as sc
from tidemark.operators import contract as ct
from tidemark.operators import drift as dr
from tidemark.operators import encoders as enc
from tidemark.operators import metrics
from tidemark.operators import reshape as rs
from tidemark.operators import schema as sch
from tidemark.operators import splits
from tidemark.operators import weights as wt
from tidemark.plans import config as cf
from tidemark.plans import models as md
from tidemark.session import remove_scratch, scratch_path
from tidemark.sources import fixtures as fx
from tidemark.sources.tables import read_csv_table, read_table
from tidemark.streaming.monitor import run_monitor

NAN = float("nan")


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_clip_keeps_missing_and_nan(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (0.4,), (7.0,), (NAN,)], "x double").coalesce(1)
    got = values(df, sc.clip("x", 0.0, 1.0))
    assert got[:4] == [None, 0.0, 0.4, 1.0] and math.isnan(got[4])
    z = values(df.filter("x is null or x < 5"), sc.standardize(df.filter("x < 5"), "x"))
    assert z[0] is None and all(-10 <= v <= 10 for v in z[1:])


def test_ratio_of_text_is_missing_not_an_error(spark):
    df = spark.createDataFrame([("a", "2"), ("3", "x"), ("3", "2"), (None, "1")], "a string, b string").coalesce(1)
    assert values(df, sc.safe_divide("a", "b")) == [None, None, 1.5, None]


def test_weights_reject_missing_days_and_probabilities(spark):
    df = spark.createDataFrame([(1, "2000-01-01"), (2, None)], "front_id int, d string").withColumn("d", F.col("d").cast("date"))
    assert None in values(df, wt.exponential_recency(df, "d")) and None in values(df, wt.recent_boost("d", "2000-01-01"))
    for strategy in ({"strategy": "exponential_recency"}, {"strategy": "linear_recency"}, {"strategy": "recent_period_boost", "cutoff": "1999-01-01"}):
        with pytest.raises(ValueError, match="missing"):
            wt.sample_weights(df, "d", {"enabled": True, **strategy})
    p = spark.createDataFrame([(0.2,), (None,)], "p double")
    assert None in values(p, wt.density_ratio(F.col("p")))
    with pytest.raises(Exception, match="probability is missing"):
        wt.density_ratio_weights(p, "p").collect()
    ok = wt.density_ratio_weights(p.dropna(), "p").first()
    assert ok["sample_weight"] == 1.0


def test_csv_columns_are_found_by_name(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    (tmp_path / "x.csv").write_text("b,a\n1,2\n,5\n")
    assert sorted(map(tuple, read_csv_table(spark, str(tmp_path / "x.csv"), schema).collect()), key=str) == [(2, 1), (5, None)]
    (tmp_path / "y.csv").write_text("a,b\n7,8\n")
    with pytest.raises(Exception):  # noqa: B017 - a second file with another header
        read_csv_table(spark, str(tmp_path), schema).collect()
    (tmp_path / "z.csv").write_text("a,b\nseven,8\n")
    with pytest.raises(Exception):  # noqa: B017 - text that is no number
        read_csv_table(spark, str(tmp_path / "z.csv"), schema).collect()
    with pytest.raises(Exception):  # noqa: B017 - a declared column is not there
        read_csv_table(spark, str(tmp_path / "x.csv"), schema.add("c", T.IntegerType())).collect()


def test_duplicates_with_missing_order_values(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 5, "y"), (1, None, "z"), (2, 1, "w")], "k int, o int, v string")
    got = {r.v: (r.n_copies, r.after_first) for r in rs.duplicate_members(df, ["k"], ["o", "v"]).collect()}
    assert got == {"y": (3, False), "x": (3, True), "z": (3, True)}


def test_target_encoding_defaults_and_no_smoothing(spark):
    rows = [(i, "abc"[i % 3], int(i % 4 == 0)) for i in range(60)] + [(60, "solo", 1), (61, None, 0)]
    fit = spark.createDataFrame(rows, "id int, c string, y int")
    new = spark.createDataFrame([(100, "a"), (101, "never"), (102, None)], "id int, c string")
    prior = sum(r[2] for r in rows) / len(rows)
    for smoothing in (0.0, 20.0):
        a, b = enc.foldsafe_target_encoding(fit, new, ["c"], "y", smoothing=smoothing)
        te = {r.id: r.c__foldsafe_te for r in a.collect()}
        assert len(te) == 62 and all(v is not None for v in te.values()) and math.isclose(te[60], prior)
        out = {r.id: r.c__foldsafe_te for r in b.collect()}
        assert math.isclose(out[101], prior) and math.isclose(out[102], prior)
        if not smoothing:
            own = [r[2] for r in rows if r[1] == "a"]
            assert math.isclose(out[100], sum(own) / len(own))
    again = enc.foldsafe_target_encoding(fit.repartition(5), None, ["c"], "y")[0].collect()
    assert {r.id: r.c__foldsafe_te for r in again} == {r.id: r.c__foldsafe_te for r in enc.foldsafe_target_encoding(fit, None, ["c"], "y")[0].collect()}


def test_histogram_of_a_constant_column(spark):
    df = spark.createDataFrame([(0, 2.0)] * 5 + [(1, 2.0)] * 3, "side int, x double")
    assert sorted(map(tuple, dr.density_histogram(df, "x", "side", 10).collect())) == [(0, 0, 5), (1, 0, 3)]


def test_all_present_columns_and_the_target_stay(spark):
    df = spark.range(40).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(25)], F.when(F.col("id") > 30, 1).alias("rare"), (F.col("id") % 2).alias("y"))
    assert dr.present_columns(df, [*[f"c{i}" for i in range(25)], "rare", "y"], 0.5, "y") == [*[f"c{i}" for i in range(25)], "y"]


def test_monitor_counts_events_of_late_files(spark, tmp_path):
    """Files that arrive newest day first: every event is counted."""
    ev = read_table(spark, SF_SMALL, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    days = sorted({r[0] for r in ev.select(F.to_date("ts")).distinct().collect()}, reverse=True)
    src = tmp_path / "events"
    third = len(days) // 3
    for part in (days[:third], days[third : 2 * third], days[2 * third :]):
        ev.filter(F.to_date("ts").isin(part)).coalesce(1).write.mode("append").parquet(str(src))
    got = run_monitor(spark, f"{src}/", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = ev.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    key = lambda df: sorted((r["day"], r["event_type"], r["n_events"]) for r in df.collect())
    assert key(got) == key(want) and sum(x[2] for x in key(got)) == ev.count()


@pytest.mark.parametrize("categories", [83, 5000])
def test_models_take_long_dictionaries(spark, categories):
    df = spark.range(12_000).select(F.col("id").alias("front_id"), F.concat(F.lit("v"), F.col("id") % categories).alias("c"),
                                    (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 > 9).cast("int").alias("target_value"))
    feats, ncols = md.tree_features(df, ["x"], ["c"])
    for cfg in ({"model_type": "gbt", "iterations": 2, "depth": 2}, {"model_type": "rf", "n_estimators": 2, "depth": 2}):
        pred, model = md.fit_score(feats, feats, ncols, ["c"], cfg, 1, carry=["target_value"])
        assert metrics.auc_table(pred, "target_value", "prediction").first().roc_auc > 0.9
        assert pred.count() == 12_000
    assert set(model.codes) == ({"c"} if categories > md.MAX_ARITY else set())


def test_early_stopping_keeps_fewer_trees_and_needs_valid_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("front_id"), F.rand(3).alias("x"), (F.rand(5) > 0.5).cast("int").alias("target_value"))
    feats, ncols = md.tree_features(df, ["x"], [])
    a, b = feats.filter("front_id % 2 = 0"), feats.filter("front_id % 2 = 1")
    model = md.fit_model(a, ncols, [], {"iterations": 30, "depth": 4, "early_stopping": True}, 1, valid=b)
    assert model.best_iteration < 30
    with pytest.raises(ValueError):
        md.fit_model(a, ncols, [], {"early_stopping": True}, 1)


def test_models_refuse_what_they_cannot_do():
    with pytest.raises(ValueError, match="weight"):
        md.model_factory({"model_type": "mlp", "layers": [2, 2]}, 1, weight_col="w")
    with pytest.raises(ValueError, match="extra_trees"):
        md.model_factory({"model_type": "extra_trees"}, 1)
    assert {p["a"] for p in md.draw_trials({"a": {"type": "categorical", "choices": [1, 2]}}, 20, 3)} == {1, 2}
    space = {"a": {"type": "categorical", "choices": [1, 2]}, "b": {"type": "int", "low": 1, "high": 9, "when": {"a": [2]}}}
    assert all(("b" in p) == (p["a"] == 2) for p in md.draw_trials(space, 30, 4))


def test_missing_scores_fail_the_check_after_the_clip(spark):
    pred = spark.createDataFrame([(1, 0.5), (2, None)], "front_id int, prediction double")
    with pytest.raises(ValueError, match="1 non-finite"):
        md.check_scores(pred.withColumn("prediction", sc.clip("prediction", 0.0, 1.0)))


BASE = {"id_col": "i", "day_col": "d", "target": "y"}


@pytest.mark.parametrize("extra", [
    {"learning_rate": 1}, {"time_features": {"include_year": True}}, {"feature_engineering": {"add_magic": True}},
    {"sample_weight": {"enabled": True, "strategy": "linear_recency", "half_life_days": 3}}, {"sample_weight": {"enabled": True, "strategy": "nope"}},
    {"model": {"model_type": "rf", "learning_rate": 0.1}}, {"model": {"model_type": "catboost"}}, {"excluded_features": ["y"]},
])
def test_config_keys_that_nothing_reads_are_errors(extra):
    cf.load_config(BASE)
    with pytest.raises(ValueError):
        cf.load_config({**BASE, **extra})


def test_context_features_need_their_columns(spark):
    tr = fx.apps(spark, SF_SMALL)
    cfg = {"id_col": "front_id", "day_col": "decision_day", "target": "target_value", "feature_engineering": {"enabled": True, "add_context_offer_features": True}}
    with pytest.raises(ValueError, match="needs columns"):
        cf.build_features(tr, tr.drop("target_value"), cfg)


def test_permuted_target_keeps_its_values_and_moves_them(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("y"), F.lit("k").alias("z"))
    out = ct.permute(df, "y", "id")
    a, b = {r.id: r.y for r in df.collect()}, {r.id: r.y for r in out.collect()}
    assert out.columns == df.columns and sorted(a.values()) == sorted(b.values()) and sum(a[i] != b[i] for i in a) > 100


def test_empty_folds_go_without_moving_rows(spark):
    df = spark.createDataFrame([(1, "train"), (1, "valid"), (2, "train"), (3, "valid"), (3, "train")], "fold int, role string")
    kept = splits.drop_empty_folds(df)
    assert sorted(map(tuple, kept.collect())) == [(1, "train"), (1, "valid"), (3, "train"), (3, "valid")]


def test_target_check_names_other_values(spark):
    test = spark.createDataFrame([(1,)], "x int")
    for rows, passed, detail in (([0, 1, None], True, "0,1"), ([0, 2], False, "0,other"), ([1], False, "1")):
        train = spark.createDataFrame([(v,) for v in rows], "y int")
        got = {r.check: (r.passed, r.detail) for r in sch.check_target(train, test, "y").collect()}
        assert got["target_values_binary"] == (passed, detail)


def test_scratch_tables_can_be_removed(spark):
    path = scratch_path(spark, "edge-cases")
    spark.range(3).write.mode("overwrite").parquet(path)
    assert remove_scratch(spark, path) and not remove_scratch(spark, path)
    with pytest.raises(ValueError):
        remove_scratch(spark, "/somewhere/else")
