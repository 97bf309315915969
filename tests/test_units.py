"""Small unit tests: typed parameter text, latest-window selection of the
stream sink, run registry parsing, config derivation."""

from pyspark.sql import functions as F

from tidemark.functions.params import typed_value
from tidemark.plans import config as cf
from tidemark.sources import sinks as sk
from tidemark.streaming.monitor import current_windows


def test_typed_value(spark):
    df = spark.createDataFrame([(v,) for v in ["None", "True", "7", "0.25", "[1, 2]", "[0.5, 1]", "x"]], "v string")
    got = {r.v: r.t for r in df.select("v", typed_value(F.col("v")).alias("t")).collect()}
    assert got["None"].kind == "null" and got["True"].bool_value is True
    assert got["7"].int_value == 7 and got["0.25"].float_value == 0.25
    assert got["[1, 2]"].int_list == [1, 2] and got["[0.5, 1]"].float_list == [0.5, 1.0]
    assert got["x"].kind == "text"


def test_current_windows_latest_batch_wins(spark):
    hist = spark.createDataFrame(
        [("2000-01-01", "view", 3, 1.0, 0, 0), ("2000-01-01", "view", 5, 2.0, 0, 1), ("2000-01-02", "view", 1, 4.0, 0, 1)],
        "day string, event_type string, n_events int, mean_value double, n_bad int, batch_id int")
    got = {(r.day, r.event_type): r.n_events for r in current_windows(hist).collect()}
    assert got == {("2000-01-01", "view"): 5, ("2000-01-02", "view"): 1}


def test_run_registry_and_latest(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.5)], "front_id long, target_value int, p double").withColumn("fold", F.lit(1))
    path = str(tmp_path / "preds")
    for run in ("m_20240101T000000Z_seed1", "m_20240201T000000Z_seed2"):
        sk.append_predictions(df, path, run, "oof", "fold", "front_id", "target_value", "p")
    latest = sk.latest_runs(sk.run_registry(spark, path)).collect()
    assert [(r.prefix, r.run_id) for r in latest] == [("m", "m_20240201T000000Z_seed2")]


def test_config_derive_overrides_nested():
    base = {"id_col": "id", "day_col": "d", "target": "y", "time_features": {"include_day_num": True}}
    d = cf.derive(base, {"time_features": {"include_week": True}})
    assert d["time_features"] == {"include_day_num": True, "include_week": True}
    assert base["time_features"] == {"include_day_num": True}
