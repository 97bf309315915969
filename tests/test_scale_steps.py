"""Steps that find few rows instead of ordering or moving all of them."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import blend as bl
from tidemark.operators import context as ctx
from tidemark.operators import contract as ct
from tidemark.operators import network as nw
from tidemark.operators import packed, ranks, splits
from tidemark.operators import pairwise as pw
from tidemark.plans import models as md
from tidemark.plans import q_models as qm


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_move_no_row_and_count_ties(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1.0, 2.0, 2.5, rng.random()]), rng.choice([None, *range(40)])) for _ in range(150)]
    df = spark.createDataFrame(data, "v double, id long")
    out = ranks.equal_count_bins(ranks.equal_count_bins(df, "v", "id", "a", 16), "v", "id", "b", 4)
    assert "Exchange" not in _plan(out) and "Join" not in _plan(out)
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    given = sorted((r for r in data if r[0] is not None), key=key)
    n = len(given)

    def bin_of(r, q):
        below = sum(key(o) < key(r) for o in given)
        return None if r[0] is None else max((below * q + n - 2) // (n - 1) - 1, 0)

    for r in out.collect():
        row = (r.v, r.id)
        assert (r.a, r.b) == ((None, None) if r.v is None else (bin_of(row, 16), bin_of(row, 4)))


def test_split_moves_no_row_and_keeps_shares(spark):
    data = [(i % 2 if i % 9 else None, i // 2) for i in range(300)] + [(1, None)] * 3
    df = spark.createDataFrame(data, "y int, id long")
    out = splits.stratified_split(df, "y", "id", 4, 0.7, "t")
    scan = _plan(out).split("Subquery")[0]
    assert "Window" not in scan and "Exchange" not in scan
    rows = [(r.y, r.id, r.t, r.h) for r in out.withColumn("h", splits.hash_order(["id"], 4)).collect()]
    key = lambda r: (r[3], r[1] is None, r[1] or 0)
    for y in (0, 1):
        own = [r for r in rows if r[0] == y]
        assert len(own) == sum(d[0] == y for d in data)
        need = math.ceil(len(own) * 7 / 10)
        assert all(r[2] == (sum(key(o) < key(r) for o in own) < need) for r in own)


def test_context_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "TASK_ROWS", 20)
    df = spark.range(2000).select((F.col("id") % 500).alias("k"), F.col("id").cast("double").alias("v"))
    out = ctx.context_features(df, ["k"], ["v"])
    assert out.rdd.getNumPartitions() == 100
    assert out.filter((F.col("context_offer_count") != 4) | (F.col("v_context_spread") != 1500)).isEmpty()


def test_a_train_side_is_fitted_once(spark, monkeypatch):
    fitted, fit = [], md.fit_model
    monkeypatch.setattr(md, "fit_model", lambda *a, **k: fitted.append(1) or fit(*a, **k))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 90).cast("int"))
    rows = md.store_rows(spark.range(180).select(F.col("id").alias("front_id"), day.alias("d"), (F.col("id") % 7).cast("double").alias("f_x"),
                                                 (F.col("id") % 3 == 0).cast("int").alias("target_value")))
    cfg, fits = {"model_type": "logreg", "iterations": 3}, {}
    _, m = md.evaluate_folds(rows, "d", splits.fold_spec(rows, "d", ["2000-02-01", "2000-03-01"]), ["f_x"], [], cfg, 1, stored=True, fits=fits)
    _, h = md.evaluate_folds(rows, "d", splits.holdout_spec([("A", "2000-03-01")]), ["f_x"], [], cfg, 1, scope="holdout", stored=True, fits=fits)
    assert len(fitted) == 2
    auc = {r.fold: r.roc_auc for r in m.collect()}
    assert {r.holdout: r.roc_auc for r in h.collect()}["A"] == auc["2"]


def test_simplex_blends_travel_once_and_stay_exact(spark, monkeypatch):
    rng = random.Random(5)
    pick = lambda: rng.choice([0.1, 0.25, 0.3, round(rng.random(), 2)])
    data = [(rng.choice([1, 2, None]), rng.choice([0, 1, 1, None]), *(rng.choice([None] + [pick() for _ in range(9)]) for _ in range(3))) for _ in range(300)]
    df = spark.createDataFrame(data * 2, "fold int, y int, a double, b double, c double")
    monkeypatch.setattr(bl, "BLOCK_TUPLES", 40)
    monkeypatch.setattr(bl, "SLOT_VALUES", 25)
    out = bl.scan_simplex(df, ["a", "b", "c"], "y", ["fold"], 4)
    assert "explode" not in _plan(out)
    got = {(r.i, r.j, r.k, r.fold): r.roc_auc for r in out.collect()}
    assert len(got) == 15 * 3
    for (i, j, k, fold), auc in got.items():
        score = lambda r: (i / 4.0) * r[2] + (j / 4.0) * r[3] + (k / 4.0) * r[4]
        own = [(r[1], score(r)) for r in data if r[0] == fold and None not in r[1:]]
        pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
        assert auc == sum((p > n) * 2 + (p == n) for p in pos for n in neg) / (2.0 * len(pos) * len(neg))


def test_small_contexts_of_the_skew_safe_way_move_once(spark, monkeypatch):
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7 % 90).cast("double").alias("v"))
    ways = {n: ctx.context_features(df, ["k"], ["v"], strategy="aggregate", hot_rows=n) for n in (None, 50, 0)}
    assert "Join" not in _plan(ways[None]) and "Join" in _plan(ways[50])
    rows = lambda d: sorted((r.k, r.v, r.context_offer_count, r.v_context_spread, r.v_minus_context_min, round(r.v_minus_context_mean, 9), r.v_rank_pct_in_context) for r in d.collect())
    plain = rows(ctx.context_features(df, ["k"], ["v"], strategy="window"))
    assert all(rows(d) == plain for d in ways.values())


def test_label_check_groups_once_and_permutes_whole(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") * 3).alias("x"))
    assert ct.PLACE_RANGES == 4096
    monkeypatch.setattr(ct, "PLACE_RANGES", 16)
    perm = ct.permute(df, "y", "id")
    assert _plan(perm).count("Exchange hashpartitioning") <= 8
    rows = perm.collect()
    assert sorted((r.id, r.x) for r in rows) == [(i, 3 * i) for i in range(500)] and sum(r.y for r in rows) == 100
    assert sum(r.y != (r.id % 5 == 0) for r in rows) > 50
    assert ct.label_free(lambda d: d.select("id", "y", (F.col("x") + 1).alias("x")), df, "y", "id")
    assert not ct.label_free(lambda d: d.select("id", "y", (F.col("x") + F.col("y")).alias("x")), df, "y", "id")
    twice = df.unionByName(df.limit(1))
    assert not ct.label_free(lambda d: d.select("id", "y", (F.col("x") + F.col("y")).alias("x")), twice, "y", "id")


def test_ranker_groups_are_moved_once(spark):
    rng = np.random.default_rng(2)
    data = [(int(i % 2), int(i % 7), [float(rng.normal()), float(i % 3)], int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame([*data, (0, 1, [None, 1.0], 1), (0, None, [0.5, 1.0], 1), (1, 2, [0.5, 1.0], None)], "m int, d int, x array<double>, y int")
    blocks = pw._group_blocks(df, "m", "d", "x", "y", 2)
    assert blocks.count() == 14
    w = {0: [0.3, -0.2], 1: [-0.5, 0.1]}
    got = pw._group_pass(blocks, "m", w, 2)
    # Beside the blocks only sums move: one exchange, after the tasks' own sums.
    rows = pw.pair_slopes(df.withColumn("s", pw.by_model(F.col("m"), F.col("x"), w)), ["m", "d"], "y", "s").collect()
    for m in w:
        own = [r for r in rows if r.m == m]
        want = [sum(r.pair_loss for r in own), sum(r.pairs for r in own), *(sum(r.pair_slope * r.x[i] for r in own) for i in range(2))]
        assert np.allclose(got[m], want)


def test_packed_rows_come_back_exactly():
    x = np.random.default_rng(1).normal(size=(9, 5))
    x[:, 1], x[:, 3] = [0, 1, 255, 3, 4, 5, 6, 7, 8], [-0.0] * 9
    mask, wide, narrow = packed.pack(x)
    assert len(wide) == 9 * 4 * 8 and len(narrow) == 9
    assert packed.unpack(mask, wide, narrow, 9).tobytes() == x.tobytes()


def test_networks_read_packed_blocks(spark, monkeypatch):
    monkeypatch.setattr(nw, "BLOCK_ROWS", 7)
    df = spark.range(40).select(F.array((F.col("id") % 2).cast("double"), F.rand(1)).alias("x"), (F.col("id") % 2).cast("double").alias("y"),
                                F.lit(1.0).alias("w"), F.array(F.lit(1)).alias("roles")).coalesce(1)
    assert nw._blocks(df, 2).count() == 6


def test_pseudo_label_fits_read_stored_rows(spark, monkeypatch):
    i = F.col("id")
    apps = spark.range(300).select(
        i.alias("front_id"), F.date_add(F.lit("2000-01-01").cast("date"), (i % 150).cast("int")).alias("decision_day"),
        *[(i % m).cast("double").alias(c) for m, c in ((7, "loan_amount_last"), (5, "balance_amt"), (3, "cnt_30"), (2, "cnt_90"))],
        F.lit("a").alias("db_group_last"), F.lit("b").alias("fl_adminarea"), (i % 3 == 0).cast("int").alias("target_value"), F.lit(0).alias("is_test"))
    monkeypatch.setattr(qm.fx, "apps", lambda *_: apps)
    plans = []

    def fit_score(train, score, *_, **__):
        plans.extend([_plan(train), _plan(score)])
        return score.select("front_id", "target_value", ((F.col("front_id") % 100) / 100.0).alias("prediction")), None

    monkeypatch.setattr(md, "fit_score", fit_score)
    assert qm.k11_pseudo_label_probe(spark, "").count() == 3
    assert len(plans) == 8 and not any("Range" in p for p in plans)


def test_fold_fits_read_stored_rows_and_fixed_days(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(400).select(
        i.alias("front_id"), F.date_add(F.lit("2000-01-01").cast("date"), (i % 90).cast("int")).alias("d"), (i % 7).cast("double").alias("f_x"),
        F.when(i % 90 < 60, F.concat(F.lit("a"), i % 4)).otherwise(F.when(i % 5 > 0, i.cast("string"))).alias("k_c"), F.lit("one").alias("k_e"),
        F.lit(None).cast("string").alias("k_n"), (i % 3 == 0).cast("int").alias("target_value"))
    seen = []

    def fit_model(train, *args):
        distinct = train.agg(*[F.countDistinct(f"k_{c}").alias(c) for c in "cen"]).first().asDict()
        seen.append((_plan(train), args[-1], distinct))
        return md.FittedModel(type("Half", (), {"stages": [None], "transform": lambda _, x: x.withColumn("probability", F.array(F.lit(0.5), F.lit(0.5)))})(), {})

    monkeypatch.setattr(md, "fit_model", fit_model)
    monkeypatch.setattr(md, "positive_class_score", lambda c, _: F.col(c)[1])
    spec = splits.fold_spec(df, "d", ["2000-02-01", "2000-03-01", "2000-03-15"], window_days=40)
    parts, m = md.evaluate_folds(df, "d", spec, ["f_x"], ["c", "e", "n"], {"model_type": "logreg"}, 1)
    assert len(seen) == 3 and not any("Range" in p or "ubquery" in p for p, *_ in seen)
    assert all(sizes == distinct for _, sizes, distinct in seen) and {s["c"] for _, s, _ in seen} != {4}
    assert parts.count() == df.filter("d >= '2000-02-01'").count() and {r.roc_auc for r in m.collect()} == {0.5}


def test_feature_probe_joins_once_and_its_tasks_follow_the_rows(spark, monkeypatch):
    i = F.col("id")
    apps = spark.range(600).select(
        i.alias("front_id"), F.date_add(F.lit("1998-06-01").cast("date"), i.cast("int")).alias("decision_day"),
        *[(i % m).cast("double").alias(c) for m, c in ((7, "loan_amount_last"), (5, "balance_amt"), (3, "cnt_30"), (2, "cnt_90"))],
        F.lit("a").alias("db_group_last"), F.lit("b").alias("fl_adminarea"), (i % 3 == 0).cast("int").alias("target_value"), (i % 6 == 5).cast("int").alias("is_test"))
    monkeypatch.setattr(qm.fx, "apps", lambda *_: apps)
    monkeypatch.setattr(md, "FIT_ROWS", 1)
    read, stored, store_rows = [], [], md.store_rows

    def keep(df, *args, **kw):
        read.append(_plan(df))
        stored.append(store_rows(df, *args, **kw))
        return stored[-1]

    def fit_model(train, num_cols, *_):
        half = type("Half", (), {"stages": [None], "transform": lambda _, x: x.withColumn("probability", F.array(F.lit(0.5), F.lit(0.5)))})()
        return md.FittedModel(half, {})

    monkeypatch.setattr(md, "store_rows", keep)
    monkeypatch.setattr(md, "fit_model", fit_model)
    monkeypatch.setattr(md, "positive_class_score", lambda c, _: F.col(c)[1])
    rows = qm.k07_feature_family_probe(spark, "").collect()
    assert len({r.variant for r in rows}) == len(rows) == 8 and all(r["1"] == r["OOF_TIME_HOLDOUT"] == 0.5 for r in rows)
    # The tables are read for the first frame only.
    assert sum("Range" in p for p in read) == 1 and len(read) == 9
    assert all(s.count() == 500 for s in stored[1:])
    tasks = lambda n: store_rows(apps, rows=n).rdd.getNumPartitions()
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        monkeypatch.setattr(md, "FIT_ROWS", 2)
        assert tasks(600) == 300 and tasks(10) == 2 * spark.sparkContext.defaultParallelism and tasks(6000) == tasks(None) == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _made_apps(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("front_id"), F.date_add(F.lit("1998-06-01").cast("date"), (i * 1000 / n).cast("int")).alias("decision_day"),
        *[(i % m).cast("double").alias(c) for m, c in ((7, "loan_amount_last"), (5, "balance_amt"), (3, "cnt_30"), (2, "cnt_90"))],
        F.lit("a").alias("db_group_last"), F.lit("b").alias("fl_adminarea"), (i % 3 == 0).cast("int").alias("target_value"), (i % 6 == 5).cast("int").alias("is_test"))


def _record_fits(monkeypatch, spark, n):
    """Fits and scores replaced by recorders: (plan, tasks) of each."""
    apps, fitted, scored = _made_apps(spark, n), [], []
    monkeypatch.setattr(qm.fx, "apps", lambda *_: apps)

    def transform(x):
        scored.append((_plan(x), x.rdd.getNumPartitions()))
        return x.withColumn("probability", F.array(F.lit(0.5), F.lit(0.5)))

    def fit_model(train, *_):
        fitted.append((_plan(train), train.rdd.getNumPartitions()))
        half = type("Half", (), {"stages": [None], "transform": lambda _, x: transform(x)})()
        return md.FittedModel(half, {})

    monkeypatch.setattr(md, "fit_model", fit_model)
    monkeypatch.setattr(md, "positive_class_score", lambda c, _: F.col(c)[1])
    return fitted, scored


def test_fits_have_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    few = -(-cores // md.PARALLEL_FITS)
    fitted, scored = _record_fits(monkeypatch, spark, 900)
    assert qm.k07_feature_family_probe(spark, "").count() == 8
    assert len(fitted) == 24 and {n for _, n in fitted + scored} == {few}
    assert md.fits_at_once(spark, 1) == max(md.PARALLEL_FITS, min(md.SMALL_FITS, 2 * cores // few)) and md.fits_at_once(spark, 10**9) == md.PARALLEL_FITS
    monkeypatch.setattr(md, "FIT_ROWS", 90)
    assert md._fit_tasks(spark, 900) == max(10, few)


def test_calendar_variants_join_once(spark, monkeypatch):
    fitted, scored = _record_fits(monkeypatch, spark, 900)
    read, store_rows = [], md.store_rows
    monkeypatch.setattr(md, "store_rows", lambda df, *a, **k: read.append(_plan(df)) or store_rows(df, *a, **k))
    rows = qm.k12_multiseed_calendar_ablation(spark, "").collect()
    assert sum("Range" in p for p in read) == 1 and len(read) == 8
    assert len({r.variant for r in rows}) == len(rows) == 7 and all(r["3"] == r["OOF_TIME_HOLDOUT"] == r.lh_mean == r.lh_min == 0.5 for r in rows)
    # Three folds and the one late holdout that trains on other rows.
    assert len(fitted) == 7 * 4 and len(scored) == 7 * 6 and not any("Range" in p for p, _ in fitted + scored)


def test_seeds_score_stored_rows(spark, monkeypatch):
    fitted, scored = _record_fits(monkeypatch, spark, 900)
    rows = {(r.seed, r.part): (r.n_rows, r.once) for r in qm.k12_multiseed_scores(spark, "").collect()}
    assert len(rows) == 3 * 7 and all(once for _, once in rows.values()) and rows[44, "test"] == (150, True)
    assert len(fitted) == 3 * 5 and len(scored) == 3 * 7 and not any("Range" in p for p, _ in fitted + scored)


def test_two_views_share_one_stored_table_of_what_they_read(spark, monkeypatch):
    i = F.col("id")
    offers = spark.range(300).select(
        (i / 3).cast("long").alias("l_orderkey"), (i % 3).cast("int").alias("l_linenumber"), i.alias("l_partkey"),
        F.date_add(F.lit("1994-06-01").cast("date"), (i * 4).cast("int")).alias("decision_day"), F.lit("F").alias("l_linestatus"), F.lit("unread").alias("l_returnflag"),
        *[(i % m).cast("double").alias(c) for m, c in ((7, "offered_rate"), (5, "overdraft_limit_min"), (11, "overdraft_limit_max"))], (i % 2).cast("int").alias("target_value"))
    monkeypatch.setattr(qm.fx, "offers", lambda *_: offers)
    fitted, scored = _record_fits(monkeypatch, spark, 1)
    monkeypatch.setattr(md, "positive_class_score", lambda *_: F.pmod(F.xxhash64("row_key"), F.lit(7)) / 7.0)
    stored, store_rows = [], md.store_rows
    monkeypatch.setattr(md, "store_rows", lambda df, *a, **k: stored.append(df.columns) or store_rows(df, *a, **k))
    rows = qm.k15_two_view_experiment(spark, "").collect()
    assert len(fitted) == len(scored) == 6 and {r.fold for r in rows} >= {"1", "2", "3"}
    assert len(stored) == 1 and {c for c in stored[0] if c[:2] not in ("f_", "k_")} == {"row_key", "decision_day", "target_value"}


def test_folds_store_the_columns_they_read(spark, monkeypatch):
    seen = []
    _record_fits(monkeypatch, spark, 1)
    fit = md.fit_model
    monkeypatch.setattr(md, "fit_model", lambda train, *a: seen.append(set(train.columns)) or fit(train, *a))
    df = _made_apps(spark, 600).withColumn("unread", F.lit("x")).withColumn("w", F.lit(2.0)).withColumn("f_x", F.lit(1.0)).withColumn("k_c", F.lit("c"))
    md.evaluate_folds(df, "decision_day", splits.fold_spec(df, "decision_day", ["1999-01-01"]), ["f_x"], ["c"], {"model_type": "logreg"}, 1, weight_col="w")
    assert seen == [{"front_id", "decision_day", "target_value", "w", "f_x", "k_c"}]


def test_fold_features_are_packed_and_removed(spark, monkeypatch):
    apps = md.cut_lineage(_made_apps(spark, 900).withColumn("unread", F.lit("x")))
    monkeypatch.setattr(qm.fx, "apps", lambda *_: apps)
    seen, paths, scratch = [], [], qm.scratch_path

    def fit_score(train, score, ncols, *_, **__):
        seen.append((train.columns, _plan(train), len(ncols)))
        return score.select("front_id", "target_value", F.lit(0.5).alias("prediction")), None

    monkeypatch.setattr(md, "fit_score", fit_score)
    monkeypatch.setattr(qm, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    out = qm.k18_foldsafe_feature_model(spark, "")
    assert len(seen) == 3 and all("FileScan parquet" in p and "unread" not in c and n == 4 + 2 * (2 * 6 + 1) for c, p, n in seen)
    # The features are gone before the result is read.
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    assert {r.fold: r.roc_auc for r in out.collect()} == dict.fromkeys(["1", "2", "3", "OOF_TIME_HOLDOUT"], 0.5)
