"""Model-based checks (rows / property only): K01-K18, E35, E36, I04, I06, I07.

Models are Spark ML estimators fitted on the fixture features; configs are
small so the checks stay quick, the code paths are the full ones.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalar as sc
from ..operators import blend as bl
from ..operators import context as ctx
from ..operators import fold_encoders as fe
from ..operators import history as hs
from ..operators import metrics, splits
from ..operators import pairwise as pw
from ..operators import tree_paths as tp
from ..operators import weights as wt
from ..operators.schema import DRIFT_EXCLUSIONS, confident_rows, feature_variants, split_feature_space
from ..session import cut_lineage, remove_scratch, scratch_path
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import models as md
from .catalog import query
from .q_folds import auc_sql

NUM = ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90"]
CAT = ["db_group_last", "fl_adminarea"]
GBT = {"model_type": "gbt", "iterations": 8, "depth": 3, "learning_rate": 0.2}
QUICK = {"model_type": "gbt", "iterations": 4, "depth": 3, "learning_rate": 0.2}
SEED = 42
#: Feature variants (or seeds) that are worked on at the same time.
PARALLEL_VARIANTS = 3


def _train_test(spark, sf):
    a = fx.apps(spark, sf)
    return a.filter("is_test = 0"), a.filter("is_test = 1")


def _features(df, extra_num=()):
    return md.tree_features(df, [*NUM, *extra_num], CAT)


def _fold_spec(tr):
    return splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS)


@query("k01_gbt_time_folds")
def k01_gbt_time_folds(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    _, m = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, GBT, SEED)
    return m


@query("k02_refit_score_test")
def k02_refit_score_test(spark, sf):
    tr, te = _train_test(spark, sf)
    ftr, ncols = _features(tr)
    fte, _ = _features(te)
    return md.refit_and_score(ftr, fte, ncols, CAT, GBT, SEED)


@query("k03_forest_time_folds")
def k03_forest_time_folds(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    cfg = {"model_type": "rf", "n_estimators": 20, "depth": 6, "min_samples_leaf": 20}
    _, m = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, cfg, SEED)
    return m


ET = {"model_type": "extra_trees", "n_estimators": 20, "depth": 6, "min_samples_leaf": 20, "class_weight": "balanced"}


@query("k03_extra_trees_time_folds")
def k03_extra_trees_time_folds(spark, sf):
    """Extremely randomised trees with class weights, per time fold and pooled."""
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    _, m = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, ET, SEED)
    return m


@query("k04_dense_network_time_folds")
def k04_dense_network_time_folds(spark, sf):
    tr, _ = _train_test(spark, sf)
    fit = tr.filter(F.col("decision_day") < F.lit("2000-01-01").cast("date"))
    z = tr.select("front_id", "decision_day", "target_value", *CAT,
                  *[sc.median_fill(fit, c).alias(c) for c in NUM])
    z = z.select("front_id", "decision_day", "target_value", *CAT, *[sc.standardize(fit, c).alias(c) for c in NUM])
    feats, ncols = _features(z)
    cfg = {"model_type": "mlp", "layers": [len(ncols) + len(CAT), 8, 2], "iterations": 30}
    _, m = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, cfg, SEED)
    return m


def _weighted_networks(spark, sf, **options):
    tr, _ = _train_test(spark, sf)
    weighted = tr.withColumn("sample_weight", wt.linear_recency(tr, "decision_day"))
    return md.network_folds(weighted, "decision_day", _fold_spec(tr), NUM, CAT, weight_col="sample_weight", hidden=(16, 8), **options)


@query("k04_weighted_network_time_folds")
def k04_weighted_network_time_folds(spark, sf):
    """Networks of all folds with recency weights, class weight and early stop: AUC, best step, steps run."""
    return _weighted_networks(spark, sf, steps=25, patience=5)[1]


@query("k05_late_holdouts")
def k05_late_holdouts(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    spec = splits.holdout_spec(fx.HOLDOUT_CUTOFFS)
    _, m = md.evaluate_folds(feats, "decision_day", spec, ncols, CAT, GBT, SEED, scope="holdout")
    return md.holdout_summary(m)


@query("k06_recent_window_scan")
def k06_recent_window_scan(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    feats = md.store_rows(feats)
    rows = None
    for win in (None, 90, 120, 180, 240, 365):
        spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS, window_days=win)
        _, m = md.evaluate_folds(feats, "decision_day", spec, ncols, CAT, GBT, SEED, stored=True)
        m = m.withColumn("window", F.lit("expanding" if win is None else f"{win}d"))
        rows = m if rows is None else rows.unionByName(m)
    wide = rows.groupBy("window").pivot("fold", ["1", "2", "3", "OOF_TIME_HOLDOUT"]).agg(F.first("roc_auc"))
    return wide.withColumn("is_best_fold3", F.col("3") == wide.select(F.max("3")).scalar())


@query("k07_feature_family_probe")
def k07_feature_family_probe(spark, sf):
    # Every family counts over the joined rows: joined once.
    both = md.store_rows(fx.apps(spark, sf))
    tr = both.filter("is_test = 0")
    spec, n = _fold_spec(tr), both.count()

    def probe(name, family):
        df = family(both).filter("is_test = 0")
        kinds = {c: t for c, t in df.dtypes if c not in both.columns}
        cats = [*CAT, *[c for c, t in kinds.items() if t == "string"]]
        feats, ncols = md.tree_features(df, [*NUM, *[c for c, t in kinds.items() if t != "string"]], cats)
        _, m = md.evaluate_folds(md.store_rows(feats, rows=n), "decision_day", spec, ncols, cats, QUICK, SEED, stored=True, pool=fits, few_tasks=True)
        return m.withColumn("variant", F.lit(name))

    variants = feature_variants(NUM, CAT, "decision_day", tr, "front_id")
    # A variant's rows and metrics are made while the fits of another run.
    with ThreadPoolExecutor(md.fits_at_once(spark, n)) as fits, ThreadPoolExecutor(PARALLEL_VARIANTS) as pool:
        # The last one takes longest to make: begun first, no other waits for it alone.
        probes = [pool.submit(probe, *v) for v in reversed(variants.items())]
        rows = reduce(DataFrame.unionByName, [p.result() for p in reversed(probes)])
    return rows.groupBy("variant").pivot("fold", ["1", "2", "3", "OOF_TIME_HOLDOUT"]).agg(F.first("roc_auc"))


@query("k08_history_feature_ab")
def k08_history_feature_ab(spark, sf):
    tr, _ = _train_test(spark, sf)
    ev = read_table(spark, sf, "events", ["user_id", "event_type", "value"])
    roll = hs.rollup(hs.matched_history(ev, tr, "user_id", "cust_id"), "user_id", ["value"],
                     flag=F.col("event_type") == "error")
    withh = hs.attach(tr, roll, "cust_id", "user_id")
    hcols = [c for c in withh.columns if c.startswith("scoring_")] + ["has_history"]
    out = None
    for name, df, extra in (("base", tr, []), ("base_plus_history", withh, hcols)):
        feats, ncols = _features(df, extra)
        _, m = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, GBT, SEED)
        m = m.withColumn("arm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def _application_offers(spark, sf):
    """Every application with its offers: a row per offer, and one with missing terms where there is none."""
    o = fx.offers(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", *fx.OFFER_COLS)
    a = fx.apps(spark, sf)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("front_id", "l_linenumber", "l_partkey", "overdraft_limit_max")])
    return a.join(o, a["front_id"] == o["l_orderkey"], "left").withColumn("row_key", key)


@query("k09_drift_forest")
def k09_drift_forest(spark, sf):
    """Metrics and importances of all four exclusion sets on applications with their offer terms."""
    cats = [*CAT, "l_linestatus"]
    base_cols = ["decision_day", *NUM, *fx.OFFER_COLS, *cats]
    both = cut_lineage(_application_offers(spark, sf).select(
        "front_id", "is_test", cal.ordinal("decision_day").cast("double").alias("decision_day"), *base_cols[1:]))
    sets = {name: [c for c in base_cols if c not in gone] for name, gone in DRIFT_EXCLUSIONS.items()}
    # Split by application: its offers tie, so they stand on one side of the holdout.
    return md.drift_forest_sets(both.filter("is_test = 0"), both.filter("is_test = 1"), sets, cats, SEED, "front_id",
                                {"model_type": "rf", "n_estimators": 20, "depth": 6, "min_samples_leaf": 20})


@query("k10_density_ratio_weights")
def k10_density_ratio_weights(spark, sf):
    tr, te = _train_test(spark, sf)
    cols = ["front_id", *NUM, *CAT]
    oof = md.oof_domain_scores(tr.select(*cols), te.select(*cols), "front_id", NUM, CAT, SEED, 3,
                               {"model_type": "gbt", "iterations": 6, "depth": 3})
    auc = metrics.auc_table(oof, "label_domain", "prediction").select("roc_auc").scalar()
    w = wt.density_ratio_weights(oof.filter("label_domain = 0"), "prediction", 0.01, 10.0)
    return metrics.weight_profile(w, "sample_weight").withColumn("oof_domain_auc", auc)


@query("k11_pseudo_label_probe")
def k11_pseudo_label_probe(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    feats = md.store_rows(feats)
    cut = F.lit("2000-04-01").cast("date")
    fit, hold = feats.filter(F.col("decision_day") < cut), feats.filter(F.col("decision_day") >= cut)
    base, _ = md.fit_score(fit, hold, ncols, CAT, GBT, SEED, carry=["target_value"])
    base = cut_lineage(base)
    base_auc = metrics.auc_table(base, "target_value", "prediction").select("roc_auc").scalar()
    # Joined once: every fit reads its rows many times.
    scored = cut_lineage(hold.join(base.select("front_id", "prediction"), "front_id"))
    out = None
    for hi, lo, pw in ((0.9, 0.05, 0.3), (0.85, 0.1, 0.3), (0.9, 0.05, 0.5)):
        pseudo = confident_rows(scored, "prediction", hi, lo).drop("target_value", "prediction").withColumnRenamed(
            "pseudo_target", "target_value").withColumn("w", wt.constant_weight(pw))
        aug = fit.withColumn("w", F.lit(1.0)).unionByName(pseudo.select(*fit.columns, "w"))
        pred, _ = md.fit_score(aug, hold, ncols, CAT, GBT, SEED, weight_col="w", carry=["target_value"])
        a = metrics.auc_table(pred, "target_value", "prediction").select(
            F.lit(hi).alias("hi"), F.lit(lo).alias("lo"), F.lit(pw).alias("pseudo_weight"), "roc_auc",
            (F.col("roc_auc") - base_auc).alias("auc_delta"),
            F.lit(pseudo.count()).alias("pseudo_rows"))
        out = a if out is None else out.unionByName(a)
    return out


@query("k12_multiseed_calendar_ablation")
def k12_multiseed_calendar_ablation(spark, sf):
    """Seven calendar variants on all folds and late holdouts."""
    # Joined once: every variant reads the same rows.
    tr = md.store_rows(_train_test(spark, sf)[0])
    spec, n = _fold_spec(tr), tr.count()

    def ablate(variant):
        feats, ncols, cats = _calendar_features(tr, tr, variant)
        # Two late holdouts train on the rows of a fold: one fit for both.
        kw = {"stored": True, "fits": {}, "pool": fits, "few_tasks": True}
        feats = md.store_rows(feats, rows=n)
        _, m = md.evaluate_folds(feats, "decision_day", spec, ncols, cats, QUICK, SEED, **kw)
        _, h = md.evaluate_folds(feats, "decision_day", splits.holdout_spec(fx.HOLDOUT_CUTOFFS), ncols, cats, QUICK, SEED, scope="holdout", **kw)
        late = h.filter("holdout <> 'POOLED'").agg(F.avg("roc_auc").alias("lh_mean"), F.min("roc_auc").alias("lh_min"))
        return m.groupBy().pivot("fold", ["1", "2", "3", "OOF_TIME_HOLDOUT"]).agg(F.first("roc_auc")).select(
            F.lit(variant).alias("variant"), "*", late.select("lh_mean").scalar().alias("lh_mean"), late.select("lh_min").scalar().alias("lh_min"))

    # A variant's rows and metrics are made while the fits of another run.
    with ThreadPoolExecutor(md.fits_at_once(spark, n)) as fits, ThreadPoolExecutor(PARALLEL_VARIANTS) as pool:
        return reduce(DataFrame.unionByName, pool.map(ablate, cal.CALENDAR_VARIANTS))


def _calendar_features(df, fit, variant):
    x = df.select("*", *cal.calendar_columns("decision_day", fit, variant))
    cats = [*CAT, *[c for c in ("month",) if c in x.columns]]
    feats, ncols = md.tree_features(x, [*NUM, *[c for c in ("day_num", "week") if c in x.columns]], cats)
    return feats, ncols, cats


@query("k12_multiseed_scores", fx.with_views("apps") + """, s(seed) AS (VALUES (43), (44), (45)),
v AS (SELECT 'fold ' || CASE WHEN decision_day < DATE '1999-07-01' THEN '1' WHEN decision_day < DATE '2000-01-01' THEN '2' ELSE '3' END AS part, target_value
      FROM apps WHERE is_test = 0 AND decision_day >= DATE '1999-01-01'
  UNION ALL SELECT 'holdout ' || h, target_value FROM apps JOIN (VALUES ('H1', DATE '1999-07-01'), ('H2', DATE '2000-01-01'), ('H3', DATE '2000-04-01')) t(h, cutoff)
      ON decision_day >= cutoff WHERE is_test = 0
  UNION ALL SELECT 'test', NULL FROM apps WHERE is_test = 1)
SELECT seed, part, COUNT(*) AS n_rows, CAST(SUM(target_value) AS BIGINT) AS n_pos, TRUE AS once, TRUE AS in_unit FROM v CROSS JOIN s GROUP BY seed, part""")
def k12_multiseed_scores(spark, sf):
    """Every fold, late holdout and the test side scored per seed; facts of the score sets."""
    tr, te = _train_test(spark, sf)
    feats, ncols, cats = _calendar_features(tr, tr, "time_all")
    fte, _, _ = _calendar_features(te, tr, "time_all")
    feats, fte = md.store_rows(feats), md.store_rows(fte)
    spec = _fold_spec(feats)

    def score(seed):
        kw = {"stored": True, "fits": {}, "pool": fits, "few_tasks": True}
        valid, _ = md.evaluate_folds(feats, "decision_day", spec, ncols, cats, QUICK, seed, **kw)
        late, _ = md.evaluate_folds(feats, "decision_day", splits.holdout_spec(fx.HOLDOUT_CUTOFFS), ncols, cats, QUICK, seed, scope="holdout", **kw)
        test = fits.submit(md.refit_and_score, feats, fte, ncols, cats, QUICK, seed).result()
        parts = valid.select(F.concat(F.lit("fold "), "fold").alias("part"), "front_id", "target_value", "prediction").unionByName(
            late.select(F.concat(F.lit("holdout "), "holdout").alias("part"), "front_id", "target_value", "prediction")).unionByName(
            test.select(F.lit("test").alias("part"), "front_id", F.lit(None).cast("int").alias("target_value"), "prediction"))
        return score_facts(parts, ["part"]).select(F.lit(seed).alias("seed"), "*")

    # The seeds share the cluster: the fits of one fill the gaps of the others.
    with ThreadPoolExecutor(md.fits_at_once(spark, feats.count())) as fits, ThreadPoolExecutor(PARALLEL_VARIANTS) as pool:
        return reduce(DataFrame.unionByName, pool.map(score, (43, 44, 45)))


def score_facts(preds, keys):
    """Rows, positives, whether each id is scored once and every score lies in [0, 1]."""
    p = F.col("prediction")
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target_value").cast("long").alias("n_pos"),
        (F.countDistinct("front_id") == F.count(F.lit(1))).alias("once"), (F.count_if((p >= 0) & (p <= 1)) == F.count(F.lit(1))).alias("in_unit"))


FOLD_FACTS_SQL = fx.with_views("apps") + """, v AS (SELECT target_value, CASE WHEN decision_day < DATE '1999-07-01' THEN '1' WHEN decision_day < DATE '2000-01-01' THEN '2' ELSE '3' END AS fold
  FROM apps WHERE is_test = 0 AND decision_day >= DATE '1999-01-01')
SELECT fold, COUNT(*) AS n_rows, CAST(SUM(target_value) AS BIGINT) AS n_pos, TRUE AS once, TRUE AS in_unit FROM v GROUP BY fold"""


@query("k01_fold_score_facts", FOLD_FACTS_SQL)
def k01_fold_score_facts(spark, sf):
    """Boosted trees with early stopping and class weights: facts of the written fold scores."""
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    cfg = {**QUICK, "early_stopping": True, "class_weight": "balanced"}
    preds, _ = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, cfg, SEED)
    return score_facts(preds, ["fold"])


@query("k03_fold_score_facts", FOLD_FACTS_SQL)
def k03_fold_score_facts(spark, sf):
    """A forest with sample weights: facts of the written fold scores."""
    tr, _ = _train_test(spark, sf)
    weighted = tr.withColumn("w", wt.recent_boost("decision_day", "1999-01-01"))
    feats, ncols = _features(weighted)
    cfg = {"model_type": "rf", "n_estimators": 8, "depth": 4}
    preds, _ = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, cfg, SEED, weight_col="w")
    return score_facts(preds, ["fold"])


@query("k04_weighted_network_score_facts", FOLD_FACTS_SQL)
def k04_weighted_network_score_facts(spark, sf):
    """Facts of the fold scores of the weighted networks."""
    return score_facts(_weighted_networks(spark, sf, steps=4)[0], ["fold"])


@query("k03_extra_trees_score_facts", FOLD_FACTS_SQL)
def k03_extra_trees_score_facts(spark, sf):
    """Extremely randomised trees with sample weights: facts of the written fold scores."""
    tr, _ = _train_test(spark, sf)
    weighted = tr.withColumn("w", wt.recent_boost("decision_day", "1999-01-01"))
    feats, ncols = _features(weighted)
    preds, _ = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, {**ET, "n_estimators": 8, "depth": 4}, SEED, weight_col="w")
    return score_facts(preds, ["fold"])


@query("k02_test_score_facts", fx.with_views("apps") + "SELECT COUNT(*) AS n_rows, CAST(NULL AS BIGINT) AS n_pos, TRUE AS once, TRUE AS in_unit FROM apps WHERE is_test = 1")
def k02_test_score_facts(spark, sf):
    tr, te = _train_test(spark, sf)
    ftr, ncols = _features(tr)
    fte, _ = _features(te)
    scored = md.refit_and_score(ftr, fte, ncols, CAT, QUICK, SEED)
    return score_facts(scored.withColumn("target_value", F.lit(None).cast("int")), [])


SPACE = {
    "iterations": {"type": "int", "low": 4, "high": 10, "step": 2},
    "depth": {"type": "int", "low": 2, "high": 4},
    "learning_rate": {"type": "float", "low": 0.05, "high": 0.3, "log": True},
    "subsample_kind": {"type": "categorical", "choices": ["none", "rows"]},
    "subsample": {"type": "float", "low": 0.6, "high": 1.0, "when": {"subsample_kind": ["rows"]}},
}


def _search(spark, sf, n=6):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    feats = md.store_rows(feats)
    spec = [s for s in _fold_spec(tr) if s["fold"] == 3]
    trials = md.draw_trials(SPACE, n, SEED)

    def value(t):
        _, m = md.evaluate_folds(feats, "decision_day", spec, ncols, CAT, {"model_type": "gbt", **t}, SEED, stored=True)
        return m.filter(F.col("fold") == "3").select("roc_auc").first()[0]

    # Two trials at a time: their jobs share the cluster.
    with ThreadPoolExecutor(2) as pool:
        return md.trial_table(spark, trials, list(pool.map(value, trials)))


@query("k13_parameter_search")
def k13_parameter_search(spark, sf):
    return _search(spark, sf)


def _stored(spark, trials):
    """A trial table written to the scratch folder and read again."""
    path = scratch_path(spark, f"trials-{uuid.uuid4().hex[:12]}")
    trials.write.parquet(path)
    return spark.read.parquet(path)


@query("k14_export_search_trials")
def k14_export_search_trials(spark, sf):
    """The best complete trials of the search's stored trial table."""
    return md.export_top_trials(_stored(spark, _search(spark, sf)), 2, "k13_parameter_search")


SCAN_W = bl.weight_grid_1d(0.1, 1.0)
# Fold 4 has no rows, so its trials fail.
SCAN_TRIALS = [(i, str(fold), w) for i, (fold, w) in enumerate((f, w) for f in (1, 2, 3, 4) for w in SCAN_W)]


@query("k14_export_scanned_trials", fx.with_views("scores") + f""", t AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{f}', {w!r}e0)" for n, f, w in SCAN_TRIALS)}) t(number, fold, w)),
x AS (SELECT number, target_value, (1e0 - w) * s1 + w * s2 AS b FROM t JOIN scores ON CAST(scores.fold AS VARCHAR) = t.fold), """ + auc_sql("x", ["number"], "b") + """,
r AS (SELECT t.number, ROUND(roc_auc, 6) AS value, fold, w FROM t JOIN auc USING (number) WHERE roc_auc IS NOT NULL)
SELECT number, value, '{"source":"weight_scan","trial":' || number || ',"value":' || value || ',"params":{"fold":"' || fold || '","weight":"' || w || '"}}' AS config
FROM r ORDER BY value DESC, r.number LIMIT 5""")
def k14_export_scanned_trials(spark, sf):
    """The best complete trials of a stored weight scan, a trial per fold and weight; trials without rows fail."""
    scan = bl.scan_1d(fx.scores(spark, sf), "s1", "s2", "target_value", ["fold"], SCAN_W, pooled=False)
    drawn = spark.createDataFrame(SCAN_TRIALS, "number int, fold string, w double")
    done = drawn.join(scan.select(F.col("fold").cast("string").alias("fold"), "w", F.round("roc_auc", 6).alias("value")), ["fold", "w"], "left")
    state = F.when(F.col("value").isNotNull(), "COMPLETE").otherwise("FAIL").alias("state")
    params = F.to_json(F.struct("fold", F.col("w").alias("weight"))).alias("params")
    return md.export_top_trials(_stored(spark, done.select("number", "value", state, params)), 5, "weight_scan")


@query("k15_two_view_experiment")
def k15_two_view_experiment(spark, sf):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "overdraft_limit_max"]
    o = fx.offers(spark, sf).withColumn("row_key", F.concat_ws(":", *[F.col(c).cast("string") for c in key]))
    o = ctx.context_features(o, ["l_orderkey"], fx.OFFER_COLS)
    numeric = [c for c in o.columns if c in fx.OFFER_COLS or "context" in c]
    absolute, relative = split_feature_space(numeric, fx.OFFER_COLS)
    spec = splits.fold_spec(o, "decision_day", ("1995-01-01", "1996-01-01", "1997-01-01"))
    # Both views read one stored table, which holds no other column.
    feats, _ = md.tree_features(o, numeric, ["l_linestatus"])
    feats = md.store_rows(feats.select("row_key", "decision_day", "target_value", *[f"f_{c}" for c in numeric], "k_l_linestatus"), ["row_key"])
    preds = {}
    for name, cols in (("absolute", absolute), ("context", relative)):
        p, _ = md.evaluate_folds(feats, "decision_day", spec, [f"f_{c}" for c in cols], ["l_linestatus"], GBT, SEED, id_cols=["row_key"], stored=True)
        preds[name] = p
    # Score sets joined on their keys (F01/F12), then a rank blend scan per fold.
    a = preds["absolute"].select("row_key", "fold", "target_value", F.col("prediction").alias("p_abs"))
    b = preds["context"].select("row_key", "fold", F.col("prediction").alias("p_ctx"))
    # Ranks, correlations and the scan read the joined scores many times: stored without their keys.
    j = cut_lineage(bl.join_predictions(a, b, ["row_key", "fold"], one_to_one=True).drop("row_key"))
    j = bl.rank_normalize(j, "p_abs", "r_abs", ["fold"])
    j = bl.rank_normalize(j, "p_ctx", "r_ctx", ["fold"])
    corr = metrics.correlations(j, "p_abs", "p_ctx", ["fold"], "r_abs", "r_ctx").select(F.col("fold").alias("__f"), "pearson", "spearman")
    scan = bl.scan_1d(j, "r_abs", "r_ctx", "target_value", ["fold"], bl.weight_grid_1d(0.25, 1.0))
    return scan.join(corr, scan["fold"] == corr["__f"], "left").drop("__f")


@query("k16_within_day_ranking")
def k16_within_day_ranking(spark, sf):
    tr, _ = _train_test(spark, sf)
    filled = tr.select("front_id", "decision_day", "target_value", *CAT,
                       *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in NUM])
    dc = md.day_centered(filled, "decision_day", NUM)
    feats, ncols = md.tree_features(dc, [f"dc_{c}" for c in NUM], CAT)
    _, m = md.evaluate_folds(feats, "decision_day", _fold_spec(tr), ncols, CAT, {"model_type": "logreg", "iterations": 30}, SEED)
    return m


PAIR_SQL = fx.with_views("apps") + """, r AS (SELECT front_id, decision_day, target_value AS y, (front_id * 7919 % 1000 + 150 * target_value) / 512e0 AS s FROM apps WHERE is_test = 0),
p AS (SELECT a.decision_day, a.front_id AS i, b.front_id AS j, GREATEST(0e0, 1e0 - (a.s - b.s)) AS m FROM r a JOIN r b ON a.decision_day = b.decision_day AND a.y = 1 AND b.y = 0),
g AS (SELECT i AS front_id, -2e0 * SUM(m) AS slope FROM p GROUP BY i UNION ALL SELECT j, 2e0 * SUM(m) FROM p GROUP BY j),
l AS (SELECT i AS front_id, SUM(m * m) AS loss, COUNT(*) AS n FROM p GROUP BY i)
SELECT r.front_id, COALESCE(g.slope, 0e0) + 0e0 AS pair_slope, COALESCE(l.loss, 0e0) AS pair_loss, CAST(COALESCE(l.n, 0) AS BIGINT) AS pairs
FROM r LEFT JOIN g USING (front_id) LEFT JOIN l USING (front_id)"""


@query("k16_pair_slopes", PAIR_SQL)
def k16_pair_slopes(spark, sf):
    """Loss and gradient of all same-day pairs at a given score, from prefix sums; the SQL makes the pairs."""
    tr, _ = _train_test(spark, sf)
    # Multiples of 2 ** -9: all sums are exact, in any order.
    s = (F.col("front_id") * 7919 % 1000 + 150 * F.col("target_value")).cast("double") / F.lit(512.0)
    scored = tr.select("front_id", "decision_day", "target_value", s.alias("s"))
    # Days of more than 8 rows are split here, so both ways are compared with the SQL.
    got = pw.pair_slopes(scored, ["decision_day"], "target_value", "s", pw.hot_groups(scored, ["decision_day"], 8))
    return got.select("front_id", (F.col("pair_slope") + 0.0).alias("pair_slope"), "pair_loss", F.col("pairs").cast("long").alias("pairs"))


@query("k16_pairwise_time_folds")
def k16_pairwise_time_folds(spark, sf):
    """A pairwise ranker per time fold: AUC and within-day AUC of the valid rows."""
    tr, _ = _train_test(spark, sf)
    _, m = md.rank_folds(tr, "decision_day", _fold_spec(tr), NUM, CAT)
    return m


@query("k16_pairwise_score_facts", FOLD_FACTS_SQL)
def k16_pairwise_score_facts(spark, sf):
    """Facts of the fold scores of the pairwise ranker."""
    tr, _ = _train_test(spark, sf)
    preds, _ = md.rank_folds(tr, "decision_day", _fold_spec(tr), NUM, CAT, iterations=3)
    return score_facts(preds, ["fold"])


@query("k17_attribution_sample")
def k17_attribution_sample(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    cut = F.lit("2000-01-01").cast("date")
    fit, hold = feats.filter(F.col("decision_day") < cut), feats.filter(F.col("decision_day") >= cut)
    model = md.fit_model(fit, ncols, CAT, GBT, SEED)
    return md.substitution_attribution(model, hold, ncols, md.medians(fit, ncols), "front_id")


def _fold3_attributions(spark, sf, cfg, n=None):
    """Attributions of the third fold's model on (``n`` sampled) rows of its holdout, and the feature names."""
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    cut = F.lit(fx.FOLD_CUTOFFS[2]).cast("date")
    fit, hold = feats.filter(F.col("decision_day") < cut), feats.filter(F.col("decision_day") >= cut)
    model = md.fit_model(fit, ncols, CAT, cfg, SEED)
    return tp.path_attributions(model, hold if n is None else splits.seeded_sample(hold, "front_id", n, SEED))


HOLDOUT_ROWS_SQL = fx.with_views("apps") + f"""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT front_id) AS n_ids, COUNT(*) AS n_additive, CAST(0 AS BIGINT) AS n_all_zero
FROM apps WHERE is_test = 0 AND decision_day >= DATE '{fx.FOLD_CUTOFFS[2]}'"""


def _attribution_facts(rows):
    """Rows, ids, rows whose attributions and base add up to their raw score, and rows without any attribution."""
    whole = F.aggregate("attribution", F.col("base"), lambda a, v: a + v)
    size = F.aggregate("attribution", F.lit(0.0), lambda a, v: a + F.abs(v))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("front_id").alias("n_ids"),
                    F.count_if(F.abs(whole - F.col("raw_score")) < 1e-9).alias("n_additive"), F.count_if(size == 0).alias("n_all_zero"))


@query("e36_path_attribution")
def e36_path_attribution(spark, sf):
    """Exact additive attributions of a boosted model on all holdout rows, summed up by feature."""
    return tp.attribution_summary(*_fold3_attributions(spark, sf, GBT))


@query("e36_path_attribution_facts", HOLDOUT_ROWS_SQL)
def e36_path_attribution_facts(spark, sf):
    """Every holdout row's attributions add up to its raw score (boosted trees)."""
    return _attribution_facts(_fold3_attributions(spark, sf, GBT)[0])


@query("e36_forest_attribution_facts", HOLDOUT_ROWS_SQL)
def e36_forest_attribution_facts(spark, sf):
    """The same for a random forest's probability."""
    return _attribution_facts(_fold3_attributions(spark, sf, {"model_type": "rf", "n_estimators": 10, "depth": 5, "min_samples_leaf": 20})[0])


@query("k17_path_attribution_sample")
def k17_path_attribution_sample(spark, sf):
    """Attributions of fold 3's model on 3,000 sampled holdout rows, by feature."""
    return tp.attribution_summary(*_fold3_attributions(spark, sf, GBT, 3000))


def _fold_features(tr, spec, nums):
    """All category columns with statistics of ``nums`` and target encodings, for the train and valid rows of all folds."""
    days, centre = fe.day_stats(tr, CAT, nums, "decision_day", "target_value")
    stats = fe.fold_stats(days, centre, spec, "decision_day", 20)
    # Each fold has its own copy of a row: only the columns that are read go along.
    rows = tr.select("front_id", "decision_day", "target_value", *NUM, *CAT)
    member = splits.drop_empty_folds(splits.assign_folds(rows, "decision_day", spec))
    return fe.add_fold_features(member, stats, CAT, nums, CAT, "target_value", "front_id")


@query("k18_foldsafe_feature_model")
def k18_foldsafe_feature_model(spark, sf):
    """Segment statistics and target encodings of every category column, made for all folds at once; a model per fold."""
    tr, _ = _train_test(spark, sf)
    made = _fold_features(tr, _fold_spec(tr), ["loan_amount_last", "balance_amt"])
    feats, ncols = _features(made, [c for c in made.columns if "__" in c])
    # Rows times folds, of which the fits read these columns; as a packed table, most of whose columns have a value per category.
    path = scratch_path(spark, f"fold-features-{uuid.uuid4().hex[:12]}")
    feats.select("front_id", "fold", "role", "target_value", *ncols, *[f"k_{c}" for c in CAT]).write.partitionBy("fold").parquet(path)
    feats = spark.read.parquet(path)
    out = None
    for f in sorted(r.fold for r in feats.select("fold").distinct().collect()):
        own = feats.filter(F.col("fold") == f)
        pred, _ = md.fit_score(own.filter("role = 'train'"), own.filter("role = 'valid'"), ncols, CAT, GBT, SEED, carry=["target_value"])
        pred = cut_lineage(pred.withColumn("fold", F.lit(str(f))))
        out = pred if out is None else out.unionByName(pred)
    # The scores are stored; nothing reads the features again.
    remove_scratch(spark, path)
    return metrics.fold_auc(out, "target_value", "prediction", "fold")


def _all_folds_sql(window):
    start = f"c.cutoff - INTERVAL {window} DAY" if window else "DATE '1900-01-01'"
    return fx.with_views("apps") + f""", c(fold, cutoff) AS (VALUES (1, DATE '1999-01-01'), (2, DATE '1999-07-01'), (3, DATE '2000-01-01')),
fit AS (SELECT c.fold, a.* FROM apps a JOIN c ON a.is_test = 0 AND a.decision_day < c.cutoff AND a.decision_day >= {start}),
long AS (SELECT fold, 'db_group_last' AS column_name, db_group_last AS category, target_value, loan_amount_last, balance_amt FROM fit
  UNION ALL SELECT fold, 'fl_adminarea', fl_adminarea, target_value, loan_amount_last, balance_amt FROM fit)
SELECT fold, column_name, category, COUNT(*) AS rows, SUM(target_value) + 0e0 AS y,
  ROUND(CASE WHEN COUNT(loan_amount_last) >= 20 THEN AVG(loan_amount_last) + 31.4159e-6 END, 4) AS loan_amount_last__mean,
  ROUND(CASE WHEN COUNT(loan_amount_last) >= 20 THEN STDDEV_SAMP(loan_amount_last) + 31.4159e-6 END, 4) AS loan_amount_last__std,
  CASE WHEN COUNT(loan_amount_last) >= 20 THEN COUNT(loan_amount_last) END AS loan_amount_last__count,
  ROUND(CASE WHEN COUNT(balance_amt) >= 20 THEN AVG(balance_amt) + 31.4159e-6 END, 4) AS balance_amt__mean,
  ROUND(CASE WHEN COUNT(balance_amt) >= 20 THEN STDDEV_SAMP(balance_amt) + 31.4159e-6 END, 4) AS balance_amt__std,
  CASE WHEN COUNT(balance_amt) >= 20 THEN COUNT(balance_amt) END AS balance_amt__count
FROM long WHERE category IS NOT NULL GROUP BY fold, column_name, category"""


def _all_fold_stats(spark, sf, window):
    tr, _ = _train_test(spark, sf)
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS, window_days=window)
    days, centre = fe.day_stats(tr, CAT, ["loan_amount_last", "balance_amt"], "decision_day", "target_value")
    out = fe.fold_stats(days, centre, spec, "decision_day", 20)
    # Means of amounts in cents end in ties at many digits: both sides round a shifted value.
    return out.select(*[F.round(F.col(c) + 31.4159e-6, 4).alias(c) if c.endswith(("__mean", "__std")) else F.col(c) for c in out.columns])


@query("e14_e15_statistics_of_all_folds", _all_folds_sql(None))
def e14_e15_statistics_of_all_folds(spark, sf):
    """Segment statistics and target sums of every fold, added up from one table per category and day."""
    return _all_fold_stats(spark, sf, None)


@query("e14_i02_statistics_of_all_windows", _all_folds_sql(180))
def e14_i02_statistics_of_all_windows(spark, sf):
    """The same over the 180 days before each cutoff."""
    return _all_fold_stats(spark, sf, 180)


@query("i04_stratified_split", fx.with_views("apps") + """, c AS (SELECT target_value, COUNT(*) AS n FROM apps WHERE is_test = 0 GROUP BY target_value)
SELECT target_value, 1 AS is_train, CAST(CEIL(0.7 * n) AS BIGINT) AS n_rows FROM c
UNION ALL SELECT target_value, 0, CAST(n - CEIL(0.7 * n) AS BIGINT) FROM c WHERE n - CEIL(0.7 * n) > 0""")
def i04_stratified_split(spark, sf):
    tr, _ = _train_test(spark, sf)
    s = splits.stratified_split(tr, "target_value", "front_id", SEED, 0.7)
    return s.groupBy("target_value", "is_train").agg(F.count(F.lit(1)).alias("n_rows"))


@query("i06_out_of_fold_predictions", fx.with_views("apps") + """SELECT is_test AS label_domain, COUNT(*) AS n_rows, COUNT(DISTINCT front_id) AS n_ids
FROM apps GROUP BY is_test""")
def i06_out_of_fold_predictions(spark, sf):
    tr, te = _train_test(spark, sf)
    cols = ["front_id", *NUM, *CAT]
    oof = md.oof_domain_scores(tr.select(*cols), te.select(*cols), "front_id", NUM, CAT, SEED, 3,
                               {"model_type": "gbt", "iterations": 5, "depth": 3})
    return oof.groupBy("label_domain").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("front_id").alias("n_ids"))


@query("i07_seeded_sample", fx.with_views("apps") + """SELECT LEAST(500, COUNT(*)) AS n_rows, LEAST(500, COUNT(*)) AS n_ids, TRUE AS same_again FROM apps WHERE is_test = 0""")
def i07_seeded_sample(spark, sf):
    """Size and distinct ids of the sample, and whether another partitioning draws the same one."""
    tr, _ = _train_test(spark, sf)
    one, two = (splits.seeded_sample(df, "front_id", 500, SEED).select("front_id") for df in (tr, tr.repartition(3)))
    h = F.sum(F.xxhash64("front_id").cast("decimal(38,0)"))
    return one.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("front_id").alias("n_ids"),
                   (h == two.select(h).scalar()).alias("same_again"))


@query("e35_feature_importance")
def e35_feature_importance(spark, sf):
    tr, _ = _train_test(spark, sf)
    feats, ncols = _features(tr)
    model = md.fit_model(feats, ncols, CAT, GBT, SEED)
    return spark.createDataFrame(md.importances(model), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
