"""Model jobs on Spark ML.

The feature table is one lazy plan, stored once (reliable checkpoint) before
a loop of fits; a fold's train and valid rows are date filters on it, so no
row is held twice.  Only the model fits loop on the driver (one Spark ML job
per fit, distributed over the data); every metric is a grouped
:func:`metrics.auc_table` over one long predictions table keyed by
(scope, fold), whose parts are cut from their lineage fold by fold.

Tree learners here are Spark ML's, so scores differ from the reference's
libraries; checks are invariants (AUC in [0, 1], every row scored once, no
NaN, a planted signal beats a constant).
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categorical import normalize
from ..functions.scalar import clip, positive_class_score
from ..operators import splits
from ..operators.drift import exact_quantiles
from ..operators.extra_trees import ExtraTreesClassifier
from ..operators.metrics import auc_table
from ..operators.network import fit_networks, network_score
from ..operators.pairwise import by_model, fit_pairwise, within_group_auc
from ..operators.weights import class_balance
from ..session import cut_lineage

#: Fits whose jobs run side by side.
PARALLEL_FITS = 3
SENTINEL = -1e12  # below every real value: trees reject NaN, a sentinel keeps "missing" separable


# Feature preparation ---------------------------------------------------------

def tree_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric columns with missing -> sentinel, categories normalised (C20);
    returns the frame and the list of numeric input columns."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)).alias(f"f_{c}") for c in numeric]
    cats = [normalize(c).alias(f"k_{c}") for c in categorical]
    keep = [c for c in df.columns if c not in (*numeric, *categorical)]
    return df.select(*keep, *cols, *cats), [f"f_{c}" for c in numeric]


#: Categories a column may have as a dictionary; a longer one is coded by frequency.
MAX_ARITY = 200


def assembler_stages(num_cols: Sequence[str], categorical: Sequence[str]) -> list:
    """C23 + assembly: shared category dictionary (unseen -> extra code) and
    one feature vector."""
    # One indexer for all columns: their values are counted in one pass.
    idx = [StringIndexer(inputCols=[f"k_{c}" for c in categorical], outputCols=[f"i_{c}" for c in categorical], handleInvalid="keep",
                         stringOrderType="alphabetAsc")] if categorical else []
    vec = VectorAssembler(inputCols=[*num_cols, *[f"i_{c}" for c in categorical]], outputCol="features",
                          handleInvalid="keep")
    return [*idx, vec]


def model_factory(cfg: dict, seed: int, weight_col: str | None = None, arity: int = 0) -> Estimator:
    """Model factory (K01-K04): ``cfg['model_type']`` picks the Spark ML estimator
    (:func:`extra_trees` makes the others).
    Trees get at least ``arity`` bins, the longest category dictionary."""
    kind = cfg.get("model_type", "gbt")
    common = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    bins = max(int(cfg.get("max_bins", 64)), arity)
    if kind == "gbt":
        m = GBTClassifier(maxIter=int(cfg.get("iterations", 20)), maxDepth=int(cfg.get("depth", 4)),
                          stepSize=float(cfg.get("learning_rate", 0.1)), subsamplingRate=float(cfg.get("subsample", 1.0)),
                          minInstancesPerNode=int(cfg.get("min_data_in_leaf", 1)), maxBins=bins, **common)
    elif kind == "rf":
        m = RandomForestClassifier(numTrees=int(cfg.get("n_estimators", 40)), maxDepth=int(cfg.get("depth", 7)),
                                   minInstancesPerNode=int(cfg.get("min_samples_leaf", 1)),
                                   featureSubsetStrategy=cfg.get("max_features", "sqrt"), maxBins=bins, **common)
    elif kind == "mlp":
        if weight_col:
            raise ValueError("this network has no weight parameter; network_folds fits weighted ones")
        m = MultilayerPerceptronClassifier(layers=list(cfg["layers"]), maxIter=int(cfg.get("iterations", 50)),
                                           stepSize=float(cfg.get("learning_rate", 0.03)), **common)
    elif kind == "logreg":
        m = LogisticRegression(maxIter=int(cfg.get("iterations", 50)), regParam=float(cfg.get("l2", 0.0)),
                               featuresCol="features", labelCol="label")
    else:
        raise ValueError(f"no Spark ML estimator for model_type {kind}")
    if weight_col:
        m.setWeightCol(weight_col)
    return m


def extra_trees(cfg: dict, seed: int, weight_col: str | None = None) -> Estimator:
    """Extremely randomised trees, which Spark ML lacks."""
    return ExtraTreesClassifier(n_estimators=int(cfg.get("n_estimators", 40)), max_depth=int(cfg.get("depth", 7)),
                                min_samples_leaf=int(cfg.get("min_samples_leaf", 1)), min_samples_split=int(cfg.get("min_samples_split", 2)),
                                max_features=cfg.get("max_features", "sqrt"), seed=seed, weight_col=weight_col)


class FittedModel:
    """A fitted pipeline with the frequency codes of its long category columns."""

    def __init__(self, pipeline, codes: dict[str, DataFrame]):
        self.pipeline, self.codes = pipeline, codes

    @property
    def stages(self) -> list:
        return self.pipeline.stages

    @property
    def best_iteration(self) -> int | None:
        """Trees kept by a boosted model (after early stopping, if asked for)."""
        last = self.stages[-1]
        return last.getNumTrees if hasattr(last, "getNumTrees") else None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.code(df))

    def code(self, df: DataFrame) -> DataFrame:
        for c, freq in self.codes.items():
            df = df.join(freq, f"k_{c}", "left").withColumn(f"q_{c}", F.coalesce(f"q_{c}", F.lit(0.0)))
        return df


def fit_model(train: DataFrame, num_cols: Sequence[str], categorical: Sequence[str], cfg: dict, seed: int,
              label: str = "target_value", weight_col: str | None = None, valid: DataFrame | None = None,
              sizes: dict[str, int] | None = None) -> FittedModel:
    """Fit the assembler + estimator pipeline on ``train``.

    Category columns of up to ``MAX_ARITY`` values get a dictionary, and the
    trees as many bins; longer ones are coded by their frequency in
    ``train``.  ``cfg['class_weight']`` (balanced, sqrt) multiplies the
    sample weights; ``cfg['early_stopping']`` stops boosting when the loss on
    ``valid`` no longer falls.  ``sizes`` are the columns' numbers of values
    in ``train``, if they are known."""
    if sizes is None:
        sizes = train.agg(*[F.countDistinct(f"k_{c}").alias(c) for c in categorical]).first().asDict() if categorical else {}
    short = [c for c in categorical if sizes[c] <= MAX_ARITY]
    codes = {c: train.groupBy(f"k_{c}").agg(F.count(F.lit(1)).cast("double").alias(f"q_{c}")) for c in categorical if c not in short}
    rows = train
    if cfg.get("class_weight", "none") != "none":
        balance = class_balance(train, label, cfg["class_weight"])
        rows = rows.withColumn("__cw", balance * F.col(weight_col) if weight_col else balance)
        weight_col = "__cw"
    if cfg.get("model_type") == "extra_trees":
        est = extra_trees(cfg, seed, weight_col)
    else:
        est = model_factory(cfg, seed, weight_col, max((sizes[c] + 1 for c in short), default=0))
    if cfg.get("early_stopping"):
        if valid is None or not isinstance(est, GBTClassifier):
            raise ValueError("early_stopping needs a boosted model and valid rows")
        est.setValidationIndicatorCol("__valid")
        rows = rows.withColumn("__valid", F.lit(False)).unionByName(valid.withColumn("__valid", F.lit(True)), allowMissingColumns=True)
        if weight_col:
            rows = rows.fillna(1.0, subset=[weight_col])
    fitted = FittedModel(None, codes)
    stages = assembler_stages([*num_cols, *[f"q_{c}" for c in codes]], short)
    fitted.pipeline = Pipeline(stages=[*stages, est]).fit(fitted.code(rows).withColumn("label", F.col(label).cast("double")))
    return fitted


def fit_score(train: DataFrame, score: DataFrame, num_cols: Sequence[str], categorical: Sequence[str], cfg: dict,
              seed: int, label: str = "target_value", weight_col: str | None = None, id_cols: Sequence[str] = ("front_id",),
              carry: Sequence[str] = ()) -> tuple[DataFrame, FittedModel]:
    """Fit on ``train`` and score ``score`` (K02): (ids..., carry..., prediction)."""
    model = fit_model(train, num_cols, categorical, cfg, seed, label, weight_col, score if label in score.columns else None)
    return _scored(model, score, cfg, id_cols, carry), model


def _scored(model: FittedModel, score: DataFrame, cfg: dict, id_cols: Sequence[str], carry: Sequence[str]) -> DataFrame:
    return model.transform(score).select(*id_cols, *carry, positive_class_score("probability", float(cfg.get("clip", 0.0))).alias("prediction"))


def check_scores(pred: DataFrame, col: str = "prediction") -> None:
    """Raise on missing / NaN / infinite scores."""
    x = F.col(col)
    bad = pred.agg(F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).first()[0]
    if bad:
        raise ValueError(f"{bad} non-finite predictions")


# Fold jobs -------------------------------------------------------------------

#: Rows of a fit's task; more tasks would only cost their start in each of its many small jobs.
FIT_ROWS = 50_000
#: Fits of few tasks that run side by side, at most.
SMALL_FITS = 6


def _fit_tasks(spark, rows: int) -> int:
    """Tasks that ``rows`` need in a fit; fits run side by side, so one needn't use all cores."""
    return max(-(-spark.sparkContext.defaultParallelism // PARALLEL_FITS), -(-rows // FIT_ROWS))


def fits_at_once(spark, rows: int) -> int:
    """Fits on ``rows`` to run side by side: more of them if each has few tasks, which leave cores idle between their jobs."""
    return max(PARALLEL_FITS, min(SMALL_FITS, 2 * spark.sparkContext.defaultParallelism // _fit_tasks(spark, rows)))


def store_rows(df: DataFrame, id_cols: Sequence[str] = ("front_id",), rows: int | None = None) -> DataFrame:
    """Rows stored once for many fits, spread over all shuffle partitions; if
    there are known to be few ``rows``, over as many as these need, at least
    two a core."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        tasks = min(tasks, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FIT_ROWS)))
    return cut_lineage(df.repartition(tasks, *id_cols))


def _side_counts(feats: DataFrame, day: str, spec: list[dict], label: str) -> dict[tuple, tuple[int, bool]]:
    """(fold, role) -> rows and whether they hold two labels, for sides with rows: one row of sums."""
    aggs = []
    for i, s in enumerate(spec):
        for role in ("train", "valid"):
            side = splits.side_condition(day, s, role)
            y = F.when(side, F.col(label))
            aggs += [F.count_if(side).alias(f"n{i}{role}"), F.coalesce(F.min(y) != F.max(y), F.lit(False)).alias(f"k{i}{role}")]
    r = feats.agg(*aggs).first()
    return {(s["fold"], role): (r[f"n{i}{role}"], r[f"k{i}{role}"]) for i, s in enumerate(spec) for role in ("train", "valid") if r[f"n{i}{role}"]}


def _category_sizes(feats: DataFrame, day: str, spec: list[dict], categorical: Sequence[str]) -> list[dict[str, int]]:
    """Values of each category column in the train side of each fold: one pass
    over the rows for all folds, one row per column on the driver."""
    sides = [f"__s{i}" for i in range(len(spec))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"k_{c}").alias("value")) for c in categorical])).alias("__c")
    rows = feats.select(*[splits.side_condition(day, s, "train").alias(n) for n, s in zip(sides, spec)], each)
    seen = rows.filter(F.col("__c.value").isNotNull()).groupBy("__c").agg(*[F.max(n).alias(n) for n in sides])
    got = {r["name"]: r for r in seen.groupBy("__c.name").agg(*[F.count_if(F.col(n)).alias(n) for n in sides]).collect()}
    return [{c: got[c][n] if c in got else 0 for c in categorical} for n in sides]


def _fixed_days(spark, spec: list[dict]) -> list[dict]:
    """The spec with its days read once: a last day that is a subquery over
    the rows would run again in every job of a fold."""
    names = ("train_start", "cutoff", "valid_end")
    r = spark.range(1).select(*[s[n].alias(f"{n}{i}") for i, s in enumerate(spec) for n in names]).first()
    return [s | {n: F.lit(r[f"{n}{i}"]).cast("date") for n in names} for i, s in enumerate(spec)]


def evaluate_folds(df: DataFrame, day: str, spec: list[dict], num_cols: Sequence[str], categorical: Sequence[str],
                   cfg: dict, seed: int, label: str = "target_value", weight_col: str | None = None,
                   scope: str = "fold", id_cols: Sequence[str] = ("front_id",), stored: bool = False,
                   fits: dict | None = None, pool: ThreadPoolExecutor | None = None, few_tasks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fit per fold (or holdout), score its valid rows; returns the
    long predictions table and the metric table (per fold with its best
    iteration + pooled).

    ``stored`` says that ``df`` comes from :func:`store_rows`.  ``fits`` keeps
    the models by train side: calls on the same stored rows, columns and label
    that pass the same dict, one after the other, fit a train side they share once
    (early stopping reads the valid side, so its models are not kept).  Calls made
    side by side hand their fits to one ``pool`` of ``fits_at_once`` threads.
    ``few_tasks`` gives a fit as many tasks as its rows need; above 10,000 rows
    Spark ML's candidates for splits depend on the tasks."""
    spec = _fixed_days(df.sparkSession, spec)
    # Each fit reads the rows many times; columns that it doesn't read are not stored.
    read = dict.fromkeys([*id_cols, day, label, *([weight_col] if weight_col else []), *num_cols, *[f"k_{c}" for c in categorical]])
    feats = df if stored else store_rows(df.select(*read), id_cols)
    got = _side_counts(feats, day, spec, label)
    usable = []
    for s in spec:
        f = s["fold"]
        if (f, "train") not in got or (f, "valid") not in got:
            if scope == "holdout":
                raise ValueError(f"empty split for holdout {f}")
            continue  # rolling folds skip empty folds (M08)
        if scope == "holdout" and not got[(f, "valid")][1]:
            raise ValueError(f"holdout {f} has one class")
        usable.append(s)
    if not usable:
        raise ValueError("no usable fold")
    known = {} if fits is None or cfg.get("early_stopping") else fits
    side_of = lambda s: (str(s["train_start"]), str(s["cutoff"]), seed, json.dumps(cfg, sort_keys=True))
    new = [s for s in usable if side_of(s) not in known]
    sizes = {s["fold"]: n for s, n in zip(new, _category_sizes(feats, day, new, categorical))} if categorical and new else {}

    def side_rows(s, role):
        rows = feats.filter(splits.side_condition(day, s, role))
        return rows.coalesce(_fit_tasks(feats.sparkSession, got[(s["fold"], role)][0])) if few_tasks else rows

    def run_fold(s):
        f = str(s["fold"])
        tr, va = (side_rows(s, role) for role in ("train", "valid"))
        side = side_of(s)
        if side not in known:
            known[side] = fit_model(tr, num_cols, categorical, cfg, seed, label, weight_col, va, sizes.get(s["fold"], {}))
        model = known[side]
        return cut_lineage(_scored(model, va, cfg, id_cols, [label]).withColumn(scope, F.lit(f))), (f, model.best_iteration)

    # Folds are independent: their jobs share the cluster.
    at_once = fits_at_once(feats.sparkSession, max(n for n, _ in got.values())) if few_tasks else PARALLEL_FITS
    with nullcontext(pool) if pool else ThreadPoolExecutor(at_once) as workers:
        done = list(workers.map(run_fold, usable))
    best = [b for _, b in done]
    parts = reduce(DataFrame.unionByName, [p for p, _ in done])
    # Scores of trees repeat: the AUCs read their counts, the pooled one as a fold more.
    counts = cut_lineage(parts.groupBy(scope, label, "prediction").agg(F.count(F.lit(1)).alias("__n")))
    pooled = counts.withColumn(scope, F.lit("OOF_TIME_HOLDOUT" if scope == "fold" else "POOLED"))
    aucs = auc_table(counts.unionByName(pooled), label, "prediction", [scope], count="__n").select(scope, "roc_auc", "n_rows", "n_pos")
    kept = feats.sparkSession.createDataFrame(best, f"{scope} string, best_iteration int")
    # A row per fold, stored: reports read it more than once.
    return parts, cut_lineage(aucs.join(kept, scope, "left"))


def holdout_summary(metrics: DataFrame, scope: str = "holdout") -> DataFrame:
    """K05 tail: per-holdout AUCs plus MEAN / STD (population) / MIN."""
    body = metrics.filter(F.col(scope) != "POOLED").select(scope, "roc_auc")
    s = body.agg(F.avg("roc_auc").alias("MEAN"), F.stddev_pop("roc_auc").alias("STD"), F.min("roc_auc").alias("MIN"))
    return body.unionByName(s.unpivot([], ["MEAN", "STD", "MIN"], scope, "roc_auc"))


def refit_and_score(train: DataFrame, test: DataFrame, num_cols, categorical, cfg, seed, label="target_value",
                    weight_col=None, id_cols: Sequence[str] = ("front_id",)) -> DataFrame:
    """Refit on all train rows (all iterations), score test, clip to
    [0, 1], finite check; a missing score stays missing in the clip and fails
    the check."""
    cfg = {k: v for k, v in cfg.items() if k != "early_stopping"}
    pred, _ = fit_score(train, test.drop(label), num_cols, categorical, cfg, seed, label, weight_col, id_cols=id_cols)
    pred = cut_lineage(pred.withColumn("prediction", clip("prediction", 0.0, 1.0)))
    check_scores(pred)
    return pred


def importances(model: FittedModel) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, in vector order."""
    names = next(st for st in model.stages if isinstance(st, VectorAssembler)).getInputCols()
    return [(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]


# Drift models ------------------------------------------------------------------

def _drift_rows(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], seed: int, id_col: str) -> DataFrame:
    """Both sides with their stratified 70/30 split (I04), stored for the fits."""
    from ..operators.profile import tagged_union

    cols = [id_col, *numeric, *categorical]
    both = tagged_union(train.select(*cols), test.select(*cols), "label_domain")
    both = both.withColumn("__key", F.concat_ws(":", F.col("label_domain").cast("string"), F.col(id_col).cast("string")))
    split = splits.stratified_split(both, "label_domain", "__key", seed, 0.7, "is_fit")
    return cut_lineage(tree_features(split.drop("__key"), numeric, categorical)[0])


def _drift_fit(feats: DataFrame, numeric: Sequence[str], categorical: Sequence[str], seed: int, id_col: str, cfg: dict | None) -> tuple[DataFrame, DataFrame]:
    from ..operators.drift import score_summary

    cfg = cfg or {"model_type": "rf", "n_estimators": 30, "depth": 7, "min_samples_leaf": 20}
    fit, val = feats.filter("is_fit = 1"), feats.filter("is_fit = 0")
    pred, model = fit_score(fit, val, [f"f_{c}" for c in numeric], categorical, cfg, seed, "label_domain", id_cols=[id_col], carry=["label_domain"])
    pred = cut_lineage(pred)
    auc = auc_table(pred, "label_domain", "prediction").select("roc_auc", "n_rows")
    summ = score_summary(pred, "label_domain", "prediction")
    imps = feats.sparkSession.createDataFrame(importances(model), "feature string, importance double")
    metrics = summ.withColumn("holdout_auc", auc.select("roc_auc").scalar())
    return metrics, imps.orderBy(F.desc("importance"), "feature")


def drift_forest(train: DataFrame, test: DataFrame, cols: Sequence[str], numeric: Sequence[str],
                 categorical: Sequence[str], seed: int, id_col: str, cfg: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Train-vs-test forest on a stratified 70/30 split (I04); returns
    (metrics: auc + score summary per label, importances E35)."""
    return _drift_fit(_drift_rows(train.select(id_col, *cols), test.select(id_col, *cols), numeric, categorical, seed, id_col),
                      numeric, categorical, seed, id_col, cfg)


def drift_forest_sets(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], categorical: Sequence[str], seed: int,
                      id_col: str, cfg: dict | None = None) -> DataFrame:
    """K09 for every named column list: metrics and importances by ``exclusion_set``.
    All lists share one split, which does not depend on their columns; equal
    lists share one fit; each name gets its rows."""
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    feats = _drift_rows(train, test, [c for c in every if c not in categorical], [c for c in every if c in categorical], seed, id_col)
    fits: dict[tuple[str, ...], tuple[DataFrame, DataFrame]] = {}
    out = None
    for name, cols in sets.items():
        if tuple(cols) not in fits:
            numeric, cats = [c for c in cols if c not in categorical], [c for c in cols if c in categorical]
            fits[tuple(cols)] = _drift_fit(feats, numeric, cats, seed, id_col, cfg)
        m, imp = fits[tuple(cols)]
        rows = m.withColumn("exclusion_set", F.lit(name)).unionByName(
            imp.select(F.lit(name).alias("exclusion_set"), "feature", "importance"), allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    return out


def oof_domain_scores(train: DataFrame, test: DataFrame, id_col: str, numeric, categorical, seed: int, k: int = 3,
                      cfg: dict | None = None) -> DataFrame:
    """K-fold out-of-fold domain probabilities for every row."""
    from ..operators.profile import tagged_union

    both = tagged_union(train, test, "label_domain")
    both = both.withColumn("__key", F.xxhash64(F.col("label_domain"), F.col(id_col), F.lit(seed)))
    folded = splits.stratified_kfold(both, "label_domain", ["__key", id_col], k, out="__k")
    feats, ncols = tree_features(folded, list(numeric), list(categorical))
    feats = cut_lineage(feats)
    cfg = cfg or {"model_type": "gbt", "iterations": 15, "depth": 4, "learning_rate": 0.1}
    parts = None
    for i in range(k):
        pred, _ = fit_score(feats.filter(F.col("__k") != i), feats.filter(F.col("__k") == i), ncols, categorical, cfg, seed,
                            "label_domain", id_cols=[id_col], carry=["label_domain"])
        pred = cut_lineage(pred)
        parts = pred if parts is None else parts.unionByName(pred)
    return parts


# Search ------------------------------------------------------------------------

def draw_trials(space: dict, n: int, seed: int) -> list[dict]:
    """Seeded random draws from a search space of
    {name: {type: int|float|categorical, low, high, step, log, choices, when}}.
    ``when`` = {earlier name: allowed values} makes a parameter conditional."""
    import math

    rng = random.Random(seed)
    out = []
    for t in range(n):
        p = {}
        for name, s in space.items():
            if any(p.get(k) not in allowed for k, allowed in s.get("when", {}).items()):
                continue
            kind = s["type"]
            if kind == "categorical":
                p[name] = rng.choice(s["choices"])
            elif kind == "int":
                lo, hi, step = int(s["low"]), int(s["high"]), int(s.get("step", 1))
                p[name] = lo + step * rng.randint(0, (hi - lo) // step)
            else:
                lo, hi = float(s["low"]), float(s["high"])
                p[name] = math.exp(rng.uniform(math.log(lo), math.log(hi))) if s.get("log") else rng.uniform(lo, hi)
        out.append({"number": t, **p})
    return out


def trial_table(spark, trials: list[dict], values: list[float | None], state: str = "COMPLETE") -> DataFrame:
    """Trials as rows (number, value, state, params_json)."""
    rows = [(t["number"], v, state if v is not None else "FAIL",
             json.dumps({k: v2 for k, v2 in t.items() if k != "number"}, sort_keys=True)) for t, v in zip(trials, values)]
    return spark.createDataFrame(rows, "number int, value double, state string, params string")


def export_top_trials(trials: DataFrame, k: int, source: str) -> DataFrame:
    """The ``k`` best complete trials as config JSON with
    source info; parameter text parsed back to typed JSON values."""
    ok = trials.filter((F.col("state") == "COMPLETE") & F.col("value").isNotNull())
    top = ok.orderBy(F.desc("value"), F.asc("number")).limit(k)
    return top.select("number", "value", F.to_json(F.struct(
        F.lit(source).alias("source"), F.col("number").alias("trial"), F.col("value").alias("value"),
        F.from_json("params", "map<string,string>").alias("params"))).alias("config"))


# Ranking -----------------------------------------------------------------------

def rank_features(fit: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, int]:
    """``df`` plus the array ``x``: numerics standardised on ``fit`` (missing
    at the approximate median), categories of up to ``MAX_ARITY`` values one-hot, longer ones by their
    standardised frequency; and its length."""
    # Two one-row reads; the numbers stand in the plan as literals.
    first = fit.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(f"m_{c}") for c in numeric],
                    *[F.countDistinct(c).alias(f"n_{c}") for c in categorical]).first()
    sizes = {c: first[f"n_{c}"] for c in categorical}
    whole = {c: F.coalesce(F.col(c).cast("double"), F.lit(first[f"m_{c}"] or 0.0)) for c in numeric}
    scale = fit.agg(*[f(v).alias(f"{k}_{c}") for c, v in whole.items() for k, f in (("avg", F.avg), ("std", F.stddev_pop))]).first()
    parts = [(v - F.lit(scale[f"avg_{c}"] or 0.0)) / F.lit(scale[f"std_{c}"] or 1.0) for c, v in whole.items()]
    filled = df
    for c in categorical:
        if sizes[c] <= MAX_ARITY:
            values = sorted(r[0] for r in fit.select(c).filter(F.col(c).isNotNull()).distinct().collect())
            parts += [F.when(F.col(c) == v, 1.0).otherwise(0.0) for v in values]
        else:
            freq = fit.groupBy(F.col(c).alias("__c")).agg(F.count(F.lit(1)).cast("double").alias(f"__n_{c}"))
            filled = filled.join(freq, F.col(c) == F.col("__c"), "left").drop("__c").fillna(0.0, subset=[f"__n_{c}"])
            parts.append(F.col(f"__n_{c}") / F.lit(float(fit.count())))
    return filled.withColumn("x", F.array(*parts)), len(parts)


def rank_folds(df: DataFrame, day: str, spec: list[dict], numeric: Sequence[str], categorical: Sequence[str], label: str = "target_value",
               id_col: str = "front_id", iterations: int = 8) -> tuple[DataFrame, DataFrame]:
    """A pairwise ranker per time fold, pairs within a day; returns the
    predictions (score through a logistic curve, so in [0, 1]) and, per fold
    and pooled, the AUC and the within-day AUC.  Statistics are those of the
    rows before the first cutoff, which every fold trains on."""
    fit = df.filter(F.col(day) < spec[0]["cutoff"])
    feats, n = rank_features(fit, df, numeric, categorical)
    # Stored once per row, not per fold.
    feats = cut_lineage(feats.select(id_col, day, label, "x"))
    member = splits.drop_empty_folds(splits.assign_folds(feats, day, spec))
    weights, _ = fit_pairwise(member.filter("role = 'train'"), "fold", day, "x", label, n, iterations)
    score = 1.0 / (1.0 + F.exp(-by_model(F.col("fold"), F.col("x"), weights)))
    preds = cut_lineage(member.filter("role = 'valid'").select(id_col, day, label, F.col("fold").cast("string").alias("fold"), score.alias("prediction")))
    per = auc_table(preds, label, "prediction", ["fold"]).select("fold", "roc_auc", "n_rows", "n_pos")
    within = within_group_auc(preds, ["fold"], day, label, "prediction")
    return preds, per.join(within, "fold", "left")


def network_folds(df: DataFrame, day: str, spec: list[dict], numeric: Sequence[str], categorical: Sequence[str], label: str = "target_value",
                  id_col: str = "front_id", weight_col: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """A weighted network per time fold, stopped by the loss on its valid
    rows; ``options`` as in :func:`network.fit_networks`.  Returns the
    predictions and, per fold and pooled, the AUC; per fold the best step, the
    steps run and the class weight.  Statistics are those of the rows before
    the first cutoff, which every fold trains on."""
    fit = df.filter(F.col(day) < spec[0]["cutoff"])
    feats, n = rank_features(fit, df, numeric, categorical)
    feats = store_rows(feats.select(id_col, day, label, "x", *([weight_col] if weight_col else [])), (id_col,))
    sides = {str(s["fold"]): (splits.side_condition(day, s, "train"), splits.side_condition(day, s, "valid")) for s in spec}
    nets = fit_networks(feats, sides, "x", label, n, weight_col, **options)
    member = splits.drop_empty_folds(splits.assign_folds(feats, day, spec)).filter("role = 'valid'")
    fold = F.col("fold").cast("string")
    preds = cut_lineage(member.select(id_col, day, label, fold.alias("fold"), network_score(fold, F.col("x"), nets).alias("prediction")))
    per = auc_table(preds, label, "prediction", ["fold"]).select("fold", "roc_auc", "n_rows", "n_pos")
    pooled = auc_table(preds, label, "prediction").select(F.lit("OOF_TIME_HOLDOUT").alias("fold"), "roc_auc", "n_rows", "n_pos")
    facts = df.sparkSession.createDataFrame([(f, v.best_step, v.steps_run, v.pos_weight) for f, v in nets.items()],
                                            "fold string, best_step int, steps_run int, pos_weight double")
    return preds, per.unionByName(pooled).join(facts, "fold", "left")


# Misc probes ---------------------------------------------------------------------

def day_centered(df: DataFrame, day: str, cols: Sequence[str]) -> DataFrame:
    """K16 (re-aimed): features minus their same-day mean, so a pointwise
    model learns the within-day order without emitting pairs."""
    means = df.groupBy(day).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    j = df.join(means, day, "left")
    return j.select(*df.columns, *[(F.col(c) - F.col(f"__m_{c}")).alias(f"dc_{c}") for c in cols])


def substitution_attribution(model, rows: DataFrame, feature_cols: Sequence[str], medians: dict[str, float],
                             id_col: str) -> DataFrame:
    """E36 (re-aimed): per feature, the score change when the feature is set
    to its fit median; all features in one exploded scoring job, then
    mean |change|, mean change, max |change|."""
    base = model.transform(rows).select(id_col, positive_class_score("probability").alias("__p0"))
    arr = F.explode(F.array(*[F.lit(c) for c in feature_cols])).alias("__feat")
    ex = rows.select("*", arr)
    for c in feature_cols:
        ex = ex.withColumn(c, F.when(F.col("__feat") == c, F.lit(float(medians[c]))).otherwise(F.col(c)))
    sub = model.transform(ex).select(id_col, "__feat", positive_class_score("probability").alias("__p1"))
    d = sub.join(base, id_col).withColumn("__d", F.col("__p1") - F.col("__p0"))
    return d.groupBy(F.col("__feat").alias("feature")).agg(
        F.avg(F.abs("__d")).alias("mean_abs"), F.avg("__d").alias("mean"), F.max(F.abs("__d")).alias("max_abs"))


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column: one prefix pass over all columns, one row each on the driver."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "x")
    return {r["column_name"]: r["quantile"] for r in exact_quantiles(long, ["column_name"], "x", [0.5]).collect()}


ModelFactory = Callable[[dict, int], Estimator]
