"""Config-driven pipeline.

One JSON-like dict selects calendar columns, rate-limit, paired and context
offer features, missing flags, exclusions, sample weights, fold cutoffs and
the model; ``derive`` overrides keys of a base config.  A key that nothing
reads is an error at every level.  The features of each side are one lazy
plan.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalar as sc
from ..operators import splits
from ..operators import weights as wt
from ..operators.context import HOT_CONTEXT_ROWS, context_features, context_sizes
from ..operators.schema import check_aligned, feature_frame

#: What each level of a config may hold.
KNOWN_KEYS = {"seed", "id_col", "day_col", "target", "categorical", "cutoffs", "time_features", "feature_engineering",
              "excluded_features", "sample_weight", "model"}
TIME_KEYS = {"enabled", "include_day_num", "include_month", "include_dayofweek", "include_week", "include_cyclic_doy", "include_cyclic_woy"}
FEATURE_KEYS = {"enabled", "add_rate_limit_features", "add_pairwise_features", "add_context_offer_features",
                "add_same_day_context_offer_features", "add_missing_flags", "offer_columns", "context_columns"}
WEIGHT_KEYS = {
    None: {"enabled"},
    "linear_recency": {"min_weight", "max_weight"},
    "exponential_recency": {"half_life_days", "min_weight"},
    "recent_period_boost": {"cutoff", "recent_weight", "older_weight"},
    "adversarial_file": set(),
}
MODEL_KEYS = {
    "gbt": {"iterations", "depth", "learning_rate", "subsample", "min_data_in_leaf", "max_bins", "early_stopping"},
    "rf": {"n_estimators", "depth", "min_samples_leaf", "max_features", "max_bins"},
    "mlp": {"layers", "iterations", "learning_rate"},
    "logreg": {"iterations", "l2"},
}

# The offer terms that context features compare.
OFFER_COLUMNS = ["offered_rate", "overdraft_limit_min", "overdraft_limit_max"]


def _only(part: str, given: dict, known: set) -> None:
    unknown = set(given) - known
    if unknown:
        raise ValueError(f"unknown keys in {part}: {sorted(unknown)}")


def load_config(text_or_dict: str | dict) -> dict:
    """Parse (JSON text or dict) and validate every level once."""
    cfg = json.loads(text_or_dict) if isinstance(text_or_dict, str) else copy.deepcopy(text_or_dict)
    _only("config", cfg, KNOWN_KEYS)
    for k in ("id_col", "day_col", "target"):
        if k not in cfg:
            raise ValueError(f"config needs {k}")
    bad = {cfg["id_col"], cfg["target"]} & set(cfg.get("excluded_features", []))
    if bad:
        raise ValueError(f"excluded_features must not name {sorted(bad)}")
    _only("time_features", cfg.get("time_features", {}), TIME_KEYS)
    _only("feature_engineering", cfg.get("feature_engineering", {}), FEATURE_KEYS)
    weight = cfg.get("sample_weight") or {}
    strategy = weight.get("strategy")
    if strategy not in WEIGHT_KEYS:
        raise ValueError(f"Unsupported sample weight strategy: {strategy}")
    _only("sample_weight", weight, {"enabled", "strategy", "normalize_mean"} | WEIGHT_KEYS[strategy])
    model = cfg.get("model") or {}
    kind = model.get("model_type", "gbt")
    if kind not in MODEL_KEYS:
        raise ValueError(f"unknown model_type {kind}")
    _only("model", model, {"model_type", "class_weight", "clip"} | MODEL_KEYS[kind])
    return cfg


def derive(base: dict, overrides: dict) -> dict:
    """A config derived by overriding (nested) keys of ``base``."""
    out = copy.deepcopy(base)

    def merge(a, b):
        for k, v in b.items():
            if isinstance(v, dict) and isinstance(a.get(k), dict):
                merge(a[k], v)
            else:
                a[k] = copy.deepcopy(v)

    merge(out, overrides)
    return load_config(out)


def _calendar(day: str, fit: DataFrame, tcfg: dict) -> list:
    if not tcfg.get("enabled", True):
        return []
    cyc = [c.alias(n) for c, n in zip(cal.cyclic(day), ("doy_sin", "doy_cos", "woy_sin", "woy_cos"))]
    offered = {
        "include_day_num": lambda: [cal.day_number(day, fit).alias("day_num")],
        "include_month": lambda: [cal.year_month(day).alias("month")],
        "include_dayofweek": lambda: [cal.weekday0(day).alias("dayofweek")],
        "include_week": lambda: [cal.iso_week(day).alias("week")],
        "include_cyclic_doy": lambda: cyc[:2],
        "include_cyclic_woy": lambda: cyc[2:],
    }
    return [c for key, make in offered.items() if tcfg.get(key) for c in make()]


def _paired(side: DataFrame, fe: dict, specs: Sequence[tuple[str, str, str, str]]) -> list:
    """Rate-limit and activity pairs plus the limit midpoint, by the config's switches."""
    wanted = list(sc.RATE_LIMIT_SPECS) if fe.get("add_rate_limit_features") else []
    pairwise = fe.get("add_pairwise_features", True)
    if pairwise:
        wanted += list(specs) or sc.RATE_LIMIT_SPECS + sc.ACTIVITY_SPECS
    cols = sc.paired_features(side.columns, wanted)
    limits = ("overdraft_limit_min", "overdraft_limit_max")
    if (pairwise or fe.get("add_rate_limit_features")) and set(limits) <= set(side.columns):
        amount = "loan_amount_last" in side.columns
        cols += sc.midpoint_features(*limits, "loan_amount_last" if amount else limits[0])[: 2 if amount else 1]
    return cols


def build_features(train: DataFrame, test: DataFrame, cfg: dict,
                   specs: Sequence[tuple[str, str, str, str]] = ()) -> tuple[DataFrame, DataFrame, list, list]:
    """Features for both sides from one config: calendar columns (origin =
    first train day), rate-limit and paired features, offer features within
    the context and within the context's day, missing flags (only for columns
    with a missing value on either side), then the drops of B01.

    A context is the tuple of all given feature columns but the offer terms,
    or of ``context_columns``.  Returns (train_x, test_x, feature names,
    manifest entries); the id and target stay as columns so rows can be
    joined back."""
    cfg = load_config(cfg)
    idc, day, y = cfg["id_col"], cfg["day_col"], cfg["target"]
    cats = list(cfg.get("categorical", []))
    excluded = set(cfg.get("excluded_features", []))
    fe = cfg.get("feature_engineering", {})
    fe = fe if fe.get("enabled") else {"add_pairwise_features": False, "add_missing_flags": False}
    offers = list(fe.get("offer_columns", OFFER_COLUMNS))
    calendar = _calendar(day, train, cfg.get("time_features", {}))
    sides = []
    for side in (train, test):
        given = [c for c in side.columns if c not in (idc, day, y) and c not in excluded]
        made = side.select("*", *calendar, *_paired(side, fe, specs))
        calendar_names = [c for c in made.columns[len(side.columns):][: len(calendar)]]
        # The context is what the row was given, calendar included; derived columns stay out.
        context = list(fe.get("context_columns") or [c for c in [*given, *calendar_names] if c not in offers])
        dealt = False
        for switch, tag, keys in (("add_context_offer_features", "context", context), ("add_same_day_context_offer_features", "same_day_context", [*context, day])):
            if fe.get(switch):
                absent = [c for c in (*offers, *keys) if c not in made.columns]
                if absent:
                    raise ValueError(f"{switch} needs columns {absent}")
                keys = list(dict.fromkeys(keys))
                calm = tag == "context" and context_sizes(made, keys)[1] <= HOT_CONTEXT_ROWS
                made = context_features(made, keys, offers, tag, flags=tag == "same_day_context", dealt=dealt)
                # Without hot contexts the same-day ones lie within the tasks of the first.
                dealt = calm
        sides.append(made)
    tr, te = sides
    base = [c for c in tr.columns if c not in (idc, y, day, *cats, *excluded) and not c.endswith("_is_missing")]
    if fe.get("add_missing_flags", True):
        flagged = sc.missing_flag_columns([tr, te], base)
        tr = tr.select("*", *[sc.missing_flag(c) for c in flagged])
        te = te.select("*", *[sc.missing_flag(c) for c in flagged])
    # The id and target stay only as keys; the day and exclusions go.
    keep = [c for c in feature_frame(tr, idc, y, drop=sorted({day, *excluded})).columns]
    check_aligned(tr.select(*keep), te.select(*keep))
    manifest = []
    for c in train.columns:
        role = "id" if c == idc else "target" if c == y else "date" if c == day else "categorical" if c in cats else "numeric"
        used = c in keep
        manifest.append((c, role, used, c if used else "", "" if used else "excluded"))
    for c in keep:
        if c not in train.columns:
            manifest.append((c, "derived", True, c, "label-free derived feature"))
    return tr.select(idc, y, *keep), te.select(idc, *keep), keep, manifest


def train_weights(train: DataFrame, cfg: dict, weight_file: DataFrame | None = None, out: str = "sample_weight") -> DataFrame | None:
    """(id, weight) of the train rows from the config (J01-J05); None when disabled."""
    cfg = load_config(cfg)
    made = wt.sample_weights(train, cfg["day_col"], cfg.get("sample_weight"), cfg["id_col"], weight_file, out)
    return None if made is None else made.select(cfg["id_col"], out)


def weights_per_fold(train: DataFrame, cfg: dict, weight_file: DataFrame | None = None) -> DataFrame:
    """Per fold of the config's cutoffs: train rows, sum, smallest and largest weight of its train side."""
    cfg = load_config(cfg)
    day = cfg["day_col"]
    made = wt.sample_weights(train, day, cfg.get("sample_weight"), cfg["id_col"], weight_file)
    made = train.withColumn("sample_weight", F.lit(1.0)) if made is None else made
    member = splits.assign_folds(made, day, splits.fold_spec(train, day, cfg["cutoffs"]))
    return splits.drop_empty_folds(member).filter("role = 'train'").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sample_weight").alias("w_sum"),
        F.min("sample_weight").alias("w_min"), F.max("sample_weight").alias("w_max"))


def run_config(train: DataFrame, test: DataFrame, cfg: dict, specs: Sequence[tuple[str, str, str, str]] = (),
               weight_file: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole run a config describes: features, weights, one fit per time
    fold, a refit on all train rows and scores of the test rows.  Returns
    ``fold_metrics``, ``valid_predictions``, ``test_predictions`` and
    ``feature_manifest``."""
    from ..sources.sinks import feature_manifest
    from . import models as md

    cfg = load_config(cfg)
    if not cfg.get("cutoffs"):
        raise ValueError("config needs cutoffs")
    idc, day, y, seed = cfg["id_col"], cfg["day_col"], cfg["target"], int(cfg.get("seed", 42))
    tr_x, te_x, names, manifest = build_features(train, test, cfg, specs)
    cats = [c for c in names if c in cfg.get("categorical", []) or dict(tr_x.dtypes)[c] == "string"]
    numeric = [c for c in names if c not in cats]
    ftr, ncols = md.tree_features(tr_x.join(train.select(idc, F.col(day).alias("__day")), idc), numeric, cats)
    fte, _ = md.tree_features(te_x, numeric, cats)
    weights = train_weights(train, cfg, weight_file, "__w")
    if weights is not None:
        ftr = ftr.join(weights, idc)
    weight_col = None if weights is None else "__w"
    model = cfg.get("model") or {}
    spec = splits.fold_spec(train, day, cfg["cutoffs"])
    ftr = md.store_rows(ftr, (idc,))
    valid, metrics = md.evaluate_folds(ftr, "__day", spec, ncols, cats, model, seed, y, weight_col, id_cols=(idc,), stored=True)
    scored = md.refit_and_score(ftr, fte, ncols, cats, model, seed, y, weight_col, id_cols=(idc,))
    return {"fold_metrics": metrics, "valid_predictions": valid, "test_predictions": scored,
            "feature_manifest": feature_manifest(train.sparkSession, manifest)}
