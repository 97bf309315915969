"""Statistics and encodings of all folds at once against one fold after the other."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import encoders as enc
from tidemark.operators import fold_encoders as fe
from tidemark.operators import splits
from tidemark.sources import fixtures as fx

CATS, NUMS = ["db_group_last", "fl_adminarea"], ["loan_amount_last", "balance_amt"]


@pytest.mark.parametrize("window", [None, 180])
def test_equal_to_one_fold_after_the_other(spark, window):
    tr = fx.train_apps(spark, SF_SMALL)
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS, window_days=window)
    days, centre = fe.day_stats(tr, CATS, NUMS, "decision_day", "target_value")
    member = splits.drop_empty_folds(splits.assign_folds(tr, "decision_day", spec))
    got = fe.add_fold_features(member, fe.fold_stats(days, centre, spec, "decision_day", 20), CATS, NUMS, CATS, "target_value", "front_id")
    rows = {(r.fold, r.role, r.front_id): r for r in got.collect()}
    assert len(rows) == member.count()
    for s in spec[-1:] if window else spec[:1]:
        fit, val = (tr.filter(splits.side_condition("decision_day", s, role)) for role in ("train", "valid"))
        fit_s, val_s = (enc.segment_stats(fit, df, CATS, NUMS, min_count=20) for df in (fit, val))
        fit_e, val_e = enc.foldsafe_target_encoding(fit_s, val_s, CATS, "target_value", 50.0, 5, order_cols=["front_id"])
        for role, want in (("train", fit_e), ("valid", val_e)):
            new = [c for c in want.columns if "__" in c]
            assert len(new) == 2 * 2 * 6 + 2 and set(new) <= set(got.columns)
            for r in want.select("front_id", *new).collect():
                mine = rows[s["fold"], role, r.front_id]
                for c in new:
                    assert (mine[c] is None) == (r[c] is None) and (r[c] is None or abs(mine[c] - r[c]) <= 1e-7 * max(1.0, abs(r[c]))), c


def test_day_table_is_read_once_for_all_folds(spark):
    tr = fx.train_apps(spark, SF_SMALL)
    days, centre = fe.day_stats(tr, CATS, NUMS, "decision_day", "target_value")
    spec = splits.holdout_spec(fx.HOLDOUT_CUTOFFS)
    plan = fe.fold_stats(days, centre, spec, "decision_day")._jdf.queryExecution().executedPlan().toString()
    # One exchange for the day table, one for the folds, two for the join of the fixture.
    assert plan.count("Exchange hashpartitioning") <= 4
    assert days.select(F.sum("rows")).first()[0] == sum(tr.filter(F.col(c).isNotNull()).count() for c in CATS)
