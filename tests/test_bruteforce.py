"""Exact AUC and average / ordinal ranks against brute force on small random
fixtures (ties, missing values, one-class groups), on both the single-task
and the bucketed paths."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import ranks
from tidemark.operators.metrics import auc_table


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    if not pos or not neg:
        return None
    win = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return win / (len(pos) * len(neg))


rows = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40)


@pytest.mark.parametrize("buckets", [2, 2048])
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_auc_matches_brute_force(spark, monkeypatch, buckets, data):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    df = spark.createDataFrame([(g, y, s / 3.0) for g, y, s in data], "g int, y int, s double")
    got = {r.g: r.roc_auc for r in auc_table(df, "y", "s", ["g"]).collect()}
    for g in {d[0] for d in data}:
        sub = [(y, s / 3.0) for gg, y, s in data if gg == g]
        want = brute_auc([y for y, _ in sub], [s for _, s in sub])
        if want is None:
            assert got[g] is None
        else:
            assert math.isclose(got[g], want, rel_tol=1e-12)


@settings(max_examples=12, deadline=None)
@given(data=st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=40))
def test_average_rank_matches_pandas(spark, data):
    rows_ = [(i, g, None if v is None else float(v)) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(rows_, "id int, g int, v double")
    got = {r.id: r.r for r in ranks.average_rank_pct(df, "v", "r", ["g"]).collect()}
    pdf = pd.DataFrame(rows_, columns=["id", "g", "v"])
    want = pdf.groupby("g")["v"].rank(method="average", pct=True)
    for i, w in zip(pdf["id"], want):
        if pd.isna(w):
            assert got[i] is None
        else:
            assert math.isclose(got[i], w, rel_tol=1e-12)


@settings(max_examples=10, deadline=None)
@given(data=st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=1, max_size=40))
def test_ordinal_rank_matches_pandas(spark, data):
    rows_ = [(i, None if v is None else float(v)) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows_, "id int, v double")
    got = {r.id: r.r for r in ranks.ordinal_rank_pct(df, "v", "id", "r").collect()}
    pdf = pd.DataFrame(rows_, columns=["id", "v"])
    want = pdf["v"].astype(float).rank(method="first", pct=True)
    for i, w in zip(pdf["id"], want):
        assert got[i] is None if pd.isna(w) else math.isclose(got[i], w, rel_tol=1e-12)


@settings(max_examples=10, deadline=None)
@given(data=st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=2, max_size=60))
def test_equal_count_bins_match_qcut(spark, data):
    missing = [i for i, v in enumerate(data) if v is None]
    rows_ = [(i, None if v is None else float(v)) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows_, "id int, v double")
    got = {r.id: r.b for r in ranks.equal_count_bins(df, "v", "id", "b", 16).collect()}
    assert all(got[i] is None for i in missing) and ranks.is_complete(df, "v") == (not missing)
    pdf = pd.DataFrame([r for r in rows_ if r[1] is not None], columns=["id", "v"])
    r = pdf["v"].rank(method="first")
    if len(pdf) >= 16:
        for i, w in zip(pdf["id"], pd.qcut(r, q=16, labels=False, duplicates="drop")):
            assert got[i] == int(w)
    assert all(0 <= b <= 15 for b in got.values() if b is not None)


@settings(max_examples=10, deadline=None)
@given(data=st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=40))
def test_prefix_sums_put_missing_last(spark, data):
    """Sum of ids below by (group; a, b) with missing values after all others."""
    df = spark.createDataFrame([(i, g, a, b) for i, (g, a, b) in enumerate(data)], "id int, g int, a int, b int")
    got = {r.id: r.id_before for r in ranks.prefix_sums(df, ["g"], ["a", "b"], ["id"]).collect()}
    key = [(99 if a is None else a, 99 if b is None else b) for _, a, b in data]
    for i, (g, _, _) in enumerate(data):
        assert got[i] == sum(j for j, (h, _, _) in enumerate(data) if h == g and key[j] < key[i])


def test_position_is_a_monotone_count(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (float("inf"),), *[(x * x / 7.0,) for x in range(5000)]], "x double")
    got = ranks.with_buckets(df, "x").select("x", F.col(ranks.BUCKET).alias("p")).collect()
    real = sorted((r.x, r.p) for r in got if r.x is not None and r.x == r.x)
    assert [p for _, p in real] == sorted(p for _, p in real) and len({p for _, p in real}) > 1500
    assert all(r.p == ranks.BUCKETS for r in got if r.x is None)


@settings(max_examples=10, deadline=None)
@given(data=st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=50))
def test_exact_quantiles_match_numpy(spark, data):
    import numpy as np

    from tidemark.operators.drift import exact_quantiles

    df = spark.createDataFrame([(g, float(v)) for g, v in data], "g int, v double")
    got = {(r.g, r.q): r.quantile for r in exact_quantiles(df, ["g"], "v", [0.01, 0.5, 0.99]).collect()}
    for g in {d[0] for d in data}:
        vals = [float(v) for gg, v in data if gg == g]
        for q in (0.01, 0.5, 0.99):
            assert math.isclose(got[(g, q)], float(np.percentile(vals, q * 100)), rel_tol=1e-9, abs_tol=1e-9)
