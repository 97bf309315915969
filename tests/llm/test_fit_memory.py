"""Fits on the driver hold a sample once and one scaled copy of it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import language_id, linear, quality_rules
from tidemark.llm.ngrams import DIMS, Grams, collect_dense


def shares(rows, columns=DIMS, seed=1):
    r = np.random.default_rng(seed)
    x = r.random((rows, columns), np.float32)
    x[x > 0.3] = 0
    return x.astype(np.float16)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("rows, columns", [(1, 3), (700, 600), (257, 1025), (512, 256), (300, DIMS)])
def test_blocks_change_no_number(rows, columns):
    x = shares(rows, columns)
    x[:, 0] = 0.5  # a column that doesn't vary
    wide = x.astype(np.float32)
    mean, sd = wide.mean(axis=0, dtype=np.float64), wide.std(axis=0, dtype=np.float64)
    scale = np.maximum(sd, max(float(np.median(sd)), 1e-12) * 0.25)
    scaler = linear.Scaler(x)
    scaled = ((wide - mean) / scale).astype(np.float32)
    if columns % linear.BLOCK != 1:
        assert np.array_equal(scaler.mean, mean) and np.array_equal(scaler.scale, scale) and np.array_equal(scaler.apply(x), scaled)
    else:  # numpy adds up a single column in another order
        np.testing.assert_allclose(scaler.mean, mean, rtol=1e-12)
        np.testing.assert_allclose(scaler.scale, scale, rtol=1e-12)
        np.testing.assert_allclose(scaler.apply(x), scaled, rtol=1e-5, atol=1e-6)
    w = np.random.default_rng(2).normal(size=columns)
    np.testing.assert_allclose(linear.products(x, w), wide @ w, rtol=1e-12, atol=1e-12)


def test_products_of_no_row():
    assert linear.products(np.zeros((0, 5), np.float16), np.ones(5)).shape == (0,)


def test_products_widen_only_a_block():
    x, w = np.ones((8000, 500), np.float32), np.ones(500)
    assert peak_mb(lambda: linear.products(x, w)) < x.nbytes / 1e6 / 2  # 2 before: the whole sample in double precision


def test_quality_fit_makes_no_third_matrix(monkeypatch):
    rows = 2000
    made = [shares(rows)]
    monkeypatch.setattr(quality_rules, "labelled_texts", lambda *_: None)
    monkeypatch.setattr(quality_rules, "collect_dense", lambda *_: ([i % 3 % 2 for i in range(rows)], made.pop()))
    assert peak_mb(lambda: quality_rules.fit_quality(None, None)) < 2.5 * rows * DIMS * 4 / 1e6


def test_language_fit_makes_no_third_matrix(monkeypatch):
    rows = 1500
    monkeypatch.setattr(language_id, "_sample", lambda *_: None)
    x = shares(rows)
    monkeypatch.setattr(language_id, "collect_dense", lambda *_: (["en" if i % 2 else "de" for i in range(rows)], x))
    assert peak_mb(lambda: language_id.fit_languages(None)) < 3 * rows * DIMS * 4 / 1e6


def test_collected_vectors_stay_narrow_and_in_order(spark):
    texts = {5: "five words stand here now", 1: "", 3: "ÄÖ 123 ## twice twice", 2: "x " * 400}
    sample = spark.createDataFrame([(k, t, k % 2) for k, t in texts.items()], "key long, text string, y int")
    y, x = collect_dense(sample, "y")
    assert x.dtype == np.float16 and y == [1, 0, 1, 1]
    assert np.array_equal(x, Grams(pa.array([texts[k] for k in sorted(texts)])).dense().astype(np.float16))
    y, x = collect_dense(sample.limit(0), "y")
    assert y == [] and x.shape == (0, DIMS)
