"""Path attributions against subset enumeration, and their sums against the raw scores."""

import random
from itertools import combinations
from math import factorial

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import tree_paths as tp
from tidemark.plans import models as md
from tidemark.plans import q_models as qm
from tidemark.sources import fixtures as fx


def read(node):
    """(rows, value) of a leaf; (rows, feature, test, left, right) of a split."""
    rows = node.impurityStats().count()
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return rows, node.prediction() if len(stats) == 3 else stats[1] / sum(stats)
    split = node.split()
    if split.getClass().getSimpleName() == "CategoricalSplit":
        names = set(split.leftCategories())
        test = names.__contains__
    else:
        test = float(split.threshold()).__ge__
    return rows, split.featureIndex(), test, read(node.leftChild()), read(node.rightChild())


def worth(node, row, known):
    """Expected value of a tree when only the features of ``known`` are seen."""
    if len(node) == 2:
        return node[1]
    _, f, test, left, right = node
    if f in known:
        return worth(left if test(row[f]) else right, row, known)
    return (left[0] * worth(left, row, known) + right[0] * worth(right, row, known)) / (left[0] + right[0])


def shapley(root, row, m):
    out = []
    for j in range(m):
        others = [i for i in range(m) if i != j]
        out.append(sum(factorial(k) * factorial(m - k - 1) / factorial(m) * (worth(root, row, {*s, j}) - worth(root, row, set(s)))
                       for k in range(m) for s in combinations(others, k)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        x = [rng.gauss(0, 1), float(rng.randint(0, 3)), rng.choice([-1e12, rng.random()]), float(rng.randint(0, 1))]
        rows.append((i, *x, float(x[0] + (x[1] in (1.0, 3.0)) * x[3] + rng.gauss(0, 0.5) > 0.4)))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, label double")
    from pyspark.ml.feature import VectorIndexer

    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="v").transform(df)
    # Columns of few values become categories, so that both kinds of split are met.
    return VectorIndexer(inputCol="v", outputCol="features", maxCategories=4).fit(df).transform(df).cache()


MODELS = {
    "boosted": lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1),
    "forest": lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1),
    "tree": lambda: DecisionTreeClassifier(maxDepth=3),
    "regression": lambda: DecisionTreeRegressor(maxDepth=3),
}


@pytest.mark.parametrize("kind", sorted(MODELS))
def test_attributions_equal_subset_enumeration(data, kind):
    model = MODELS[kind]().fit(data)
    got = tp.add_attributions(data, model, 4).withColumn("x", vector_to_array("features")).filter("i < 25").collect()
    trees = list(model._java_obj.trees()) if hasattr(model, "trees") else [model._java_obj]
    weights = list(model._java_obj.treeWeights()) if hasattr(model, "trees") else [1.0]
    if kind == "forest":
        weights = [w / len(trees) for w in weights]
    roots = [read(t.rootNode()) for t in trees]
    for r in got:
        want = [0.0] * 4
        for t, w in zip(roots, weights):
            want = [a + w * b for a, b in zip(want, shapley(t, r.x, 4))]
        assert max(abs(a - b) for a, b in zip(r.attribution, want)) < 1e-9
        assert abs(r.base - sum(w * worth(t, r.x, set()) for t, w in zip(roots, weights))) < 1e-9


@pytest.mark.parametrize("kind", ["boosted", "forest", "tree"])
def test_attributions_add_up_to_the_score(data, kind):
    model = MODELS[kind]().fit(data)
    score = "rawPrediction" if kind == "boosted" else "probability"
    out = tp.add_attributions(model.transform(data), model, 4)
    gap = F.abs(F.aggregate("attribution", F.col("base"), lambda a, v: a + v) - vector_to_array(score)[1])
    assert out.agg(F.max(gap)).first()[0] < 1e-9 and out.count() == 400


def test_model_without_a_split_and_too_deep_model(spark, data, monkeypatch):
    flat = DecisionTreeClassifier(maxDepth=0).fit(data)
    r = tp.add_attributions(data, flat, 4).first()
    assert r.attribution == [0.0] * 4 and abs(r.base - data.agg(F.avg("label")).first()[0]) < 1e-12
    monkeypatch.setattr(tp, "MAX_CONSTANTS", 3)
    with pytest.raises(ValueError, match="constants"):
        tp.add_attributions(data, MODELS["tree"]().fit(data), 4)


def test_summary_and_planted_feature(spark):
    tr = fx.train_apps(spark, SF_SMALL).withColumn("planted", F.col("target_value") * 2.0 + (F.col("front_id") % 7) / 10.0)
    feats, ncols = md.tree_features(tr, ["balance_amt", "planted"], ["db_group_last"])
    rows, names = tp.path_attributions(md.fit_model(feats, ncols, ["db_group_last"], qm.GBT, 42), feats)
    got = {r.feature: r for r in tp.attribution_summary(rows, names).collect()}
    assert list(names) == ["f_balance_amt", "f_planted", "i_db_group_last"] and got.keys() == set(names)
    assert got["f_planted"].mean_abs > 10 * got["f_balance_amt"].mean_abs
    each = [r.attribution[1] for r in rows.select("attribution").collect()]
    assert abs(got["f_planted"].mean_abs - sum(map(abs, each)) / len(each)) < 1e-9 and abs(got["f_planted"].max_abs - max(map(abs, each))) < 1e-12
