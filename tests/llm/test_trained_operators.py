"""Trained operators: held-out accuracy, model parts against direct computation, awkward rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SF, documents, edge_documents
from tidemark.llm import language_id, linear, queries, rule_ensemble, toxicity
from tidemark.llm.labelled import fold_of, labelled_texts
from tidemark.llm.ngrams import DIMS, Grams


def labels(spark, sf=SF):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_folds_and_samples_are_bounded_and_repeatable(spark):
    docs = documents(spark)
    import zlib

    ids = [r.doc_id for r in docs.select("doc_id").limit(50).collect()]
    got = {r.doc_id: r.f for r in docs.select("doc_id", fold_of(F.col("doc_id"), 5).alias("f")).collect()}
    assert all(got[i] == zlib.crc32(str(i).encode()) % 5 for i in ids)
    one = {r.key for r in labelled_texts(docs, labels(spark), "toxic", fold_of(F.col("key"), 4) != 2, 100).collect()}
    two = {r.key for r in labelled_texts(docs.repartition(5), labels(spark).repartition(3), "toxic", fold_of(F.col("key"), 4) != 2, 100).collect()}
    assert one == two and len(one) <= 100 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in one)


def test_a_repeated_id_gives_one_sampled_row(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") < 19_900, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    marks = docs.select("doc_id", F.lit(1).alias("toxic"))
    got = labelled_texts(docs, marks, "toxic", None, 200).collect()
    assert len(got) == 101 and [r.text for r in got if r.key == 5] == ["text 0"]
    assert got == labelled_texts(docs.repartition(9), marks, "toxic", None, 200).collect()
    assert language_id._sample(docs, None, 200, "doc_id", "text", "lang").count() == 101


def test_gathered_scores_equal_dense_products():
    rng = np.random.default_rng(1)
    grams = Grams(pa.array(["", "a", "ab c", "The THE the!! x x x", "é " * 40, " \n "]))
    w = rng.normal(size=(DIMS, 3))
    assert np.allclose(grams.scores(w, np.array([0.0, 1.0, -1.0])), grams.dense() @ w + [0.0, 1.0, -1.0], atol=1e-4)


def test_linear_fits_reach_their_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (rng.random(400) < linear.sigmoid(x @ np.array([2, -1, 0, 0, 0.5]) + 0.3)).astype(float)
    w, b = linear.fit_logistic(x, y, l2=0.01, steps=800)
    g = x.T @ (linear.sigmoid(x @ w + b) - y) / 400 + 0.01 * w
    assert np.abs(g).max() < 1e-3 and abs((linear.sigmoid(x @ w + b) - y).mean()) < 1e-3
    side = np.where(y > 0, 1.0, -1.0)
    w, b = linear.fit_svm(x, side, l2=0.01, steps=800)
    slack = np.maximum(0, 1 - side * (x @ w + b))
    assert np.abs(-2 * x.T @ (side * slack) / 400 + 0.01 * w).max() < 1e-2
    z = rng.normal(size=5000) * 7
    a, b = linear.fit_platt(z, (rng.random(5000) < linear.sigmoid(0.5 * z - 1)).astype(float))
    assert abs(a - 0.5) < 0.06 and abs(b + 1) < 0.2


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_of_held_out_documents(spark):
    got = rows_of(queries.op3_language_id(spark, SF))
    truth = [(r.doc_id, r.lang) for r in documents(spark).collect() if r.lang and got[r.doc_id].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in truth) / len(truth) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == documents(spark).count()


def test_language_does_not_read_lang_source_or_id(spark):
    docs = documents(spark)
    model = language_id.fit_languages(docs)
    a = rows_of(language_id.identify(docs, model))
    b = language_id.identify(docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source")), model).collect()
    assert all(a[-r.doc_id].lang_pred == r.lang_pred and a[-r.doc_id].score == r.score for r in b)


def test_language_on_edge_rows(spark):
    docs = edge_documents(spark)
    got = rows_of(language_id.identify(docs, language_id.fit_languages(documents(spark))))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3, -9))
    assert got[-5].lang_pred == got[-6].lang_pred and got[-5].score == got[-6].score
    none = language_id.identify(docs, language_id.fit_languages(docs.where("lang = 'zz'"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = rows_of(language_id.identify(docs, language_id.fit_languages(docs.where("lang = 'fr'"))))
    assert one[-7].lang_pred == "fr" and one[-7].score == 1 and one[-1].lang_pred == "und"
    assert language_id.identify(docs.limit(0), language_id.fit_languages(docs.limit(0))).count() == 0


def test_quality_of_held_out_documents(spark):
    got = rows_of(queries.op6_quality_classifier(spark, SF))
    held = [(got[r.doc_id], r.quality) for r in labels(spark).collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in held) / len(held) > 0.95
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 for g in got.values())


def test_rule_columns_equal_the_rules_applied_by_hand(spark):
    docs = documents(spark).unionByName(edge_documents(spark).select("doc_id", "text", "source", "lang", "n_chars"))
    model = rule_ensemble.fit_rules(docs, labels(spark), trees=4)
    assert model.rules and all(1 <= len(rule) <= 3 for rule, _ in model.rules)
    texts = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    stats = rule_ensemble.statistics(texts).withColumn("score", model.column()).collect()
    for r in stats:
        z = model.intercept + sum(w for rule, w in model.rules if all((r[f"s_{n}"] > cut) == above for n, above, cut in rule))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    by_hand = "Ab cd!\n\nAb 12 #é"
    s = rule_ensemble.statistics(spark.createDataFrame([(by_hand,)], "text string")).first()
    assert (s.s_words, s.s_distinct_share, s.s_marks, s.s_symbols, s.s_digits) == (5, 0.8, 0.2, 0.2, 2 / len(by_hand))


def test_rules_without_labels_or_with_one_value(spark):
    docs = edge_documents(spark)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rule_ensemble.score(docs, rule_ensemble.fit_rules(docs, empty)).collect()} == {0.5}
    one = spark.createDataFrame([(-4, 1), (-5, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in rule_ensemble.score(docs, rule_ensemble.fit_rules(docs, one)).collect())
    assert rule_ensemble.score(docs.limit(0), rule_ensemble.RuleModel(0.0)).count() == 0


def test_toxicity_of_held_out_documents(spark):
    got = rows_of(queries.op10_toxicity(spark, "/root/testdata/sf0.1"))
    held = [(got[r.doc_id], r.toxic) for r in labels(spark, "/root/testdata/sf0.1").collect() if got[r.doc_id].held_out]
    hit = sum(g.predicted and t for g, t in held)
    assert hit / sum(g.predicted for g, _ in held) > 0.95 and hit / sum(t for _, t in held) > 0.85
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 for g in got.values())


def test_label_model_recovers_accuracies_and_clusters():
    rng = np.random.default_rng(3)
    n, prior, hit = 200_000, 0.2, np.array([0.5, 0.4, 0.3, 0.35, 0.45, 0.45])
    y = rng.random(n) < prior
    votes = np.array([(rng.random(n) < np.where(y, h, 0.02)) for h in hit])
    votes[5] = votes[4]  # a copy of another voter
    pairs = (votes.astype(np.int64) @ votes.T.astype(np.int64)).astype(float)
    got, clusters = toxicity.fit_label_model(n, pairs, prior, np.column_stack([np.full(6, 0.3), np.full(6, 0.05)]))
    assert np.abs(got[:4, 0] - hit[:4]).max() < 0.05 and np.abs(got[:, 1] - 0.02).max() < 0.02
    assert sorted(map(sorted, clusters)) == [[0], [1], [2], [3], [4, 5]]
    # Bayes' rule with the true rates; the copy says nothing new.
    odds = prior / (1 - prior) * 0.45 / 0.02 * np.prod((1 - hit[:4]) / 0.98)
    for votes_of in ([4, 5], [4]):
        assert math.isclose(toxicity.posterior(votes_of, got, clusters, prior), odds / (1 + odds), rel_tol=0.1)


def test_vote_moments_equal_brute_force(spark):
    docs = documents(spark)
    voters = ["the", "idiot", "réeux*", "réeux*2", "thin*", "scum"]
    total, pairs = toxicity.vote_moments(docs, voters)
    want = np.zeros((6, 6))
    texts = [r.text for r in docs.collect()]
    for t in texts:
        v = np.array([w in toxicity.terms_of(t) for w in voters])
        want += np.outer(v, v)
    assert total == len(texts) and (pairs == want).all()


def test_term_index_finds_what_terms_of_lists():
    rng = random.Random(4)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=40)).title() for _ in range(60)]
    terms = sorted(set().union(*(toxicity.terms_of(t) for t in texts[:20])))
    index = toxicity.TermIndex(terms)
    for t in texts:
        assert [terms[i] for i in index.find(t)] == sorted(toxicity.terms_of(t) & set(terms))


def test_planted_toxic_texts_go_and_clean_ones_stay(spark):
    docs = documents(spark)
    model = toxicity.fit_toxicity(docs, labels(spark))
    clean = [r.text for r in docs.limit(80).collect() if not toxicity.terms_of(r.text) & set(toxicity.SEEDS)][:20]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, f"{t} you stupid idiot, what pathetic trash") for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in toxicity.drop_toxic(df, model, 0.3).collect()}
    assert not any(i >= 100 for i in kept) and len(kept) >= 19


@pytest.mark.parametrize("rows", [[], [(-7, 1)], [(-4, 0), (-5, 1), (-6, 1), (-7, None), (None, 1)]])
def test_toxicity_on_edge_rows_and_few_labels(spark, rows):
    docs = edge_documents(spark)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = rows_of(toxicity.score(docs, model))
    assert by[-1].score == by[-2].score == by[-3].score and by[-5].score == by[-6].score
    insult = spark.createDataFrame([(1, "you idiot"), (2, "fine day")], "doc_id long, text string")
    two = rows_of(toxicity.score(insult, model))
    assert two[1].score > two[2].score
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
