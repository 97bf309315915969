"""Secret spans: base patterns against plain Python, the field against enumeration."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, edge_documents
from tidemark.llm import queries, secret_scan
from tidemark.llm.labelled import fold_of
from tidemark.llm.text import slices, spans, strings

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def slow_base(text):
    """The contract's rules, written plainly."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return [(k, b, e) for b, _, k, e in sorted(found)]


def awkward_texts(rng, n):
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "ſecret", "toKen", "=", ": ", " = ", "\"", "'", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "deadbeef" * 4, "0123456789abcdef", "abc", " ", "\n", "é", "😀", "x=y.z", "secret: ", "-", "+/"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_spans_equal_plain_rules():
    rng = random.Random(1)
    texts = awkward_texts(rng, 3000) + ["token=secret: abcdefghij", "password=token=abcdefgh12", "secret=abc token=abcdefgh", "AKIA" + "B" * 11, "AKIA" + "B" * 12, "f" * 31, "f" * 32 + "g" + "0" * 40]
    found = secret_scan.found_in(pa.array(texts))
    assert len(found) > 300
    for i, t in enumerate(texts):
        assert [s[:3] for s in found.get(i, [])] == slow_base(t), t


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for trial in range(60):
        sizes = rng.integers(1, 6, 4)
        first = np.r_[0, np.cumsum(sizes)]
        unary = rng.normal(size=(first[-1], 3)) * rng.choice([1, 6])
        unary[:, 0] = 0
        moves = rng.normal(size=(3, 3))
        got = secret_scan.viterbi(unary, moves, first)
        score = lambda y, a, b: sum(unary[i, y[i - a]] for i in range(a, b)) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1))
        for a, b in zip(first, first[1:]):
            best = max(score(y, a, b) for y in itertools.product(range(3), repeat=b - a))
            assert abs(score(got[a:b], a, b) - best) < 1e-9
    assert secret_scan.viterbi(np.empty((0, 3)), moves, np.array([0])).shape == (0,)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    unary, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True] * 4, [True, True, True, False]])
    tags, pairs, norm = secret_scan.marginals(unary, moves, mask)
    want, want_pairs, want_norm = np.zeros_like(tags), np.zeros((3, 3)), 0.0
    for w, n in ((0, 4), (1, 3)):
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.exp([sum(unary[w, i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
        want_norm += np.log(weight.sum())
        for y, p in zip(paths, weight / weight.sum()):
            for i in range(n):
                want[w, i, y[i]] += p
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += p
    assert np.allclose(tags, want) and np.allclose(pairs, want_pairs) and abs(norm - want_norm) < 1e-9


def test_scores_equal_hashed_places():
    texts = pa.array([*awkward_texts(random.Random(4), 200), "", "x", "a b c"])
    tokens = secret_scan.Tokens(*spans(texts))
    features = secret_scan.Features(tokens)
    weights = np.random.default_rng(5).normal(size=(secret_scan.DIMS, 3))
    whole = weights[features.places(np.arange(len(tokens)))].sum(axis=1)
    assert np.allclose(features.scores(weights), whole - whole[:, :1], atol=1e-4)


def test_field_adds_spans_beyond_the_patterns(spark):
    rng = random.Random(6)
    words = ["sun", "moon", "river", "stone", "green", "walk", "été"]
    secret = lambda n: "".join(rng.choice("0123456789abcdefABXYZ") for _ in range(n))
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{filler(30)} {rng.choice(['password=', 'token: ', 'secret = '])}{secret(20)} {filler(20)}") for i in range(300)] + [(1000 + i, filler(60)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = secret_scan.fit_secrets(df)
    new = [(1, f"{filler(8)} été passkey = {secret(20)} {filler(9)}"), (2, filler(40)), (3, f"{filler(8)} password={secret(20)} {filler(3)}")]
    got = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.found] for r in secret_scan.scan(spark.createDataFrame(new, df.schema), field).collect()}
    begin = new[0][1].index("passkey = ") + len("passkey = ")
    assert got == {1: [("field", begin, begin + 20)], 2: [], 3: slow_base(new[2][1])}
    plain = secret_scan.scan(spark.createDataFrame(new, df.schema), None).collect()
    assert {r.doc_id: len(r.found) for r in plain} == {1: 0, 2: 0, 3: 1}
    assert secret_scan.fit_secrets(df.where("doc_id >= 1000")) is None and secret_scan.fit_secrets(df.limit(0)) is None


def test_edge_rows_and_clashing_columns(spark):
    df = edge_documents(spark).selectExpr("*", "1 as found", "2 as spans", "3 as chance").unionByName(
        spark.createDataFrame([(50, "密码 password=abcdefgh1 é", 1, 2, 3)], "doc_id long, text string, found int, spans int, chance int"), allowMissingColumns=True
    )
    rows = secret_scan.digests(df, secret_scan.fit_secrets(df)).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            base = slow_base(texts[r.doc_id])
            assert r.base_sha256 == secret_scan.digest_of(base) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
    assert [r.spans for r in rows if r.doc_id == 50] == ["assign:3:21"]
    assert secret_scan.digests(df.limit(0), None).count() == 0
    text_ids = df.where("doc_id = 50").selectExpr("'a' as doc_id", "text")
    assert secret_scan.digests(text_ids, None).first().doc_id == "a"


def test_op12_equals_base_rules_and_field_finds_held_out_values(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = queries.op12_secret_scan(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == secret_scan.digest_of(base)
        own = [tuple(s.split(":")) for s in r.spans.split(",")] if r.spans else []
        assert [(k, int(b), int(e)) for k, b, e in own if k != "field"] == base
    field = secret_scan.fit_secrets(docs, fold_of(F.col("doc_id"), 2) == 0)
    hit = wrong = missed = 0
    for _, part in slices(strings(docs.where(fold_of(F.col("doc_id"), 2) == 1).select("text").toArrow()["text"])):
        tokens = secret_scan.Tokens(*spans(part))
        real = secret_scan.label_tokens(tokens, secret_scan.found_in(part)) > 0
        tagged = secret_scan.viterbi(secret_scan.Features(tokens).scores(field.weights), field.moves, tokens.first) > 0
        hit, wrong, missed = hit + (real & tagged).sum(), wrong + (~real & tagged).sum(), missed + (real & ~tagged).sum()
    assert hit >= 0.7 * (hit + missed) and wrong <= 0.1 * (hit + wrong), (hit, wrong, missed)
