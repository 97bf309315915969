"""Text operators against brute force: codec, quality statistics, license scan, URL rules."""

import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tests.llm.fixtures import LONG, documents, edge_documents
from tidemark.llm import license_scan, piece_codec, quality_rules, url_filter
from tidemark.llm.ngrams import DIMS, Grams
from tidemark.llm.piece_bpe import Codec, PieceModel
from tidemark.llm.text import NON_BLANK, Words, grams, hash_strings, slices, spans

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(n, parts, seed=5, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 7, longest]))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_words_and_grams_match_regex():
    texts = random_texts(800, ["a", "bé", " ", "\n", "\t", "中", "x y", "\x0b", "\u00a0"])
    part = pa.array(texts)
    words = Words(*spans(part), NON_BLANK)
    expect = [WORD.findall(t) for t in texts]
    got = [w.decode() for w in words.arrow().to_pylist()]
    assert got == [w for ws in expect for w in ws]
    h, at = grams(words.hashes(), words.first, 3)
    want = [tuple(ws[i : i + 3]) for ws in expect for i in range(len(ws) - 2)]
    assert len(h) == len(want) and len(set(zip(h.tolist(), want))) == len(set(want)) == len(set(h.tolist()))


def test_hash_of_a_word_does_not_depend_on_its_place():
    a = hash_strings(pa.array([b"one", b"two", b""], pa.binary()))
    b = hash_strings(pa.array([b"zero", b"", b"two", b"one"], pa.binary()))
    assert a[0] == b[3] and a[1] == b[2] and a[2] == b[1] and len({*b.tolist()}) == 4


@pytest.mark.parametrize("parts", [["a", "b", "c", " ", "  ", "▁", " the", "ing", "é", "ñ", "中", "😀", "\n", "\t", "\0", "<s>", "-----", "=="], [" ", "a"], ["="]])
def test_codec_equals_the_library(library, parts):
    codec = Codec(PieceModel(open(MODEL, "rb").read()))
    texts = random_texts(1500, parts, longest=300) + [p * k for p in (" ", "a", "=", "ab ") for k in range(0, 60, 3)]
    for first, part in slices(pa.array(texts), 4096):
        flat, n = codec.encode(part)
        for k in range(len(part)):
            ids, text = flat[n[k] : n[k + 1]], texts[first + k]
            want = [*library.encode(text), library.eos_id()]
            assert ids.tolist() == want and codec.decode(ids) == library.decode(want)


def test_codec_over_edge_rows(spark, library):
    rows = edge_documents(spark)
    got = piece_codec.round_trip(rows, MODEL).collect()
    want = Counter((r.doc_id, tuple([*library.encode(r.text or ""), 2]), library.decode([*library.encode(r.text or ""), 2])) for r in rows.select("doc_id", "text").collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert piece_codec.digests(rows.limit(0), MODEL).count() == 0
    assert piece_codec.encode(rows, MODEL).columns == ["doc_id", "ids"]


def base_of(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    count, marked = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked[i : i + 3] = [True] * 3
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(marked)


def test_base_statistics_match_brute_force():
    texts = random_texts(2500, ["a", "b", "é", " ", "\n", " \n", "\t", "中", "#", "a b a b a", "x y z x y z"]) + [LONG]
    for first, part in slices(pa.array(texts), 4096):
        got = quality_rules.base_statistics(Grams(part))
        for k in range(len(part)):
            assert tuple(int(got[c][k]) for c in quality_rules.STATS) == base_of(texts[first + k])


def test_quality_rules_on_edge_rows_and_documents(spark):
    docs = documents(spark).unionByName(edge_documents(spark).select("doc_id", "text", "source", "lang", "n_chars"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_rules.fit_quality(docs, labels)
    got = quality_rules.apply_rules(docs, model).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, Counter())[base_of(r.text or "")] += 1
    for r in got:
        stats = tuple(getattr(r, c) for c in quality_rules.STATS)
        assert texts[r.doc_id][stats] > 0
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5) and 0 <= r.quality <= 1
    marked = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, marked[r.doc_id]) for r in got if r.doc_id in marked and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.97
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_model_without_labels_keeps_what_the_base_rules_keep(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rules.fit_quality(docs, labels)
    assert model.weights.shape == (DIMS, 1)
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(docs, model).collect())
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(docs, quality_rules.fit_quality(docs, one)).collect())


def test_license_scan_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "CHUNK", 7)
    parts = ["under ", "the ", "mit ", "license\n", "Apache ", "License, ", "Version ", "2.0 ", "cc ", "by ", "nc ", "CC BY-NC ", "é ", "x ", "under the MIT license. "]
    rows = list(enumerate([*random_texts(300, parts), None, "", LONG]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as uid", "1 as hash", "2 as template")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        starts, labels = [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_spans_allow_small_edits_and_nothing_less(spark):
    whole = license_scan.NOTICES[1][1]
    words = whole.split()
    edited = " ".join([*words[:9], "really", *words[9:]])
    half = " ".join(words[: len(words) // 2])
    rows = [(1, whole), (2, f"aaa {edited} bbb"), (3, half), (4, "all rights"), (5, "All rights reserved."), (6, f"{whole} {whole}")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["mit", "mit", "", "", "proprietary", "mit"]
    assert got[2].score < 1 and got[1].score == 1 and got[3].score == 0
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_grams([("x", "two words")], [])


def naive_rule(rules, host, path):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)


def test_trie_equals_every_rule_tried():
    rng = random.Random(2)
    labels, segments = ["a", "b", "com", "net"], ["", "/", "/x", "/x/", "/x/y", "/xy/", "/x/y/", "//"]
    for _ in range(60):
        rules = url_filter.check_rules({(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(segments), rng.choice(["allow", "block"])) for _ in range(8)})
        trie = url_filter.UrlTrie(rules)
        for _ in range(60):
            host, path = ".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(segments) + rng.choice(segments)
            assert trie.longest(host, path) == naive_rule(rules, host, path), (rules, host, path)


def test_url_parts_verdicts_and_the_join_path(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"), ("net", "/es", "block"), ("net", "/es", "block")]
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://a.example.com/en/", "http://a.example.com/en", "http://example.com", "http://example.com?x=/en/",
        "x://y.net/espana://z.com/en/", "http://net/es/", "http://notexample.com/en/", "http://u@example.com:80/en/", "http://é.com/ü", "http://a.net/\nes/", "http://a.net/es/", "http://a.net/es/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'q' as host", "1 as rule", "2 as verdict")
    got = url_filter.judge_urls(df, rules).collect()
    listed = url_filter.check_rules(rules)
    for r in got:
        url = urls[r.page_id]
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        best = naive_rule(listed, host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), url
    table = spark.createDataFrame(listed, "host string, path string, verdict string")
    joined = url_filter.judge_by_join(df, table).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    assert {r.verdict for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.check_rules([("a", "/", "maybe")])
