"""Collocations by prefix-free parsing against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import edge_documents
from tidemark.llm import collocations

PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def slow_counts(rows, longest):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in PIECES.split((text or "").translate(LOWER)):
            w = WORDS.findall(piece)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts


def slow_collocations(rows, longest=3, least=10, inside=50, top=2000):
    out = []
    for lang, f in slow_counts(rows, longest).items():
        n = sum(c for g, c in f.items() if " " not in g)
        phrases = {g: c for g, c in f.items() if " " in g and c >= least}
        best = []
        for g, a in phrases.items():
            w = g.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            if any(f" {g} " in f" {h} " and 100 * c >= inside * a for h, c in phrases.items() if len(h.split(" ")) > len(w)):
                continue
            score, _, left, right = min(cuts)
            best.append((-score, -a, g.encode(), left, right))
        out += [(lang, i, g.decode(), -a, left, right, n, -s) for i, (s, a, g, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def fast(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def noisy_texts(rng, n):
    words = ["The", "of", "a", "ä", "x1", "#", "“q”", "中", "\x00", "É"]
    parts = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\r\n", "! ", ";", "\x0b"]
    copy = "".join(rng.choice(words) + rng.choice(parts) for _ in range(80))
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(parts) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "de", None, "und"]), text + (copy if i % 3 == 0 else "")))
    return out


@pytest.mark.parametrize("longest, modulus", [(2, 1), (3, 2), (3, 24), (5, 3)])
def test_equal_to_plain_counts(spark, longest, modulus):
    rows = noisy_texts(random.Random(longest), 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = slow_collocations(rows, longest, 3, 50)
    assert len(want) > 50
    assert fast(df, max_words=longest, least=3, modulus=modulus) == want
    assert fast(df.repartition(5), max_words=longest, least=3, modulus=modulus, top=7) == slow_collocations(rows, longest, 3, 50, 7)


def test_edge_rows(spark):
    df = edge_documents(spark).selectExpr("*", "1 as chunk", "2 as own", "3 as n", "4 as gram", "5 as f", "6 as rank", "7 as salt")
    rows = [(r.lang, r.text) for r in df.collect()]
    got = fast(df, least=2)
    assert got == slow_collocations(rows, least=2) and any(r[0] == "fr" for r in got)
    assert fast(df.limit(0)) == [] and fast(df.where("text is null")) == []
    with pytest.raises(ValueError):
        collocations.collocations(df, max_words=1)


def test_chunks_hold_every_gram_once_and_equal_passages_once():
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randint(0, 300)}" for _ in range(400))
    texts = [f"{rng.randint(0, 10**9)} {passage} {rng.randint(0, 10**9)}" for _ in range(20)] + ["", "one", "one two", "same " * 5000, None]
    doc, chunk, own = collocations.parse(pa.array([t or "" for t in texts]), 2, 24)
    assert sum(own) == sum(len(t.split()) for t in texts if t)
    assert Counter(doc.tolist())[23] in (1, 4999, 5000) and set(doc.tolist()) == set(range(20)) | {21, 22, 23}
    words = [c.split(" ") for c in chunk.to_pylist()]
    # A chunk that another follows ends with the window that begins the other.
    for i in range(len(words) - 1):
        if doc[i] == doc[i + 1]:
            assert words[i][-2:] == words[i + 1][:2] and len(words[i]) == own[i] + 2
        else:
            assert len(words[i]) == own[i]
    # Chunks inside the passage are cut alike in all texts.
    inner = [tuple(words[i]) for i in range(len(words)) if doc[i] < 20 and 0 < i and doc[i - 1] == doc[i] and i + 1 < len(words) and doc[i + 1] == doc[i]]
    assert set(Counter(inner).values()) == {20}


def test_counts_and_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12 + 7
    f = {"a": 5 * big + 1, "b": 4 * big + 3, "c": 9 * big, "a b": big, "b c": 2 * big + 1, "a b c": big // 3}
    rows = [("x", g, n) for g, n in f.items()] + [("x", "", 10**14)]
    got = {r.phrase: tuple(r)[2:] for r in collocations.score_phrases(spark.createDataFrame(rows, "lang string, gram string, f long"), 3, 50).collect()}

    def low(*cuts):
        return min((1000000 * a * a // (f[x] * f[y]), k, f[x], f[y]) for k, (a, x, y) in enumerate(cuts))

    want = {"a b": (f["a b"], low((f["a b"], "a", "b"))), "b c": (f["b c"], low((f["b c"], "b", "c")))}
    want["a b c"] = (f["a b c"], low((f["a b c"], "a", "b c"), (f["a b c"], "a b", "c")))
    assert got == {g: (a, left, right, s) for g, (a, (s, _, left, right)) in want.items()}
    total = Counter()
    for k in (1, 2):
        for b in collocations.count_grams(pa.array(["x", "x"]), pa.array(["u v", "u v\nu"]), np.array([2, 3]), np.array([2**61, 2**60 + 1]), k):
            for g, n in zip(b["gram"].to_pylist(), b["f"].to_pylist()):
                total[g] += n
    assert total == {"": 2**62 + 3 * (2**60 + 1), "u": 2**61 + 2 * (2**60 + 1), "v": 2**61 + 2**60 + 1, "u v": 2**61 + 2**60 + 1}


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_full_filter_changes_no_count(spark, bits):
    """With 64 bits nearly every gram passes; the result is the same."""
    rows = noisy_texts(random.Random(8), 40)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert fast(df, least=4, filter_bits=bits) == slow_collocations(rows, 3, 4)
