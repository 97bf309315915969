"""Mixing, nearest neighbours, near-duplicate join and the pipeline against brute force."""

import heapq
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SF, documents, edge_documents
from tidemark.llm import connected, knn, mixing, ngram_join, queries, toxicity
from tidemark.llm.grouped import map_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_seats(votes, seats, caps):
    got = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * got[i] + 1), i))
    return got


def test_seats_equal_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        votes = [float(rng.choice([0, 1, 2, 3, 10, 500, rng.randint(1, 10**6)])) for _ in range(n)]
        caps = [rng.choice([0, 1, 5, 10**6]) for _ in range(n)]
        seats = rng.randint(0, 400)
        got = mixing.sainte_lague(votes, seats, caps).tolist()
        want = slow_seats(votes, seats, caps)
        assert sum(got) == sum(want) and all(g <= c for g, c in zip(got, caps))
        if len(set(votes)) == n:
            assert got == want, (votes, caps, seats)
    big = mixing.sainte_lague([5e12, 2e12, 1e12], 10**12, [10**13] * 3)
    assert big.sum() == 10**12 and abs(big[0] - 625 * 10**9) <= 1


def test_targets_share_the_excess():
    assert mixing.fill_targets([100, 100, 100], [1, 1, 1], 3).tolist() == [100, 100, 100]
    assert mixing.fill_targets([10, 1000, 1000], [8, 1, 1], 3).tolist() == [30, 990, 990]
    assert mixing.fill_targets([], [], 3).tolist() == [] and mixing.fill_targets([0, 0], [1, 2], 3).tolist() == [0, 0]
    got = mixing.fill_targets([10, 10, 1000], [5, 5, 0], 3)
    assert got.tolist() == [30, 30, 0]


def test_mix_comes_near_its_targets_on_every_run(spark):
    docs = documents(spark).unionByName(edge_documents(spark).select("doc_id", "text", "source", "lang", "n_chars"))
    run = lambda d: d.select("doc_id", "source", F.col(f"{mixing.MIX}.*")).collect()
    got = run(mixing.mix(docs, mixing.cycled_weights((5, 2, 1))))
    again = run(mixing.mix(docs.repartition(7), mixing.cycled_weights((5, 2, 1))))
    assert Counter(got) == Counter(again) and len(got) == docs.count()
    words = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size) for r in got) == words
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r.size for r in got if r.source == s) for s in sources}
    target = mixing.fill_targets([size[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    for s, t in zip(sources, target):
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - t) < 1e-6 * max(1, t) and r.source_size == size[s] for r in own)
        # One block a shard may be left over where a source is taken whole.
        assert abs(sum(r.taken for r in own) - t) <= max(48, 0.01 * t)
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_mixed_rows_repeat_whole_rows(spark):
    docs = edge_documents(spark)
    out = mixing.mixed_rows(docs, {"s1": 1.0, "s2": 1.0, None: 1.0}, max_repeat=2)
    assert out.columns == docs.columns
    count = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert max(count.values()) <= 2 and -7 not in count and -2 not in count
    assert mixing.mixed_rows(docs.limit(0), {}).count() == 0
    assert mixing.mix(docs, {}).count() == docs.count()


def test_neighbours_on_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[3] = (3, rows[2][1])  # a tie
    rows[40] = (40, rows[2][1])
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (220, [0.0] * 8), (240, [nan] + [1.0] * 7), (260, [inf] + [1.0] * 7), (280, [None] + [1.0] * 7), (300, []), (None, [1.0] * 8), (320, [1.0, 2.0]), (321, [3.0, 1.0])]
    rows += [rows[20], (20, [9.0] * 8)]  # repeated id: the smallest vector counts
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as dim", "4 as side", "5 as block")
    got = defaultdict(list)
    for r in knn.nearest(df, F.col("id") % 20 == 0, k=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    best = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            v = [float(np.float32(c)) for c in v]
            best[i] = min(best.get(i, v), v)
    for q in [i for i in best if i % 20 == 0]:
        all_ = []
        for c, v in best.items():
            if c != q and len(v) == len(best[q]):
                s = 0.0
                for a, b in zip(best[q], v):
                    s += a * b
                all_.append((-s, c))
        want = [(k + 1, c, -s) for k, (s, c) in enumerate(sorted(all_)[:5])]
        assert sorted(got.pop(q)) == want
    assert not got
    assert knn.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_tiles_keep_every_neighbour_and_bound_the_error(spark, monkeypatch):
    rng = np.random.default_rng(6)
    c = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=(100, 16)) * 1e-3, 1 + rng.normal(size=(100, 16)) * 1e-4])
    q = c[::17]
    codes, scale, norm, decoded, err = knn.quantise(c)
    assert codes.dtype == np.int8 and np.allclose(np.linalg.norm(c - codes * scale[:, None], axis=1), err)
    exact = {}
    for i in range(0, 500, 17):
        s = knn.inner(np.repeat(c[i][None], 500, 0), c)
        exact[i] = sorted((-v, j) for j, v in enumerate(s.tolist()) if j != i)[:7]
    # Many small blocks, strips and tiles give the same result as few large ones.
    for rows, strips, tile, strip_rows in (((512, 4096), 8, (512, 2048), 1 << 17), ((8, 8), 3, (5, 16), 1 << 17), ((8, 8), 3, (5, 16), 40)):
        monkeypatch.setattr(knn, "STRIP_ROWS", strip_rows)
        monkeypatch.setattr(knn, "QUERY_ROWS", rows)
        monkeypatch.setattr(knn, "STRIPS", strips)
        monkeypatch.setattr(knn, "TILE", tile)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<double>")
        rows_ = knn.nearest(df, F.col("id") % 17 == 0, k=7).collect()
        assert {i: sorted((-r.score, r.vec_id) for r in rows_ if r.query_id == i) for i in exact} == exact


def test_groups_come_whole(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 40) ** 2 // 40, i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "g long, v long")

    def sums(table, at):
        import pyarrow as pa

        for a, b in zip(at, at[1:]):
            part = table.slice(int(a), int(b - a))
            assert len(set(part["g"].to_pylist())) == 1
            yield pa.RecordBatch.from_arrays([pa.array([part["g"][0].as_py()]), pa.array([sum(part["v"].to_pylist())])], names=["g", "s"])

    got = [(r.g, r.s) for r in map_groups(df, ["g"], sums, "g bigint, s bigint").collect()]
    want = defaultdict(int)
    for g, v in rows:
        want[g] += v
    assert sorted(got) == sorted(want.items())


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    want = union_find(500, links)
    df = spark.createDataFrame([*links, (5, 5), (None, 3), (3, None), links[0], links[0][::-1]], "a long, b long")
    got = {r.node: r.root for r in connected.components(df).collect()}
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert connected.components(df.limit(0)).count() == 0
    a, b = np.array(links).T
    assert ngram_join.roots(500, a, b).tolist() == want


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n, links = len(texts), []
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links.append((j, i))
    return sets, links


def near_copies(rng, n, words, changes):
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 99)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block, most", [(512, 16), (16, 16), (16, 2)])
def test_join_equals_brute_force(spark, monkeypatch, block, most):
    """A large near-copy group in one cell, in many, and in cells of many tiles; links at the very threshold, copies, short and blank texts."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCKS", most)
    rng = random.Random(9)
    texts = near_copies(rng, 120, 150, 4) + near_copies(rng, 30, 60, 3)
    texts += [" ".join(f"q{i}" for i in range(13)), " ".join(f"q{i}" for i in range(12)) + " z", " ".join(f"q{i}" for i in range(14)), "a b", "a b", "a  b\n", "b a", "", None, " \t", "solo"]
    texts += [texts[0]] * 40
    rng.shuffle(texts)
    _, links = brute_links(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as h", "3 as digest", "4 as row")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    count = Counter(x for link in links for x in link)
    assert {i: got[i].n_links for i in got} == {i: count[i] for i in range(len(texts))}
    assert [got[i].class_id for i in range(len(texts))] == union_find(len(texts), links)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in range(len(texts)) if got[i].class_id == i)


def test_join_on_edge_rows(spark):
    df = edge_documents(spark)
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == df.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.class_id, r.n_links))
    assert by[-5] == by[-6] == [(-6, 1)] and by[-8] == [(-8, 1)] * 2 and by[-1] == [(-1, 0)] and by[-2] == [(-2, 0)]
    assert sorted(by[None], key=str) == [(None, 0)] * 2
    kept = Counter(r.doc_id for r in ngram_join.keep_one(df).collect())
    assert kept == Counter({None: 2, **{-i: 1 for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)}})
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0 and ngram_join.keep_one(df.limit(0)).count() == 0
    null_with_id = spark.createDataFrame([(None, "p q r s t u v"), (7, "p q r s t u v"), (None, "p q r s t u v")], "doc_id long, text string")
    assert {(r.class_id, r.n_links) for r in ngram_join.near_duplicates(null_with_id).collect()} == {(7, 2)}
    assert [r.doc_id for r in ngram_join.keep_one(null_with_id).collect()] == [7]


def test_join_keeps_ids_of_any_type(spark):
    text = "p q r s t u v"
    top = spark.createDataFrame([((1 << 63) - 5, text), (None, text), ((1 << 63) - 1, text), (3, "a")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(top).collect()}
    low = (1 << 63) - 5
    assert got == {(low, low, low, 2), (None, low, low, 2), ((1 << 63) - 1, low, low, 2), (3, 3, 3, 0)}
    assert sorted(r.doc_id for r in ngram_join.keep_one(top).collect()) == [3, low]
    names = spark.createDataFrame([("b", text), ("a", text), (None, text), (None, " "), (None, " ")], "name string, body string")
    got = [(r.name, r.class_id, r.n_links) for r in ngram_join.near_duplicates(names, id_col="name", text_col="body").collect()]
    assert sorted(got, key=str) == sorted([("b", "a", 2), ("a", "a", 2), (None, "a", 2), (None, None, 0), (None, None, 0)], key=str)
    assert sorted((r.name for r in ngram_join.keep_one(names, id_col="name", text_col="body").collect()), key=str) == [None, None, "a"]


def test_rows_of_a_group_are_written_a_bounded_number_of_times(spark):
    def written(n):
        members = spark.range(n).selectExpr("cast(cast(id as string) as binary) as digest", f"{n}L as n", "1 as band")
        return ngram_join._cells(members, "band", ngram_join.block_count(F.col("n"), F.col("n") / F.lit(ngram_join.BLOCK_SIGS))).count()

    assert [written(n) / n for n in (256, 2560, 25600)] == [1, 10, 16]


def test_posterior_steps_are_binomial_tails():
    spec = ngram_join.JoinSpec()
    rng = np.random.default_rng(10)
    for n, least in spec.least_matches():
        # Beta(m + 1, n - m + 1) by sampling, at a tolerance that sampling can see.
        loose = ngram_join.JoinSpec(tolerance=0.05)
        cut = dict(loose.least_matches())[n]
        tail = lambda m: (rng.beta(m + 1, n - m + 1, 200_000) >= 0.8).mean()
        assert tail(cut) > 0.045 and (cut == 0 or tail(cut - 1) < 0.055)
        assert 0 < least < cut


def test_op8_on_documents_equals_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001").collect()
    _, links = brute_links([r.text for r in docs])
    got = {r.doc_id: r for r in queries.op8_ngram_join(spark, "/root/testdata/sf0.001").collect()}
    count = Counter(x for link in links for x in link)
    want = union_find(len(docs), links)
    order = sorted(range(len(docs)), key=lambda i: docs[i].doc_id)
    assert [docs[i].doc_id for i in order] == sorted(got) and order == list(range(len(docs)))
    for i, r in enumerate(docs):
        assert (got[r.doc_id].class_id, got[r.doc_id].n_links) == (docs[want[i]].doc_id, count[i])


def walked_mix(docs, weights, block=16, repeat=3):
    """Copies of every document: a walk over sources, their shards in order, and the documents of a shard in theirs.

    Ids are unique here; the seeded order is the hash that Spark gives.
    """
    rows = [(r.source, r.doc_id, len(WORD.findall(r.text or "")), r.o) for r in docs.select("*", F.xxhash64(F.lit(1), "doc_id", "text").alias("o")).collect()]
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(r[2] for r in rows if r[0] == s) for s in sources]
    target = [float(t) for t in mixing.fill_targets(size, [weights[i % len(weights)] for i in range(len(size))], repeat)]
    blocks = slow_seats(target, round(sum(target) / block), [min(repeat * n // block, -int(-t // block)) for n, t in zip(size, target)])
    copies = Counter()
    for s, n, t, b in zip(sources, size, target, blocks):
        n_shards = max(1, -int(-((n / 1000) ** 0.5) // 1))
        shards = [sorted((o, i, k) for src, i, k, o in rows if src == s and o % n_shards == shard) for shard in range(n_shards)]
        shards = [x for x in shards if x]
        held = [sum(k for *_, k in x) for x in shards]
        words = [block * x for x in slow_seats(held, b, [repeat * h // block for h in held])]
        missing = round(t) - sum(words)
        for j in sorted(range(len(shards)), key=lambda j: words[j] - repeat * held[j]):
            more = max(0, min(missing, repeat * held[j] - words[j]))
            words[j], missing = words[j] + more, missing - more
        rest = 0
        for x, h, quota in zip(shards, held, words):
            rounds, left = divmod(quota, h) if h else (0, 0)
            for _, i, k in x:
                begun = min(k, left)
                left -= begun
                copies[i] += rounds if k else 0
                if 0 < begun < k:
                    rest += begun
                    whole = 2 * rest >= k
                    rest -= k * whole
                    copies[i] += whole
                elif begun:
                    copies[i] += 1
    return +copies


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        made[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = made[name][1]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, _ in corpus_pipeline.STAGES[:4]:
        assert made[name][1].columns == columns
    given, kept = made["toxicity"]
    scores = {r.doc_id: r.score for r in queries.op10_toxicity(spark, sf).collect()}
    assert ids(kept) == Counter(i for i in ids(given) if scores[i] < 0.3)
    given, kept = made["quality_rules"]
    verdict = {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, sf).collect()}
    assert ids(kept) == Counter(i for i in ids(given) if verdict[i])
    given, kept = made["ngram_join"]
    rows = sorted(given.collect(), key=lambda r: r.doc_id)
    root = union_find(len(rows), brute_links([r.text for r in rows])[1])
    assert ids(kept) == Counter(r.doc_id for i, r in enumerate(rows) if root[i] == i)
    given, kept = made["source_mixing"]
    assert ids(kept) == walked_mix(given, corpus_pipeline.MIX_WEIGHTS)
    given, out = made["piece_codec"]
    assert ids(out) == ids(given)
    text = {r.doc_id: r.text for r in given.collect()}
    assert all(r.decoded == text[r.doc_id].replace("▁", " ") and r.ids[-1] == 2 for r in out.collect())
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_pipeline_on_edge_rows(spark):
    docs = edge_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert toxicity.SEEDS


def test_pruning_loses_fewer_links_than_the_bands():
    spec = ngram_join.JoinSpec()
    alive, lost, done, t = {0: 1.0}, 0.0, 0, spec.threshold
    for n, least in spec.least_matches():
        after: dict[int, float] = defaultdict(float)
        for m, p in alive.items():
            for more in range(n - done + 1):
                after[m + more] += p * comb(n - done, more) * t**more * (1 - t) ** (n - done - more)
        lost += sum(p for m, p in after.items() if m < least)
        alive, done = {m: p for m, p in after.items() if m >= least}, n
    assert lost < (1 - t**spec.rows) ** spec.bands


def test_rounding_to_whole_documents_cancels_across_shards(spark):
    # Two sources of 400 documents of 500 words: 15 shards each, targets of 40,000 and 360,000 words.
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), 500).alias("text"))
    weights = {"a": 1.0, "b": 9.0}
    words = {r.source: r["count"] * 500 for r in mixing.mixed_rows(docs, weights).groupBy("source").count().collect()}
    taken = {r.source: r.t for r in mixing.mix(docs, weights).groupBy("source").agg(F.sum(f"{mixing.MIX}.taken").alias("t")).collect()}
    assert set(words) == {"a", "b"}
    assert all(abs(words[s] - taken[s]) <= 250 for s in words), (words, taken)


def test_sources_below_one_block_are_taken(spark):
    docs = spark.createDataFrame([(1, "w " * 5, "small"), (2, "w " * 400, "large"), (3, "w w w", "tiny")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"small": 1.0, "large": 1.0, "tiny": 1.0})
    taken = {r.source: r.t for r in mixed.select("source", F.col(f"{mixing.MIX}.taken").alias("t")).collect()}
    assert (taken["small"], taken["tiny"]) == (15, 9) and abs(taken["large"] - 384) <= 16


def test_rows_without_an_id_or_with_one_id_are_spread_over_shards(spark):
    rows = [(None if i % 3 else 7, "s", " ".join(f"w{i}x{k}" for k in range(10))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    placed = mixing._mixed(docs, {"s": 1.0})
    sizes = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert len(sizes) == 6 and max(sizes.values()) < 2 * min(sizes.values())
    run = lambda d: Counter((r.doc_id, r.text) for r in mixing.mixed_rows(d, {"s": 1.0}).collect())
    taken = run(docs)
    # The quotas of the shards are in blocks, so a row may be taken twice for another's sake; the source's words are met.
    assert taken == run(docs.repartition(5)) and taken.keys() <= {(i, t) for i, _, t in rows} and sum(taken.values()) == 3000


def test_mixing_query_takes_near_its_targets(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op1_source_mixing(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 16 and all(r.taken <= 3 * r.size for r in own)
