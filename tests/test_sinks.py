"""Digests of files in byte ranges, and runs that are visible only when whole."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks as sk


def test_chunk_digests_of_files_of_any_size(spark, tmp_path):
    rng = random.Random(2)
    sizes = {"empty": 0, "one": 1, "edge": 1000, "over": 1001, "large%41 file": 54_321}
    data = {n: rng.randbytes(k) for n, k in sizes.items()}
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    read = lambda tasks: sk.chunk_digests(spark, [str(tmp_path)], 1000, tasks)
    data.pop("empty")  # no row: Spark's file sources pass over empty files
    got = {(r.path.rsplit("/", 1)[1], r.chunk): r for r in read(7).collect()}
    want = {(n, i): d[i * 1000 : i * 1000 + 1000] for n, d in data.items() for i in range(-(-len(d) // 1000))}
    assert got.keys() == want.keys() and all(got[k].sha256 == hashlib.sha256(d).hexdigest() and got[k].length == len(d) and got[k].offset == k[1] * 1000 for k, d in want.items())
    # One file is read by several tasks.
    large = read(7).filter(F.col("path").endswith("file")).select(F.spark_partition_id()).distinct().count()
    assert large > 1
    roots = {r.path.rsplit("/", 1)[1]: r for r in sk.tree_digests(read(3), 4).collect()}
    for n, d in data.items():
        level = [hashlib.sha256(want[n, i]).hexdigest() for i in range(-(-len(d) // 1000))]
        k = len(level)
        while len(level) > 1:
            level = [hashlib.sha256("".join(g).encode()).hexdigest() if len(g) > 1 else g[0] for g in (level[i : i + 4] for i in range(0, len(level), 4))]
        assert (roots[n].sha256, roots[n].length, roots[n].n_chunks) == (level[0], len(d), k)
    assert roots["edge"].sha256 == hashlib.sha256(data["edge"]).hexdigest()


def test_a_changed_byte_is_named_by_its_chunk(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(10_000))
    card = spark.createDataFrame(sk.chunk_digests(spark, [str(tmp_path)], 1000).collect())
    new = bytearray(10_500)
    new[4321] = 1
    (tmp_path / "f").write_bytes(bytes(new))
    now = sk.chunk_digests(spark, [str(tmp_path)], 1000)
    assert sorted((r.chunk, r.change) for r in sk.changed_chunks(now, card).collect()) == [(4, "changed"), (10, "added")]
    assert sorted((r.chunk, r.change) for r in sk.changed_chunks(card, now).collect()) == [(4, "changed"), (10, "removed")]


def test_only_committed_runs_are_seen(spark, tmp_path):
    root = str(tmp_path / "runs")
    good, other = spark.range(5).withColumn("v", F.lit(1.0)), spark.range(7).withColumn("v", F.lit(float("nan")))
    lost = good.withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    first = sk.write_committed_run(root, "a_20240101T000000Z_seed1", {"scores": good, "metrics": good})
    with pytest.raises(Exception, match="lost"):
        sk.write_committed_run(root, "a_20240201T000000Z_seed1", {"scores": other, "metrics": lost})
    with pytest.raises(Exception, match="lost"):
        sk.write_committed_run(root, "a_20240101T000000Z_seed1", {"scores": other, "metrics": lost})
    runs = sk.committed_runs(spark, root).collect()
    assert [(r.run_id, r.attempt, r.artifacts) for r in runs] == [("a_20240101T000000Z_seed1", first, ["metrics", "scores"])]
    assert [r.run_id for r in sk.latest_runs(sk.run_ids(sk.committed_runs(spark, root))).collect()] == ["a_20240101T000000Z_seed1"]
    assert sk.read_committed(spark, root, "scores").count() == 5
    # A repeat that comes through replaces what is seen.
    second = sk.write_committed_run(root, "a_20240101T000000Z_seed1", {"scores": other, "metrics": good})
    got = sk.read_committed(spark, root, "scores").collect()
    assert second != first and len(got) == 7 and all(r.v is None and set(r.asDict()) == {"id", "v", "run_id"} for r in got)
