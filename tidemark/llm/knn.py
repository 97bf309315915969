"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries are dealt into blocks and candidates into strips of about
``STRIP_ROWS`` rows by a hash of their id; every query block meets every strip.  A strip is read tile by
tile, with the query block held.  In a tile the vectors are quantised to int8
codes with one scale each.  The product of the codes is exact (32-bit floats
hold it), and with the norms of the rounding errors it bounds each inner
product from both sides:

    |x.y - x'.y'| <= |x'| |y - y'| + |x - x'| |y|      (x' = scale * codes)

Pairs whose upper bound lies below the k-th largest lower bound of their
query in the tile, or below its k-th best score so far, can't be among its k
nearest and are dropped; the others are computed again from the original
vectors in double precision and go into the query's heap of k.  The heaps of
the strips are merged per query.

The work is queries times candidates, in tiles.  A candidate is repeated once
per query block, a query once per strip, and a strip returns k rows per
query, so no step makes a row per pair.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; an id given several
times counts once, with its smallest vector; vectors of another length than
the query's are no candidates; ties go to the smaller id; fewer than k
candidates are all returned; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import Reader, read_groups, vectors

#: Rows of a query block: an eighth of the queries between these bounds.
QUERY_ROWS = (512, 4096)

#: Least parts of the candidates that are searched side by side for a query block.
STRIPS = 8

#: Candidates of a strip, about; more rows make more strips, so a task's share doesn't grow with the table.
STRIP_ROWS = 1 << 17

#: Queries and candidates of one tile.
TILE = (512, 2048)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>, dim): one usable vector per id."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # false for null and NaN too
    cast = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = cast.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0))
    return good.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the vector, of its decoded codes, of the rounding error)."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    norm = lambda m: np.sqrt((m * m).sum(axis=1))
    return codes, scale, norm(x), norm(decoded), norm(x - decoded)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


class Search(Reader):
    """One query block against one strip; rows of side 0 are queries and come first, side 1 are candidates."""

    def __init__(self, k: int):
        self.k, self.parts, self.ready = k, [], False

    def add(self, part: pa.Table) -> None:
        side, ids, x = part["side"].to_numpy(), part["id"].to_numpy(), vectors(part["v"], np.float64)
        if (side == 0).any():
            self.parts.append((ids[side == 0], x[side == 0]))
        if self.parts and (side == 1).any():
            self.search(ids[side == 1], x[side == 1])

    def search(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.ready:
            self.qid, self.q = (np.concatenate(p) for p in zip(*self.parts))
            self.heaps: list[list[tuple[float, int]]] = [[] for _ in self.qid]
            self.floor = np.full(len(self.qid), -np.inf)
            self.codes, self.ready = quantise(self.q), True
        rows, columns = TILE
        for c in range(0, len(ids), columns):
            coded = quantise(x[c : c + columns])
            for r in range(0, len(self.qid), rows):
                self._tile(slice(r, r + rows), ids[c : c + columns], x[c : c + columns], coded)

    def _tile(self, rows: slice, cid: np.ndarray, c: np.ndarray, coded: tuple[np.ndarray, ...]) -> None:
        k, qid = self.k, self.qid[rows]
        cq, sq, nq, dq, eq = (a[rows] for a in self.codes)
        cc, sc, nc, dc, ec = coded
        # int8 codes in 32-bit floats: sums of products stay below 2 ** 24 up to 1,000 dimensions.
        exact = np.float32 if c.shape[1] <= 1000 else np.float64
        approx = (cq.astype(exact) @ cc.T.astype(exact)).astype(np.float64) * sq[:, None] * sc[None, :]
        slack = (dq[:, None] * ec[None, :] + eq[:, None] * nc[None, :]) * (1 + 1e-9) + 1e-12 * nq[:, None] * nc[None, :]
        own = qid[:, None] == cid[None, :]
        floor = self.floor[rows]
        if len(cid) > k:
            low = np.where(own, -np.inf, approx - slack)
            floor = np.maximum(floor, np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k])
        i, j = np.nonzero((approx + slack >= floor[:, None]) & ~own)
        score = inner(self.q[rows][i], c[j])
        for at, s, n in zip((i + rows.start).tolist(), score.tolist(), (-cid[j]).tolist()):
            heap = self.heaps[at]
            if len(heap) < k:
                heapq.heappush(heap, (s, n))
            else:
                heapq.heappushpop(heap, (s, n))
        for at in np.unique(i + rows.start).tolist():
            if len(self.heaps[at]) == k:
                self.floor[at] = self.heaps[at][0][0]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.ready:
            found = [(q, -n, s) for q, heap in zip(self.qid.tolist(), self.heaps) for s, n in heap]
            if found:
                query, vec, score = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products of each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    good = usable(df, id_col, vec_col)
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    n_queries, n_rows = ids.agg(F.count_if(is_query), F.count("*")).first()
    low, high = QUERY_ROWS
    blocks = max(1, -(-n_queries // min(max(n_queries // 8, low), high)))
    strips = max(STRIPS, -(-n_rows // STRIP_ROWS))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = good.where(is_query).select("dim", part(blocks).alias("block"), each(strips).alias("strip"), F.lit(0).alias("side"), "id", "v")
    candidates = good.select("dim", each(blocks).alias("block"), part(strips).alias("strip"), F.lit(1).alias("side"), "id", "v")
    found = read_groups(queries.unionByName(candidates), ["dim", "block", "strip"], lambda: Search(k), "query_id bigint, vec_id bigint, score double", order=["side"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
