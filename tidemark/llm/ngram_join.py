"""Word n-gram Jaccard self-join with Bayesian pruning of candidates.

1. Every text becomes its set of distinct word ``n``-grams (a text of fewer
   words is one gram).  Texts with equal sets form one class of copies; only
   one representative of each goes on.
2. Candidates share a band of MinHash values.  Within a bucket, pairs are
   compared a few MinHash values at a time; after m matches in n the
   similarity has the posterior Beta(m + 1, n - m + 1), and a pair is dropped
   as soon as P(similarity >= threshold) falls below ``tolerance``.
3. Survivors are joined into components; within a component every pair of
   representatives is verified exactly on the whole sets.

No pair becomes a row.  Large buckets and components are cut into blocks and
every two blocks meet in a cell of bounded size; a cell returns one row per
member (its number of links and the root of its links in the cell).  A row is
written once per block of its group: at most ``GROUP_BLOCKS`` times, until the
group passes ``GROUP_BLOCKS`` blocks of full size (``BLOCK_SIGS`` signatures,
``BLOCK_GRAMS`` grams).  Comparisons run in numpy, in tiles of a cell, over
many tasks.  Copies are counted by class size.

Every link is found unless its two texts share none of the bands (3.2e-6 at
similarity 0.8 with 24 bands of 4) or are dropped by the posterior (7.6e-8
over its six steps), and no chain of survivors connects them otherwise.

Cases: null, empty and blank texts have no gram and no link, each is its own
class; texts are read whole; repeated rows are copies of each other; ids keep
their type, which must have an order; a null id stands for itself and sorts
last, its class id is null unless the class has an id; an empty table gives an
empty result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage

from .connected import SALTS, components
from .grouped import map_groups
from .text import NON_BLANK, Words, grams, mix, slices, spans, strings

#: Rows of a tile, the least that a block holds; two blocks meet in a cell.
BLOCK_ROWS = 256

#: Blocks of a group whose blocks are not full yet.
GROUP_BLOCKS = 16

#: Signatures of a full block.
BLOCK_SIGS = 1 << 14

#: Grams of a full block, about; long texts make smaller blocks.
BLOCK_GRAMS = 1 << 20

#: Pairs compared at once in a cell.
PAIRS = 1 << 18


@dataclass(frozen=True)
class JoinSpec:
    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-8

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, fewest matches to go on): below it P(similarity >= threshold) < tolerance."""
        out = []
        for n in range(self.step, self.hashes + 1, self.step):
            # Beta(m + 1, n - m + 1) lies above t with the probability that at most m of n + 1 trials with chance t succeed.
            tail, m = 0.0, 0
            while m <= n:
                tail += comb(n + 1, m) * self.threshold**m * (1 - self.threshold) ** (n + 1 - m)
                if tail >= self.tolerance:
                    break
                m += 1
            out.append((n, m))
        return out


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(k, h): the id behind a flag that puts null ids last, and a hash of the text."""
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    return key.alias("k"), F.xxhash64(F.col(text_col).cast("string")).alias("h")


def gram_sets(texts: pa.Array, n_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct gram hashes) of the texts of a slice that have a word."""
    raw, offsets = spans(texts)
    words = Words(raw, offsets, NON_BLANK)
    hashes, count = words.hashes(), np.diff(words.first)
    h, at = grams(hashes, words.first, n_words)
    begin = np.searchsorted(at, words.first)
    for i in np.flatnonzero(count).tolist():
        if count[i] >= n_words:
            yield i, np.unique(h[begin[i] : begin[i + 1]])
        else:
            own = hashes[words.first[i] : words.first[i + 1]]
            yield i, grams(own, np.array([0, len(own)]), len(own))[0]


def _minhash_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return seeds[:n], seeds[n:] | np.uint64(1)


def minhash(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values (uint32), a row of ``n`` per set."""
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), n), np.uint32)
    for k, (x, m) in enumerate(zip(*_minhash_keys(n))):
        out[:, k] = np.minimum.reduceat((flat ^ x) * m, starts) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray, spec: JoinSpec) -> np.ndarray:
    """A 64-bit key per band, the band's number mixed in."""
    parts = sig.reshape(len(sig), spec.bands, spec.rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, spec.bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(spec.rows):
        key = mix(key ^ (parts[:, :, r] + np.uint64(r + 1)))
    return key.view(np.int64)


def signatures(df: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    """k, h, digest (null without a word), size, sig, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(2))):
                digest, size, sig, bands = ([None] * len(part) for _ in range(4))
                found = list(gram_sets(part, spec.words))
                if found:
                    values = minhash([s for _, s in found], spec.hashes)
                    keys = band_keys(values, spec)
                    for row, (i, s) in enumerate(found):
                        digest[i], size[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s)
                        sig[i], bands[i] = values[row].tobytes(), keys[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, len(part)) for c in (0, 1)),
                        pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["k", "h", "digest", "size", "sig", "bands"],
                )

    texts = df.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    key = texts.schema["k"].dataType.simpleString()
    return texts.mapInArrow(run, f"k {key}, h bigint, digest binary, size bigint, sig binary, bands array<bigint>")


def block_count(rows: Column, full: Column) -> Column:
    """Blocks of a group of ``rows`` rows that fill ``full`` whole blocks."""
    return F.greatest(F.least(F.ceil(rows / F.lit(BLOCK_ROWS)), F.lit(GROUP_BLOCKS)), F.ceil(full))


def _cells(df: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Deals the rows of each ``group`` into ``blocks`` blocks (column ``own``) and repeats each row for the cells (i, j) of its block."""
    own = df.withColumn("g", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("digest", group), F.col("g")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return cells.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _cell_pairs(own: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a cell in parts: all of one block, or one block with the other."""
    if i == j:
        left = right = np.arange(len(own))
    else:
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    rows = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), rows):
        a = np.repeat(left[at : at + rows], len(right))
        b = np.tile(right, len(left[at : at + rows]))
        if i == j:
            keep = a < b
            a, b = a[keep], b[keep]
        if len(a):
            yield a, b


def _tiles(own: np.ndarray, size: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(rows, own, i, j) of the tiles of a cell: smaller cells of up to ``BLOCK_ROWS`` rows or about ``BLOCK_GRAMS`` grams a side."""

    def parts(rows: np.ndarray) -> list[np.ndarray]:
        full = np.arange(len(rows)) // BLOCK_ROWS + np.cumsum(size[rows]) // BLOCK_GRAMS
        return np.split(rows, np.flatnonzero(np.diff(full)) + 1)

    left = parts(np.flatnonzero(own == i))
    right = left if i == j else parts(np.flatnonzero(own == j))
    for x, a in enumerate(left):
        if i == j:
            yield a, np.zeros(len(a), np.int32), 0, 0
        for b in right[x + 1 :] if i == j else right:
            yield np.r_[a, b], np.repeat(np.array([0, 1], np.int32), [len(a), len(b)]), 0, 1


def roots(n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Smallest row of the component of each of ``n`` rows under the links a-b and those to the ``known`` roots."""
    if not len(a):
        return np.arange(n) if known is None else known
    label = np.arange(n)
    if known is not None:
        member = np.flatnonzero(known != label)
        a, b = np.r_[a, member], np.r_[b, known[member]]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, spec: JoinSpec, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior stays above the tolerance at every step."""
    matches, done = np.zeros(len(a), np.int32), 0
    for n, least in steps:
        matches += (sig[a, done:n] == sig[b, done:n]).sum(axis=1, dtype=np.int32)
        alive = matches >= least
        a, b, matches, done = a[alive], b[alive], matches[alive], n
        if not len(a):
            break
    return a, b


def survivors(reps: DataFrame, spec: JoinSpec) -> DataFrame:
    """(a, b) digests: in each cell of a bucket, every survivor's edge to the root of its survivors."""
    banded = reps.select("digest", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    # Bands with the same members need one comparison: keep one of them.
    buckets = buckets.groupBy("n", "sum").agg(F.min("band").alias("band")).drop("sum")
    members = banded.join(buckets, "band").join(reps.select("digest", "sig"), "digest")
    cells = _cells(members, "band", block_count(F.col("n"), F.col("n") / F.lit(BLOCK_SIGS))).select("band", "i", "j", "own", "digest", "sig")
    steps = spec.least_matches()

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        digest = table["digest"].combine_chunks()
        own, i, j = (table[c].to_numpy() for c in ("own", "i", "j"))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # Small groups are compared together, large ones in parts of their own.
        pend: list[tuple[np.ndarray, np.ndarray]] = []
        n_pend = 0
        for s, e in zip(at.tolist(), at[1:].tolist()):
            label = np.arange(e - s)
            for a, b in _cell_pairs(own[s:e], int(i[s]), int(j[s])):
                if e - s <= 64:
                    pend.append((a + s, b + s))
                    n_pend += len(a)
                else:
                    # Only the roots of the survivors so far are held.
                    label = roots(e - s, *prune(sig[s:e], a, b, spec, steps), label)
            member = np.flatnonzero(label != np.arange(e - s))
            found.append((member + s, label[member] + s))
            if n_pend > PAIRS:
                found.append(prune(sig, *(np.concatenate(x) for x in zip(*pend)), spec, steps))
                pend, n_pend = [], 0
        if pend:
            found.append(prune(sig, *(np.concatenate(x) for x in zip(*pend)), spec, steps))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            if len(a):
                label = roots(table.num_rows, a, b)
                member = np.flatnonzero(label != np.arange(table.num_rows))
                yield pa.RecordBatch.from_arrays([digest.take(pa.array(member)), digest.take(pa.array(label[member]))], names=["a", "b"])

    return map_groups(cells, ["band", "i", "j"], run, "a binary, b binary")


def jaccard_links(sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs whose sets have exact Jaccard similarity ``threshold`` or more."""
    size = np.array([len(s) for s in sets], np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    # A gram of one set only is in no intersection.
    shared = often[column] > 1
    rank = np.cumsum(often > 1) - 1
    row, column = row[shared], rank[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width, n_columns = 4096, int(column[-1]) + 1 if len(column) else 0
    found = []
    for a, b in pairs:
        left, right = np.unique(a), np.unique(b)
        inter = np.zeros((len(left), len(right)), np.int64)
        for c in range(0, n_columns, width):
            s, e = np.searchsorted(column, [c, c + width])
            part = np.zeros((len(sets), min(width, n_columns - c)), np.float32)
            part[row[s:e], column[s:e] - c] = 1.0
            inter += (part[left] @ part[right].T).astype(np.int64)
        both = inter[np.searchsorted(left, a), np.searchsorted(right, b)]
        ok = both * threshold.denominator >= threshold.numerator * (size[a] + size[b] - both)
        found.append((a[ok], b[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


def verified(df: DataFrame, reps: DataFrame, members: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    """(digest, root, add, whole): links of each representative in each cell of its component.

    ``add`` counts linked rows (copies included), ``root`` is the smallest
    digest it is linked with in the cell, ``whole`` tells that the cell holds
    its whole component.
    """
    sizes = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("size").alias("grams"))
    wanted = members.join(sizes, "comp").select("k", "h", "digest", "n", "comp", "m", "grams")
    texts = df.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text")).join(wanted, ["k", "h"])
    # Repeated rows of a representative bring its text several times.
    once = Window.partitionBy("k", "h", "digest").orderBy(F.lit(0))
    texts = texts.withColumn("copy", F.row_number().over(once)).where("copy = 1").drop("copy")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(0))):
                sets = [b""] * len(part)
                for i, s in gram_sets(part, spec.words):
                    sets[i] = s.tobytes()
                rest = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *rest.columns[1:]], names=["grams_of", *rest.schema.names[1:]])

    sets = texts.select("text", "digest", "n", "comp", "m", "grams").mapInArrow(to_sets, "grams_of binary, digest binary, n bigint, comp binary, m bigint, grams bigint")
    blocks = block_count(F.col("m"), F.col("grams") / F.lit(BLOCK_GRAMS))
    cells = _cells(sets, "comp", F.least(blocks, F.col("m")))
    threshold = Fraction(str(spec.threshold))

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, i, j, n, g = (table[c].to_numpy() for c in ("own", "i", "j", "n", "g"))
        digest = table["digest"].combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(at.tolist(), at[1:].tolist()):
            if e - s < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table["grams_of"].slice(s, e - s).to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            add, label = np.zeros(e - s, np.int64), np.arange(e - s)
            for rows, side, left, right in _tiles(own[s:e], size, int(i[s]), int(j[s])):
                a, b = (rows[x] for x in jaccard_links([sets[r] for r in rows], _cell_pairs(side, left, right), threshold))
                np.add.at(add, a, n[s:e][b])
                np.add.at(add, b, n[s:e][a])
                label = roots(e - s, a, b, label)
            member = np.flatnonzero(add)
            if len(member):
                out.append((member + s, label[member] + s, add[member]))
        if out:
            member, root, add = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [digest.take(pa.array(member)), digest.take(pa.array(root)), pa.array(add), pa.array(g[member] == 1)], names=["digest", "root", "add", "whole"]
            )

    # Within a cell rows come by digest, so the first row of a component is its smallest.
    return map_groups(cells.select("comp", "i", "j", "own", "g", "n", "digest", "grams_of"), ["comp", "i", "j"], run, "digest binary, root binary, add bigint, whole boolean", order=["digest"])


def join_classes(df: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, h, root (struct k, h: the row its class keeps), copy (the same for its copies), n_links of every row.

    ``n_links`` counts all other rows with similarity ``threshold`` or more.
    """
    rows = cut_lineage(signatures(df, spec, id_col, text_col))
    node = F.struct("k", "h")
    reps = cut_lineage(
        rows.where("digest is not null").groupBy("digest").agg(F.min(node).alias("node"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    tree = components(survivors(reps, spec))
    label = tree.select(F.col("node").alias("digest"), F.col("root").alias("comp")).unionByName(tree.select(F.col("root").alias("digest"), F.col("root").alias("comp")).distinct())
    members = label.join(reps.select("digest", "n", "size", "node.k", "node.h"), "digest")
    found = cut_lineage(verified(df, reps, members, spec, id_col, text_col))
    # Components in one cell are settled there; the others are connected across their cells.
    split = components(found.where("not whole").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    split = split.unionByName(split.select(F.col("root").alias("node"), "root").distinct())
    settled = found.where("whole").select("digest", "root").unionByName(split.select(F.col("node").alias("digest"), "root"))
    links = found.groupBy("digest").agg(F.sum("add").alias("add"))
    classed = reps.select("digest", "node", "n").join(settled, "digest", "left").join(links, "digest", "left")
    # Most texts are a class of their own; members of a class meet its smallest row in SALTS tasks.
    alone, members = classed.where("root is null"), classed.where("root is not null")
    smallest = members.groupBy("root").agg(F.min("node").alias("kept")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = members.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(smallest, ["root", "salt"])
    n_links = (F.coalesce("add", F.lit(0)) + F.col("n") - 1).alias("n_links")
    known = alone.select("digest", F.col("node").alias("kept"), F.col("node").alias("copy"), n_links).unionByName(
        members.select("digest", "kept", F.col("node").alias("copy"), n_links)
    )
    # Texts without a word have no digest and don't take part in the join.
    out = rows.where("digest is not null").select("k", "h", "digest").join(known, "digest")
    blank = rows.where("digest is null").select("k", "h", node.alias("root"), node.alias("copy"), F.lit(0).cast("bigint").alias("n_links"))
    return out.select("k", "h", F.col("kept").alias("root"), "copy", "n_links").unionByName(blank)


def near_duplicates(df: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class of linked texts), copy_id (of its equal gram sets), n_links."""
    found = join_classes(df, spec, id_col, text_col)
    return found.select(F.col("k.id").alias(id_col), F.col("root.k.id").alias("class_id"), F.col("copy.k.id").alias("copy_id"), "n_links")


def keep_one(df: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, one per class: that with the smallest id.  Texts without a word all stay."""
    found = join_classes(df, spec, id_col, text_col)
    gone = found.where((F.col("root.k") != F.col("k")) | (F.col("root.h") != F.col("h"))).select("k", "h").distinct()
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *row_key(id_col, text_col), F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    # Repeated rows have one key; the first of them stays.  Texts without a word share a key and stay out of that shuffle.
    first = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(0)))
    kept = whole.where("words").join(gone, ["k", "h"], "left_anti").withColumn("copy", first).where("copy = 1")
    return kept.select("row.*").unionByName(whole.where("not words").select("row.*"))
