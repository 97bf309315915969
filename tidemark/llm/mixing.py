"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: a source's weight times all words, at most ``max_repeat`` times its
own words; what a full source can't take is shared again by weight.  Blocks of
``block_words`` words go to sources by highest quotients (target / 1, / 3,
/ 5 ...), and a source's blocks to its shards the same way by shard size, so
each shard has an integer quota; a target that the blocks don't reach is filled
by a partial last block, so small sources are taken too.  Within a shard the documents stand in a
seeded order as one stream of words, cut into equal blocks; the quota takes
blocks from its start, going round again for repeats.

Scale: a source with S words has about sqrt(S / 1000) shards, so a hot source
is spread over many tasks and the quota step sees one short row per shard.
Only one row per source reaches the driver.

Cases: a null source is a source of its own, sorted last; a null or empty
text has size 0 and is taken 0 times; order and shard of a row come from a
hash of id and text, so rows with a null or repeated id are spread by their
texts; rows equal in both are told apart by their place only, so the result as
a set of rows is the same on every run; an empty table gives an empty result;
added columns sit in one struct, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import cycle, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The driver holds one row per source; a mix names its sources.
MAX_SOURCES = 100_000

MIX = "__mix"


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(weights: Sequence[float]) -> Callable[[int], list[float]]:
    """Weights for n sources in order, repeating ``weights``."""
    return lambda n: list(islice(cycle(weights), n))


def fill_targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float) -> np.ndarray:
    """Targets by weight of all words, none above ``max_repeat`` times its source; the excess is shared again."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    caps, targets = max_repeat * sizes, np.zeros(len(sizes))
    open_, rest = weights > 0, float(sizes.sum())
    while open_.any() and rest > 0:
        share = np.where(open_, rest * weights / weights[open_].sum(), 0.0)
        over = open_ & (share > caps)
        if not over.any():
            targets[open_] = share[open_]
            break
        targets[over] = caps[over]
        rest -= float(caps[over].sum())
        open_ &= ~over
    return targets


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), none above its cap; ties go to the earlier one.

    The divisor is found by bisection, so the work doesn't depend on the
    number of seats; the last few seats are given out one by one.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    caps = np.where(votes > 0, caps, 0)
    if seats >= caps.sum():
        return caps
    count = lambda divisor: np.minimum(np.floor(votes / divisor + 0.5), caps).astype(np.int64)
    low, high = 0.0, 2 * float(votes.max()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        low, high = (low, mid) if count(mid).sum() <= seats else (mid, high)
    got = count(high)
    for _ in range(int(seats - got.sum())):
        quotient = np.where(got < caps, votes / (2 * got + 1), -1.0)
        got[int(quotient.argmax())] += 1
    return got


def mix(df: DataFrame, weights: Callable[[int], Sequence[float]] | dict[str | None, float], **options) -> DataFrame:
    """``df`` plus a struct column ``MIX`` (in place of one it has): size, source_size, target, taken (words, repeats counted)."""
    df = df.drop(MIX)
    return _mixed(df, weights, **options).select("row.*", F.col("mix").alias(MIX))


def _mixed(
    df: DataFrame,
    weights: Callable[[int], Sequence[float]] | dict[str | None, float],
    size: Column | None = None,
    max_repeat: int = 3,
    block_words: int = 16,
    seed: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    apart: Column | None = None,
) -> DataFrame:
    """(row, mix, s, shard, begun): the whole input row, its part in the mix, its shard, and its words in the last round.

    ``weights`` gives a weight per source: a mapping, or a function from the
    number of sources to weights in source order (code points, null last).
    ``apart`` tells rows of one id apart; by default it is the text.
    """
    spark = df.sparkSession
    size = word_count(F.col(text_col).cast("string")) if size is None else size
    apart = F.col(text_col).cast("string") if apart is None else apart
    narrow = df.select(F.col(source_col).cast("string").alias("source"), size.alias("size"), _order(id_col, apart, seed).alias("o"))
    found = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n) for r in found]
    given = [float(weights.get(r.source, 0.0)) for r in found] if isinstance(weights, dict) else list(weights(len(found)))
    targets = fill_targets(sizes, given, max_repeat)
    # No source gets the seats that another is too small to hold: its cap is its target in blocks, rounded up.
    caps = [min(max_repeat * s // block_words, int(np.ceil(t / block_words))) for s, t in zip(sizes, targets)]
    blocks = sainte_lague(targets, int(round(targets.sum() / block_words)), caps) if found else []
    plan = spark.createDataFrame(
        [(r.source, i, sizes[i], float(targets[i]), int(blocks[i]), max(1, int(np.ceil(np.sqrt(sizes[i] / 1000))))) for i, r in enumerate(found)],
        "source string, s int, source_size long, target double, blocks long, shards int",
    )
    # One row per source, at most MAX_SOURCES of them.
    plan = F.broadcast(plan)
    shard = F.pmod(F.col("o"), F.col("shards")).cast("int").alias("shard")

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", kind="stable")
        n = rows["n"].to_numpy(np.int64)
        words = sainte_lague(n, int(rows["blocks"].iloc[0]), max_repeat * n // block_words) * block_words
        # What the blocks leave of the target is a partial last block, in the shards with most room.
        rest, room = int(round(rows["target"].iloc[0])) - int(words.sum()), max_repeat * n - words
        by = np.argsort(-room, kind="stable")
        words[by] += np.clip(rest - (np.cumsum(room[by]) - room[by]), 0, room[by])
        return pd.DataFrame({"s": rows["s"], "shard": rows["shard"], "n": n, "words": words})

    per_shard = (
        narrow.join(plan, narrow["source"].eqNullSafe(plan["source"])).select("s", shard, "size", "blocks", "target")
        .groupBy("s", "shard", "blocks", "target").agg(F.sum("size").alias("n"))
        .groupBy("s").applyInPandas(quotas, "s int, shard int, n long, words long")
    )
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(source_col).cast("string").alias("source"), size.alias("size"), _order(id_col, apart, seed).alias("o"), F.col(id_col).alias("at"))
    placed = row.join(plan, row["source"].eqNullSafe(plan["source"])).select("row", "size", "o", "at", "s", "source_size", "target", shard)
    line = Window.partitionBy("s", "shard").orderBy("o", "at", "size").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn("end", F.sum("size").over(line)).join(per_shard, ["s", "shard"])
    rounds, part = F.expr("words div greatest(n, 1)"), F.expr("words % greatest(n, 1)")
    begun = F.greatest(F.lit(0), F.least("end", part) - (F.col("end") - F.col("size")))
    taken = rounds * F.col("size") + begun
    return joined.select("row", F.struct("size", "source_size", "target", taken.cast("long").alias("taken")).alias("mix"), "s", "shard", begun.cast("long").alias("begun"))


def _order(id_col: str, apart: Column, seed: int) -> Column:
    """Seeded place of a document in its source's streams, by id and text: rows
    without an id, or with one that repeats, are spread by their texts."""
    return F.xxhash64(F.lit(seed), F.col(id_col), apart)


def _cut_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """Which of a source's cut documents stay: the rest of each rounding goes on to the next shard."""
    rows, rest, keep = rows.sort_values("shard", kind="stable"), 0, []
    for size, begun in zip(rows["size"].tolist(), rows["begun"].tolist()):
        rest += begun
        keep.append(2 * rest >= size)
        rest -= size * keep[-1]
    return pd.DataFrame({"s": rows["s"], "shard": rows["shard"], "keep": keep})


def mixed_rows(df: DataFrame, weights, **options) -> DataFrame:
    """The mixed corpus: whole rows of ``df``, each as often as the mix takes it.

    At most one document of a shard is cut by its quota; it is taken whole or
    not, so that a source ends within half of its longest cut document of its
    taken words.
    """
    mixed = _mixed(df, weights, **options)
    size, is_cut = F.col("mix.size"), (F.col("begun") > 0) & (F.col("begun") < F.col("mix.size"))
    # One short row per shard, without the texts' columns.
    cut = mixed.where(is_cut).select("s", "shard", size.alias("size"), "begun")
    keep = cut.groupBy("s").applyInPandas(_cut_ends, "s int, shard int, keep boolean")
    whole = F.expr("mix.taken div greatest(mix.size, 1)")
    copies = (whole + F.when(is_cut & F.col("keep"), 1).otherwise(0)).cast("int")
    counted = mixed.join(keep, ["s", "shard"], "left").select("row", copies.alias("copies"))
    return counted.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
