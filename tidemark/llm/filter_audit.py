"""Audit of how filters interact: what each removes at every place of every order.

1. Each document gets the set of filters it fails, as a bit mask; documents
   are counted by (part, mask), with those labelled good and toxic.
2. All orders of the filters are numbered lexicographically (Lehmer rank).  A
   document leaves at the first filter of its mask.  The orders that begin
   with given filters outside the mask and then one of the mask are one
   interval of ranks, so a mask's removals at a step are a few intervals.
3. Counts are added at the beginnings of the intervals and taken off at their
   ends; a prefix sum over the ranks gives the removals of every order.

Work after the first step depends on the number of parts and masks only, not
on documents times orders.

Scale: texts are read once and never move; rows of an id, a digest and a few
bits do.  Equal rows are counted before any shuffle, the first of each group
of copies is found by partial aggregation and matched on (digest, id), and
labels meet an id in ``SALTS`` tasks, so no hot text, id or part is in one task;
labels are never broadcast.

Cases: a null text is empty, a null part is the empty string; a row with a
null id comes after no other, so it is no repeat, and it has no labels;
repeated rows of one id and text are not repeats of each other; an id with
several labels counts as good (toxic) if one says so, null labels say nothing;
labels without a document don't count; texts are read whole; an empty table
gives no part and no row; only the named columns are read, so others can't
clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage

#: Tasks that share the rows of one id when labels are joined.
SALTS = 8


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D on a text without null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def bits(conditions: Sequence[Column]) -> Column:
    """Bit i is set where condition i holds."""
    total = F.lit(0)
    for i, c in enumerate(conditions):
        total = total + F.when(c, 1 << i).otherwise(0)
    return total


def failure_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, digest, mask, n): rows by the filters A to E that they fail.

    E is failed by a text that a smaller id has.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    read = df.select(F.col(id_col).alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits(list(text_failures(text).values())).alias("own"))
    # Read twice below; the texts are read once.
    rows = cut_lineage(read.groupBy("id", "part", "digest", "own").agg(F.count("*").alias("n")))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    repeat = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id"], "left").select("id", "part", "digest", (F.col("own") + F.when(repeat, 16).otherwise(0)).alias("mask"), "n")


def label_flags(rows: DataFrame, labels: DataFrame, flags: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """``rows`` (id, digest, ...) plus a 0/1 column for each of ``flags``."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.when(F.col(f) == 1, 1).otherwise(0)).alias(f) for f in flags))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Rows with a null id meet nothing, wherever they are sent.
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    dealt = rows.withColumn("salt", F.when(F.col("id").isNotNull(), salt).otherwise(-1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).cast("int"))
    # Each label stands SALTS times in ``spread``, which Spark's estimate leaves out: broadcast, it would fill the driver.
    return dealt.join(spread.hint("merge"), ["id", "salt"], "left").drop("salt").fillna(0, list(flags))


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): the ranks of the orders of ``k`` filters in which the mask leaves at the step.

    Neighbouring intervals of a mask and step are joined; ``end`` is exclusive.
    """
    out: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << k):
        outside = [f for f in range(k) if not mask >> f & 1]
        for before in range(len(outside) + 1):
            width, found = factorial(k - before - 1), []
            for head in permutations(outside, before):
                for f in range(k):
                    if mask >> f & 1:
                        begin = _rank((*head, f), k)
                        found.append((begin, begin + width))
            found.sort()
            joined = [list(found[0])]
            for begin, end in found[1:]:
                if begin == joined[-1][1]:
                    joined[-1][1] = end
                else:
                    joined.append([begin, end])
            out.extend((mask, before + 1, begin, end) for begin, end in joined)
    return out


def _rank(head: Sequence[int], k: int) -> int:
    """Rank of the first order that begins with ``head``: Lehmer digits times factorials."""
    return sum((f - sum(g < f for g in head[:i])) * factorial(k - 1 - i) for i, f in enumerate(head))


def audit_orders(counts: DataFrame, names: str, totals: Sequence[str] = ("n", "good", "toxic")) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <total>_lost ..., shapley) for all orders of the filters.

    ``counts`` has part, mask (bit i: fails the filter ``names[i]``) and the
    columns ``totals``, the first of which counts documents.  ``names`` are
    single letters, in lexicographic order.
    """
    spark, k = counts.sparkSession, len(names)
    if list(names) != sorted(set(names)) or not 0 < k < 8:
        raise ValueError("names must be one to seven different letters in order")
    count, *lost = totals
    # Tables of a size that depends on the number of filters only.
    spans = F.broadcast(spark.createDataFrame(removal_intervals(k), "mask int, step int, begin int, end int"))
    places = [(rank, "".join(names[f] for f in order), step + 1, f) for rank, order in enumerate(permutations(range(k))) for step, f in enumerate(order)]
    orders = F.broadcast(spark.createDataFrame(places, "rank int, filter_order string, step int, filter int"))

    by_mask = counts.groupBy("part", "mask").agg(*(F.sum(t).cast("long").alias(t) for t in totals))
    ends = by_mask.join(spans, "mask").select(
        "part", "step", F.explode(F.array(*(F.struct(F.col(at).alias("rank"), *((sign * F.col(t)).alias(t) for t in totals)) for at, sign in (("begin", 1), ("end", -1))))).alias("e")
    )
    parts = by_mask.select("part").distinct()
    grid = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))))
    marks = ends.select("part", "step", "e.*").unionByName(grid.select("part", "step", "rank", *(F.lit(0).cast("long").alias(t) for t in totals)))
    steps = marks.groupBy("part", "step", "rank").agg(*(F.sum(t).alias(t) for t in totals))
    up_to = Window.partitionBy("part", "step").orderBy("rank")
    removed = steps.select("part", "step", "rank", *(F.sum(t).over(up_to).alias(t) for t in totals)).join(orders, ["rank", "step"])

    fails = by_mask.select("part", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("filter"), "mask", count)
    alone = F.sum(F.when(F.expr("mask = shiftleft(1, filter)"), F.col(count)).otherwise(0))
    whole = F.sum(F.when(F.expr("shiftright(mask, filter) & 1 = 1"), F.col(count)).otherwise(0))
    fails = fails.groupBy("part", "filter").agg(whole.alias("fails"), alone.alias("alone"), F.sum(count).alias("all"))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    return removed.join(fails, ["part", "filter"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("all") - F.sum(count).over(so_far)).alias("kept"),
        F.col(count).alias("removed"),
        (F.col("fails") - F.col(count)).alias("redundant"),
        F.col("alone").alias("unique_fails"),
        *(F.col(t).alias(f"{t}_lost") for t in lost),
        F.sum(count).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E by source, with good (quality 1) and toxic documents lost."""
    rows = label_flags(failure_masks(documents), labels, ["quality", "toxic"])
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("quality") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic")
    )
    # Parts times masks: read several times by the audit.
    return audit_orders(cut_lineage(counts), "ABCDE")
