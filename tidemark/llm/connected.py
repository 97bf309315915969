"""Connected components by alternating large-star and small-star rounds.

Each round hangs every node's larger (then smaller) neighbours below the
smallest one it knows; the rounds end when every edge leads to a root.  Only
edges are moved, minima are pre-aggregated, and the neighbours of a hub meet
its minimum in ``SALTS`` tasks.  Lineage is cut after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Tasks that share the neighbours of one node.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for all but the roots of ``edges`` (a, b).

    Edges may repeat, run in both directions or lead to themselves; nulls are left out.
    """
    tree = cut_lineage(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("a is not null and b is not null and a <> b").distinct()
    )
    while not _is_forest(tree):
        both = tree.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(tree.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Large star: larger neighbours go below the smallest of the neighbourhood.
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = dealt.join(salted, ["u", "salt"]).select(F.least("m", "u").alias("lo"), F.col("v").alias("hi")).distinct()
        # Small star: the node and its smaller neighbours go below the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), "hi"))).alias("e"))
        tree = cut_lineage(small.select("e.lo", "e.hi").where("lo < hi").distinct())
    return tree.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _is_forest(tree: DataFrame) -> bool:
    """Every node has one parent, and no parent has a parent."""
    inner = tree.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        tree.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = inner.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return bad.isEmpty()
