"""Output contracts and leakage checks.

Each contract is one aggregate returning a (check_name, passed, detail) table,
so a pipeline can store the checks next to its outputs; ``assert_passed``
raises on the driver when a check fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blend import align_to_ids
from .ranks import prefix_sums


def with_position(ids: DataFrame, id_col: str, order: str | None = None, pos: str = "pos") -> DataFrame:
    """Stored 0-based row position (D12) by ``order`` (default: the id)."""
    order = order or id_col
    base = ids.select(*dict.fromkeys([id_col, order])).withColumn("__one", F.lit(1))
    p = prefix_sums(base, [], [order, id_col] if order != id_col else [id_col], ["__one"])
    return p.select(id_col, F.col("__one_before").cast("long").alias(pos))


def submission_table(test_ids: DataFrame, scores: DataFrame, id_col: str, score: str = "target_value",
                     pos: str = "pos") -> DataFrame:
    """(id, score, pos) in test order; raises when an id has no
    score.  Write with ``orderBy(pos)``."""
    ordered = with_position(test_ids, id_col, pos=pos)
    return align_to_ids(ordered, scores.select(id_col, score), id_col, pos).select(id_col, score, pos)


def submission_contract(sub: DataFrame, test_ids: DataFrame, id_col: str, score: str = "target_value",
                        pos: str = "pos", columns: Sequence[str] | None = None) -> DataFrame:
    """Exact columns, row count, id order, unique ids, finite scores in [0, 1]."""
    s = sub.sparkSession
    want = list(columns or [id_col, score])
    have = [c for c in sub.columns if c != pos]
    x = F.col(score)
    ref = with_position(test_ids, id_col, pos="__tpos")
    order_ok = sub.join(ref, (sub[id_col] == ref[id_col]) & (sub[pos] == ref["__tpos"]), "inner").select(F.count(F.lit(1))).scalar()
    n_ref = test_ids.select(F.count(F.lit(1))).scalar()
    agg = sub.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("nd"),
        F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"),
        F.count_if((x < 0) | (x > 1)).alias("out_of_range"))
    head = s.createDataFrame([("columns", have == want, ",".join(have))], "check_name string, passed boolean, detail string")
    rest = agg.select(F.explode(F.array(
        _check("row_count", F.col("n") == n_ref, F.col("n")),
        _check("unique_ids", F.col("nd") == F.col("n"), F.col("nd")),
        _check("id_order", order_ok == n_ref, order_ok),
        _check("finite", F.col("bad") == 0, F.col("bad")),
        _check("range_0_1", F.col("out_of_range") == 0, F.col("out_of_range")),
    )).alias("c")).select("c.*")
    return head.unionByName(rest)


def _check(name: str, passed, detail):
    return F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), detail.cast("string").alias("detail"))


def non_finite_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing / NaN / infinite values per column (one aggregate)."""
    return df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in cols])


def assert_passed(checks: DataFrame) -> None:
    bad = [r["check_name"] for r in checks.filter(~F.col("passed")).select("check_name").collect()]
    if bad:
        raise ValueError(f"contract checks failed: {bad}")


#: Hash ranges that :func:`permute` orders apart, a power of two.
PLACE_RANGES = 4096


def permute(df: DataFrame, col: str, id_col: str, seed: int = 7) -> DataFrame:
    """``df`` with the values of ``col`` dealt to other rows: the value at each
    place of one seeded order goes to the row at that place of another.

    An order is by hash, so its ranges hold like numbers of rows: one window
    per range, and the rows of all lower ranges (``PLACE_RANGES`` sums) added."""
    def placed(cols, s):
        h = df.select(*cols, F.xxhash64(F.col(id_col), F.lit(s)).alias("__h"))
        h = h.withColumn("__range", F.shiftright("__h", 64 - (PLACE_RANGES.bit_length() - 1)))
        sizes = h.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
        lower = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        lower = sizes.select("__range", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__lower"))
        within = Window.partitionBy("__range").orderBy("__h", F.col(id_col).asc_nulls_last())
        ranked = h.withColumn("__rank", F.rank().over(within) - 1)
        return ranked.join(F.broadcast(lower), "__range").withColumn("__place", F.col("__rank") + F.col("__lower"))

    values = placed([id_col, col], seed).select("__place", col)
    rows = placed([id_col], seed + 1).select(id_col, "__place")
    return df.drop(col).join(rows.join(values, "__place").drop("__place"), id_col).select(*df.columns)


def label_free(build, df: DataFrame, target: str, id_col: str, seed: int = 7) -> bool:
    """Features built from ``df`` and from ``df`` with a permuted target
    must be identical: every row comes as often on both sides, which one
    grouping of both tells."""
    perm = permute(df, target, id_col, seed)
    a = build(df).drop(target)
    b = build(perm).drop(target).select(*a.columns)
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__side").alias("__more")).filter(F.col("__more") != 0).isEmpty()
