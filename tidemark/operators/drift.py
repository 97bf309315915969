"""Train-vs-test drift and univariate signal reports
(E24-E26, E28, E32, E33, E38, H06).

Every per-column report unpivots the columns to ``(column_name, domain, x)``
and runs one grouped job: the exact AUC of every column comes out of one
:func:`metrics.auc_table` keyed by column, medians and quantiles of every
column out of one distinct-value prefix pass (:func:`exact_quantiles`), so no
group of values is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType

from ..functions.categorical import normalize
from .metrics import auc_table
from ..session import cut_lineage
from .ranks import prefix_sums


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (same rule as ``percentile`` and
    ``quantile_cont``) per ``keys`` group: one row per (keys..., q).

    Distinct-value counts get their position range and the group total from
    one prefix pass; each row checks which interpolation positions
    (floor / ceil of ``(n - 1) q``) it covers, and a final ``groupBy(keys, q)``
    combines the (at most two) hits.  No join, nothing collected per group.
    """
    keys = list(keys)
    src = long if keys else long.withColumn("__g", F.lit(0))
    gk = keys or ["__g"]
    dist = src.filter(F.col(value).isNotNull()).groupBy(*gk, value).agg(F.count(F.lit(1)).alias("__c"))
    pref = prefix_sums(dist, gk, [value], ["__c"], unique=True)
    qarr = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    x = pref.select(*gk, value, "__c", "__c_before", "__c_total", qarr)
    h = (F.col("__c_total") - 1) * F.col("q")
    lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
    start, end = F.col("__c_before"), F.col("__c_before") + F.col("__c")
    x = x.select(*gk, "q", value, h.alias("__h"), lo.alias("__lo"),
                 ((lo >= start) & (lo < end)).alias("__is_lo"), ((hi >= start) & (hi < end)).alias("__is_hi"))
    hits = x.filter(F.col("__is_lo") | F.col("__is_hi")).groupBy(*gk, "q").agg(
        F.max(F.when(F.col("__is_lo"), F.col(value))).alias("__xlo"),
        F.max(F.when(F.col("__is_hi"), F.col(value))).alias("__xhi"),
        F.first("__h").alias("__h"), F.first("__lo").alias("__lo"))
    val = F.col("__xlo") + (F.col("__h") - F.col("__lo")) * (F.col("__xhi") - F.col("__xlo"))
    return hits.select(*keys, "q", val.alias("quantile"))


def _as_number(df: DataFrame, c: str, share_of: DataFrame | None = None):
    dt = df.schema[c].dataType
    if isinstance(dt, DateType):
        return F.unix_date(F.col(c)).cast("double"), "date"
    if isinstance(dt, NumericType):
        return F.col(c).cast("double"), "numeric"
    return None, "category"


def univariate_drift(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, train (0) vs test (1) AUC of the value after median
    fill (category -> its share of all rows, date -> day number), folded to
    >= 0.5; AUC of the missing flag when both values occur; missing rates and
    distinct counts (missing not counted)."""
    both = train.select(*cols).withColumn("domain", F.lit(0)).unionByName(
        test.select(*cols).withColumn("domain", F.lit(1)))
    parts = []
    for c in cols:
        x, kind = _as_number(both, c)
        raw = F.col(c).cast("string")
        if kind == "category":
            # Share of the normalised category over train + test.
            cnt = both.groupBy(normalize(c).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
            total = both.select(F.count(F.lit(1))).scalar()
            part = both.select("domain", normalize(c).alias("__v"), raw.alias("raw")).join(cnt, "__v").select(
                F.lit(c).alias("column_name"), "domain", (F.col("__k") / total).alias("x"), "raw")
        else:
            part = both.select(F.lit(c).alias("column_name"), "domain", x.alias("x"), raw.alias("raw"))
        parts.append(part)
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    # The long table feeds five grouped passes (median, two AUCs, stats):
    # materialise it once in the shared checkpoint folder instead of
    # re-reading and re-joining the sources for each.
    long = cut_lineage(long)
    # One median per column: a map in a scalar subquery, so rows aren't dealt by column name.
    med = exact_quantiles(long, ["column_name"], "x", [0.5])
    med = med.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "quantile")))).scalar()
    filled = long.withColumn("__med", med).withColumn(
        "xf", F.coalesce("x", F.try_element_at("__med", F.col("column_name")), F.lit(0.0))).withColumn(
        "miss", F.col("x").isNull().cast("int")).drop("__med")
    vauc = auc_table(filled, "domain", "xf", ["column_name"]).select(
        "column_name", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("adv_auc_value"))
    mauc = auc_table(filled, "domain", "miss", ["column_name"])
    two = filled.groupBy("column_name").agg((F.min("miss") != F.max("miss")).alias("__two"))
    mauc = mauc.join(two, "column_name").select(
        "column_name", F.when(F.col("__two"), F.greatest("roc_auc", 1 - F.col("roc_auc"))).alias("adv_auc_missing"))
    stats = long.groupBy("column_name").agg(
        F.avg(F.when(F.col("domain") == 0, F.col("raw").isNull().cast("double"))).alias("train_missing"),
        F.avg(F.when(F.col("domain") == 1, F.col("raw").isNull().cast("double"))).alias("test_missing"),
        F.countDistinct(F.when(F.col("domain") == 0, F.col("raw"))).alias("train_nunique"),
        F.countDistinct(F.when(F.col("domain") == 1, F.col("raw"))).alias("test_nunique"))
    return vauc.join(mauc, "column_name").join(stats, "column_name")


def univariate_target_auc(df: DataFrame, cols: Sequence[str], target: str, min_rows: int = 100) -> DataFrame:
    """Per numeric column, AUC against the target on its
    non-missing rows (at least ``min_rows`` and both classes), folded."""
    long = df.select(target, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [target], list(cols), "column_name", "x").filter(F.col("x").isNotNull())
    a = auc_table(long, target, "x", ["column_name"])
    return a.filter(F.col("n_rows") >= min_rows).filter(F.col("roc_auc").isNotNull()).select(
        "column_name", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"), "n_rows")


def top_k_by_auc(aucs: DataFrame, k: int) -> DataFrame:
    """The ``k`` columns with the highest folded AUC (ties by name)."""
    return aucs.orderBy(F.desc("auc"), F.asc("column_name")).limit(k)


def score_summary(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per label count, min, mean, exact median, max of a score."""
    med = exact_quantiles(df, [label], score, [0.5]).select(label, F.col("quantile").alias("median"))
    agg = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.min(score).alias("min"),
                                F.avg(score).alias("mean"), F.max(score).alias("max"))
    return agg.join(med, label)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every pairwise Pearson correlation (pairwise non-missing rows) in
    one aggregate, returned long as (a, b, corr)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], list(wide.columns), "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")


def present_columns(df: DataFrame, cols: Sequence[str], min_share: float = 0.5, target: str | None = None) -> list[str]:
    """E28 column choice: every column present in more than ``min_share`` of
    rows (one aggregate row read on the driver), and always the target."""
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols]).first()
    kept = [c for c in cols if c != target and row[c] is not None and row[c] > min_share]
    return kept + ([target] if target else [])


def density_histogram(both: DataFrame, col: str, side: str, bins: int = 50, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Counts per (side, bin) with ``bins`` equal-width bins between
    the wider of the per-side ``lo_q``/``hi_q`` quantiles; values outside the
    range are left out, the top edge falls in the last bin."""
    q = exact_quantiles(both, [side], col, [lo_q, hi_q])
    lo = q.filter(F.col("q") == lo_q).select(F.min("quantile")).scalar()
    hi = q.filter(F.col("q") == hi_q).select(F.max("quantile")).scalar()
    x = F.col(col)
    # A constant column has one bin.
    b = F.least(F.floor(F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    inside = both.filter(x.isNotNull() & (x >= lo) & (x <= hi))
    return inside.groupBy(side, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drift_by_month(df: DataFrame, day: str, target: str, cols: Sequence[str]) -> DataFrame:
    """Per month the prevalence and each column's correlation with the target."""
    m = F.date_format(F.col(day), "yyyy-MM").alias("month")
    return df.groupBy(m).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias("prevalence"),
                             *[F.corr(c, target).alias(f"corr_{c}") for c in cols])
