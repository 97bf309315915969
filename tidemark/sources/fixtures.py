"""The three fixture views the checks run on, built from the driver tables.

``apps``   one row per order: an application with id, day, numeric and
           categorical columns, a binary target and a train/test side.
``offers`` one row per line item: several offers share an order context.
``scores`` two deterministic model scores on three time folds.

The driver tables hold no nulls, so some columns are nulled by fixed rules on
the key to exercise the missing-value paths.  The SQL text of each view
(``*_SQL``) runs unchanged in Spark SQL and DuckDB; the DataFrame builders
below are the same relations written with the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# The fixture definitions (dates, moduli, score formulas).
TEST_START = "2000-07-01"
FOLD_CUTOFFS = ("1999-01-01", "1999-07-01", "2000-01-01")
HOLDOUT_CUTOFFS = (("H1", "1999-07-01"), ("H2", "2000-01-01"), ("H3", "2000-04-01"))
TRAIN_END = "2000-06-30"
MISSING_TOKEN = "__MISSING__"

APPS_NUMERIC = ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90"]
APPS_CATEGORICAL = ["db_group_last", "fl_adminarea"]
OFFER_COLS = ["offered_rate", "overdraft_limit_min", "overdraft_limit_max"]

APPS_SQL = """SELECT o.o_orderkey AS front_id,
       CAST(o.o_orderdate AS DATE) AS decision_day,
       o.o_custkey AS cust_id,
       o.o_totalprice AS loan_amount_last,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS balance_amt,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE c.c_mktsegment END AS db_group_last,
       n.n_name AS fl_adminarea,
       CAST(o.o_orderkey % 11 AS DOUBLE) AS cnt_30,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderkey % 13 AS DOUBLE) END AS cnt_90,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS target_value,
       CASE WHEN CAST(o.o_orderdate AS DATE) < DATE '2000-07-01' THEN 0 ELSE 1 END AS is_test
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey"""

OFFERS_SQL = """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
       CAST(l.l_shipdate AS DATE) AS decision_day,
       l.l_linestatus, l.l_returnflag,
       CASE WHEN l.l_partkey % 9 = 0 THEN NULL ELSE l.l_discount END AS offered_rate,
       l.l_quantity AS overdraft_limit_min,
       l.l_extendedprice AS overdraft_limit_max,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS target_value
FROM lineitem l"""

SCORES_SQL = """SELECT front_id, target_value,
       CASE WHEN decision_day < DATE '1999-07-01' THEN 1 WHEN decision_day < DATE '2000-01-01' THEN 2 ELSE 3 END AS fold,
       CAST(front_id * 7919 % 1000 + 150 * target_value AS DOUBLE) / 1150e0 AS s1,
       CAST(front_id * 104729 % 97 + 12 * target_value AS DOUBLE) / 109e0 AS s2
FROM apps WHERE is_test = 0 AND decision_day >= DATE '1999-01-01'"""

VIEW_SQL = {"apps": APPS_SQL, "offers": OFFERS_SQL, "scores": SCORES_SQL}
VIEW_DEPS = {"apps": (), "offers": (), "scores": ("apps",)}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named fixture views (and their inputs)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in VIEW_DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order) + "\n"


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"])
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    n = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("front_id"),
            day.alias("decision_day"),
            F.col("o_custkey").alias("cust_id"),
            F.col("o_totalprice").alias("loan_amount_last"),
            _null_when(k % 7 == 0, F.col("c_acctbal")).alias("balance_amt"),
            _null_when(k % 5 == 0, F.col("c_mktsegment")).alias("db_group_last"),
            F.col("n_name").alias("fl_adminarea"),
            (k % 11).cast("double").alias("cnt_30"),
            _null_when(k % 17 == 0, (k % 13).cast("double")).alias("cnt_90"),
            (F.col("o_orderstatus") == "F").cast("int").alias("target_value"),
            (day >= F.lit(TEST_START).cast("date")).cast("int").alias("is_test"),
        )
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_linestatus", "l_returnflag",
         "l_discount", "l_quantity", "l_extendedprice"],
    )
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.to_date("l_shipdate").alias("decision_day"),
        "l_linestatus", "l_returnflag",
        _null_when(F.col("l_partkey") % 9 == 0, F.col("l_discount")).alias("offered_rate"),
        F.col("l_quantity").alias("overdraft_limit_min"),
        F.col("l_extendedprice").alias("overdraft_limit_max"),
        (F.col("l_returnflag") == "R").cast("int").alias("target_value"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = apps(spark, sf_dir)
    day = F.col("decision_day")
    fid = F.col("front_id")
    y = F.col("target_value")
    return a.filter((F.col("is_test") == 0) & (day >= F.lit("1999-01-01").cast("date"))).select(
        fid, y,
        F.when(day < F.lit("1999-07-01").cast("date"), 1)
        .when(day < F.lit("2000-01-01").cast("date"), 2)
        .otherwise(3).alias("fold"),
        ((fid * 7919 % 1000 + 150 * y).cast("double") / F.lit(1150.0)).alias("s1"),
        ((fid * 104729 % 97 + 12 * y).cast("double") / F.lit(109.0)).alias("s2"),
    )


def train_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apps(spark, sf_dir).filter(F.col("is_test") == 0)


def test_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apps(spark, sf_dir).filter(F.col("is_test") == 1).drop("target_value")
