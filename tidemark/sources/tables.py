"""Table scans (A01, A02) and typed readers.

Every reader declares the columns it needs so Catalyst prunes the Parquet scan
(``ReadSchema`` in ``explain``) and pushes filters into it.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet scan of one driver table, projected to ``columns``."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    return df


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a header row and a declared schema.

    Columns are found by their header name, whatever their order in the file;
    a file whose header differs from the first one's fails instead of being
    read by position.  An empty cell is missing; no type is inferred (only
    the first line is read ahead), and text that doesn't fit its type fails.
    """
    text = (
        spark.read.option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").option("emptyValue", None).csv(path)
    )
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def scan_for_keys(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``keys`` (A03): a left-semi join
    that adaptive execution broadcasts when the measured key set is small."""
    return big.join(keys.select(key).distinct(), on=key, how="left_semi")


def as_date(col) -> "F.Column":
    """``timestamp_ntz`` / text day -> ``date`` (strict)."""
    return F.to_date(col)
