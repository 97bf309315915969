"""History stored in buckets of its key.

Rows are written once by a hash of their key, one sorted file per bucket, as
a table that records the bucketing; semi-joins, roll-ups and left joins on the
key then move no history row.  Keys with more than ``hot_rows`` rows, and rows
without a key, are stored beside the buckets, unbucketed: a bucket holds at
most ``hot_rows`` rows of a key, and a hot key is read by many tasks and
combined before its few partial rows are shuffled.

Cases: an empty history gives an empty table; rows without a key stay in
``rows`` but match nothing; writing to a place twice replaces what was there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import matched_history


@dataclass(frozen=True)
class BucketedHistory:
    """``calm``: rows in buckets of ``key``; ``hot``: rows of hot keys and rows without one."""

    calm: DataFrame
    hot: DataFrame
    key: str

    @property
    def rows(self) -> DataFrame:
        return self.calm.unionByName(self.hot)

    def matched(self, apps: DataFrame, app_key: str) -> BucketedHistory:
        """The rows whose key occurs among the applications."""
        calm, hot = (matched_history(part, apps, self.key, app_key) for part in (self.calm, self.hot))
        return BucketedHistory(calm, hot, self.key)

    def rollups(self, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """``make``, a roll-up by the key, of both parts; no key is in both."""
        return make(self.calm), make(self.hot.filter(F.col(self.key).isNotNull()))


def attach_parts(apps: DataFrame, rolls: tuple[DataFrame, DataFrame], app_key: str, hist_key: str) -> DataFrame:
    """left join of the roll-ups of both parts, values cast to double, plus has_history."""
    calm, hot = rolls
    vals = [c for c in calm.columns if c != hist_key]
    # Each part is joined by itself: their union would forget the buckets.
    sides = [r.select(*(F.col(c).alias(f"__{n}_{c}") for c in r.columns)) for n, r in (("calm", calm), ("hot", hot))]
    out = apps
    for side, n in zip(sides, ("calm", "hot")):
        out = out.join(side, out[app_key] == side[f"__{n}_{hist_key}"], "left")
    either = lambda c: F.coalesce(f"__calm_{c}", f"__hot_{c}")
    return out.select(*apps.columns, *[either(c).cast("double").alias(c) for c in vals], either(hist_key).isNotNull().cast("int").alias("has_history"))


def write_bucketed(history: DataFrame, key: str, place: str, buckets: int, hot_rows: int = 1_000_000) -> BucketedHistory:
    """Stores ``history`` below ``place``."""
    # At most one key per hot_rows rows, so the list stays small beside the table.
    hot = history.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select("__hot")
    marked = history.join(hot, F.col(key) == F.col("__hot"), "left")
    aside = F.col("__hot").isNotNull() | F.col(key).isNull()
    marked.filter(aside).select(*history.columns).write.mode("overwrite").parquet(f"{place}/hot")
    calm = marked.filter(~aside).select(*history.columns)
    # The exchange deals rows as the buckets do: one file per bucket.
    calm.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{place}/calm").mode("overwrite").saveAsTable(_table(place))
    return open_bucketed(history.sparkSession, place, key, buckets)


def open_bucketed(spark: SparkSession, place: str, key: str, buckets: int) -> BucketedHistory:
    """What :func:`write_bucketed` stored; the table is registered where the session's catalog doesn't know it."""
    hot = spark.read.parquet(f"{place}/hot")
    name = _table(place)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema.fields)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}/calm'")
    return BucketedHistory(spark.table(name), hot, key)


def _table(place: str) -> str:
    return "history_" + hashlib.sha256(place.encode()).hexdigest()[:16]
