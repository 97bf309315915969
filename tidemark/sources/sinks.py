"""Sinks, run artifacts and the run registry.

Prediction sets of every run live in one long table partitioned by
``run_id`` (partition pruning replaces "open the newest folder"), or as
attempts that a commit row, written last, makes visible; summaries
are JSON strings built with ``to_json`` after non-finite doubles become null;
fingerprints are SHA-256 of the file bytes plus an order-free table hash.
All paths are in shared storage (the cluster's checkpoint folder or a path
the caller gives), never a machine-local temp folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

PRED_COLS = ["run_id", "scope", "grp", "row_index", "target_value", "prediction"]


def write_csv_fixed(df: DataFrame, path: str, float_cols: Sequence[str], order_by: str | None = None,
                    digits: int = 10) -> None:
    """CSV with a header and fixed-decimal text for ``float_cols``.
    With ``order_by`` the output is globally sorted (range-partitioned part
    files in order), so reading the folder back keeps the contract order."""
    out = df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if c in float_cols else F.col(c)
                      for c in df.columns])
    if order_by:
        out = out.orderBy(order_by)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink, optionally partitioned (e.g. by ``run_id``)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_predictions(df: DataFrame, path: str, run_id: str, scope: str, grp: str, row_index: str,
                       target: str, prediction: str) -> None:
    """Append one run's predictions to the long table (partitioned by
    run_id; dynamic partition overwrite replaces only this run)."""
    out = df.select(F.lit(run_id).alias("run_id"), F.lit(scope).alias("scope"), F.col(grp).cast("string").alias("grp"),
                    F.col(row_index).cast("long").alias("row_index"), F.col(target).cast("int").alias("target_value"),
                    F.col(prediction).cast("double").alias("prediction"))
    _replace_partitions(out, path)


def _replace_partitions(df: DataFrame, path: str) -> None:
    """Overwrite only the ``run_id`` partitions that ``df`` holds (a writer option, no session setting)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_run_artifacts(root: str, run_id: str, tables: dict[str, DataFrame], config: dict | None = None) -> dict[str, str]:
    """Every artifact of a run (predictions, fold metrics, feature
    manifest, ...) appended to its own table under ``root``, partitioned by
    ``run_id`` with dynamic partition overwrite (a re-run replaces only its
    own partition); the config is stored as one JSON row.  Returns the paths."""
    import json

    paths = {}
    items = dict(tables)
    if config is not None:
        spark = next(iter(tables.values())).sparkSession if tables else None
        if spark is not None:
            items["config"] = spark.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "config_json string")
    for name, df in items.items():
        out = sanitize_doubles(df).withColumn("run_id", F.lit(run_id))
        path = f"{root.rstrip('/')}/{name}"
        _replace_partitions(out, path)
        paths[name] = path
    return paths


COMMITS = "commits"


def write_committed_run(root: str, run_id: str, tables: dict[str, DataFrame]) -> str:
    """The artifacts of a run, then one commit row naming them.

    Every call writes its own attempt (partitions ``run_id``, ``attempt``) and
    never touches another, so a job that dies half-way, in a first run or a
    repeated one, leaves what was committed before as it was.  Returns the
    attempt."""
    attempt = uuid.uuid4().hex
    root = root.rstrip("/")
    for name, df in tables.items():
        out = sanitize_doubles(df).withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt))
        out.write.mode("append").partitionBy("run_id", "attempt").parquet(f"{root}/{name}")
    spark = next(iter(tables.values())).sparkSession
    commit = spark.createDataFrame([(run_id, attempt, sorted(tables))], "run_id string, attempt string, artifacts array<string>")
    # One file, renamed into place when it is whole: the run is there or not.
    commit.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")
    return attempt


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """Per run its last commit (run_id, attempt, artifacts, committed_at)."""
    schema = "run_id string, attempt string, artifacts array<string>, committed_at timestamp"
    commits = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{COMMITS}")
    last = F.max_by(F.struct("attempt", "artifacts", "committed_at"), F.struct("committed_at", "attempt"))
    return commits.groupBy("run_id").agg(last.alias("c")).select("run_id", "c.*")


def read_committed(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """An artifact's rows of committed attempts only, without the attempt;
    the commit table (one row per run) prunes the partitions."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/{artifact}")
    return rows.join(committed_runs(spark, root).select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("attempt")


def load_runs(spark: SparkSession, path: str, labels: dict[str, str], scope: str,
              keys: Sequence[str] = ("grp", "row_index", "target_value")) -> DataFrame:
    """The named runs of one scope side by side, ``prediction`` renamed
    to each run's label; the run filter prunes partitions."""
    runs = list(labels)
    t = spark.read.parquet(path).filter((F.col("scope") == scope) & F.col("run_id").isin(runs))
    wide = t.groupBy(*keys).pivot("run_id", runs).agg(F.first("prediction"))
    return wide.select(*keys, *[F.col(r).alias(labels[r]) for r in runs])


def latest_runs(registry: DataFrame, prefix_col: str = "prefix", stamp_col: str = "stamp",
                run_col: str = "run_id") -> DataFrame:
    """Newest run per prefix (``max_by`` on the stamp, no window)."""
    return registry.groupBy(prefix_col).agg(F.max_by(run_col, stamp_col).alias(run_col), F.max(stamp_col).alias(stamp_col))


def run_registry(spark: SparkSession, path: str) -> DataFrame:
    """Runs present in a predictions table: run_id -> (prefix, stamp, seed),
    from ids shaped ``<prefix>_<yyyyMMddTHHmmssZ>_seed<n>``."""
    return run_ids(spark.read.parquet(path))


def run_ids(runs: DataFrame) -> DataFrame:
    """The parts of the distinct ids in ``run_id``."""
    ids = runs.select("run_id").distinct()
    rx = r"^(.*)_(\d{8}T\d{6}Z)_seed(\d+)$"
    return ids.select("run_id", F.regexp_extract("run_id", rx, 1).alias("prefix"),
                      F.regexp_extract("run_id", rx, 2).alias("stamp"),
                      F.regexp_extract("run_id", rx, 3).cast("int").alias("seed"))


def sanitize_doubles(df: DataFrame) -> DataFrame:
    """NaN and +/-inf become null in every double column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            x = F.col(f.name)
            cols.append(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def json_summary(df: DataFrame, name: str = "summary") -> DataFrame:
    """One JSON object per row (after :func:`sanitize_doubles`)."""
    s = sanitize_doubles(df)
    return s.select(F.to_json(F.struct(*s.columns)).alias(name))


def file_fingerprints(spark: SparkSession, paths: Sequence[str], root: str | None = None) -> DataFrame:
    """A10: size and SHA-256 of each file's bytes (binaryFile source, one row
    per file, so a file may hold up to 2 GB; larger tables are compared by
    :func:`table_fingerprint`).  With ``root``, files are summed up per folder
    below it (``name``), in the order of their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(list(paths)).select(
        "path", "length", F.sha2(F.col("content"), 256).alias("sha256"))
    if root is None:
        return files
    name = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name")
    return files.groupBy(name).agg(F.sum("length").alias("length"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"))


def chunk_digests(spark: SparkSession, paths: Sequence[str], chunk_bytes: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """A10: (path, chunk, offset, length, sha256) of files of any size.

    The file listing reads no content; byte ranges are spread over ``tasks``
    (default: the session's shuffle partitions) and each is read by offset
    where it is hashed, so a file is never held whole.  Empty
    files are not listed, as in every file source of Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(list(paths)).select("path", F.col("length").alias("size"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk_bytes).cast("long")))
    ranges = files.select("path", "size", starts.alias("offset")).select(
        "path", "offset", F.least(F.lit(chunk_bytes).cast("long"), F.col("size") - F.col("offset")).alias("length"))
    # By ranges of (path, offset): neighbouring chunks share a task and an open file.
    ranges = ranges.repartitionByRange(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            digests = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != name:
                    name, file = path, _open(path)
                file.seek(offset)
                data = file.read(length)
                if len(data) != length:
                    raise OSError(f"{path} changed while it was read")
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "offset", "length", "sha256"])

    done = ranges.mapInArrow(run, "path string, offset long, length long, sha256 string")
    return done.select("path", F.expr(f"offset div {int(chunk_bytes)}").alias("chunk"), "offset", "length", "sha256")


def _open(path: str):
    """A file of any file system that Arrow knows, by Spark's path text."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(inner)


def tree_digests(chunks: DataFrame, fan: int = 1024) -> DataFrame:
    """A10: (path, length, n_chunks, sha256) from chunk digests: ``fan``
    neighbouring digests, in order, give their parent's, up to one root.  A
    file of one chunk has the SHA-256 of its bytes.  No row holds more than
    ``fan`` digests."""
    most = chunks.agg(F.max("chunk")).first()[0]
    level = chunks.select("path", F.col("chunk").alias("at"), "length", F.lit(1).cast("long").alias("n_chunks"), "sha256")
    while most:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda c: c["sha256"])
        level = level.groupBy("path", F.expr(f"at div {int(fan)}").alias("at")).agg(
            F.sum("length").alias("length"), F.sum("n_chunks").alias("n_chunks"), in_order.alias("d")).select(
            "path", "at", "length", "n_chunks", F.when(F.size("d") == 1, F.col("d")[0]).otherwise(F.sha2(F.array_join("d", ""), 256)).alias("sha256"))
        most //= fan
    return level.drop("at")


def changed_chunks(current: DataFrame, card: DataFrame) -> DataFrame:
    """(path, chunk, change) of chunks that differ from the stored ones: changed, added or removed."""
    new, old = (d.select("path", "chunk", F.col("sha256").alias(n)) for d, n in ((current, "new"), (card, "old")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return new.join(old, ["path", "chunk"], "full_outer").select("path", "chunk", change.alias("change")).filter("change is not null")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """A10: order-free content hash of a table: rows and the xor / sum of a
    64-bit hash of every row (both independent of partitioning and order)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def check_fingerprint(current: DataFrame, card: DataFrame, on: str = "name") -> DataFrame:
    """Stored fingerprint equals the current one (per ``on``)."""
    c = card.select(on, F.col("sha256").alias("card_sha256"))
    return current.join(c, on, "full_outer").select(
        on, (F.col("sha256") == F.col("card_sha256")).alias("matches"))


def feature_manifest(spark: SparkSession, entries: Sequence[tuple[str, str, bool, str, str]]) -> DataFrame:
    """(source_column, role, used, transformed_to, reason) rows built on
    the driver from the feature plan's column lists."""
    return spark.createDataFrame(list(entries),
                                 "source_column string, role string, used boolean, transformed_to string, reason string")
