"""Bounded samples of labelled documents for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def labelled_texts(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str,
    train: Column | None,
    rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(key, text, y) of at most ``rows`` labelled documents, chosen by a hash of the id.

    ``train`` is a condition on the column ``key``.  Ids labelled 0 and 1 at
    once count as 1, null labels and ids are left out, and so are labels
    without a document.  ``rows`` bounds the chosen table, so it may be
    broadcast; of the texts only the chosen ones move.  An id that repeats has
    one row, with its smallest text, so ``rows`` bounds the sample too.
    """
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("key is not null and y is not null")
    if train is not None:
        marked = marked.where(train)
    # The same hash order for every label column and run.
    chosen = marked.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = documents.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return one_text(texts.join(F.broadcast(chosen), "key"))


def one_text(sample: DataFrame) -> DataFrame:
    """(key, text, y) with one row per key, in the hash order of the keys; copies of a key are pre-aggregated where they are."""
    return sample.groupBy("key").agg(F.min("text").alias("text"), F.min("y").alias("y")).orderBy(F.xxhash64("key"), "key")
