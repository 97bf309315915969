"""License scan by diagonal voting.

Every rolling 3-word hash of every document is joined in Spark with the
positions of the same hash in license templates.  A match votes for a
diagonal (document position minus template position); votes are counted by
document, template and diagonal.  Neighbouring diagonals that continue each
other are merged into a span, which lets words be inserted or dropped, and a
span counts when it holds enough of its template.  Base phrases are templates
that must match whole on one diagonal.

Words are runs of ASCII letters and digits and of non-ASCII characters, after
lower-casing A-Z.  The template table is fixed and small, so it is broadcast;
documents are exploded and joined in place, and only matches are shuffled.

Cases: null and empty texts have no word, no label and score 0; texts are
read whole, long ones in chunks of grams; equal rows are separate rows; a
phrase shorter than three words is not a template and raises; an empty table
gives an empty result; only the id and the text are read, so other columns
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import ALNUM, Words, grams, hash_strings, lower_ascii, slices, spans, strings

K = 3

#: Grams in one row of the exploded input.
CHUNK = 1 << 16

#: Stands for the document itself, so that documents without a match stay.
_SELF = -(1 << 63)

#: Base phrases, lower case, by label: fixed values.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Notices by label, lower case: fixed values.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
]



def template_grams(base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> list[tuple]:
    """(hash, template, position, label, is base, grams of the template) of each template gram."""
    rows: list[tuple] = []
    for t, (label, phrase, is_base) in enumerate([*((a, b, True) for a, b in base), *((a, b, False) for a, b in notices)]):
        words = phrase.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {phrase!r}")
        h, at = grams(hash_strings(pa.array([w.encode() for w in words], pa.binary())), np.array([0, len(words)]), K)
        rows += [(int(x), t, int(p), label, is_base, len(at)) for x, p in zip(h.view(np.int64), at)]
    return rows


def document_grams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, n_words, offset and an array of gram hashes; the first chunk starts with the document's own mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(2))):
                raw, offsets = spans(part)
                words = Words(lower_ascii(raw), offsets, ALNUM)
                h, at = grams(words.hashes(), words.first, K)
                begin = np.searchsorted(at, words.first)
                row, start, size = [], [], []
                for i, n in enumerate(np.diff(begin).tolist()):
                    for c in range(0, max(n, 1), CHUNK):
                        row.append(i)
                        start.append(c)
                        size.append(min(CHUNK, n - c))
                row, start, size = np.array(row, np.int64), np.array(start, np.int64), np.array(size, np.int64)
                # Chunk bounds in the flat hashes, with one place for the mark ahead of each document.
                length = size + (start == 0)
                bounds = np.r_[0, np.cumsum(length)]
                flat = np.full(bounds[-1], _SELF, np.int64)
                flat[np.arange(bounds[-1]) != np.repeat(np.where(start == 0, bounds[:-1], -1), length)] = h.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)).take(pa.array(row)),
                        batch.column(1).slice(first, len(part)).take(pa.array(row)),
                        pa.array(np.diff(words.first)[row], pa.int64()),
                        pa.array(start - (start == 0), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64())),
                    ],
                    names=["uid", "id", "n_words", "offset", "grams"],
                )

    kind = df.select(id_col).schema[0].dataType.simpleString()
    texts = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"uid bigint, id {kind}, n_words bigint, offset bigint, grams array<bigint>")


def diagonals(df: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Votes: uid, id, n_words, template, label, is_base, size, diagonal, n, first, last (template -1: the document)."""
    spark = df.sparkSession
    table = spark.createDataFrame(
        [*template_grams(base, notices), (_SELF, -1, -1, None, False, 0)], "hash bigint, template int, at int, label string, is_base boolean, size int"
    )
    exploded = document_grams(df, id_col, text_col).select("uid", "id", "n_words", "offset", F.posexplode("grams").alias("p", "hash"))
    matched = exploded.join(F.broadcast(table), "hash").withColumn("at_doc", F.when(F.col("template") < 0, -1).otherwise(F.col("offset") + F.col("p")))
    return (
        matched.groupBy("uid", "id", "n_words", "template", "label", "is_base", "size", (F.col("at_doc") - F.col("at")).alias("diagonal"))
        .agg(F.count("*").alias("n"), F.min("at_doc").alias("first"), F.max("at_doc").alias("last"))
    )


def matched_spans(votes: DataFrame, max_shift: int = 3, max_gap: int = 8, min_share: float = 0.75) -> DataFrame:
    """Verified spans: the rows of ``votes`` merged over neighbouring diagonals.

    A diagonal continues the span before it when it is at most ``max_shift``
    off and starts at most ``max_gap`` words after that ended, without
    counting more grams than the template has.  A span is kept when it holds
    ``min_share`` of the template's grams; a base phrase must hold all of them
    on one diagonal.  Document rows (template -1) pass.
    """
    order = Window.partitionBy("uid", "template").orderBy("first", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) <= max_shift) & (F.col("first") - F.lag("last").over(order) <= max_gap) & (F.lag("n").over(order) < F.col("size"))
    starts = votes.withColumn("new", F.when(near & ~F.col("is_base"), 0).otherwise(1))
    numbered = starts.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans_ = numbered.groupBy("uid", "id", "n_words", "template", "label", "is_base", "size", "span").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    share = F.least(F.lit(1.0), F.col("n") / F.greatest("size", F.lit(1)))
    return spans_.withColumn("share", share).where((F.col("template") < 0) | (F.col("is_base") & (F.col("n") == F.col("size"))) | (~F.col("is_base") & (share >= min_share)))


def scan(df: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template that a span holds.
    """
    found = matched_spans(diagonals(df, base, notices, id_col, text_col))
    real, is_base = F.col("template") >= 0, F.col("is_base")
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")  # noqa: E731 - at most one per label
    return found.groupBy("uid", "id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)).alias("score"),
    ).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
