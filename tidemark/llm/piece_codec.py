"""SentencePiece encoding and decoding of a text column (see :mod:`.piece_bpe`).

Map-only: each task reads the model once and encodes slices of bounded size.

Cases: null and empty texts have no piece, only the end id, and decode to
the empty text; a character outside the vocabulary becomes its bytes; a very
long text is encoded whole; equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_bpe import Codec, PieceModel
from .text import slices, strings


def _codec(blob: bytes) -> Codec:
    """One codec a worker process: reading the model takes half a second."""
    key = hashlib.sha256(blob).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(PieceModel(blob))
    return _CODECS[key]


_CODECS: dict[bytes, Codec] = {}


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> (end id last) of every whole text."""
    return _run(df, model_path, id_col, text_col, "ids array<int>", _ids)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string."""
    return _run(df, model_path, id_col, text_col, "ids array<int>, decoded string", _both)


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: the round trip without its bulk."""
    return _run(df, model_path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def _ids(codec: Codec, flat: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(flat, pa.int32()))]


def _both(codec: Codec, flat: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    return [*_ids(codec, flat, n), pa.array([codec.decode(flat[a:b]) for a, b in zip(n, n[1:])], pa.string())]


def _digests(codec: Codec, flat: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    ids, texts = [], []
    names = codec.names = getattr(codec, "names", None) or [str(i) for i in range(len(codec.model.pieces))]
    for a, b in zip(n, n[1:]):
        ids.append(hashlib.sha256(" ".join([names[i] for i in flat[a:b].tolist()]).encode()).hexdigest())
        texts.append(hashlib.sha256(codec.decode(flat[a:b]).encode()).hexdigest())
    return [pa.array(np.diff(n), pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]


def _run(df: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, finish) -> DataFrame:
    # The model (0.5 MB) is part of the task, so executors need no file of the driver's.
    blob = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(blob.value)
        for batch in batches:
            for first, part in slices(strings(batch.column(1))):
                flat, n = codec.encode(part)
                own = batch.column(0).slice(first, len(part))
                yield pa.RecordBatch.from_arrays([own, *finish(codec, flat, n)], names=names)

    full = f"`{id_col}` {df.select(id_col).schema[0].dataType.simpleString()}, {schema}"
    names = [id_col, *(x.split()[0] for x in schema.split(", "))]
    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, full)
