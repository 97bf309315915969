"""Arrow batches of whole groups: many small groups per call, no pandas frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

GroupsFn = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers where groups begin, and the row count; ``table`` is sorted by ``keys``, which hold no null."""
    n = table.num_rows
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, dtype=bool)
    for k in keys:
        column = table[k].combine_chunks()
        new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(new) + 1, n]


def map_groups(df: DataFrame, keys: Sequence[str], fn: GroupsFn, schema: str, order: Sequence[str] = ()) -> DataFrame:
    """``fn(table, bounds)`` on tables that hold whole groups of equal ``keys``.

    Rows are dealt by a hash of the keys and sorted, so a task streams through
    its groups; it holds one Arrow batch and at most one unfinished group, so
    callers must bound the size of a group.
    """
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = [batch.column(batch.schema.get_field_index(k))[0] for k in keys]
            if rest and head == last and _one_group(batch, keys):
                rest.append(batch)  # the open group goes on through this batch
                continue
            table = pa.Table.from_batches([*rest, batch])
            at = bounds(table, keys)
            if at[-2] > 0:
                yield from fn(table.slice(0, int(at[-2])), at[:-1])
            rest = table.slice(int(at[-2])).to_batches()
            last = [table[k][-1] for k in keys]
        if rest:
            table = pa.Table.from_batches(rest)
            yield from fn(table, bounds(table, keys))

    return arranged.mapInArrow(run, schema)


class Reader:
    """State of one group that is read batch by batch."""

    def add(self, part: pa.Table) -> None:
        raise NotImplementedError

    def close(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def read_groups(df: DataFrame, keys: Sequence[str], make: Callable[[], Reader], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """A new ``Reader`` for each group, given the group's rows in ``order``.

    Like :func:`map_groups`, but a group may be of any size: only the reader's
    state and one Arrow batch are held.
    """
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = bounds(table, keys)
            for a, b in zip(at.tolist(), at[1:].tolist()):
                part = table.slice(a, b - a)
                key = [part[k][0] for k in keys]
                if key != last:
                    if reader:
                        yield from reader.close()
                    reader, last = make(), key
                reader.add(part)
        if reader:
            yield from reader.close()

    return arranged.mapInArrow(run, schema)


def _one_group(batch: pa.RecordBatch, keys: Sequence[str]) -> bool:
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    return all(c[0] == c[len(c) - 1] for c in columns)


def vectors(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0), dtype)
