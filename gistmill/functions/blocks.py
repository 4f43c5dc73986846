"""Vectors of a task as numpy blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Bytes of packed blocks that a task of ``crossed`` reads of the right side, and parts of the left side at most.
SIDE_BYTES, MOST_PARTS = 64 << 20, 512


def matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, 1))


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as the rows of a matrix; an error if a list is null or they differ in length."""
    if not len(column):
        return np.zeros((0, 1))
    column = column.combine_chunks()
    length = pc.unique(pc.list_value_length(column))
    if len(length) != 1 or not length[0].is_valid:
        raise ValueError("vectors are missing or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(raw: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all()


def right_parts(rows: int, width: int) -> int:
    """In how many parts vectors are dealt as the right side of ``crossed``."""
    return max(1, -(-rows * (8 * width + 32) // SIDE_BYTES))


def crossed(left: DataFrame, right: DataFrame, on: Column, run: Callable[[pa.Table, Iterable[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on each block of ``left`` and the blocks of ``right`` that it meets, in a task for each pair of partitions.

    left: ``place`` (a number of its own), ``block`` (packed) and what ``on`` needs; right: ``other`` (packed) and what ``on`` needs. Nothing is shuffled:
    a task reads its two partitions again, so both sides should be written before.
    """
    pairs = left.join(right.hint("shuffle_replicate_nl"), on).select("place", "block", "other")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("place")[i].as_py(), b.column("block")[i], b.column("other")[i]) for b in batches for i in range(b.num_rows))
        for _, met in groupby(rows, lambda r: r[0]):
            first = next(met)
            yield from run(unpack(first[1]), (unpack(r[2]) for r in chain([first], met)))

    return pairs.mapInArrow(each, schema)
