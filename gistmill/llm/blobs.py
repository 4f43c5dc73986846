"""Routes and buckets: how positions of texts meet in tasks without a row for each position.

A *route* is a group of whole texts of about SLICE_BYTES, cut by a hash of the row. Its rows are put in a fixed order, so a word
or byte of the corpus is named by (route, place). A *bucket* is a group of hashes. What a route sends to a bucket is one row
with packed arrays, so the JVM moves a few large rows, and an entry takes as many bytes as its arrays say.

The frame of routes is used several times in one plan; Spark then reuses its one exchange of the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.words import SLICE_BYTES

#: Entries that a bucket should hold.
BUCKET_ENTRIES = 750_000
LARGEST_BUCKET_NUMBER = 1 << 24


def text_size(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def routed(docs: DataFrame, total: int, id_col: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Columns route, id, text and more; all rows, whatever repeats or is null."""
    routes = max(1, math.ceil(total / SLICE_BYTES))
    route = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(routes)).cast("int")
    return docs.select(route.alias("route"), F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), *more)


def bucket_count(entries: float) -> int:
    return int(min(LARGEST_BUCKET_NUMBER, max(1, math.ceil(entries / BUCKET_ENTRIES))))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of the hash; entries may carry the lower bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a route in their fixed order; rows that tie are alike in all columns."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()


def planes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The `size` lower bytes of whole numbers as 16-bit columns (and one byte, if odd): sorted columns compress well."""
    parts = [(x >> x.dtype.type(16 * k)).astype(np.uint16) for k in range(size // 2)]
    return parts + ([(x >> x.dtype.type(8 * (size - 1))).astype(np.uint8)] if size % 2 else [])


def joined(parts: list[np.ndarray]) -> np.ndarray:
    whole = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        whole |= part.astype(np.uint64) << np.uint64(16 * k)
    return whole


def deal(to: np.ndarray, sender: int, columns: dict[str, tuple[np.ndarray, int]]) -> pa.Table:
    """A row for each receiver in `to`: receiver, sender, and each column's lower bytes as binary planes, in the given order."""
    to = np.asarray(to)
    small = to.astype(np.uint16) if len(to) and to.max() < 65536 else to
    order = np.argsort(small, kind="stable")
    ranked = to[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    bounds = np.append(first, len(ranked))
    out = {"receiver": pa.array(ranked[first].astype(np.int32)), "sender": pa.array(np.full(len(first), sender, np.int32))}
    for name, (values, size) in columns.items():
        for k, plane in enumerate(planes(values[order], size)):
            offsets = (bounds * plane.itemsize).astype(np.int32)
            out[f"{name}{k}"] = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(plane))])
    return pa.table(out)


def schema(**sizes: int) -> str:
    """The Spark schema of `deal`'s rows."""
    names = [f"{name}{k}" for name, size in sizes.items() for k in range((size + 1) // 2)]
    return ", ".join(["receiver int", "sender int", *(f"{n} binary" for n in names)])


def column(table: pa.Table, name: str, size: int) -> np.ndarray:
    """A column of all rows of dealt entries, one after the other."""
    parts = []
    for k in range((size + 1) // 2):
        kind = np.uint16 if k < size // 2 else np.uint8
        chunks = table.column(f"{name}{k}").chunks
        parts.append(np.concatenate([_values(c, kind) for c in chunks]) if chunks else np.zeros(0, kind))
    return joined(parts)


def _values(chunk: pa.Array, kind: type) -> np.ndarray:
    offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    data = chunk.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and len(chunk) else np.zeros(0, kind)


def senders(table: pa.Table, name: str) -> np.ndarray:
    """The sender of each entry. name: a column's first plane, of two bytes an entry."""
    sizes = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) // 2 for c in table.column(f"{name}0").chunks if len(c)]
    return np.repeat(table.column("sender").to_numpy(), np.concatenate(sizes)) if sizes else np.zeros(0, np.int32)
