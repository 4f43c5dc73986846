"""Codes of vectors: equal parts, a codebook for each, nearest entries found in trees that cut off what is too far.

Entries of a codebook stand in a GNAT. A node has a few split points, every other entry goes to its nearest one, and for each split point and each child
the node keeps the range of distances from the one to the entries of the other. A query measures its distances to the split points; a child whose range,
seen from any split point, lies further away than the best entry so far is left out with its whole subtree. It is left out only if it is strictly
further, bounds are rounded outward, and what is measured is compared as whole numbers, so ties go to the lower index.

Vectors are worked on where they are read: a round of training sends one row for each entry and task, and the codebooks are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gistmill.functions.joins import SLICES
from gistmill.session import scratch_path

#: Split points of a node.
DEGREE = 8
#: Rows whose distances are held at a time.
BLOCK = 4096
#: Scaled components beyond this are left out: squares of their differences, summed over 4,096 places, still fit 64 bits.
LARGEST = 1 << 24
#: Of relative error in a bound; a square root and two additions make 2^-51 at most.
SLACK = 2.0**-48
#: Bytes of labels that are sent to all tasks; more are joined in slices.
SENT_LABELS = 8 << 20


@dataclass
class Gnat:
    """A node over the entries `points[numbers]`."""

    points: np.ndarray
    numbers: np.ndarray
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    splits: np.ndarray = field(init=False)
    children: list = field(init=False)

    def __post_init__(self):
        own = self.points[self.numbers]
        picked, gap = [0], squares(own, own[:1])[:, 0]
        while len(picked) < min(DEGREE, len(own)):  # the entry that is furthest from those before; never one that was picked
            gap[picked] = -1
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, squares(own, own[picked[-1:]])[:, 0])
        picked = np.sort(np.array(picked))
        self.splits = self.numbers[picked]
        rest = np.setdiff1d(np.arange(len(own)), picked)
        far = squares(own[rest], own[picked])
        nearest = far.argmin(1) if len(rest) else np.zeros(0, np.int64)
        k = len(picked)
        self.low, self.high, self.children = np.zeros((k, k)), np.zeros((k, k)), [None] * k
        for j in range(k):
            mine = rest[nearest == j]
            if len(mine):
                ranges = np.sqrt(far[nearest == j].astype(np.float64))
                self.low[:, j], self.high[:, j] = np.nextafter(ranges.min(0), 0), np.nextafter(ranges.max(0), np.inf)
                self.children[j] = Gnat(self.points, self.numbers[mine])

    def search(self, queries: np.ndarray, best: np.ndarray, index: np.ndarray, rows: np.ndarray | None = None) -> int:
        """Puts the least squared distance of each query, and the lowest entry at that distance, into best and index. Returns how many were measured."""
        rows = np.arange(len(queries)) if rows is None else rows
        far = squares(queries[rows], self.points[self.splits])
        least = far.argmin(1)  # split points are in the order of their numbers, so the first of ties
        found, at = far[np.arange(len(rows)), least], self.splits[least]
        better = (found < best[rows]) | (found == best[rows]) & (at < index[rows])
        best[rows[better]], index[rows[better]] = found[better], at[better]
        measured = far.size
        if not any(self.children):
            return measured
        far = np.sqrt(far.astype(np.float64))
        for j, child in enumerate(self.children):
            if child:
                reach = np.sqrt(best[rows].astype(np.float64))[:, None]
                outside = np.maximum(self.low[:, j] - far, far - self.high[:, j]) - reach
                near = rows[~(outside > SLACK * (far + self.high[:, j] + reach)).any(1)]
                if len(near):
                    measured += child.search(queries, best, index, near)
        return measured


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        out += step * step
    return out


def nearest(vectors: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the nearest entries by part, and their squared distances."""
    parts = vectors.reshape(len(vectors), len(trees), -1)
    index, best = np.full((len(trees), len(vectors)), 1 << 30, np.int64), np.full((len(trees), len(vectors)), np.iinfo(np.int64).max)
    for p, tree in enumerate(trees):
        for at in range(0, len(vectors), BLOCK):
            tree.search(np.ascontiguousarray(parts[at : at + BLOCK, p]), best[p, at : at + BLOCK], index[p, at : at + BLOCK])
    return index.T, best.T


def _whole(column: pa.Array, size: int, scale: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64).reshape(-1, size)


def _usable(vector: Column, parts: int, scale: int) -> Column:
    """Not null, without null or non-finite components or those beyond LARGEST, of a length that `parts` divides."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST / scale)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & whole, F.lit(False))


@dataclass
class Codebooks:
    """entries: parts x entries x width whole numbers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        return [Gnat(points, np.arange(len(points))) for points in self.entries]


def usable(vectors: DataFrame, parts: int = 16, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that get a code, and the length of their vectors: that of the usable vector of least id."""
    kept = vectors.where(_usable(F.col(vector), parts, scale))
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).select(F.size(vector).alias("n")).first()
    return (kept.where(F.size(vector) == first["n"]), first["n"]) if first else (kept, 0)


def train(kept: DataFrame, size: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks that start as the vectors of the least ids; each round moves an entry to the rounded-down mean of the parts that are nearest to it."""
    floor = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    start = kept.select(F.col(id_col).alias("id"), floor.alias("q")).orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    books = np.array([r["q"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    width = size // parts
    for _ in range(rounds):

        def tally(batches: Iterable[pa.RecordBatch], trees: list[Gnat] = Codebooks(books).trees()) -> Iterator[pa.RecordBatch]:  # noqa: B008
            count = np.zeros((parts, len(start)), np.int64)
            total = np.zeros((parts, len(start), width), np.int64)
            for batch in batches:
                whole = _whole(batch.column("v"), size, scale)
                index, _ = nearest(whole, trees)
                for p, own in enumerate(whole.reshape(len(whole), parts, width).transpose(1, 0, 2)):
                    np.add.at(total[p], index[:, p], own)
                    count[p] += np.bincount(index[:, p], minlength=len(start))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

        sent = kept.select(F.col(vector).alias("v")).mapInArrow(tally, "part int, entry int, n long, s array<long>")
        sums = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)])
        moved = books.copy()
        for r in sums.collect():  # parts x entries rows at most
            moved[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
        books = moved
    return Codebooks(books)


def encode(kept: DataFrame, size: int, books: Codebooks, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (id, label, code, error): a byte for each part in `code`, the squared distance to the entries in `error`."""
    parts, trees = len(books.entries), books.trees()

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, far = nearest(_whole(batch.column("v"), size, scale), trees)
            data = np.ascontiguousarray(index.astype(np.uint8))
            codes = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * parts), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(far.sum(1))], ["id", "label", "code", "error"])

    given = kept.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return given.mapInArrow(code, f"id long, label {given.schema['label'].dataType.simpleString()}, code binary, error long")


def decode(coded: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """Adds `decoded`: the middle of the cells that the entries stand for, as array<double>."""
    shelf, width = books.entries, books.entries.shape[2]

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.array([list(x) for x in batch.column("code").to_pylist()], np.int64).reshape(-1, len(shelf))
            whole = (shelf[np.arange(len(shelf)), index].reshape(len(index), -1) + 0.5) / scale
            bounds = np.arange(len(index) + 1, dtype=np.int32) * (len(shelf) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(whole.ravel()))], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(fill, StructType([*coded.schema.fields, StructField("decoded", ArrayType(DoubleType()))]))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds `label_error`, the errors summed over rows of equal labels; nulls are one label. `coded` should be cheap to read twice."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    size = sums.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("_label").cast("string"))).alias("b")).first()
    if size["n"] * 32 + (size["b"] or 0) <= SENT_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    dealt = sums.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    mine = F.xxhash64("id").bitwiseAND(SLICES - 1)
    return coded.join(dealt, F.col("label").eqNullSafe(F.col("_label")) & (mine == F.col("_slice"))).drop("_label", "_slice")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Codes of all usable vectors, stored in the shared folder: (id, label, code, error, label_error); and the codebooks.

    Components become floor(scale * x); vectors are cut into `parts` equal parts. Left out: null vectors, those with a null or non-finite component or one
    beyond LARGEST / scale, empty ones, those whose length `parts` does not divide, and those of another length than the usable vector of least id. Null ids
    come last in the order of ids; of equal ids the lesser vector comes first; repeated rows count as often as they are there. A table without usable
    vectors gives no rows and no codebooks. entries: up to 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    kept, size = usable(vectors, parts, scale, id_col, vector)
    spark = vectors.sparkSession
    if not size:
        kind = vectors.schema[label].dataType.simpleString()
        return spark.createDataFrame([], f"id long, label {kind}, code binary, error long, label_error long"), None
    books = train(kept, size, parts, entries, rounds, scale, id_col, vector)
    path = scratch_path(spark, "codes")
    encode(kept, size, books, scale, id_col, vector, label).write.parquet(path)
    return with_label_errors(spark.read.parquet(path)), books


def digest(coded: DataFrame, books: Codebooks | None) -> DataFrame:
    return coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).alias("codebooks_sha256"))
