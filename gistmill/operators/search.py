"""Exact nearest rows of a large base, in two steps with a bound for each query.

Base rows belong to the nearest of some sqrt(rows) pivots. Cells of neighbouring pivots share a bin of about ``block_rows`` rows; a cell that is larger by
itself is cut into parts. A query knows its distance to every pivot, and so, before any row is met, a distance within which k rows must lie. Both sides are
packed into blocks, of one bin each. In step one a block of queries meets a block of its own bin; a query's k-th distance replaces its bound if it is lower. In
step two tasks for pairs of partitions let a block of queries meet the blocks of all bins with a cell that a bound reaches, one after the other, and keep the
k best; only cells that a query's own bound reaches by then are measured. Blocks are read and never sent: what lies on disk is linear in the rows (but for k
rows of a query from each part of the base). Where nothing can be ruled out, the search compares all pairs, block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions.blocks import MOST_PARTS, crossed, matrix, pack, right_parts, sq_distances, unpack, vectors
from gistmill.functions.draws import hash_key
from gistmill.session import cut_lineage

#: Bytes of pivots that are sent to all tasks. With more base rows than their square, cells grow and are cut into parts.
PIVOT_BYTES = 64 << 20
#: Distances from rows to pivots that a task holds at a time.
HELD_CELLS = 1 << 19
#: Pairs of vectors that are measured anew at a time.
HELD_PAIRS = 1 << 13
#: Stands for a null id, and for a row that is known by its distance alone.
NO_ID = np.iinfo(np.int64).max
HITS = "id long, nbr long, dist double"


def group_cells(pivots: np.ndarray, count: np.ndarray, block_rows: int) -> np.ndarray:
    """The bin of each cell: halves of the pivots along their widest axis, until a bin holds ``block_rows`` rows or one cell."""
    out, todo, n = np.zeros(len(pivots), dtype=np.int32), [np.arange(len(pivots))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or count[own].sum() <= block_rows:
            out[own], n = n, n + 1
            continue
        axis = pivots[own].var(axis=0).argmax()
        own = own[np.argsort(pivots[own, axis], kind="stable")]
        half = int(np.searchsorted(np.cumsum(count[own]), count[own].sum() / 2)) + 1
        half = min(max(half, 1), len(own) - 1)
        todo += [own[:half], own[half:]]
    return out


@dataclass
class Grid:
    """Pivots and, by cell, rows, radius, bin, and whether its rows have more than one label (else which). zeros: some row has no length."""

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    bin_of: np.ndarray
    label: np.ndarray
    mixed: np.ndarray
    slack: float
    zeros: bool = False

    def from_pivots(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(sq_distances(v, self.pivots))

    def first_bound(self, far: np.ndarray, k: int, label: np.ndarray | None) -> np.ndarray:
        """A distance within which k base rows lie, one more since a query may meet itself; with labels, one row of another label."""
        farthest = np.where(self.count > 0, far + self.radius, np.inf)
        if label is not None:
            if k > 1:
                return np.full(len(far), np.inf)
            other = self.mixed[None, :] | (label[:, None] != self.label[None, :])
            return np.where(other, farthest, np.inf).min(axis=1)
        order = np.argsort(farthest, axis=1)
        filled = np.cumsum(self.count[order], axis=1) >= k + 1
        at = np.take_along_axis(order, filled.argmax(axis=1)[:, None], 1)
        return np.where(filled[:, -1], np.take_along_axis(farthest, at, 1)[:, 0], np.inf)

    def reached(self, far: np.ndarray, near: np.ndarray, own: np.ndarray, cells: np.ndarray | slice, bound: np.ndarray) -> np.ndarray:
        """Which of ``cells`` may hold a row within the bound. far: distances to their pivots; near: that to the query's nearest pivot ``own``.

        A cell's rows lie within its radius, and on its side of the plane between its pivot and any other.
        """
        between = np.sqrt(sq_distances(self.pivots[own], self.pivots[cells]))
        apart = between > self.slack
        behind = np.divide(far * far - (near * near)[:, None], 2 * between, out=np.zeros_like(far), where=apart)
        return (np.maximum(far - self.radius[cells], behind) <= bound[:, None] + self.slack) & (self.count[cells] > 0)


def _in_chunks(df: DataFrame, width: int, fn, schema: T.StructType) -> DataFrame:
    """``fn`` on pandas blocks with at most HELD_CELLS distances to ``width`` pivots."""
    step = max(1, HELD_CELLS // width)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), step):
                yield fn(pdf.iloc[at : at + step])

    return df.mapInPandas(run, schema)


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, kind) for n, kind in fields]])


def build_grid(base: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, Grid]:
    """Base rows with ``cell`` (written), and their grid. n: base rows."""
    spark = base.sparkSession
    width = base.select(F.size("v").alias("n")).limit(1).collect()[0]["n"]
    most = max(1, min(int(np.ceil(np.sqrt(n))), PIVOT_BYTES // (8 * max(1, width))))
    picked = base.withColumn("_h", hash_key(7, "id")).orderBy("_h", "id").limit(most).select("v").toPandas()
    pivots = np.unique(matrix(picked["v"]), axis=0)
    held = spark.sparkContext.broadcast(pivots)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        d = sq_distances(matrix(pdf["v"]), held.value)
        cell = d.argmin(axis=1)
        return pdf.assign(cell=cell.astype("int32"), away=np.sqrt(d[np.arange(len(pdf)), cell]))

    rows = cut_lineage(_in_chunks(base, len(pivots), assign, _with(base, ("cell", T.IntegerType()), ("away", T.DoubleType()))))
    label = [F.min("label").alias("lo"), F.max("label").alias("hi")] if "label" in base.columns else [F.lit(0).alias("lo"), F.lit(0).alias("hi")]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    norm = [F.max(square).alias("norm"), F.min(square).alias("least")]
    facts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), *norm, *label).toPandas()  # a row for each pivot
    count, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    lo, hi = np.full(len(pivots), None, dtype=object), np.full(len(pivots), None, dtype=object)
    at = facts["cell"].to_numpy()
    count[at], radius[at], lo[at], hi[at] = facts["n"], facts["r"], facts["lo"], facts["hi"]
    slack = 1e-6 * (1.0 + float(np.sqrt(facts["norm"].max())))
    return rows, Grid(pivots, count, radius, group_cells(pivots, count, block_rows), lo, lo != hi, slack, bool((facts["least"] == 0).any()))


def first_bounds(queries: DataFrame, grid: Grid, k: int, labelled: bool, metric: str = "euclidean") -> DataFrame:
    """Queries with the bin of their own cell, and the bound that cells alone give.

    A vector without length is one away from all by the cosine, as if at right angles, though straight lines to it are shorter.
    """
    held = queries.sparkSession.sparkContext.broadcast(grid)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        g = held.value
        v = matrix(pdf["v"])
        far = g.from_pivots(v)
        own, bound = far.argmin(axis=1), g.first_bound(far, k, pdf["label"].to_numpy() if labelled else None)
        if metric == "cosine":
            bound = np.where(g.zeros | ~v.any(axis=1), np.maximum(bound, np.sqrt(2.0)), bound)
        return pdf.assign(own=own.astype("int32"), bin=g.bin_of[own], bound=bound)

    return _in_chunks(queries, len(grid.pivots), place, _with(queries, ("own", T.IntegerType()), ("bin", T.IntegerType()), ("bound", T.DoubleType())))


def routes(bounded: DataFrame, grid: Grid) -> DataFrame:
    """A row for each query and further bin that its bound reaches; ``work``: rows of the reached cells. What the bounds are worth is measured by it.

    A task lists the bins of a query beside it, and Spark makes the rows: Python never holds a copy of a vector for each bin.
    """
    held = bounded.sparkSession.sparkContext.broadcast(grid)
    bins = int(grid.bin_of.max()) + 1

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        g = held.value
        far, own = g.from_pivots(matrix(pdf["v"])), pdf["own"].to_numpy()
        row, cell = np.nonzero(g.reached(far, far[np.arange(len(far)), own], own, slice(None), pdf["bound"].to_numpy()))
        pair, at = np.unique(row.astype(np.int64) * bins + g.bin_of[cell], return_inverse=True)
        work = np.bincount(at, g.count[cell], len(pair)).astype(np.int64)
        row, to = pair // bins, (pair % bins).astype(np.int32)
        other = to != pdf["bin"].to_numpy()[row]
        row, to, work = row[other], to[other], work[other]
        ends = np.searchsorted(row, np.arange(1, len(pdf)))
        return pdf.assign(to=np.split(to, ends), rows=np.split(work, ends)) if len(pdf) else pdf.assign(to=None, rows=None)

    listed = _in_chunks(bounded, len(grid.pivots), send, _with(bounded, ("to", T.ArrayType(T.IntegerType())), ("rows", T.ArrayType(T.LongType()))))
    one = cut_lineage(listed).withColumn("one", F.explode(F.arrays_zip("to", "rows")))
    return one.withColumns({"bin": F.col("one.to"), "work": F.col("one.rows")}).select(*bounded.columns, "work")


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("id").cast(pa.int64()), NO_ID).to_numpy()


class Best:
    """The k nearest rows so far of each query of a block.

    q: id, v, own, bound and, if only other labels count, label; ``dist`` holds the distances of rows that are known already.
    """

    def __init__(self, q: pa.Table, grid: Grid, k: int, metric: str, skip_self: bool, other_label: bool):
        self.grid, self.k, self.metric, self.skip_self = grid, k, metric, skip_self
        self.id, self.v, self.own, self.bound = _ids(q), vectors(q.column("v")), q.column("own").to_numpy(), q.column("bound").to_numpy().copy()
        self.label = q.column("label").to_pandas().to_numpy() if other_label else None
        self.near = np.sqrt(((self.v - grid.pivots[self.own]) ** 2).sum(1))
        self.dist = vectors(q.column("dist")).copy() if "dist" in q.column_names else np.full((len(q), k), np.inf)
        self.nbr, self.new = np.full((len(q), k), NO_ID), np.zeros((len(q), k), bool)
        # Rounding is least around a point amid the queries.
        self.middle = self.v.mean(0) if metric != "cosine" else 0.0
        self.moved = self.v - self.middle
        self.short, self.square = self.moved.astype(np.float32), (self.moved * self.moved).sum(1)
        self.held = np.empty(0), np.empty(0, bool)

    def meet(self, b: pa.Table) -> None:
        """b: id, v, cell and perhaps label, by cell."""
        bv, bid, cell = vectors(b.column("v")), _ids(b), b.column("cell").to_numpy()
        label = None if self.label is None else b.column("label").to_pandas().to_numpy()
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        ends, cells, step = np.append(starts[1:], len(cell)), cell[starts], max(1, HELD_CELLS // len(cell))
        if step * len(cell) > len(self.held[1]):
            self.held = np.empty(max(HELD_CELLS, len(cell))), np.empty(max(HELD_CELLS, len(cell)) + 8, bool)
        moved = bv - self.middle
        sides = bv, moved, moved.astype(np.float32), (moved * moved).sum(1), bid, label
        for at in range(0, len(self.id), step):
            rows = np.arange(at, min(at + step, len(self.id)))
            far = np.sqrt(sq_distances(self.v[rows], self.grid.pivots[cells]))
            reached = self.grid.reached(far, self.near[rows], self.own[rows], cells, self.bound[rows])
            if 2 * (reached @ (ends - starts)).sum() > len(rows) * len(cell):
                self._measure(rows, *sides)
                continue
            for c in np.flatnonzero(reached.any(0)):
                of = slice(starts[c], ends[c])
                self._measure(rows[reached[:, c]], *[x if x is None else x[of] for x in sides])

    def _measure(self, rows: np.ndarray, bv: np.ndarray, moved: np.ndarray, short: np.ndarray, square: np.ndarray, bid: np.ndarray, label: np.ndarray | None) -> None:
        # A score is the product, less half the square of the base row if lines count: the higher the nearer, from ``least`` on within the bound. Bounds
        # know straight lines; distances of unit vectors are measured as 1 - cosine, half the square of the line.
        lines = self.metric != "cosine"
        within = (self.bound[rows] + self.grid.slack) ** 2 / 2
        half = self.square[rows] / 2 if lines else np.ones(len(rows))
        # How far rounding may move a score of single precision, which serves where that is little; the rest is for the exact distances.
        off = (bv.shape[1] + 8) * 2.0**-24 * (square.max() + 2 * half)
        coarse = (64 * off <= within).all()
        off, cells = off if coarse else off * 2.0**-29, len(rows) * len(bv)
        near = self.held[1][:cells].reshape(len(rows), -1)
        score = (self.held[0].view(np.float32) if coarse else self.held[0])[:cells].reshape(near.shape)
        np.matmul(self.short[rows] if coarse else self.moved[rows], (short if coarse else moved).T, out=score)
        if lines:
            score -= (square / 2).astype(score.dtype)
        np.greater_equal(score, (half - within - off).astype(score.dtype)[:, None], out=near)
        if self.skip_self:
            near &= (self.id[rows][:, None] != bid) | (bid == NO_ID)
        if label is not None:
            near &= self.label[rows][:, None] != label
        if np.count_nonzero(near) > 4 * self.k * len(rows) and self.k < len(bv):
            # Bounds that keep too many: the k-th of this block is nearer.
            score[~near] = -np.inf
            kth = np.partition(score, len(bv) - self.k, axis=1)[:, len(bv) - self.k]
            near &= score >= (kth - 2 * off).astype(score.dtype)[:, None]
        # Eight cells at a time: hits are few.
        flat = self.held[1][: -(-cells // 8) * 8]
        flat[cells:] = False
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        row, col = np.divmod(at[flat[at]], len(bv))
        if not len(row):
            return
        qv = self.v[rows]
        exact = np.empty(len(row))
        for at in range(0, len(row), HELD_PAIRS):
            a, c = qv[row[at : at + HELD_PAIRS]], bv[col[at : at + HELD_PAIRS]]
            exact[at : at + HELD_PAIRS] = np.maximum(1.0 - (a * c).sum(1), 0.0) if self.metric == "cosine" else np.sqrt(((a - c) ** 2).sum(1))
        self._add(rows[row], bid[col], exact)

    def _add(self, row: np.ndarray, nbr: np.ndarray, dist: np.ndarray) -> None:
        some = np.unique(row)
        old = np.isfinite(self.dist[some])
        known = np.repeat(some, self.k).reshape(old.shape)[old]
        new = np.concatenate([self.new[some][old], np.ones(len(row), bool)])
        row, nbr, dist = np.concatenate([known, row]), np.concatenate([self.nbr[some][old], nbr]), np.concatenate([self.dist[some][old], dist])
        order = np.lexsort((nbr, dist, row))
        row, nbr, dist, new = row[order], nbr[order], dist[order], new[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        top = rank < self.k
        at = row[top], rank[top]
        self.dist[at], self.nbr[at], self.new[at] = dist[top], nbr[top], new[top]
        kth = self.dist[some, -1]
        self.bound[some] = np.minimum(self.bound[some], np.sqrt(2 * kth) if self.metric == "cosine" else kth)

    def hits(self) -> pa.Table:
        """Rows (id, nbr, dist) that were met here."""
        row, rank = np.nonzero(self.new)
        ids = [pa.array(x, mask=x == NO_ID) for x in (self.id[row], self.nbr[row, rank])]
        return pa.table([*ids, pa.array(self.dist[row, rank])], ["id", "nbr", "dist"])

    def bins(self) -> np.ndarray:
        """Bins with a cell that the bound of any query reaches."""
        cells = np.zeros(len(self.grid.count), bool)
        step = max(1, HELD_CELLS // len(cells))
        for at in range(0, len(self.id), step):
            of = slice(at, at + step)
            cells |= self.grid.reached(self.grid.from_pivots(self.v[of]), self.near[of], self.own[of], slice(None), self.bound[of]).any(0)
        return np.unique(self.grid.bin_of[cells])


def two_steps(
    queries: DataFrame, base: DataFrame, n: int, k: int, metric: str, skip_self: bool, other_label: bool, block_rows: int
) -> DataFrame:
    """Rows (id, nbr, dist): the k nearest of each query and some more. n: base rows."""
    spark = base.sparkSession
    rows, grid = build_grid(base, n, block_rows)
    held = spark.sparkContext.broadcast(grid)
    bins, width = int(grid.bin_of.max()) + 1, grid.pivots.shape[1]
    placed = cut_lineage(first_bounds(queries, grid, k, other_label, metric))
    asked = np.zeros(bins, dtype=np.int64)
    for r in placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each bin
        asked[r["bin"]] = r["n"]
    counted = np.bincount(grid.bin_of, grid.count, bins).astype(np.int64)
    parts = pd.DataFrame({"bin": np.arange(bins, dtype=np.int32), "bn": np.maximum(1, -(-counted // block_rows)), "qn": np.maximum(1, -(-asked // block_rows))})
    blocks = int(parts["qn"].sum())
    # Both tables have a row for each pivot at most.
    parts = spark.createDataFrame(parts, "bin int, bn long, qn long")
    cells = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(grid.count), dtype=np.int32), "bin": grid.bin_of}), "cell int, bin int")

    def part(number: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(number))

    def packed(table: pa.Table) -> pa.Table:
        own = [c for c in ("id", "v", "cell", "label") if c in table.column_names]
        key = {c: table.column(c)[:1] for c in ("bin", "part")}
        return pa.table({**key, "other": pa.array([pack(table.select(own).sort_by("cell"))])})

    b = rows.join(F.broadcast(cells.join(parts, "bin")), "cell").withColumn("part", part("bn"))
    b = b.repartition(right_parts(n, width), "bin", "part").groupBy("bin", "part").applyInArrow(packed, "bin int, part long, other binary")
    b = cut_lineage(b)

    def first(q: pa.Table, given: pa.Table) -> pa.Table:
        if not len(q):
            return FIRST.empty_table()
        best = Best(q, held.value, k, metric, skip_self, other_label)
        met = given.column("part")[0].as_py() if len(given) else -1
        for raw in given.column("other"):
            best.meet(unpack(raw))
        own = q.select([c for c in ("id", "v", "own", "label") if c in q.column_names])
        own = own.append_column("bound", pa.array(best.bound)).append_column("dist", pa.FixedSizeListArray.from_arrays(best.dist.ravel(), k).cast(pa.list_(pa.float64())))
        at, number = q.column("bin")[0].as_py(), q.column("part")[0].as_py()
        row = {"place": at << 32 | number, "at": at, "met": met, "reached": best.bins().tolist(), "block": pack(own), "hits": pack(best.hits())}
        return pa.Table.from_pylist([row], FIRST)

    def further(q: pa.Table, others: Iterable[pa.Table]) -> Iterator[pa.RecordBatch]:
        best = Best(q, held.value, k, metric, skip_self, other_label)
        for other in others:
            best.meet(other)
        yield from best.hits().to_batches()

    # A block of the base meets the blocks of queries whose number leaves its own.
    met = F.explode(F.sequence(F.col("part"), F.col("qn") - 1, F.col("bn")))
    one = b.join(F.broadcast(parts), "bin").filter("part < qn").withColumn("number", met)
    q = placed.join(F.broadcast(parts), "bin").withColumn("part", part("qn"))
    deal = min(blocks, MOST_PARTS)
    q, one = q.repartition(deal, "bin", "part"), one.select(F.col("bin").alias("b_bin"), "number", "part", "other").repartition(deal, "b_bin", "number")
    kinds = "place long, at int, met long, reached array<int>, block binary, hits binary"
    own = cut_lineage(q.groupBy("bin", "part").cogroup(one.groupBy("b_bin", "number")).applyInArrow(first, kinds))
    on = F.array_contains("reached", F.col("bin")) & ~((F.col("at") == F.col("bin")) & (F.col("met") == F.col("part")))
    found = own.select("hits").mapInArrow(_unpacked, HITS)
    return found.union(crossed(own.select("place", "at", "met", "reached", "block"), b, on, further, HITS))


FIRST = pa.schema([("place", pa.int64()), ("at", pa.int32()), ("met", pa.int64()), ("reached", pa.list_(pa.int32())), ("block", pa.binary()), ("hits", pa.binary())])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("hits"):
            yield from unpack(raw).to_batches()
