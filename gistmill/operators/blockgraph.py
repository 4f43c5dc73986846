"""A symmetric sparse operator on blocks of nodes, for many applications in a row.

Nodes are dealt to blocks of about BLOCK_NODES by a hash. What a block needs from another one (the places of the nodes at the far ends of its edges) is
found once. An application then is one shuffle: each block sends to each other block one packed row with the numbers of the nodes that this one
needs, and adds up what it gets along its edges in numpy. A task holds one block, its edges and what is sent to it.

In a graph without neighbourhoods a block needs most nodes, so that a shuffle carries many copies of each number. As long as all numbers fit HELD_BYTES, they go
to the tasks by way of the driver instead (``HeldGraph``), and no application writes anything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import cut_lineage

BLOCK_NODES = 8192
#: Numbers of all nodes of so many bytes may go through the driver (``HeldGraph``).
HELD_BYTES = 128 << 20
#: Products of weights and numbers that a task holds at a time.
HELD_CELLS = 1 << 19
#: Applications in one job.
STEPS = 10
_EDGES, _SENDS = range(2)
_PARTS = "block int, kind int, peer int, ids binary, rows binary, slots binary, w binary"
_SENT = "receiver int, sender int, x binary, p binary"
_OWN = -1


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = [c.split() for c in schema.split(", ")]
    types = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], types[kind]) for i, (name, kind) in enumerate(kinds)})


class BlockGraph:
    """edges: a, b, w (w: what a gets of b's number), with an edge of each node to itself."""

    def __init__(self, edges: DataFrame, nodes: int):
        self.edges, self.nodes, self.blocks = edges, nodes, max(1, math.ceil(nodes / BLOCK_NODES))

    def held(self) -> HeldGraph:
        return HeldGraph(self.edges, self.nodes)

    @cached_property
    def parts(self) -> DataFrame:
        edges, blocks, block = self.edges, self.blocks, self._block

        def cut(table: pa.Table) -> pa.Table:
            a, b, w, far = (table.column(c).to_numpy() for c in ("a", "b", "w", "far"))
            own, me = np.unique(a), table.column("block")[0].as_py()
            out, slots, before = [], np.empty(len(a), np.int32), 0
            for s in np.unique(far):
                at = np.flatnonzero(far == s)
                needed, slot = np.unique(b[at], return_inverse=True)
                slots[at] = slot + before
                before += len(needed)
                out.append((int(s), _SENDS, me, _bytes(needed), None, None, None))
            rows = np.searchsorted(own, a).astype(np.int32)
            order = np.lexsort((slots, rows))
            out.append((me, _EDGES, me, _bytes(own), _bytes(rows[order]), _bytes(slots[order]), _bytes(w[order])))
            return _table(_PARTS, out)

        def place(table: pa.Table) -> pa.Table:
            """Needed nodes by their places in their block, no longer by their ids."""
            rows = table.to_pylist()
            own = next(np.frombuffer(r["ids"], np.int64) for r in rows if r["kind"] == _EDGES)
            for r in rows:
                if r["kind"] == _SENDS:
                    r["ids"] = _bytes(np.searchsorted(own, np.frombuffer(r["ids"], np.int64)).astype(np.int32))
            return _table(_PARTS, [tuple(r.values()) for r in rows])

        given = edges.filter("a is not null and b is not null").select("a", "b", "w", block("a").alias("block"), block("b").alias("far"))
        parts = given.groupBy("block").applyInArrow(cut, _PARTS).groupBy("block").applyInArrow(place, _PARTS)
        deal = min(blocks, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return cut_lineage(parts).repartition(deal, "block").persist()

    def close(self) -> None:
        if "parts" in vars(self):
            self.parts.unpersist()

    def _block(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.blocks)).cast("int")

    def three_terms(self, state: DataFrame, names: Sequence[str], steps: int, scale: float) -> DataFrame:
        """id and names after ``steps`` times: the next is scale * operator(last) - 2 * last - the one before. state: id, names and their ``p_`` columns."""
        names, width = list(names), len(names)

        def send(parts: list[dict], x: np.ndarray, p: np.ndarray) -> pa.Table:
            me = parts[0]["block"]
            rows = [(r["peer"], me, _bytes(x[np.frombuffer(r["ids"], np.int32)]), None) for r in parts if r["kind"] == _SENDS]
            return _table(_SENT, [*rows, (me, _OWN, _bytes(x), _bytes(p))])

        def first(held: pa.Table, given: pa.Table) -> pa.Table:
            given = given.sort_by("id")
            columns = lambda own: np.stack([given.column(c).to_numpy() for c in own], 1)
            return send(held.to_pylist(), columns(names), columns([f"p_{c}" for c in names]))

        def moved(held: pa.Table, sent: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray]:
            parts, got = held.to_pylist(), sorted(sent.to_pylist(), key=lambda r: r["sender"])
            numbers = lambda raw: np.frombuffer(raw, float).reshape(-1, width)
            last, before = numbers(got[0]["x"]), numbers(got[0]["p"])
            far = np.concatenate([numbers(r["x"]) for r in got[1:]])
            edges = next(r for r in parts if r["kind"] == _EDGES)
            rows, slots, w = np.frombuffer(edges["rows"], np.int32), np.frombuffer(edges["slots"], np.int32), np.frombuffer(edges["w"], float)
            heads = np.searchsorted(rows, np.arange(len(last) + 1))
            return parts, scale * image(heads, slots, w, far) - 2 * last - before, last

        def step(held: pa.Table, sent: pa.Table) -> pa.Table:
            return send(*moved(held, sent))

        def end(held: pa.Table, sent: pa.Table) -> pa.Table:
            parts, x, _ = moved(held, sent)
            ids = next(np.frombuffer(r["ids"], np.int64) for r in parts if r["kind"] == _EDGES)
            return pa.table({"id": ids, **{c: np.ascontiguousarray(x[:, i]) for i, c in enumerate(names)}})

        parts = lambda: self.parts.groupBy("block")
        given = state.withColumn("receiver", self._block("id"))
        sent = parts().cogroup(given.groupBy("receiver")).applyInArrow(first, _SENT)
        for k in range(1, steps):
            sent = parts().cogroup(sent.groupBy("receiver")).applyInArrow(step, _SENT)
            if k % STEPS == 0:
                sent = cut_lineage(sent)
        return parts().cogroup(sent.groupBy("receiver")).applyInArrow(end, ", ".join(["id long", *(f"{c} double" for c in names)]))


def image(heads: np.ndarray, far: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of w * x[far] for each node. Its edges begin at its place of ``heads``, which ends with their number; every node has one."""
    n, width = len(heads) - 1, x.shape[1]
    out, at = np.empty((n, width)), 0
    while at < n:
        # Whole nodes, with as many edges as are held at a time, or one.
        stop = max(at + 1, int(np.searchsorted(heads, heads[at] + HELD_CELLS // width, "right")) - 1)
        of = slice(heads[at], heads[stop])
        out[at:stop] = np.add.reduceat(w[of, None] * x[far[of]], heads[at:stop] - heads[at])
        at = stop
    return out


class HeldGraph:
    """The operator of BlockGraph for nodes whose numbers fit HELD_BYTES. A task holds them, and the edges of one block."""

    def __init__(self, edges: DataFrame, nodes: int):
        spark = self.spark = edges.sparkSession
        blocks = max(1, math.ceil(nodes / BLOCK_NODES))
        given = edges.filter("a is not null and b is not null").select("a", "b", "w")
        ids = self.ids = np.sort(given.filter("a = b").select("a").distinct().toArrow().column("a").to_numpy())
        known = self.known = spark.sparkContext.broadcast(ids)
        self.sent = None

        def cut(table: pa.Table) -> pa.Table:
            a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
            row, far = (np.searchsorted(known.value, x).astype(np.int32) for x in (a, b))
            order = np.lexsort((far, row))
            own, heads = np.unique(row[order], return_index=True)
            return pa.table({c: pa.array([_bytes(x)]) for c, x in (("own", own), ("heads", np.append(heads, len(row))), ("far", far[order]), ("w", w[order]))})

        dealt = given.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
        deal = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts = dealt.repartition(deal, "block").groupBy("block").applyInArrow(cut, "own binary, heads binary, far binary, w binary")
        self.parts = cut_lineage(parts)

    def close(self) -> None:
        self._send(None)
        self.known.destroy()

    def _send(self, x: np.ndarray | None):
        if self.sent is not None:
            self.sent.destroy()
        self.sent = None if x is None else self.spark.sparkContext.broadcast(x)
        return self.sent

    def _numbers(self, table: DataFrame, *columns: Sequence[str]) -> list[np.ndarray]:
        got = table.filter("id is not null").select("id", *[c for own in columns for c in own]).toArrow()
        at = np.searchsorted(self.ids, got.column("id").to_numpy())
        out = [np.zeros((len(self.ids), len(own))) for own in columns]
        for x, own in zip(out, columns, strict=True):
            for i, c in enumerate(own):
                x[at, i] = got.column(c).to_numpy()
        return out

    def _image(self, x: np.ndarray) -> np.ndarray:
        held, width = self._send(x), x.shape[1]

        def run(batches):
            for batch in batches:
                for own, heads, far, w in zip(*(batch.column(c) for c in ("own", "heads", "far", "w")), strict=True):
                    y = image(*(np.frombuffer(r.as_buffer(), t) for r, t in ((heads, np.int64), (far, np.int32), (w, float))), held.value)
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()]), pa.array([_bytes(y)])], ["own", "y"])

        out = np.empty_like(x)
        got = self.parts.mapInArrow(run, "own binary, y binary").toArrow()
        for own, y in zip(got.column("own"), got.column("y"), strict=True):
            out[np.frombuffer(own.as_buffer(), np.int32)] = np.frombuffer(y.as_buffer(), float).reshape(-1, width)
        return out

    def _table(self, x: np.ndarray, names: Sequence[str]) -> DataFrame:
        """To be read before the next application."""
        held, known = self._send(x), self.known

        def run(batches):
            for batch in batches:
                for raw in batch.column("own"):
                    own = np.frombuffer(raw.as_buffer(), np.int32)
                    y = held.value[own]
                    yield pa.RecordBatch.from_arrays([pa.array(known.value[own]), *(pa.array(y[:, i].copy()) for i in range(len(names)))], ["id", *names])

        return self.parts.select("own").mapInArrow(run, ", ".join(["id long", *(f"{c} double" for c in names)]))

    def apply(self, table: DataFrame, names: Sequence[str]) -> DataFrame:
        return self._table(self._image(self._numbers(table, names)[0]), names)

    def three_terms(self, state: DataFrame, names: Sequence[str], steps: int, scale: float) -> DataFrame:
        """As BlockGraph's."""
        last, before = self._numbers(state, names, [f"p_{c}" for c in names])
        for _ in range(steps):
            last, before = scale * self._image(last) - 2 * last - before, last
        return self._table(last, names)
