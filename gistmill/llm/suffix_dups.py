"""Repeated byte strings, found by bucket-pointer refinement of suffixes.

Suffixes get bucket identifiers for their first bytes, to a depth that grows from step to step. An identifier is a 64-bit hash of the string
it stands for, made from prefix sums only where a step asks for it; the same string has the same identifier in every task, so buckets need no central
numbering, and what a step has settled is reused by the next.

Only suffixes that can still be in a shared bucket of the full width are carried on:

1. The suffixes at *anchors*: each window of `width` bytes has as its anchor the place with the least identifier of
   ANCHOR_BYTES in it. Equal windows have equal anchors at equal offsets, and the windows of an anchor follow each other.
   Anchors alone in their bucket leave.
2. For the rest, buckets of the whole reach of an anchor: all bytes of its windows, named by the identifiers of its first and
   last window. Where two anchors share one, all their windows are repeated.
3. Only what is left at the ends of repeats goes on window by window, against one anchor of each bucket of step 2.

Nothing is collected: a bucket holds hashes and places, and identical texts shrink to a count in step 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gistmill.llm import blobs
from gistmill.llm.words import BYTE_NUMBERS, U64, covered, mix, powers, repeated, text_bytes, thrifty, thrifty_pair

WIDTH = 200
ANCHOR_BYTES = 32
#: Bits of a place in a route of up to 16 MB; the other bits of an identifier choose anchors.
PLACE_BITS = 24
#: What step 2 tells a route about an anchor.
WINDOW, WHOLE, REST, MODEL = range(4)
_PLACE = 4


class Identifiers:
    """Bucket identifiers of the strings of any depth, from prefix sums over the bytes: made where they are asked for. Strings may run across texts."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_NUMBERS[data] * self.power[:-1], out=self.sums[1:])

    def at(self, places: np.ndarray, depth: int) -> np.ndarray:
        found = self.sums[places + depth]
        found -= self.sums[places]
        found *= self.inverse[places]
        return mix(found + U64(depth))

    def every(self, depth: int) -> np.ndarray:
        n = max(0, len(self.sums) - depth)
        found = self.sums[depth:] - self.sums[:n]
        found *= self.inverse[:n]
        found += U64(depth)
        return mix(found)


class Route:
    """Anchors of the texts of a route and the windows that belong to each."""

    def __init__(self, table: pa.Table, width: int):
        self.table = blobs.in_order(table)
        self.data, self.offsets = text_bytes(self.table.column("text").chunk(0) if self.table.num_rows else pa.array([], pa.string()))
        depth = min(ANCHOR_BYTES, width)
        names, self.width = Identifiers(self.data), width
        self.ids = lambda places: names.at(places, width)
        short = names.every(depth)
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(len(self.data))
        self.starts = np.flatnonzero(left >= width)
        anchor = _least(short, width - depth + 1)[self.starts] if len(self.starts) else self.starts
        # The anchor of the next window is the same or a later one, so the windows of an anchor lie together.
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(anchor)) - 1
        self.anchors = anchor[self.first]
        self.keys = short[self.anchors]

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Starts of the windows of the anchors of these numbers."""
        sizes = self.last[which] - self.first[which] + 1
        ends = np.cumsum(sizes)
        return self.starts[np.repeat(self.first[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def reach(self, which: np.ndarray) -> np.ndarray:
        """Identifiers of all bytes of an anchor's windows, and of where the anchor lies in them."""
        a, b = self.starts[self.first[which]], self.starts[self.last[which]]
        return mix(mix(self.ids(a) + U64(1)) ^ (self.ids(b) * U64(0xA0761D6478BD642F)) ^ mix((b - a).astype(U64) << U64(20) | (self.anchors[which] - a).astype(U64)))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of the upper 40 bits of each run of `span` values, the first one of ties."""
    n = len(values) - span + 1
    if len(values) <= 1 << PLACE_BITS:
        # Value and place are one number, so the lesser of two has both.
        least = values & ~U64((1 << PLACE_BITS) - 1)
        least |= np.arange(len(values), dtype=U64)
        size = 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        shift = span - size
        return (np.minimum(least[shift : shift + n], least[:n]) & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    # The least of a run is the lesser of those of two runs of a power of two; values are compared with their places.
    where, size = np.arange(len(values)), 1
    least = values >> U64(PLACE_BITS)
    while 2 * size <= span:
        left, right = least[:-size], least[size:]
        later = right < left
        where = np.where(later, where[size:], where[:-size])
        least = np.where(later, right, left)
        size *= 2
    shift = span - size
    return np.where(least[shift : shift + n] < least[:n], where[shift : shift + n], where[:n])


def _once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each key, and 1 where the key is there again: a route tells a bucket of a key only once."""
    _, firsts, counts = np.unique(keys, return_index=True, return_counts=True)
    return firsts, (counts > 1).astype(U64)


def repeated_spans(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text: str = "text", carry: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, starts and ends (byte spans to take out, in order) and kept (the other bytes). With `carry`,
    instead: carried (`carry` as it is) and left (the kept bytes as text, without those of broken characters).

    A byte is taken out if a string of `width` bytes that covers it also starts anywhere else: in another text or elsewhere in the
    same one. Every place of such a string is taken out. Strings never run from one text into the next. A null text is empty, a text
    below `width` bytes is kept whole, rows that are there twice are two places of their text, and an empty table gives none.
    Other columns are not read, but for `carry`.
    """
    carried = [] if carry is None else [carry.alias("carried")]
    total = blobs.text_size(docs, text)
    texts = blobs.routed(docs, total, id_col, text, *carried)
    by_route = lambda: texts.groupBy("route")  # noqa: E731  the same exchange each time
    each = 2 / (width - min(ANCHOR_BYTES, width) + 2)
    buckets = blobs.bucket_count(total * each)
    wide = blobs.bucket_count(total / 2)

    @thrifty
    def send_anchors(table: pa.Table) -> pa.Table:
        r = Route(table, width)
        which, again = _once(r.keys)
        return _dealt(table, r.keys[which], buckets, {"h": (r.keys[which], 6), "p": (which.astype(U64), _PLACE), "m": (again, 1)})

    @thrifty_pair
    def send_reaches(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows or not marks.num_rows:
            return _none(h=6, s=8, p=_PLACE, m=1)
        r = Route(table, width)
        which = np.flatnonzero(np.isin(r.keys, r.keys[blobs.column(marks, "p", _PLACE).astype(np.int64)]))
        reach = r.reach(which)
        firsts, again = _once(reach)
        which, reach = which[firsts], reach[firsts]
        return _dealt(table, r.keys[which], buckets, {"h": (r.keys[which], 6), "s": (reach, 8), "p": (which.astype(U64), _PLACE), "m": (again, 1)})

    @thrifty_pair
    def send_windows(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows or not marks.num_rows:
            return _none(h=8, p=_PLACE, m=1)
        r = Route(table, width)
        p, k = blobs.column(marks, "p", _PLACE).astype(np.int64), blobs.column(marks, "k", 2)
        places = r.windows(np.unique(p[k != WHOLE]))
        ids = r.ids(places)
        firsts, again = _once(ids)
        places, ids = places[firsts], ids[firsts]
        return _dealt(table, ids, wide, {"h": (ids, 8), "p": (places.astype(U64), _PLACE), "m": (again, 1)})

    anchors = by_route().applyInArrow(send_anchors, blobs.schema(h=6, p=_PLACE, m=1))
    live = anchors.groupBy("receiver").applyInArrow(_meet_anchors, blobs.schema(p=_PLACE))
    reaches = by_route().cogroup(live.groupBy("receiver")).applyInArrow(send_reaches, blobs.schema(h=6, s=8, p=_PLACE, m=1))
    kinds = reaches.groupBy("receiver").applyInArrow(_meet_reaches, blobs.schema(p=_PLACE, k=2))
    windows = by_route().cogroup(kinds.groupBy("receiver")).applyInArrow(send_windows, blobs.schema(h=8, p=_PLACE, m=1))
    # What is said of whole anchors goes to the routes along with the single windows.
    found = windows.groupBy("receiver").applyInArrow(_meet_windows, blobs.schema(p=_PLACE, k=2)).unionByName(kinds)

    @thrifty_pair
    def take_out(table: pa.Table, marks: pa.Table) -> pa.Table:
        r = Route(table, width) if marks.num_rows else None
        out = []
        if r:
            p, k = blobs.column(marks, "p", _PLACE).astype(np.int64), blobs.column(marks, "k", 2)
            reach = r.reach(np.arange(len(r.keys)))
            whole = np.isin(reach, reach[p[(k == WHOLE) | (k == MODEL)]])
            rest = r.windows(np.unique(p[k == REST]))
            rest = rest[np.isin(r.ids(rest), r.ids(p[k == WINDOW]))]
            starts = np.concatenate([r.windows(np.flatnonzero(whole)), rest])
            gone = covered(starts, width, len(r.data))
            ordered, data, offsets = r.table, r.data, r.offsets
        else:
            ordered = blobs.in_order(table)
            data, offsets = text_bytes(ordered.column("text").chunk(0) if ordered.num_rows else pa.array([], pa.string()))
            gone = np.zeros(len(data), bool)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
            out.append((edge[::2], edge[1::2], data[a:b][~gone[a:b]].tobytes() if len(edge) else data[a:b].tobytes()))
        if "carried" in ordered.column_names:
            # Decoded here, since a further step would keep a second Python worker beside this one.
            return pa.table({"carried": ordered.column("carried"), "left": pa.array([x[2].decode("utf-8", "ignore") for x in out], pa.string())})
        return pa.table(
            {
                "id": ordered.column("id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "starts": pa.array([x[0] for x in out], pa.list_(pa.int64())), "ends": pa.array([x[1] for x in out], pa.list_(pa.int64())),
                "kept": pa.array([x[2] for x in out], pa.binary()),
            }
        )

    schema = StructType.fromDDL("id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    if carried:
        schema = StructType([f for f in texts.schema.fields if f.name == "carried"]).add("left", "string")
    return by_route().cogroup(found.groupBy("receiver")).applyInArrow(take_out, schema)


def _none(**sizes: int) -> pa.Table:
    return blobs.deal(np.zeros(0, np.int32), 0, {name: (np.zeros(0, U64), size) for name, size in sizes.items()})


def _dealt(table: pa.Table, keys: np.ndarray, buckets: int, columns: dict) -> pa.Table:
    return blobs.deal(blobs.bucket_of(keys, buckets), table.column("route")[0].as_py(), columns)


def _answer(which: np.ndarray, table: pa.Table, columns: dict) -> pa.Table:
    """To the routes that sent these entries of the bucket."""
    return blobs.deal(blobs.senders(table, "h")[which], table.column("receiver")[0].as_py(), columns)


@thrifty
def _meet_anchors(table: pa.Table) -> pa.Table:
    live = repeated(blobs.column(table, "h", 6)) | (blobs.column(table, "m", 1) > 0)
    return _answer(live, table, {"p": (blobs.column(table, "p", _PLACE)[live], _PLACE)})


@thrifty
def _meet_reaches(table: pa.Table) -> pa.Table:
    h, s, p = blobs.column(table, "h", 6), blobs.column(table, "s", 8), blobs.column(table, "p", _PLACE)
    values, firsts, at = np.unique(s, return_index=True, return_inverse=True)
    many = np.bincount(at, blobs.column(table, "m", 1) > 0, len(values)) > 0
    whole = repeated(s) | many[at]
    # Buckets of one reach have nothing left to compare; in the others, one anchor of each whole reach stands for all.
    keys, reaches = np.unique(h[firsts], return_counts=True)
    open_keys = np.intersect1d(keys[reaches > 1], h[~whole])
    inside = np.isin(h, open_keys)
    kind = np.where(whole, WHOLE, REST).astype(U64)
    model = firsts[whole[firsts] & inside[firsts]]
    kind[model] = MODEL
    told = whole | inside
    return _answer(told, table, {"p": (p[told], _PLACE), "k": (kind[told], 2)})


@thrifty
def _meet_windows(table: pa.Table) -> pa.Table:
    found = repeated(blobs.column(table, "h", 8)) | (blobs.column(table, "m", 1) > 0)
    p = blobs.column(table, "p", _PLACE)[found]
    return _answer(found, table, {"p": (p, _PLACE), "k": (np.full(len(p), WINDOW, U64), 2)})


def digest(frame: DataFrame) -> DataFrame:
    """Counts and the hash of what is left, from `repeated_spans`."""
    return frame.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` (doc_id, text, n_chars, ...) with what is left of their texts; other columns stay. What is left of a character of which
    some bytes are taken out is taken out as well. A null text stays null."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    left = repeated_spans(docs, width, carry=F.struct(*others, F.col("text").isNull().alias("_no_text")))
    text = F.when(~F.col("carried._no_text"), F.col("left"))
    columns = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return left.select(*[columns[c].alias(c) if c in columns else F.col("carried").getField(c).alias(c) for c in docs.columns])
