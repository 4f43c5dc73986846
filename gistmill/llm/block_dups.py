"""Passages that an earlier document has too, found by fixed-block anchors.

A window of WINDOW words holds one whole block of BLOCK = (WINDOW + 1) / 2 words of any cutting of its text into blocks from
the text's start. So these non-overlapping blocks are the index, and every run of BLOCK words of every text probes it. Hits are
extended: all windows that hold a hit are compared in full with those of the other texts, and repeated windows that touch
or overlap form the maximal repeats that are taken out. Comparing by window takes one entry for each place, however many
texts share a passage, where comparing hits by pairs would take one for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blobs
from gistmill.llm.words import PLAIN_WORD, U64, covered, gram_hashes, join_words, repeated, runs, span_hashes, split_words, text_bytes

WINDOW = 13
_PLACE = 4
AGAIN, ALIGNED = 1, 2
_SIGN = U64(1 << 63)


class Route:
    def __init__(self, table: pa.Table, window: int):
        self.table = blobs.in_order(table)
        self.block = (window + 1) // 2
        self.data, offsets = text_bytes(self.table.column("text").chunk(0) if self.table.num_rows else pa.array([], pa.string()))
        self.words = split_words(self.data, offsets, PLAIN_WORD)
        hashes = span_hashes(self.data, self.words.starts, self.words.ends)
        left = self.words.left()
        self.grams, self.windows = gram_hashes(hashes, self.block), gram_hashes(hashes, window)
        self.blocks_at = np.flatnonzero(left[: len(self.grams)] >= self.block)
        self.windows_at = np.flatnonzero(left[: len(self.windows)] >= window)
        ids = self.table.column("id")
        # In an order that unsigned numbers keep; a null id comes after all others.
        numbers = ids.fill_null(0).to_numpy().astype(np.int64).view(U64) ^ _SIGN
        numbers[ids.is_null().to_numpy()] = U64(0xFFFFFFFFFFFFFFFF)
        self.id_of = numbers[self.words.text_of()]
        self.first_of = np.repeat(self.words.offsets[:-1], self.words.counts)


def earlier_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, starts and ends (runs of words to take out), kept (the other words).

    A word is taken out if a window of `window` words (odd) that covers it also starts in a row with a smaller id. Windows are judged
    on the input. Words are runs of anything but ASCII white space, compared as they are; kept words are joined by one space. A null or
    empty text has no words, a text of fewer words than a window is kept, rows of one id don't take anything from each other, and a
    null id counts as greater than all others. An empty table gives none. Other columns are not read.
    """
    if window % 2 == 0:
        raise ValueError("the window must be an odd number of words")
    total = blobs.text_size(docs, text)
    texts = blobs.routed(docs, total, id_col, text)
    by_route = lambda: texts.groupBy("route")  # noqa: E731  the same exchange each time
    buckets = blobs.bucket_count(total / 6)
    wide = blobs.bucket_count(total / 15)

    def send_blocks(table: pa.Table) -> pa.Table:
        r = Route(table, window)
        keys = r.grams[r.blocks_at]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        at = r.blocks_at[order]
        aligned = (at - r.first_of[at]) % r.block == 0
        told = np.where(np.diff(np.append(heads, len(keys))) > 1, AGAIN, 0) + (np.logical_or.reduceat(aligned, heads) * ALIGNED if len(heads) else 0)
        sent = np.argsort(at[heads])  # places rise, so their upper bytes take no room
        keys, at, told = ranked[heads][sent], at[heads][sent], np.asarray(told)[sent]
        return _dealt(table, keys, buckets, {"p": (at.astype(U64), _PLACE), "h": (keys, 3), "m": (told.astype(U64), 1)})

    def meet_blocks(table: pa.Table) -> pa.Table:
        h, m = blobs.column(table, "h", 3).astype(np.int64), blobs.column(table, "m", 1)
        index = np.zeros(1 << 24, bool)
        index[h[m & U64(ALIGNED) > 0]] = True
        hit = np.flatnonzero(index[h])
        hit = hit[repeated(h[hit]) | (m[hit] & U64(AGAIN) > 0)]
        return _answer(hit, table)

    def send_windows(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows or not marks.num_rows:
            return blobs.deal(np.zeros(0, np.int32), 0, {"p": (np.zeros(0, U64), _PLACE), "h": (np.zeros(0, U64), 7), "d": (np.zeros(0, U64), 8)})
        r = Route(table, window)
        hits = r.blocks_at[np.isin(r.grams[r.blocks_at], r.grams[blobs.column(marks, "p", _PLACE).astype(np.int64)])]
        reach = window - r.block
        near = covered(np.maximum(hits - reach, 0), np.minimum(hits, reach) + 1, len(r.words.starts))
        at = r.windows_at[near[r.windows_at]]
        _, firsts = np.unique(r.windows[at], return_index=True)
        at = at[np.sort(firsts)]  # rows are in the order of ids: the first place has the least one
        keys = r.windows[at]
        return _dealt(table, keys, wide, {"p": (at.astype(U64), _PLACE), "h": (keys, 7), "d": (r.id_of[at], 8)})

    def take_out(table: pa.Table, marks: pa.Table) -> pa.Table:
        r = Route(table, window)
        keys = r.windows[r.windows_at]
        _, firsts, at = np.unique(keys, return_index=True, return_inverse=True)
        gone = r.id_of[r.windows_at] > r.id_of[r.windows_at[firsts]][at]
        if marks.num_rows:
            gone |= np.isin(keys, r.windows[blobs.column(marks, "p", _PLACE).astype(np.int64)])
        out = covered(r.windows_at[gone], window, len(r.words.starts))
        starts, ends = runs(out, r.words.offsets)
        removed = np.bincount(r.words.text_of()[out], minlength=table.num_rows)
        return pa.table(
            {"id": r.table.column("id"), "n_words": pa.array(r.words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "starts": starts, "ends": ends, "kept": join_words(r.data, r.words, ~out).cast(pa.string())}
        )

    blocks = by_route().applyInArrow(send_blocks, blobs.schema(p=_PLACE, h=3, m=1))
    hits = blocks.groupBy("receiver").applyInArrow(meet_blocks, blobs.schema(p=_PLACE))
    windows = by_route().cogroup(hits.groupBy("receiver")).applyInArrow(send_windows, blobs.schema(p=_PLACE, h=7, d=8))
    later = windows.groupBy("receiver").applyInArrow(_meet_windows, blobs.schema(p=_PLACE))
    return by_route().cogroup(later.groupBy("receiver")).applyInArrow(take_out, "id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept string")


def _dealt(table: pa.Table, keys: np.ndarray, buckets: int, columns: dict) -> pa.Table:
    return blobs.deal(blobs.bucket_of(keys, buckets), table.column("route")[0].as_py(), columns)


def _answer(which: np.ndarray, table: pa.Table) -> pa.Table:
    return blobs.deal(blobs.senders(table, "p")[which], table.column("receiver")[0].as_py(), {"p": (blobs.column(table, "p", _PLACE)[which], _PLACE)})


def _meet_windows(table: pa.Table) -> pa.Table:
    h, d = blobs.column(table, "h", 7), blobs.column(table, "d", 8)
    order = np.lexsort((d, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    least = d[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return _answer(order[d[order] > least], table)


def digest(frame: DataFrame) -> DataFrame:
    """Counts and the hash of what is left, from `earlier_passages`."""
    return frame.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
