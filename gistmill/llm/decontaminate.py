"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton holds every run of words of every item. A text is streamed through it: each word moves to the state of the longest
run that ends here and that some item has, and the length of that run is tracked. Runs of WINDOW words or more are hits, and so are whole items
that are shorter. Most words of most texts can't be in such a run: a text goes through the automaton only where several words on end are
those of an item, which is looked up for all words at once.

Items are dealt into blocks of about BLOCK_BYTES of text, each of which becomes one automaton. Items of up to SENT_BYTES of text in all, which is counted first,
are sent to all tasks, and texts pass their few automata one after the other in one stage. Beyond that nothing that grows with the items is sent: texts meet the
blocks by a join. A window, or the whole shorter item, has a part of as many words as the shortest item (`window` at most), and the least hash of LOOKUP
neighbouring words in that part, its anchor, is the same on both sides. Anchors of the items are rows; a table of 2^27 bits says for a text's words
which can be in one, and each anchor of a text takes with it the words around it that a window could reach. They are streamed through the automaton of each block
that has the anchor. Either way gives the same rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gistmill.llm.blobs import text_size
from gistmill.llm.words import ALNUM_WORD, LOWER, U64, gram_hashes, mix, slices, span_hashes, split_words, text_bytes

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: Text of items whose automata are sent to all tasks: four at most, of some 50 MB each in a worker.
SENT_BYTES = 1 << 21
#: Words of an item that are one part where texts meet items by a join; parts overlap by a window less one word.
PART_WORDS = 1 << 14
#: Bits of the table of anchors' words that is sent to all tasks (16 MB at any number of items).
TABLE_BITS = 27
#: Tasks that share the words met by one block or one anchor.
SALTS = 8
#: Neighbouring words that are looked up together before a text goes through the automaton.
LOOKUP = 4


class Automaton:
    """States of the runs of words of all items; state 0 is the empty run."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window, self.step, self.link, self.longest = window, [{}], [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, set[str]] = {}  # by the state of a window
        self.short: dict[int, list[tuple[int, str]]] = {}  # by the state of a whole shorter item: its length, its name
        for name, words in items:
            for state, length, _ in self.stream(words):
                if length >= window:
                    self.items.setdefault(self.shortened(state), set()).add(name)
                elif length == len(words):
                    self.short.setdefault(state, []).append((length, name))

    def _extend(self, last: int, word: int) -> int:
        step, link, longest = self.step, self.link, self.longest
        if word in step[last]:
            old = step[last][word]
            return old if longest[old] == longest[last] + 1 else self._split(last, word, old)
        new = self._state(longest[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at != -1:
            old = step[at][word]
            link[new] = old if longest[old] == longest[at] + 1 else self._split(at, word, old)
        return new

    def _split(self, at: int, word: int, old: int) -> int:
        """A state for the shorter runs of `old`, from `at` and its suffixes."""
        new = self._state(self.longest[at] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = new
        while at != -1 and self.step[at].get(word) == old:
            self.step[at][word] = new
            at = self.link[at]
        return new

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.step) - 1

    def stream(self, words: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """State and length of the longest run that ends at each word, and the word's place."""
        state, length = 0, 0
        step, link, longest = self.step, self.link, self.longest
        for place, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                length = longest[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            else:
                length = 0
            yield state, length, place

    def shortened(self, state: int) -> int:
        """The state of the last `window` words of a run at least as long."""
        while self.longest[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, Iterable[str]]]:
        """Start, end and items of each window that occurs."""
        for state, length, place in self.stream(words):
            if length >= self.window:
                yield place + 1 - self.window, place + 1, self.items.get(self.shortened(state), ())
            at = state if self.short else 0
            while at > 0:
                for size, name in self.short.get(at, ()):
                    if size <= length:
                        yield place + 1 - size, place + 1, (name,)
                at = self.link[at]


def _hashed(batch: pa.RecordBatch | pa.Table, column: str):
    data, offsets = text_bytes(batch.column(column) if isinstance(batch, pa.RecordBatch) else batch.column(column).combine_chunks())
    words = split_words(data, offsets, ALNUM_WORD)
    return data, offsets, words, span_hashes(LOWER[data], words.starts, words.ends)


def block_count(total: int) -> int:
    """Blocks of items with so many bytes of text."""
    blocks = math.ceil(total / BLOCK_BYTES)
    return 2 * blocks if blocks > 1 else 1


def automata(items: DataFrame, blocks: int, window: int = WINDOW, id_col: str = "item_id", text: str = "text") -> list[bytes]:
    """Pickled (automaton, lookup table, words looked up together), one for each block of items; for items of at most SENT_BYTES."""
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(blocks)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        _, _, words, hashes = _hashed(table, "text")
        names = table.column("item").to_pylist()
        lists = [(names[k], hashes[a:b].tolist()) for k, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)) if b > a]
        size = min([LOOKUP, *(len(x) for _, x in lists)])
        grams = gram_hashes(hashes, size)
        ok = words.left()[: len(grams)] >= size
        out = pickle.dumps((Automaton(lists, window), np.unique(grams[ok]), size)) if lists else None
        return pa.table({"automaton": pa.array([out], pa.binary())})

    built = items.select(block.alias("block"), F.col(id_col).cast("string").alias("item"), F.col(text).alias("text")).groupBy("block").applyInArrow(build, "automaton binary")
    return [bytes(r["automaton"]) for r in built.where("automaton is not null").toLocalIterator()]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_share: float = 1.0, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", carry: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, items (names of items with a window in the text, sorted), starts and ends (spans of bytes
    to take out), kept (the text without them; null if over `most_share` of its words were hit), and `carry` as it is.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as lower case. A window is `window` words of an item, or all words of
    an item that has fewer. Words that lie in any place of a window are hit. A null or empty text has no words, is not hit and stays as it is; so do
    all texts if there are no items. A null item has no windows; a null item id doesn't hit by name, its words do. Rows and items that are
    there twice are judged alike. Other columns are not read, but for `carry`.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), *([] if carry is None else [carry.alias("carried")]))
    carried = [f for f in frame.schema.fields if f.name == "carried"]
    total = text_size(items, item_text)
    if total > SENT_BYTES:
        met = spans_met(frame.select("text"), items, block_count(total), window, item_col, item_text)
        frame = frame.withColumn("digest", F.md5(F.col("text").cast("binary"))).join(met, "digest", "left").drop("digest")
        return frame.mapInArrow(_cut(most_share), _cut_schema(carried))
    frame = frame.withColumns({"starts": F.array().cast("array<long>"), "ends": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    steps = [_pass(spark.sparkContext.broadcast(packed)) for packed in automata(items, block_count(total), window, item_col, item_text)]
    return frame.mapInArrow(_in_one([*steps, _cut(most_share)]), _cut_schema(carried))


def _cut_schema(carried: list[StructField]) -> StructType:
    return StructType(StructType.fromDDL("id long, n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>, kept string").fields + carried)


def spans_met(texts: DataFrame, items: DataFrame, blocks: int, window: int, id_col: str, text: str) -> DataFrame:
    """Rows (digest of a text, starts and ends of spans of words, items), one for each different text that is hit. Items and texts meet by a join on anchors."""
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int")
    parts = items.select(F.col(id_col).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(_parts(window), "item string, words array<long>").withColumn("block", block)
    width = min(window, parts.agg(F.min(F.size("words"))).first()[0] or window)
    size = min(LOOKUP, width)
    listed = parts.select("block", "words").mapInArrow(_part_anchors(size, width), "block int, anchors array<long>, grams array<long>")
    slot = F.col("gram").bitwiseAND((1 << TABLE_BITS) - 1)
    bits = listed.select(F.explode("grams").alias("gram")).groupBy(F.shiftright(slot, 3).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(gram & 7 as int))")).alias("bits"))
    rows = bits.toArrow()  # 2^24 bytes of the table at most, at any number of items
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    table[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(table)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = listed.select("block", F.explode("anchors").alias("anchor")).distinct().select("block", "anchor", salt)
    around = texts.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").mapInArrow(_text_anchors(sent, size, width, window), "digest string, at long, place long, anchor long, words array<long>")
    # Copies of a text are met once.
    around = around.dropDuplicates(["digest", "at"]).withColumn("salt", F.pmod(F.xxhash64("digest", "at"), F.lit(SALTS)).cast("int"))
    nothing = F.lit(None)
    met = around.join(known, ["anchor", "salt"]).select("block", "salt", F.lit(1).alias("kind"), nothing.cast("string").alias("item"), "digest", "place", "words")
    both = parts.select("block", salt, F.lit(0).alias("kind"), "item", nothing.cast("string").alias("digest"), nothing.cast("long").alias("place"), "words").union(met)
    # The items of a block come before what it meets, which is streamed.
    hits = both.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(_stream(window), "digest string, start long, end long, items array<string>")
    found = hits.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return found.select("digest", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), "items")


def _lists(values: np.ndarray, firsts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The runs of 64-bit numbers as lists."""
    sizes = stops - firsts
    ends = np.cumsum(sizes)
    at = np.repeat(firsts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[at].view(np.int64)))


def _parts(window: int):
    """Words of items, as hashes, in overlapping parts; items without words give none."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, words, hashes = _hashed(batch, "text")
            step = PART_WORDS - window + 1
            each = np.where(words.counts > 0, np.maximum(1, -(-(words.counts - window + 1) // step)), 0)
            owner = np.repeat(np.arange(len(each)), each)
            firsts = words.offsets[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), _lists(hashes, firsts, np.minimum(firsts + PART_WORDS, words.offsets[owner + 1]))], ["item", "words"])

    return cut


def _anchors(hashes: np.ndarray, offsets: np.ndarray, size: int, width: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least gram in each run of `width` words of one text, and the grams. With a table, of runs whose grams may all be there."""
    grams = gram_hashes(hashes, size)
    left = (np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(hashes)))[: len(grams)]
    ok = left >= size
    if table is not None:
        slot = (grams & U64((1 << TABLE_BITS) - 1)).astype(np.int64)
        ok &= (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) > 0
    many = width - size + 1
    sums = np.concatenate([[0], np.cumsum(ok)])
    heads = np.flatnonzero((sums[many:] - sums[:-many] == many) & (left[: max(0, len(grams) - many + 1)] >= width)) if len(grams) >= many else np.zeros(0, np.int64)
    return np.unique(heads + mix(grams)[heads[:, None] + np.arange(many)].argmin(1)), grams


def _part_anchors(size: int, width: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            hashes = words.flatten().to_numpy().astype(np.int64).view(U64)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
            places, grams = _anchors(hashes, offsets, size, width)
            bounds = np.searchsorted(places, offsets)
            ends = np.maximum(offsets[:-1], offsets[1:] - size + 1)
            yield pa.RecordBatch.from_arrays([batch.column("block"), _lists(grams[places], bounds[:-1], bounds[1:]), _lists(grams, offsets[:-1], ends)], ["block", "anchors", "grams"])

    return find


def _text_anchors(sent, size: int, width: int, window: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches):
            _, _, words, hashes = _hashed(batch, "text")
            places, grams = _anchors(hashes, words.offsets, size, width, table)
            owner = np.searchsorted(words.offsets, places, "right") - 1
            firsts, stops = np.maximum(words.offsets[owner], places + size - window), np.minimum(words.offsets[owner + 1], places + window)
            columns = [batch.column("digest").take(pa.array(owner)), *(pa.array(x - words.offsets[owner], pa.int64()) for x in (places, firsts)), pa.array(grams[places].view(np.int64)), _lists(hashes, firsts, stops)]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "at", "place", "anchor", "words"])

    return find


def _stream(window: int):
    """Hits of rows (kind 1) in the automaton of the items (kind 0) before them."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, items, automaton = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                words = [w & 0xFFFFFFFFFFFFFFFF for w in row["words"]]
                if (row["block"], row["salt"]) != group:
                    group, items, automaton = (row["block"], row["salt"]), [], None
                if not row["kind"]:
                    items.append((row["item"], words))
                    continue
                automaton = automaton or Automaton(items, window)
                for first, stop, names in automaton.hits(words):
                    out.append((row["digest"], row["place"] + first, row["place"] + stop, [n for n in names if n is not None]))
            if out:
                columns = zip(*out, strict=True)
                types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["digest", "start", "end", "items"])

    return scan


def without_items(docs: DataFrame, items: DataFrame, most_share: float, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` (doc_id, text, n_chars, ...) without the hit words of their texts; other columns stay. Rows of which more than `most_share`
    is hit are left out; a null text stays null."""
    found = decontaminate(docs, items, window, most_share, carry=F.struct(*[c for c in docs.columns if c != "text"]))
    found = found.where("kept is not null or n_hit = 0")
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return found.select(*[columns[c].alias(c) if c in columns else F.col("carried").getField(c).alias(c) for c in docs.columns])


def _carried(batch: pa.RecordBatch) -> tuple[list[pa.Array], list[str]]:
    return ([batch.column("carried")], ["carried"]) if "carried" in batch.schema.names else ([], [])


def _pass(sent):
    """Adds the hits of one automaton, as spans of words, to what each row has."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, lookup, size = pickle.loads(sent.value)
        low = np.zeros(1 << 20, bool)
        low[(lookup & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in slices(batches):
            _, _, words, hashes = _hashed(batch, "text")
            grams = gram_hashes(hashes, size)
            at = np.flatnonzero(words.left()[: len(grams)] >= size)
            at = at[low[(grams[at] & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            at = at[np.isin(grams[at], lookup)]
            starts, ends, items = (batch.column(c).to_pylist() for c in ("starts", "ends", "items"))
            if len(at):
                # Looked-up words on end, within one text.
                owner = np.searchsorted(words.offsets, at, "right") - 1
                new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner) > 0)])
                heads = np.flatnonzero(new)
                for a, b, k in zip(at[heads], at[np.append(heads[1:], len(at)) - 1] + size, owner[heads], strict=True):
                    base = words.offsets[k]
                    for first, stop, names in automaton.hits(hashes[a:b].tolist()):
                        starts[k].append(int(a - base) + first)
                        ends[k].append(int(a - base) + stop)
                        items[k].extend(n for n in names if n is not None)
                for k in np.unique(owner):
                    items[k] = sorted(set(items[k]))
                    starts[k], ends[k] = _merged(starts[k], ends[k])
            lists = [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            same, name = _carried(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *lists, *same], ["id", "text", "starts", "ends", "items", *name])

    return scan


def _in_one(steps: list):
    """One step for all: as steps of Spark, each would keep a Python worker of its own beside the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def _merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The spans, joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def _cut(most_share: float):
    """Counts, spans of bytes and what is left, from spans of words."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            words = split_words(data, offsets, ALNUM_WORD)
            kept, (starts, ends, items) = batch.column("text").to_pylist(), ([x or [] for x in batch.column(c).to_pylist()] for c in ("starts", "ends", "items"))
            n_hit = np.zeros(batch.num_rows, np.int64)
            for k, spans in enumerate(starts):
                if not spans:
                    continue
                base = words.offsets[k]
                spans, ends[k] = _merged(spans, ends[k])
                n_hit[k] = sum(ends[k]) - sum(spans)
                starts[k] = [int(words.starts[base + a] - offsets[k]) for a in spans]
                ends[k] = [int(words.ends[base + b - 1] - offsets[k]) for b in ends[k]]
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                pieces = [raw[a:b] for a, b in zip([0, *ends[k]], [*starts[k], len(raw)], strict=True)]
                kept[k] = b"".join(pieces).decode() if n_hit[k] <= most_share * words.counts[k] else None
            lists = [pa.array(items, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.string())]
            same, name = _carried(batch)
            columns = [batch.column("id"), pa.array(words.counts, pa.int64()), pa.array(n_hit), *lists, *same]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "items", "starts", "ends", "kept", *name])

    return cut


def digest(frame: DataFrame) -> DataFrame:
    """Counts and the hash of the items' names, from `decontaminate`."""
    return frame.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
