"""Phrase collocations from a weighted graph of overlapping word runs.

Every place of a piece of text sends one record: the longest run of words that starts there, up to LONGEST of them or to the end of its piece. Runs of full length
are the edges of a de Bruijn graph, from the run of their first words to that of their last; shorter ones are corrections for the ends of pieces. Summed up,
they give the counts of all shorter phrases without reading text again: the count of a node is the weight of the edges that leave it plus the pieces that
end with it, and the same holds for its own first words. A node whose whole weight comes in by one edge, or leaves by one, lies on an unary path and is compacted
into that edge: wherever it stands the longer phrase does, so it is no phrase of its own.

Words are counted first. One of fewer occurrences than a phrase needs can be in no phrase, so it ends a run like the end of a piece does; the others are numbered.
A run is a row of bytes, `width` for each word, of which the first or last words can be cut off.

Runs are shuffled once, packed in sorted columns, to a bucket that depends on their first two words, so that all sums of first words are made in one pass over
a bucket in order. First words that are all very frequent are parted by the word that follows them, and their sums, marked as parts, meet in a second, small step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions.joins import spread_join
from gistmill.llm.blobs import bucket_count, bucket_of, column, deal, planes, schema
from gistmill.llm.words import BYTE_NUMBERS, LOWER, U64, Words, mix, run_hashes, slices, span_hashes, split_words, text_bytes
from gistmill.session import cut_lineage

#: Words of the longest phrase.
LONGEST = 5
#: Bytes that end a piece.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: Words are what lies between these bytes and spaces or tabs.
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
#: Numbered words that are sent to all tasks (16 bytes each); with more of them, runs hold hashes and no word ends a run.
SENT_WORDS = 1 << 21
#: A word with more than this share of all words is hot; there are at most as many hot words.
HOT_SHARES = 4096
#: Runs that a task sums up before it sends them.
BUFFER = 1 << 20
#: Groups of a language's phrases whose best are found apart, before the best of all.
RANK_SLICES = 32


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of words together with those of their languages."""
    numbers = mix(BYTE_NUMBERS ^ U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.maximum(mix(run_hashes(numbers[data], starts, ends) ^ mix(langs + U64(seed))), U64(1))  # 0 is no word


def _split(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    """Lower-cased bytes, words, the number of each word's piece, and a hash of language and word."""
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    words = split_words(data, offsets, WORD)
    text_of = words.text_of()
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ENDS[data], out=ends[1:])
    lang_data, lang_offsets = text_bytes(batch.column("lang"))
    langs = span_hashes(lang_data, lang_offsets[:-1], lang_offsets[1:])
    return data, words, ends[words.starts] + text_of, _hashes(data, words.starts, words.ends, langs[text_of], seed)


def _binary(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def _spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans, one after the other, and the offsets between them."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts - (ends - sizes), sizes)
    return data[at], np.concatenate([[0], ends]).astype(np.int32)


def _edge_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first and the last eight bytes of each span as numbers, filled up with zeros."""
    step, size = np.arange(8), len(data) - 1
    heads = data[np.minimum(starts[:, None] + step, size)] * (step < sizes[:, None])
    tails = data[np.maximum((starts + sizes)[:, None] - 8 + step, 0)] * (step >= 8 - sizes[:, None])
    return np.concatenate([heads, tails], 1).astype(np.uint8).view(U64)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (lang, word, n, hash) of `docs` (lang, text)."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, words, _, hashes = _split(batch, seed)
            if len(hashes):
                order = np.argsort(hashes, kind="stable")
                ranked, starts, sizes = hashes[order], words.starts[order], (words.ends - words.starts)[order]
                edges = _edge_bytes(data, starts, sizes)  # words of one hash are told apart
                new = (ranked[1:] != ranked[:-1]) | (sizes[1:] != sizes[:-1]) | (edges[1:] != edges[:-1]).any(1)
                first = np.flatnonzero(np.concatenate([[True], new]))
                found, bounds = _spans(data, starts[first], sizes[first])
                langs = batch.column("lang").take(pa.array(words.text_of()[order[first]]))
                yield pa.RecordBatch.from_arrays([langs, _binary(found, bounds, pa.string()), pa.array(np.diff(np.append(first, len(ranked))))], ["lang", "word", "n"])

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("word"))
            lang_data, lang_offsets = text_bytes(batch.column("lang"))
            found = _hashes(data, offsets[:-1], offsets[1:], span_hashes(lang_data, lang_offsets[:-1], lang_offsets[1:]), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], ["lang", "word", "n", "hash"])

    counts = docs.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(name, "lang string, word string, n long, hash long")


def vocabulary(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Words of `least` occurrences (lang, word, n, hash), words in all by language (lang, total), and the seed with which no other word has one of their hashes."""
    for seed in count():
        words = cut_lineage(word_counts(docs, seed))
        heavy = words.where(F.col("n") >= least)
        taken = heavy.select("hash").distinct()
        if words.join(taken, "hash", "left_semi").count() == taken.count():
            return heavy, words.groupBy("lang").agg(F.sum("n").alias("total")), seed


@dataclass
class Numbers:
    """Hashes of the frequent words in the order of their numbers (from 1), or none if there are too many; hot words by number, and their counts; the bytes of a word."""

    known: np.ndarray | None
    share: int
    width: int
    hot: np.ndarray = field(init=False)
    hot_counts: np.ndarray = field(init=False)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for rare ones; hashes themselves where words have no numbers."""
        if self.known is None:
            return hashes
        if not len(self.known):
            return np.zeros(len(hashes), U64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0).astype(U64)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """`width` bytes for each word."""
        return np.ascontiguousarray(ids.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - self.width :])

    def hot_count(self, ids: np.ndarray) -> np.ndarray:
        """The counts of hot words, 0 for others."""
        if not len(self.hot):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
        return np.where(self.hot[at] == ids, self.hot_counts[at], 0)


def numbered(heavy: DataFrame, total: int, sent: int = SENT_WORDS) -> Numbers:
    """total: occurrences of all words."""
    known, width, share = None, 8, max(1, total // HOT_SHARES)
    if heavy.count() <= sent:
        known = np.sort(heavy.select("hash").toArrow().column("hash").to_numpy().view(U64))  # 16 MB at most
        width = max(2, (len(known).bit_length() + 7) // 8)
    numbers = Numbers(known, share, width)
    hot = heavy.where(F.col("n") > share).select("hash", "n").toArrow()  # HOT_SHARES rows at most
    ids = numbers.of(hot.column("hash").to_numpy().view(U64))
    order = np.argsort(ids)
    numbers.hot, numbers.hot_counts = ids[order], hot.column("n").to_numpy()[order]
    return numbers


def _sorted(words: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order by words from the first on, and for each number of first words, where in that order they are others than before."""
    order = np.lexsort([plane for own in words[::-1] for plane in planes(own, width)])
    found, new = [], np.arange(words.shape[1]) == 0
    for own in words:
        ranked = own[order]
        new = new.copy()
        new[1:] |= ranked[1:] != ranked[:-1]
        found.append(new)
    return order, found


def _places(words: np.ndarray, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The place (64 bits) of each run, and a bit for each number of first words that lie in several places."""
    place = mix(mix(words[0] * U64(3)) + words[1])
    least, parted = np.minimum(numbers.hot_count(words[0]), numbers.hot_count(words[1])), np.zeros(len(place), np.int64)
    for size in range(2, len(words)):
        hot = np.flatnonzero((least > 0) & (words[size - 1] > 0))
        parted[hot] |= 1 << size
        hot = hot[words[size][hot] > 0]
        parts = (-(-least[hot] // numbers.share)).astype(U64)
        place[hot] = mix(place[hot] + U64(1) + mix(words[size][hot]) % parts)
        least = np.minimum(least, numbers.hot_count(words[size]))
    return place, parted


def _columns(longest: int, width: int) -> dict[str, int]:
    """Bytes of the packed columns: words by letter, f, bits of parted first words."""
    return {chr(97 + k) + "_": width for k in range(longest)} | {"f": 4, "parted": 2 * (longest // 16 + 1)}


def runs(docs: DataFrame, numbers: Numbers, seed: int, buckets: int, longest: int = LONGEST) -> DataFrame:
    """The longest run from each place of a word that others follow, summed up for a buffer; a row for each buffer and bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    sizes = _columns(longest, numbers.width)

    def pack(held: list[np.ndarray], numbers: Numbers) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(held, 1)
        order, new = _sorted(words, numbers.width)
        first = np.flatnonzero(new[-1])
        f, words = np.diff(np.append(first, len(order))), words[:, order[first]]
        place, parted = _places(words, numbers)
        columns = dict(zip(sizes, [*words, f, parted], strict=True))
        yield from deal(bucket_of(place, buckets), 0, {k: (v, sizes[k]) for k, v in columns.items()}).to_batches()

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = shared.value, [], 0
        for batch in slices(batches):
            _, words, piece, hashes = _split(batch, seed)
            ids = numbers.of(hashes)
            breaks = piece[1:] != piece[:-1]
            if numbers.known is not None:
                breaks |= (ids[1:] == 0) | (ids[:-1] == 0)
            stops = np.append(np.flatnonzero(breaks) + 1, len(ids))
            left = np.repeat(stops, np.diff(np.concatenate([[0], stops]))) - np.arange(len(ids))
            starts = np.flatnonzero(left >= 2)
            if not len(starts):
                continue
            ids, left = np.concatenate([ids, np.zeros(longest, U64)]), left[starts]
            held.append(np.stack([np.where(left > k, ids[starts + k], U64(0)) for k in range(longest)]))
            size += len(starts)
            if size >= BUFFER:
                yield from pack(held, numbers)
                held, size = [], 0
        if held:
            yield from pack(held, numbers)

    return docs.mapInArrow(send, schema(**sizes))


def frequent(sent: DataFrame, width: int, least: int, longest: int = LONGEST) -> DataFrame:
    """Rows (run, f) of all runs of 2 to `longest` words that occur `least` times, from the longest runs at all places."""
    sizes = _columns(longest, width)

    def meet(table: pa.Table) -> pa.Table:
        *words, f, parted = (column(table, name, size) for name, size in sizes.items())
        words = np.stack(words)
        order, new = _sorted(words, width)
        words, f, parted = words[:, order], f[order].astype(np.int64), parted[order].astype(np.int64)
        rows = np.ascontiguousarray(words.T.astype(">u8")).view(np.uint8).reshape(len(order), longest, 8)[:, :, 8 - width :].reshape(len(order), longest * width)
        out = []
        for size in range(2, longest + 1):
            first = np.flatnonzero(new[size - 1])
            sums = np.add.reduceat(f, first)
            # Shorter runs, the ends of pieces, have no word here.
            kept = (words[size - 1, first] > 0) & ((sums >= least) | (parted[first] >> size & 1 > 0))
            found = np.ascontiguousarray(rows[first[kept], : size * width])
            out.append(pa.table({"run": _binary(found, np.arange(len(found) + 1, dtype=np.int32) * (size * width), pa.binary()), "f": sums[kept]}))
        return pa.concat_tables(out)

    found = sent.groupBy("receiver").applyInArrow(meet, "run binary, f long")
    return cut_lineage(found.groupBy("run").agg(F.sum("f").alias("f")).where(F.col("f") >= least))


def compacted(nodes: DataFrame, width: int) -> DataFrame:
    """The nodes that no edge carries as a whole: those that are not within a longer run as often as they are there."""
    longer = nodes.where(F.length("run") > 2 * width)
    inside = F.array(F.expr(f"substring(run, 1, length(run) - {width})"), F.expr(f"substring(run, {width + 1})"))
    carried = longer.select(F.explode(inside).alias("run"), "f").distinct()
    return nodes.join(carried, ["run", "f"], "left_anti")


def coded(heavy: DataFrame, numbers: Numbers) -> DataFrame:
    """The words with the bytes that stand for them in runs: (lang, word, n, run)."""
    shared = heavy.sparkSession.sparkContext.broadcast(numbers)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.rows(shared.value.of(batch.column("hash").to_numpy().view(U64)))
            bounds = np.arange(len(rows) + 1, dtype=np.int32) * shared.value.width
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), batch.column("n"), _binary(rows, bounds, pa.binary())], ["lang", "word", "n", "run"])

    return heavy.select("lang", "word", "n", "hash").mapInArrow(code, "lang string, word string, n long, run binary")


def scored(kept: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """The lowest-scoring cut of each phrase of `kept` (run, a, lang, n): its columns, score, k, l, r. counts: (run, f) of phrases and words."""
    size = (F.length("run") / width).cast("int")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.expr(f"substring(run, 1, k * {width})"), "right": F.expr(f"substring(run, k * {width} + 1)")})
    cuts = cuts.join(counts.select(F.col("run").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("run").alias("right"), F.col("f").alias("r")), "right")
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000 * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    best = cuts.withColumn("score", score).groupBy("run", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("run", "lang", "a", "n", "best.*")


def spelled(found: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """Adds `phrase`, the words of `run` joined by spaces."""
    size = (F.length("run") / width).cast("int")
    rows = found.withColumns({"at": F.explode(F.sequence(F.lit(0), size - 1)), "size": size})
    rows = rows.withColumn("one", F.expr(f"substring(run, at * {width} + 1, {width})")).join(words.select(F.col("run").alias("one"), "word"), "one")
    rows = rows.groupBy(*found.columns, "size").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    return rows.where(F.size("words") == F.col("size")).withColumn("phrase", F.array_join("words.word", " ")).drop("words", "size")


def phrases(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, lang: str = "lang", text: str = "text", sent: int = SENT_WORDS) -> DataFrame:
    """The best `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as lower case. A phrase occurs `least` times or more within pieces (a), and no longer one stands wherever it does. It is cut where
    floor(1000 * a * n / (l * r)) is lowest, ties at the first place: l and r are the counts of both parts, n that of all words of the language. Phrases rank by score and a, highest
    first, then by their bytes. A null language is `und`, a null text empty; rows that are there twice count twice; an empty table gives none; other
    columns are not read. All counts are exact at any size: the number of frequent words (`sent`) only decides whether words are numbered.
    """
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    heavy, totals, seed = vocabulary(given, least)
    numbers = numbered(heavy, totals.agg(F.sum("total")).first()[0] or 0, sent)
    width = numbers.width
    buckets = bucket_count(heavy.agg(F.sum("n")).first()[0] or 0)
    nodes = frequent(runs(given, numbers, seed, buckets, longest), width, least, longest)
    words = coded(heavy, numbers)
    counts = nodes.union(words.select("run", F.col("n").alias("f")))
    kept = compacted(nodes, width).withColumn("one", F.expr(f"substring(run, 1, {width})")).join(words.select(F.col("run").alias("one"), "lang"), "one")
    kept = spread_join(kept.select("run", F.col("f").alias("a"), "lang"), totals.withColumnRenamed("total", "n"), ["lang"], "run")
    found = scored(kept, counts, width)
    # First the best of slices of a language, ties whole, so that no task ranks a whole language; only these need their words.
    apart = Window.partitionBy("lang", F.pmod(F.xxhash64("run"), F.lit(RANK_SLICES))).orderBy(F.desc("score"), F.desc("a"))
    found = spelled(found.withColumn("rank", F.rank().over(apart)).where(F.col("rank") <= top).drop("rank"), words, width)
    whole = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
