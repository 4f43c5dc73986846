"""Near duplicates: b-bit MinHash signatures joined on Hamming distance through several indexes, then compared in full.

A signature is a row of symbols of 16 bits, each from the least value of one hash function over a text's word shingles. Two
texts differ in a symbol with chance 1 - J. The first 30 symbols are cut into CHUNKS of CHUNK symbols. Two signatures that
differ in fewer than CHUNKS * (ERRORS + 1) of them have a chunk with at most ERRORS errors (pigeonhole), and so agree in CHUNK - ERRORS
symbols of it: every choice of as many symbols of a chunk is a key, and such pairs share one. So all pairs of up to 17 errors of 30
are found; two texts of J = 0.8 miss all six chunks with chance 4e-8.

Texts with equal sets are one class and are never paired. A group of classes that share a key is first linked to its least
member. Once these links are confirmed on the full sets and made into components, only pairs of different components are left:
those that longer signatures allow, each at the first key that it shares. They hold families together, and the full sets of
a family are compared. Pairs are never rows, so a group of thousands of near copies costs rows in proportion. In a group of more than HOT members,
those outside its most frequent label meet all members, in blocks that are dealt over tasks: a pair of two labels has such a member, so the
chances are the same in groups of any size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import blobs
from gistmill.llm.components import components
from gistmill.llm.words import LOWER, PLAIN_WORD, U64, give_back, gram_hashes, mix, repeated, slices, span_hashes, split_words, text_bytes, thrifty, thrifty_pair
from gistmill.session import FILE_BYTES, few_files, hold, scratch_path

CHUNKS, CHUNK, ERRORS = 6, 5, 2
CHOICES = list(itertools.combinations(range(CHUNK), CHUNK - ERRORS))
#: Symbols of a signature; those beyond the chunks sharpen the distance.
SYMBOLS = 48
HOT = 4096
#: Texts whose full sets meet in a task, or half of them.
TILE = 1024
#: Symbols of one byte in the longer signatures of candidates.
SKETCH = 256
#: Classes whose keys are made at a time; more of them where there are so many that a bucket would get less than four keys from a route.
ROUTE_CLASSES = 1_000
#: Rows of the input for each file of the table of classes.
FILE_ROWS = 10_000
_PLACE = 4

_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SKETCH_SEEDS = mix(np.arange(1001, SKETCH + 1001, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
#: The first choice whose symbols all agree, by the bits of those that agree.
_FIRST_CHOICE = np.array([next((n for n, c in enumerate(CHOICES) if all(code >> k & 1 for k in c)), len(CHOICES)) for code in range(1 << CHUNK)])


def most_errors(similarity: float, symbols: int = SYMBOLS) -> int:
    """Errors in so many symbols that two texts of this similarity exceed with chance 1e-6 at most."""
    p, tail = 1 - similarity, 0.0
    for k in range(symbols, -1, -1):
        tail += math.comb(symbols, k) * p**k * (1 - p) ** (symbols - k)
        if tail > 1e-6:
            return k
    return symbols


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and n + 1 offsets. A text with fewer words has one, of all its words."""
    words = split_words(data, offsets, PLAIN_WORD)
    hashes = span_hashes(LOWER[data], words.starts, words.ends)
    counts, text_of = words.counts, words.text_of()
    grams = gram_hashes(hashes, size)
    at = np.flatnonzero(words.left()[: len(grams)] >= size)
    values, owner = grams[at], text_of[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = mix(counts[short].astype(U64))
        for k in range(size - 1):
            inside = counts[short] > k
            whole[inside] = mix(whole[inside] * U64(0xC2B2AE3D27D4EB4F) + hashes[words.offsets[short[inside]] + k])
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
    salt = mix(np.arange(len(counts), dtype=U64) + U64(1))
    _, firsts = np.unique(values ^ salt[owner], return_index=True)
    firsts = firsts[np.argsort(owner[firsts], kind="stable")]
    return values[firsts], np.searchsorted(owner[firsts], np.arange(len(counts) + 1))


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n (shingles), s1 and s2 (a hash of the set), sig (null without shingles)."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingles(*text_bytes(batch.column("text")), size)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            heads = offsets[:-1][full]
            out = np.zeros((batch.num_rows, SYMBOLS), np.uint16)
            sums = np.zeros((2, batch.num_rows), np.int64)
            if len(values):
                for k, seed in enumerate(_SEEDS):
                    out[full, k] = mix(np.minimum.reduceat((values ^ seed) * seed, heads) + U64(k)) >> U64(48)
                sums[0, full] = np.add.reduceat(values, heads).view(np.int64)
                sums[1, full] = np.add.reduceat(mix(values + U64(1)), heads).view(np.int64)
            ends = (np.arange(batch.num_rows + 1) * out[0].nbytes).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), packed], ["id", "n", "s1", "s2", "sig"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(sign, "id long, n long, s1 long, s2 long, sig binary")


def _unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def keys_of(sig: np.ndarray, chunk: int) -> np.ndarray:
    """A column for each choice of symbols of the chunk."""
    part = sig[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(U64)
    columns = []
    for number, choice in enumerate(CHOICES):
        key = np.full(len(sig), chunk * len(CHOICES) + number + 1, U64)
        for k in choice:
            key = (key << U64(16)) | part[:, k]
        columns.append(mix(key))
    return np.stack(columns, 1)


def shared_keys(classes: DataFrame) -> DataFrame:
    """Rows (key, number, id) of all keys that two or more classes have. classes: id, sig."""
    n = classes.count()
    routes = max(1, math.ceil(n / max(ROUTE_CLASSES, 4 * n // blobs.BUCKET_ENTRIES)))
    routed = classes.select(F.pmod(F.xxhash64("id"), F.lit(routes)).cast("int").alias("route"), "id", "sig")
    per_class = CHUNKS * len(CHOICES)
    buckets = blobs.bucket_count(n * per_class)

    def all_keys(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by([("id", "ascending"), ("sig", "ascending")]).combine_chunks()
        sig = _unpacked(table.column("sig"))
        return table, np.concatenate([keys_of(sig, c) for c in range(CHUNKS)], 1).ravel()

    @thrifty
    def send(table: pa.Table) -> pa.Table:
        table, keys = all_keys(table)
        _, firsts, counts = np.unique(keys, return_index=True, return_counts=True)
        sent = np.argsort(firsts)
        firsts, again = firsts[sent], counts[sent] > 1
        keys = keys[firsts]
        return blobs.deal(blobs.bucket_of(keys, buckets), table.column("route")[0].as_py(), {"p": (firsts.astype(U64), _PLACE), "h": (keys, 5), "m": (again.astype(U64), 1)})

    @thrifty
    def meet(table: pa.Table) -> pa.Table:
        shared = repeated(blobs.column(table, "h", 5)) | (blobs.column(table, "m", 1) > 0)
        return blobs.deal(blobs.senders(table, "p")[shared], 0, {"p": (blobs.column(table, "p", _PLACE)[shared], _PLACE)})

    @thrifty_pair
    def name(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows or not marks.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "number": pa.array([], pa.int32()), "id": pa.array([], pa.int64())})
        table, keys = all_keys(table)
        at = np.flatnonzero(np.isin(keys, keys[blobs.column(marks, "p", _PLACE).astype(np.int64)]))
        ids = table.column("id").to_numpy()[at // per_class]
        return pa.table({"key": pa.array(keys[at].view(np.int64)), "number": pa.array((at % per_class).astype(np.int32)), "id": pa.array(ids)})

    met = routed.groupBy("route").applyInArrow(send, blobs.schema(p=_PLACE, h=5, m=1)).groupBy("receiver").applyInArrow(meet, blobs.schema(p=_PLACE))
    return routed.groupBy("route").cogroup(met.groupBy("receiver")).applyInArrow(name, "key long, number int, id long")


def near(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and whole signatures allow."""
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)).select("a", "b", "sig_a", "sig_b")
    most = most_errors(similarity)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = (_unpacked(batch.column("sig_a")) != _unpacked(batch.column("sig_b"))).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(errors <= most))

    return both.mapInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * common >= percent * all shingles, counted on the full sets. texts: id, text."""
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in slices(batches, "text_a") for y in slices([x], "text_b")):
            a, at_a = shingles(*text_bytes(batch.column("text_a")), size)
            b, at_b = shingles(*text_bytes(batch.column("text_b")), size)
            salt = mix(np.arange(batch.num_rows, dtype=U64) + U64(1))
            pair_a, pair_b = np.repeat(np.arange(batch.num_rows), np.diff(at_a)), np.repeat(np.arange(batch.num_rows), np.diff(at_b))
            common = np.bincount(pair_a[np.isin(a ^ salt[pair_a], b ^ salt[pair_b])], minlength=batch.num_rows)
            union = np.diff(at_a) + np.diff(at_b) - common
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * union))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a long, b long")


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """Rows (id, sketch) of texts (id, text): longer signatures with symbols of one byte, which tell near misses from links."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingles(*text_bytes(batch.column("text")), size)
            full = np.flatnonzero(np.diff(offsets))
            out = np.zeros((batch.num_rows, SKETCH), np.uint8)
            if len(values):
                for k, seed in enumerate(_SKETCH_SEEDS):
                    out[full, k] = mix(np.minimum.reduceat((values ^ seed) * seed, offsets[:-1][full])) >> U64(56)
            ends = (np.arange(batch.num_rows + 1) * SKETCH).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])], ["id", "sketch"])

    return texts.mapInArrow(sketch, "id long, sketch binary")


#: Sides of a block: members of a small group, which all meet one another; those that ask; those that are asked, and of these the ones of the most frequent label.
PLAIN, ASKS, ASKED, FREQUENT = range(4)


def _pairs_within(
    keys: np.ndarray, block: np.ndarray, side: np.ndarray, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sig: np.ndarray, sketch: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block of a key and two labels that sizes and sketches allow, each at the first key that it shares. Rows are sorted by key, block and side."""
    most = most_errors(similarity, SKETCH)
    heads = np.flatnonzero(_begins(keys, block))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in zip(heads, np.append(heads[1:], len(keys)), strict=True):
        asking = a + int((side[a:b] <= ASKS).sum())
        for top in range(a, asking, 512):
            rows = slice(top, min(top + 512, asking))
            # Two that ask are asked as well: the lesser one asks.
            ok = (labels[rows, None] != labels[None, a:b]) & ((ids[rows, None] < ids[None, a:b]) | (side[None, a:b] == FREQUENT)) & (side[None, a:b] != ASKS)
            if not ok.any():
                continue
            ok &= np.minimum(sizes[rows, None], sizes[None, a:b]) >= similarity * np.maximum(sizes[rows, None], sizes[None, a:b]) - 1e-6
            i, j = np.nonzero(ok)
            i, j = i + top, j + a
            first = np.ones(len(i), bool)
            chunk, choice = divmod(int(number[a]), len(CHOICES))
            for c in range(chunk + 1):
                code = np.zeros(len(i), np.int64)
                for k in range(CHUNK):
                    code |= (sig[i, c * CHUNK + k] == sig[j, c * CHUNK + k]).astype(np.int64) << k
                first &= _FIRST_CHOICE[code] == (choice if c == chunk else len(CHOICES))
            i, j = i[first], j[first]
            for k in range(0, len(i), 65536):
                x, y = i[k : k + 65536], j[k : k + 65536]
                near = (sketch[x] != sketch[y]).sum(1) <= most
                out.append((ids[x[near]], ids[y[near]]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *(p[k] for p in out)]) for k in (0, 1))


def _begins(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether a row begins a block."""
    return np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as hold together what these pairs do: the least member of each connected part with every other one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            rest = np.flatnonzero(label != np.arange(len(ids)))
            return ids[label[rest]], ids[rest]
        label = new


def across(shared: DataFrame, labels: DataFrame, classes: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that hold together all pairs of one key and of two components that sizes and sketches allow. shared: key, number, id.

    Within a group, the pairs are never rows: they are made in a task in blocks, and only a forest of them comes out.
    """
    groups = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "number", "id", F.coalesce("label", "id").alias("label"))
    wide = groups.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "m")
    groups = hold(groups.join(wide, "key").select("key", "number", "id", "label", "m"))
    facts = classes.select("id", F.col("n").alias("size"), "sig").join(sketched, "id")
    small = groups.where(F.col("m") <= HOT).select("key", F.lit(0).cast("bigint").alias("block"), F.lit(PLAIN).alias("side"), "number", "id", "label")

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            ints = [rows.column(c).to_numpy() for c in ("key", "block", "side", "number", "id", "label", "size")]
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            a, b = _forest(*_pairs_within(*ints, _unpacked(rows.column("sig")), sketch, similarity))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            if not len(keys):
                continue
            last = int(np.flatnonzero(_begins(keys, block))[-1])  # the last block may go on in the next batch
            if last:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and (held[0].column("key")[0].as_py(), held[0].column("block")[0].as_py()) != (keys[0], block[0]):
                yield flush(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush(pa.Table.from_batches(held))
        give_back()

    rows = small.union(_blocks(groups.where(F.col("m") > HOT))).join(facts, "id").select("key", "block", "side", "number", "id", "label", "size", "sig", "sketch")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "side").mapInArrow(pair, "a long, b long").distinct()


def _blocks(hot: DataFrame) -> DataFrame:
    """Rows (key, block, side, number, id, label) of large groups: members outside the most frequent label meet all members, half of HOT of each in a block.

    hot: key, number, id, label, m (members of the key).
    """
    tops = hot.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"))
    half = max(1, HOT // 2)
    parts = hot.join(tops, "key").withColumns({
        "asking": F.ceil((F.col("m") - F.col("top.c")) / half), "asked": F.ceil(F.col("m") / half), "frequent": F.col("label") == F.col("top.label"), "h": F.xxhash64("id"),
    })
    place = lambda i, j, side: F.struct((i * F.col("asked") + j).cast("bigint").alias("block"), side.alias("side"))
    is_asked = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("asking") - 1), lambda i: place(i, F.pmod("h", "asked"), F.when(F.col("frequent"), FREQUENT).otherwise(ASKED)))
    asks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("asked") - 1), lambda j: place(F.pmod("h", "asking"), j, F.lit(ASKS)))
    parts = parts.select("key", "number", "id", "label", F.explode(F.when(F.col("frequent"), is_asked).otherwise(F.concat(is_asked, asks))).alias("at"))
    return parts.select("key", "at.block", "at.side", "number", "id", "label")


def links_within(families: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between texts of one family and of two components, as few as make the same components, by their full sets.

    families: node, label (the family). A family of more than TILE texts is cut into tiles, of which each two meet in a task; small ones share
    tasks. A text is compared with those that share shingles with it, through lists of the texts of each shingle.
    """
    parts = families.select(F.col("node").alias("id"), F.col("label").alias("family")).join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = parts.groupBy("family").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    common = max(1, math.ceil(families.count() / TILE))
    parts = parts.join(counts, "family").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")))).select(
        "id", "label", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        F.when(F.col("tiles") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(common))).alias("task"),
    )

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, offsets = shingles(*text_bytes(batch.column("text")), size)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed], ["id", "shingles"])

    @thrifty
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("shingles").to_pylist()
        ids, labels, tiles = (table.column(c).to_numpy() for c in ("id", "label", "tile"))
        sizes = np.array([len(x) // 8 for x in lists])
        apart = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, at = np.unique(np.frombuffer(b"".join(lists), U64), return_inverse=True)
        order = np.argsort(at, kind="stable")
        postings, bounds = owner[order], np.concatenate([[0], np.cumsum(np.bincount(at))])
        parent = {x: x for x in labels.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        # A pair of two labels has a member outside the most frequent one.
        values, numbers = np.unique(labels, return_counts=True)
        most = values[numbers.argmax()]
        ends = np.cumsum(sizes)
        out = []
        for x in np.flatnonzero(labels != most):
            own = at[ends[x] - sizes[x] : ends[x]]
            heads, lengths = bounds[own], bounds[own + 1] - bounds[own]
            stops = np.cumsum(lengths)
            met = postings[np.repeat(heads - (stops - lengths), lengths) + np.arange(stops[-1])]
            common = np.bincount(met, minlength=len(ids))
            linked = (100 * common >= percent * (sizes[x] + sizes - common)) & (labels != labels[x])
            for y in np.flatnonzero(linked & (tiles != tiles[x]) if apart else linked):
                a, b = root(int(labels[x])), root(int(labels[y]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    sets = texts.join(families.select(F.col("node").alias("id")), "id", "left_semi").select("id", "text").mapInArrow(gather, "id long, shingles binary")
    return parts.join(sets, "id").groupBy("task", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, class_id (least id with the same set), component_id (least id that links reach).

    Words are runs of anything but ASCII white space, with A-Z in lower case. A text's set holds its shingles of `size` words, or with
    fewer words the whole sequence. Two texts are linked if 100 * common >= percent * all. A null text, and one without words, has an empty set and is
    linked with nothing. Rows of one id are one node: they share the component of any of them. A row without id is left alone, with a null
    component. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    similarity = percent / 100
    signed_path = scratch_path(spark, "signatures")
    signatures(docs, size, id_col, text).write.parquet(signed_path)
    signed = spark.read.parquet(signed_path)
    linked = signed.where("id is not null and n > 0")
    # An id has several classes only where it is there with several texts; these are linked below.
    class_path = scratch_path(spark, "classes")
    few_files(linked.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), signed.count(), FILE_ROWS).write.parquet(class_path)
    # Where an id has several texts, it has several classes: each makes keys, and all their links are the id's.
    classes = spark.read.parquet(class_path)
    ids = linked.select("s1", "s2", "n", "id").join(classes.select("s1", "s2", "n", F.col("id").alias("class_id")), ["s1", "s2", "n"])
    shared = hold(shared_keys(classes.select("id", "sig")))
    stars = shared.join(shared.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1"), "key")
    stars = stars.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    stars = hold(near(stars, classes, similarity))
    texts_path = scratch_path(spark, "candidates")
    members = shared.select("id").distinct()
    candidates = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).join(members, "id", "left_semi")
    few_files(candidates, blobs.text_size(docs, text), FILE_BYTES).write.parquet(texts_path)
    texts = spark.read.parquet(texts_path)
    links = hold(confirmed(stars, texts, size, percent))
    sketched = hold(sketches(texts, size))
    labels = components(links)
    families = components(across(shared, labels, classes, sketched, similarity))
    links = links.union(hold(links_within(families, labels, texts, size, percent)))
    # Equal sets and ids with several sets are links as well.
    same = ids.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    labels = components(links.union(same))
    rows = signed.join(ids.groupBy("id", "s1", "s2", "n").agg(F.min("class_id").alias("class_id")), ["id", "s1", "s2", "n"], "left")
    rows = rows.join(labels.withColumnRenamed("node", "id").withColumnRenamed("label", "component_id"), "id", "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))


def digest(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
