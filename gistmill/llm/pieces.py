"""SentencePiece encoding and decoding in numpy, for unigram and BPE models.

All texts of a slice become one row of characters, which is cut into units that no piece runs across (words, with the space mark before
them). Each distinct unit of a slice is encoded once, and units of equal length advance together:

* Unigram: Viterbi. For each end place, hashes of the substrings that end there probe the sorted keys of the pieces, and the vectorised maximum of
  the scores so far stores the way back. Sums are of single precision, unit by unit; where two ways have the same sum but for rounding, a library that adds up
  whole sentences may take the other one.
* BPE: the best sum of scores is not what such a model means, so the way back is another. The merges of a text are those of its parts wherever no merge
  crosses from part to part; so a row of pieces is the encoding if each is by itself and each two neighbours are (they are a compatible pair), and each
  prefix has exactly one last piece. For each end place, the same probes give the candidates; of those that are compatible with the last piece of the prefix
  before them the vectorised maximum of lengths, which is the only one, stores the way back. Whether a pair is compatible follows from the steps in which both are merged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gistmill.llm.merges import Merges, Pairs
from gistmill.llm.token_counts import characters
from gistmill.llm.words import U64, mix, run_hashes, slices, text_bytes

UNIGRAM, BPE = 1, 2
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
SPACE = 0x2581
#: What an unknown character scores below the least piece.
UNKNOWN_COST = 10.0
#: Fewer units of one length than this go place by place, each by itself.
FEW = 24


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """Pieces of a model file with identity normalisation."""

    def __init__(self, raw: bytes):
        pieces, self.kind, self.prefix, self.unknown = [], UNIGRAM, True, 0
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that keep characters and white space as they are can be read")
        if self.kind not in (UNIGRAM, BPE) or any(k in (USER, UNUSED) for _, _, k in pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces can be read")
        self.names = [name for name, _, _ in pieces]
        self.score = np.array([s for _, s, _ in pieces], np.float32)
        self.bytes_at = np.full(256, -1, np.int64)
        normal = {}
        for k, (name, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes_at[int(name[3:5], 16)] = k
            elif kind == UNKNOWN:
                self.unknown = k
            elif kind == NORMAL:
                normal[name] = k
        self.fallback = bool((self.bytes_at >= 0).all())
        # Symbols are pieces of one character, or characters by code point beyond all pieces.
        self.base = len(pieces)
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.base
        for name, k in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = k
        self.alone = np.ones(0x110000, bool)
        self.joins = False  # a space mark within a piece, after something else
        for name in normal:
            if len(name) > 1:
                self.alone[[ord(c) for c in name]] = False
                self.joins |= "▁" in name.lstrip("▁")
        if self.kind == BPE:
            of = lambda part: normal[part] if part in normal else int(self.symbol[ord(part)]) if len(part) == 1 else None
            order = {s: r for r, s in enumerate(sorted({float(self.score[k]) for k in normal.values()}, reverse=True))}
            rows = [
                (left, right, order[float(self.score[k])], k)
                for name, k in normal.items() for cut in range(1, len(name))
                if (left := of(name[:cut])) is not None and (right := of(name[cut:])) is not None
            ]
            # The table of pairs is a few arrays: workers live on, and keep it beside what other stages need.
            symbols = [self.symbol[[ord(c) for c in name]] for name in normal]
            self.pairs = Pairs(Merges(*np.array(rows, np.int64).T), np.array(list(normal.values()), np.int64), symbols, self.base)
            normal = {name: k for name, k in normal.items() if self.pairs.whole[k]}
        keys = np.array([self._key([ord(c) for c in name]) for name in normal], U64)
        order = np.argsort(keys)
        self.by_name, self.keys, self.of_key = normal, keys[order], np.array(list(normal.values()), np.int64)[order]
        self.may_be = np.zeros(1 << 20, bool)  # by the first bits of a key; most substrings are told by these
        self.may_be[keys >> U64(44)] = True
        self.longest = max(map(len, normal))
        self.unknown_score = np.float32(self.score[list(normal.values())].min() - UNKNOWN_COST)
        text = [b"" if k == CONTROL else bytes([int(n[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else n.replace("▁", " ").encode() for n, _, k in pieces]
        self.text_ends = np.cumsum([len(t) for t in text])
        self.text_sizes = np.array([len(t) for t in text], np.int64)
        self.text = np.frombuffer(b"".join(text), np.uint8)

    @staticmethod
    def _key(codes: list[int]) -> np.uint64:
        return run_hashes(mix(np.array(codes, U64) + U64(1)), np.array([0]), np.array([len(codes)]))[0]

    def viterbi(self, codes: np.ndarray) -> list[np.ndarray]:
        """Pieces of units of equal length, a row of code points each."""
        n, size = codes.shape
        numbers = mix(codes.astype(U64).ravel() + U64(1))
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            starts = np.arange(max(0, end - self.longest), end)
            at = (rows[:, None] * size + starts[None]).ravel()
            keys = run_hashes(numbers, at, np.repeat(rows * size + end, len(starts)))
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[found] == keys).reshape(n, -1)
            ids = np.where(hit, self.of_key[found].reshape(n, -1), -1)
            worth = np.where(hit, self.score[ids], -np.inf).astype(np.float32)
            lone = ~hit[:, -1]
            worth[lone, -1] = self.unknown_score
            total = best[:, starts] + worth
            choice = total.argmax(1)
            best[:, end], back[:, end], piece[:, end] = total[rows, choice], starts[choice], ids[rows, choice]
        out = []
        for row in range(n):
            at, ids = size, []
            while at:
                ids.append(piece[row, at] if piece[row, at] >= 0 else self.base + codes[row, at - 1])
                at = back[row, at]
            out.append(np.array(ids[::-1], np.int64))
        return out

    def compatible_way(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units of equal length, a row of code points each, in the one way in which all neighbours are compatible; and how many each has."""
        n, size = codes.shape
        numbers = mix(codes.astype(U64).ravel() + U64(1))
        rows, alone = np.arange(n), self.symbol[codes]
        piece, back = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            starts = np.arange(max(0, end - self.longest), end - 1)
            keys = run_hashes(numbers, (rows[:, None] * size + starts[None]).ravel(), np.repeat(rows * size + end, len(starts)))
            hit = np.flatnonzero(self.may_be[keys >> U64(44)])
            found = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
            same = self.keys[found] == keys[hit]
            hit, found = hit[same], found[same]
            # A character by itself is a candidate in every row.
            row = np.concatenate([hit // max(1, len(starts)), rows])
            start = np.concatenate([starts[hit % max(1, len(starts))], np.full(n, end - 1)])
            ids = np.concatenate([self.of_key[found], alone[:, end - 1]])
            inner = np.flatnonzero(start > 0)
            fits = np.ones(len(row), bool)
            fits[inner] = self.pairs.compatible(piece[row[inner], start[inner]], ids[inner])
            length = np.zeros(n, np.int64)
            np.maximum.at(length, row[fits], end - start[fits])
            chosen = np.flatnonzero(fits & (end - start == length[row]))
            piece[row[chosen], end], back[row[chosen], end] = ids[chosen], start[chosen]
        return _ways(piece, back)

    def compatible_way_alone(self, codes: np.ndarray) -> np.ndarray:
        """As `compatible_way`, place by place for one unit of any length."""
        text, symbols = "".join(map(chr, codes.tolist())), self.symbol[codes].tolist()
        piece, back, known = [0] * (len(text) + 1), [0] * (len(text) + 1), {}
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                this = symbols[start] if start == end - 1 else self.by_name.get(text[start:end])
                if this is None:
                    continue
                if start:
                    pair = (piece[start], this)
                    if pair not in known:
                        known[pair] = self.pairs.pair_apart(*pair)
                    if not known[pair]:
                        continue
                piece[end], back[end] = this, start
                break
        ids, at = [], len(text)
        while at:
            ids.append(piece[at])
            at = back[at]
        return np.array(ids[::-1], np.int64)

    def units(self, codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Places where units start. heads: where texts start."""
        starts = np.zeros(len(codes), bool)
        starts[heads] = True
        if not self.joins:
            space = codes == SPACE
            starts[1:] |= space[1:] & ~space[:-1]
        alone = self.alone[codes]
        starts |= alone
        starts[1:] |= alone[:-1]
        return np.flatnonzero(starts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets."""
        at, codes = characters(data)
        codes = np.where(codes == 0x20, SPACE, codes).astype(np.int64)
        heads = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
        if self.prefix:
            codes = np.insert(codes, heads, SPACE)
            heads = heads + np.arange(len(heads))
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts = self.units(codes, heads)
        ends = np.append(starts[1:], len(codes))
        _, firsts, back = np.unique(run_hashes(mix(codes.astype(U64) + U64(1)), starts, ends), return_index=True, return_inverse=True)
        a, sizes = starts[firsts], (ends - starts)[firsts]
        parts: list[np.ndarray] = []
        counts = np.zeros(len(firsts), np.int64)
        order = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            order.append(rows)
            grid = codes[a[rows, None] + np.arange(size)]
            if self.kind == UNIGRAM:
                made = self.viterbi(grid)
            elif len(rows) < FEW:
                made = [self.compatible_way_alone(row) for row in grid]
            else:
                ids, kept = self.compatible_way(grid)
                counts[rows] = kept
                parts.append(ids)
                continue
            counts[rows] = [len(x) for x in made]
            parts.extend(made)
        flat = np.concatenate(parts)
        order = np.concatenate(order)
        begin = np.zeros(len(firsts), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        per_unit = counts[back]
        stops = np.cumsum(per_unit)
        ids = flat[np.repeat(begin[back] - (stops - per_unit), per_unit) + np.arange(stops[-1])]
        unit_text = np.searchsorted(heads, starts, "right") - 1
        per_text = np.zeros(len(offsets) - 1, np.int64)
        owner = np.repeat(unit_text, per_unit)
        ids, lengths = self._known(ids, owner)
        per_text[np.flatnonzero(np.diff(offsets))] = np.bincount(owner, lengths, len(heads)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def _known(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become bytes, or else one unknown piece for all on end; and how many ids each has become."""
        lengths = np.ones(len(ids), np.int64)
        rare = np.flatnonzero(ids >= self.base)
        if not len(rare):
            return ids, lengths
        if not self.fallback:
            ids = ids.copy()
            ids[rare] = self.unknown
            lengths[rare[1:][(np.diff(rare) == 1) & (owner[rare[1:]] == owner[rare[:-1]])]] = 0
            return ids[lengths > 0], lengths
        code = ids[rare] - self.base
        lengths[rare] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.repeat(ids, lengths)
        begin = np.cumsum(lengths) - lengths
        for size in range(1, 5):
            rows = rare[lengths[rare] == size]
            value = ids[rows] - self.base
            for k in range(size):
                byte = value >> (6 * (size - 1 - k)) & 0x3F | 0x80
                if k == 0:
                    byte = value if size == 1 else value >> (6 * (size - 1)) | (0, 0xC0, 0xE0, 0xF0)[size - 1]
                out[begin[rows] + k] = self.bytes_at[byte]
        return out, lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids. Bytes that are not UTF-8 become U+FFFD."""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        raw = self.text[np.repeat(self.text_ends[ids] - sizes - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in out]


def _ways(piece: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces on the way back from the last place of each row, row by row, and their number."""
    n, places = piece.shape
    on, at, going = np.zeros((n, places), bool), np.full(n, places - 1), np.arange(n)
    while len(going):
        on[going, at] = True
        at = back[going, at]
        going, at = going[at > 0], at[at > 0]
    return piece[on], on.sum(1)


_models: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    key = hash(raw)
    if key not in _models:
        _models[key] = Model(raw)
    return _models[key]


def _sent(frame: DataFrame, path: str):
    with open(path, "rb") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids. path: a model file, read on the driver; its size is fixed.

    The ids are those of the library without begin and end. A null or empty text has none. Rows that are there twice are encoded alike, an empty
    table gives none, other columns are not read. Nothing is shuffled.
    """
    sent = _sent(docs, path)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in slices(batches):
            ids, offsets = model.encode(*text_bytes(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets), pa.int64()), lists], ["id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(encode, "id long, n_tokens long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with one more column, the text of the ids. Null ids give a null text; an id outside the model is an error."""
    sent = _sent(encoded, path)
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                lists = rows.column(ids)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
                texts = model.decode(values, np.concatenate([[0], np.cumsum(sizes)]))
                empty = lists.is_null().to_pylist()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([None if e else t for t, e in zip(texts, empty, strict=True)], pa.string())], [*rows.schema.names, out])

    return encoded.mapInArrow(decode, schema)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode_pieces`, with one more column: whether the ids decode to the text again. A text with U+2581 in it does not, as decoding makes it a blank."""
    sent = _sent(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in slices(batches):
            column = batch.column("text").fill_null("")
            ids, offsets = model.encode(*text_bytes(column))
            same = [a == b for a, b in zip(model.decode(ids, offsets), column.to_pylist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(same, pa.bool_())], ["id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_tokens long, ids array<int>, round_trip boolean")
