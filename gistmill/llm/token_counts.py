"""Token counts of a byte-level BPE vocabulary by finite-state transducers.

A deterministic transducer over classes of characters cuts texts into pre-tokens: each transition says how many start there. Texts
are read as one row of characters cut into chunks; all chunks advance together from every state at once, which gives each chunk's map
from state to state. A parallel prefix scan composes these maps, and from its true first state each chunk then emits its marks.
So a text of any length costs the same for each character.

The tokens within a pre-token come from a second transducer, over bytes. A state is the set of ways to go on from what was read: for each place where a
token may have begun, the token before it, the place in the trie of tokens reached since, and how many tokens it has beyond the least of the set. A byte
takes every way one step down the trie; the one way that ends in a token compatible with the token before it (see `merges.Pairs`) also gives the way that begins anew.
A transition is annotated with the tokens that all its ways have settled, a state with those still to come if the pre-token ends there. States and transitions are compiled when
they are first met, for all pre-tokens of a slice together. Each pre-token begins in the first state, so the map of a pre-token is a constant
and the maps of a text compose by adding them up; those of the first transducer compose by the prefix scan.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.merges import Merges, Pairs
from gistmill.llm.words import U64, mix, slices, text_bytes

CHUNK_CHARS = 64
#: Places for transitions in a worker, 16 bytes each. When half are taken, only the states in use are kept.
PLACES = 1 << 20
#: Pre-tokens that advance together.
TOGETHER = 1 << 17

# Classes of characters.
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, STMD, RV, LL, EE, END = range(11)
# States: after a text's start or a contraction; in a run of letters, numbers or others; in white space (one character or more, with a plain space last
# or not); after a quote that starts a pre-token, and after that with r or v, or with l.
BEGIN, LETTERS, NUMBERS, OTHERS, SPACE1, WHITE1, SPACES, WHITES, QUOTED, QUOTED_RV, QUOTED_L = range(11)
STATES = 11
#: Where a transition has pre-tokens start: at its character, and at the one before.
HERE, BEFORE = 1, 2
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by class and state."""
    step, marks = np.zeros((11, STATES), np.uint8), np.zeros((11, STATES), np.uint8)
    run = {LETTER: LETTERS, STMD: LETTERS, RV: LETTERS, LL: LETTERS, EE: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: OTHERS}
    for kind in range(11):
        for state in range(STATES):
            mark, then = HERE, run.get(kind)
            if kind == END:
                then, mark = BEGIN, BEFORE if state in (QUOTED_RV, QUOTED_L) else 0
            elif kind in (SPACE, WHITE):
                if state in (SPACE1, WHITE1, SPACES, WHITES):
                    then, mark = SPACES if kind == SPACE else WHITES, 0
                else:
                    then = SPACE1 if kind == SPACE else WHITE1
                    mark = HERE | (BEFORE if state in (QUOTED_RV, QUOTED_L) else 0)
            elif state in (SPACE1, SPACES):  # the last space goes with what follows
                mark = BEFORE if state == SPACES else 0
            elif state in (WHITE1, WHITES):
                mark = HERE | (BEFORE if state == WHITES else 0)
                then = QUOTED if kind == QUOTE else then
            elif state in (QUOTED, QUOTED_RV, QUOTED_L) and (
                state == QUOTED and kind in (STMD, RV, LL) or state == QUOTED_RV and kind == EE or state == QUOTED_L and kind == LL
            ):
                mark = 0
                then = {RV: QUOTED_RV, LL: QUOTED_L}[kind] if state == QUOTED and kind != STMD else BEGIN
            elif state == QUOTED:
                mark = 0 if then == OTHERS else HERE
            elif state in (QUOTED_RV, QUOTED_L):  # the quote was alone; a letter came after it
                mark = BEFORE | (0 if then == LETTERS else HERE)
                then = QUOTED if kind == QUOTE else then
            elif state == then:
                mark = 0
            elif kind == QUOTE:
                then = QUOTED
            step[kind, state], marks[kind, state] = then, mark
    return step, marks


STEP, MARKS = _transducer()
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class of every code point; made once in a worker."""
    if "classes" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[WHITE_SPACE] = WHITE
        table[0x20] = SPACE
        for text, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", LL), ("e", EE)):
            table[[ord(x) for x in text]] = kind
        _tables["classes"] = table
    return _tables["classes"]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of all characters, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at].astype(np.int32)
    code = first.copy()
    for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        rows = np.flatnonzero(first >= (0xC0, 0xE0, 0xF0)[size - 2])
        if size < 4:
            rows = rows[first[rows] < (0xE0, 0xF0)[size - 2]]
        if len(rows):
            value = first[rows] & mask
            for k in range(1, size):
                value = (value << 6) | (data[at[rows] + k] & 0x3F)
            code[rows] = value
    return at, code


def transduce(kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for a row of classes in which END closes each text."""
    n = len(kinds)
    chunks = -(-n // CHUNK_CHARS)
    padded = np.full(chunks * CHUNK_CHARS, END, np.uint8)
    padded[:n] = kinds
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK_CHARS).T)
    flat, out = STEP.ravel(), MARKS.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = flat[(row.astype(np.uint8) * np.uint8(STATES))[:, None] + maps]
    # Prefix scan: after the step of width w, a map leads through up to 2w chunks that end with its own.
    width = 1
    while width < chunks:
        maps = np.concatenate([maps[:width], np.take_along_axis(maps[width:], maps[:-width].astype(np.int64), 1)])
        width *= 2
    state = np.concatenate([[BEGIN], maps[:-1, BEGIN]]).astype(np.uint8)
    marks = np.empty((CHUNK_CHARS, chunks), np.uint8)
    for k, row in enumerate(grid):
        at = row * np.uint8(STATES) + state
        marks[k] = out[at]
        state = flat[at]
    marks = marks.T.ravel()[:n]
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    return starts


class Vocabulary:
    """The transducer over bytes of a byte-level BPE vocabulary, given as the JSON text of its file."""

    def __init__(self, text: str):
        model = json.loads(text)
        self.special = [x["content"].encode() for x in model["added_tokens"] if x["special"]]
        vocab = model["model"]["vocab"]
        # Bytes that can be printed stand for themselves in the vocabulary, the others for characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        of_byte = np.zeros(256, np.int64)
        for name, b in byte_of.items():
            of_byte[b] = vocab[name]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left, right = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64).reshape(-1, 2).T
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        tokens = {k: [byte_of[c] for c in name] for name, k in vocab.items() if all(c in byte_of for c in name)}
        self.pairs = Pairs(Merges(left, right, np.arange(len(merges)), made), np.array(list(tokens), np.int64), [of_byte[x] for x in tokens.values()], max(vocab.values()) + 1)
        self._trie([(k, x) for k, x in tokens.items() if self.pairs.whole[k]])
        self._clear()

    def _trie(self, tokens: list[tuple[int, list[int]]]) -> None:
        """Nodes from 1 on, 0 is the root: children by node and byte in sorted keys, the token of each node or -1, and whether it has children."""
        children: dict[int, int] = {}
        token = [-1]
        for k, name in tokens:
            node = 0
            for b in name:
                child = children.setdefault(node << 8 | b, len(token))
                if child == len(token):
                    token.append(-1)
                node = child
            token[node] = k
        keys = np.array(list(children), np.int64)
        order = np.argsort(keys)
        self.steps, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.token, self.inner = np.array(token, np.int64), np.zeros(len(token), bool)
        self.inner[keys >> 8] = True

    def _clear(self) -> None:
        """No transition, and one state: nothing read, no token before."""
        self.keys, self.values, self.taken = np.full(PLACES, -1, np.int64), np.zeros(PLACES, np.int64), 0
        self.ids: dict[bytes, int] = {}
        self.ways, self.ends = np.zeros((1024, 3), np.int32), np.zeros(1024, np.int64)  # of state s: ways[ends[s - 1] : ends[s]]
        self.rest = np.zeros(1024, np.int64)
        self._states(np.array([[-1, 0, 0]], np.int32), np.array([1]))

    def _states(self, ways: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The states of sets of ways, which stand one after the other; the last way of a set begins anew."""
        blob, stops = ways.tobytes(), np.cumsum(sizes)
        out, new, n = [], [], len(self.ids)
        for k, (a, b) in enumerate(zip((12 * (stops - sizes)).tolist(), (12 * stops).tolist(), strict=True)):
            state = self.ids.setdefault(blob[a:b], n)
            if state == n:
                new.append(k)
                n += 1
            out.append(state)
        if new:
            first, k = n - len(new), np.array(new)
            ends = (self.ends[first - 1] if first else 0) + np.cumsum(sizes[k])
            if n > len(self.ends):
                grown = max(n, 2 * len(self.ends))
                self.ends, self.rest = np.resize(self.ends, grown), np.resize(self.rest, grown)
            if ends[-1] > len(self.ways):
                self.ways = np.resize(self.ways, (max(int(ends[-1]), 2 * len(self.ways)), 3))
            at = np.repeat(stops[k] - np.cumsum(sizes[k]), sizes[k]) + np.arange(int(sizes[k].sum()))
            self.ways[ends[-1] - len(at) : ends[-1]] = ways[at]
            self.ends[first:n], self.rest[first:n] = ends, ways[stops[k] - 1, 2]
        return np.array(out, np.int64)

    def _sets(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ways of states one after the other, and how many each has."""
        ends = self.ends[states]
        sizes = ends - np.where(states > 0, self.ends[states - 1], 0)
        return self.ways[np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))], sizes

    def _compiled(self, keys: np.ndarray) -> np.ndarray:
        """Transitions, as state after << 16 | tokens settled, of distinct keys (state << 8 | byte)."""
        ways, sizes = self._sets(keys >> 8)
        owner = np.repeat(np.arange(len(keys)), sizes)
        step = ways[:, 1].astype(np.int64) << 8 | keys[owner] & 0xFF
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        on = self.steps[at] == step
        owner, before, node, more = owner[on], ways[on, 0].astype(np.int64), self.child[at[on]], ways[on, 2]
        token = self.token[node]
        ending = np.flatnonzero(token >= 0)
        inner = ending[before[ending] >= 0]
        fits = np.zeros(len(owner), bool)
        fits[ending] = True
        fits[inner] = self.pairs.compatible(before[inner], token[inner])
        one = np.flatnonzero(fits)
        if len(one) != len(keys):
            raise ValueError("a prefix without exactly one last token")
        stays = np.flatnonzero(self.inner[node])
        owner = np.concatenate([owner[stays], owner[one]])
        ways = np.concatenate([np.stack([before[stays], node[stays], more[stays]], 1), np.stack([token[one], np.zeros(len(one), np.int64), more[one] + 1], 1)])
        order = np.argsort(owner, kind="stable")
        owner, ways = owner[order], ways[order].astype(np.int32)
        sizes = np.bincount(owner, minlength=len(keys))
        settled = np.minimum.reduceat(ways[:, 2], np.cumsum(sizes) - sizes)
        ways[:, 2] -= settled[owner]
        return self._states(ways, sizes) << 16 | settled

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its place, or the free one where it belongs; and whether it is there."""
        at = (mix(keys.astype(U64)) >> U64(20)).astype(np.int64) & (PLACES - 1)
        found = self.keys[at]
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (PLACES - 1)
            found[other] = self.keys[at[other]]
            other = other[(found[other] != keys[other]) & (found[other] >= 0)]
        return at, found == keys

    def _advance(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The transitions from states by a byte each."""
        keys = states << 8 | data
        at, there = self._places(keys)
        out = self.values[at]
        new = np.flatnonzero(~there)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            made = self._compiled(distinct)
            out[new] = made[back]
            self.taken += len(distinct)
            while len(distinct):  # keys that belong to one free place: one takes it, the others look on
                at, _ = self._places(distinct)
                places, one = np.unique(at, return_index=True)
                self.keys[places], self.values[places] = distinct[one], made[one]
                left = np.ones(len(distinct), bool)
                left[one] = False
                distinct, made = distinct[left], made[left]
        return out

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(starts), np.int64)
        for first in range(0, len(starts), TOGETHER):
            sizes = (ends - starts)[first : first + TOGETHER]
            order = np.argsort(-sizes, kind="stable")
            sizes, at = sizes[order], starts[first + order]
            counts, states = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            going = np.searchsorted(-sizes, -np.arange(sizes[0] + 1))  # how many are longer than each place
            for place in range(int(sizes[0])):
                n = going[place]
                states = states[:n]
                if self.taken + n > PLACES // 2:
                    distinct, back = np.unique(states, return_inverse=True)
                    ways, ways_each = self._sets(distinct)
                    self._clear()
                    states = self._states(ways, ways_each)[back]
                moved = self._advance(states, data[at[:n] + place])
                states = moved >> 16
                counts[:n] += moved & 0xFFFF
                done = slice(going[place + 1], n)
                counts[done] += self.rest[states[done]]
            out[first + order] = counts
        return out


def _segments(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts that special tokens cut texts into, and whether a part is such a token."""
    raw, cuts, is_special = data.tobytes(), [offsets[:-1]], []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right"):
                is_special.append(at)
                cuts.append(np.array([at, at + len(token)]))
            at = raw.find(token, at + len(token))
    starts = np.unique(np.concatenate(cuts))
    starts = starts[starts < len(data)]
    return starts, np.isin(starts, is_special)


def count(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    parts, special = _segments(data, offsets, vocabulary.special)
    at, code = characters(data)
    kinds = classes()[code]
    # An END goes before the first character of each part but the first.
    first_char = np.searchsorted(at, parts[1:])
    marks = transduce(np.append(np.insert(kinds, first_char, END), END))
    body = np.ones(len(marks), bool)
    body[first_char + np.arange(len(first_char))] = False
    body[-1] = False
    starts = at[marks[body]]
    ends = np.append(starts[1:], len(data))
    owner = np.searchsorted(parts, starts, "right") - 1
    plain = ~special[owner]
    starts, ends = starts[plain], ends[plain]
    out = np.bincount(np.searchsorted(offsets, starts, "right") - 1, vocabulary.tokens(data, starts, ends), n).astype(np.int64)
    return out + np.bincount(np.searchsorted(offsets, parts[special], "right") - 1, minlength=n)


_vocabularies: dict[int, Vocabulary] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens. path: a byte-level BPE tokenizer file, read on the driver.

    The counts are those of the file's library without added begin or end tokens; a special token's string inside a text counts as one.
    A null or empty text has no tokens. Rows that are there twice count alike, an empty table gives none, other columns are not read.
    Nothing is shuffled; the vocabulary has a fixed size.
    """
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _vocabularies:
            _vocabularies[key] = Vocabulary(sent.value)
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            columns = [batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(count(data, offsets, _vocabularies[key]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(tally, "id long, n_bytes long, n_tokens long")
