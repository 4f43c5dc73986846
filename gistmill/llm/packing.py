"""Packing by powers of two: no sequence holds tokens of two documents, and none is padded.

The tokens of a document are cut into pieces whose lengths are powers of two: as many of the longest length as fit, then one for each binary digit of
what is left, from the largest. Each piece is a sequence by itself, and sequences of equal length make a bucket, from which batches are taken. So a
document of n tokens gives n // longest + (binary digits of the rest) sequences, there is no padding at all, and attention never crosses documents.

The number of a sequence has its bucket in front, then the partition and a running number in it: numbers of one bucket lie together, and no rows are
shuffled to give them. A task that runs again after an executor was lost gives its rows the same numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gistmill.llm.words import slices

#: A sequence number: bucket, partition (22 bits), running number (36 bits).
PARTITION_BITS, RUNNING_BITS = 22, 36
#: Tokens of the pieces in one Arrow batch.
BATCH_TOKENS = 1 << 20

#: The pre-token pattern of the byte-level tokenizers that the library's "ByteLevel" step stands for; fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts as the library `tokenizers` gives them for a file's JSON text, without added tokens.

    A plain byte-level BPE file is also read as a table of ranks, with which `tiktoken` gives the same ids several times faster; other files, and texts
    that its regular expressions refuse (white space by the hundred thousand), go to `tokenizers`.
    """

    def __init__(self, text: str):
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self._ranked(json.loads(text))

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding | None:
        model, step = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not spec.get("normalizer")
        plain &= not any(x["single_word"] or x["lstrip"] or x["rstrip"] or not x["special"] for x in spec["added_tokens"])
        if not plain:
            return None
        # Bytes that can be printed stand for themselves in the vocabulary, the others for characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if len(set(made)) < len(made) or made != sorted(made) or len(made) + 256 != len(ranks):
            return None  # ranks by id would not be the order of merges
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[int, Encoder] = {}


def piece_lengths(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of all pieces, document by document, and the number of pieces of each document."""
    full, rest = tokens // longest, tokens % longest
    digits = np.arange(longest.bit_length() - 2, -1, -1)
    has = (rest[:, None] >> digits) & 1
    # One row for a document: its full pieces, then its binary digits from the largest.
    times = np.concatenate([full[:, None], has], 1)
    sizes = np.concatenate([[longest], np.int64(1) << digits])
    return np.repeat(np.tile(sizes, len(tokens)), times.ravel()), times.sum(1)


def pack(docs: DataFrame, path: str, longest: int = 1024, end: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: id, start (tokens of its document before it), length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    A document is the ids of its text by the tokenizer file `path` (read on the driver) without added begin or end tokens, then `end`. Every id is in
    exactly one piece. longest: a power of two. A null or empty text is the one id `end`, rows that are there twice are packed twice, null ids stay, an
    empty table gives none, other columns are not read. Long texts are encoded whole; a task holds one slice of texts and its ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _encoders:
            _encoders[key] = Encoder(sent.value)
        encoder, stop = _encoders[key], np.array([end], np.uint32)
        part, running = TaskContext.get().partitionId(), 0
        if part >> PARTITION_BITS:
            raise ValueError("too many partitions to number sequences")
        for batch in slices(batches):
            rows = [np.concatenate([encoder.ids(x or ""), stop]) for x in batch.column("text").to_pylist()]
            tokens = np.array([len(x) for x in rows], np.int64)
            data = np.concatenate(rows).astype("<u4", copy=False)
            lengths, pieces = piece_lengths(tokens, longest)
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(rows)), pieces)
            starts = ends - lengths - (np.cumsum(tokens) - tokens)[owner]
            bucket = np.log2(lengths).astype(np.int64)
            numbers = bucket << (PARTITION_BITS + RUNNING_BITS) | part << RUNNING_BITS | running + np.arange(len(lengths))
            running += len(lengths)
            at = 0
            while at < len(lengths):
                before = int(ends[at] - lengths[at])
                to = max(at + 1, int(np.searchsorted(ends, before + BATCH_TOKENS, "right")))
                bounds = np.concatenate([[0], ends[at:to] - before]) * 4
                ids = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[before : int(ends[to - 1])])])
                columns = [batch.column("id").take(pa.array(owner[at:to])), pa.array(starts[at:to]), pa.array(lengths[at:to]), ids]
                columns += [pa.array(tokens[owner[at:to]]), pa.array(numbers[at:to]), pa.array(np.zeros(to - at, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                at = to

    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(cut, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences as Parquet, a folder for each length: a training job draws its batches from one of them at a time."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
