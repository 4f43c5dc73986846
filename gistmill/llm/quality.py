"""Quality rules: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.words import PLAIN_WORD, U64, covered, gram_hashes, mix, repeated, slices, span_hashes, split_words, text_bytes, text_sums

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Not a later byte of a character.
_LEADS = np.ones(256, bool)
_LEADS[0x80:0xC0] = False


@dataclass(frozen=True)
class Rules:
    """A text fails on too few words, too many words in repeated 3-word windows, or too large a share of its word characters in
    repeated n-grams (of each length by its own share) or repeated lines, or more than `symbols` symbols a word."""

    least_words: int = 50
    repeat_words: float = 0.5
    gram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.4, 7: 0.35, 10: 0.3})
    line_chars: float = 0.3
    symbols: float = 0.1


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All columns of `quality_rules` but the ids, for texts as bytes and offsets."""
    words = split_words(data, offsets, PLAIN_WORD)
    hashes = span_hashes(data, words.starts, words.ends)
    text_of = words.text_of()
    salt = mix(np.arange(len(offsets) - 1, dtype=U64) + U64(1))
    n_words = words.counts
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEADS[data] & PLAIN_WORD[data], out=leads[1:])
    chars = leads[words.ends] - leads[words.starts]
    word_chars = text_sums(chars, words.offsets)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": text_sums(_SYMBOL[data], offsets)}
    share = lambda part: part / np.maximum(1, word_chars)

    # Lines: pieces between line breaks and the borders of texts.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = np.unique(starts[starts < len(data)])
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - (data[ends - 1] == 0x0A) if len(ends) else ends
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_text = np.searchsorted(offsets, starts, "right") - 1
    keys = mix(span_hashes(data, starts, ends) ^ salt[line_text])
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[firsts] = False
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=len(n_words))
    twice = repeated(keys)
    line_chars = np.bincount(line_text[twice], leads[ends[twice]] - leads[starts[twice]], len(n_words))
    out["dup_line_share"] = share(line_chars)

    left = words.left()
    covers = {}
    for n in sorted({3, *rules.gram_chars}):
        grams = gram_hashes(hashes, n)
        at = np.flatnonzero(left[: len(grams)] >= n)
        at = at[repeated(mix(grams[at] ^ salt[text_of[at]]))]
        covers[n] = covered(at, n, len(hashes))
    out["n_repeat_words"] = text_sums(covers[3], words.offsets)
    for n in rules.gram_chars:
        out[f"dup_{n}gram_share"] = share(text_sums(np.where(covers[n], chars, 0), words.offsets))
    out["base_failed"] = (n_words < rules.least_words) | (out["n_repeat_words"] > rules.repeat_words * n_words)
    good = (out["dup_line_share"] <= rules.line_chars) & (out["n_symbols"] <= rules.symbols * n_words)
    for n, most in rules.gram_chars.items():
        good &= out[f"dup_{n}gram_share"] <= most
    out["kept"] = good & ~out["base_failed"]
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares, base_failed, kept.

    Words are runs of anything but ASCII white space. A null or empty text has no words and is not kept; rows that are there twice
    are judged alike; an empty table gives none; other columns are not read. Nothing is shuffled, and a task holds one slice of texts.
    """
    shares = ["dup_line_share", *(f"dup_{n}gram_share" for n in rules.gram_chars)]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measure(*text_bytes(batch.column("text")), rules)
            columns = [pa.array(found[c], pa.int64()) for c in counts] + [pa.array(found[c], pa.float64()) for c in shares]
            flags = [pa.array(found[c], pa.bool_()) for c in ("base_failed", "kept")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, *flags], ["id", *counts, *shares, "base_failed", "kept"])

    schema = ", ".join(["id long", *(f"{c} long" for c in counts), *(f"{c} double" for c in shares), "base_failed boolean", "kept boolean"])
    return docs.selectExpr(f"cast({id_col} as bigint) as id", f"{text} as text").mapInArrow(judge, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    Null and empty texts have no words and go; rows that are there twice are judged one by one, alike; an empty table gives none. A text is
    in its Arrow batch once.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(measure(*text_bytes(batch.column(text)), rules)["kept"]))

    return docs.mapInArrow(judge, docs.schema)
