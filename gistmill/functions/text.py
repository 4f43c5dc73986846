"""Text columns: cleaning, words, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions.arrays import let

# Whitespace as Unicode text defines it (Java's own \s is narrower), punctuation, word characters.
SPACE = r"\x09-\x0d\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
ASCII_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f]"
RARE_SPACE = SPACE.replace(r"\x09-\x0d\x1c-\x20", r"\x1c-\x1f")
PUNCT = r"\p{Punct}"
WORD = r"[\p{L}\p{N}_]{2,}"


def strip_header(c: Column) -> Column:
    at = F.instr(c, "\n\n")
    return F.when(at > 0, c.substr(at + 2, F.length(c))).otherwise(c)


def strip_quoted(c: Column) -> Column:
    kept = F.filter(F.split(c, "\n", -1), lambda x: ~(x.startswith(">") | x.startswith(":")))
    return F.array_join(kept, "\n")


def strip_emails(c: Column) -> Column:
    # A match always spans a whole blank-free run, so anchoring at its start keeps the scan linear. Java tests
    # the long whitespace class slowly; the short one decides the same unless rare blanks occur.
    fast = F.regexp_replace(c, r"(?<!\S)(?:[^\s@]++@|@\S*@)\S+", "")
    full = F.regexp_replace(c, rf"(?<![^{SPACE}])(?:[^{SPACE}@]++@|@[^{SPACE}]*@)[^{SPACE}]+", "")
    return F.when(~c.contains("@"), c).when(c.rlike(f"[{RARE_SPACE}]"), full).otherwise(fast)


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, rf"http[^{SPACE}]+|www\.[^{SPACE}]+", "")


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, PUNCT, "")


def squash_lower(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, f"[{SPACE}]+", " ")))


def clean_basic(c: Column) -> Column:
    """Header, quoted lines, emails, URLs and punctuation off, blanks squashed, lower case.

    Emails and URLs are runs without blanks, so every blank may become a plain space first; then one pass over the
    text finds emails (at the start of a run), URLs and punctuation, and removes the same as one pass for each.
    """
    body = strip_quoted(strip_header(c))
    # Plain ASCII text, told by its byte length, has few kinds of blank and takes the faster way.
    plain = F.regexp_replace(body, ASCII_SPACE, " ")
    c = F.when(F.octet_length(c) == F.length(c), plain).otherwise(F.translate(body, SPACE_CHARS, " " * len(SPACE_CHARS)))
    c = F.regexp_replace(c, r"(?<![^ ])(?:[^ @]++@|@[^ ]*@)[^ ]+|http[^ ]+|www\.[^ ]+|\p{Punct}", "")
    return F.lower(F.trim(F.regexp_replace(c, " {2,}", " ")))


def words(c: Column) -> Column:
    """Split on whitespace, no empty parts."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda x: x != "")


def _in(x: Column, items: Sequence[str]) -> Column:
    return x.isin(list(items)) if items else F.lit(False)


def remove_stopwords(c: Column, stop: Sequence[str]) -> Column:
    return F.array_join(F.filter(words(c), lambda x: ~_in(x, stop)), " ")


def truncate_words(c: Column, max_words: int = 512, position: str = "start") -> Column:
    def cut(w: Column) -> Column:
        start = F.lit(1) if position == "start" else F.size(w) - max_words + 1
        return F.when(F.size(w) <= max_words, c).otherwise(F.array_join(F.slice(w, start, max_words), " "))

    return let(words(c), cut)


def sliding_segments(c: Column, window: int = 512, stride: int = 256, min_words: int = 10) -> Column:
    """array<string>: overlapping word windows; short tails end the list."""

    def cut(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w), F.lit(stride)), lambda i: F.size(w) - i >= min_words)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, window), " "))

    return let(words(c), cut)


def custom_preprocess(c: Column, stop_substrings: Sequence[str]) -> Column:
    c = F.lower(c)
    for part in stop_substrings:
        c = F.replace(c, F.lit(part), F.lit(" "))
    return c


def terms(c: Column, stop: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """Lower-cased word tokens without stop words, then n-grams over what remains."""

    def ngrams(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: i + n <= F.size(t))
        # Element access is constant-time, where slice would copy the array for every n-gram.
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(n)]))

    def grams(t: Column) -> Column:
        return F.concat(*[ngrams(t, n) for n in range(ngram_range[0], ngram_range[1] + 1)])

    tokens = F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), lambda x: ~_in(x, stop))
    return let(tokens, grams)
