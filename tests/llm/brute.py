"""Slow, plain versions of the operators, on lists of (id, text)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WHITE = r"[^\x20\x09-\x0D]+"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None, pattern: str = WHITE) -> list[str]:
    return re.findall(pattern, text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(rows: list[tuple], width: int = 200) -> list[tuple]:
    """id, bytes, mask of bytes to take out."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + width] for _, b in texts for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        out.append((i, b, gone))
    return out


def earlier(rows: list[tuple], window: int = 13) -> list[tuple]:
    """id, words, which to take out."""
    texts = [(i, words(t)) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    least: dict[tuple, tuple] = {}
    for i, ws in texts:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for i, ws in texts:
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if least[tuple(ws[p : p + window])] < rank(i):
                gone[p : p + window] = [True] * window
        out.append((i, ws, gone))
    return out


def shingles(text: str | None, size: int) -> set[tuple]:
    ws = words(lower(text or ""))
    return {tuple(ws[p : p + size]) for p in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def near(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """id, shingles, component, for each row."""
    sets = [shingles(t, size) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                    parent[y] = x
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def covered(ws: list[str], n: int) -> list[bool]:
    count = Counter(tuple(ws[p : p + n]) for p in range(len(ws) - n + 1))
    flags = [False] * len(ws)
    for p in range(len(ws) - n + 1):
        if count[tuple(ws[p : p + n])] > 1:
            flags[p : p + n] = [True] * n
    return flags


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    ws = words(text)
    chars = sum(map(len, ws))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    lines = [x for x in (text or "").split("\n") if words(x)]
    count = Counter(lines)
    line_chars = sum(len("".join(words(x))) for x in lines if count[x] > 1)
    repeat = sum(covered(ws, 3))
    base = len(ws) < 50 or 100 * repeat > 50 * len(ws)
    share = lambda n: sum(len(w) for w, c in zip(ws, covered(ws, n), strict=True) if c) / max(1, chars)
    kept = not base and line_chars / max(1, chars) <= 0.3 and symbols <= 0.1 * len(ws) and share(5) <= 0.4 and share(7) <= 0.35 and share(10) <= 0.3
    return len(ws), chars, symbols, len(lines) - len(count), repeat, base, kept


def hits(text: str | None, items: list[tuple], window: int = 10) -> tuple[list[re.Match], list[bool], set[str]]:
    """The words as matches, which of them are hit, and the items."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    found = list(re.finditer(pattern, lower(text or "")))
    ws = [m[0] for m in found]
    hit, names = [False] * len(ws), set()
    for name, item in items:
        iw = words(lower(item or ""), pattern)
        n = min(window, len(iw))
        windows = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if iw else set()
        for p in range(len(ws) - n + 1):
            if tuple(ws[p : p + n]) in windows:
                hit[p : p + n] = [True] * n
                names.add(name)
    return found, hit, names


def cut_items(text: str | None, items: list[tuple], most: float) -> str | None:
    """The text without hit words, or None if too many are."""
    found, hit, _ = hits(text, items)
    if sum(hit) > most * len(hit):
        return None
    out, at = "", 0
    runs = [k for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1])]
    for k in runs:
        end = next((j for j in range(k, len(hit)) if not hit[j]), len(hit)) - 1
        out += text[at : found[k].start()]
        at = found[end].end()
    return (text or "")[:0] + out + (text or "")[at:]


def coded(rows: list[tuple], parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[dict, list]:
    """rows: (id, vector, label), usable and with ids that differ. id -> (indexes, error); entries by part."""
    whole = sorted((i, [math.floor(256 * x) for x in v]) for i, v, _ in rows)
    width = len(whole[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [list(x) for x in zip(*[cut(v) for _, v in whole[:entries]], strict=True)]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held: dict[int, list] = {}
            for _, v in whole:
                held.setdefault(best(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(x) // len(held[k]) for x in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    found = {i: [best(x, books[p]) for p, x in enumerate(cut(v))] for i, v in whole}
    return {i: ([k for _, k in x], sum(d for d, _ in x)) for i, x in found.items()}, books


def collocations(rows: list[tuple], least: int, top: int, longest: int = 5) -> list[tuple]:
    """rows: (lang, text). lang, rank, phrase, a, l, r, n, score."""
    count: dict[str, Counter] = {}
    for lang, text in rows:
        own = count.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            own.update(tuple(ws[p : p + k]) for k in range(1, longest + 1) for p in range(len(ws) - k + 1))
    out = []
    for lang, own in count.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        heavy = {g: c for g, c in own.items() if len(g) > 1 and c >= least}
        inside = {(g[p : p + k], c) for g, c in heavy.items() for k in range(2, len(g)) for p in range(len(g) - k + 1)}
        found = []
        for g, a in heavy.items():
            if (g, a) not in inside:
                score, k = min((1000 * a * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out
