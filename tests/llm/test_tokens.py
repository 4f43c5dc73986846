"""Token counts, pieces and page texts against the libraries and against round trips."""

import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gistmill.llm import html_text, merges, pieces, token_counts
from gistmill.llm.words import text_bytes
from tests.llm.test_dedup import ordered

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["'", "s", "t", "re", "r", "e", "v", "m", "l", "ll", "d", " ", "  ", "\n", "\t", "a", "1", "2", "!", "?", "é", "中", " ", "　", "<|endoftext|>", "<|endof", "▁", "the", "🙂", "<s>", "."]


def odd_texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, "", " ", "a" * 3000, " " * 100, "!?" * 200, "the" * 400, "<|endoftext|>" * 3]


def test_counts(docs, given, empty):
    library = Tokenizer.from_file(BPE)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, BPE).collect()
    assert ordered(got) == ordered((i, len((t or "").encode()), count(t)) for i, t in given)
    assert token_counts.token_counts(empty, BPE).count() == 0
    texts = odd_texts(1, 20_000)
    with open(BPE, encoding="utf-8") as file:
        found = token_counts.count(*text_bytes(pa.array(texts, pa.string())), token_counts.Vocabulary(file.read()))
    assert found.tolist() == [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_character_class():
    library = Tokenizer.from_file(BPE)
    texts = [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    with open(BPE, encoding="utf-8") as file:
        found = token_counts.count(*text_bytes(pa.array(texts)), token_counts.Vocabulary(file.read()))
    assert found.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_in_chunks(monkeypatch):
    """Marks don't depend on where chunks are cut."""
    kinds = np.random.default_rng(3).integers(0, 11, 5000).astype(np.uint8)
    want = token_counts.transduce(kinds)
    for size in (1, 7, 5000):
        monkeypatch.setattr(token_counts, "CHUNK_CHARS", size)
        assert (token_counts.transduce(kinds) == want).all()


def test_transducer_over_bytes(given, monkeypatch):
    """Transitions give the library's counts, also when the kept ones run out within long pre-tokens."""
    library = Tokenizer.from_file(BPE)
    rng = random.Random(9)
    texts = [t or "" for _, t in given] + ["".join(rng.choice("aeinorst") for _ in range(size)) for size in (1, 40, 3000)] + ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(900)), "-" * 999]
    texts += ["".join(rng.choice("  \n=-aé") for _ in range(30)) for _ in range(500)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(BPE, encoding="utf-8") as file:
        vocabulary = token_counts.Vocabulary(file.read())
    assert token_counts.count(*text_bytes(pa.array(texts)), vocabulary).tolist() == want
    monkeypatch.setattr(token_counts, "PLACES", 1 << 11)
    monkeypatch.setattr(token_counts, "TOGETHER", 200)
    vocabulary._clear()
    assert token_counts.count(*text_bytes(pa.array(texts)), vocabulary).tolist() == want
    assert vocabulary.taken <= 1 << 10


def test_pieces(docs, given, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES).select("id", "ids", "decoded").collect()
    assert ordered((r["id"], r["ids"], r["decoded"]) for r in got) == ordered((i, library.encode(t or ""), t or "") for i, t in given)
    assert pieces.encode_pieces(empty, PIECES).count() == 0
    trips = pieces.round_trips(docs, PIECES).collect()
    assert len(trips) == len(given) and all(r["round_trip"] for r in trips)
    with open(PIECES, "rb") as file:
        model = pieces.Model(file.read())
    texts = odd_texts(2, 20_000)
    ids, offsets = model.encode(*text_bytes(pa.array(texts, pa.string())))
    want = library.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert model.decode(ids, offsets) == library.decode(want)


def test_compatible_pieces(docs, given, monkeypatch):
    """One unit of any length and many of one length give the library's ids, also when few pairs are remembered."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(merges, "PAIRS", 64)
    with open(PIECES, "rb") as file:
        model = pieces.Model(file.read())
    rng = random.Random(8)
    letters = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 90))) for _ in range(3000)] + ["".join(rng.choice("aeinorstxé中") for _ in range(20_000))]
    texts = letters + [t or "" for _, t in given] + [f"{a}{b}" for a in model.names[300:3000:50] for b in model.names[400:3000:60]]
    want = library.encode(texts)
    for few in (0, 24, 1 << 40):
        monkeypatch.setattr(pieces, "FEW", few)
        some = [k for k in range(len(texts)) if few or len(texts[k]) < 2000]
        ids, offsets = model.encode(*text_bytes(pa.array([texts[k] for k in some])))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [want[k] for k in some]
    parts = np.array(sorted(model.by_name.values()), np.int64)
    left, right = np.random.default_rng(4).choice(parts, (2, 3000))
    fits = model.pairs.apart(left, right)
    assert [model.pairs.pair_apart(a, b) for a, b in zip(left.tolist(), right.tolist())] == fits.tolist()
    inner = [k for k in range(3000) if model.names[right[k]][0] != "▁" and model.names[left[k]][0] == "▁"]
    joined = library.encode([(model.names[left[k]] + model.names[right[k]])[1:].replace("▁", " ") for k in inner])
    assert [ids == [left[k], right[k]] for k, ids in zip(inner, joined)] == [fits[k] for k in inner]


def message(field: int, body: bytes) -> bytes:
    size, out = len(body), b""
    while True:
        out += bytes([size & 0x7F | (0x80 if size > 0x7F else 0)])
        size >>= 7
        if not size:
            return bytes([field << 3 | 2]) + out + body


@pytest.mark.parametrize("fallback", [True, False])
def test_viterbi(fallback):
    """A unigram model put together by hand from public pieces, with scores that don't tie."""
    with open(PIECES, "rb") as file:
        names = pieces.Model(file.read()).names
    rng = random.Random(5)
    parts = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    parts += [(n, -1 - 12 * rng.random(), 1) for n in dict.fromkeys([*(n for n in names[259:6000] if n.lstrip("▁")), "▁"])]
    raw = b"".join(message(1, message(1, n.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for n, s, k in parts)
    raw += message(2, b"\x18\x01" + (b"\x98\x02\x01" if fallback else b"")) + message(3, message(1, b"identity") + b"\x18\x01\x20\x00")
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Model(raw)
    texts = [t for t in odd_texts(6, 4000) if t is None or "aaa" not in t]
    ids, offsets = model.encode(*text_bytes(pa.array(texts, pa.string())))
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    want = library.encode([t or "" for t in texts])
    worth = lambda row: sum(np.float64(library.get_score(i)) for i in row)
    assert sum(g != w for g, w in zip(got, want)) <= 4  # sums that are equal but for rounding
    assert all(abs(worth(g) - worth(w)) < 1e-3 for g, w in zip(got, want))


def page(rng: random.Random, depth: int, words: list[str], shown: bool) -> str:
    """Random markup; words that can be seen are gathered in order."""
    out = ""
    for _ in range(rng.randint(1, 3)):
        word = f"w{rng.randint(0, 9999)}"
        kind = rng.choice(["text", "p", "div", "b", "ul", "hidden", "script", "table", "pre"] if depth else ["text"])
        inner = lambda ok=True: page(rng, depth - 1, words, shown and ok)
        if kind == "text":
            out += f" {word} "
            if shown:
                words.append(word)
        elif kind == "p":
            out += f"<P>{inner_text(rng, words, shown)}" + rng.choice(["", "</p>"])
        elif kind in ("div", "b"):
            out += f"<{kind}>{inner()}</{kind}>"
        elif kind == "ul":
            out += "<ul>" + "".join(f"<li>{item(rng, words, shown)}" + rng.choice(["", "</li>"]) for _ in range(2)) + "</ul>"
        elif kind == "hidden":
            out += rng.choice(["<div style='color:red; display : none'>", "<div hidden>"]) + inner(False) + "</div>"
        elif kind == "script":
            out += f"<script>if (a<b) '{word}'</script><!-- {word} -->"
        elif kind == "table":
            out += "<table>" + "".join("<tr>" + "".join(f"<td>{inner_text(rng, words, shown)}" for _ in range(2)) for _ in range(2)) + "</table>"
        else:
            out += f"<pre>{inner_text(rng, words, shown)}</pre>"
    return out


def item(rng: random.Random, words: list[str], shown: bool) -> str:
    """A list item's text; its mark is seen before it."""
    if shown:
        words.append("-")
    return inner_text(rng, words, shown)


def inner_text(rng: random.Random, words: list[str], shown: bool) -> str:
    some = [f"v{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 3))]
    if shown:
        words.extend(some)
    return " ".join(some)


def test_pages_keep_all_that_is_seen(spark):
    rng, pages, want = random.Random(8), [], {}
    for k in range(300):
        words: list[str] = []
        pages.append((k, f"<!DOCTYPE html><html><head><title>t</title></head><body>{page(rng, 4, words, True)}"))
        want[k] = words
    got = html_text.html_text(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {r["id"]: r["text"].replace(" | ", " ").split() for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) and r["n_lines"] == len(r["text"].splitlines()) for r in got)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, None), ("", ""), ("a < b &amp; c", "a < b & c"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<hr>c", "a\nb\n\nc"), ("<div>a</div>b", "a\nb"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<ol><li>a<li>b</ol>", "1. a\n2. b"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<table><tr><th>A<th>Long<tr><td>wide cell<td>2</table>", "A         | Long\nwide cell | 2"), ("<tr><td>x</td></tr>", "x"), ("</p>a</div>", "a"),
        ("<blockquote>q<br>r</blockquote>", "  q\n  r"), ("<img alt='pic'> <span hidden>no</span><template>no</template>yes", "pic yes"), ("<html hidden><body>x", ""),
        ("<h1>T<h2>U</h2>v", "T\n\nU\n\nv"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<div>" * 5000 + "deep", "deep"), ("<a <b>x", "x"), ("<table><td>a</td>stray</table>", "stray\na"),
        ("<ul><li><p>a<p>b<li>c</ul>", "- a\n\n  b\n\n- c"), ("<ol start=4><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"), ("<ol start=x><li>a</ol>", "1. a"),
        ("<details><summary>s</summary>no<p>no</details>yes", "s\nyes"), ("<details open><summary>s</summary>a</details>", "s\na"), ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
    ],
)
def test_layout(html, want):
    assert html_text.extract(html) == want


def test_odd_page_tables(spark):
    frame = spark.createDataFrame([(1, "<p>a", 2, "t"), (1, "<p>a", 2, "t"), (None, None, None, None)], "page_id long, html string, id int, text string")
    assert ordered(r[:2] for r in html_text.html_text(frame).collect()) == ordered([(1, "a"), (1, "a"), (None, None)])
    assert html_text.html_text(frame.limit(0)).count() == 0


def test_wide_cells_fill_no_rows():
    """One very long cell above a thousand short rows: the text grows with the page."""
    text = html_text.extract("<table><tr><td>" + "x" * 100_000 + "<td>y" + "<tr><td>a<td>b" * 1000 + "</table>")
    assert len(text) < 130_000 and text.startswith("x" * 100_000 + " | y\na | b\n")


def test_deep_pages():
    """Below hundreds of open elements, hidden text stays hidden, tables and lists keep their shape, end tags find their own element; a visible bar stays."""
    inner = "<script>var x</script><div hidden>no<div>no</div>no</div><style>no</style><table><tr><td>a</td><td>b|</td><td></td></tr></table><ul><li>c</li></ul>"
    for tag in ("span", "div", "font"):
        assert html_text.extract(f"<{tag}>" * 300 + inner) == "a | b|\n\n- c"
    assert html_text.extract("<div>" * 20_000 + "seen") == "seen"
    assert html_text.extract("<div hidden>" + "<span>" * 300 + "<div>x</div>no</div>yes") == "yes"
