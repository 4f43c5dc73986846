"""Quality rules, decontamination, shards and licences against plain versions."""

import hashlib
import random
import re
import textwrap
from importlib import resources

import pytest

from gistmill.llm import decontaminate, licences, quality, shards
from tests.llm import brute
from tests.llm.test_dedup import ordered


def test_quality(docs, given, empty):
    got = quality.quality_rules(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert ordered(got) == ordered((i, *brute.quality(t)) for i, t in given)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert ordered(kept.select("doc_id", "text").collect()) == ordered((i, t) for i, t in given if brute.quality(t)[-1])
    assert quality.quality_rules(empty).count() == 0


def items_of(given):
    long = next(t for i, t in given if i == 20)
    part = " ".join(long.split()[30:55])
    return [(1, part), (2, part.upper() + " and more"), (3, None), (4, ""), (5, "two words"), (5, "two words"), (6, " ".join(long.split()[40:52])), (None, "ing the"), (7, "!?")]


def test_decontamination(spark, docs, given, empty):
    items = items_of(given)
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in given:
        found, hit, names = brute.hits(t, items)
        named = sorted(str(n) for n in names if n is not None)
        want.append((i, len(found), sum(hit), len(named), brute.sha(",".join(named).encode()), sum(hit) > 0))
    assert ordered(decontaminate.digest(decontaminate.decontaminate(docs, frame)).collect()) == ordered(want)
    left = decontaminate.without_items(docs, frame, 0.5)
    assert left.columns == docs.columns
    want = [(i, None if t is None else brute.cut_items(t, items, 0.5)) for i, t in given if t is None or brute.cut_items(t, items, 0.5) is not None]
    assert ordered(left.select("doc_id", "text").collect()) == ordered(want)
    assert decontaminate.decontaminate(empty, frame).count() == 0
    none = decontaminate.decontaminate(docs, frame.limit(0)).collect()
    assert len(none) == len(given) and not any(r["n_hit"] for r in none)


def test_several_automata(spark, docs, given, monkeypatch):
    items = items_of(given)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).select("id", "n_hit").collect()
    assert ordered(got) == ordered((i, sum(brute.hits(t, items)[1])) for i, t in given)


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("parts", [16, 1 << 14])
def test_items_beyond_the_bound(spark, docs, given, empty, monkeypatch, short, parts):
    """Texts that meet the blocks by a join are judged as by automata that are sent, with and without items shorter than a window, and items in parts."""
    items = [x for x in items_of(given) if short or not x[1] or len(x[1].split()) > 10]
    frame = spark.createDataFrame(items, "item_id long, text string")
    sent = decontaminate.decontaminate(docs, frame).collect()
    monkeypatch.setattr(decontaminate, "SENT_BYTES", 0)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontaminate, "PART_WORDS", parts)
    monkeypatch.setattr(decontaminate, "automata", None)
    assert ordered(decontaminate.decontaminate(docs, frame).collect()) == ordered(sent)
    assert any(r["n_hit"] for r in sent)
    left = decontaminate.without_items(docs, frame, 0.5)
    want = [(i, None if t is None else brute.cut_items(t, items, 0.5)) for i, t in given if t is None or brute.cut_items(t, items, 0.5) is not None]
    assert ordered(left.select("doc_id", "text").collect()) == ordered(want)
    assert decontaminate.decontaminate(empty, frame).count() == 0


def test_several_anchors_in_first_words(spark, monkeypatch):
    """Items in blocks of their own are all found where the words around their anchors begin with the text."""
    words = "a b c d e f g h i j k l a b c d a b c d".split()
    items = [(k, " ".join(words[k : k + 5])) for k in range(0, 8, 2)] + [(9, "a b c d")]
    texts = [(1, " ".join(words)), (2, " ".join(words[2:9])), (3, "a b c d"), (4, "b c d")]
    frame, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "SENT_BYTES", 0)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2)
    got = decontaminate.decontaminate(docs, frame).select("id", "n_hit", "items").collect()
    want = [(i, sum(hit), sorted(str(n) for n in names)) for i, t in texts for _, hit, names in [brute.hits(t, items)]]
    assert ordered((r["id"], r["n_hit"], r["items"]) for r in got) == ordered(want)


def split(rows, limit, depth=0):
    """Buckets of (hash, bytes) rows, as (prefix, depth)."""
    if sum(b for _, b in rows) <= limit or depth == shards.BITS:
        return [(rows[0][0] >> (shards.BITS - depth), depth, rows)] if rows else []
    bit = lambda h: h >> (shards.BITS - depth - 1) & 1
    return [x for k in (0, 1) for x in split([r for r in rows if bit(r[0]) == k], limit, depth + 1)]


def test_shards_of_odd_tables(docs, given, empty):
    frame = shards.sharded(docs, 60_000)
    assert sorted(frame.columns) == sorted(docs.columns)  # an old column of the name gives way
    assert ordered(frame.select("doc_id", "text").collect()) == ordered(given)
    assert shards.sharded(empty).count() == 0


def test_shards_split_and_chain(spark, tmp_path):
    rows = [(k, "x" * (k % 50)) for k in range(400)] + [(7, "y" * 40)] * 30 + [(8, "z" * 90)] * 3 + [(None, "n" * 20)] * 20 + [(9, None)]
    frame = shards.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100)
    got = frame.select("doc_id", "shard.*").collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        sums.setdefault((r["prefix"], r["depth"], r["chain"]), []).append(r["n_bytes"])
    assert all(sum(v) <= 100 for v in sums.values())
    single = [(k, t) for k, t in rows if k is not None and k not in (7, 8, 9)]
    code = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
    want = {h: (p, d) for p, d, part in split([(code(k), len((t or "").encode())) for k, t in rows], 100) for h, _ in part}
    assert all((r["prefix"], r["depth"]) == want[code(r["doc_id"])] for r in got if r["doc_id"] in {k for k, _ in single})
    shards.write_shards(frame, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).select("shard_name").distinct().count() == len(sums)
    assert ordered(spark.read.parquet(str(tmp_path / "s")).select("doc_id", "text").collect()) == ordered(rows)


def test_chained_rows_of_shuffled_joins(spark, tmp_path, monkeypatch):
    """Rows that no bit parts are all there where the directory is joined by a shuffle and the two plans of its rows have different partitions."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=600)), j) for k in range(200) for j in range(3)] + [(None, "n" * 300, j) for j in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, j long").repartition(8).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(shards, "SENT_CELLS", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = shards.sharded(spark.read.parquet(str(tmp_path / "docs")), 1000).select("doc_id", "text", "j", "shard.*").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert ordered((r["doc_id"], r["text"], r["j"]) for r in got) == ordered(rows)
    sums = {}
    for r in got:
        key = (r["prefix"], r["depth"], r["chain"])
        sums[key] = sums.get(key, 0) + r["n_bytes"]
    assert max(sums.values()) <= 1000


def plain(text):
    """Canonical words of a text of ASCII."""
    text = "\n".join(x for x in brute.lower(text or "").split("\n") if not re.match(r"[ \t*#/;-]*(copyright|\(c\)|all rights reserved)", x))
    text = " ".join(re.sub(r"[^a-z0-9]+", " ", text).split())
    for a, b in (("licence", "license"), ("favour", "favor"), ("non commercial", "noncommercial"), ("https", "http")):
        text = re.sub(rf"\b{a}\b", b, text)
    return re.sub(r"\bv(?:ersion)? ?(\d)\b", r"version \1", text)


def test_licences(spark, docs, given, empty):
    mit, name = licences.KNOWN[6][1], licences.KNOWN[6][0]
    wrapped = re.sub(r"(\S+ \S+ \S+) ", r"\1\n", mit).upper()
    rows = [
        (1, mit), (2, f"Copyright (c) 2020 Someone\nAll rights reserved.\n\n{wrapped}"), (3, mit + " more"), (4, "Licensed under the Apache Licence v2.0"), (5, None), (6, ""),
        (7, "Text first.\nReleased under the MIT licence!\nthen\n  licensed under CC BY-NC 4.0\nReleased under the MIT License."), (7, "Released under the MIT License."), (8, "© 2020"),
    ]
    digests = licences.known_digests(spark)
    got = {(r["id"], r["licence"], r["licence_lines"], tuple(r["line_licences"])) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"), digests).collect()}
    assert got == {
        (1, name, 0, ()), (2, name, 0, ()), (3, None, 0, ()), (4, "Apache-2.0", 1, ("Apache-2.0",)), (5, None, 0, ()), (6, None, 0, ()),
        (7, None, 3, ("CC-BY-NC-4.0", "MIT")), (7, "MIT", 1, ("MIT",)), (8, None, 0, ()),
    }
    known = {plain(t) for _, t in licences.KNOWN}
    assert {i for i, t, *_ in got if t} == {i for i, t in rows if plain(t) in known}
    assert licences.licence_scan(docs, digests).count() == len(given)
    assert licences.licence_scan(empty, digests).count() == 0
    assert licences.licence_scan(docs, digests.limit(0)).where("licence is not null").count() == 0


def test_whole_licences(spark):
    """One whole text of each public licence that is packaged, in other case and line breaks, and without the advice after the terms."""
    read = lambda n: resources.files("gistmill.llm").joinpath("licence_texts", f"{n}.txt").read_text("utf-8")
    want = [(n, read(n)) for n in licences.WHOLE] + [("GPL-2", read("GPL-2").split("END OF TERMS")[0]), ("Apache-2.0", read("Apache-2.0").upper().replace("  ", "\t "))]
    want = [(licences.WHOLE[n], t) for n, t in want]
    bsd = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIRD
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    want += [("BSD-3-Clause", bsd.replace("THIRD", third)), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + bsd.replace("THIRD\n", "")), ("BSD-3-Clause", read("BSD"))]
    want += [(n, f"{n} License\n\nCopyright (c) 2020 Someone\n\n{t}") for n, t in licences.KNOWN[6:]] + [(None, read("GPL-3") + " and more")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(want)], "doc_id long, text string")
    got = {r["id"]: r["licence"] for r in licences.licence_scan(docs, licences.known_digests(spark)).collect()}
    assert [(k, got[k]) for k in range(len(want))] == [(k, n) for k, (n, _) in enumerate(want)]


def test_wrapped_licences(spark):
    """Every known text, its paragraphs wrapped at widths that put "copyright" first in lines of terms, and owners over two lines."""
    rows, want = [], {}
    for licence, text in licences.KNOWN + licences.whole_texts():
        for width in [*range(40, 121, 8), 50, 61, 62, 81, 82, 117]:
            parts = (textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n[ \t]*\n", text))
            want[len(rows)] = licence
            rows.append((len(rows), "\n\n".join(parts)))
    mit = licences.KNOWN[6][1]
    for owner in ("Copyright 2020 Someone", "Copyright: 2020, Someone", "(c) 1999 A\n(c) 2001 B", "Copyright (c) 2020 A long\nname of some owner. All rights\nreserved.", "Copyright [2020] [A]", "All rights reserved."):
        want[len(rows)] = "MIT"
        rows.append((len(rows), f"{owner}\n\n{mit}"))
    for other in (f"Copyright law holds.\n\n{mit}", f"{mit}\nCopyright holders may add terms."):
        want[len(rows)] = None
        rows.append((len(rows), other))
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_digests(spark)).collect()
    assert {r["id"]: r["licence"] for r in got} == want
