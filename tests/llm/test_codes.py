"""Vector codes, packed sequences and phrases against plain versions."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gistmill.llm import blobs, packing, phrases, vector_codes
from tests.llm import brute
from tests.llm.test_dedup import ordered

BPE = public_tokenizers.path("byte_bpe_50k.json")


def vectors(n: int = 300, size: int = 32) -> list[tuple]:
    """Few values, so that ties are common; copies of one vector make a third."""
    rng = random.Random(4)
    hot = [rng.choice((-0.3, 0.0, 0.1, 0.25)) for _ in range(size)]
    return [(7 * k % n - 20, hot if k % 3 == 0 else [rng.choice((-0.3, 0.0, 0.1, 0.25)) for _ in range(size)], None if k % 4 == 0 else k % 3) for k in range(n)]


def table(spark, rows):
    """With columns whose names clash with the operator's own."""
    full = [(i, v, label, "c", 1.5, b"x", 3, "e") for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, code string, error double, v binary, id int, part string").repartition(4)


def test_codes_equal_plain_rounds(spark):
    rows = vectors()
    bad = [(900, None, 1), (901, [0.1] * 31 + [None], 1), (902, [0.1] * 31 + [math.nan], 1), (903, [0.1] * 31 + [-math.inf], 1), (904, [], 1), (905, [0.5] * 16, 1), (906, [0.5] * 31, 1), (907, [1e30] * 32, 1), (-99, [0.5] * 17, 0)]
    want, books = brute.coded(rows)
    found, got = vector_codes.compress(table(spark, rows + bad))
    assert got.entries.tolist() == books
    found = {r["id"]: r for r in found.collect()}
    assert {i: (list(r["code"]), r["error"]) for i, r in found.items()} == want
    label = dict((i, x) for i, _, x in rows)
    for i, r in found.items():
        assert r["label"] == label[i] and r["label_error"] == sum(e for j, (_, e) in want.items() if label[j] == label[i])
    vector = vector_codes.decode(vector_codes.compress(table(spark, rows))[0], got).where("id = 0").first()
    assert vector["decoded"] == [(x + 0.5) / 256 for p, k in enumerate(want[0][0]) for x in books[p][k]]


def test_codes_of_repeated_and_null_ids(spark):
    """Rows that are there twice, null ids (last), fewer vectors than entries; and no usable vectors at all."""
    rows = [(1, [0.5, 1.0], 1), (1, [0.25, 1.0], 1), (1, [0.5, 1.0], 2), (None, [2.0, 3.0], None)]
    found, books = vector_codes.compress(table(spark, rows), parts=2)
    assert books.entries.tolist() == [[[64], [128], [128], [512]], [[256], [256], [256], [768]]]
    assert ordered((r["id"], list(r["code"]), r["error"], r["label_error"]) for r in found.collect()) == ordered([(1, [1, 0], 0, 0), (1, [0, 0], 0, 0), (1, [1, 0], 0, 0), (None, [3, 3], 0, 0)])
    for rows in ([], [(1, None, 1)]):
        found, books = vector_codes.compress(table(spark, rows) if rows else table(spark, vectors(3)).limit(0))
        assert books is None and found.count() == 0
        assert vector_codes.digest(found, books).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_labels_beyond_the_bound_are_joined_in_slices(spark, monkeypatch):
    coded = spark.createDataFrame([(k, None if k % 5 == 0 else f"l{k % 7}", k) for k in range(200)], "id long, label string, error long")
    want = ordered(map(tuple, vector_codes.with_label_errors(coded).collect()))
    monkeypatch.setattr(vector_codes, "SENT_LABELS", 0)
    assert ordered(map(tuple, vector_codes.with_label_errors(coded).collect())) == want and len(want) == 200


@pytest.mark.parametrize("spread", [3, 40, 1 << 23])
def test_trees_find_the_nearest_and_cut_off_subtrees(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (256, 4))
    queries = np.concatenate([points, rng.integers(-spread, spread + 1, (2000, 4))])
    best, index = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), 1 << 30)
    measured = vector_codes.Gnat(points, np.arange(256)).search(queries, best, index)
    far = vector_codes.squares(queries, points)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()
    assert measured < 0.7 * far.size


def test_pieces_are_binary_lengths(docs, given, empty, spark):
    library = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    want = []
    for i, t in given:
        tokens, at = np.array(ids(t), "<u4"), 0
        while at < len(tokens):
            size = min(1024, 1 << (len(tokens) - at).bit_length() - 1)
            want.append((i, at, size, tokens[at : at + size].tobytes(), len(tokens), 0))
            at += size
    assert ordered((r["id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"], r["offset"]) for r in got) == ordered(want)
    assert len({r["sequence_id"] for r in got}) == len(got)
    by_number = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert by_number == sorted(by_number)  # a bucket's sequences lie together
    assert ordered((r["doc_id"], r["ids_crc32"]) for r in packing.digest(packing.pack(docs, BPE)).collect()) == ordered((r["id"], zlib.crc32(r["ids"])) for r in got)
    assert packing.pack(empty, BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BPE, longest=1000)


def test_long_pieces_come_in_several_batches(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "some words of a text " * 3000), (2, "short")], "doc_id long, text string").coalesce(1)
    want = ordered(map(tuple, packing.pack(docs, BPE, longest=64).collect()))
    monkeypatch.setattr(packing, "BATCH_TOKENS", 100)
    assert ordered(map(tuple, packing.pack(docs, BPE, longest=64).collect())) == want
    packing.write_buckets(packing.pack(docs, BPE), str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.where(F.length("ids") != 4 * F.col("length")).count() == 0 and read.agg(F.sum("length")).first()[0] == sum(r[2] for r in want)


def test_encoder_equals_library():
    library = Tokenizer.from_file(BPE)
    with open(BPE, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    assert encoder.fast
    rng = random.Random(6)
    odd = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "1", "!", "é", "中", "　", "\x85", "\xa0", "<|endoftext|>", "<|endof", "the", "🙂"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 16))) for _ in range(5000)] + ["", " " * 300_000, "a" * 50_000, "x" + "\n " * 150_000]
    for text in texts:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for other in ("word_bpe_49k.json",):
        with open(public_tokenizers.path(other), encoding="utf-8") as file:
            encoder = packing.Encoder(file.read())
        assert not encoder.fast
        assert encoder.ids("Some words").tolist() == Tokenizer.from_file(public_tokenizers.path(other)).encode("Some words", add_special_tokens=False).ids


def talk(seed: int = 3) -> list[tuple]:
    """Few words, so that phrases repeat; a passage that is always whole, odd bytes that sort before the space, null languages and texts."""
    rng = random.Random(seed)
    ws = ["a", "B", "b\x01", "é", "ż", "the", "The", "of", "x-y", "中文", "ab", "aĀ"]
    rows = []
    for k in range(120):
        parts = [rng.choice(ws) if rng.random() < 0.9 else "once upon a long time ago there was" for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", " ", "\t ", ", ", ".", "\n", ";", "\x0b"]) for p in parts)
        rows.append((("en", "fr", None, "und")[k % 4], text))
    return rows + [("en", None), ("en", ""), (None, " \n"), ("fr", "single"), ("de", "rare words only"), ("en", "the a " * 300), *[("fr", "hot line of many words")] * 60]


def talk_table(spark, rows):
    full = [(lang, text, "w", 5, 1, b"r", "o") for lang, text in rows]
    return spark.createDataFrame(full, "lang string, text string, word string, n int, hash long, run binary, one string").repartition(5)


@pytest.mark.parametrize(("least", "top", "sent"), [(3, 2000, 1 << 21), (3, 7, 1 << 21), (2, 2000, 0), (60, 5, 5)])
def test_phrases_equal_plain_counts(spark, monkeypatch, least, top, sent):
    """Also with hashes in place of numbers (sent=0), with most words hot, so that sums come in parts, and with many buffers and buckets."""
    if least < 60:
        monkeypatch.setattr(blobs, "BUCKET_ENTRIES", 50)
        monkeypatch.setattr(phrases, "HOT_SHARES", 25)
        monkeypatch.setattr(phrases, "BUFFER", 300)
    rows = talk()
    got = phrases.phrases(talk_table(spark, rows), least, top, sent=sent).collect()
    assert ordered(map(tuple, got)) == ordered(brute.collocations(rows, least, top))
    assert phrases.phrases(talk_table(spark, rows).limit(0), least, top, sent=sent).count() == 0


@pytest.mark.parametrize("pair", [("of", "upon"), ("of", "rare")])
def test_words_of_one_hash_get_another_seed(spark, monkeypatch, pair):
    """If another word has a frequent word's hash, all are hashed anew."""
    rows = talk()
    given = talk_table(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    right, seeds = phrases.word_counts, []

    def poor(docs, seed):
        seeds.append(seed)
        found = right(docs, seed)
        return found.withColumn("hash", F.when(F.lit(seed < 2) & F.col("word").isin(*pair), F.lit(5)).otherwise(F.col("hash")))

    monkeypatch.setattr(phrases, "word_counts", poor)
    heavy, totals, seed = phrases.vocabulary(given, 3)
    assert seed == 2 and seeds == [0, 1, 2]
    assert heavy.groupBy("hash").count().where("count > 1").count() == 0
    assert {r["lang"]: r["total"] for r in totals.collect()} == {x[0]: x[6] for x in brute.collocations(rows, 1, 1)}


def test_scores_beyond_64_bits(spark):
    kept = spark.createDataFrame([(bytearray([1, 2]), 9_000_000_000_000, "en", 8_000_000_000_000_000)], "run binary, a long, lang string, n long")
    counts = spark.createDataFrame([(bytearray([1]), 9_000_000_000_001), (bytearray([2]), 9_100_000_000_000)], "run binary, f long")
    got = phrases.scored(kept, counts, 1).first()
    assert got["score"] == 1000 * 9_000_000_000_000 * 8_000_000_000_000_000 // (9_000_000_000_001 * 9_100_000_000_000)
