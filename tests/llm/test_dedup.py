"""Duplicate operators against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.llm import block_dups, near_dups, suffix_dups
from tests.llm import brute


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_suffixes(docs, given, empty):
    want = []
    for i, data, gone in brute.repeats(given):
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        want.append((i, len(data), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), brute.sha(kept)))
    assert ordered(suffix_dups.digest(suffix_dups.repeated_spans(docs)).collect()) == ordered(want)
    assert suffix_dups.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("width", [7, 40])
def test_suffixes_of_other_widths(spark, width):
    rows = [(k, ("abcab" * k + "xyz" * (k % 3) + "é" * k)) for k in range(30)]
    want = [(i, [k for k, g in enumerate(gone) if g]) for i, _, gone in brute.repeats(rows, width)]
    got = suffix_dups.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert ordered((r["id"], [k for a, b in zip(r["starts"], r["ends"]) for k in range(a, b)]) for r in got) == ordered(want)


def test_many_routes_and_buckets(spark, docs, given, monkeypatch):
    """Small routes and buckets, so that all meets go through the shuffle."""
    from gistmill.llm import blobs

    monkeypatch.setattr(blobs, "SLICE_BYTES", 4000)
    monkeypatch.setattr(blobs, "BUCKET_ENTRIES", 500)
    want = [(i, len(data), sum(gone)) for i, data, gone in brute.repeats(given)]
    assert ordered(suffix_dups.digest(suffix_dups.repeated_spans(docs)).select("doc_id", "n_bytes", "n_removed").collect()) == ordered(want)
    want = [(i, len(ws), sum(gone), brute.sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode())) for i, ws, gone in brute.earlier(given)]
    assert ordered(block_dups.digest(block_dups.earlier_passages(docs)).collect()) == ordered(want)


def test_left_texts(docs, given):
    got = suffix_dups.without_repeats(docs)
    assert got.columns == docs.columns
    want = []
    for (i, t), (_, data, gone) in zip(given, brute.repeats(given), strict=True):
        left = None if t is None else bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((i, left, None if t is None else len(left)))
    assert ordered(got.select("doc_id", "text", "n_chars").collect()) == ordered(want)


def test_passages(docs, given, empty):
    want = [(i, len(ws), sum(gone), brute.sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode())) for i, ws, gone in brute.earlier(given)]
    assert ordered(block_dups.digest(block_dups.earlier_passages(docs)).collect()) == ordered(want)
    assert block_dups.earlier_passages(empty).count() == 0
    with pytest.raises(ValueError):
        block_dups.earlier_passages(docs, window=12)


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (2, 60)])
def test_near_duplicates(docs, given, size, percent):
    got = near_dups.near_duplicates(docs, size, percent).select("id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute.near(given, size, percent))


def test_no_documents(empty):
    assert near_dups.near_duplicates(empty).count() == 0


def test_hot_groups(spark, monkeypatch):
    """Groups above the limit are refined by later chunks; chains of edits need links between members other than the first."""
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        ws = list(base)
        for j in range(k % 8):
            ws[(13 * j + k) % 120] = f"e{k}x{j}"
        rows.append((k, " ".join(ws)))
    monkeypatch.setattr(near_dups, "HOT", 4)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).select("id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(brute.near(rows, 4, 80))


def test_signature_bounds():
    """The bound on errors is exceeded by pairs at the threshold with chance 1e-6."""
    assert near_dups.most_errors(0.8) == 24 and near_dups.most_errors(0.8, near_dups.SKETCH) < 90


def test_hot_groups_keep_pairs_of_one_chunk(spark, monkeypatch):
    """Pairs that agree in one early chunk only are found in a large group as well, in blocks that hold at most half the limit of each side."""
    rng = np.random.default_rng(1)
    sigs = rng.integers(0, 1 << 16, (15, near_dups.SYMBOLS)).astype(np.uint16)
    sigs[:, : near_dups.CHUNK] = 7
    classes = spark.createDataFrame([(k, 50, bytearray(s.tobytes())) for k, s in enumerate(sigs)], "id long, n long, sig binary")
    sketched = spark.createDataFrame([(k, bytearray(near_dups.SKETCH)) for k in range(15)], "id long, sketch binary")
    labels = spark.createDataFrame([(k, 3) for k in range(3, 12)], "node long, label long")
    monkeypatch.setattr(near_dups, "HOT", 4)
    shared = near_dups.shared_keys(classes.select("id", "sig"))
    pairs = [tuple(r) for r in near_dups.across(shared, labels, classes, sketched, 0.8).collect()]
    assert near_dups._forest(*np.array(pairs).reshape(-1, 2).T)[1].tolist() == list(range(1, 15))
    blocks = near_dups._blocks(shared.join(labels.withColumnRenamed("node", "id"), "id", "left").fillna({"label": -1}).withColumn("m", F.lit(15).cast("bigint")))
    counts = blocks.groupBy("key", "block", "side").count()
    assert counts.select("block").distinct().count() > 8 and blocks.where(f"side = {near_dups.FREQUENT}").select("id").distinct().count() == 9


@pytest.mark.parametrize("span", [1, 2, 3, 8, 169])
def test_anchors_are_the_least_of_their_windows(monkeypatch, span):
    """In routes of any size by the upper bits of identifiers alone, first ones of ties."""
    values = np.random.default_rng(span).integers(0, 2**64, 700, dtype=np.uint64)
    values[::3] &= np.uint64((1 << 40) - 1)  # many ties above the lower 24 bits of a few values
    want = [p + int((values[p : p + span] >> np.uint64(24)).argmin()) for p in range(len(values) - span + 1)]
    assert suffix_dups._least(values, span).tolist() == want
    monkeypatch.setattr(np, "minimum", None)  # the other way, for longer routes
    big = np.concatenate([values, np.full(1 << 24, (1 << 64) - 1, np.uint64)])
    assert suffix_dups._least(big, span)[: len(want)].tolist() == want
