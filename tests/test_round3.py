"""What the findings of the third round asked for, on rows of the tests' own."""

import numpy as np
import pandas as pd
import pytest

from gistmill.operators import clusters as cl
from gistmill.operators import features
from gistmill.operators import labelling as lb
from gistmill.operators import neighbours as nb
from gistmill.operators import topics as tp
from gistmill.operators.clean import lemmatize
from gistmill.registry import all_queries


def documents(spark, path, n=40):
    words = ["apples", "apple", "trees", "tree", "boat", "boats", "river", "stone", "glass", "moon"]
    rows = [(i, " ".join(words[(i * 7 + j * j) % 10] for j in range(20 + i % 5)), "en", f"src{i % 20}", 100) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_written_vectors_are_whole(spark, tmp_path):
    """each place of each vector is compared."""
    rows = all_queries()["write_embeddings"](spark, documents(spark, tmp_path)).collect()
    assert len(rows) == 40 * 64
    assert {(r["doc_id"], r["d"]) for r in rows} == {(i, d) for i in range(40) for d in range(64)}


def blocks(n=2600, width=8, seed=1):
    v = np.random.default_rng(seed).standard_normal((2 * n, width))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [pd.DataFrame({"id": np.arange(i * n, i * n + n), "v": list(v[i * n : i * n + n]), "label": np.arange(n) % 3}) for i in range(2)]


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_rows_of_a_block_are_found_in_slices(metric):
    """A task never holds the whole matrix of a block pair."""
    q, b = blocks()
    got, peak = peak_mb(lambda: nb._topk_kernel(4, metric, False, False)(q, b))
    d = 1 - np.stack(q["v"]) @ np.stack(b["v"]).T if metric == "cosine" else np.sqrt(nb._sq_distances(np.stack(q["v"]), np.stack(b["v"])))
    assert (got["nbr"].to_numpy().reshape(-1, 4) == b["id"].to_numpy()[np.argsort(d, axis=1)[:, :4]]).all()
    assert peak < 100


def test_links_of_a_block_are_found_in_slices():
    """components of a block pair without a matrix of labels."""
    q, b = blocks()
    got, peak = peak_mb(lambda: cl._reach_kernel(0.25, "euclidean")(q, b))
    near = np.sqrt(nb._sq_distances(np.stack(q["v"]), np.stack(b["v"]))) <= 0.25
    parent = list(range(2 * len(q)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        x, y = sorted((find(i), find(j + len(q))))
        parent[y] = x
    assert {(u, v) for u, v in zip(got["u"], got["v"])} == {(i, find(i)) for i in range(len(parent)) if find(i) != i}
    assert peak < 100


def test_wide_blocks_give_the_same_profile(spark):
    """a larger base is met in fewer, larger blocks, with the same sums."""
    v = np.random.default_rng(2).standard_normal((300, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    wide = {r["id"]: r for r in nb.pairwise_cosine(df, small_rows=0).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    sim = u @ u.T - np.eye(300) * (u @ u.T)
    assert len(wide) == 300
    for i, r in wide.items():
        assert r["others"] == 299 and abs(r["mean_sim"] - sim[i].sum() / 299) < 1e-12


def watched(df, col):
    """``df`` with ``col`` passed through a function that counts its rows."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def same(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(same, df.schema), seen


@pytest.mark.parametrize("name", ["topic_similarity", "reduce_topics", "keyword_labeller"])
def test_weights_are_read_once(spark, name):
    """Costly weights are not made again for each reader."""
    weights, seen = watched(spark.createDataFrame([(t, f"w{(t * j) % 7}", 0.1 + j) for t in range(-1, 5) for j in range(4)], "topic int, term string, weight double"), "weight")
    if name == "topic_similarity":
        rows = tp.topic_similarity(weights).collect()
        assert len(rows) == 10
    elif name == "reduce_topics":
        docs = spark.createDataFrame([(i, i % 6 - 1) for i in range(30)], "doc_id long, topic int")
        assert tp.reduce_topics(docs, weights, 3).count() == 30
    else:
        profiles = spark.createDataFrame([("a", "w0", 1.0), ("b", "w1", 1.0)], "category string, term string, u double")
        assert lb.keyword_labeller(weights, profiles).count() == 5
    assert seen.value == 24


def test_documents_are_counted_once(spark):
    """counts are written, so that the documents behind them are read once."""
    docs, seen = watched(spark.createDataFrame([(i, i % 3, ["a", "b", f"c{i % 5}"]) for i in range(30)], "doc_id long, topic int, terms array<string>"), "terms")
    weights = tp.ctfidf(tp.topic_term_counts(docs))
    assert len(tp.topic_words(weights, 2).collect()) == 6 and len(tp.unit_weights(weights).collect()) == weights.count()
    assert seen.value == 30


def test_maps_read_documents_once(spark):
    """the fit reads centroids, not documents (which are read once more, for the length of a vector)."""
    v = np.random.default_rng(3).standard_normal((60, 4))
    docs, seen = watched(spark.createDataFrame([(i, i % 6, x.tolist()) for i, x in enumerate(v)], "doc_id long, topic int, embedding array<double>"), "embedding")
    assert tp.topic_map_data(docs).count() == 6
    assert seen.value <= 120


def test_lemmas_are_read_once(spark):
    """F25, F26."""
    lemmas, seen = watched(spark.createDataFrame([("trees", "tree"), ("boats", "boat")], "token string, lemma string"), "lemma")
    df = spark.createDataFrame([(1, "two trees and boats")], "doc_id long, text string")
    assert lemmatize(df, lemmas).first()["text"] == "two tree and boat"
    assert seen.value == 2


def test_front_keeps_all_that_may_win(spark):
    """what is left of each batch holds the heaviest terms of every group, ties included."""
    rows = [(c, t, f"t{j:03d}", float((j * 37 + t) % 11)) for c in range(2) for t in range(3) for j in range(90)]
    weights = spark.createDataFrame(rows, "combo int, topic int, term string, weight double")
    want = tp.topic_words(weights, 4, by=["combo"])
    front = tp._front(weights, 4)
    assert sorted(tp.topic_words(front, 4, by=["combo"]).collect()) == sorted(want.collect())
    assert front.count() < weights.count()


def test_sparse_rows_are_multiplied_in_slices(monkeypatch):
    """the same images whatever the size of a slice, and no matrix of entries x directions."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"_j": [rng.choice(50, size=n, replace=False) for n in rng.integers(1, 40, 200)]})
    pdf["_w"] = [rng.random(len(j)) for j in pdf["_j"]]
    basis = rng.random((50, 7))
    want = np.stack([w @ basis[j] for j, w in zip(pdf["_j"], pdf["_w"])])
    for held in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(features, "HELD_ENTRIES", held)
        assert np.allclose(features.TruncatedSVD._dense(pdf, basis), want)
