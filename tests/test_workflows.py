"""Whole workflows and fits: sizes, bounds, and that training and labelling do what they say."""

import json

from pyspark.sql import functions as F

from gistmill.operators import clusters as cl
from gistmill.operators.labelling import BROAD_NAMES
from gistmill.plans import workflows as wf
from gistmill.registry import tables as t
from gistmill.registry.topics import q_map
from gistmill.sources import readers

SF = "/root/testdata/sf0.001"


def flat_docs(spark):
    v = t.doc_vectors(spark, SF)
    flat = F.array(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)))
    return v.select("doc_id", "text", "split", F.col("broad_label_id").alias("label"), flat.alias("embedding"))


def first_category(prompts):
    return [json.dumps({"tuned_topic_name": BROAD_NAMES[0], "short_explanation": p[:20]}) for p in prompts]


def test_topics_to_scores(spark):
    docs = flat_docs(spark).persist()
    want = {r["split"]: r["count"] for r in docs.groupBy("split").count().collect()}
    fit = dict(metric="euclidean", k_neighbours=8, min_samples=4, core_quantile=0.5, ngram_range=(1, 1), min_cluster_size=5)
    for fn, dims in ((None, None), (first_category, 5)):
        rows = {r["split"]: r for r in wf.topics_to_scores(docs, fn=fn, stop=t.STOP_WORDS, reduce_to=dims, **fit).collect()}
        assert {s: r["total"] for s, r in rows.items()} == want
        train = rows["train"]
        assert 0 < train["after_outliers"] < train["total"] and train["after_unmapped"] == train["samples"]
        assert 0 <= train["macro_f1"] <= 1 and 0 < train["weighted_f1"] <= 1


def test_topics_are_found_in_the_layout(spark):
    """Four rings of vectors around far centres: the layout has five dimensions, and each ring is one topic of the fit."""
    import numpy as np

    g = np.random.default_rng(3)
    rows = []
    for c in range(4):
        centre = 8 * g.standard_normal(12)
        for k in range(40):
            rows.append((len(rows), f"word{c} thing{c} item{c} place{k % 3}", [float(x) for x in centre + 0.4 * g.standard_normal(12)], c))
    docs = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>, ring int")
    fitted, _, _ = wf.fit_topics(docs, 0.95, 10, 4, 5, 10, "euclidean", ngram_range=(1, 1))
    got = fitted.select("ring", "topic", F.size("place").alias("n")).collect()
    assert {r["n"] for r in got} == {5}
    kept = {(r["ring"], r["topic"]) for r in got if r["topic"] != -1}
    assert {ring for ring, _ in kept} == {0, 1, 2, 3} and len({topic for _, topic in kept}) == len(kept)
    placed = wf.place_new(docs.limit(7), fitted, 10, "euclidean").collect()
    assert len(placed) == 7 and all(len(r["place"]) == 5 for r in placed)


def test_store_variants(spark, tmp_path):
    wf.store_variants(t.raw_posts(spark, SF), str(tmp_path / "v"))
    train, test = readers.load_variant(spark, "sparse_repr", str(tmp_path / "v"))
    assert train.filter("broad_label_id is not null").count() == 0 and test.count() > 0


def test_training_approaches(spark):
    rows = {r["approach"]: r for r in wf.compare_approaches(t.embeddings(spark, SF), 200, 32, 6, 5e-3).collect()}
    assert set(rows) == {"triplet", "simcse", "cosine"}
    for r in rows.values():
        assert r["last_loss"] < r["first_loss"] and r["davies_bouldin"] > 0 and r["examples"] == 200


def test_kmeans_and_quality(spark):
    e = t.embeddings(spark, SF)
    got = cl.kmeans(e, restarts=2)
    assert got.count() == 500 and got.select("cluster").distinct().count() <= 50
    q = cl.embedding_quality(e, restarts=1).first()
    assert -1 <= q["silhouette"] <= 1 and (q["n_dimensions"], q["n_samples"]) == (64, 500)


def test_topic_map(spark):
    rows = q_map(spark, SF).collect()
    assert len({r["topic"] for r in rows}) == len(rows) and -1 not in {r["topic"] for r in rows}
    assert abs(sum(r["x"] for r in rows)) < 1e-4
