"""Findings of the fourth round: what the searches and graphs keep between their steps."""

import numpy as np
import pytest

from gistmill.operators import neighbours as nb


def vectors(spark, n, width, seed=5):
    v = np.random.default_rng(seed).standard_normal((n, width))
    return v, spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_hits_do_not_grow_with_the_number_of_bins(spark, monkeypatch, metric):
    """Where nothing can be ruled out, a query still keeps k rows of each step, and not of each bin."""
    v, df = vectors(spark, 600, 16)
    held, ranked = [], nb._ranked
    monkeypatch.setattr(nb, "_ranked", lambda hits, k: held.append(hits.count()) or ranked(hits, k))
    got = nb.knn_graph(df, 6, metric, small_rows=0, block_rows=40)
    d = 1 - (u := v / np.linalg.norm(v, axis=1, keepdims=True)) @ u.T if metric == "cosine" else np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(r["id"], r["rank"]): r["nbr"] for r in got.collect()} == {(i, r + 1): j for i, row in enumerate(np.argsort(d, axis=1)[:, :6].tolist()) for r, j in enumerate(row)}
    assert held[0] <= 2 * 600 * 7


def test_vectors_without_length_are_at_right_angles_to_all(spark):
    """By blocks as beside a small base."""
    v, _ = vectors(spark, 200, 3)
    v[::4] = 0.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    pts = nb.as_points(df, "vec_id", "embedding", "cosine")
    small, blocks = ({(r["id"], r["rank"]): (r["nbr"], r["dist"]) for r in nb.nearest(pts, pts, 120, **s).collect()} for s in ({}, {"small_rows": 0, "block_rows": 20}))
    assert small.keys() == blocks.keys() and all(abs(small[x][1] - blocks[x][1]) < 1e-12 for x in small)


def test_blocks_that_meet_are_not_sent(spark):
    """links between blocks of vectors come from a task that reads both, and each pair of blocks meets once."""
    from gistmill.operators import clusters as cl

    v, df = vectors(spark, 400, 3)
    pts = nb.as_points(df, "vec_id", "embedding", "euclidean")
    links = nb.vector_join(pts, pts, cl._reach_kernel(0.4, "euclidean"), "u long, v long", reach=0.4, small_rows=0, block_rows=40)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange hashpartitioning" not in plan
    core = spark.createDataFrame([(i, 0.0) for i in range(400)], "id long, core double")
    small, blocks = ({r["id"]: r["topic"] for r in cl.density_clusters(df, 0.4, core, 2, "euclidean", **s).collect()} for s in ({}, {"small_rows": 0, "block_rows": 40}))
    assert small == blocks and len(set(small.values())) > 5


def test_layout_steps_write_nothing(spark, monkeypatch):
    """numbers of nodes that fit go to the tasks whole; the layout is that of blocks that send each other what they need."""
    from gistmill.operators import blockgraph

    monkeypatch.setattr(blockgraph, "BLOCK_NODES", 64)
    _, df = vectors(spark, 300, 4)
    graph = nb.fuzzy_graph(nb.knn_graph(df, 8, "euclidean"), 8).persist()
    cuts = []
    cut = blockgraph.cut_lineage
    monkeypatch.setattr(blockgraph, "cut_lineage", lambda x: cuts.append(x.columns) or cut(x))
    held = {r["id"]: r["coords"] for r in nb.spectral_layout(graph, 2).collect()}
    assert cuts == [["own", "heads", "far", "w"]]
    sent = {r["id"]: r["coords"] for r in nb.spectral_layout(graph, 2, held_bytes=0).collect()}
    assert held.keys() == sent.keys() and all(np.allclose(held[i], sent[i], atol=1e-7) for i in held)
