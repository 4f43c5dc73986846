"""Iterative fits: many steps in one job, against one step at a time."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from gistmill.operators import clusters as cl
from gistmill.operators import neighbours as nb
from gistmill.operators.blockgraph import BlockGraph


def test_steps_on_blocks_equal_a_matrix(spark, monkeypatch):
    monkeypatch.setattr("gistmill.operators.blockgraph.BLOCK_NODES", 12)
    g = np.random.default_rng(5)
    n, width = 60, 3
    w = np.triu(g.random((n, n)) * (g.random((n, n)) < 0.1), 1)
    w = w + w.T + np.diag(np.full(n, 0.5))
    ids = np.arange(n) * 7 - 100
    a, b = np.nonzero(w)
    edges = spark.createDataFrame([(int(ids[i]), int(ids[j]), float(w[i, j])) for i, j in zip(a, b, strict=True)], "a long, b long, w double")
    x, p = g.standard_normal((n, width)), g.standard_normal((n, width))
    names = ["x0", "x1", "x2"]
    state = spark.createDataFrame([(int(ids[i]), *x[i].tolist(), *p[i].tolist()) for i in range(n)], ", ".join(["id long", *(f"{c} double" for c in names), *(f"p_{c} double" for c in names)]))
    graph = BlockGraph(edges, n)
    got = graph.three_terms(state, names, 13, 0.7).orderBy("id").toPandas()
    graph.close()
    for _ in range(13):
        x, p = 0.7 * w @ x - 2 * x - p, x
    assert graph.blocks == 5 and got["id"].tolist() == ids.tolist()
    assert np.allclose(got[names].to_numpy(), x, rtol=1e-9, atol=1e-9 * np.abs(x).max())


def test_layout_takes_blocks_unless_there_are_hubs(spark, monkeypatch):
    made = []
    monkeypatch.setattr(nb, "BlockGraph", lambda *a: made.append(1) or BlockGraph(*a))
    ring = spark.createDataFrame([(i, (i + 1) % 40, 1.0 + i % 3) for i in range(40)], "a long, b long, weight double")
    packed = nb.spectral_layout(ring, 2).orderBy("id").toPandas()
    monkeypatch.setattr(nb, "HUB_EDGES", 1)
    joined = nb.spectral_layout(ring, 2).orderBy("id").toPandas()
    assert made == [1] and np.allclose(np.stack(packed["coords"]), np.stack(joined["coords"]), atol=1e-6)


def vectors_frame(spark, n=400, width=5, shift=0.0):
    v = np.random.default_rng(8).standard_normal((n, width)) + shift
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("cells", [1 << 20, 60])
def test_runs_of_kmeans_move_together(spark, monkeypatch, cells):
    """a pass over the vectors moves all runs (or as many as MOVED_CELLS allows), each as if it were alone."""
    passes = []
    step = cl._center_step
    monkeypatch.setattr(cl, "_center_step", lambda v, c: passes.append(len(c)) or step(v, c))
    monkeypatch.setattr(cl, "MOVED_CELLS", cells)
    v, df = vectors_frame(spark)
    starts = [v[:6], v[10:14], v[20:26]]  # the second run has fewer centers
    got = cl._settled(df.selectExpr("embedding as v"), starts)
    alone = []
    for (cost, centers), c in zip(got, starts, strict=True):
        for rounds in range(1, 301):
            far = ((v[:, None] - c[None]) ** 2).sum(2)
            best, old = far.argmin(1), c
            c = np.stack([v[best == j].mean(0) for j in range(len(c))])
            if (((c - old) ** 2).sum(1) <= 1e-8).all():
                break
        alone.append(rounds)
        assert centers.shape == c.shape and np.allclose(centers, c) and np.isclose(cost, far.min(1).sum())
    assert len(passes) == (max(alone) if cells > 60 else sum(alone))


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_kmeans_names_the_clusters_of_sparks_cheapest_run(spark, shift):
    _, df = vectors_frame(spark, shift=shift)
    pts = df.withColumn("f", array_to_vector("embedding")).persist()
    fits = [KMeans(k=7, maxIter=300, seed=42 + i, featuresCol="f").fit(pts) for i in range(3)]
    want = min(fits, key=lambda m: m.summary.trainingCost).transform(pts).select("vec_id", "prediction")
    got = cl.kmeans(df, k=7, restarts=3)
    assert got.columns == ["vec_id", "embedding", "cluster"]
    assert sorted(map(tuple, got.select("vec_id", "cluster").collect())) == sorted(map(tuple, want.collect()))
