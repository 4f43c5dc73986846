"""Vector operators against brute force, on the small and on the block path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gistmill.operators import clusters as cl
from gistmill.operators import contrastive as cn
from gistmill.operators import neighbours as nb
from gistmill.operators import search as sr
from gistmill.operators import train as tr
from gistmill.operators.evaluate import check_projection, davies_bouldin, silhouette, worst_ratios
from gistmill.operators.features import TruncatedSVD, pca, tfidf, tokenize_terms
from gistmill.plans.workflows import project_2d
from gistmill.registry import tables as t

SF = "/root/testdata/sf0.001"
BLOCKS = {"small_rows": 0, "block_rows": 40}


def make(spark, v, labels=None):
    rows = [(i, [float(x) for x in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


def blobs(n=60, seed=1, d=2):
    """Three groups, strays, and a mass of copies holding a third of the rows."""
    g = np.random.default_rng(seed)
    centres = g.uniform(-5, 5, (3, d))
    v = np.concatenate([c + 0.2 * g.standard_normal((n, d)) for c in centres] + [g.uniform(-9, 9, (20, d)), np.tile(centres[0] + 3, (100, 1))])
    return np.round(v, 4)


def brute_knn(v, k, metric):
    if metric == "cosine":
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = np.maximum(1 - (u[:, None] * u[None]).sum(2), 0)
    else:
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(v)):
        for r, j in enumerate(np.lexsort((np.arange(len(v)), d[i]))[:k]):
            out[i, r + 1] = (int(j), float(d[i, j]))
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("sizes", [{}, BLOCKS])
def test_knn_graph_is_exact(spark, metric, sizes):
    v = blobs()
    got = {(r["id"], r["rank"]): (r["nbr"], r["dist"]) for r in nb.knn_graph(make(spark, v), 7, metric, **sizes).collect()}
    want = brute_knn(v, 7, metric)
    assert got.keys() == want.keys()
    # Distances agree everywhere, members wherever the last place of a unit vector leaves no doubt.
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert sum(got[k][0] != want[k][0] for k in want) <= len(want) // 100


def test_pruning_removes_far_blocks_only():
    between = np.array([[0.0, 10.0], [10.0, 0.0]])
    assert nb.surviving_cells(between, np.ones(2), np.array([5, 5]), np.ones(2), 8.0).all()
    assert nb.surviving_cells(between, np.ones(2), np.array([5, 5]), np.ones(2), 7.0).tolist() == [[True, False], [False, True]]
    assert nb.surviving_cells(between, np.ones(2), np.array([5, 0]), np.ones(2), None).tolist() == [[True, False], [True, False]]


def test_first_bounds_hold_enough_rows():
    g = np.random.default_rng(2)
    v, q = g.standard_normal((400, 5)), g.standard_normal((60, 5))
    pivots = v[:20]
    d = np.sqrt(sr.sq_distances(v, pivots))
    cell = d.argmin(1)
    count = np.bincount(cell, minlength=20)
    radius = np.array([d[cell == c, c].max(initial=0) for c in range(20)])
    label = np.where(cell < 12, cell % 2, np.arange(400) % 3)
    lo, hi = (np.array([f(label[cell == c]) for c in range(20)], dtype=object) for f in (np.min, np.max))
    bins = sr.group_cells(pivots, count, 50)
    assert sorted(set(bins)) == list(range(bins.max() + 1)) and all(count[bins == b].sum() <= 50 or (bins == b).sum() == 1 for b in set(bins))
    grid = sr.Grid(pivots, count, radius, bins, lo, lo != hi, 1e-9)
    far, true = grid.from_pivots(q), np.sqrt(sr.sq_distances(q, v))
    own, at = far.argmin(1), np.arange(60)
    for k in (1, 7, 399):
        bound = grid.first_bound(far, k, None)
        assert ((true <= bound[:, None] + 1e-9).sum(1) >= k + 1).all()
        order = np.argsort(true, 1)
        reached = grid.reached(far, far[at, own], own, slice(None), true[at, order[:, k]])
        assert all(reached[i, cell[order[i, : k + 1]]].all() for i in at) and (k > 1 or not reached.all())
    assert np.isinf(grid.first_bound(far, 400, None)).all()
    mine = g.integers(0, 3, 60)
    bound = grid.first_bound(far, 1, mine)
    assert all((true[i, label != mine[i]] <= bound[i] + 1e-9).any() for i in range(60))


def test_visits_grow_with_the_rows_and_not_their_square(spark):
    """Four times the rows in four times the clusters: the rows that a query meets stay about as many."""
    work = []
    for clusters in (16, 64):
        g = np.random.default_rng(1)
        v = np.concatenate([c + 0.05 * g.standard_normal((50, 8)) for c in 10 * g.standard_normal((clusters, 8))])
        pts = nb.as_points(make(spark, v), "vec_id", "embedding", "euclidean")
        rows, grid = sr.build_grid(pts, len(v), 100)
        own = sr.first_bounds(pts, grid, 5, False)
        found = nb.nearest(pts, pts, 6, "euclidean").filter("rank = 6").select("id", F.col("dist").alias("kth"))
        bounded = own.join(found, "id").withColumn("bound", F.least("bound", "kth")).drop("kth")
        sent = sr.routes(bounded, grid).agg(F.sum("work"), F.count(F.lit(1))).first()
        work.append((sent[0] or 0) / len(v) + 100)
        assert sent[1] < len(v) * (grid.bin_of.max() + 1) / 8
    assert work[1] < 1.5 * work[0]


@pytest.mark.parametrize("sizes", [{}, BLOCKS])
def test_profile_and_hardest_negative(spark, sizes):
    e = t.embeddings(spark, SF)
    pdf = e.orderBy("vec_id").toPandas()
    v = np.stack(pdf["embedding"]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    off = sim + np.where(np.eye(len(v)) > 0, -np.inf, 0)
    got = nb.pairwise_cosine(e, **sizes).orderBy("id").toPandas()
    assert np.allclose(got["max_sim"], off.max(1), atol=1e-6)
    assert np.allclose(got["mean_sim"], (sim.sum(1) - 1) / (len(v) - 1), atol=1e-6)
    lab = pdf["label"].to_numpy()
    other = np.where(lab[:, None] == lab[None], -np.inf, np.round(sim, 6))
    pts = nb.as_points(e, "vec_id", "embedding", "cosine", "label")
    neg = nb.hardest_negative(pts, pts, **sizes).orderBy("id").toPandas()
    assert np.allclose(neg["sim"], other.max(1), atol=2e-6)
    assert (neg["nbr"].to_numpy() == other.argmax(1)).mean() > 0.99


@pytest.mark.parametrize("sizes", [{}, BLOCKS])
def test_density_clusters_find_the_groups(spark, sizes):
    v = blobs()
    df = make(spark, v)
    core = cl.core_distance(nb.knn_graph(df, 5, "euclidean"), 5)
    got = cl.density_clusters(df, 0.5, core, 10, "euclidean", **sizes).orderBy("id").toPandas()["topic"].to_numpy()
    # Brute force.
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 6)
    dense = np.sort(d, axis=1)[:, 5] <= 0.5
    comp = np.where(dense, np.arange(len(v)), -1)
    while True:
        near = (d <= 0.5) & dense[:, None] & dense[None]
        low = np.where(near, comp[None], len(v)).min(1)
        new = np.where(dense, np.minimum(comp, low), -1)
        if (new == comp).all():
            break
        comp = new
    ids, n = np.unique(comp[comp >= 0], return_counts=True)
    order = [i for i, c in sorted(zip(ids, n), key=lambda x: (-x[1], x[0])) if c >= 10]
    assert got.tolist() == [order.index(c) if c in order else -1 for c in comp]
    assert len(order) >= 4 and (got == -1).any()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = cl.connected_components(spark.createDataFrame(edges, "u long, v long"))
    rows = {r["id"]: r["component"] for r in got.collect()}
    assert {rows[i] for i in range(201)} == {0} and {rows[1000 + i] for i in range(50)} == {1000}
    assert got.count() == 251


def test_fuzzy_weights_sum_to_log2_k(spark):
    knn = nb.knn_graph(t.embeddings(spark, SF), 15).toPandas()
    d = knn.sort_values(["id", "rank"])["dist"].to_numpy().reshape(-1, 15)
    x = np.maximum(d - d.min(1, keepdims=True), 0)
    sigma = nb._solve_sigma(np.log2(15), 60)(pd.Series(list(x))).to_numpy()
    assert np.allclose(np.exp(-x / sigma[:, None]).sum(1), np.log2(15), atol=1e-6)


def test_layout_separates_two_groups(spark):
    v = np.concatenate([blobs()[:60], blobs()[60:120]])
    graph = nb.fuzzy_graph(nb.knn_graph(make(spark, v), 15, "euclidean"), 15).union(spark.createDataFrame([(0, 100, 0.01)], "a long, b long, weight double"))
    pdf = nb.spectral_layout(graph, 2).toPandas().sort_values("id")
    xy = np.stack(pdf["coords"])
    left, right = xy[:60, 0], xy[60:, 0]
    assert max(left) < min(right) or max(right) < min(left)
    # The first direction solves the eigenvalue equation.
    g = graph.toPandas()
    w = np.zeros((120, 120))
    w[g["a"], g["b"]] = w[g["b"], g["a"]] = g["weight"]
    deg = w.sum(1)
    m = w / np.sqrt(deg[:, None] * deg[None])
    x = xy[:, 0]
    value = x @ m @ x / (x @ x)
    assert value > 0.98 and np.linalg.norm(m @ x - value * x) / np.linalg.norm(x) < 1e-6
    # Both equal the dense solution, each with its largest component positive.
    vec = np.linalg.eigh(m)[1]
    for i in range(2):
        want = vec[:, -2 - i] * np.sign(vec[np.abs(vec[:, -2 - i]).argmax(), -2 - i])
        assert np.allclose(xy[:, i], want, atol=1e-6)
    few = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5)], "a long, b long, weight double")
    assert sorted(len(r["coords"]) for r in nb.spectral_layout(few, 2).collect()) == [2, 2, 2]
    assert nb.spectral_layout(few.limit(0), 2).count() == 0


@pytest.mark.parametrize("method", ["pca", "graph"])
def test_project_covers_both_splits(spark, method):
    df = t.embeddings(spark, SF).withColumn("split", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train"))
    got = project_2d(df, method, tolerance=1e-3).toPandas()
    assert len(got) == 500 and got[["x", "y"]].notna().all().all()


def test_pca_is_centred_and_ordered(spark):
    got = pca(t.embeddings(spark, SF), 5).toPandas()
    p = np.stack(got["projected"])
    v = np.stack(got["embedding"]).astype(float)
    assert np.allclose(p.mean(0), 0, atol=1e-9)
    want = np.linalg.svd(v - v.mean(0), compute_uv=False)[:5] ** 2 / (len(v) - 1)
    assert np.allclose(p.var(0, ddof=1), want, rtol=1e-6)


def test_svd_matches_dense(spark):
    docs = tokenize_terms(t.corpus(spark, SF), t.STOP_WORDS)
    w = tfidf(docs, 3, 0.85, 300).persist()
    model = TruncatedSVD(5).fit(w)
    pdf = w.toPandas()
    m = pdf.pivot(index="doc_id", columns="term", values="weight").fillna(0.0)[model.terms].to_numpy()
    want = np.linalg.svd(m, compute_uv=False)[:5]
    assert np.allclose(model.singular_values, want, rtol=1e-9)
    assert np.allclose(model.components.T @ model.components, np.eye(5), atol=1e-8)
    assert len(model.transform(w).toPandas()) == len(m)


def test_davies_bouldin_edge_cases(spark):
    same = make(spark, [[0, 0], [2, 0], [0, 0], [2, 0]], [0, 0, 1, 1])
    assert davies_bouldin(same).first()[0] == 0.0
    apart = make(spark, [[0, 0], [2, 0], [10, 0], [12, 0]], [0, 0, 1, 1])
    assert davies_bouldin(apart).first()[0] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        check_projection(make(spark, [[0, 0], [1, 1]], [0, 0]))
    with pytest.raises(ValueError):
        check_projection(make(spark, [[0, 0, 0], [1, 1, 1]], [0, 1]))


def test_many_labels_need_little_memory():
    import tracemalloc

    g = np.random.default_rng(1)
    v = g.standard_normal((4096, 64))
    v[7] = v[9]
    frame = pd.DataFrame({"id": range(4096), "v": list(v), "s": g.random(4096)})
    tracemalloc.start()
    got = worst_ratios(frame, frame)["r"].to_numpy()
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    for i in (0, 7, 9, 4095):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        assert got[i] == pytest.approx(((frame["s"] + frame["s"][i])[d > 0] / d[d > 0]).max())


def test_silhouette_counts_lone_points_as_zero(spark):
    v = make(spark, [[0, 0], [1, 0], [10, 0]], [0, 0, 1])
    assert silhouette(v).first()[0] == pytest.approx((0.9 + 8 / 9) / 3)


def test_triplets_and_pairs_keep_their_promises(spark):
    e = t.embeddings(spark, SF).withColumn("label", F.when(F.col("vec_id") == 3, 99).otherwise(F.col("label")))
    label = {r["vec_id"]: r["label"] for r in e.collect()}
    tri = cn.mine_triplets(e, 100).collect()
    assert len(tri) == 100 and 3 not in {r["a_id"] for r in tri}
    assert all(r["a_id"] != r["p_id"] and label[r["a_id"]] == label[r["p_id"]] != label[r["n_id"]] for r in tri)
    got = cn.cosine_pairs(e, 200, "vec_id").collect()
    assert len(got) == 200
    for r in got:
        assert r["a_id"] != r["b_id"] and (label[r["a_id"]] == label[r["b_id"]]) == (r["target"] == 1.0)
    again = cn.cosine_pairs(e.repartition(7), 200, "vec_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("loss", ["triplet", "simcse", "cosine"])
def test_gradients(loss):
    g = np.random.default_rng(3)
    sides = [g.standard_normal((6, 4)) for _ in tr.SIDES[loss]]
    target = g.integers(0, 2, 6).astype(float)
    w = g.standard_normal((4, 4))
    _, grad = tr.loss_and_gradient(loss, w, sides, target)
    for i in range(4):
        for j in range(4):
            step = np.zeros((4, 4))
            step[i, j] = 1e-6
            up = tr.loss_and_gradient(loss, w + step, sides, target)[0]
            down = tr.loss_and_gradient(loss, w - step, sides, target)[0]
            assert grad[i, j] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_training_lowers_the_loss(spark):
    e = t.embeddings(spark, SF)
    tri = cn.mine_triplets(e, 200)
    head = tr.train_head(tri, e, "triplet", epochs=8, lr=1e-2)
    assert head.losses[-1] < 0.8 * head.losses[0]
    with pytest.raises(ValueError):
        tr.train_head(tri.limit(0), e, "triplet")


def test_loss_curve_equals_numpy(spark):
    """Gradients that come up the tree of tasks are those of all rows at once."""
    e = t.embeddings(spark, SF)
    tri = cn.mine_triplets(e, 150)
    head = tr.train_head(tri, e, "triplet", epochs=4, lr=1e-3)
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    sides = [np.stack([v[r[c]] for r in tri.collect()]) for c in ("a_id", "p_id", "n_id")]
    w, m, s, losses = np.eye(64), 0.0, 0.0, []
    for step in range(4):
        value, g = tr.loss_and_gradient("triplet", w, sides, None)
        losses.append(value / 150)
        m, s = 0.9 * m + 0.1 * g / 150, 0.999 * s + 0.001 * (g / 150) ** 2
        rate = 1e-3 * min(step + 1, (4 - step) / 3)
        w = w - rate * ((m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.999 ** (step + 1))) + 1e-8) + 0.01 * w)
    assert np.allclose(head.losses, losses, rtol=1e-9) and np.allclose(head.weights, w, atol=1e-7)


def test_gaps_below_the_sixth_place(spark):
    """Ranks are by exact distances: neighbours that differ by less than 1e-6 are told apart."""
    got = nb.knn_graph(make(spark, [[0.0, 0.0], [4e-7, 0.0], [1e-7, 0.0]]), 1, "euclidean").collect()
    assert {r["id"]: r["nbr"] for r in got} == {0: 2, 1: 2, 2: 0}
    blocks = nb.knn_graph(make(spark, [[0.5 + 3e-9 * k * k, 1.0] for k in range(90)]), 1, "euclidean", **BLOCKS).collect()
    assert {r["id"]: r["nbr"] for r in blocks} == {k: max(k - 1, 0) if k else 1 for k in range(90)}
