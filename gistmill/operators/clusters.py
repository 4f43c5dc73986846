"""K-means, density clusters and topic assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.dims import OUTLIER
from gistmill.functions import vectors as vx
from gistmill.functions.draws import global_rank
from gistmill.operators.evaluate import centroids, silhouette
from gistmill.operators.neighbours import HELD_CELLS, _matrix, _slices, _sq_distances, as_points, nearest, vector_join
from gistmill.operators.train import GRADIENT, tree_sum
from gistmill.session import cut_lineage


#: Doubles that a task returns in a step of k-means: so many runs move at a time. Tasks that return no more than that together send it straight to the driver.
MOVED_CELLS = 1 << 20


def _flat_vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _center_step(vectors: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the vectors (v) by nearest center, and their squared distances, of all runs in one pass.

    centers: runs x k x D, with NaN where a run has fewer than k. Ties go to the first center.
    """
    runs, k, width = centers.shape
    held = vectors.sparkSession.sparkContext.broadcast(centers.reshape(runs * k, width))

    def add(batches):
        own = np.nan_to_num(held.value)
        heights = np.where(np.isnan(held.value[:, 0]), np.inf, (own * own).sum(1))
        n, sums, counts, costs = 0, np.zeros((runs * k, width)), np.zeros(runs * k), np.zeros(runs)
        step = max(1, HELD_CELLS // (runs * k))
        for batch in batches:
            v = _flat_vectors(batch.column("v"), width)
            for at in range(0, len(v), step):
                part = v[at : at + step]
                far = part @ own.T
                far *= -2.0
                far += heights
                far = far.reshape(len(part), runs, k)
                best = far.argmin(2)
                least = np.take_along_axis(far, best[:, :, None], 2)[:, :, 0] + (part * part).sum(1)[:, None]
                costs += np.maximum(least, 0.0).sum(0)
                far = far.reshape(len(part), runs * k)
                far[:] = 0.0
                np.put_along_axis(far, best + np.arange(runs) * k, 1.0, 1)
                sums += far.T @ part
                counts += far.sum(0)
            n += len(v)
        if n:
            g = np.concatenate([sums.ravel(), counts, costs])
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([0.0]), pa.array([g], pa.list_(pa.float64()))], ["n", "loss", "g"])

    parts, tasks = vectors.mapInArrow(add, GRADIENT), vectors.rdd.getNumPartitions()
    if tasks * centers.size <= MOVED_CELLS:
        g = _flat_vectors(parts.select("g").toArrow()["g"].combine_chunks(), centers.size + runs * (k + 1)).sum(0)
    else:
        g = tree_sum(parts, tasks)[2]
    held.destroy()
    sums, counts, costs = np.split(g, [runs * k * width, runs * k * (width + 1)])
    return sums.reshape(centers.shape), counts.reshape(runs, k), costs


def _settled(vectors: DataFrame, starts: list[np.ndarray], rounds: int = 300, tol: float = 1e-4) -> list[tuple[float, np.ndarray]]:
    """Lloyd's steps for all runs side by side, one pass over the vectors a step: cost (at the last step's start) and centers of each run.

    A run ends where no center moves by more than `tol`, as in Spark's KMeans; centers without rows stay.
    """
    k, width = max(len(c) for c in starts), starts[0].shape[1]
    at_once = max(1, MOVED_CELLS // (k * (width + 1)))
    centers = np.stack([np.pad(c, ((0, k - len(c)), (0, 0)), constant_values=np.nan) for c in starts])
    costs = np.zeros(len(starts))
    for top in range(0, len(starts), at_once):
        moving = np.arange(top, min(top + at_once, len(starts)))
        for _ in range(rounds):
            sums, counts, costs[moving] = _center_step(vectors, centers[moving])
            new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centers[moving])
            moved = np.nan_to_num(((new - centers[moving]) ** 2).sum(2)).max(1)
            centers[moving] = new
            moving = moving[moved > tol * tol]
            if not len(moving):
                break
    return [(float(cost), c[~np.isnan(c[:, 0])]) for cost, c in zip(costs, centers, strict=True)]


def kmeans(df: DataFrame, k: int | None = None, restarts: int = 10, seed: int = 42, vec: str = "embedding") -> DataFrame:
    """Adds ``cluster``: the cheapest of several seeded runs; k defaults to min(50, n // 10).

    Spark's KMeans finds the first centers of each run (k-means||); then all runs move together, so that the passes over the
    vectors are those of the longest run, and not of all of them.
    """
    pts = df.withColumn("_v", array_to_vector(vx.as_double(F.col(vec)))).persist()
    if k is None:
        k = max(2, min(50, pts.count() // 10))
    starts = [np.stack(KMeans(k=k, maxIter=0, seed=seed + i, featuresCol="_v").fit(pts).clusterCenters()) for i in range(restarts)]
    # Distances are taken from a point amid the vectors: products of large components would hide small ones.
    middle = starts[0].mean(0)
    flat = pts.select(vector_to_array("_v").alias("v"))
    vectors = flat.mapInArrow(_shifted(middle), "v array<double>").persist()
    _, best = min(_settled(vectors, [c - middle for c in starts]), key=lambda run: run[0])
    vectors.unpersist()
    held = df.sparkSession.sparkContext.broadcast((best, middle))

    def name(v: pd.Series) -> pd.Series:
        best, middle = held.value
        step = max(1, HELD_CELLS // len(best))
        parts = (np.stack(v.iloc[at : at + step].to_numpy()) - middle for at in range(0, len(v), step))
        return pd.Series(np.concatenate([((best * best).sum(1) - 2.0 * (x @ best.T)).argmin(1) for x in parts]).astype(np.int32))

    name.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return pts.withColumn("cluster", F.pandas_udf(name, "int")(vector_to_array("_v"))).drop("_v")


def _shifted(middle: np.ndarray):
    def shift(batches):
        for batch in batches:
            v = _flat_vectors(batch.column("v"), len(middle)) - middle
            ends = pa.array(np.arange(0, v.size + 1, len(middle), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["v"])

    return shift


def embedding_quality(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", **kw) -> DataFrame:
    """silhouette of the k-means clusters on a 1,000-row sample, n_dimensions, n_samples."""
    clustered = kmeans(df, vec=vec, **kw)
    facts = df.agg(F.max(F.size(vec)).alias("n_dimensions"), F.count(F.lit(1)).alias("n_samples"), F.lit(1).alias("_k"))
    score = silhouette(clustered, 1000, id_col, "cluster", vec).withColumn("_k", F.lit(1))
    return score.join(facts, "_k").drop("_k")


def core_distance(knn: DataFrame, min_samples: int = 10) -> DataFrame:
    """id, core: distance to the min_samples-th neighbour."""
    return knn.filter(F.col("rank") <= min_samples).groupBy("id").agg(
        F.max("dist").alias("core"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == min_samples).drop("_n")


def mutual_reachability(knn: DataFrame, core: DataFrame) -> DataFrame:
    """id, nbr, reach for each neighbour edge."""
    joined = knn.join(core, "id").join(core.select(F.col("id").alias("nbr"), F.col("core").alias("nbr_core")), "nbr")
    return joined.select("id", "nbr", F.greatest("core", "nbr_core", "dist").alias("reach"))


def _block_components(near: np.ndarray) -> np.ndarray:
    """Component number (smallest place) of the rows, then the columns, of a boolean matrix of links, by label spreading with jumps."""
    n, m = near.shape
    label = np.arange(n + m)
    step = max(1, HELD_CELLS // max(1, m))
    while True:
        low = label.copy()
        # A slice of rows at a time: the matrix of labels is never held whole.
        for at in range(0, n, step):
            part = near[at : at + step]
            low[at : at + len(part)] = np.minimum(low[at : at + len(part)], np.where(part, label[None, n:], n + m).min(1, initial=n + m))
            low[n:] = np.minimum(low[n:], np.where(part, label[at : at + len(part), None], n + m).min(0, initial=n + m))
        new = low[low]
        if (new == label).all():
            return label
        label = new


def _reach_kernel(eps: float, metric: str):
    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([q["id"].to_numpy(), b["id"].to_numpy()])
        bv, near, at = _matrix(b["v"]), np.empty((len(q), len(b)), bool), 0
        for part in _slices(q, len(b)):
            qv = _matrix(part["v"])
            near[at : at + len(part)] = (1.0 - qv @ bv.T if metric == "cosine" else np.sqrt(_sq_distances(qv, bv))) <= eps
            at += len(part)
        label = _block_components(near)
        root = ids.copy()
        np.minimum.at(root, label, ids)
        root = root[label]
        linked = root != ids
        return pd.DataFrame({"u": ids[linked], "v": root[linked]})

    return kernel


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (smallest id) from edges (u, v), by alternating large and small stars (Kiveris et al., 2014).

    Only minima are aggregated; hub rows are spread by AQE's skew join. Each round ends in a reliable checkpoint.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.filter("u != v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.union(roots)


def density_clusters(
    df: DataFrame,
    eps: float,
    core: DataFrame,
    min_cluster_size: int = 10,
    metric: str = "cosine",
    id_col: str = "vec_id",
    vec: str = "embedding",
    **sizes,
) -> DataFrame:
    """id, topic: components of core points (core distance <= eps) within eps of each other.

    Components below the minimum size and all other points get -1; topics are numbered by size, then smallest id.
    A block pair returns a spanning forest of its near pairs instead of the pairs, which leaves the components
    unchanged and the output linear in the rows.
    """
    pts = as_points(df, id_col, vec, metric)
    dense = pts.join(core.filter(F.col("core") <= eps).select("id"), "id").persist()
    reach = float(np.sqrt(2 * eps)) if metric == "cosine" else eps
    # Blocks hold core points; a block pair's matrix covers both sides.
    links = vector_join(dense, dense, _reach_kernel(eps, metric), "u long, v long", reach=reach, mirrored=True, **sizes)
    comp = connected_components(links)
    comp = dense.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cluster_size)
    numbered = global_rank(size, F.desc("n"), F.col("component"))
    named = comp.join(numbered.select("component", F.col("rank").cast("int").alias("topic")), "component")
    return pts.select("id").join(named.select("id", "topic"), "id", "left").select(
        "id", F.coalesce("topic", F.lit(OUTLIER)).cast("int").alias("topic")
    )


def assign_topics(
    new: DataFrame, train: DataFrame, eps: float, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding", **sizes
) -> DataFrame:
    """id, nbr, dist, topic: the topic of the nearest clustered train row within eps, else -1."""
    base = as_points(train.filter(F.col("topic") != OUTLIER), id_col, vec, metric, "topic")
    hits = nearest(as_points(new, id_col, vec, metric), base.select("id", "v"), 1, metric, **sizes)
    named = hits.join(base.select(F.col("id").alias("nbr"), "topic"), "nbr")
    found = named.select("id", "nbr", "dist", F.when(F.col("dist") <= eps, F.col("topic")).otherwise(OUTLIER).alias("topic"))
    everyone = new.select(F.col(id_col).alias("id"))
    return everyone.join(found, "id", "left").withColumn("topic", F.coalesce("topic", F.lit(OUTLIER)).cast("int"))


def topic_probability(
    docs: DataFrame, train: DataFrame, id_col: str = "vec_id", vec: str = "embedding", topic: Column | str = "topic", **sizes
) -> DataFrame:
    """id, best_topic, topic_probability: largest share of the (non-negative) similarities to the topic centroids."""
    cent = centroids(train.filter(F.col(topic) != OUTLIER), topic, vec)
    base = cent.select(F.col(topic).cast("long").alias("id"), vx.l2_normalize(F.col("centroid")).alias("v"))

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        sim = np.maximum(_matrix(q["v"]) @ _matrix(b["v"]).T, 0.0)
        at = sim.argmax(1)
        return pd.DataFrame(
            {
                "id": q["id"].to_numpy(),
                "best": sim[np.arange(len(q)), at],
                "t": b["id"].to_numpy()[at],
                "total": sim.sum(1),
            }
        )

    hits = vector_join(as_points(docs, id_col, vec, "cosine"), base, kernel, "id long, best double, t long, total double", **sizes)
    agg = hits.groupBy("id").agg(
        F.max(F.struct(F.col("best"), (-F.col("t")).alias("nt"))).alias("m"), F.sum("total").alias("total")
    )
    return agg.select(
        "id",
        (-F.col("m.nt")).cast("int").alias("best_topic"),
        F.coalesce(F.try_divide(F.col("m.best"), F.col("total")), F.lit(0.0)).alias("topic_probability"),
    )
