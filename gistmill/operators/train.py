"""A linear head over frozen vectors, trained with one distributed gradient over all examples per pass."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions.draws import hash_rank
from gistmill.operators.contrastive import RANKING_SCALE, with_vectors

SIDES = {"triplet": ("a", "p", "n"), "simcse": ("a", "b"), "cosine": ("a", "b")}


GRADIENT = "n long, loss double, g array<double>"


def tree_sum(parts: DataFrame, tasks: int) -> tuple[int, float, np.ndarray] | None:
    """Sums of (n, loss, g) with whole arrays g: in each task, then in some sqrt(tasks) tasks, then in one; one row reaches the driver."""

    def add(batches):
        n, loss, g = 0, 0.0, None
        for pdf in batches:
            for row_n, row_loss, row_g in zip(pdf["n"], pdf["loss"], pdf["g"]):
                n, loss, g = n + int(row_n), loss + float(row_loss), np.array(row_g, float) if g is None else g + row_g
        if g is not None:
            yield pd.DataFrame({"n": [n], "loss": [loss], "g": [g]})

    parts = parts.mapInPandas(add, GRADIENT)
    for width in (int(np.ceil(np.sqrt(tasks))), 1):
        parts = parts.repartition(width).mapInPandas(add, GRADIENT)
    rows = parts.collect()
    return (rows[0]["n"], rows[0]["loss"], np.array(rows[0]["g"])) if rows else None


@dataclass
class Head:
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, vec: str = "embedding", normalize: bool = True) -> DataFrame:
        """Replace the vectors by the head's output; the D x D matrix goes to every task once."""
        held = df.sparkSession.sparkContext.broadcast(self.weights)

        def apply(v: pd.Series) -> pd.Series:
            out = np.stack(v.to_numpy()).astype(float) @ held.value.T
            if normalize:
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return pd.Series(list(out))

        apply.__annotations__ = {"v": pd.Series, "return": pd.Series}
        return df.withColumn(vec, F.pandas_udf(apply, "array<double>")(F.col(vec).cast("array<double>")))


def _cos(w, x, y):
    """Cosines of mapped rows and what their gradient needs."""
    u, v = x @ w.T, y @ w.T
    nu, nv = np.linalg.norm(u, axis=1) + 1e-12, np.linalg.norm(v, axis=1) + 1e-12
    c = (u * v).sum(1) / (nu * nv)
    return c, u, v, nu, nv


def _cos_grad(g, x, y, c, u, v, nu, nv):
    """Gradient with respect to the matrix when row i carries the factor g[i]."""
    du = g[:, None] * (v / (nu * nv)[:, None] - (c / nu**2)[:, None] * u)
    dv = g[:, None] * (u / (nu * nv)[:, None] - (c / nv**2)[:, None] * v)
    return du.T @ x + dv.T @ y


def loss_and_gradient(loss: str, w: np.ndarray, sides: list[np.ndarray], target: np.ndarray | None, margin: float = 0.2):
    """Summed loss and gradient over the rows given (all of them one batch for the ranking loss)."""
    if loss == "triplet":
        a, p, n = sides
        cp, cn = _cos(w, a, p), _cos(w, a, n)
        gap = cn[0] - cp[0] + margin
        on = (gap > 0).astype(float)
        return np.maximum(gap, 0).sum(), _cos_grad(on, a, n, *cn) - _cos_grad(on, a, p, *cp)
    if loss == "cosine":
        a, b = sides
        got = _cos(w, a, b)
        miss = got[0] - target
        return (miss**2).sum(), _cos_grad(2 * miss, a, b, *got)
    a, b = sides
    u, v = a @ w.T, b @ w.T
    nu, nv = np.linalg.norm(u, axis=1, keepdims=True) + 1e-12, np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
    un, vn = u / nu, v / nv
    s = RANKING_SCALE * un @ vn.T
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    lse = top[:, 0] + np.log(e.sum(1))
    ds = RANKING_SCALE * (e / e.sum(1, keepdims=True) - np.eye(len(a)))
    dun, dvn = ds @ vn, ds.T @ un
    du = (dun - (dun * un).sum(1, keepdims=True) * un) / nu
    dv = (dvn - (dvn * vn).sum(1, keepdims=True) * vn) / nv
    return (lse - np.diag(s)).sum(), du.T @ a + dv.T @ b


def train_head(
    examples: DataFrame,
    vectors: DataFrame,
    loss: str,
    epochs: int = 2,
    batch_size: int = 32,
    lr: float = 1e-5,
    weight_decay: float = 0.01,
    warmup: float = 0.1,
    seed: int = 42,
    id_col: str = "vec_id",
    vec: str = "embedding",
) -> Head:
    """AdamW with linear warm-up and decay. Starts from the identity, so an untrained head changes nothing.

    Each epoch is one pass over the cached examples and one step. Tasks add up their rows' gradients as whole arrays, a tree of tasks adds up
    theirs, and the driver gets one D x D matrix per pass. For the ranking loss, rows see the others of their batch of `batch_size`,
    which is one small group; the other losses are sums over rows, so batches don't matter to them.
    """
    sides = SIDES[loss]
    n = examples.count()
    if n == 0:
        raise ValueError("no training examples")
    if n < batch_size:
        batch_size = max(2, n)
    key = F.concat_ws("-", *[f"{s}_id" for s in sides])
    ranked = hash_rank(examples.withColumn("_key", key), None, "_key", seed, "_pos")
    full = with_vectors(ranked, vectors, *sides, id_col=id_col, vec=vec)
    full = full.withColumn("_batch", F.floor(F.col("_pos") / batch_size).cast("int"))
    cols = ["_batch", *[f"{s}_v" for s in sides]] + (["target"] if loss == "cosine" else [])
    full = full.select(*cols).persist()
    first = full.select(f"{sides[0]}_v").first()
    if first is None:
        raise ValueError("no example has vectors on all sides")
    dim, tasks = len(first[0]), full.rdd.getNumPartitions()
    w, m, v = np.eye(dim), np.zeros((dim, dim)), np.zeros((dim, dim))
    total = max(1, epochs)
    warm = max(1, int(total * warmup))
    head = Head(w)
    for step in range(total):
        held = vectors.sparkSession.sparkContext.broadcast(head.weights)

        def gradient(pdf, held=held):
            data = [np.stack(pdf[f"{s}_v"].to_numpy()) for s in sides]
            target = pdf["target"].to_numpy() if loss == "cosine" else None
            value, grad = loss_and_gradient(loss, held.value, data, target)
            return pd.DataFrame({"n": [len(pdf)], "loss": [value], "g": [grad.ravel()]})

        def gradients(batches, gradient=gradient):
            for pdf in batches:
                if len(pdf):
                    yield gradient(pdf)

        if loss == "simcse":
            parts = full.groupBy("_batch").applyInPandas(lambda pdf: gradient(pdf), GRADIENT)
        else:
            parts = full.mapInPandas(gradients, GRADIENT)
        count, value, g = tree_sum(parts, tasks)
        held.unpersist()
        g = g.reshape(dim, dim) / count
        head.losses.append(value / count)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        rate = lr * min((step + 1) / warm, max(0.0, (total - step) / max(1, total - warm)))
        move = (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
        head.weights = head.weights - rate * (move + weight_decay * head.weights)
    full.unpersist()
    return head
