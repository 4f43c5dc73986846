"""Vector joins: neighbours, similarity profiles, fuzzy graph, spectral layout.

Every operator here compares each query vector with all base vectors, exactly. The comparison is a
matrix product on two bounded blocks inside a task, and a task returns a few rows per query, never the pairs:

* a base side of at most ``SMALL_ROWS`` rows (counted first) goes to the tasks whole, and queries are not moved;
* a larger one is cut into blocks around pivot vectors. Blocks are split by row hash so that none exceeds
  ``BLOCK_ROWS`` however dense a region is, and where only rows within a reach count, the triangle inequality removes
  block pairs that cannot hold any; nearest rows are found in two steps, see ``search``. Blocks are written once; a task reads those of
  two partitions, so that no row is sent to each block that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gistmill.functions import vectors as vx
from gistmill.functions.blocks import MOST_PARTS, crossed, pack, right_parts
from gistmill.functions.blocks import matrix as _matrix
from gistmill.functions.blocks import sq_distances as _sq_distances
from gistmill.functions.draws import hash_key
from gistmill.operators.blockgraph import HELD_BYTES, BlockGraph, HeldGraph
from gistmill.operators.eigen import leading, random_columns, three_terms
from gistmill.operators.search import HITS, two_steps
from gistmill.session import cut_lineage

SMALL_ROWS = 4096
SMALL_CELLS = 4_000_000
BLOCK_ROWS = 4096
#: Blocks of joins that keep nothing but sums grow up to this many rows, so that a row is sent to fewer of them.
WIDE_ROWS = 16_384
#: Cells of a matrix, and pairs of vectors, that a task holds at a time, whatever the size of its blocks.
HELD_CELLS = 1 << 19
HELD_PAIRS = 1 << 13
MAX_PIVOTS = 256
DIGITS = 6

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def vector_join(
    queries: DataFrame,
    base: DataFrame,
    kernel: Kernel,
    schema: str,
    reach: float | None = None,
    small_rows: int = SMALL_ROWS,
    block_rows: int | None = BLOCK_ROWS,
    mirrored: bool = False,
) -> DataFrame:
    """Run ``kernel`` on blocks so that every (query row, base row) pair meets exactly once.

    Both sides hold ``id`` and ``v`` (array<double>); other columns travel along. With ``reach`` = r block
    pairs that are farther apart than r are left out. block_rows: None lets the blocks of a large
    base grow up to WIDE_ROWS, for kernels that go through their queries in slices. mirrored: both sides are the same table, and two blocks of a large one
    meet in one order only.
    """
    head = _small(base, small_rows)
    if head is not None:
        return _beside(queries, head, kernel, schema)
    return _grid_join(queries, base, kernel, schema, reach, block_rows, mirrored)


def _small(base: DataFrame, small_rows: int) -> pd.DataFrame | None:
    """The base rows, if they are few and short enough to be sent to all tasks."""
    head = base.limit(small_rows + 1).toPandas()
    width = len(head["v"].iloc[0]) if len(head) else 0
    return head if len(head) <= small_rows and len(head) * width <= SMALL_CELLS else None


def _beside(queries: DataFrame, head: pd.DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    held = queries.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield kernel(pdf, held.value)

    return queries.mapInPandas(run, schema)


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for pdf in (part for whole in batches for part in _slices(whole, len(held.value))):
            if len(pdf):
                d = _sq_distances(_matrix(pdf["v"]), held.value)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), away=np.sqrt(d[np.arange(len(pdf)), cell]))

    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return df.mapInPandas(nearest, schema)


def _cell_stats(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()
    count, radius = np.zeros(n, dtype=np.int64), np.zeros(n)
    for row in rows:
        count[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    return count, radius


def surviving_cells(between: np.ndarray, q_radius: np.ndarray, b_count: np.ndarray, b_radius: np.ndarray, reach: float | None) -> np.ndarray:
    """Boolean (query cell x base cell): may the pair hold rows within ``reach``?"""
    nearest_possible = np.maximum(between - q_radius[:, None] - b_radius[None, :], 0.0)
    keep = np.ones_like(between, dtype=bool)
    if reach is not None:
        keep &= nearest_possible <= reach + 10.0 ** (2 - DIGITS)
    return keep & (b_count > 0)[None, :]


def _grid_join(queries, base, kernel, schema, reach, block_rows, mirrored) -> DataFrame:
    spark = base.sparkSession
    n_base = base.count()
    if block_rows is None:
        # An eighth of the base leaves 64 pairs of blocks at least.
        block_rows = min(WIDE_ROWS, max(BLOCK_ROWS, n_base // 8))
    n_pivots = int(min(MAX_PIVOTS, max(1, n_base // block_rows)))
    picked = base.withColumn("_h", hash_key(7, "id")).orderBy("_h", "id").limit(n_pivots).select("v").toPandas()
    pivots = _matrix(picked["v"])
    b = _with_cell(base, pivots).persist()
    q = b if mirrored else _with_cell(queries, pivots).persist()
    q_count, q_radius = _cell_stats(q, n_pivots)
    b_count, b_radius = _cell_stats(b, n_pivots)
    between = np.sqrt(_sq_distances(pivots, pivots))
    keep = surviving_cells(between, q_radius, b_count, b_radius, reach)
    keep &= (q_count > 0)[:, None]

    def packed(side: DataFrame, count: np.ndarray, columns: Sequence[str], deal: int) -> DataFrame:
        """Blocks (place, cell, block), written."""

        def pack_rows(table: pa.Table) -> pa.Table:
            cell, part = (table.column(c)[0].as_py() for c in ("cell", "part"))
            return pa.table({"place": pa.array([cell << 32 | part]), "cell": pa.array([cell], pa.int32()), "block": pa.array([pack(table.select(columns))])})

        # A row for each pivot.
        parts = spark.createDataFrame(pd.DataFrame({"cell": np.arange(n_pivots, dtype=np.int32), "parts": np.maximum(1, -(-count // block_rows))}), "cell int, parts long")
        dealt = side.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("away", "parts")
        return cut_lineage(dealt.repartition(deal, "cell", "part").groupBy("cell", "part").applyInArrow(pack_rows, "place long, cell int, block binary"))

    right = packed(b, b_count, base.columns, right_parts(n_base, pivots.shape[1]))
    left = packed(q, q_count, queries.columns, min(MOST_PARTS, int((-(-q_count // block_rows)).sum()) or 1))
    q.unpersist(), b.unpersist()
    # At most MAX_PIVOTS^2 numbers.
    reached = spark.createDataFrame([(i, np.flatnonzero(r).tolist()) for i, r in enumerate(keep)], "cell int, reached array<int>")
    left = left.join(F.broadcast(reached), "cell").select("place", "reached", "block")
    right = right.select(F.col("place").alias("to"), "cell", F.col("block").alias("other"))
    on = F.array_contains("reached", F.col("cell"))
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(block: pa.Table, others: Iterable[pa.Table]) -> Iterator[pa.RecordBatch]:
        own = block.to_pandas()
        for other in others:
            yield pa.RecordBatch.from_pandas(kernel(own, other.to_pandas()), schema=out, preserve_index=False)

    return crossed(left, right, on & (F.col("place") <= F.col("to")) if mirrored else on, run, schema)


def _near_limit(score: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores up to the k-th smallest of their row and a slack, by row; infinite scores never count."""
    k = min(k, score.shape[1])
    limit = np.partition(score, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero((score <= limit + slack) & np.isfinite(score))


def _slices(q: pd.DataFrame, width: int) -> list[pd.DataFrame]:
    """Rows of ``q``, so many at a time that a matrix with ``width`` columns has at most HELD_CELLS cells."""
    step = max(1, HELD_CELLS // max(1, width))
    return [q.iloc[at : at + step] for at in range(0, max(1, len(q)), step)]


def _topk_kernel(k: int, metric: str, skip_self: bool, other_label: bool) -> Kernel:
    def some(q: pd.DataFrame, b: pd.DataFrame, bv: np.ndarray, size: float) -> pd.DataFrame:
        qv = _matrix(q["v"])
        dist = 1.0 - qv @ bv.T if metric == "cosine" else np.sqrt(_sq_distances(qv, bv))
        if skip_self:
            dist[q["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = np.inf
        if other_label:
            dist[q["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]] = np.inf
        # The matrix product is exact to some last places only, in an order that depends on the block; near the limit each pair is computed anew.
        row, col = _near_limit(dist, k, 1e-6 * (1.0 + max(np.abs(qv).max(initial=0.0), size)))
        exact = np.empty(len(row))
        for at in range(0, len(row), HELD_PAIRS):
            a, c = qv[row[at : at + HELD_PAIRS]], bv[col[at : at + HELD_PAIRS]]
            exact[at : at + HELD_PAIRS] = np.maximum(1.0 - (a * c).sum(1), 0.0) if metric == "cosine" else np.sqrt(((a - c) ** 2).sum(1))
        order = np.lexsort((b["id"].to_numpy()[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        top = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        return pd.DataFrame({"id": q["id"].to_numpy()[row[top]], "nbr": b["id"].to_numpy()[col[top]], "dist": exact[top]})

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        bv = _matrix(b["v"])
        size = np.abs(bv).max(initial=0.0)
        return pd.concat([some(part, b, bv, size) for part in _slices(q, len(b))], ignore_index=True)

    return kernel


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("dist", "nbr")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def as_points(df: DataFrame, id_col: str, vec: str, metric: str, *keep: str) -> DataFrame:
    """id, v and further columns; unit length for the cosine metric."""
    v = vx.l2_normalize(F.col(vec)) if metric == "cosine" else vx.as_double(F.col(vec))
    return df.select(F.col(id_col).alias("id"), v.alias("v"), *keep)


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int = 1,
    metric: str = "cosine",
    skip_self=False,
    other_label=False,
    small_rows: int = SMALL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """id, rank, nbr, dist: the k nearest base points of each query point; ties by id."""
    head = _small(base, small_rows)
    if head is not None:
        hits = _beside(queries, head, _topk_kernel(k, metric, skip_self, other_label), HITS)
    else:
        base = cut_lineage(base)
        hits = two_steps(queries, base, base.count(), k, metric, skip_self, other_label, block_rows)
    return _ranked(hits, k).select("id", "rank", "nbr", "dist")


def knn_graph(
    df: DataFrame, k: int = 15, metric: str = "cosine", id_col: str = "vec_id", vec: str = "embedding", **sizes
) -> DataFrame:
    """id, rank, nbr, dist of the k nearest other rows.

    Equal vectors have equal neighbours, so each distinct vector is searched once and at most k + 1 of its copies
    stay on the base side: enough for any list, and a mass of copies costs no more than one row.
    """
    pts = as_points(df, id_col, vec, metric)
    reps = pts.groupBy("v").agg(F.min("id").alias("id"))
    # Spark trims each copy group to k + 1 rows before it shuffles (window group limit).
    copies = pts.withColumn("_c", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    base = copies.filter(F.col("_c") <= k + 1).select("id", "v")
    hits = nearest(reps, base, k + 1, metric, **sizes)
    lists = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr"))).alias("l"))
    lists = lists.withColumnRenamed("id", "rep")
    member = pts.join(reps.withColumnRenamed("id", "rep"), "v").select("id", "rep")
    own = F.slice(F.filter("l", lambda e: e["nbr"] != F.col("id")), 1, k)
    out = member.join(lists, "rep").select("id", F.posexplode(own).alias("p", "e"))
    return out.select("id", (F.col("p") + 1).alias("rank"), "e.nbr", "e.dist")


def hardest_negative(anchors: DataFrame, base: DataFrame, **sizes) -> DataFrame:
    """id, nbr, sim: the most similar row of another label. Of equal rows of one label only the first is searched."""
    first = base.groupBy("v", "label").agg(F.min("id").alias("id")).select("id", "v", "label")
    hits = nearest(anchors, first, 1, "cosine", other_label=True, **sizes)
    return hits.select("id", "nbr", (1.0 - F.col("dist")).alias("sim"))


def pairwise_cosine(
    df: DataFrame, threshold: float = 0.3, id_col: str = "vec_id", vec: str = "embedding", **sizes
) -> DataFrame:
    """Similarity of each vector to all others, block by block, kept as one row per vector.

    id, others, mean_sim, min_sim, max_sim, close (others at or above the threshold).
    """
    pts = as_points(df, id_col, vec, "cosine")

    def some(q: pd.DataFrame, b: pd.DataFrame, bv: np.ndarray) -> pd.DataFrame:
        sim = _matrix(q["v"]) @ bv.T
        other = q["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        return pd.DataFrame(
            {
                "id": q["id"].to_numpy(),
                "n": other.sum(1),
                "total": (sim * other).sum(1),
                "lo": np.where(other, sim, np.inf).min(1),
                "hi": np.where(other, sim, -np.inf).max(1),
                "close": ((sim >= threshold) & other).sum(1),
            }
        )

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        bv = _matrix(b["v"])
        return pd.concat([some(part, b, bv) for part in _slices(q, len(b))], ignore_index=True)

    hits = vector_join(pts, pts, kernel, "id long, n long, total double, lo double, hi double, close long", **{"block_rows": None, **sizes})
    agg = hits.groupBy("id").agg(
        F.sum("n").alias("others"),
        F.sum("total").alias("_t"),
        F.min("lo").alias("min_sim"),
        F.max("hi").alias("max_sim"),
        F.sum("close").alias("close"),
    )
    return agg.withColumn("mean_sim", F.try_divide("_t", "others")).drop("_t").filter(F.col("others") > 0)


def fuzzy_graph(knn: DataFrame, k: int = 15, steps: int = 40) -> DataFrame:
    """a, b, weight (a < b) from neighbour lists.

    rho is the nearest distance above zero; sigma is found by halving so that a row's weights sum to log2 k;
    the two directions are joined by the probabilistic union.
    """
    lists = knn.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "nbr", "dist"))).alias("e"),
        F.min(F.when(F.col("dist") > 0, F.col("dist"))).alias("rho"),
    )
    lists = lists.withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    excess = F.transform(F.col("e"), lambda x: F.greatest(x["dist"] - F.col("rho"), F.lit(0.0)))
    lists = lists.withColumn("x", excess)
    sigma = F.pandas_udf(_solve_sigma(float(np.log2(k)), steps), "double")
    lists = lists.withColumn("sigma", sigma("x"))
    one = lists.select(
        "id", "rho", "sigma", F.explode(F.transform("e", lambda x: F.struct(x["nbr"].alias("nbr"), x["dist"].alias("dist")))).alias("t")
    )
    weight = F.exp(-F.greatest(F.col("t.dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma"))
    directed = one.select(
        F.least("id", "t.nbr").alias("a"), F.greatest("id", "t.nbr").alias("b"), weight.alias("w")
    )
    # Both directions of a pair land in one group: a + b - ab = 1 - (1 - a)(1 - b).
    return directed.groupBy("a", "b").agg(
        (F.sum("w") - F.when(F.count("w") == 2, F.max("w") * F.min("w")).otherwise(0.0)).alias("weight")
    )


def _solve_sigma(target: float, steps: int):
    def solve(x: pd.Series) -> pd.Series:
        out = np.ones(len(x))
        sizes = x.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            d = np.stack(x.to_numpy()[at]).astype(float)
            lo, hi, mid = np.zeros(len(at)), np.full(len(at), np.inf), np.ones(len(at))
            for _ in range(steps):
                high = np.exp(-d / mid[:, None]).sum(1) > target
                hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
                mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
            out[at] = np.maximum(mid, 1e-9)
        return pd.Series(out)

    solve.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return solve


#: A node with more edges than this is a hub: its edges are dealt to several places, and its coordinates go to each.
HUB_EDGES = 100_000


def spectral_layout(graph: DataFrame, k: int = 2, tolerance: float = 1e-8, extra: int = 12, seed: int = 42, held_bytes: int = HELD_BYTES) -> DataFrame:
    """id, coords: the k leading non-trivial eigenvectors of the normalised graph, to a residual of ``tolerance``.

    All steps run on blocks of nodes with the numbers of all nodes beside them, if these fit ``held_bytes``, else the filter's steps on blocks alone
    (``blockgraph``). With hubs, and beyond these bytes for one application in a round, a step is a join of the edges, which stay dealt by their ends while the
    fit runs, and a sum per node.
    Raises RuntimeError if the residuals don't settle. A graph with fewer than k + 2 nodes, or an empty one, has fewer coordinates or none.
    """
    both = graph.select("a", "b", "weight").union(graph.select(F.col("b"), F.col("a"), "weight"))
    degree = cut_lineage(both.groupBy("a").agg(F.sum("weight").alias("deg"), F.count(F.lit(1)).alias("n")))
    nodes = degree.count()
    width, k = min(k + extra, nodes - 1), min(k, nodes - 1)
    if width < 1:
        return degree.select(F.col("a").alias("id"), F.array().cast("array<double>").alias("coords"))
    places = F.ceil(F.col("n") / HUB_EDGES)
    edges = both.join(degree.select("a", F.col("deg").alias("da")), "a")
    edges = edges.join(degree.select(F.col("a").alias("b"), F.col("deg").alias("db"), places.alias("places")), "b")
    weight = F.col("weight") / F.sqrt(F.col("da") * F.col("db")) / 2
    # Half a step plus half of staying put keeps every eigenvalue positive; a node's edge to itself also carries what else it knows.
    half = edges.select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).alias("place"), weight.alias("w"))
    stay = degree.select("a", F.col("a").alias("b"), F.pmod(F.xxhash64("a"), places).alias("place"), F.lit(0.5).alias("w"))
    edges = cut_lineage(half.union(stay))
    hubs = degree.filter(F.col("n") > HUB_EDGES).limit(1).count() > 0
    packed = None if hubs or dict(degree.dtypes)["a"] != "bigint" else BlockGraph(edges.select("a", "b", "w"), nodes)
    if packed and 8 * nodes * width <= held_bytes:
        packed = packed.held()
    edges = edges.repartition("b", "place").persist()
    total = degree.agg(F.sum("deg")).first()[0]

    def moved(x: DataFrame, names: Sequence[str], *carried: str) -> DataFrame:
        """id, carried and, as ``m_`` columns, the image of ``names``: one join of the edges and one sum per node."""
        sent = x.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places").cast("long") - 1))).withColumnRenamed("id", "b")
        own = [F.max(F.when(F.col("a") == F.col("b"), F.col(c))).alias(c) for c in carried]
        image = [F.sum(F.col("w") * F.col(n)).alias(f"m_{n}") for n in names]
        return edges.join(sent, ["b", "place"]).groupBy("a").agg(*own, *image).withColumnRenamed("a", "id")

    def apply(x: DataFrame, names: Sequence[str]) -> DataFrame:
        if isinstance(packed, HeldGraph):
            return packed.apply(x, names)
        return moved(x, names).select("id", *[F.col(f"m_{n}").alias(n) for n in names])

    def advance(state: DataFrame, names: Sequence[str]) -> DataFrame:
        return three_terms(moved(state, names, *kept, "scale", *names, *[f"p_{n}" for n in names]), "id", names, kept)

    def several(state: DataFrame, names: Sequence[str], steps: int, scale: float) -> DataFrame:
        return packed.three_terms(state, names, steps, scale).join(start, "id")

    kept = ["t", "places"]
    names = [f"x{i}" for i in range(width)]
    start = degree.select(F.col("a").alias("id"), F.sqrt(F.col("deg") / total).alias("t"), places.cast("double").alias("places"))
    try:
        found, _ = leading(apply, random_columns(start, "id", names, seed), "id", names, k, tolerance, ["t"], ["places"], advance, several if packed else None)
        return found.select("id", F.array(*names[:k]).alias("coords"))
    finally:
        edges.unpersist()
        if packed:
            packed.close()


def layout_transform(layout: DataFrame, hits: DataFrame, k: int = 2) -> DataFrame:
    """Coordinates of new points: mean of their train neighbours', weighted by 1 / (distance + small)."""
    w = 1.0 / (F.col("dist") + 1e-6)
    joined = hits.join(layout.withColumnRenamed("id", "nbr"), "nbr").withColumn("w", w)
    sums = joined.groupBy("id").agg(
        F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.get("coords", F.lit(i))).alias(f"s{i}") for i in range(k)]
    )
    return sums.select("id", F.array(*[F.col(f"s{i}") / F.col("sw") for i in range(k)]).alias("coords"))
