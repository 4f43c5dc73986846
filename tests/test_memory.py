"""What a task of the vector searches holds."""

import numpy as np
from pyspark.sql import functions as F

from gistmill.operators import neighbours as nb
from gistmill.operators import search as sr


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bins_of_a_query_are_listed_and_become_rows_in_spark(spark):
    v = np.random.default_rng(3).standard_normal((120, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    pts = nb.as_points(df, "vec_id", "embedding", "euclidean")
    rows, grid = sr.build_grid(pts, 120, 10)
    own = sr.first_bounds(pts, grid, 3, False).withColumn("bound", F.lit(1.0)).persist()
    sent = sr.routes(own, grid)
    assert "Generate explode" in plan(sent)
    got = sorted((r["id"], r["bin"], r["work"]) for r in sent.collect())
    far = grid.from_pivots(v)
    want = []
    for i, cell in enumerate(far.argmin(1)):
        reached = grid.reached(far[i : i + 1], far[i : i + 1, cell], np.array([cell]), slice(None), np.ones(1))[0]
        bins = {int(b) for b in grid.bin_of[reached]} - {int(grid.bin_of[cell])}
        want += [(i, b, int(grid.count[reached & (grid.bin_of == b)].sum())) for b in bins]
    assert got == sorted(want) and len(got) > 120
    # No bin beyond the own one is reached, and no queries.
    assert sr.routes(own.withColumn("bound", F.lit(-1.0)), grid).count() == 0
    assert sr.routes(own.limit(0), grid).count() == 0


def test_blocks_are_held_in_small_slices(spark):
    # 4,096 rows of a block against 4,096: a matrix of a slice takes 4 MB.
    assert nb.HELD_CELLS * 8 <= 4 << 20 and sr.HELD_CELLS * 8 <= 4 << 20
