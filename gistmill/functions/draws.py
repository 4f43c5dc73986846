"""Reproducible draws from md5, and a distributed ranking in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import cut_lineage


def hash_key(seed: int, *parts: Column | str) -> Column:
    """32 hex digits that order rows at random but always the same way."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw(seed: int, *parts: Column | str) -> Column:
    """A number in 0 .. 2^32-1 from the first eight hex digits."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("long")


def hash_rank(df: DataFrame, by: str | None, id_col: str, seed: int, out: str = "pos") -> DataFrame:
    """0-based position of each row within ``by`` in md5 order, plus the group size ``members``.

    The order is split on the first three hex digits: every group is ranked in 4,096 pieces
    whose offsets come from a table of counts, so one group holding most rows is still spread
    over the cluster.
    """
    keys = [by] if by else []
    keyed = df.withColumn("_h", hash_key(seed, id_col)).withColumn("_b", F.substring("_h", 1, 3))
    counts = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *keys,
        "_b",
        (F.sum("_n").over(over.orderBy("_b")) - F.col("_n")).alias("_off"),
        F.sum("_n").over(over).alias("members"),
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    return (
        keyed.withColumn("_r", F.row_number().over(inner))
        .join(offsets, [*keys, "_b"])
        .withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("long"))
        .drop("_h", "_b", "_n", "_off", "_r")
    )


def global_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """0-based position of each row in the whole order: rows are sorted by ranges, and each range starts after the rows of those before."""
    rows = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    known = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    return rows.join(F.broadcast(known), part == F.col("_p")).withColumn(out, F.col("_start") + within).drop("_m", "_p", "_start")
