"""Joins that stay spread when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 32  # a power of two


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """Equi-join with a table of one row per key, each key cut into slices by the hash of ``by``.

    A key with a third of the rows is met in 32 places, and since the result is not partitioned by the key alone,
    a following ``row_number() <= n`` per key is trimmed before it is shuffled.
    """
    slices = F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))
    # Bits of the hash: never null, so the join adds no filter below that would keep plans from being reused.
    left = big.withColumn("_slice", F.xxhash64(by).bitwiseAND(SLICES - 1))
    return left.join(small.withColumn("_slice", F.explode(slices)), [*on, "_slice"], how).drop("_slice")


#: What a side that is sent to all tasks may hold.
SENT_BYTES = 16 << 20


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], by: str, row_bytes: int = 64) -> DataFrame:
    """Equi-join with a term table (its key is the first of ``on``): sent to all tasks if rows and text fit SENT_BYTES, sliced by ``by`` beyond.

    ``small`` should be cheap to read twice. row_bytes: of a row without its key.
    """
    size = small.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.col(on[0]))).alias("text")).first()
    if size["rows"] * row_bytes + (size["text"] or 0) <= SENT_BYTES:
        return big.join(F.broadcast(small), on)
    return spread_join(big, small, on, by)


def checked_join(big: DataFrame, small: DataFrame, on: list[str], by: str, limit: int = 4096) -> DataFrame:
    """Broadcast ``small`` if it has at most ``limit`` rows, which is counted first; otherwise a sliced join."""
    small = small.persist()
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on)
    return spread_join(big, small, on, by)


#: Rows of a few numbers for each group that are sent to all tasks.
SENT_GROUPS = 1 << 18


def group_join(big: DataFrame, small: DataFrame, on: list[str], by: str) -> DataFrame:
    """As ``checked_join``, with a table of a few numbers for each group that is cheap to read twice: it is not kept in memory."""
    if small.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS:
        return big.join(F.broadcast(small), on)
    return spread_join(big, small, on, by)
