"""Shards of bounded size by extendible hashing.

A directory is indexed by the first bits of a hash of the id. A bucket whose rows hold more than the limit is split on one more bit, the others
are left as they are, until every bucket fits. The directory is made STRIDE bits at a time: cells of that many more bits are summed up once, a bucket
is the shortest prefix that fits, and only cells that don't fit by themselves are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, STRIDE = 60, 8
LIMIT = 1 << 20
#: Cells of a round that are sent to all tasks (12 bytes each); more are joined by a shuffle.
SENT_CELLS = 500_000


def hash_bits(id_col: str | Column) -> Column:
    """60 bits of the MD5 of the id as text; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _cells(sized: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Rows (cell, depth): the bucket of each cell of `high` bits, as its number of bits; null where the cell itself is too large."""
    cells = sized.groupBy(F.shiftright("hash", BITS - high).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    depths = F.sequence(F.lit(low), F.lit(high)) if low == 0 else F.sequence(F.lit(low + 1), F.lit(high))
    prefixes = cells.select("cell", "n_bytes", F.explode(depths).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = prefixes.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("s")).where(F.col("s") <= limit).select("depth", "prefix")
    buckets = prefixes.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(buckets, "cell", "left")


def sharded(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text", cut=None) -> DataFrame:
    """All rows and columns of `docs` and the struct `shard`: prefix (its first bits as a number), depth (how many), chain, n_bytes (of the row).
    An old column of that name gives way.

    The texts of a shard hold `limit` bytes of UTF-8 at most, but for one row that is larger by itself. Rows of one id lie together until they
    don't fit: then no bit parts them, and the bucket is chained: rows of over half the limit take a link each, the others fill links in the
    order in which they are read. A null text has no bytes, null ids are one id, an empty table gives none. cut: what to do with small tables
    between the rounds; a reliable checkpoint if left out.
    """
    from gistmill.session import cut_lineage

    cut = cut or cut_lineage
    sized = cut(docs.select(hash_bits(id_col).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes")))
    out = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "shard"]).alias("row"), hash_bits(id_col).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = out.withColumns({"prefix": F.lit(None).cast("bigint"), "depth": F.lit(None).cast("int")})
    low, over = 0, None
    while low < BITS:
        high = min(BITS, low + STRIDE)
        cells = cut(_cells(sized, low, high, limit))
        found = cells.where("depth is not null").select("cell", F.col("depth").cast("int").alias("d"))
        # The rows of `docs` are large: they stay where they are as long as this part of the directory can be sent to them.
        if cells.limit(SENT_CELLS + 1).count() <= SENT_CELLS:
            found = F.broadcast(found)
        out = out.withColumn("cell", F.when(F.col("depth").isNull(), F.shiftright("hash", BITS - high))).join(found, "cell", "left")
        out = out.select("row", "hash", "n_bytes", F.coalesce("prefix", F.expr(f"shiftright(cell, {high} - d)")).alias("prefix"), F.coalesce("depth", "d").alias("depth"))
        over = cells.where("depth is null").select("cell")
        if over.isEmpty():
            return out.select("row.*", F.struct("prefix", "depth", F.lit(0).cast("bigint").alias("chain"), "n_bytes").alias("shard"))
        sized = cut(sized.withColumn("cell", F.shiftright("hash", BITS - high)).join(over, "cell", "left_semi").drop("cell"))
        low = high
    return _chained(out, limit)


def _chained(out: DataFrame, limit: int) -> DataFrame:
    """Links for rows that no bit parts: running sums within each part of the input, and of the parts before it."""
    from gistmill.session import cut_lineage

    # These rows are stored with their parts: the id of a partition may be another one wherever a frame is planned anew, and both branches need the same.
    part = cut_lineage(out.where("depth is null").withColumn("part", F.spark_partition_id()))
    large = F.col("n_bytes") > limit // 2
    here = Window.partitionBy("hash", "part").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    fill = lambda w: {"bytes": F.coalesce(F.sum(F.when(~large, F.col("n_bytes")).otherwise(0)).over(w), F.lit(0)), "rows": F.coalesce(F.sum(large.cast("int")).over(w), F.lit(0))}
    left = part.withColumns(fill(here))
    totals = part.groupBy("hash", "part").agg(F.sum(F.when(~large, F.col("n_bytes")).otherwise(0)).alias("b"), F.sum(large.cast("int")).alias("r"))
    before = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("hash", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    # Links of large rows have odd numbers, those that are filled even ones.
    link = F.when(large, 2 * (F.col("rows") + F.col("r0")) + 1).otherwise(2 * F.floor((F.col("bytes") + F.col("b0")) / F.lit(max(1, limit // 2))))
    link = F.when(F.col("b0").isNotNull(), link).otherwise(F.raise_error(F.lit("a part has no total")))
    chained = left.join(totals, ["hash", "part"], "left").select("row", F.struct(F.col("hash").alias("prefix"), F.lit(BITS).alias("depth"), link.cast("bigint").alias("chain"), "n_bytes").alias("shard"))
    fitting = out.where("depth is not null").select("row", F.struct("prefix", "depth", F.lit(0).cast("bigint").alias("chain"), "n_bytes").alias("shard"))
    return fitting.union(chained).select("row.*", "shard")


def write_shards(frame: DataFrame, path: str, width: int = 256) -> None:
    """Writes the rows of `sharded` as Parquet, a folder for each shard; a shard is written by one task, and tasks take `width` shards at a time."""
    name = F.concat_ws("-", F.lpad(F.conv(F.col("shard.prefix").cast("string"), 10, 16), 15, "0"), F.col("shard.depth"), F.col("shard.chain"))
    frame.withColumn("shard_name", name).drop("shard").repartition(width, "shard_name").sortWithinPartitions("shard_name").write.partitionBy("shard_name").parquet(path)


def digest(frame: DataFrame) -> DataFrame:
    return frame.select("doc_id", F.col("shard.prefix").alias("shard"), "shard.depth", "shard.chain", "shard.n_bytes")
