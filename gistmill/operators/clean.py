"""Row-wise corpus preparation. All narrow, so usable on a stream as well."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.dims import STOP_WORDS, fine_dim
from gistmill.functions import text as tx
from gistmill.functions.arrays import once
from gistmill.functions.joins import SENT_BYTES, spread_join
from gistmill.session import cut_lineage
from gistmill.sources.readers import with_label_names


def filter_short(df: DataFrame, min_length: int = 50) -> DataFrame:
    return df.filter(F.length("text") > min_length)


def short_report(df: DataFrame, min_length: int = 50) -> DataFrame:
    """Documents before, dropped and kept, in one aggregate."""
    keep = F.length("text") > min_length
    return df.agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped"),
        F.count_if(keep).alias("kept"),
    )


def lemmatize(df: DataFrame, lemmas: DataFrame, col: str = "text") -> DataFrame:
    """Replace each word of ``col`` by its lemma from the table (token, lemma), the first by order where it has several; pure punctuation is dropped.

    The table goes to the tasks if its measured size allows, and words are looked up in their row; a larger one is joined
    in slices, and one document's words are regrouped.
    """
    base = cut_lineage(lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")))
    size = base.agg(F.sum(F.octet_length("token") + F.octet_length("lemma") + 32).alias("n")).first()["n"] or 0
    if size > SENT_BYTES:
        return _lemmatize_by_join(df, base, col)
    held = df.sparkSession.sparkContext.broadcast(base.where("token is not null and lemma is not null").toArrow())
    given = df.withColumn(col, tx.words(F.col(col)))
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == col else f for f in df.schema.fields])

    def look_up(batches):
        tokens, lemma = held.value.column("token").combine_chunks(), held.value.column("lemma").combine_chunks()
        for batch in batches:
            lists = batch.column(col)
            words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            kept = pc.invert(pc.match_substring_regex(words, r"^[!-/:-@\[-`{-~]+$"))
            words, row = words.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
            found = pc.coalesce(lemma.take(pc.index_in(words, value_set=tokens)), words)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), found), " ")
            yield pa.RecordBatch.from_arrays([text if n == col else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return given.mapInArrow(look_up, schema)


def _lemmatize_by_join(df: DataFrame, base: DataFrame, col: str) -> DataFrame:
    w = df.select("doc_id", F.posexplode(tx.words(F.col(col))).alias("_i", "_w"))
    w = w.filter(~F.col("_w").rlike(r"^\p{Punct}+$"))
    joined = spread_join(w, base.withColumnRenamed("token", "_w"), ["_w"], "doc_id", "left").select("doc_id", "_i", F.coalesce("lemma", "_w").alias("_l"))
    text = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_l"))).alias("_ws"))
    text = text.select("doc_id", F.array_join(F.transform("_ws", lambda s: s["_l"]), " ").alias("_text"))
    return df.join(text, "doc_id", "left").withColumn(col, F.coalesce("_text", F.lit(""))).drop("_text")


def clean_sparse(df: DataFrame, stop: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None, col: str = "text") -> DataFrame:
    """Basic cleaning, stop word removal, and lemmas where a table is given, of column ``col``."""
    out = once(df, col, tx.clean_basic(F.col(col)))
    out = once(out, col, tx.remove_stopwords(F.col(col), stop))
    return lemmatize(out, lemmas, col) if lemmas is not None else out


def sliding_segments(df: DataFrame, window: int = 512, stride: int = 256) -> DataFrame:
    """doc_id, segment number, segment."""
    return df.select("doc_id", F.posexplode(tx.sliding_segments(F.col("text"), window, stride)).alias("seg", "segment"))


def add_broad_category(df: DataFrame) -> DataFrame:
    """Fine label name to broad id; unknown labels give null."""
    dim = fine_dim(df.sparkSession).select("label", "broad_label_id")
    return df.join(F.broadcast(dim), "label", "left")


def prepare_corpus(posts: DataFrame, min_length: int = 50) -> DataFrame:
    """Raw posts (doc_id, raw, label_id, split) to clean text with label names, short ones dropped."""
    clean = once(posts, "text", tx.clean_basic(F.col("raw"))).select("doc_id", "text", "label_id", "split")
    return with_label_names(filter_short(clean, min_length)).select("doc_id", "text", "label_id", "label", "split")


def build_variants(clean: DataFrame, stop: Sequence[str] = STOP_WORDS, lemmas: DataFrame | None = None) -> DataFrame:
    """basic, sparse_repr and broad_category stacked, with the variant name as a column. The corpus is read and cleaned once."""
    both = add_broad_category(clean_sparse(clean.withColumn("_sparse", F.col("text")), stop, lemmas, "_sparse"))
    none = F.lit(None).cast("int")

    def variant(name: str, text: str, broad: Column) -> Column:
        return F.struct(F.lit(name).alias("variant"), F.col(text).alias("text"), broad.alias("broad_label_id"))

    each = F.array(variant("basic", "text", none), variant("sparse_repr", "_sparse", none), variant("broad_category", "text", F.col("broad_label_id").cast("int")))
    rows = both.select("doc_id", "label_id", "label", "split", F.explode(each).alias("_v"))
    return rows.select("doc_id", "_v.text", "label_id", "label", "_v.broad_label_id", "_v.variant", "split")


def widen_embedding(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.get(F.col(col), F.lit(i)).alias(f"emb_{i}") for i in range(dim)])


def nest_embedding(df: DataFrame, col: str = "embedding") -> DataFrame:
    wide = sorted((c for c in df.columns if c.startswith("emb_")), key=lambda c: int(c[4:]))
    rest = [c for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*wide).alias(col))


def select_label_column(df: DataFrame, variant: str) -> DataFrame:
    """The training label: broad id for the broad variant, fine label name otherwise."""
    return df.select("doc_id", "text", F.col("broad_label_id" if variant == "broad_category" else "label").alias("label"))
