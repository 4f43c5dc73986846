"""Bag of words, TF-IDF, truncated SVD and PCA."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions import vectors as vx
from gistmill.functions.arrays import histogram, once
from gistmill.functions.joins import SENT_BYTES, spread_join
from gistmill.session import cut_lineage

MAX_SVD_TERMS = 50_000
#: Entries of sparse rows that a task multiplies at a time.
HELD_ENTRIES = 1 << 16


def tokenize_terms(
    df: DataFrame,
    stop: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    text_col: str = "text",
    preprocess: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds ``terms``: array of word n-grams, of the text as ``preprocess`` leaves it."""
    text = F.col(text_col) if preprocess is None else preprocess(F.col(text_col))
    return once(df, "terms", tx.terms(text, stop, ngram_range))


def counted(df: DataFrame) -> DataFrame:
    """``terms`` replaced by ``counts`` (term, tf) and written to the shared folder, so that cleaning and tokenising run once."""
    if "counts" in df.columns:
        return df
    return cut_lineage(df.select(*[c for c in df.columns if c != "terms"], histogram(F.col("terms")).alias("counts")))


def term_counts(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id, term, tf. Counted inside each row, so nothing is shuffled."""
    cols = ["doc_id", *keep]
    counts = F.col("counts") if "counts" in df.columns else histogram(F.col("terms"))
    return df.select(*cols, F.explode(counts).alias("_e")).select(*cols, "_e.term", "_e.tf")


def build_vocabulary(
    df: DataFrame,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """term, df, tf, n_docs of the terms inside the document-frequency band, the most frequent ones where capped.

    Documents are counted once and written; their number and the frequencies are read from there. A float bound is a share of the documents.
    The result is a written table.
    """
    docs = counted(df)
    n = docs.count()
    low, high = (x if isinstance(x, int) else x * n for x in (min_df, max_df))
    vocab = term_counts(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    vocab = vocab.filter((F.col("df") >= low) & (F.col("df") <= high)).withColumn("n_docs", F.lit(n).cast("long"))
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("tf"), "term").limit(max_features)
    return cut_lineage(vocab)


def _in_row(df: DataFrame, vocabulary: DataFrame, weigh: bool) -> DataFrame | None:
    """doc_id, term and tf, or weight, of the counts of each row; None if the vocabulary is too large to be sent to the tasks.

    Terms are looked up, weighed and brought to unit length where the row is, so that no posting is moved.
    """
    size = vocabulary.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term")).alias("text")).first()
    if size["rows"] * 16 + (size["text"] or 0) > SENT_BYTES:
        return None
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0 if weigh else F.lit(1.0)
    held = df.sparkSession.sparkContext.broadcast(vocabulary.select("term", idf.alias("idf")).toArrow())
    counts = F.col("counts") if "counts" in df.columns else histogram(F.col("terms"))
    given = df.select("doc_id", counts.alias("counts"))
    kind, last = given.schema["doc_id"].dataType.simpleString(), "weight double" if weigh else "tf bigint"

    def look_up(batches):
        names = held.value.column("term").combine_chunks()
        idf = held.value.column("idf").to_numpy()
        for batch in batches:
            lists = batch.column("counts")
            row, pairs = pc.list_parent_indices(lists), lists.flatten()
            at = pc.index_in(pairs.field("term"), value_set=names)
            known = at.is_valid()
            row, at = row.filter(known), at.filter(known).to_numpy()
            value = pairs.field("tf").filter(known)
            if weigh:
                w = value.to_numpy() * idf[at]
                length = np.sqrt(np.bincount(row.to_numpy(), w * w, batch.num_rows))
                value = pa.array(w / length[row.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), names.take(pa.array(at)), value], ["doc_id", "term", last.split(" ")[0]])

    return given.mapInArrow(look_up, f"doc_id {kind}, term string, {last}")


def count_vectorize(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, term, tf on a fitted vocabulary."""
    found = _in_row(df, vocabulary, False)
    if found is None:
        found = spread_join(term_counts(df), vocabulary.select("term"), ["term"], "doc_id").select("doc_id", "term", "tf")
    return found


def tfidf_transform(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, term, weight: smooth idf of the fitted vocabulary, unit length per document."""
    found = _in_row(df, vocabulary, True)
    if found is not None:
        return found
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    raw = spread_join(term_counts(df), vocabulary.select("term", idf.alias("_idf")), ["term"], "doc_id")
    raw = raw.select("doc_id", "term", (F.col("tf") * F.col("_idf")).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return raw.withColumn("weight", F.col("_w") / length).drop("_w")


def tfidf(df: DataFrame, min_df=3, max_df=0.85, max_features: int | None = 10_000) -> DataFrame:
    docs = counted(df)
    return tfidf_transform(docs, build_vocabulary(docs, min_df, max_df, max_features))


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, vx.l2_normalize(F.col(col)))


class TruncatedSVD:
    """Uncentred SVD of sparse document rows by restarted block Krylov iteration.

    The matrix stays distributed: each pass every task multiplies its rows with the current block of (terms x width) directions and
    returns partial sums per term. BLOCKS blocks make the space from which the best directions are taken; their residuals end the fit, and the fit
    raises if they don't fall below the tolerance (of the largest squared singular value). Terms are capped by the vocabulary, so a block has a fixed size
    whatever the number of documents.
    """

    BLOCKS, RESTARTS = 5, 40

    def __init__(self, k: int = 30, oversample: int = 10, tolerance: float = 1e-8, seed: int = 42):
        self.k, self.oversample, self.tolerance, self.seed = k, oversample, tolerance, seed

    def _rows(self, weights: DataFrame) -> DataFrame:
        idx = weights.sparkSession.createDataFrame(
            pd.DataFrame({"term": self.terms, "_j": range(len(self.terms))}), "term string, _j int"
        )
        joined = weights.join(F.broadcast(idx), "term")
        grouped = joined.groupBy("doc_id").agg(F.collect_list(F.struct("_j", "weight")).alias("_e"))
        return grouped.select("doc_id", F.col("_e._j").alias("_j"), F.col("_e.weight").alias("_w"))

    @staticmethod
    def _dense(pdf: pd.DataFrame, basis: np.ndarray) -> np.ndarray:
        """Rows of (documents x basis width)."""
        out = np.zeros((len(pdf), basis.shape[1]))
        for rows, starts, j, w in TruncatedSVD._slices(pdf):
            out[rows] = np.add.reduceat(w[:, None] * basis[j], starts)
        return out

    @staticmethod
    def _slices(pdf: pd.DataFrame):
        """(rows, where each begins, term numbers, weights) of some rows at a time, each with a term at least."""
        ends = np.cumsum(pdf["_j"].map(len).to_numpy())
        j, w = np.concatenate(pdf["_j"].to_list()).astype(int), np.concatenate(pdf["_w"].to_list())
        row = at = 0
        while row < len(ends):
            after = max(row + 1, int(np.searchsorted(ends, at + HELD_ENTRIES, side="right")))
            starts = np.append(at, ends[row : after - 1]) - at
            yield slice(row, after), starts, j[at : ends[after - 1]], w[at : ends[after - 1]]
            row, at = after, int(ends[after - 1])

    def fit(self, weights: DataFrame) -> TruncatedSVD:
        found = weights.select("term").distinct().limit(MAX_SVD_TERMS + 1).toPandas()
        if len(found) > MAX_SVD_TERMS:
            raise ValueError(f"cap the vocabulary at {MAX_SVD_TERMS} terms first")
        self.terms = sorted(found["term"])
        n, width = len(self.terms), min(self.k + self.oversample, len(self.terms))
        rows = self._rows(weights).persist()
        slices = self._slices

        def image(basis: np.ndarray) -> np.ndarray:
            """The transposed matrix times the matrix times the basis: one pass over the rows."""
            held = weights.sparkSession.sparkContext.broadcast(basis)
            wide = basis.shape[1]

            def partial(batches):
                total = np.zeros((n, wide))
                for pdf in batches:
                    if len(pdf):
                        for rows, starts, j, w in slices(pdf):
                            image = np.add.reduceat(w[:, None] * held.value[j], starts)
                            sizes = np.diff(np.append(starts, len(j)))
                            order = np.argsort(j, kind="stable")
                            first = np.flatnonzero(np.append(True, j[order][1:] != j[order][:-1]))
                            parts = w[order, None] * image[np.repeat(np.arange(len(sizes)), sizes)[order]]
                            total[j[order][first]] += np.add.reduceat(parts, first)
                hit = np.flatnonzero(total.any(axis=1))
                yield pd.DataFrame({"_j": hit, "_v": list(total[hit])})

            parts = rows.mapInPandas(partial, "_j int, _v array<double>")
            summed = parts.groupBy("_j").agg(*[F.sum(F.get("_v", F.lit(c))).alias(f"c{c}") for c in range(wide)])
            got = summed.toPandas().set_index("_j")
            held.unpersist()
            out = np.zeros((n, wide))
            out[got.index.to_numpy()] = got.to_numpy()
            return out

        def independent(block: np.ndarray, space: np.ndarray) -> np.ndarray:
            """Orthonormal directions of the block that the space doesn't hold yet."""
            size = np.linalg.norm(block, axis=0).max(initial=0.0)
            for _ in range(2):
                block = block - space @ (space.T @ block)
            left, values, _ = np.linalg.svd(block, full_matrices=False)
            return left[:, values > 1e-12 * size]

        try:
            space = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((n, width)))[0]
            images = image(space)
            for _ in range(self.RESTARTS):
                last = images
                for _ in range(self.BLOCKS - 1):
                    block = independent(last, space)
                    if not block.shape[1]:
                        break
                    last = image(block)
                    space, images = np.hstack([space, block]), np.hstack([images, last])
                small = space.T @ images
                values, turn = np.linalg.eigh((small + small.T) / 2)
                values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
                space, images = space @ turn, images @ turn
                off = np.linalg.norm(images - space * values, axis=0)[: self.k]
                if off.max(initial=0.0) <= self.tolerance * max(values[0], 1e-300):
                    break
            else:
                raise RuntimeError("singular values did not settle")
        finally:
            rows.unpersist()
        v = space[:, : self.k]
        flip = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        self.components = v * flip
        self.singular_values = np.sqrt(np.maximum(values[: self.k], 0.0))
        return self

    def transform(self, weights: DataFrame, out: str = "embedding") -> DataFrame:
        """doc_id and k numbers per document that holds at least one fitted term."""
        held = weights.sparkSession.sparkContext.broadcast(self.components)
        dense = self._dense

        def project(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"doc_id": pdf["doc_id"], out: list(dense(pdf, held.value))})

        return self._rows(weights).mapInPandas(project, f"doc_id long, {out} array<double>")


def truncated_svd(train: DataFrame, test: DataFrame | None = None, k: int = 30) -> DataFrame:
    """Fit on train weights; rows of both splits in the same k dimensions."""
    model = TruncatedSVD(k).fit(train)
    out = model.transform(train).withColumn("split", F.lit("train"))
    if test is not None:
        out = out.unionByName(model.transform(test).withColumn("split", F.lit("test")))
    return out


def pca(
    df: DataFrame, k: int = 50, fit_on: Column | None = None, col: str = "embedding", out: str = "projected"
) -> DataFrame:
    """Centred PCA, fitted on the rows where ``fit_on`` holds, applied to all; each axis points to its largest loading.

    The covariance is summed by Spark ML over the rows; only the D x D matrix is held in one place.
    """
    width = df.select(F.size(col).alias("n")).limit(1).collect()[0]["n"]
    k = min(k, width)
    v = df.withColumn("_v", array_to_vector(vx.as_double(F.col(col))))
    sample = v.filter(fit_on) if fit_on is not None else v
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(sample)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(sample))
    axes = model.pc.toArray()
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    done = model.transform(centre.transform(v))
    signs = F.array(*[F.lit(float(s)) for s in flip])
    return done.withColumn(out, F.zip_with(vector_to_array("_p"), signs, lambda x, s: x * s)).drop("_v", "_c", "_p")


def pca_or_skip(df: DataFrame, k: int = 50, **kw) -> DataFrame:
    """PCA to k, or the vectors as they are when they have fewer than k dimensions."""
    width = df.select(F.size(kw.get("col", "embedding")).alias("n")).limit(1).collect()[0]["n"]
    if width < k:
        return df.withColumn(kw.get("out", "projected"), vx.as_double(F.col(kw.get("col", "embedding"))))
    return pca(df, k, **kw)
