"""Scores for labels, clusters and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions.blocks import matrix, sq_distances
from gistmill.functions.joins import checked_join
from gistmill.functions.vectors import as_double
from gistmill.operators.neighbours import _slices, vector_join
from gistmill.operators.relational import (
    attrition_report,
    drop_outliers,
    drop_unmapped,
    hash_sample,
    label_universe,
)


def pair_counts(df: DataFrame, true_col: str, pred_col: str, *by: str) -> DataFrame:
    """label, predicted_label, n: the one pass over the predictions that every score below starts from."""
    return df.groupBy(
        *by, F.col(true_col).alias("label"), F.col(pred_col).alias("predicted_label")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """Dense counts over the label universe, zeros included. Null predictions have no column, rows without a true label no place.

    The grid is laid out by numbering the labels and joining on the number.
    """
    counts = pair_counts(df.where(F.col(true_col).isNotNull()), true_col, pred_col)
    numbered = label_universe(counts).withColumn("_i", F.row_number().over(Window.orderBy("label")))
    sized = numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    rows = sized.select("label", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i"))
    grid = rows.join(numbered.select(F.col("label").alias("predicted_label"), "_i"), "_i").drop("_i")
    joined = grid.join(counts, ["label", "predicted_label"], "left")
    return joined.select("label", "predicted_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class_f1(
    df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label", by: tuple[str, ...] = ()
) -> DataFrame:
    """label, tp, fp, fn, support, f1 for every label of the universe; 0 where F1 is undefined.

    A null prediction is a miss of its true label and no class of its own; rows without a true label are not scored.
    """
    counts = pair_counts(df.where(F.col(true_col).isNotNull()), true_col, pred_col, *by)
    hit = F.coalesce(F.col("label") == F.col("predicted_label"), F.lit(False))
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("label").alias("label"), F.lit(True).alias("is_true")),
                F.struct(F.col("predicted_label").alias("label"), F.lit(False).alias("is_true")),
            )
        ).alias("_s"),
        "n",
        hit.alias("_hit"),
    ).select(*by, "_s.label", "_s.is_true", "n", "_hit").where("label is not null")
    agg = sides.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("is_true") & F.col("_hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("is_true") & ~F.col("_hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("is_true") & ~F.col("_hit"), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("support"),
    )
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return agg.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def f1_summary(
    df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label", by: tuple[str, ...] = ()
) -> DataFrame:
    """macro_f1, weighted_f1 and samples."""
    return per_class_f1(df, true_col, pred_col, by).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
        F.sum("support").alias("samples"),
    )


def macro_f1(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    return f1_summary(df, true_col, pred_col).select("macro_f1")


def weighted_f1(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    return f1_summary(df, true_col, pred_col).select("weighted_f1")


def align_keys(truth: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """Truth and predictions matched by key; a key on one side only is an error when the plan runs."""
    t = truth.withColumn("_t", F.lit(1))
    p = pred.withColumn("_p", F.lit(1))
    ok = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    checked = t.join(p, key, "full").withColumn(
        "_ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("prediction and label keys differ")).cast("boolean"))
    )
    return checked.filter("_ok").drop("_t", "_p", "_ok")


def category_alignment(
    df: DataFrame, run_name: str = "default", true_col: str = "label", pred_col: str = "predicted_label"
) -> DataFrame:
    """One record: run_name, macro_f1, weighted_f1, labels[], per_class_f1[], confusion_matrix[][]."""
    per = per_class_f1(df, true_col, pred_col).select("label", "f1", "support")
    rows = confusion_matrix(df, true_col, pred_col).groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("predicted_label", "n"))).alias("_cells")
    )
    lines = per.join(rows, "label").agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
        F.sort_array(F.collect_list(F.struct("label", "f1", F.col("_cells.n").alias("cells")))).alias("_l"),
    )
    return lines.select(
        F.lit(run_name).alias("run_name"),
        "macro_f1",
        "weighted_f1",
        F.col("_l.f1").alias("per_class_f1"),
        F.col("_l.label").alias("labels"),
        F.col("_l.cells").alias("confusion_matrix"),
    )


def centroids(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Mean vector and size per group. Each task adds up its groups' vectors as a whole, so a group moves one row for each task."""
    first = df.select(F.size(vec).alias("n")).where("n >= 0").limit(1).collect()
    width = first[0]["n"] if first else 0
    v = F.col("_v")
    sums = df.select(by, as_double(F.col(vec)).alias("_v")).groupBy(by).agg(
        F.count(v).alias("size"), *[F.sum(F.get(v, F.lit(i))).alias(f"_s{i}") for i in range(width)]
    )
    mean = F.array(*[F.col(f"_s{i}") / F.col("size") for i in range(width)]).cast("array<double>")
    return sums.where("size > 0").select(by, mean.alias("centroid"), "size")


def _distance(a, b):
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(squares)


def check_projection(df: DataFrame, vec: str = "embedding") -> None:
    """Raise unless the vectors are 2-D and hold at least two labels."""
    facts = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).collect()[0]
    if (facts["lo"], facts["hi"]) != (2, 2):
        raise ValueError("embeddings must have two columns [x, y]")
    if len(df.select("label").distinct().limit(2).collect()) < 2:
        raise ValueError("need at least two categories")


#: Labels whose distances to all others are held at a time.
RATIO_ROWS = 256


def worst_ratios(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """id, r: the largest (s_i + s_j) / d_ij of each row of ``q``, by matrix products on blocks; near rows are measured anew."""
    bv, bs, out = matrix(b["v"]), b["s"].to_numpy(), []
    for at in range(0, len(q), RATIO_ROWS):
        part = q.iloc[at : at + RATIO_ROWS]
        qv = matrix(part["v"])
        d = sq_distances(qv, bv)
        # The product rounds off what is small beside the vectors' lengths.
        row, col = np.nonzero(d <= 1e-6 * ((qv * qv).sum(1)[:, None] + (bv * bv).sum(1)[None, :]))
        for lo in range(0, len(row), 1 << 16):
            i, j = row[lo : lo + (1 << 16)], col[lo : lo + (1 << 16)]
            d[i, j] = ((qv[i] - bv[j]) ** 2).sum(1)
        d = np.sqrt(d)
        both = part["s"].to_numpy()[:, None] + bs[None, :]
        out.append(np.divide(both, d, out=np.zeros_like(d), where=d > 0).max(1))
    return pd.DataFrame({"id": q["id"].to_numpy(), "r": np.concatenate(out) if out else np.zeros(0)})


def davies_bouldin(df: DataFrame, label_col: str = "label", vec: str = "embedding", two_d: bool = False) -> DataFrame:
    """Mean over labels of the worst (s_i + s_j) / d_ij.

    Documents are only joined to their own centroid; label pairs are formed on the small centroid table.
    """
    pts = df.select(F.col(label_col).alias("label"), as_double(F.col(vec)).alias("v"))
    if two_d:
        check_projection(pts, "v")
    cent = centroids(pts, "label", "v")
    met = checked_join(pts, cent, ["label"], "v")
    spread = met.groupBy("label").agg(F.avg(_distance(F.col("v"), F.col("centroid"))).alias("s"))
    stats = cent.join(spread, "label").select(F.xxhash64("label").alias("id"), F.col("centroid").alias("v"), "s").persist()

    worst = vector_join(stats, stats, worst_ratios, "id long, r double")
    return worst.groupBy("id").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def silhouette(
    df: DataFrame, sample: int | None = 1000, id_col: str = "vec_id", label_col: str = "label", vec: str = "embedding", seed=42
) -> DataFrame:
    """Mean (b - a) / max(a, b) with Euclidean distances; points alone in their cluster count 0.

    Blocks return one distance sum per point and cluster.
    """
    pts = df.select(F.col(id_col).alias("id"), as_double(F.col(vec)).alias("v"), F.col(label_col).alias("label"))
    if sample is not None:
        pts = hash_sample(pts, sample, "id", seed)
    pts = pts.persist()
    label_type = pts.schema["label"].dataType.simpleString()

    def kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        bv = np.stack(b["v"].to_numpy())
        codes, names = pd.factorize(b["label"])
        member = np.eye(len(names))[codes]
        total = []
        for part in _slices(q, len(b)):
            qv = np.stack(part["v"].to_numpy())
            d = np.sqrt(np.maximum((qv * qv).sum(1)[:, None] + (bv * bv).sum(1)[None, :] - 2 * qv @ bv.T, 0))
            d[part["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = 0.0
            total.append(d @ member)
        return pd.DataFrame(
            {
                "id": np.repeat(q["id"].to_numpy(), len(names)),
                "own": np.repeat(q["label"].to_numpy(), len(names)),
                "other": np.tile(names, len(q)),
                "total": np.concatenate(total).ravel(),
                "n": np.tile(member.sum(0), len(q)).astype("int64"),
            }
        )

    sums = vector_join(
        pts, pts, kernel, f"id long, own {label_type}, other {label_type}, total double, n long", block_rows=None
    ).groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    ab = sums.groupBy("id").agg(
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return ab.agg(F.avg(score).alias("silhouette"))


def evaluate_topic_predictions(df: DataFrame, *by: str) -> DataFrame:
    """Attrition and F1 of topic-based predictions after the outlier and unmapped filters."""
    kept = drop_unmapped(drop_outliers(df))
    scores = f1_summary(kept, "label", "predicted_topic_id", by)
    report = attrition_report(df, *by)
    if by:
        return report.join(scores, list(by), "left")
    return report.withColumn("_k", F.lit(1)).join(scores.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
