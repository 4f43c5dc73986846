"""Small relational steps between topics, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.dims import OUTLIER, broad_dim
from gistmill.functions.draws import hash_key, hash_rank


def label_id_of_name(df: DataFrame, name_col: str = "tuned_topic_name", out: str = "predicted_topic_id") -> DataFrame:
    """Category name to id; null and unknown names give -1."""
    dim = broad_dim(df.sparkSession).select(F.col("name").alias(name_col), F.col("broad_label_id").alias(out))
    joined = df.join(F.broadcast(dim), name_col, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("int"))


def drop_outliers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("topic") != OUTLIER)


def drop_unmapped(df: DataFrame) -> DataFrame:
    return df.filter(F.col("predicted_topic_id") != -1)


def drop_unlabelled(df: DataFrame, name_col: str = "tuned_topic_name_pred") -> DataFrame:
    return df.dropna(subset=[name_col])


def join_topic_info_labels(info: DataFrame, labels: DataFrame) -> DataFrame:
    return info.join(labels, "topic", "left")


def join_doc_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their topic's name and explanation. Topic tables are small, and Spark measures that itself."""
    return docs.join(labels.select("topic", "tuned_topic_name", "short_explanation"), "topic", "left")


def join_with_suffix(left: DataFrame, right: DataFrame, on: str = "topic", suffix: str = "_pred") -> DataFrame:
    """Left join; columns held by both sides get the suffix on the right copy."""
    renamed = right.select(*[F.col(c).alias(c + suffix if c != on and c in left.columns else c) for c in right.columns])
    return left.join(renamed, on, "left")


def label_cardinality(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Documents and distinct labels per split (nulls are not a label)."""
    per_label = df.groupBy("split", label_col).agg(F.count(F.lit(1)).alias("_n"))
    return per_label.groupBy("split").agg(F.sum("_n").alias("docs"), F.count(label_col).alias("labels"))


def prediction_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("predicted_topic_id").agg(F.count(F.lit(1)).alias("docs")).orderBy("predicted_topic_id")


def label_distribution_by_prompt(labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("prompt", "tuned_topic_name").agg(F.count(F.lit(1)).alias("topics"))
    return counts.orderBy("prompt", F.desc("topics"), "tuned_topic_name")


def attrition_report(df: DataFrame, *by: str) -> DataFrame:
    """Rows before and after the outlier filter, share lost, rows after the unmapped filter."""
    inlier = F.col("topic") != OUTLIER
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(inlier).alias("after_outliers"),
        F.count_if(inlier & (F.col("predicted_topic_id") != -1)).alias("after_unmapped"),
    )
    removed = F.col("total") - F.col("after_outliers")
    return counts.withColumn("outliers_removed", removed).withColumn(
        "outlier_percent", F.round(F.try_divide(removed * 100.0, F.col("total")), 2)
    )


def mean_topic_probability(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("topic_probability").alias("avg_topic_prob"))


def distinct_topics(df: DataFrame) -> DataFrame:
    return drop_outliers(df.select("topic")).distinct().orderBy("topic")


def label_index(df: DataFrame, label_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """label, pos, id, members: the rows of each label numbered 0.. in hash order.

    The long form of a label -> ids map: any member is found by an equi-join on (label, pos),
    and no label's ids are gathered in one place.
    """
    return hash_rank(df.select(label_col, id_col).dropna(), label_col, id_col, seed)


def head_n(df: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def split_batches(topics: DataFrame, k: int, order: str = "topic") -> DataFrame:
    """k nearly equal ordered chunks of a topic-level table, larger ones first."""
    return topics.withColumn("batch", F.ntile(k).over(Window.orderBy(order)))


def fixed_batches(topics: DataFrame, size: int = 5, order: str = "topic") -> DataFrame:
    """Batch number and number of batches of a topic-level table."""
    every = Window.orderBy(order)
    return topics.withColumn("batch", F.floor((F.row_number().over(every) - 1) / size).cast("int") + 1).withColumn(
        "batches", F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / size).cast("int")
    )


def concat_label_batches(batches: DataFrame, ok: Column | str = "ok") -> DataFrame:
    """Rows of the batches that succeeded; topics of failed ones are simply absent."""
    return batches.filter(F.col(ok) if isinstance(ok, str) else ok)


def label_universe(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """Sorted union of the true labels and the predictions for them, from one scan; null is no label."""
    both = df.where(F.col(true_col).isNotNull()).groupBy(true_col, pred_col).agg(F.count(F.lit(1)).alias("_n"))
    return both.select(F.explode(F.array(true_col, pred_col)).alias("label")).dropna().distinct().orderBy("label")


def hash_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones for any partitioning."""
    return df.withColumn("_h", hash_key(seed, id_col)).orderBy("_h", id_col).limit(n).drop("_h")
