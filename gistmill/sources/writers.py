"""Writers. All write whole directories in parallel; re-running one gives the same rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANT_COLUMNS = ["doc_id", "text", "label_id", "label", "broad_label_id", "variant", "split"]


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_clean_csv(df: DataFrame, path: str) -> None:
    _csv(df, path)


def write_variants(df: DataFrame, path: str) -> None:
    """Replace exactly the (variant, split) partitions that ``df`` holds."""
    (
        df.select(*VARIANT_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("variant", "split")
        .parquet(path)
    )


def write_variants_jdbc(df: DataFrame, variant: str, split: str, jdbc: dict[str, str]) -> None:
    """One database table per variant and split: made if absent, emptied, then filled."""
    schema = jdbc.get("schema", "newsgroup")
    options = {k: v for k, v in jdbc.items() if k != "schema"}
    rows = df.filter((F.col("variant") == variant) & (F.col("split") == split))
    (
        rows.select("text", "label_id", "label", "broad_label_id")
        .write.format("jdbc")
        .options(**options)
        .option("dbtable", f"{schema}.{split}_{variant}")
        .option("truncate", True)
        .mode("overwrite")
        .save()
    )


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_projection(df: DataFrame, path: str) -> None:
    _csv(df, path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON record per run, in a folder per run_name."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_name")
        .json(path)
    )


def db_report(score: DataFrame, points: DataFrame, model_name: str) -> DataFrame:
    """model, score to 4 places, sample count and sorted categories."""
    seen = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    facts = seen.agg(
        F.sum("n").alias("samples"), F.array_join(F.sort_array(F.collect_list(F.col("label"))), ",").alias("categories")
    )
    named = score.select(F.lit(model_name).alias("model"), F.round("davies_bouldin", 4).alias("score"))
    return named.join(facts.withColumn("model", F.lit(model_name)), "model")


def write_db_report(score: DataFrame, points: DataFrame, model_name: str, path: str) -> None:
    db_report(score, points, model_name).write.mode("overwrite").json(path)


def write_prediction_pair(df: DataFrame, fine_path: str, broad_path: str) -> None:
    """Two CSV tables (text, label, predicted_label) from one pass over ``df``."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for grain, path in (("fine", fine_path), ("broad", broad_path)):
            _csv(
                kept.select(
                    "doc_id",
                    "text",
                    F.col(f"{grain}_label").alias("label"),
                    F.col(f"{grain}_predicted").alias("predicted_label"),
                ),
                path,
            )
    finally:
        kept.unpersist()
