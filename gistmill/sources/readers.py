"""Corpus, variant, embedding, prediction and projection readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.dims import fine_dim

PROJECTION_SCHEMA = "doc_id long, text string, label string, x double, y double"


def with_label_names(posts: DataFrame) -> DataFrame:
    """Resolve label_id to the fine label name. A null id has a null name; an id outside the list is an error when the plan runs."""
    names = F.broadcast(fine_dim(posts.sparkSession).select("label_id", "label"))
    unknown = F.raise_error(F.concat(F.lit("unknown label_id "), F.col("label_id").cast("string"))).cast("string")
    named = F.when(F.col("label").isNull() & F.col("label_id").isNotNull(), unknown).otherwise(F.col("label"))
    return posts.join(names, "label_id", "left").withColumn("label", named)


def load_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled raw posts (doc_id, raw, label_id, split) of one split; parquet gets the split filter."""
    posts = spark.read.parquet(path)
    if split is not None:
        posts = posts.filter(F.col("split") == split)
    return with_label_names(posts)


def load_variant(
    spark: SparkSession, variant: str, path: str | None = None, jdbc: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a stored variant: from the partitioned layout, or from one database table per split.

    ``jdbc`` holds reader options (url, driver, and where wanted partitionColumn, lowerBound,
    upperBound, numPartitions); the table name is made from split and variant.
    """
    if (path is None) == (jdbc is None):
        raise ValueError("give either path or jdbc")
    if path is not None:
        stored = spark.read.parquet(path).filter(F.col("variant") == variant)
        return tuple(stored.filter(F.col("split") == s) for s in ("train", "test"))
    schema = jdbc.get("schema", "newsgroup")
    options = {k: v for k, v in jdbc.items() if k != "schema"}
    reader = spark.read.format("jdbc").options(**options)
    return tuple(reader.option("dbtable", f"{schema}.{s}_{variant}").load() for s in ("train", "test"))


def read_predictions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Prediction CSV; must hold the columns label and predicted_label. Fields with line breaks need `multi_line`, one task for each file."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    if not {"label", "predicted_label"} <= set(df.columns):
        raise ValueError("CSV must hold the columns 'label' and 'predicted_label'")
    return df


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_projection(spark: SparkSession, path: str, schema: str = PROJECTION_SCHEMA, multi_line: bool = False) -> DataFrame | None:
    """A saved projection, or None where there is none. Fields with line breaks need `multi_line`, one task for each file."""
    try:
        return spark.read.csv(path, header=True, schema=schema, multiLine=multi_line, escape='"')
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
