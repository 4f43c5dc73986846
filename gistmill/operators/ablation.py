"""Prompt comparison. The prompt is a column, so all prompts are scored in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.operators.evaluate import f1_summary
from gistmill.operators.labelling import apply_labeller, build_topic_prompt, read_topic_replies, topic_inputs
from gistmill.operators.relational import (
    drop_outliers,
    drop_unlabelled,
    drop_unmapped,
    join_with_suffix,
    label_id_of_name,
)
from gistmill.prompts import ABLATION_PROMPTS
from gistmill.session import cut_lineage


def kept_predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with each prompt's prediction, after the outlier, unlabelled and unmapped filters."""
    joined = join_with_suffix(docs, labels.select("topic", "prompt", "tuned_topic_name"))
    kept = drop_unlabelled(drop_outliers(joined))
    return drop_unmapped(label_id_of_name(kept, "tuned_topic_name_pred"))


def prompt_ablation(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """prompt, macro_f1, weighted_f1, samples, avg_topic_prob.

    ``docs`` holds doc_id, topic, label (broad id), tuned_topic_name and topic_probability; ``labels`` holds one
    row per prompt and labelled topic.
    """
    kept = kept_predictions(docs, labels)
    scores = f1_summary(kept, "label", "predicted_topic_id", by=("prompt",))
    prob = kept.groupBy("prompt").agg(F.avg("topic_probability").alias("avg_topic_prob"))
    return scores.join(prob, "prompt")


def run_ablation(
    docs: DataFrame, info: DataFrame, fn: Callable[[Sequence[str]], Sequence[str]], prompts: Sequence[str] = tuple(ABLATION_PROMPTS), batch_size: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(scores, labels): every topic of ``info`` named by ``fn`` under each prompt, some topics at a time, and all prompts scored on ``docs``.

    Prompts are a column, so their replies are made in one job; a prompt's batch holds no other prompt's topics. Topics whose reply can't be read are
    left out of that prompt. The labels are written, as their replies are costly. docs: as for ``prompt_ablation``.
    """
    asked = build_topic_prompt(topic_inputs(info), prompts)
    asked = cut_lineage(asked.select("topic", "prompt", "prompt_text"))
    answered = apply_labeller(asked.repartitionByRange("prompt", "topic").sortWithinPartitions("prompt", "topic"), fn, batch_size=batch_size, by="prompt")
    labels = cut_lineage(read_topic_replies(answered).filter("ok").select("topic", "prompt", "tuned_topic_name", "short_explanation"))
    return prompt_ablation(docs, labels), labels


def best_prompt(scores: DataFrame, order: Sequence[str] = tuple(ABLATION_PROMPTS)) -> DataFrame:
    """min_f1, max_f1, best (the first prompt in order that reaches the maximum), identical."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("prompt"))
    return scores.agg(
        F.min("macro_f1").alias("min_f1"),
        F.max("macro_f1").alias("max_f1"),
        F.max_by("prompt", F.struct(F.col("macro_f1"), -place)).alias("best"),
        (F.min("macro_f1") == F.max("macro_f1")).alias("identical"),
    )


def prompt_comparison(labels: DataFrame, prompts: Sequence[str] = tuple(ABLATION_PROMPTS)) -> DataFrame:
    """topic and one column of names per prompt."""
    return labels.groupBy("topic").pivot("prompt", list(prompts)).agg(F.first("tuned_topic_name"))


def prompt_disagreement(labels: DataFrame) -> DataFrame:
    """agreeing, disagreeing: topics whose prompts gave one name, and more than one."""
    named = labels.select("topic", "tuned_topic_name").distinct()
    per = named.groupBy("topic").agg(F.count(F.lit(1)).alias("names"))
    return per.agg(F.count_if(F.col("names") <= 1).alias("agreeing"), F.count_if(F.col("names") > 1).alias("disagreeing"))


def per_topic_names(labels: DataFrame) -> DataFrame:
    """topic, names: distinct names given to a topic."""
    named = labels.select("topic", "tuned_topic_name").distinct()
    return named.groupBy("topic").agg(F.count(F.lit(1)).alias("names")).orderBy("topic")
