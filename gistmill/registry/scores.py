"""Joins, aggregates, samples, scores and prompt comparison."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from gistmill.dims import BROAD
from gistmill.operators import ablation as ab
from gistmill.operators import evaluate as ev
from gistmill.operators import relational as op
from gistmill.prompts import ABLATION_PROMPTS, TOPIC_TEMPLATES
from gistmill.registry import tables as t
from gistmill.registry.labels import INFO_VIEWS, _filled
from gistmill.registry.tables import quoted, sql
from gistmill.registry.topics import info
from gistmill.session import scratch_path, written
from gistmill.sources import writers

DOC_COLS = ["doc_id", "topic", "tuned_topic_name", "short_explanation"]


def scored(spark, sf):
    return op.label_id_of_name(t.labelled_docs(spark, sf))


def topics(spark, sf):
    return t.doc_topics(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("count"))


def default_names(spark, sf):
    return t.topic_names(spark, sf).filter("prompt = 'default'").drop("prompt")


def q_info_labels(spark, sf):
    return op.join_topic_info_labels(topics(spark, sf), default_names(spark, sf))


def q_doc_labels(spark, sf):
    docs = t.doc_topics(spark, sf).select("doc_id", "topic")
    return op.join_doc_labels(docs, default_names(spark, sf)).select(*DOC_COLS)


def q_suffix(spark, sf):
    right = t.topic_names(spark, sf).filter("prompt = 'cot'").select("topic", "tuned_topic_name")
    return op.join_with_suffix(t.labelled_docs(spark, sf).select("doc_id", "topic", "tuned_topic_name"), right)


def q_unlabelled(spark, sf):
    return op.drop_unlabelled(q_suffix(spark, sf))


def q_batches(spark, sf):
    names = t.topic_names(spark, sf).filter("prompt = 'default'")
    tagged = op.split_batches(names, 3).withColumn("ok", F.col("batch") != 2)
    return op.concat_label_batches(tagged).select("topic", "tuned_topic_name")


def q_alignment(spark, sf):
    p = t.predictions(spark, sf)
    d = ev.align_keys(p.select("doc_id", "label"), p.select("doc_id", "predicted_label"))
    out = ev.category_alignment(d, "broad")
    return out.select(
        "run_name",
        t.r6("macro_f1"),
        t.r6("weighted_f1"),
        F.array_join("labels", "|").alias("labels"),
        F.array_join(F.transform("per_class_f1", lambda x: F.round(x * 1e6).cast("long")), "|").alias("f1_millionths"),
        F.array_join(F.flatten("confusion_matrix"), "|").alias("confusion"),
    )


def q_write_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    writers.write_metrics(ev.category_alignment(t.predictions(spark, sf), "broad"), path)
    got = spark.read.json(path)
    lists = F.transform("per_class_f1", lambda x: F.round(x * 1e6).cast("long"))
    return got.select(
        "run_name", t.r6("macro_f1"), t.r6("weighted_f1"), F.array_join("labels", "|").alias("labels"),
        F.array_join(lists, "|").alias("f1_millionths"), F.array_join(F.flatten("confusion_matrix"), "|").alias("confusion"),
    )


def q_db_report(spark, sf):
    path = scratch_path(spark, "report")
    pts = t.plane(spark, sf)
    writers.write_db_report(ev.davies_bouldin(pts, two_d=True), pts, "raw", path)
    return spark.read.json(path, schema="model string, score double, samples long, categories string")


def q_davies(spark, sf):
    flat = ev.davies_bouldin(t.plane(spark, sf), two_d=True).select(F.lit("plane").alias("space"), t.r6("davies_bouldin"))
    full = ev.davies_bouldin(t.embeddings(spark, sf)).select(F.lit("full").alias("space"), t.r6("davies_bouldin"))
    return flat.unionByName(full)


def q_evaluate(spark, sf):
    out = ev.evaluate_topic_predictions(scored(spark, sf), "split")
    cols = ["split", "total", "after_outliers", "after_unmapped", "outliers_removed", "outlier_percent", "samples"]
    return out.select(*cols, t.r6("macro_f1"), t.r6("weighted_f1"))


def ablation_labels(spark, sf):
    return t.topic_names(spark, sf).filter(F.col("prompt").isin(ABLATION_PROMPTS))


def ablation(spark, sf):
    return ab.prompt_ablation(t.labelled_docs(spark, sf), ablation_labels(spark, sf))


def q_ablation(spark, sf):
    return ablation(spark, sf).select("prompt", t.r6("macro_f1"), t.r6("weighted_f1"), "samples", t.r6("avg_topic_prob"))


def md5_names(prompts):
    """A stand-in for a remote model: a subject by the prompt's md5, now and then one that isn't listed, or none."""
    out = []
    for p in prompts:
        pick = int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % (len(BROAD) + 2)
        if pick > len(BROAD):
            raise RuntimeError("refused")
        out.append(json.dumps({"tuned_topic_name": [*(n for _, n, _ in BROAD), "Others"][pick], "short_explanation": "by md5"}))
    return out


def q_run_ablation(spark, sf):
    scores, _ = ab.run_ablation(written(t.labelled_docs(spark, sf), "labelled"), info(spark, sf), md5_names)
    return scores.select("prompt", t.r6("macro_f1"), t.r6("weighted_f1"), "samples", t.r6("avg_topic_prob"))


def q_best(spark, sf):
    return ab.best_prompt(ablation(spark, sf)).select(t.r6("min_f1"), t.r6("max_f1"), "best", "identical")


def q_probability(spark, sf):
    return op.mean_topic_probability(op.drop_outliers(t.labelled_docs(spark, sf))).select(t.r6("avg_topic_prob"))


QUERIES = {
    "drop_outliers": lambda s, sf: op.drop_outliers(scored(s, sf)).select("doc_id", "topic"),
    "drop_unmapped": lambda s, sf: op.drop_unmapped(scored(s, sf)).select("doc_id", "predicted_topic_id"),
    "drop_unlabelled": q_unlabelled,
    "join_topic_info_labels": q_info_labels,
    "join_doc_labels": q_doc_labels,
    "join_with_suffix": q_suffix,
    "label_cardinality": lambda s, sf: op.label_cardinality(t.corpus(s, sf)),
    "prediction_distribution": lambda s, sf: op.prediction_distribution(scored(s, sf)),
    "label_distribution_by_prompt": lambda s, sf: op.label_distribution_by_prompt(t.topic_names(s, sf)),
    "attrition_report": lambda s, sf: op.attrition_report(scored(s, sf)),
    "mean_topic_probability": q_probability,
    "distinct_topics": lambda s, sf: op.distinct_topics(t.doc_topics(s, sf)),
    "label_index": lambda s, sf: op.label_index(t.corpus(s, sf), "label", "doc_id"),
    "head_n": lambda s, sf: op.head_n(t.corpus(s, sf).select("doc_id", "text", "label"), 100),
    "split_batches": lambda s, sf: op.split_batches(topics(s, sf), 2),
    "fixed_batches": lambda s, sf: op.fixed_batches(topics(s, sf)),
    "concat_label_batches": q_batches,
    "label_universe": lambda s, sf: op.label_universe(t.predictions(s, sf)),
    "hash_sample": lambda s, sf: op.hash_sample(t.corpus(s, sf).select("doc_id", "label"), 500, "doc_id"),
    "confusion_matrix": lambda s, sf: ev.confusion_matrix(t.predictions(s, sf)),
    "per_class_f1": lambda s, sf: ev.per_class_f1(t.predictions(s, sf)).select("label", "tp", "fp", "fn", "support", t.r6("f1")),
    "macro_f1": lambda s, sf: ev.macro_f1(t.predictions(s, sf)).select(t.r6("macro_f1")),
    "weighted_f1": lambda s, sf: ev.weighted_f1(t.predictions(s, sf)).select(t.r6("weighted_f1")),
    "category_alignment": q_alignment,
    "write_metrics": q_write_metrics,
    "write_db_report": q_db_report,
    "davies_bouldin": q_davies,
    "silhouette": lambda s, sf: ev.silhouette(t.embeddings(s, sf), 1000).select(t.r6("silhouette")),
    "silhouette_whole": lambda s, sf: ev.silhouette(t.embeddings(s, sf), None).select(t.r6("silhouette")),
    "evaluate_topic_predictions": q_evaluate,
    "prompt_ablation": q_ablation,
    "run_ablation": q_run_ablation,
    "best_prompt": q_best,
    "prompt_comparison": lambda s, sf: ab.prompt_comparison(ablation_labels(s, sf)),
    "prompt_disagreement": lambda s, sf: ab.prompt_disagreement(ablation_labels(s, sf)),
}


def f1_views(source: str, true: str, pred: str, name: str = "f", grp: str = "") -> list[tuple[str, str]]:
    side = grp.rstrip(", ")
    using = f"({grp}label)"
    return [
        (f"{name}_l", f"select * from {source} where {true} is not null"),
        (f"{name}_u", f"select {grp}{true} as label from {name}_l union select {grp}{pred} from {name}_l where {pred} is not null"),
        (f"{name}_t", f"select {grp}{true} as label, count(*) as support, count(*) filter ({true} = {pred}) as tp from {name}_l group by all"),
        (f"{name}_p", f"select {grp}{pred} as label, count(*) as predicted from {name}_l where {pred} is not null group by all"),
        (
            name,
            f"select {grp}label, coalesce(tp, 0) as tp, coalesce(predicted, 0) - coalesce(tp, 0) as fp, "
            "coalesce(support, 0) - coalesce(tp, 0) as fn, coalesce(support, 0) as support, "
            "case when coalesce(support, 0) + coalesce(predicted, 0) = 0 then 0.0::double "
            "else 2.0::double * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(predicted, 0)) end as f1 "
            f"from {name}_u left join {name}_t using {using} left join {name}_p using {using}",
        ),
        (
            f"{name}_sum",
            f"select {grp}avg(f1) as macro_f1, sum(f1 * support) / sum(support) as weighted_f1, cast(sum(support) as bigint) as samples "
            f"from {name}" + (f" group by {side}" if side else ""),
        ),
    ]


PRED = f1_views("predictions", "label", "predicted_label")
DENSE = [
    ("grid", "select a.label as label, b.label as predicted_label from f_u a cross join f_u b"),
    ("cnt", "select label, predicted_label, count(*) as n from f_l group by all"),
    ("conf", "select g.label, g.predicted_label, coalesce(n, 0) as n from grid g left join cnt using (label, predicted_label)"),
]
KEPT = [("kept", "select * from scored_docs where topic <> -1 and predicted_topic_id <> -1")]


def davies_views(source: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_x", f"select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from {source}"),
        (f"{name}_c", f"select label, d, avg(x) as m from {name}_x group by all"),
        (
            f"{name}_s",
            f"select label, avg(r) as s from (select label, vec_id, sqrt(sum((x - m) * (x - m))) as r from {name}_x "
            f"join {name}_c using (label, d) group by all) group by label",
        ),
        (
            f"{name}_r",
            f"select i, max((a.s + b.s) / d) as r from (select p.label as i, q.label as j, sqrt(sum((p.m - q.m) * (p.m - q.m))) as d "
            f"from {name}_c p join {name}_c q on p.d = q.d and p.label <> q.label group by all) "
            f"join {name}_s a on a.label = i join {name}_s b on b.label = j group by i",
        ),
    ]


TOPICS = "(select topic, count(*) as count from doc_topics group by topic)"
SUFFIX = [
    (
        "suf",
        "select doc_id, l.topic, l.tuned_topic_name, n.tuned_topic_name as tuned_topic_name_pred from labelled_docs l "
        "left join topic_names n on n.topic = l.topic and prompt = 'cot'",
    )
]


def ablation_views(names: str) -> list[tuple[str, str]]:
    return [
        (
            "ak",
            f"select prompt, l.label, broad_label_id as pred, topic_probability from labelled_docs l join {names} n on n.topic = l.topic "
            f"join broad on name = n.tuned_topic_name where l.topic <> -1 and prompt in ({quoted(ABLATION_PROMPTS)})",
        ),
        *f1_views("ak", "label", "pred", "a", "prompt, "),
        (
            "ab",
            "select prompt, macro_f1, weighted_f1, samples, p as avg_topic_prob from a_sum join "
            "(select prompt, avg(topic_probability) as p from ak group by prompt) using (prompt)",
        ),
    ]


ABLATION = ablation_views("topic_names")
ASKED = [
    ("asked", " union all ".join(f"select topic, '{n}' as prompt, {_filled(TOPIC_TEMPLATES[n])} as p from inp" for n in ABLATION_PROMPTS)),
    (
        "replied",
        f"select topic, prompt, [{quoted([n for _, n, _ in BROAD])}][cast('0x' || substr(md5(p), 1, 8) as bigint) % {len(BROAD) + 2} + 1] as tuned_topic_name from asked",
    ),
]
AB_NAMES = [("an", f"select * from topic_names where prompt in ({quoted(ABLATION_PROMPTS)})")]
ORDER = "case prompt " + " ".join(f"when '{p}' then {i}" for i, p in enumerate(ABLATION_PROMPTS)) + " end"

ORACLE = {
    "drop_outliers": sql("select doc_id, topic from scored_docs where topic <> -1", "scored_docs"),
    "drop_unmapped": sql("select doc_id, predicted_topic_id from scored_docs where predicted_topic_id <> -1", "scored_docs"),
    "drop_unlabelled": sql("select * from suf where tuned_topic_name_pred is not null", "labelled_docs", extra=SUFFIX),
    "join_topic_info_labels": sql(
        f"select i.topic, count, tuned_topic_name, short_explanation from {TOPICS} i "
        "left join topic_names n on n.topic = i.topic and prompt = 'default'",
        "topic_names",
    ),
    "join_doc_labels": sql("select doc_id, topic, tuned_topic_name, short_explanation from labelled_docs", "labelled_docs"),
    "join_with_suffix": sql("select * from suf", "labelled_docs", extra=SUFFIX),
    "label_cardinality": sql("select split, count(*) as docs, count(distinct label) as labels from corpus group by split", "corpus"),
    "prediction_distribution": sql("select predicted_topic_id, count(*) as docs from scored_docs group by all", "scored_docs"),
    "label_distribution_by_prompt": sql(
        "select prompt, tuned_topic_name, count(*) as topics from topic_names group by all", "topic_names"
    ),
    "attrition_report": sql(
        "select total, after_outliers, after_unmapped, total - after_outliers as outliers_removed, "
        "round((total - after_outliers) * 100.0::double / total, 2) as outlier_percent from (select count(*) as total, "
        "count(*) filter (topic <> -1) as after_outliers, "
        "count(*) filter (topic <> -1 and predicted_topic_id <> -1) as after_unmapped from scored_docs)",
        "scored_docs",
    ),
    "mean_topic_probability": sql(
        "select round(avg(topic_probability), 6) + 0.0 as avg_topic_prob from labelled_docs where topic <> -1", "labelled_docs"
    ),
    "distinct_topics": sql("select distinct topic from doc_topics where topic <> -1", "doc_topics"),
    "label_index": sql(
        "select label, doc_id, row_number() over (partition by label order by md5('42:' || doc_id), doc_id) - 1 as pos, "
        "count(*) over (partition by label) as members from corpus",
        "corpus",
    ),
    "head_n": sql("select doc_id, text, label from corpus order by doc_id limit 100", "corpus"),
    "split_batches": sql(f"select topic, count, cast(ntile(2) over (order by topic) as int) as batch from {TOPICS}", "doc_topics"),
    "fixed_batches": sql(
        "select topic, count, cast((row_number() over (order by topic) - 1) // 5 + 1 as int) as batch, "
        f"cast(ceil(count(*) over () / 5.0) as int) as batches from {TOPICS}",
        "doc_topics",
    ),
    "concat_label_batches": sql(
        "select topic, tuned_topic_name from (select *, ntile(3) over (order by topic) as b from topic_names "
        "where prompt = 'default') where b <> 2",
        "topic_names",
    ),
    "label_universe": sql(
        "select label from predictions where label is not null union "
        "select predicted_label from predictions where label is not null and predicted_label is not null",
        "predictions",
    ),
    "hash_sample": sql("select doc_id, label from corpus order by md5('42:' || doc_id), doc_id limit 500", "corpus"),
    "confusion_matrix": sql("select * from conf", "predictions", extra=PRED + DENSE),
    "per_class_f1": sql("select label, tp, fp, fn, support, round(f1, 6) + 0.0 as f1 from f", "predictions", extra=PRED),
    "macro_f1": sql("select round(macro_f1, 6) + 0.0 as macro_f1 from f_sum", "predictions", extra=PRED),
    "weighted_f1": sql("select round(weighted_f1, 6) + 0.0 as weighted_f1 from f_sum", "predictions", extra=PRED),
    "category_alignment": sql(
        "select 'broad' as run_name, round(macro_f1, 6) + 0.0 as macro_f1, round(weighted_f1, 6) + 0.0 as weighted_f1, "
        "(select string_agg(label::varchar, '|' order by label) from f) as labels, "
        "(select string_agg(cast(round(f1 * 1e6) as bigint)::varchar, '|' order by label) from f) as f1_millionths, "
        "(select string_agg(n::varchar, '|' order by label, predicted_label) from conf) as confusion from f_sum",
        "predictions",
        extra=PRED + DENSE,
    ),
    "write_metrics": sql(
        "select 'broad' as run_name, round(macro_f1, 6) + 0.0 as macro_f1, round(weighted_f1, 6) + 0.0 as weighted_f1, "
        "(select string_agg(label::varchar, '|' order by label) from f) as labels, "
        "(select string_agg(cast(round(f1 * 1e6) as bigint)::varchar, '|' order by label) from f) as f1_millionths, "
        "(select string_agg(n::varchar, '|' order by label, predicted_label) from conf) as confusion from f_sum",
        "predictions",
        extra=PRED + DENSE,
    ),
    "write_db_report": sql(
        "select 'raw' as model, round(avg(r), 4) as score, (select count(*) from plane) as samples, "
        "(select string_agg(label::varchar, ',' order by label) from (select distinct label from plane)) as categories from d_r",
        "plane",
        extra=davies_views("plane", "d"),
    ),
    "davies_bouldin": sql(
        "select 'plane' as space, round(avg(r), 6) + 0.0 as davies_bouldin from d_r union all "
        "select 'full', round(avg(r), 6) + 0.0 from e_r",
        "plane",
        extra=davies_views("plane", "d") + davies_views("embeddings", "e"),
    ),
    "silhouette": (
        "with pts as (select vec_id, label, embedding::double[] as v from embeddings order by md5('42:' || vec_id), vec_id limit 1000), "
        "ab as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v)) as total, count(*) as n "
        "from pts a cross join pts b group by all), "
        "sc as (select vec_id, max(case when own = other and n > 1 then total / (n - 1) end) as a, "
        "min(case when own <> other then total / n end) as b from ab group by vec_id) "
        "select round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) + 0.0 as silhouette from sc"
    ),
    "silhouette_whole": (
        "with pts as (select vec_id, label, embedding::double[] as v from embeddings), "
        "ab as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v)) as total, count(*) as n "
        "from pts a cross join pts b group by all), "
        "sc as (select vec_id, max(case when own = other and n > 1 then total / (n - 1) end) as a, "
        "min(case when own <> other then total / n end) as b from ab group by vec_id) "
        "select round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) + 0.0 as silhouette from sc"
    ),
    "evaluate_topic_predictions": sql(
        "select split, total, after_outliers, after_unmapped, total - after_outliers as outliers_removed, "
        "round((total - after_outliers) * 100.0::double / total, 2) as outlier_percent, samples, "
        "round(macro_f1, 6) + 0.0 as macro_f1, round(weighted_f1, 6) + 0.0 as weighted_f1 from (select split, count(*) as total, "
        "count(*) filter (topic <> -1) as after_outliers, "
        "count(*) filter (topic <> -1 and predicted_topic_id <> -1) as after_unmapped from scored_docs group by split) "
        "left join k_sum using (split)",
        "scored_docs",
        extra=KEPT + f1_views("kept", "label", "predicted_topic_id", "k", "split, "),
    ),
    "prompt_ablation": sql(
        "select prompt, round(macro_f1, 6) + 0.0 as macro_f1, round(weighted_f1, 6) + 0.0 as weighted_f1, samples, "
        "round(avg_topic_prob, 6) + 0.0 as avg_topic_prob from ab",
        "labelled_docs",
        "broad",
        extra=ABLATION,
    ),
    "run_ablation": sql(
        "select prompt, round(macro_f1, 6) + 0.0 as macro_f1, round(weighted_f1, 6) + 0.0 as weighted_f1, samples, "
        "round(avg_topic_prob, 6) + 0.0 as avg_topic_prob from ab",
        "labelled_docs", "broad", "doc_vectors", "terms2",
        extra=INFO_VIEWS + ASKED + ablation_views("replied"),
    ),
    "best_prompt": sql(
        "select round(min(macro_f1), 6) + 0.0 as min_f1, round(max(macro_f1), 6) + 0.0 as max_f1, "
        f"first(prompt order by macro_f1 desc, {ORDER}) as best, min(macro_f1) = max(macro_f1) as identical from ab",
        "labelled_docs",
        "broad",
        extra=ABLATION,
    ),
    "prompt_comparison": sql(
        "select topic, " + ", ".join(f"max(tuned_topic_name) filter (prompt = '{p}') as {p}" for p in ABLATION_PROMPTS) + " from an group by topic",
        "topic_names",
        extra=AB_NAMES,
    ),
    "prompt_disagreement": sql(
        "select count(*) filter (n <= 1) as agreeing, count(*) filter (n > 1) as disagreeing from "
        "(select topic, count(*) as n from (select distinct topic, tuned_topic_name from an) group by topic)",
        "topic_names",
        extra=AB_NAMES,
    ),
}
