"""Topic and document labels: prompts, replies, the labeller surface and an offline keyword labeller."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.dims import BROAD, FINE, MAX_CATEGORIES, OUTLIER, broad_dim, fine_dim
from gistmill.functions.arrays import histogram, python_list
from gistmill.functions.joins import SENT_BYTES, spread_join
from gistmill.functions.replies import normalize_prediction, parse_topic_reply
from gistmill.functions.text import terms
from gistmill.operators.features import counted, term_counts
from gistmill.operators.relational import head_n
from gistmill.operators.topics import ctfidf, topic_term_counts, unit_weights
from gistmill.prompts import CATEGORY_LIST, TOPIC_TEMPLATES, doc_template
from gistmill.session import cut_lineage, written

BROAD_NAMES = [name for _, name, _ in BROAD]
SHORT_NAMES = [short for _, _, short in BROAD]
FINE_NAMES = [name for _, name, _ in FINE]


def topic_inputs(info: DataFrame, n_words: int = 5, n_docs: int = 8, chars: int = 50) -> DataFrame:
    """topic, keywords, documents for each topic but the outliers."""
    docs = F.transform(F.slice("representative_docs", 1, n_docs), lambda d: F.substring(d, 1, chars))
    return info.filter(F.col("topic") != OUTLIER).select(
        "topic", F.slice("representation", 1, n_words).alias("keywords"), docs.alias("documents")
    )


def build_topic_prompt(
    inputs: DataFrame, names: Sequence[str] = ("default",), templates: Mapping[str, str] = TOPIC_TEMPLATES
) -> DataFrame:
    """topic, prompt, prompt_text: every topic with each named template. Templates are constants of the plan."""
    words, docs = python_list(F.col("keywords")), python_list(F.col("documents"))

    def filled(template: str) -> Column:
        text = F.lit(template.replace("{categories}", CATEGORY_LIST))
        return F.replace(F.replace(text, F.lit("{keywords}"), words), F.lit("{documents}"), docs)

    each = F.array(*[F.struct(F.lit(n).alias("prompt"), filled(templates[n]).alias("prompt_text")) for n in names])
    return inputs.select(*[c for c in inputs.columns if c not in ("prompt", "prompt_text")], F.explode(each).alias("_p")).select(
        *[c for c in inputs.columns if c not in ("prompt", "prompt_text")], "_p.prompt", "_p.prompt_text"
    )


def build_doc_prompt(df: DataFrame, grain: int = 20) -> DataFrame:
    head, tail = doc_template(grain).split("{text}")
    return df.withColumn("prompt_text", F.concat(F.lit(head), F.col("text"), F.lit(tail)))


#: What a labeller may raise when it can't answer; anything else is an error of the program and ends the job.
FAILURES = (RuntimeError, OSError, ValueError)


def answered_in_halves(fn: Callable[[Sequence[str]], Sequence[str]], prompts: Sequence[str]) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt. A batch that fails is asked again in halves, so one bad prompt costs some 2 log2(n) further calls."""
    try:
        replies = list(fn(prompts))
        if len(replies) != len(prompts):
            raise ValueError("one reply per prompt is needed")
        return [(r, None) for r in replies]
    except FAILURES as e:
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(prompts) // 2
    return answered_in_halves(fn, prompts[:half]) + answered_in_halves(fn, prompts[half:])


def apply_labeller(
    df: DataFrame, fn: Callable[[Sequence[str]], Sequence[str]], prompt_col: str = "prompt_text", batch_size: int = 5, by: str | None = None
) -> DataFrame:
    """Adds ``reply``, ``answered`` and ``error``: ``fn`` gets up to ``batch_size`` prompts and returns as many replies.

    With ``by``, a batch ends where that column changes. A prompt that fails by itself is answered with 'other', and the error's text is kept. Only FAILURES are caught.
    """

    def run(batches):
        for pdf in batches:
            found, prompts = [], pdf[prompt_col].tolist()
            edges = [k for k in range(1, len(pdf)) if by and pdf[by].iloc[k] != pdf[by].iloc[k - 1]]
            for start, stop in zip([0, *edges], [*edges, len(pdf)]):
                for at in range(start, stop, batch_size):
                    found += answered_in_halves(fn, prompts[at : min(stop, at + batch_size)])
            if found:
                replies = ["other" if error else reply for reply, error in found]
                yield pdf.assign(reply=replies, answered=[e is None for _, e in found], error=[e for _, e in found])

    schema = T.StructType(
        [*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("answered", T.BooleanType()), T.StructField("error", T.StringType())]
    )
    return df.mapInPandas(run, schema)


def category_profiles(labelled: DataFrame, category: str = "category") -> DataFrame:
    """category, term, u: unit-length class-based weights of each category, learnt from labelled documents."""
    return unit_weights(written(ctfidf(topic_term_counts(labelled, topic=category), topic=category), "weights"), category)


def keyword_labeller(topic_weights: DataFrame, profiles: DataFrame, category: str = "category") -> DataFrame:
    """topic, category, score: the category whose words are closest in cosine to the topic's; ties by category.

    A topic that shares no word with any category has a null category and a score of 0.
    """
    topic_weights = written(topic_weights.select("topic", "term", "weight"), "weights")
    unit = unit_weights(topic_weights.filter(F.col("topic") != OUTLIER)).withColumnRenamed("u", "_w")
    dots = unit.join(profiles, "term").groupBy("topic", category).agg(F.sum(F.col("_w") * F.col("u")).alias("_d"))
    best = dots.groupBy("topic").agg(F.min(F.struct((-F.col("_d")).alias("_n"), F.col(category))).alias("_b"))
    topics = topic_weights.filter(F.col("topic") != OUTLIER).select("topic").distinct()
    return topics.join(best, "topic", "left").select("topic", F.col(f"_b.{category}").alias(category), F.coalesce(-F.col("_b._n"), F.lit(0.0)).alias("score"))


def classify_terms(docs: DataFrame, grains: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Adds one column per grain: the category with the largest dot product with the document's term counts.

    ``grains`` maps a column name to (profiles (category, term, u), category names). The profiles of a term become
    one row with a slot per category, so a document's terms are joined once and all sums are taken together.
    Ties go to the first name in order; a document without a known term gets null.
    """
    if sum(len(names) for _, names in grains.values()) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    stacked, slots = None, {}
    for out, (profiles, names) in grains.items():
        part = profiles.select(F.lit(out).alias("_g"), F.col("category"), "term", "u")
        stacked = part if stacked is None else stacked.unionByName(part)
        slots |= {f"_s{len(slots) + i}": (out, n) for i, n in enumerate(sorted(names))}
    hit = {s: (F.col("_g") == out) & (F.col("category") == n) for s, (out, n) in slots.items()}
    wide = stacked.groupBy("term").agg(*[F.sum(F.when(h, F.col("u")).otherwise(0.0)).alias(s) for s, h in hit.items()])
    wide = cut_lineage(wide)
    size = wide.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term")).alias("text")).first()
    if size["rows"] * (8 * len(slots) + 16) + (size["text"] or 0) <= 4 * SENT_BYTES:
        return _classify_in_row(docs, wide, grains, slots)
    docs = counted(docs)
    joined = spread_join(term_counts(docs), wide, ["term"], "doc_id")
    sums = joined.groupBy("doc_id").agg(*[F.sum(F.col("tf") * F.col(s)).alias(s) for s in slots])

    def best(out: str) -> Column:
        mine = [(s, n) for s, (o, n) in slots.items() if o == out]
        scored = [
            F.struct(F.col(s).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
            for i, (s, n) in enumerate(mine)
        ]
        return F.array_max(F.array(*scored))["name"].alias(out)

    return docs.drop("counts").join(sums.select("doc_id", *[best(out) for out in grains]), "doc_id", "left")


def _classify_in_row(docs: DataFrame, wide: DataFrame, grains: Mapping, slots: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Sums of a document's terms by category where the document is; nothing is moved."""
    held = docs.sparkSession.sparkContext.broadcast(wide.select("term", *slots).toArrow())
    counts = F.col("counts") if "counts" in docs.columns else histogram(F.col("terms"))
    given = docs.withColumn("counts", counts).drop("terms")
    rest, asked = [f for f in given.schema.fields if f.name != "counts"], list(grains)

    def sums(batches):
        names = held.value.column("term").combine_chunks()
        table = np.stack([held.value.column(s).to_numpy() for s in slots], 1)
        for batch in batches:
            lists = batch.column("counts")
            pairs = lists.flatten()
            at = pc.index_in(pairs.field("term"), value_set=names)
            known = at.is_valid()
            row = pc.list_parent_indices(lists).filter(known).to_numpy()
            at, tf = at.filter(known).to_numpy(), pairs.field("tf").filter(known).to_numpy()
            total = np.zeros((batch.num_rows, len(slots)))
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            if len(row):
                total[row[first]] = np.add.reduceat(table[at] * tf[:, None], first)
            none = np.ones(batch.num_rows, dtype=bool)
            none[row[first]] = False
            columns = [batch.column(f.name) for f in rest]
            for out in asked:
                mine = [i for i, (o, _) in enumerate(slots.values()) if o == out]
                labels = pa.array([n for o, n in slots.values() if o == out])
                columns.append(labels.take(pa.array(total[:, mine].argmax(1), mask=none)))
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rest), *asked])

    return given.mapInArrow(sums, T.StructType([*rest, *[T.StructField(out, T.StringType()) for out in asked]]))


def classify_documents(docs: DataFrame, train: DataFrame, n: int | None = None, stop: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, fine_label, fine_predicted, broad_label, broad_predicted for the first n documents (all if None).

    ``train`` and ``docs`` hold doc_id, text and the fine ``label``; answers outside the lists read 'other'. Train
    documents are counted once: the broad counts are sums of the fine ones.
    """
    spark = docs.sparkSession
    short = F.broadcast(broad_dim(spark).select("broad_label_id", F.col("short_name").alias("broad_label")))
    names = F.broadcast(fine_dim(spark).select("label", "broad_label_id").join(short, "broad_label_id").select("label", "broad_label"))
    learnt = train.withColumn("terms", terms(F.col("text"), stop))
    # Four aggregates read the counts, so they are written once.
    fine = cut_lineage(topic_term_counts(learnt, topic="label").filter(F.col("label").isin(FINE_NAMES)))
    broad = fine.join(names, "label").groupBy("broad_label", "term").agg(F.sum("tf").alias("tf"))

    def profiles(counts: DataFrame, col: str) -> DataFrame:
        return unit_weights(ctfidf(counts, col), col).withColumnRenamed(col, "category")

    asked = (head_n(docs, n) if n is not None else docs).select("doc_id", "text", "label").join(names, "label", "left")
    out = classify_terms(
        asked.withColumn("terms", terms(F.col("text"), stop)),
        {
            "fine_predicted": (profiles(fine, "label"), FINE_NAMES),
            "broad_predicted": (profiles(broad, "broad_label"), SHORT_NAMES),
        },
    )
    return out.select(
        "doc_id",
        "text",
        F.col("label").alias("fine_label"),
        F.coalesce("fine_predicted", F.lit("other")).alias("fine_predicted"),
        "broad_label",
        F.coalesce("broad_predicted", F.lit("other")).alias("broad_predicted"),
    )


def read_topic_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """ok, tuned_topic_name, short_explanation from a reply column."""
    rest = [c for c in df.columns if c != reply]
    return df.select(*rest, parse_topic_reply(F.col(reply), BROAD_NAMES).alias("_r")).select(*rest, "_r.*")


def read_doc_replies(df: DataFrame, valid: Sequence[str], reply: str = "reply", out: str = "predicted_label") -> DataFrame:
    return df.withColumn(out, normalize_prediction(F.col(reply), valid))


def keyword_replies(choices: DataFrame, category: str = "category") -> DataFrame:
    """topic, reply: the keyword labeller's choice written as a model would answer."""
    reply = F.to_json(
        F.struct(
            F.col(category).alias("tuned_topic_name"),
            F.concat(F.lit("Words are closest to "), F.col(category)).alias("short_explanation"),
        )
    )
    return choices.select("topic", reply.alias("reply"))


def label_topics(
    info: DataFrame,
    names: Sequence[str] = ("default",),
    fn: Callable[[Sequence[str]], Sequence[str]] | None = None,
    replies: DataFrame | None = None,
) -> DataFrame:
    """topic, prompt, tuned_topic_name, short_explanation; invalid replies leave their topic out.

    Replies come from ``fn`` over the prompts, or from a table (topic, reply) such as the keyword labeller's.
    """
    prompts = build_topic_prompt(topic_inputs(info), names).select("topic", "prompt", "prompt_text")
    if (fn is None) == (replies is None):
        raise ValueError("give either fn or replies")
    answered = apply_labeller(prompts, fn) if fn is not None else prompts.join(replies, "topic", "left")
    return read_topic_replies(answered).filter("ok").select("topic", "prompt", "tuned_topic_name", "short_explanation")


