"""Sources, sinks and row-wise preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmill.dims import STOP_WORDS
from gistmill.functions import text as tx
from gistmill.operators import clean as op
from gistmill.operators.labelling import classify_documents
from gistmill.operators.relational import label_id_of_name
from gistmill.registry import tables as t
from gistmill.registry.tables import sql
from gistmill.session import scratch_path, written
from gistmill.sources import readers, writers


def scalar(fn):
    def run(spark, sf):
        return t.raw_posts(spark, sf).select("doc_id", fn(F.col("raw")).alias("text"))

    return run


def scalar_sql(fn, *extra):
    return sql(f"select doc_id, {fn('raw')} as text from raw_posts", "raw_posts")


def lemma_table(spark, sf):
    """Lemmas from the corpus itself: a word ending in s whose stem also occurs stands for the stem."""
    words = t.cleaned(spark, sf).select(F.explode(tx.words(F.col("text"))).alias("token")).distinct()
    words = written(words, "words")  # read twice, and the corpus is cleaned once
    plural = words.filter((F.length("token") >= 5) & F.col("token").endswith("s"))
    plural = plural.withColumn("lemma", F.expr("substring(token, 1, length(token) - 1)"))
    return plural.join(words.select(F.col("token").alias("lemma")), "lemma", "left_semi").select("token", "lemma")


LEMMA_SQL = [
    ("cwords", f"select doc_id, unnest({t.sql_words('text')}) as w, generate_subscripts({t.sql_words('text')}, 1) as i from cleaned"),
    ("vocab", "select distinct w from cwords"),
    (
        "lemmas",
        "select w as token, substr(w, 1, length(w) - 1) as lemma from vocab where length(w) >= 5 and ends_with(w, 's') "
        "and substr(w, 1, length(w) - 1) in (select w from vocab)",
    ),
]


def q_lemmatize(spark, sf):
    return op.lemmatize(t.cleaned(spark, sf).select("doc_id", "text"), lemma_table(spark, sf))


def q_clean_sparse(spark, sf):
    raw = t.raw_posts(spark, sf).select("doc_id", F.col("raw").alias("text"))
    return op.clean_sparse(raw, STOP_WORDS, lemma_table(spark, sf)).select("doc_id", "text")


def q_truncate(spark, sf):
    c = F.col("text")
    return t.posts(spark, sf).select(
        "doc_id", tx.truncate_words(c, 512, "start").alias("start_text"), tx.truncate_words(c, 512, "end").alias("end_text")
    )


def q_add_broad(spark, sf):
    d = t.cleaned(spark, sf).withColumn("label", F.when(F.col("doc_id") % 17 == 0, "unknown").otherwise(F.col("label")))
    return op.add_broad_category(d).select("doc_id", "label", "broad_label_id")


def q_prepare(spark, sf):
    return op.prepare_corpus(t.raw_posts(spark, sf))


def q_variants(spark, sf):
    return op.build_variants(op.prepare_corpus(t.raw_posts(spark, sf)))


SPARSE = f"array_to_string(list_filter(string_split(text, ' '), lambda x: x not in ({t.STOP_SQL})), ' ')"
VARIANTS_SQL = (
    "select doc_id, text, label_id, label, cast(null as int) as broad_label_id, 'basic' as variant, split from corpus union all "
    f"select doc_id, {SPARSE}, label_id, label, null, 'sparse_repr', split from corpus union all "
    "select doc_id, text, label_id, label, broad_label_id, 'broad_category', split from corpus"
)


def q_load_corpus(spark, sf):
    path = scratch_path(spark, "posts")
    t.raw_posts(spark, sf).write.partitionBy("split").parquet(path)
    return readers.load_corpus(spark, path, "test").select("doc_id", "raw", "label_id", "label", "split")


def q_write_variants(spark, sf):
    path = scratch_path(spark, "variants")
    v = q_variants(spark, sf)
    writers.write_variants(v, path)
    writers.write_variants(v, path)
    return spark.read.parquet(path).select(*writers.VARIANT_COLUMNS)


def q_load_variant(spark, sf):
    path = scratch_path(spark, "variants")
    writers.write_variants(q_variants(spark, sf), path)
    train, test = readers.load_variant(spark, "broad_category", path)
    both = train.unionByName(test)
    return both.select("doc_id", "text", "label_id", "label", "broad_label_id", "split")


def q_write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_clean_csv(op.prepare_corpus(t.raw_posts(spark, sf)).select("doc_id", "text", "label_id", "label"), path)
    return spark.read.csv(path, header=True, schema="doc_id long, text string, label_id int, label string", escape='"')


def q_read_predictions(spark, sf):
    path = scratch_path(spark, "pred")
    d = t.posts(spark, sf).select("doc_id", "text", F.col("source").alias("label"), F.col("lang").alias("predicted_label"))
    d.write.option("header", True).option("escape", '"').csv(path)
    got = readers.read_predictions(spark, path, multi_line=True)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "predicted_label")


def _written_vectors(spark, sf):
    path = scratch_path(spark, "vec")
    writers.write_embeddings(t.doc_vectors(spark, sf).select("doc_id", "text", "label", "embedding"), path)
    return readers.read_embeddings(spark, path)


def q_embeddings(spark, sf):
    v = _written_vectors(spark, sf)
    return v.select("doc_id", "text", "label", F.posexplode("embedding").alias("d", "x")).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", "d", t.r6(F.col("x").cast("double"), "x")
    )


def q_write_embeddings(spark, sf):
    """A row for each place of each written vector, with the vector's length and what tells the document's text."""
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    facts = ["doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "label"]
    v = _written_vectors(spark, sf).select(*facts, F.size("embedding").alias("places"), t.r6(F.sqrt(length), "length"), F.posexplode("embedding").alias("d", "x"))
    return v.withColumn("x", t.r6(F.col("x").cast("double"), "x"))


def _projection(spark, sf):
    v = t.doc_vectors(spark, sf)
    return v.select(
        "doc_id", "text", "label", F.get(t.axes(), F.lit(0)).alias("x"), F.get(t.axes(), F.lit(1)).alias("y")
    )


def q_projection(spark, sf):
    path = scratch_path(spark, "proj")
    writers.write_projection(_projection(spark, sf), path)
    missing = readers.read_projection(spark, scratch_path(spark, "none"))
    got = readers.read_projection(spark, path)
    return got.select("doc_id", "text", "label", t.r6("x"), t.r6("y"), F.lit(missing is None).alias("missing_skipped"))


def q_prediction_pair(spark, sf):
    c = t.corpus(spark, sf)
    both = classify_documents(c.filter("split = 'test'"), c.filter("split = 'train'"), stop=STOP_WORDS)
    fine, broad = scratch_path(spark, "fine"), scratch_path(spark, "broad")
    writers.write_prediction_pair(both, fine, broad)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), "label", "predicted_label"]
    a = readers.read_predictions(spark, fine).select(*cols, F.lit("fine").alias("grain"))
    return a.unionByName(readers.read_predictions(spark, broad).select(*cols, F.lit("broad").alias("grain")))


def q_widen(spark, sf):
    wide = op.widen_embedding(t.embeddings(spark, sf).select("vec_id", "embedding"), 64)
    return wide.select("vec_id", *[t.r6(F.col(f"emb_{i}").cast("double"), f"emb_{i}") for i in range(64)])


def q_nest(spark, sf):
    wide = op.widen_embedding(t.embeddings(spark, sf).select("vec_id", "embedding"), 64)
    back = op.nest_embedding(wide)
    return back.select("vec_id", F.posexplode("embedding").alias("d", "x")).select("vec_id", "d", t.r6(F.col("x").cast("double"), "x"))


def q_select_label(spark, sf):
    c = t.corpus(spark, sf)
    fine = op.select_label_column(c, "basic").select("doc_id", F.col("label").alias("fine"))
    broad = op.select_label_column(c, "broad_category").select("doc_id", F.col("label").alias("broad"))
    return fine.join(broad, "doc_id")


def q_label_id(spark, sf):
    return label_id_of_name(t.labelled_docs(spark, sf)).select("doc_id", "topic", "predicted_topic_id")


def q_filter_short(spark, sf):
    return op.filter_short(t.posts(spark, sf)).select("doc_id", "text")


def q_short_report(spark, sf):
    return op.short_report(t.posts(spark, sf))


VEC_SQL = (
    "select doc_id, md5(text) as text_md5, label, cast(generate_subscripts(embedding, 1) - 1 as int) as d, "
    "round(unnest(embedding), 6) + 0.0 as x from doc_vectors"
)
PROJ_SQL = (
    f"select doc_id, text, label, round(a[1], 6) + 0.0 as x, round(a[2], 6) + 0.0 as y, true as missing_skipped "
    f"from (select doc_id, text, label, {t.sql_axes('embedding')} as a from doc_vectors)"
)

QUERIES = {
    "load_corpus": q_load_corpus,
    "load_variant": q_load_variant,
    "read_predictions": q_read_predictions,
    "read_embeddings": q_embeddings,
    "read_projection": q_projection,
    "write_clean_csv": q_write_csv,
    "write_variants": q_write_variants,
    "write_embeddings": q_write_embeddings,
    "write_projection": q_projection,
    "write_prediction_pair": q_prediction_pair,
    "strip_header": scalar(tx.strip_header),
    "strip_quoted": scalar(tx.strip_quoted),
    "strip_emails": scalar(tx.strip_emails),
    "strip_urls": scalar(tx.strip_urls),
    "strip_punct": scalar(tx.strip_punct),
    "squash_lower": scalar(tx.squash_lower),
    "clean_basic": scalar(tx.clean_basic),
    "filter_short": q_filter_short,
    "filter_short_report": q_short_report,
    "remove_stopwords": lambda s, sf: t.cleaned(s, sf).select("doc_id", tx.remove_stopwords(F.col("text"), STOP_WORDS).alias("text")),
    "lemmatize": q_lemmatize,
    "clean_sparse": q_clean_sparse,
    "truncate_words": q_truncate,
    "sliding_segments": lambda s, sf: op.sliding_segments(t.cleaned(s, sf)),
    "add_broad_category": q_add_broad,
    "build_variants": q_variants,
    "prepare_corpus": q_prepare,
    "custom_preprocess": lambda s, sf: t.posts(s, sf).select(
        "doc_id", tx.custom_preprocess(F.col("text"), ["the", "qu", "er"]).alias("text")
    ),
    "widen_embedding": q_widen,
    "nest_embedding": q_nest,
    "select_label_column": q_select_label,
    "label_id_of_name": q_label_id,
}

_W = t.sql_words("text")

ORACLE = {
    "load_corpus": sql("select doc_id, raw, r.label_id, label, split from raw_posts r join fine using (label_id) where split = 'test'", "raw_posts", "fine"),
    "load_variant": sql("select doc_id, text, label_id, label, broad_label_id, split from corpus", "corpus"),
    "read_predictions": "select doc_id, source as label, lang as predicted_label from documents",
    "read_embeddings": sql(VEC_SQL, "doc_vectors"),
    "read_projection": sql(PROJ_SQL, "doc_vectors"),
    "write_clean_csv": sql("select doc_id, text, label_id, label from corpus", "corpus"),
    "write_variants": sql(VARIANTS_SQL, "corpus"),
    "write_embeddings": sql(
        "select doc_id, length(text) as chars, md5(text) as text_md5, label, cast(len(embedding) as int) as places, "
        "round(sqrt(list_dot_product(embedding, embedding)), 6) + 0.0 as length, "
        "cast(generate_subscripts(embedding, 1) - 1 as int) as d, round(unnest(embedding), 6) + 0.0 as x from doc_vectors",
        "doc_vectors",
    ),
    "write_projection": sql(PROJ_SQL, "doc_vectors"),
    "strip_header": scalar_sql(t.sql_strip_header),
    "strip_quoted": scalar_sql(t.sql_strip_quoted),
    "strip_emails": scalar_sql(t.sql_strip_emails),
    "strip_urls": scalar_sql(t.sql_strip_urls),
    "strip_punct": scalar_sql(t.sql_strip_punct),
    "squash_lower": scalar_sql(t.sql_squash_lower),
    "clean_basic": sql("select doc_id, text from cleaned", "cleaned"),
    "filter_short": "select doc_id, text from documents where length(text) > 50",
    "filter_short_report": "select count(*) as before, count(*) filter (length(text) <= 50) as dropped, "
    "count(*) filter (length(text) > 50) as kept from documents",
    "remove_stopwords": sql(f"select doc_id, array_to_string(list_filter({_W}, lambda x: x not in ({t.STOP_SQL})), ' ') as text from cleaned", "cleaned"),
    "lemmatize": sql(
        "select c.doc_id, coalesce(string_agg(coalesce(lemma, w), ' ' order by i), '') as text from cleaned c "
        "left join cwords using (doc_id) left join lemmas on token = w group by c.doc_id",
        "cleaned", extra=LEMMA_SQL,
    ),
    "clean_sparse": sql(
        "select c.doc_id, coalesce(string_agg(coalesce(lemma, w), ' ' order by i), '') as text from cleaned c "
        f"left join (select * from cwords where w not in ({t.STOP_SQL})) using (doc_id) left join lemmas on token = w group by c.doc_id",
        "cleaned", extra=LEMMA_SQL,
    ),
    "truncate_words": f"select doc_id, case when len({_W}) <= 512 then text else array_to_string({_W}[1:512], ' ') end as start_text, "
    f"case when len({_W}) <= 512 then text else array_to_string({_W}[-512:], ' ') end as end_text from documents",
    "sliding_segments": sql(
        "select doc_id, cast(i as int) as seg, array_to_string(w[i * 256 + 1 : i * 256 + 512], ' ') as segment from "
        "(select doc_id, w, unnest(range(0, len(w) // 256 + 1)) as i from ws) where len(w) - i * 256 >= 10",
        "cleaned", extra=[("ws", f"select doc_id, {_W} as w from cleaned")],
    ),
    "add_broad_category": sql(
        "select doc_id, case when doc_id % 17 = 0 then 'unknown' else label end as label, "
        "case when doc_id % 17 = 0 then null else broad_label_id end as broad_label_id from cleaned", "cleaned",
    ),
    "build_variants": sql(VARIANTS_SQL, "corpus"),
    "prepare_corpus": sql("select doc_id, text, label_id, label, split from corpus", "corpus"),
    "custom_preprocess": "select doc_id, replace(replace(replace(lower(text), 'the', ' '), 'qu', ' '), 'er', ' ') as text from documents",
    "widen_embedding": "select vec_id, " + ", ".join(f"round(embedding[{i + 1}]::double, 6) + 0.0 as emb_{i}" for i in range(64)) + " from embeddings",
    "nest_embedding": "select vec_id, cast(generate_subscripts(embedding, 1) - 1 as int) as d, round(unnest(embedding)::double, 6) + 0.0 as x from embeddings",
    "select_label_column": sql("select doc_id, label as fine, broad_label_id as broad from corpus", "corpus"),
    "label_id_of_name": sql("select doc_id, topic, predicted_topic_id from scored_docs", "scored_docs"),
}
