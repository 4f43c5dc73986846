"""Bag of words, TF-IDF, SVD, PCA, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmill.dims import STOP_WORDS
from gistmill.operators import encode as en
from gistmill.operators import features as op
from gistmill.registry import tables as t
from gistmill.registry.tables import sql

TRAIN, TEST = "split = 'train'", "split = 'test'"


def tokens(spark, sf, ngram_range=(1, 2)):
    return op.tokenize_terms(t.doc_topics(spark, sf), STOP_WORDS, ngram_range)


def q_tokenize(spark, sf):
    return tokens(spark, sf).select("doc_id", F.array_join("terms", "|").alias("terms"))


def q_vocabulary(spark, sf):
    return op.build_vocabulary(tokens(spark, sf), 3, 0.85, 10_000)


def q_count_vectorize(spark, sf):
    tok = op.counted(tokens(spark, sf))
    return op.count_vectorize(tok, op.build_vocabulary(tok, 3, 0.85, 10_000))


def q_tfidf(spark, sf):
    return op.tfidf(tokens(spark, sf)).select("doc_id", "term", t.r6("weight"))


def q_tfidf_transform(spark, sf):
    tok = op.counted(tokens(spark, sf))
    vocab = op.build_vocabulary(tok.filter(TRAIN), 3, 0.85, 10_000)
    return op.tfidf_transform(tok.filter(TEST), vocab).select("doc_id", "term", t.r6("weight"))


def q_svd(spark, sf):
    tok = op.counted(tokens(spark, sf))
    vocab = op.build_vocabulary(tok.filter(TRAIN), 3, 0.85, 10_000)
    out = op.truncated_svd(op.tfidf_transform(tok.filter(TRAIN), vocab), op.tfidf_transform(tok.filter(TEST), vocab), 30)
    return out.select("doc_id", "split", F.posexplode("embedding").alias("d", "x")).select("doc_id", "split", "d", t.r6("x"))


def q_pca(spark, sf):
    out = op.pca(t.embeddings(spark, sf), 50)
    return out.select("vec_id", F.posexplode("projected").alias("d", "x")).select("vec_id", "d", t.r6("x"))


def q_l2(spark, sf):
    e = t.embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)))
    return op.l2_normalize(e).select("vec_id", F.posexplode("embedding").alias("d", "x")).select("vec_id", "d", t.r6("x"))


def q_encode(spark, sf):
    return en.encode(t.corpus(spark, sf)).select("doc_id", F.posexplode("embedding").alias("d", "x"))


def q_encode_splits(spark, sf):
    out = en.encode_splits(t.corpus(spark, sf), normalize=True)
    return out.select("doc_id", "split", F.posexplode("embedding").alias("d", "x")).select("doc_id", "split", "d", t.r6("x"))


QUERIES = {
    "tokenize_terms": q_tokenize,
    "build_vocabulary": q_vocabulary,
    "count_vectorize": q_count_vectorize,
    "tfidf": q_tfidf,
    "tfidf_transform": q_tfidf_transform,
    "truncated_svd": q_svd,
    "pca": q_pca,
    "l2_normalize": q_l2,
    "encode": q_encode,
    "encode_splits": q_encode_splits,
}


def vocabulary_views(where: str) -> list[tuple[str, str]]:
    return [
        ("n_all", f"select count(*) as n_docs from toks where {where}"),
        ("tf_doc", f"select doc_id, term, count(*) as tf from terms2 where {where} group by all"),
        (
            "vocab",
            "select term, count(*) as df, cast(sum(tf) as bigint) as tf, n_docs from tf_doc, n_all group by term, n_docs "
            "having count(*) >= 3 and count(*) <= 0.85::double * n_docs order by sum(tf) desc, term limit 10000",
        ),
    ]


def weight_views(counts: str) -> list[tuple[str, str]]:
    return [
        (
            "w",
            "select doc_id, c.term, c.tf * (ln((1.0::double + n_docs) / (1.0::double + df)) + 1.0::double) as w "
            f"from {counts} c join vocab v on v.term = c.term",
        )
    ]


WEIGHTS = "select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) + 0.0 as weight from w"

ENCODED = [
    ("h", f"select doc_id, {t.sql_draw('term')} % 128 as h from (select doc_id, unnest({t.sql_terms('text', False)}) as term from corpus)"),
    ("sums", "select doc_id, h // 2 as d, sum(case when h % 2 = 0 then 1 else -1 end) as x from h group by all"),
    ("dense", "select c.doc_id, c.split, cast(r.d as int) as d, coalesce(s.x, 0)::double as x from corpus c cross join (select unnest(range(64)) as d) r left join sums s on s.doc_id = c.doc_id and s.d = r.d"),
]

ORACLE = {
    "tokenize_terms": sql(f"select doc_id, array_to_string(list_concat(t, {t.sql_bigrams('t')}), '|') as terms from toks", "toks"),
    "build_vocabulary": sql("select term, df, tf, n_docs from vocab", "terms2", extra=vocabulary_views("true")),
    "count_vectorize": sql(
        "select doc_id, term, tf_doc.tf from tf_doc join vocab using (term)", "terms2", extra=vocabulary_views("true")
    ),
    "tfidf": sql(WEIGHTS, "terms2", extra=vocabulary_views("true") + weight_views("tf_doc")),
    "tfidf_transform": sql(
        WEIGHTS,
        "terms2",
        extra=vocabulary_views(TRAIN)
        + [("tf_test", f"select doc_id, term, count(*) as tf from terms2 where {TEST} group by all")]
        + weight_views("tf_test"),
    ),
    "l2_normalize": (
        "with e as (select vec_id, list_transform(embedding::double[], lambda x, i: x * i) as v from embeddings) "
        "select vec_id, cast(generate_subscripts(v, 1) - 1 as int) as d, "
        "round(unnest(v) / sqrt(list_dot_product(v, v)), 6) + 0.0 as x from e"
    ),
    "encode": sql("select doc_id, d, x from dense", "corpus", extra=ENCODED),
    "encode_splits": sql(
        "select doc_id, split, d, round(case when n = 0 then 0 else x / n end, 6) + 0.0 as x from "
        "(select *, sqrt(sum(x * x) over (partition by doc_id)) as n from dense)",
        "corpus",
        extra=ENCODED,
    ),
}
