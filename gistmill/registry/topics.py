"""Topic words, similarity, tables and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmill.dims import STOP_WORDS
from gistmill.functions.numbers import to_places
from gistmill.operators import topics as op
from gistmill.operators.features import tokenize_terms
from gistmill.registry import tables as t
from gistmill.registry.features import tokens
from gistmill.registry.tables import sql
from gistmill.session import written


def category_words(spark, sf):
    """Raw posts to the ten best words of each broad category."""
    words = tokenize_terms(t.corpus(spark, sf), STOP_WORDS)
    weights = op.ctfidf(op.topic_term_counts(words, topic="broad_label_id"), topic="broad_label_id")
    best = op.topic_words(weights, 10, topic="broad_label_id")
    return best.select("broad_label_id", "rank", "term", to_places(F.col("weight"), 8).alias("weight"))


def counts(spark, sf):
    return op.topic_term_counts(tokens(spark, sf))


def weights(spark, sf):
    return op.ctfidf(counts(spark, sf))


def q_counts(spark, sf):
    return op.topic_term_counts(tokens(spark, sf), 2, 0.95)


def q_ctfidf(spark, sf):
    return weights(spark, sf).select("topic", "term", "tf", to_places(F.col("weight"), 8).alias("weight"))


def q_words(spark, sf):
    return op.topic_words(weights(spark, sf)).select("topic", "rank", "term")


def q_barchart(spark, sf):
    return op.topic_barchart_data(weights(spark, sf)).select("topic", "rank", "term", to_places(F.col("weight"), 8).alias("weight"))


def q_similarity(spark, sf):
    return op.topic_similarity(weights(spark, sf)).select("a", "b", t.r6("similarity"))


def q_reduce(spark, sf):
    docs = written(t.doc_topics(spark, sf).select("doc_id", "topic", "text"))
    terms = tokenize_terms(docs, STOP_WORDS, (1, 2))
    return op.reduce_topics(docs.select("doc_id", "topic"), op.ctfidf(op.topic_term_counts(terms)), 6).select("doc_id", "topic")


def vector_topics(spark, sf):
    """Documents with vectors, cleaned and encoded once and written; terms are made anew by each reader, which takes less room than keeping them."""
    v = t.doc_vectors(spark, sf).select("doc_id", "topic", "text", "embedding", "broad_label_id", "split")
    return tokenize_terms(written(v, "vectors"), STOP_WORDS, (1, 2))


def info_of(v):
    return op.topic_info(v, op.ctfidf(op.topic_term_counts(v)))


def info(spark, sf):
    return info_of(vector_topics(spark, sf))


def q_info(spark, sf):
    return info(spark, sf).select(
        "topic",
        "count",
        "name",
        F.array_join("representation", "|").alias("representation"),
        F.array_join("representative_docs", "|").alias("representative_docs"),
    )


def q_representative(spark, sf):
    return op.representative_docs(t.doc_vectors(spark, sf)).select("topic", "rank", "doc_id", t.r6("similarity"))


def q_map(spark, sf):
    return op.topic_map_data(t.doc_vectors(spark, sf)).select("topic", "size", t.r6("x"), t.r6("y"))


def q_coherence(spark, sf):
    docs = tokens(spark, sf, (1, 1)).persist()
    best = op.topic_words(op.ctfidf(op.topic_term_counts(docs)), 10, outliers=False)
    return op.coherence_cv(docs, best).select("topic", t.r6("coherence"))


def q_sweep(spark, sf):
    docs = written(t.doc_topics(spark, sf).select("doc_id", "topic", "text"))
    return op.sweep_vectorizer(docs, STOP_WORDS).select("combo", "max_n", "min_df", "max_df", t.r6("coherence"), "best")


QUERIES = {
    "category_words": category_words,
    "topic_term_counts": q_counts,
    "ctfidf": q_ctfidf,
    "topic_words": q_words,
    "topic_similarity": q_similarity,
    "reduce_topics": q_reduce,
    "topic_info": q_info,
    "representative_docs": q_representative,
    "topic_barchart_data": q_barchart,
    "topic_map_data": q_map,
    "coherence_cv": q_coherence,
    "sweep_vectorizer": q_sweep,
}


def weight_sql(source: str, by: str = "topic", name: str = "cw", grp: str = "") -> list[tuple[str, str]]:
    """Class-based weights from (topic, term, tf) rows; ``grp`` holds further keys such as 'combo, '."""
    part = f"partition by {grp.rstrip(', ')}" if grp else ""
    return [
        (f"{name}_size", f"select {grp}{by}, sum(tf) as words from {source} group by all"),
        (f"{name}_avg", f"select *, floor(avg(words) over ({part})) as a from {name}_size"),
        (
            name,
            f"select {grp}{by}, term, tf, tf::double / words * ln(1 + a::double / sum(tf) over (partition by {grp}term)) as weight "
            f"from {source} join {name}_avg using ({grp}{by})",
        ),
    ]


def words_sql(n: int, source: str = "cw", by: str = "topic", name: str = "best", grp: str = "", where: str = "true"):
    rank = f"row_number() over (partition by {grp}{by} order by weight desc, term)"
    return [(name, f"select * from (select *, cast({rank} as int) as rank from {source} where {where}) where rank <= {n}")]


TC = [("tc", "select topic, term, count(*) as tf from terms2 group by all")]
TC1 = [("tc", "select topic, term, count(*) as tf from terms1 group by all")]
CAT = [("tc", "select broad_label_id, term, count(*) as tf from terms1 group by all")]

VEC = [
    ("vt", "select v.doc_id, v.topic, v.text, v.embedding, t2.term from doc_vectors v join terms2 t2 on t2.doc_id = v.doc_id"),
    ("tc", "select topic, term, count(*) as tf from vt group by all"),
]
REPS = [
    ("dv", "select topic, generate_subscripts(embedding, 1) as d, unnest(embedding) as x from doc_vectors"),
    ("cd", "select topic, d, avg(x) as m from dv group by all"),
    ("cent", "select topic, list(m order by d) as c from cd group by topic"),
    (
        "reps",
        "select topic, doc_id, text, coalesce(list_dot_product(embedding, c) / nullif(sqrt(list_dot_product(embedding, embedding)) "
        "* sqrt(list_dot_product(c, c)), 0), 0) as similarity from doc_vectors join cent using (topic)",
    ),
    (
        "reps3",
        "select * from (select *, cast(row_number() over (partition by topic order by similarity desc, doc_id) as int) as rank "
        "from reps) where rank <= 3",
    ),
]


def coherence_sql(grp: str, best: str = "best") -> list[tuple[str, str]]:
    """Window counts by interval arithmetic on word positions; pairs by inclusion and exclusion."""
    g = f"{grp}topic"
    cover = "sum(greatest(0, hi - greatest(lo, coalesce(prev, -1) + 1) + 1))"
    return [
        ("dw", f"select doc_id, {t.sql_words('text')} as w from doc_topics"),
        ("dn", "select doc_id, w, len(w) as n, greatest(1, len(w) - 109) as last from dw where len(w) > 0"),
        ("tot", "select sum(last) as total from dn"),
        ("bw", f"select distinct term from {best}"),
        ("po", "select doc_id, last, unnest(w) as term, generate_subscripts(w, 1) - 1 as p from dn"),
        ("occ", "select doc_id, term, greatest(0, p - 109) as lo, least(last - 1, p) as hi from po where term in (select term from bw)"),
        ("o1", "select *, lag(hi) over (partition by doc_id, term order by hi, lo) as prev from occ"),
        ("single", f"select term, {cover} as n from o1 group by term"),
        ("kw", f"select distinct {g}, term from {best} join single using (term)"),
        ("pr", f"select distinct a.term as ta, b.term as tb from kw a join kw b using ({g}) where a.term < b.term"),
        ("pt", "select ta, tb, ta as term from pr union all select ta, tb, tb from pr"),
        ("o2", "select ta, tb, doc_id, lo, hi, lag(hi) over (partition by ta, tb, doc_id order by hi, lo) as prev from occ join pt using (term)"),
        ("uni", f"select ta, tb, {cover} as n from o2 group by ta, tb"),
        ("co", "select ta, tb, x.n + y.n - u.n as n from uni u join single x on x.term = ta join single y on y.term = tb"),
        ("cell0", f"select {g}, a.term as i, b.term as j from kw a join kw b using ({g})"),
        (
            "cell",
            f"select {g}, i, j, x.n / total::double as pi, y.n / total::double as pj, "
            "(case when i = j then x.n else coalesce(co.n, 0) end) / total::double as p from cell0 cross join tot "
            "join single x on x.term = i join single y on y.term = j "
            "left join co on ta = least(i, j) and tb = greatest(i, j)",
        ),
        ("v", f"select {g}, i, j, ln((p + 1e-12) / (pi * pj)) / -ln(p + 1e-12) as v from cell"),
        ("s", f"select {g}, i, j, v, sum(v) over (partition by {g}, j) as s from v"),
        ("cs", f"select {g}, i, coalesce(sum(v * s) / nullif(sqrt(sum(v * v)) * sqrt(sum(s * s)), 0), 0) as c from s group by {g}, i"),
        ("coh", f"select {g}, avg(c) as coherence from cs group by {g}"),
    ]


GRID = [(hi, a, b) for hi in (1, 2) for a in (1, 5) for b in (1.0, 0.95)]
SWEEP = [
    ("grid", "select * from (values " + ", ".join(f"({i}, {hi}, {a}, {b}::double)" for i, (hi, a, b) in enumerate(GRID)) + ") t(combo, max_n, min_df, max_df)"),
    ("tdf", "select *, count(*) over (partition by term) as df from tc"),
    ("nt", "select count(distinct topic) as nt from doc_topics"),
    ("sc", "select combo, topic, term, tf from tdf cross join grid cross join nt where len(string_split(term, ' ')) <= max_n and df >= min_df and df <= max_df * nt"),
]

ORACLE = {
    "category_words": sql(
        "select broad_label_id, rank, term, round(weight, 8) + 0.0 as weight from best",
        "terms1",
        extra=CAT + weight_sql("tc", "broad_label_id") + words_sql(10, by="broad_label_id"),
    ),
    "topic_term_counts": sql(
        "select topic, term, tf from (select *, count(*) over (partition by term) as df from tc) "
        "where df >= 2 and df <= 0.95::double * (select count(distinct topic) from doc_topics)",
        "terms2",
        extra=TC,
    ),
    "ctfidf": sql("select topic, term, tf, round(weight, 8) + 0.0 as weight from cw", "terms2", extra=TC + weight_sql("tc")),
    "topic_words": sql("select topic, rank, term from best", "terms2", extra=TC + weight_sql("tc") + words_sql(10)),
    "topic_barchart_data": sql(
        "select topic, rank, term, round(weight, 8) + 0.0 as weight from best",
        "terms2",
        extra=TC + weight_sql("tc") + words_sql(5, where="topic <> -1"),
    ),
    "topic_similarity": sql(
        "select a.topic as a, b.topic as b, round(coalesce(s, 0), 6) + 0.0 as similarity from (select distinct topic from u) a "
        "join (select distinct topic from u) b on a.topic < b.topic left join "
        "(select x.topic as ta, y.topic as tb, sum(x.u * y.u) as s from u x join u y using (term) where x.topic < y.topic group by all) "
        "on ta = a.topic and tb = b.topic",
        "terms2",
        extra=TC
        + weight_sql("tc")
        + [("u", "select topic, term, weight / sqrt(sum(weight * weight) over (partition by topic)) as u from cw where topic <> -1")],
    ),
    "topic_info": sql(
        "select c.topic, c.count, c.topic || '_' || array_to_string(list(term order by rank)[1:4], '_') as name, "
        "array_to_string(list(term order by rank), '|') as representation, any_value(d.docs) as representative_docs from "
        "(select topic, count(*) as count from doc_vectors group by topic) c join best using (topic) join "
        "(select topic, array_to_string(list(text order by rank), '|') as docs from reps3 group by topic) d using (topic) "
        "group by c.topic, c.count",
        "doc_vectors",
        "terms2",
        extra=VEC + weight_sql("tc") + words_sql(10) + REPS,
    ),
    "representative_docs": sql("select topic, rank, doc_id, round(similarity, 6) + 0.0 as similarity from reps3", "doc_vectors", extra=REPS),
    "coherence_cv": sql(
        "select topic, round(coherence, 6) + 0.0 as coherence from coh",
        "terms1",
        extra=TC1 + weight_sql("tc") + words_sql(10, where="topic <> -1") + coherence_sql(""),
    ),
    "sweep_vectorizer": sql(
        "select combo, max_n, min_df, max_df, round(c, 6) + 0.0 as coherence, "
        "row_number() over (order by round(c, 6) desc nulls last, combo) = 1 as best "
        "from grid left join (select combo, avg(coherence) as c from coh group by combo) using (combo)",
        "terms2",
        extra=TC
        + SWEEP
        + weight_sql("sc", grp="combo, ")
        + words_sql(10, grp="combo, ", where="topic <> -1")
        + coherence_sql("combo, "),
    ),
}
