"""Views over the test tables: once as DataFrames, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.dims import BROAD, FINE, STOP_WORDS
from gistmill.functions.arrays import once
from gistmill.functions.draws import draw
from gistmill.functions.numbers import to_places
from gistmill.functions.text import clean_basic
from gistmill.operators.clean import add_broad_category, filter_short
from gistmill.operators.encode import encode
from gistmill.sources.readers import with_label_names

PROMPTS = ["default", "no_others", "cot", "few_shot"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # Test tables are one small file each; larger ones come in enough pieces by themselves.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r6(c: Column | str, name: str | None = None) -> Column:
    out = to_places(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def posts(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.withColumn("label_id", F.substring("source", 4, 10).cast("int")).withColumn(
        "split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    )


def raw_posts(spark, sf) -> DataFrame:
    p = posts(spark, sf)
    raw = F.concat(
        F.lit("From: "), "source", F.lit("@example.org\nSubject: "), F.col("doc_id").cast("string"),
        F.lit("\n\n> quoted\n: quoted\n"), "text", F.lit(" see http://example.org/"), F.col("doc_id").cast("string"),
    )
    return p.select("doc_id", raw.alias("raw"), "label_id", "split")


def cleaned(spark, sf) -> DataFrame:
    """Clean text, short ones still in."""
    r = once(raw_posts(spark, sf), "text", clean_basic(F.col("raw")))
    return with_label_names(r.select("doc_id", "text", "label_id", "split"))


def corpus(spark, sf) -> DataFrame:
    return add_broad_category(filter_short(cleaned(spark, sf)))


def doc_topics(spark, sf) -> DataFrame:
    topic = F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("label_id") % 12).cast("int")
    return corpus(spark, sf).withColumn("topic", topic)


def topic_names(spark, sf) -> DataFrame:
    """topic, prompt, tuned_topic_name, short_explanation; one name in nine unknown, one missing."""
    t = doc_topics(spark, sf).select("topic").distinct().filter("topic <> -1")
    each = t.select("topic", F.explode(F.array(*[F.lit(p) for p in PROMPTS])).alias("prompt"))
    names = F.array(*[F.lit(n) for _, n, _ in BROAD], F.lit("Others"), F.lit(None))
    at = (draw(5, "prompt", "topic") % 9).cast("int")
    return each.select(
        "topic", "prompt", F.get(names, at).alias("tuned_topic_name"), F.concat(F.lit("by "), "prompt").alias("short_explanation")
    )


def labelled_docs(spark, sf) -> DataFrame:
    """doc_id, topic, label, split, tuned_topic_name, short_explanation, topic_probability for the default prompt."""
    d = doc_topics(spark, sf).select(
        "doc_id", "topic", F.col("broad_label_id").alias("label"), "split", ((F.col("doc_id") % 100) / 100.0).alias("topic_probability")
    )
    n = topic_names(spark, sf).filter("prompt = 'default'").drop("prompt")
    return d.join(n, "topic", "left")


def predictions(spark, sf) -> DataFrame:
    """Broad label and a made prediction 0..8 for every document; some labels and some predictions are null."""
    d = add_broad_category(with_label_names(posts(spark, sf)))
    guess = F.when(F.col("n_chars") % 13 != 0, F.col("n_chars") % 9).cast("int")
    return d.select("doc_id", F.when(F.col("n_chars") % 17 != 0, F.col("broad_label_id")).alias("label"), guess.alias("predicted_label"))


def embeddings(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings")


def doc_vectors(spark, sf) -> DataFrame:
    """Every document of the corpus with the default encoder's vector."""
    return encode(doc_topics(spark, sf))


def axes(vec: str = "embedding"):
    """A fixed linear projection of whole vectors to two axes: sums over the even and the odd places."""
    doubles = F.col(vec).cast("array<double>")
    part = lambda k: F.aggregate(F.filter(doubles, lambda x, i: i % 2 == k), F.lit(0.0), lambda a, x: a + x)
    return F.array(part(0), part(1))


def plane(spark, sf) -> DataFrame:
    return embeddings(spark, sf).select("vec_id", "label", axes().alias("embedding"))


# ---------------------------------------------------------------- SQL side

NL = "chr(10)"
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


STOP_SQL = quoted(STOP_WORDS)


def sql_strip_header(c):
    return f"case when instr({c}, {NL} || {NL}) > 0 then substr({c}, instr({c}, {NL} || {NL}) + 2) else {c} end"


def sql_strip_quoted(c):
    keep = "lambda x: not starts_with(x, '>') and not starts_with(x, ':')"
    return f"array_to_string(list_filter(string_split({c}, {NL}), {keep}), {NL})"


def sql_strip_emails(c):
    return f"regexp_replace({c}, '[^{WS}]+@[^{WS}]+', '', 'g')"


def sql_strip_urls(c):
    return rf"regexp_replace({c}, 'http[^{WS}]+|www\.[^{WS}]+', '', 'g')"


def sql_strip_punct(c):
    return rf"regexp_replace({c}, '[!-/:-@\[-`{{-~]', '', 'g')"


def sql_squash_lower(c):
    return f"lower(trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'), ' '))"


def sql_words(c):
    return f"list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda x: x <> '')"


def sql_terms(c, stop=True):
    found = rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"
    return f"list_filter({found}, lambda x: x not in ({STOP_SQL}))" if stop else found


def sql_bigrams(t):
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def sql_axes(c):
    part = "coalesce(list_sum(list_transform(range(1, len({c}) + 1, 2), lambda i: {c}[i + {k}]::double)), 0)"
    return f"[{part.format(c=c, k=0)}, {part.format(c=c, k=1)}]"


def sql_draw(*parts):
    text = " || ':' || ".join(str(p) for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


def sql_round(e, name=None):
    out = f"(round({e}, 6) + 0.0)"
    return f"{out} as {name}" if name else out


_BROAD_ROWS = ", ".join(f"({i}, '{n}', '{s}')" for i, n, s in BROAD)
_FINE_ROWS = ", ".join(f"({i}, '{n}', {b})" for i, n, b in FINE)
_NAME_LIST = "[" + quoted([n for _, n, _ in BROAD] + ["Others"]) + "]"

# name: (names it needs, body)
VIEWS = {
    "fine": ([], f"select * from (values {_FINE_ROWS}) t(label_id, label, broad_label_id)"),
    "broad": ([], f"select * from (values {_BROAD_ROWS}) t(broad_label_id, name, short_name)"),
    "posts": (
        [],
        "select *, cast(substr(source, 4) as int) as label_id, case when doc_id % 5 = 0 then 'test' else 'train' end as split "
        "from documents",
    ),
    "raw_posts": (
        ["posts"],
        f"select doc_id, label_id, split, 'From: ' || source || '@example.org' || {NL} || 'Subject: ' || doc_id || {NL} || {NL} "
        f"|| '> quoted' || {NL} || ': quoted' || {NL} || text || ' see http://example.org/' || doc_id as raw from posts",
    ),
    "c1": (["raw_posts"], f"select doc_id, label_id, split, {sql_strip_header('raw')} as t from raw_posts"),
    "c2": (["c1"], f"select doc_id, label_id, split, {sql_strip_quoted('t')} as t from c1"),
    "c3": (["c2"], f"select doc_id, label_id, split, {sql_strip_urls(sql_strip_emails('t'))} as t from c2"),
    "cleaned": (
        ["c3", "fine"],
        f"select doc_id, {sql_squash_lower(sql_strip_punct('t'))} as text, c3.label_id, split, label, broad_label_id "
        "from c3 join fine using (label_id)",
    ),
    "corpus": (["cleaned"], "select * from cleaned where length(text) > 50"),
    "doc_topics": (
        ["corpus"],
        "select *, cast(case when doc_id % 11 = 0 then -1 else label_id % 12 end as int) as topic from corpus",
    ),
    "topic_names": (
        ["doc_topics"],
        f"select topic, prompt, {_NAME_LIST}[{sql_draw(5, 'prompt', 'topic')} % 9 + 1] as tuned_topic_name, "
        "'by ' || prompt as short_explanation from (select distinct topic from doc_topics where topic <> -1), "
        f"(select unnest([{quoted(PROMPTS)}]) as prompt)",
    ),
    "labelled_docs": (
        ["doc_topics", "topic_names"],
        "select doc_id, d.topic, broad_label_id as label, split, (doc_id % 100) / 100.0::double as topic_probability, "
        "tuned_topic_name, short_explanation from doc_topics d left join topic_names n on n.topic = d.topic and prompt = 'default'",
    ),
    "scored_docs": (
        ["labelled_docs", "broad"],
        "select l.*, cast(coalesce(broad_label_id, -1) as int) as predicted_topic_id from labelled_docs l "
        "left join broad on name = tuned_topic_name",
    ),
    "predictions": (
        ["posts", "fine"],
        "select doc_id, case when n_chars % 17 <> 0 then broad_label_id end as label, "
        "cast(case when n_chars % 13 <> 0 then n_chars % 9 end as int) as predicted_label from posts join fine using (label_id)",
    ),
    "doc_vectors": (
        ["doc_topics"],
        "select d.*, v.embedding from doc_topics d join (select c.doc_id, list(coalesce(s.x, 0)::double order by r.k) as embedding "
        "from doc_topics c cross join (select unnest(range(64)) as k) r left join (select doc_id, h // 2 as k, "
        "sum(case when h % 2 = 0 then 1 else -1 end) as x from (select doc_id, "
        f"{sql_draw('term')} % 128 as h from (select doc_id, unnest({sql_terms('text', False)}) as term from doc_topics)) group by all) s "
        "on s.doc_id = c.doc_id and s.k = r.k group by c.doc_id) v using (doc_id)",
    ),
    "plane": ([], f"select vec_id, label, {sql_axes('embedding')} as embedding from embeddings"),
    "terms1": (["doc_topics"], f"select doc_id, topic, split, broad_label_id, label, unnest({sql_terms('text')}) as term from doc_topics"),
    "toks": (["doc_topics"], f"select doc_id, topic, split, broad_label_id, label, {sql_terms('text')} as t from doc_topics"),
    "terms2": (
        ["toks"],
        f"select doc_id, topic, split, broad_label_id, label, unnest(list_concat(t, {sql_bigrams('t')})) as term from toks",
    ),
}


def sql(body: str, *names: str, recursive: bool = False, extra: list[tuple[str, str]] = ()) -> str:
    """A statement with the views it needs, in order, then further ones of its own."""
    order: list[str] = []

    def need(n):
        for d in VIEWS[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = [f"{n} as ({VIEWS[n][1]})" for n in order] + [f"{n} as ({b})" for n, b in extra]
    if not ctes:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
