"""Topics, labels, scores, sources and sinks on small golden tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.dims import BROAD, FINE
from gistmill.functions.draws import hash_rank
from gistmill.operators import ablation as ab
from gistmill.operators import evaluate as ev
from gistmill.operators import labelling as lb
from gistmill.operators import relational as rel
from gistmill.operators import topics as tp
from gistmill.operators.contrastive import simcse_pairs
from gistmill.operators.encode import encode
from gistmill.prompts import TOPIC_TEMPLATES, doc_template
from gistmill.registry import tables as t
from gistmill.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_dimension_is_whole():
    assert len(FINE) == 20 and [f[1] for f in FINE] == sorted(f[1] for f in FINE)
    assert {f[2] for f in FINE} == {b[0] for b in BROAD} == set(range(1, 8))


def brute_average_link(sim, n):
    """One pair at a time, the textbook way."""
    groups = [[i] for i in range(len(sim))]
    while len(groups) > n:
        best = max(
            ((np.mean([sim[a, b] for a in x for b in y]), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        )
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {m: min(g) for g in groups for m in g}


@pytest.mark.parametrize("n", [1, 3, 6, 11])
def test_merging_topics_equals_one_pair_at_a_time(spark, n):
    g = np.random.default_rng(5)
    x = g.random((11, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    rows = [(i, j, float(sim[i, j])) for i in range(11) for j in range(i + 1, 11)]
    assert tp.merge_topics(spark.createDataFrame(rows, "a int, b int, similarity double"), n) == brute_average_link(sim, n)


def test_ten_thousand_topics_are_merged(spark):
    """Sparse similarities: chains of twenty topics, the groups of which share nothing."""
    rows = [(i, i + 1, 0.5 + (i * 7919 % 1000) / 2500) for i in range(10_000) if i % 20 != 19]
    got = tp.merge_topics(spark.createDataFrame(rows, "a int, b int, similarity double"), 500, spark.range(10_000).select(F.col("id").cast("int").alias("topic")))
    assert len(got) == 10_000 and {t: t // 20 * 20 for t in range(10_000)} == got
    fewer = tp.merge_topics(spark.createDataFrame(rows, "a int, b int, similarity double"), 498)
    assert len(set(fewer.values())) == 498 and {fewer[t] for t in range(60)} == {0} and fewer[61] == 60


def test_reduce_topics_keeps_documents_and_outliers(spark):
    docs = t.doc_topics(spark, SF)
    from gistmill.operators.features import tokenize_terms

    tok = tokenize_terms(docs, t.STOP_WORDS).persist()
    out = tp.reduce_topics(tok, tp.ctfidf(tp.topic_term_counts(tok)), 5)
    rows = {r["doc_id"]: r["topic"] for r in out.select("doc_id", "topic").collect()}
    before = {r["doc_id"]: r["topic"] for r in docs.select("doc_id", "topic").collect()}
    assert rows.keys() == before.keys()
    assert {d for d, x in rows.items() if x == -1} == {d for d, x in before.items() if x == -1}
    assert set(rows.values()) == {-1, 0, 1, 2, 3}
    sizes = [sum(x == i for x in rows.values()) for i in range(4)]
    assert sizes == sorted(sizes, reverse=True)


def test_global_rank_without_one_task(spark):
    from gistmill.functions.draws import global_rank

    df = spark.range(3000).select("id", (F.col("id") * 7919 % 100).alias("v")).repartition(6)
    ranked = global_rank(df, F.desc("v"), F.col("id"))
    want = {i: k for k, i in enumerate(sorted(range(3000), key=lambda i: (-(i * 7919 % 100), i)))}
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want
    assert global_rank(df.limit(0), F.col("id")).count() == 0


def test_topics_without_a_shared_term_stay(spark):
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (1, "zz", 2.0), (-1, "a", 1.0)], "topic int, term string, weight double")
    profiles = spark.createDataFrame([("X", "a", 1.0), ("Y", "b", 1.0)], "category string, term string, u double")
    got = {r["topic"]: (r["category"], r["score"]) for r in lb.keyword_labeller(weights, profiles).collect()}
    assert got == {0: ("X", pytest.approx(0.5**0.5)), 1: (None, 0.0)}


def test_hash_rank_is_dense_for_any_partitioning(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"))
    a = hash_rank(df.repartition(1), "g", "id", 1).collect()
    b = hash_rank(df.repartition(7), "g", "id", 1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    by = {}
    for r in a:
        by.setdefault(r["g"], []).append(r["pos"])
        assert r["members"] == sum(x["g"] == r["g"] for x in a) if r["id"] < 3 else True
    assert all(sorted(p) == list(range(len(p))) for p in by.values())


def test_simcse_draws_with_replacement_when_short(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    got = simcse_pairs(df, 100).collect()
    assert len(got) == 50 and all(r["a_id"] == r["b_id"] for r in got) and len({r["a_id"] for r in got}) < 50
    assert simcse_pairs(df, 20).distinct().count() == 20


def scores(spark, rows):
    df = spark.createDataFrame(rows, "label int, predicted_label int")
    rec = ev.category_alignment(df, "x").first()
    return rec


def test_scores_golden(spark):
    rec = scores(spark, [(1, 1), (1, 2), (2, 2), (3, 4)])
    assert rec["labels"] == [1, 2, 3, 4]
    assert rec["per_class_f1"] == pytest.approx([2 / 3, 2 / 3, 0, 0])
    assert rec["macro_f1"] == pytest.approx(1 / 3)
    assert rec["weighted_f1"] == pytest.approx((2 * 2 / 3 + 2 / 3) / 4)
    assert rec["confusion_matrix"] == [[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
    assert scores(spark, [(1, 1), (2, 2)])["macro_f1"] == 1.0
    assert scores(spark, [(1, 2), (2, 1)])["macro_f1"] == 0.0


def test_confusion_sums_to_the_rows(spark):
    p = t.predictions(spark, SF)
    scored = p.where("label is not null and predicted_label is not null").count()
    assert ev.confusion_matrix(p).agg(F.sum("n")).first()[0] == scored
    f1 = [r["f1"] for r in ev.per_class_f1(p).collect()]
    assert all(0 <= x <= 1 for x in f1)


def test_unmatched_keys_are_an_error(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "doc_id int, label int")
    b = spark.createDataFrame([(1, 1)], "doc_id int, predicted_label int")
    assert ev.align_keys(a.limit(1), b).count() == 1
    with pytest.raises(Exception, match="keys differ"):
        ev.align_keys(a, b).collect()


def test_label_id_of_name(spark):
    names = [None, "Others", *[n for _, n, _ in BROAD]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, tuned_topic_name string")
    got = [r["predicted_topic_id"] for r in rel.label_id_of_name(df).orderBy("i").collect()]
    assert got == [-1, -1, 1, 2, 3, 4, 5, 6, 7]


def test_batches(spark):
    df = spark.range(7).select(F.col("id").cast("int").alias("topic"))
    assert [r["batch"] for r in rel.split_batches(df, 3).orderBy("topic").collect()] == [1, 1, 1, 2, 2, 3, 3]
    assert [tuple(r) for r in rel.fixed_batches(df).orderBy("topic").select("batch", "batches").collect()] == [(1, 2)] * 5 + [(2, 2)] * 2


def test_best_prompt_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("few_shot", 0.5), ("cot", 0.5), ("no_others", 0.2)], "prompt string, macro_f1 double")
    assert tuple(ab.best_prompt(df).first()) == (0.2, 0.5, "cot", False)
    same = df.withColumn("macro_f1", F.lit(0.3))
    assert tuple(ab.best_prompt(same).first()) == (0.3, 0.3, "no_others", True)


def test_prompt_tables_with_a_missing_topic(spark):
    rows = [(0, "cot", "Sports"), (0, "few_shot", "Sports"), (1, "cot", "Sports"), (1, "few_shot", "Religion"), (2, "cot", "Religion")]
    df = spark.createDataFrame(rows, "topic int, prompt string, tuned_topic_name string")
    wide = {r["topic"]: (r["no_others"], r["cot"], r["few_shot"]) for r in ab.prompt_comparison(df).collect()}
    assert wide == {0: (None, "Sports", "Sports"), 1: (None, "Sports", "Religion"), 2: (None, "Religion", None)}
    assert tuple(ab.prompt_disagreement(df).first()) == (2, 1)


def test_prompts_hold_their_parts(spark):
    info = spark.createDataFrame(
        [(-1, ["x"], ["d"]), (0, ["a", "b", "c", "d", "e", "f"], ["y" * 60] * 9)],
        "topic int, representation array<string>, representative_docs array<string>",
    )
    got = lb.build_topic_prompt(lb.topic_inputs(info), list(TOPIC_TEMPLATES)).collect()
    assert [r["topic"] for r in got] == [0] * 5 and len({r["prompt_text"] for r in got}) == 5
    for r in got:
        assert "GROUP APART\n['a', 'b', 'c', 'd', 'e']" in r["prompt_text"]
        assert str(["y" * 50] * 8) in r["prompt_text"] and all(n in r["prompt_text"] for n in lb.BROAD_NAMES)
        assert "{keywords}" not in r["prompt_text"] and "{categories}" not in r["prompt_text"]
    assert all(n in doc_template(20) for n in lb.FINE_NAMES) and all(n in doc_template(7) for n in lb.SHORT_NAMES)
    with pytest.raises(ValueError):
        doc_template(8)


def test_labeller_errors_cost_one_row(spark):
    def fn(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "i int, prompt_text string").coalesce(1)
    before = df.schema
    got = {r["i"]: (r["reply"], r["answered"], r["error"]) for r in lb.apply_labeller(df, fn).collect()}
    assert got == {1: ("A", True, None), 2: ("other", False, "RuntimeError: no answer"), 3: ("C", True, None)} and df.schema == before

    def broken(prompts):
        return prompts[0].no_such_thing

    with pytest.raises(Exception, match="no_such_thing"):
        lb.apply_labeller(df, broken).collect()


def test_batches_keep_prompts_apart(spark):
    df = spark.createDataFrame([(p, str(k)) for p in "xyy" for k in range(4)], "prompt string, prompt_text string").coalesce(1)
    got = lb.apply_labeller(df, lambda p: [f"{len(p)}"] * len(p), batch_size=3, by="prompt").collect()
    assert [r["reply"] for r in got] == ["3", "3", "3", "1"] + ["3"] * 6 + ["2", "2"]


def test_few_shot_replies_are_valid(spark):
    import re

    replies = re.findall(r"REPLY (\{.*?\})", TOPIC_TEMPLATES["few_shot"])
    read = lb.read_topic_replies(spark.createDataFrame([(r,) for r in replies], "reply string")).collect()
    assert len(replies) == 2 and all(r["ok"] for r in read)


def test_one_bad_prompt_costs_few_calls():
    calls = []

    def fn(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise OSError
        return list(prompts)

    got = lb.answered_in_halves(fn, ["bad" if k == 37 else str(k) for k in range(64)])
    assert [r for r, e in got if not e] == [str(k) for k in range(64) if k != 37] and got[37] == (None, "OSError: ")
    assert len(calls) == 13 and calls[0] == 64
    calls.clear()
    short = lb.answered_in_halves(lambda p: calls.append(1) or p[:1], list("abcd"))
    assert [r for r, _ in short] == list("abcd") and len(calls) == 7


def test_caller_supplied_encoder(spark):
    def make():
        return lambda texts: np.array([[len(x), 1.0] for x in texts])

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in encode(df, make).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0]}
    unit = encode(df, make, normalize=True).collect()
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1) for r in unit)


def test_coherence_of_words_that_always_or_never_meet(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "c d") for i in range(20)], "doc_id long, text string")
    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "a"), (2, "zzz")], "topic int, term string")
    got = {r["topic"]: r["coherence"] for r in tp.coherence_cv(docs, words).collect()}
    assert got[0] == pytest.approx(1) and got[2] == pytest.approx(1) and got[1] < 0.2


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_window_counts_by_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(tp, "SENT_BYTES", sent)
    g = np.random.default_rng(0)
    texts = [" ".join(g.choice(list("abcdefgh"), n, p=[0.02, 0.02, 0.06, 0.1, 0.2, 0.2, 0.2, 0.2])) for n in (1, 5, 30, 31, 200, 700)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    topics = {1: "abc", 2: "cbz", 3: "d"}
    words = spark.createDataFrame([(k, c) for k, ws in topics.items() for c in ws], "topic int, term string")
    single, pairs, total = tp.window_counts(docs, words, 30)
    one, two, windows = {}, {}, 0
    for x in texts:
        w = x.split()
        for s in range(max(1, len(w) - 29) if w else 0):
            seen = set(w[s : s + 30])
            windows += 1
            for c in seen & set("abcdz"):
                one[c] = one.get(c, 0) + 1
            for k, ws in topics.items():
                for a in ws:
                    for b in ws:
                        if a < b and {a, b} <= seen:
                            two[k, a, b] = two.get((k, a, b), 0) + 1
    assert total == windows and {r["term"]: r["n"] for r in single.collect()} == one
    assert {(r["topic"], r["a"], r["b"]): r["n"] for r in pairs.collect() if r["n"]} == two


def test_lookups_in_the_row_equal_joins(spark, monkeypatch):
    """Weights, counts, lemmas and categories, with tables that are sent to the tasks and with such as are joined."""
    from gistmill.operators import clean, features

    docs = t.doc_topics(spark, SF).select("doc_id", "text", "label").limit(60)
    docs = spark.createDataFrame(docs.collect() + [(1001, "", None), (1002, "zzz", None), (1003, None, None)], docs.schema)
    tok = features.counted(features.tokenize_terms(docs, t.STOP_WORDS))
    vocab = features.build_vocabulary(tok, 2, 0.9, 500)
    lemmas = spark.createDataFrame([("the", "THE"), ("and", "&"), ("of", None), (None, "x"), ("and", "zz")], "token string, lemma string")
    profiles = tp.unit_weights(tp.ctfidf(tp.topic_term_counts(tok.withColumn("terms", F.col("counts.term")), topic="label"), "label"), "label").withColumnRenamed("label", "category")
    got = []
    for sent in (1 << 24, -1):
        for module in (features, clean, lb):
            monkeypatch.setattr(module, "SENT_BYTES", sent)
        weights = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf_transform(tok, vocab).collect()}
        counts = sorted(map(tuple, features.count_vectorize(tok, vocab).collect()))
        text = sorted(map(tuple, clean.lemmatize(docs.select("doc_id", "text"), lemmas).collect()))
        named = sorted((r["doc_id"], r["p"] or "") for r in lb.classify_terms(tok, {"p": (profiles, lb.FINE_NAMES)}).collect())
        got.append((weights, counts, text, named))
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1:] == got[1][1:]
    plan = features.tfidf_transform(tok, vocab)
    for module in (features,):
        monkeypatch.setattr(module, "SENT_BYTES", 1 << 24)
    assert "Exchange" not in features.tfidf_transform(tok, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == len(got[0][0])


def test_variants_written_twice_equal_once(spark, tmp_path):
    from gistmill.operators.clean import build_variants, prepare_corpus

    path = str(tmp_path / "v")
    v = build_variants(prepare_corpus(t.raw_posts(spark, SF)))
    writers.write_variants(v, path)
    once = spark.read.parquet(path).count()
    writers.write_variants(v.filter("variant = 'basic'"), path)
    assert spark.read.parquet(path).count() == once == v.count()
    train, test = readers.load_variant(spark, "basic", path)
    assert train.count() + test.count() == once / 3
    assert "PartitionFilters: [isnotnull(variant" in train._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        readers.load_variant(spark, "basic")


def test_readers_check_their_input(spark, tmp_path):
    bad = str(tmp_path / "bad")
    spark.range(3).write.option("header", True).csv(bad)
    with pytest.raises(ValueError):
        readers.read_predictions(spark, bad)
    assert readers.read_projection(spark, str(tmp_path / "missing")) is None


def test_csv_keeps_quotes_and_newlines(spark, tmp_path):
    rows = [(1, 'he said "no", twice\nand left', "a", 0.5, -1.0)]
    df = spark.createDataFrame(rows, readers.PROJECTION_SCHEMA)
    writers.write_projection(df, str(tmp_path / "p"))
    assert [tuple(r) for r in readers.read_projection(spark, str(tmp_path / "p"), multi_line=True).collect()] == rows


def test_null_predictions_are_misses(spark):
    """All scores say the same of rows whose prediction or label is null."""
    rows = [(1, 1), (1, None), (1, None), (2, 2), (None, 2), (None, None)]
    rec = scores(spark, rows)
    df = spark.createDataFrame(rows, "label int, predicted_label int")
    assert rec["labels"] == [1, 2] and rec["per_class_f1"] == pytest.approx([0.5, 1.0])
    assert rec["confusion_matrix"] == [[1, 0], [0, 1]]
    assert rec["macro_f1"] == ev.macro_f1(df).first()[0] == pytest.approx(0.75)
    assert rec["weighted_f1"] == ev.weighted_f1(df).first()[0] == pytest.approx((3 * 0.5 + 1.0) / 4)
    assert [(r["label"], r["tp"], r["fp"], r["fn"], r["support"]) for r in ev.per_class_f1(df).orderBy("label").collect()] == [(1, 1, 0, 2, 3), (2, 1, 0, 0, 1)]


def test_rounding_keeps_what_is_no_number(spark):
    from gistmill.functions.numbers import to_places

    values = [1.2345675, -0.5, float("nan"), float("inf"), float("-inf"), 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(to_places(F.col("x"), 6)).collect()]
    assert got[:2] == pytest.approx([1.234568, -0.5]) and np.isnan(got[2]) and got[3:] == [float("inf"), float("-inf"), 1e300, None]


def test_small_weights_are_ranked(spark):
    df = spark.createDataFrame([(0, "a", 1e-11), (0, "b", 4e-10)], "topic int, term string, weight double")
    assert [r["term"] for r in tp.topic_words(df, 1).collect()] == ["b"]


def test_unknown_label_ids_are_an_error(spark):
    posts = spark.createDataFrame([(1, "x", 3), (2, "y", None)], "doc_id int, text string, label_id int")
    assert {r["doc_id"]: r["label"] for r in readers.with_label_names(posts).collect()} == {1: FINE[3][1], 2: None}
    with pytest.raises(Exception, match="unknown label_id 99"):
        readers.with_label_names(posts.withColumn("label_id", F.lit(99))).collect()
