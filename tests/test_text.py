"""Golden rows and properties of the text columns."""

import pytest
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions.arrays import histogram, python_list
from gistmill.functions.replies import as_list, normalize_prediction, parse_topic_reply
from gistmill.operators import clean as op
from gistmill.operators.labelling import BROAD_NAMES, FINE_NAMES
from gistmill.registry import tables as t

SF = "/root/testdata/sf0.001"


def run(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, x string").select("i", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(got, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "fn, cases",
    [
        (tx.strip_header, {"no blank line\nhere": "no blank line\nhere", "h\n\nb\n\nc": "b\n\nc", "\n\nbody": "body", "end\n\n": ""}),
        (tx.strip_quoted, {"> q\nkeep\n: q\n > kept": "keep\n > kept", ">a\n:b": "", "a\n\nb": "a\n\nb"}),
        (tx.strip_emails, {"a@b c": " c", "mail x@y.z,\nnext": "mail \nnext", "@b c@ @@x a@@": "@b c@  ", "p q@r s": "p  s"}),
        (tx.strip_urls, {"http www. httpd": "http www. ", "see http://x.y/z now": "see  now", "awww.x.y b": "a b"}),
        (tx.strip_punct, {"a-b! «c»…": "ab «c»…"}),
        (tx.squash_lower, {"  A\t B　\nC ": "a b c", "\x1cX\x85": "x"}),
    ],
)
def test_scalar_golden(spark, fn, cases):
    assert run(spark, fn, list(cases)) == list(cases.values())


def test_one_pass_clean_equals_the_steps(spark):
    odd = [
        "x www.http://a@b.c d", "http://a.b/@c @@q @r a@", "wwww.a.b c@d e", "ht.tp://x h@ttp", ">q\n\n> w\nhttphttp www.",
        "a\u0085b@c\x1cd", "..http.. ,www.,", "", "\n\n", "@", "a@b@c d@", "WWW.X http", "x　@y z@　w",
    ]
    texts = odd + [r["raw"] for r in t.raw_posts(spark, SF).select("raw").collect()]
    single = [tx.strip_header, tx.strip_quoted, tx.strip_emails, tx.strip_urls, tx.strip_punct, tx.squash_lower]
    want = texts
    for step in single:
        want = run(spark, step, want)
    assert run(spark, tx.clean_basic, texts) == want


def test_clean_golden(spark):
    cases = {
        "From: a\n\nHi, mail me at x@y.z NOW": "hi mail me at now",
        "> quoted\nsee http://a.b/c and www.d.e\n: also quoted\nBye!": "see and bye",
        "h\n\n": "",
        "Two\n\nBlank\n\nLines": "blank lines",
        "don't http stop": "dont http stop",
    }
    assert run(spark, tx.clean_basic, list(cases)) == list(cases.values())


def test_words_segments_truncate(spark):
    def w(n):
        return " ".join(f"w{i}" for i in range(n))

    sizes = [0, 9, 10, 256, 257, 265, 266, 512, 600]
    got = run(spark, lambda c: F.transform(tx.sliding_segments(c), lambda s: F.size(F.split(s, " "))), [w(n) for n in sizes])
    assert got == [[], [], [10], [256], [257], [265], [266, 10], [512, 256], [512, 344, 88]]
    doubled = w(512).replace(" ", "  ")
    assert run(spark, tx.truncate_words, [doubled]) == [doubled]
    assert run(spark, lambda c: tx.truncate_words(c, 512, "end"), [w(513)]) == [w(513).split(" ", 1)[1]]
    assert run(spark, lambda c: tx.truncate_words(c, 2, "start"), [" a  b c"]) == ["a b"]


def test_terms_and_histogram(spark):
    got = run(spark, lambda c: tx.terms(c, ["the"], (1, 2)), ["The cat, the hat a b1"])
    assert got == [["cat", "hat", "b1", "cat hat", "hat b1"]]
    assert run(spark, lambda c: tx.terms(c, [], (2, 3)), ["aa"]) == [[]]
    hist = run(spark, lambda c: histogram(F.split(c, " ")), ["b a b c b a"])
    assert [tuple(x) for x in hist[0]] == [("a", 2), ("b", 3), ("c", 1)]


def test_short_filter_is_strict(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "x" * 51)], "doc_id int, text string")
    assert [r["doc_id"] for r in op.filter_short(df).collect()] == [2]
    assert tuple(op.short_report(df).first()) == (2, 1, 1)


def test_lemmatize_keeps_order_and_empty_documents(spark):
    df = spark.createDataFrame([(1, "cats and dogs ,, cats"), (2, "")], "doc_id long, text string")
    table = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    got = {r["doc_id"]: r["text"] for r in op.lemmatize(df, table).collect()}
    assert got == {1: "cat and dog cat", 2: ""}


def test_as_list(spark):
    cells = [None, "  ", '["a",1]', '{"a":1}', "a, ,b", "a|b", "a,b|c", " plain ", '["a", null]', '["a"'] + ["[1, 2] x"]
    got = run(spark, as_list, cells)
    assert got == [[], [], ["a", "1"], ['{"a":1}'], ["a", "b"], ["a", "b"], ["a", "b|c"], ["plain"], ["a", "None"], ['["a"'], ["[1", "2] x"]]


def test_replies(spark):
    replies = ['["sci.space"]', '[" sci.space "]', '["sci.space","sci.med"]', '["x"]', "sci.space", "[1]", None, '["sci.space"] more']
    assert run(spark, lambda c: normalize_prediction(c, FINE_NAMES), replies) == ["sci.space"] * 2 + ["other"] * 6
    full = '{"tuned_topic_name": "Sports", "short_explanation": "games"}'
    cells = [full, full.replace("Sports", "Others"), '{"tuned_topic_name": "Sports"}', f"[{full}]", "Sports", full + " x"]
    got = run(spark, lambda c: parse_topic_reply(c, BROAD_NAMES), cells)
    assert [g["ok"] for g in got] == [True, False, False, False, False, False]
    assert got[0]["tuned_topic_name"] == "Sports" and got[1]["tuned_topic_name"] is None


def test_python_list(spark):
    items = [["a b", "it's", 'say "x"', 'it\'s "x"', "back\\n"], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x array<string>")
    got = [r["y"] for r in df.select("i", python_list(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [str(x) for x in items]


def test_cleaning_runs_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    posts = t.raw_posts(spark, SF)
    posts.write.parquet(src)
    stream = spark.readStream.schema(posts.schema).parquet(src)
    q = op.prepare_corpus(stream).writeStream.format("memory").queryName("cleaned_stream").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["doc_id"], r["text"]) for r in op.prepare_corpus(posts).collect()}
    assert {(r["doc_id"], r["text"]) for r in spark.table("cleaned_stream").collect()} == want
