"""The stages one after the other against plain versions, and the registered queries against SQL."""

import __spark_entry__ as entry
import pytest
import sentencepiece

import corpus_pipeline
from gistmill.llm import queries
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_dedup import ordered
from tests.llm.test_tokens import PIECES
from tests.oracle import connect, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, given, tmp_path):
    rows = [*given, (300, prose(77, 100) + prose(78, 60)), (301, prose(78, 60) + prose(79, 90))]
    items = [(1, " ".join(prose(79, 90).split()[20:40])), (2, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = [(i, t) for i, t in rows if brute.quality(t)[-1]]
    want = [now]
    groups = {i: c for i, _, c in brute.near(now, 5, 80)}
    now = [(i, t) for i, t in now if i is None or groups[i] == i]
    want.append(now)
    now = [(i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")) for i, b, gone in brute.repeats(now)]
    want.append(now)
    now = [(i, left) for i, t in now if (left := brute.cut_items(t, items, corpus_pipeline.MOST_HIT)) is not None]
    want.append(now)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert ordered(docs.select("doc_id", "text").collect()) == ordered(expected), name
        assert docs.where("n_chars <> length(text)").count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert ordered((r["doc_id"], r["ids"]) for r in final.collect()) == ordered((i, library.encode(t)) for i, t in now)


def test_no_documents(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    cursor = connect(SF).execute(queries.ORACLE[name])
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())
