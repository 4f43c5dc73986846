"""How many Python steps stand in a row, what workers keep, and how many files small tables take."""

import os
import re
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import decontaminate, near_dups, suffix_dups, words
from gistmill.llm.components import LINKS, TASKS, components
from gistmill.session import LEAST_FILES, scratch_root
from tests.llm.conftest import prose


def test_texts_are_decoded_where_bytes_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "ä" * 300, 300), (2, None, None)], "doc_id long, text string, n_chars long")
    assert "MapInArrow" not in suffix_dups.without_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()


def own_mb():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"Private_Dirty:\s+(\d+)", file.read())[1]) / 1024


@pytest.mark.skipif(words._trim is None, reason="not the GNU C library")
def test_a_worker_gives_freed_memory_back():
    """pipeline: arrays of the C library's heap stay with a worker while another one lies above them."""
    below = [np.ones(12_000) for _ in range(1000)]
    above = np.ones(1000)
    held = own_mb()
    del below
    assert not list(words.slices([]))
    assert held - own_mb() > 60 and above.sum() == 1000


def test_labels_are_written_in_few_files(spark):
    """pipeline: as many files as the labels need, whatever the number of shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        chain = spark.range(90).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 30 == 29, 0).otherwise(1)).alias("b"))
        got = components(chain)
        assert got.rdd.getNumPartitions() <= TASKS < 50 and LINKS > 180
        assert {(r["node"], r["label"]) for r in got.collect()} == {(i, i // 30 * 30) for i in range(90)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def files_below(path):
    return {os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.startswith("part-")}


def test_near_duplicates_writes_few_files(spark):
    """pipeline: signatures in as many files as the input has, two tables in as many as their rows need, whatever the number of shuffle partitions; no more."""
    texts = [prose(k % 9, 60) + ("end" if k > 20 else "") for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    root = scratch_root(spark).removeprefix("file:")
    with many_partitions(spark):
        before = files_below(root)
        got = near_dups.near_duplicates(docs).collect()
        made = files_below(root) - before
    assert {(r["id"], r["component_id"]) for r in got} == {(k, k % 9) for k in range(60)}
    assert 3 <= len(made) <= 4 + 2 * LEAST_FILES


def test_stages_write_few_files(spark, docs):
    """pipeline: what comes out of a shuffle has as many partitions as the input's text needs."""
    with many_partitions(spark):
        for name, stage in corpus_pipeline.STAGES[1:3]:
            assert stage(spark, docs, "").rdd.getNumPartitions() <= LEAST_FILES, name


@pytest.mark.skipif(words._trim is None, reason="not the GNU C library")
def test_a_group_hands_back_what_it_took():
    """pipeline: a worker that waits for its next task keeps nothing of the last group."""
    above, most = [], []

    def group(*tables):
        below = [np.ones(12_000) for _ in range(1000)]
        above.append(np.ones(1000))
        most.append(own_mb())
        return len(below)

    assert words.thrifty(group)(None) == 1000 and most[0] - own_mb() > 60
    assert words.thrifty_pair(group)(None, None) == 1000 and most[1] - own_mb() > 60


def test_powers_grow_by_a_quarter():
    """pipeline: each worker keeps them."""
    n = len(words.powers(5000)[0].base)
    assert len(words.powers(n + 1)[0].base) <= max(n + 1, n * 5 // 4)
    power, inverse = words.powers(n + 1)
    assert ((power * inverse) == 1).all()


def test_texts_pass_all_automata_in_one_step(spark, docs):
    """pipeline: one Python worker for each task of decontamination, not one for each automaton and one more."""
    text = prose(91, 30)
    items = spark.createDataFrame([(1, text), (2, prose(92, 30))], "item_id long, text string")
    found = decontaminate.decontaminate(docs.limit(3).select("doc_id", F.lit(text).alias("text")), items)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["n_hit"], r["items"]) for r in found.collect()] == [(r["n_words"], ["1"]) for r in found.collect()]
