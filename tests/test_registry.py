"""Every registered query against its SQL statement, at the smallest scale."""

import __spark_entry__ as entry_module
import pytest

from gistmill.registry import all_oracles, all_queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Iterative fits, checked by tests of their own.
ROWS_ONLY = {
    "truncated_svd", "pca", "reduce_topics", "topic_map_data", "spectral_layout", "project_2d", "train_head",
    "compare_approaches", "kmeans", "embedding_quality", "topics_to_scores",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_fits_lack_sql():
    assert set(all_queries()) - set(all_oracles()) == ROWS_ONLY
    assert set(all_oracles()) <= set(all_queries())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 70 and {r["rank"] for r in rows} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, con, name):
    try:
        assert compare(spark, con, name, SF) is None
    finally:
        spark.catalog.clearCache()
