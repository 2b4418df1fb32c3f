"""Registered plans against their DuckDB oracles at sf0.01 (a fast, wide
subset; tools/check_oracles.py runs every plan)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import TABLES, compare  # noqa: E402

from conftest import SF01  # noqa: E402

FAST = ["keyset_page", "sample_n", "rejects_by_reason", "clean_text", "decode_entities", "map_topics", "map_paper",
        "normalize_requests", "list_latest", "list_page2", "topic_hot", "topic_relevance", "topic_inner_hits",
        "filter_topics", "page_metadata", "duplicate_ids", "table_profile", "data_distribution", "topic_trends",
        "parse_payload", "protected_names", "bm25", "search_text", "search_filtered", "search_contextual",
        "knn_exact", "related_docs", "search_hybrid", "upsert_accounting", "sync_full"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def plans():
    from __spark_entry__ import oracle_sql, queries
    return queries(), oracle_sql()


def test_every_plan_is_registered_and_most_have_oracles(plans):
    qs, os_ = plans
    assert len(qs) >= 70
    assert set(os_) <= set(qs)
    assert len(os_) >= 60


@pytest.mark.parametrize("name", FAST)
def test_plan_matches_oracle(spark, con, plans, name):
    qs, os_ = plans
    res = compare(spark, name, qs[name], os_[name], SF01, con)
    assert res["status"] == "ok", res
