"""Scores and pages in blocks: the same rows as by joins, and what is moved and written for them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quire.operators import search as S
from quire.operators.index import build_index, build_postings
from quire.operators.scoring import page_rows
from quire.plans.catalog import registry
from quire.plans.catalog_search import paper_index, search_requests, with_english
from quire.plans.common import papers

SPECS = [S.DEFAULT_SPEC, S.TextQuery({"title": 2.0, "abstract": 1.0}, fuzzy=False, min_should_match=0.7),
         S.TextQuery({"contextualContent.english": 2.0, "abstract": 1.0}, {"authors": 1.5}, min_should_match=0.6)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark):
    rnd = random.Random(3)
    words = ["history", "histories", "war", "wars", "the", "peace", "place", "peaceful", "running", "runner", "ran", "über", "a.b", "x"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    rows = [(f"d{i:03d}", text(4), text(30), "", text(6) if i % 7 == 0 else None, text(3), [text(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, openSummary string, other string, journal string, names array<string>")
    df = df.withColumn("contextualContent", F.coalesce("other", F.concat_ws(" ", F.filter(F.array("title", "abstract"), lambda x: x != ""))))
    return with_english(build_index(df, extra={"authors": F.col("names")}))


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(1, "the histories of wars and peace"), (2, "runing runer"), (3, None), (4, "place place PEACE war"), (None, "history war"),
            (5, "peaceful history"), (5, "the runner ran a war in a place of peace"), (6, "über a.b zzz"), (7, "war"), (7, "war")]
    return spark.createDataFrame(rows, "query_id long, query string")


def _stored(index):
    """The same tables, read as a stored index's are: documents are put together by arrays."""
    from dataclasses import replace
    return replace(index, stored=True)


@pytest.mark.parametrize("spec", SPECS)
def test_arrays_score_as_joins_do(index, requests, spec, monkeypatch):
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(S.score_requests(requests, index, spec))
    assert rows(S.score_requests(requests, _stored(index), spec)) == want != []
    if spec.keyword_fields:
        found = rows(S.matching_documents(requests, _stored(index), spec))
        assert len(found) == len(set(found)) == len(want)
        monkeypatch.setattr(S, "MAX_PAIRS", 120)  # several groups of requests
        monkeypatch.setattr(S, "MAX_KEYS", 0)
        assert rows(S.score_requests(requests, _stored(index), spec)) == want


def test_matches_are_not_written_and_totals_are_exact(spark, monkeypatch):
    p, idx = papers(spark, SF001), paper_index(papers(spark, SF001))
    req = search_requests(spark, SF001, "filtered")
    written, cut = {}, S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df, name: written.setdefault(name, cut(df, name)))
    found = S.search(p, idx, req.withColumn("size", F.lit(2)))
    assert "hits" not in found.columns
    found = found.collect()
    total = {r["query_id"]: r["total_hits"] for r in S.search_totals(p, idx, req).collect()}
    assert {(r["query_id"], r["total_hits"]) for r in found} <= set(total.items()) and found
    assert "search_matches" not in written and written["search_candidates"].count() < sum(total.values())


def test_best_rows_of_a_task_are_exact(monkeypatch):
    from quire.operators import scoring
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, None]), f"d{rnd.randrange(500):03d}", rnd.choice([None, 1.0, 2.0, 3.0]), float(rnd.randrange(3))) for _ in range(3000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("query_id", "id", "_key0", "_key1"), r)) for r in rows[i:i + 100]],
                                          pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("_key0", pa.float64()), ("_key1", pa.float64())])) for i in range(0, 3000, 100)]
    monkeypatch.setattr(scoring, "PENDING_ROWS", 150)
    got = pa.Table.from_batches(list(page_rows(20, ["_key0", "_key1"])(iter(batches)))).to_pylist()
    for q in (1, 2, None):
        mine = [r for r in rows if r[0] == q]
        best = sorted(mine, key=lambda r: (r[2] is None, -(r[2] or 0), -r[3], r[1]))[:20]
        assert [(r["query_id"], r["id"], r["_key0"], r["_key1"]) for r in got if r["query_id"] == q] == best
        assert sum(r["hits"] for r in got if r["query_id"] == q) == len(mine)


def test_postings_are_counted_without_a_row_per_occurrence(spark):
    plan = _plan(build_postings(papers(spark, SF001)))
    assert "Generate" not in plan and "Aggregate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["highlight", "compare_search"])
def test_the_vocabulary_is_searched_once_for_all_uses(spark, name, monkeypatch):
    times, find = [], S.fuzzy_candidates
    monkeypatch.setattr(S, "fuzzy_candidates", lambda *a: times.append(1) or find(*a))
    registry()[name](spark, SF001)
    assert len(times) == 1


def test_terms_that_share_a_hash_get_another_seed(spark, monkeypatch):
    from quire.operators import index as I
    idx = I.TextIndex(None, spark.createDataFrame([("title", "a", 1), ("title", "b", 1)], "field string, term string, df long"), None)
    hashed = F.xxhash64
    monkeypatch.setattr(I.F, "xxhash64", lambda seed, *c: F.when(seed == 0, F.lit(5).cast("long")).otherwise(hashed(seed, *c)))
    assert I.hash_seed(idx) == 1 and idx.seed == 1
