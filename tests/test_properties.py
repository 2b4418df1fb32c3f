"""Properties: replays, streams, late rows, plan shapes, ties, caps that are none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from quire.functions._ship import ship_by_value
from quire.functions.embed import EmbeddingStore, HashingEmbedder, PiecewiseEmbedder, embed_column
from quire.operators import quantise as PQ
from quire.operators import search as S
from quire.operators import vector as V
from quire.operators.mapping import join_sources
from quire.operators.quality import duplicate_ids
from quire.operators.table import PapersTable, newest_per_key
from quire.plans.catalog import registry
from quire.plans.catalog_search import CONTEXTUAL_SPEC, paper_index, search_requests
from quire.plans.catalog_sync import _arrive, _run_stream, batch_a, batch_b, sync_flat
from quire.plans.common import papers
from quire.session import shared_path
from quire.sources.fixtures import crossref_source, flat_sources, read_table, stats_source
from quire.streaming import sync as SY


def _content(t):
    return sorted((r.id, r.citationsCount) for r in t.read().select("id", "citationsCount").collect())


def _table(spark, name, **options):
    return PapersTable(spark, shared_path(spark, "t", name), **options)


@pytest.fixture(scope="module")
def flat(spark):
    return flat_sources(spark, read_table(spark, SF001, "documents"))


def test_replays_change_nothing_whatever_came_since(spark, flat):
    t = _table(spark, "one")
    sync_flat(spark, batch_a(flat), t, 1)
    sync_flat(spark, batch_b(flat), t, 2)
    before = _content(t)
    sync_flat(spark, batch_b(flat), t, None)  # a batch without an id resets nothing
    for part, k in ((batch_b(flat), 2), (batch_a(flat), 1)):
        assert not sync_flat(spark, part, t, k)["applied"]
    assert _content(t) == before
    status = SY.sync_status(t).first()
    assert status["batches"] == 3  # replays are counted nowhere


def test_batch_split_does_not_matter_and_compaction_keeps_all(spark, flat):
    one, many = _table(spark, "whole"), _table(spark, "many", compact_after=2)
    sync_flat(spark, batch_a(flat), one, 1)
    sync_flat(spark, batch_b(flat), one, 2)
    for k in range(4):
        sync_flat(spark, batch_a(flat).where(F.col("doc_id") % 4 == k), many, k + 1)
    sync_flat(spark, batch_b(flat), many, 10)
    assert _content(many) == _content(one)
    assert len(many._live()) <= 3


def test_second_stream_is_not_taken_for_a_replay(spark, flat):
    t = _table(spark, "streams")
    sync_flat(spark, flat.where("doc_id < 20"), t, 0, stream="first")
    sync_flat(spark, flat.where("doc_id between 20 and 39"), t, 1, stream="first")
    m = sync_flat(spark, flat.where("doc_id >= 40"), t, 0, stream="second")
    assert m["applied"] and m["created"] > 0
    assert max(i for i, _ in _content(t)) > "p00000040"


def test_batch_without_its_log_row_is_not_read_and_can_be_retried(spark, flat):
    t = _table(spark, "crash")
    sync_flat(spark, flat.where("doc_id < 20"), t, 0)
    before = _content(t)
    real, t._append = t._append, lambda row: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        sync_flat(spark, flat.where("doc_id >= 20"), t, 1)
    t._append = real
    assert _content(t) == before and t.rejects().where("batch like '%000001'").count() == 0
    assert sync_flat(spark, flat.where("doc_id >= 20"), t, 1)["applied"]
    assert len(_content(t)) > len(before)


def test_wrong_size_vectors_are_not_stored(spark):
    from quire.schema import papers_schema
    t = _table(spark, "dims")
    t.create_if_absent(papers_schema(3))
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0])], "id string, embeddingVector array<float>")
    for f in papers_schema(3).fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    t.upsert(rows, 1)
    assert {r["id"]: r["embeddingVector"] for r in t.read().collect()} == {"a": [1.0, 2.0, 3.0], "b": None}
    assert t.drop() and not t.drop()


def test_last_row_of_a_key_wins_and_duplicates_multiply_nothing(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(map(tuple, newest_per_key(df, ["k"], ["n"]).collect())) == [("a", 3, "z"), ("b", 1, None)]
    flat = flat_sources(spark, read_table(spark, SF001, "documents"))
    cr = crossref_source(flat)
    joined = join_sources(stats_source(flat), cr.unionByName(cr))
    assert joined.count() == flat.count()


def test_stream_restart_takes_no_batch_twice_and_late_rows_are_found(spark, flat):
    base = shared_path(spark, "streams", "late")
    t = PapersTable(spark, f"{base}/table")
    stats_source(flat).write.parquet(f"{base}/stats")
    early = crossref_source(flat).withColumn("arrived", F.lit(0)).where(F.substring("_id", -1, 1) != "3")
    early.write.parquet(f"{base}/crossref")
    _run_stream(spark, base, t)
    first = t.log().count()
    _run_stream(spark, base, t)
    assert t.log().count() == first == 1
    have = t.read().count()
    crossref_source(flat).withColumn("arrived", F.lit(1)).where(F.substring("_id", -1, 1) == "3").write.mode("append").parquet(f"{base}/crossref")
    _run_stream(spark, base, t)
    whole = _table(spark, "late_whole")
    sync_flat(spark, flat, whole, 1)
    assert t.read().count() > have and _content(t) == _content(whole)


def test_two_arrivals_in_one_run_equal_two_runs(spark):
    contents = []
    for name, runs in (("together", [(0, 1)]), ("apart", [(0,), (1,)])):
        base = shared_path(spark, "streams", name)
        t = PapersTable(spark, f"{base}/table")
        for arrivals in runs:
            for k in arrivals:
                _arrive(spark, SF001, base, k)
            _run_stream(spark, base, t)
        contents.append(_content(t))
    assert contents[0] == contents[1]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_is_top_k_not_full_sort(spark):
    plan = _plan(registry()["list_latest"](spark, SF001))
    assert "TakeOrderedAndProject" in plan


def test_search_has_no_row_at_a_time_python(spark):
    plan = _plan(registry()["search_text"](spark, SF001))
    assert "BatchEvalPython" not in plan


def test_search_pushes_few_terms_to_the_scan(spark):
    from quire.operators.index import postings_of
    idx = paper_index(papers(spark, SF001))
    some = idx.term_stats.where("field = 'title'").select("field", "term").orderBy("term").limit(2)
    pruned = postings_of(idx, some)
    assert "PushedFilters: [In(term" in _plan(pruned)
    assert postings_of(idx, idx.term_stats) is idx.postings
    hits = lambda df: sorted(map(str, df.join(some, ["field", "term"], "left_semi").select("field", "term", "id", "tf").collect()))
    assert hits(pruned) == hits(idx.postings) and hits(pruned)


def test_matches_are_scored_without_a_shuffle(spark):
    idx, req = paper_index(papers(spark, SF001)), search_requests(spark, SF001).select("query_id", "query")
    for spec in (S.DEFAULT_SPEC, CONTEXTUAL_SPEC):
        plan = _plan(S.score_documents(req, idx, spec))
        assert " Exchange" not in plan and "Bucketed: true" in plan
    plan = _plan(S.search_totals(papers(spark, SF001), idx, search_requests(spark, SF001)))
    assert "tf#" not in plan and "dl#" not in plan  # nothing that only a score needs is read


def test_documents_are_numbered_densely(spark):
    docs = paper_index(papers(spark, SF001)).docs
    assert sorted(r["doc"] for r in docs.select("doc").collect()) == list(range(docs.count()))


def test_prefix_filter_loses_no_match_and_leaves_rows_out(spark):
    idx, req = paper_index(papers(spark, SF001)), search_requests(spark, SF001).select("query_id", "query")
    qexp = S.scored_terms(req, idx, CONTEXTUAL_SPEC)
    per_slot = qexp.groupBy("query_id", "field", "slot").agg(F.max("rare").alias("rare"), F.min("rare").alias("rare_too"))
    assert per_slot.where("rare <> rare_too").count() == 0  # all expansions of a query term or none
    moved = idx.postings.join(qexp, ["field", "term"]).groupBy("rare").count().collect()
    moved = {r["rare"]: r["count"] for r in moved}
    assert 0 < moved[True] < moved[False]
    # against a plain count of all slots that each document has
    rows = idx.postings.join(qexp.withColumn("nq", F.col("slot").bitwiseAND(F.lit((1 << 28) - 1))), ["field", "term"])
    plain = rows.groupBy("query_id", "doc", "field").agg(F.count_distinct("slot").alias("n"), F.max("nq").alias("nq"))
    plain = plain.where("n >= greatest(1, floor(0.75 * nq))").select("query_id", "doc").distinct()
    pairs = lambda df: sorted(map(tuple, df.select("query_id", "doc").collect()))
    assert pairs(S.matching_documents(req, idx, CONTEXTUAL_SPEC)) == pairs(plain) == pairs(S.score_documents(req, idx, CONTEXTUAL_SPEC)) != []


def test_totals_have_a_row_for_requests_without_hits(spark):
    p = papers(spark, SF001)
    req = spark.createDataFrame([(1, "zzzzqqqq", 0, 5), (2, "the", 4000, 5)], "query_id long, query string, from int, size int")
    found = {r["query_id"]: r["total_hits"] for r in S.search_totals(p, paper_index(p), req).collect()}
    assert found[1] == 0 and found[2] > 0
    with pytest.raises(ValueError):
        S.search(p, paper_index(p), req.withColumn("from", F.lit(60_000)))


def test_author_filter_of_a_request(spark):
    p = papers(spark, SF001)
    req = search_requests(spark, SF001).withColumn("author", F.lit("Given8 Family8"))
    with_author = {r["id"] for r in p.where(F.exists("authors", lambda a: a["name"] == "Given8 Family8")).collect()}
    found = {r["id"] for r in S.search(p, paper_index(p), req).collect()}
    assert found and found <= with_author


def test_english_leg_counts_its_own_terms(spark):
    rows = [("a", "the histories of wars"), ("b", "history of the war"), ("c", "peace")]
    from quire.operators.index import build_index
    from quire.plans.catalog_search import with_english
    df = spark.createDataFrame([(i, t, t, "", t, "") for i, t in rows], "id string, title string, abstract string, openSummary string, "
                               "contextualContent string, journal string")
    req = spark.createDataFrame([(1, "the histories and the war")], "query_id long, query string")
    spec = S.TextQuery({"contextualContent.english": 2.0}, fuzzy=False, min_should_match=0.75)
    assert {r["id"] for r in S.score_requests(req, with_english(build_index(df)), spec).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        S.score_requests(req, build_index(df), CONTEXTUAL_SPEC)


def test_knn_cuts_ties_by_id_however_rows_are_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:04d}", [1.0, 2.0]) for i in range(500)] + [("x", [0.0, 0.0]), ("y", None)], "id string, vec array<double>")
    qs = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], "query_id long, vec array<double>")
    want = [(k, f"d{i:04d}") for k in range(3) for i in range(5)]
    for doc_block, query_block, parts in ((16384, 2048, 1), (64, 2, 8)):
        monkeypatch.setattr(V, "DOC_BLOCK", doc_block)
        monkeypatch.setattr(V, "QUERY_BLOCK", query_block)
        got = V.knn_exact(docs.repartition(parts), qs, 5, 2).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["id"]) for r in got] == want


def test_registered_recall_is_at_least_nine_tenths(spark):
    import __spark_entry__
    recall = [r["recall"] for r in __spark_entry__.queries()["knn_recall"](spark, "/root/testdata/sf0.01").collect()]
    assert len(recall) == 500 and sum(recall) / len(recall) >= .9


def test_stored_cells_equal_exact_when_all_are_probed_and_recall_is_high(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    vectors = centres[rng.integers(0, 20, 2000)] + .3 * rng.standard_normal((2000, 16))
    docs = spark.createDataFrame([(f"d{i:05d}", v.tolist()) for i, v in enumerate(vectors)], "id string, vec array<double>")
    qs = docs.where("id < 'd00060'").select(F.col("id").alias("query_id"), "vec")
    index = V.ivf_build(docs, 16, shared_path(spark, "t", "ivf"), n_cells=20)
    exact = V.knn_exact(docs, qs, 10, 16)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "rank").collect()))
    assert rows(V.ivf_search(index, qs, 10, nprobe=20)) == rows(exact)
    recall = [r["recall"] for r in V.recall_at_k(V.ivf_search(index, qs, 10, nprobe=3), exact).collect()]
    assert sum(recall) / len(recall) >= .9
    assert "PartitionFilters" in _plan(index.cells(spark).where("cell = 1"))


@pytest.mark.parametrize("dim", [24, 10])
def test_coded_cells_rank_like_the_exact_search(spark, dim):
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in rng.standard_normal((2000, dim))] + [[0.0] * dim, None, [1.0]]
    docs = spark.createDataFrame([(f"d{i:05d}", v) for i, v in enumerate(vectors)], "id string, vec array<double>")
    qs = docs.where("id < 'd00080' or id > 'd01998'").select(F.col("id").alias("query_id"), "vec")
    ivf = V.ivf_build(docs, dim, shared_path(spark, "t", "ivf"), n_cells=12)
    index = PQ.pq_build(ivf, spark, shared_path(spark, "t", "pq"), parts=8)
    assert index.codes(spark).count() == 2000 and index.codes(spark).where(F.length("code") == 8).count() == 2000
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))
    for own in (False, True):
        exact = V.knn_exact(docs, qs, 10, dim, exclude_self=own)
        assert rows(PQ.pq_search(index, qs, 10, 12, 2000, exclude_self=own)) == rows(exact)
        recall = [r["recall"] for r in V.recall_at_k(PQ.pq_search(index, qs, 10, 12, 100, exclude_self=own), exact).collect()]
        assert len(recall) == 81 and sum(recall) / len(recall) >= .95


def test_codes_of_few_and_of_no_documents(spark):
    docs = spark.createDataFrame([(f"d{i}", [float(i % 3), 1.0]) for i in range(9)], "id string, vec array<double>")
    qs = docs.select(F.col("id").alias("query_id"), "vec")
    for some in (docs, docs.limit(0)):
        ivf = V.ivf_build(some, 2, shared_path(spark, "t", "ivf"))
        index = PQ.pq_build(ivf, spark, shared_path(spark, "t", "pq"))
        got = PQ.pq_search(index, qs, 3, len(ivf.centres), 9).select("query_id", "id", "rank")
        assert sorted(got.collect()) == sorted(V.knn_exact(some, qs, 3, 2).select("query_id", "id", "rank").collect())


@pytest.mark.parametrize(("name", "queries"), [("knn_pq_recall", 500), ("related_pq_recall", 477)])
def test_registered_coded_searches_score_at_most_a_quarter(spark, name, queries):
    import __spark_entry__
    rows = __spark_entry__.queries()[name](spark, SF01).collect()
    assert len(rows) == queries and sum(r["recall"] for r in rows) / len(rows) >= .95
    assert max(r["exact_share"] for r in rows) <= .25


def test_no_limit_on_duplicates_unless_asked_for(spark):
    df = spark.range(1500).unionByName(spark.range(1500)).toDF("id")
    assert duplicate_ids(df).count() == 1500
    assert duplicate_ids(df, limit=10).count() == 10


ship_by_value(__name__)  # workers can't import tests


class FailsOn:
    """Raises for calls that hold a certain text."""

    def __init__(self, text):
        self.text, self.inner = text, HashingEmbedder(8)

    def __call__(self, texts):
        if self.text in texts:
            raise RuntimeError("embedding service unavailable")
        return self.inner(texts)


class RefusingEmbedder:
    """A model that refuses a call with a text above ``max_chars``."""

    def __init__(self, inner, max_chars):
        self.inner, self.max_chars = inner, max_chars

    def __call__(self, texts):
        if max(map(len, texts)) > self.max_chars:
            raise ValueError(f"a text is longer than {self.max_chars} characters")
        return self.inner(texts)


def test_failing_chunk_is_halved_until_the_failing_text_stands_alone(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(100)] + [(100, " ")], "id long, text string").coalesce(1)
    rows = embed_column(df, "text", 8, FailsOn("text number 5")).collect()
    assert {r["id"]: r["embed_status"] for r in rows if r["embed_status"] != "ok"} == {5: "failed", 100: "blank"}
    assert all((not any(r["embedding"])) == (r["embed_status"] != "ok") for r in rows)
    long = df.withColumn("text", F.when(F.col("id") % 10 == 0, F.repeat("text", 50)).otherwise(F.col("text")))
    status = {r["id"]: r["embed_status"] for r in embed_column(long, "text", 8, RefusingEmbedder(HashingEmbedder(8), 100)).collect()}
    assert [i for i, x in status.items() if x == "failed"] == [0, 10, 20, 30, 40, 50, 60, 70, 80, 90]
    pieces = PiecewiseEmbedder(RefusingEmbedder(HashingEmbedder(8), 100), 100)
    assert {r["embed_status"] for r in embed_column(long, "text", 8, pieces).collect()} == {"ok", "blank"}


def test_known_texts_are_not_embedded_again_and_failed_ones_are(spark):
    path = shared_path(spark, "t", "vectors")
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "d"), (5, "d")], "id long, text string")
    rows, n = EmbeddingStore(spark, path, 8, FailsOn("c")).embed(df, "text")
    assert n == 4 and sorted((r["id"], r["embed_status"]) for r in rows.collect()) == [(1, "ok"), (2, "ok"), (3, "failed"), (4, "blank"), (5, "ok"), (5, "ok")]
    rows, n = EmbeddingStore(spark, path, 8).embed(df.union(spark.createDataFrame([(6, "e")], df.schema)), "text")
    got = {r["id"]: r["embedding"] for r in rows.collect()}
    assert n == 2 and got[3] == HashingEmbedder(8)(["c"])[0].tolist() and got[1] == got[2] == HashingEmbedder(8)(["a b"])[0].tolist()
    assert EmbeddingStore(spark, path, 8).embed(df.limit(0), "text")[0].collect() == []


def test_published_state_outlives_batches_and_compactions(spark, flat):
    t = _table(spark, "published", compact_after=2)
    sync_flat(spark, flat.where("doc_id < 30"), t, 1)
    t.publish("old")
    before = _content(t)
    for k in range(2, 9):
        sync_flat(spark, batch_b(flat).where(F.col("doc_id") % 8 == k % 8), t, k)
    assert sorted((r.id, r.citationsCount) for r in t.read("old").select("id", "citationsCount").collect()) == before != _content(t)
    t.publish("old")
    assert sorted((r.id, r.citationsCount) for r in t.read("old").select("id", "citationsCount").collect()) == _content(t)
    with pytest.raises(LookupError):
        t.read("none")
    with pytest.raises(PermissionError):
        t.publish(".kibana_1")


def test_tables_are_dropped_by_name_unless_protected(spark):
    from quire.operators.table import drop_table
    path = shared_path(spark, "t", "drop")
    spark.range(3).write.parquet(path)
    with pytest.raises(PermissionError):
        drop_table(spark, path, ".OpenDistro_x")
    assert spark.read.parquet(path).count() == 3
    assert drop_table(spark, path, "papers") and not drop_table(spark, path, "papers")


def test_one_runner_at_a_time_starts_stops_and_tells_its_progress(spark, flat):
    base = shared_path(spark, "streams", "runner")
    t = PapersTable(spark, f"{base}/table")
    stats_source(flat).write.parquet(f"{base}/stats")
    crossref_source(flat).withColumn("arrived", F.lit(0)).write.parquet(f"{base}/crossref")
    make = lambda **o: SY.SyncRunner(spark, f"{base}/stats", f"{base}/crossref", t, f"{base}/ckpt", 64, arrival="arrived", **o)
    one, two = make(), make()
    assert one.start() and not two.start() and not two.stop()
    assert one.wait()
    progress, status = one.progress().collect(), one.status().first()
    assert progress and sum(p["rows"] for p in progress) == flat.count() + crossref_source(flat).count()
    assert status["batches"] == 1 and not status["running"] and status["map_s"] > 0
    assert one.stop() and two.start()
    two.wait()
    assert two.status().first()["batches"] == 1 and two.stop()  # nothing new
    steady = make(processing_time="1 second")
    assert steady.start() and steady.status().first()["running"] and steady.stop() and not steady.status().first()["running"]


def test_corrections_of_one_side_and_rows_without_the_other(spark):
    base = shared_path(spark, "streams", "sides")
    t = PapersTable(spark, f"{base}/table")
    flat = flat_sources(spark, read_table(spark, SF001, "documents")).where("doc_id between 20 and 29")
    for k, (stats, cross) in enumerate([(flat.where("doc_id < 23"), flat.where("doc_id > 25")), (flat.where("doc_id > 25"), flat.where("doc_id < 23")),
                                        (None, flat.where("doc_id = 21").withColumn("citations_raw", F.lit(999)))]):
        if stats is not None:
            stats_source(stats).write.mode("append").parquet(f"{base}/stats")
        crossref_source(cross).withColumn("arrived", F.lit(k)).write.mode("append").parquet(f"{base}/crossref")
        _run_stream(spark, base, t)
    want = _table(spark, "sides_whole")
    both = flat.where("doc_id < 23 OR doc_id > 25").withColumn("citations_raw", F.when(F.col("doc_id") == 21, 999).otherwise(F.col("citations_raw")))
    sync_flat(spark, both, want, 1)
    assert _content(t) == _content(want) and 999 in [c for _, c in _content(t)]


def test_sketches_of_batches_estimate_the_whole(spark):
    from quire.operators.quality import profile_of_sketches, profile_sketch, table_profile
    df = spark.range(60_000).selectExpr("id", "id % 777 AS few", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('text ', id % 30000) END AS text", "array(id % 50) AS list")
    whole = {r["column_name"]: r for r in table_profile(df, exact=True).collect()}
    parts = profile_sketch(df.where("id < 20000")).unionByName(profile_sketch(df.where("id >= 15000")))
    for r in profile_of_sketches(parts).collect():
        exact = whole[r["column_name"]]
        assert abs(r["distinct_count"] - exact["distinct_count"]) <= .05 * exact["distinct_count"]
        assert r["row_count"] == 65_000
    assert profile_of_sketches(profile_sketch(df.limit(0))).first()["row_count"] == 0


def test_distribution_over_files_and_partitions(spark):
    from quire.operators.quality import file_distribution, partition_distribution
    path = shared_path(spark, "t", "files")
    spark.range(1000).selectExpr("id", "CASE WHEN id < 700 THEN 'a' ELSE 'b' END AS p").repartition(1).write.partitionBy("p").parquet(path)
    spark.range(500).selectExpr("id", "'b' AS p").repartition(1).write.mode("append").partitionBy("p").parquet(path)
    files = file_distribution(spark.read.parquet(path), "p").collect()
    assert sorted((r["partition"], r["n_rows"], r["skew"]) for r in files) == [("a", 700, 1.4), ("b", 300, .6), ("b", 500, 1.0)]
    assert all(r["n_bytes"] > 0 and r["file"].endswith(".parquet") for r in files)
    parts = partition_distribution(spark.read.parquet(path), "p").collect()
    assert sorted((r["partition"], r["n_files"], r["n_rows"]) for r in parts) == [("a", 1, 700), ("b", 2, 800)]


def test_lookup_takes_the_same_row_of_a_repeated_key_whatever_the_order(spark):
    from quire.sources.scan import point_lookup
    rows = [("a", i) for i in range(50)] + [("b", 1)]
    keys = spark.createDataFrame([("a",), ("c",)], "_id string")
    found = {tuple(map(tuple, point_lookup(spark.createDataFrame(x, "_id string, n int").repartition(p), keys).orderBy("_id").collect()))
             for x in (rows, rows[::-1]) for p in (1, 7)}
    assert len(found) == 1 and [r[0] for r in found.pop()] == ["a", "c"]


def test_long_texts_are_embedded_in_pieces():
    seen = []

    def inner(texts):
        seen.extend(texts)
        return HashingEmbedder(8)(texts)
    out = PiecewiseEmbedder(inner, 10)(["a b c d e f g h i j k", "short", ""])
    assert max(map(len, seen)) <= 10 and "".join(seen) == "a b c d e f g h i j kshort"
    assert out.shape == (3, 8) and abs(np.linalg.norm(out[0]) - 1) < 1e-6


def test_queries_meet_a_block_of_codes_once_and_in_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(f"d{i:04d}", v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))], "id string, vec array<double>")
    qs = docs.select(F.col("id").alias("query_id"), "vec")
    ivf = V.ivf_build(docs, 8, shared_path(spark, "t", "ivf"), n_cells=30)
    monkeypatch.setattr(V, "QUERY_BLOCK", 100)
    places = V.blocks_of(ivf.cells(spark), 150)
    assert len({f for f, _ in places.values()}) <= 8  # not a block per cell
    d, q = V.dealt(ivf.cells(spark), qs, V._probes(qs, "query_id", ivf.centres, 30, places), places)
    groups = q.groupBy("block", "qb").count().collect()
    assert max(r["count"] for r in groups) < 200 and d.groupBy("block", "qb").count().agg(F.max("count")).first()[0] <= 200
    assert q.count() == 600 * len({r["block"] for r in groups})
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(V, "DOC_BLOCK", 40)
    assert rows(V.ivf_search(ivf, qs, 5, nprobe=30)) == rows(V.knn_exact(docs, qs, 5, 8))
    few = V.ivf_search(ivf, qs, 5, nprobe=4)
    assert .5 < few.join(V.knn_exact(docs, qs, 5, 8), ["query_id", "id"]).count() / 3000 < 1


def test_postings_are_computed_stored_and_extended_where_their_document_is(spark):
    from quire.operators.index import build_index, by_document, number_documents
    from quire.plans.catalog_search import with_english
    p = papers(spark, SF001)
    dealt, buckets = by_document(number_documents(p))
    plan = _plan(build_index(dealt, buckets=buckets).postings)
    assert plan.count("Exchange hashpartitioning(doc") == 1 == plan.count("Exchange hashpartitioning")  # texts move once, postings never
    idx, plain = paper_index(p), with_english(build_index(p, extra={"authors": F.transform("authors", lambda a: a["name"])}))
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(idx.postings, "field", "term", "id", "tf", "dl") == rows(plain.postings, "field", "term", "id", "tf", "dl") != []
    assert rows(idx.term_stats, "field", "term", "df") == rows(plain.term_stats, "field", "term", "df")
    assert rows(idx.english, "term", "eterm") == rows(plain.english, "term", "eterm")
    stats = lambda i: {(r["field"], r["n_docs"], round(r["avgdl"], 9)) for r in i.field_stats.collect()}
    assert stats(idx) == stats(plain)
