"""What is moved, written and computed once: batches, epochs, embeddings, cleaning."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from quire.functions.embed import EmbeddingStore, HashingEmbedder
from quire.functions.text import clean_text
from quire.operators.mapping import join_sources
from quire.operators.table import PapersTable
from quire.session import shared_path
from quire.sources.fixtures import crossref_source, flat_sources, read_table, stats_source
from quire.sources.scan import newest_per_key, one_per_key
from quire.streaming import sync as SY


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def flat(spark):
    return flat_sources(spark, read_table(spark, SF001, "documents"))


def test_one_per_key_is_the_newest_and_moves_rows_of_repeated_keys_only(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "x"), (None, 1, "x"), (None, 3, "y"), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, n int, t string")
    for order in (None, ["n"]):
        assert sorted(map(str, one_per_key(df, "id", order).collect())) == sorted(map(str, newest_per_key(df, ["id"], order).collect()))
    alone = df.where("id <> 'a'")
    assert one_per_key(alone, "id") is alone


def test_sources_are_shuffled_once_for_dedupe_and_join(spark, flat, monkeypatch):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _plan(join_sources(stats_source(flat), crossref_source(flat))).count("Exchange hashpartitioning") == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_an_epoch_is_mapped_without_a_join_and_written_once(spark, flat, monkeypatch):
    written, cut = [], SY.cut_lineage
    monkeypatch.setattr(SY, "cut_lineage", lambda df, name: written.append((df.columns, _plan(df))) or cut(df, name))
    base = shared_path(spark, "t", "epoch")
    stats_source(flat).write.parquet(f"{base}/stats")
    crossref_source(flat).write.parquet(f"{base}/crossref")
    changed = SY.last_rows(spark.read.parquet(f"{base}/stats"), spark.read.parquet(f"{base}/crossref"))
    nameless = changed.limit(1).withColumn("_id", F.lit(None).cast("string")).withColumn("stats", F.col("stats").withField("_id", F.lit(None).cast("string")))
    one, other = PapersTable(spark, f"{base}/one"), PapersTable(spark, f"{base}/other")
    got = SY.sync_epoch(spark, changed.unionByName(nameless), one, 1, 8)
    assert len(written) == 1 and "contextualContent" not in written[0][0] and "Join" not in written[0][1]
    want = SY.sync(spark, stats_source(flat), crossref_source(flat), other, 1, 8)
    assert got["retrieved"] == want["retrieved"] + 1 and got["created"] == want["created"]
    assert one.rejects().where("id IS NULL").first()["reason"] == "no_crossref"
    assert one.read().exceptAll(other.read()).isEmpty() and other.read().exceptAll(one.read()).isEmpty()
    assert not SY.sync_epoch(spark, changed.limit(0), one, 2, 8)["applied"]


def test_known_texts_are_neither_moved_nor_stored_again(spark):
    path = shared_path(spark, "t", "store")
    store = EmbeddingStore(spark, path, 8, HashingEmbedder(8))
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "id int, t string")
    assert [store.embed(df, "t")[1] for _ in range(2)] == [3, 0]
    assert len(glob.glob(f"{path}/batch=*")) == 1
    assert store.embed(df, "t")[0].where("embedding IS NULL").isEmpty()


def test_hashed_tokens_are_remembered_and_give_the_same_vectors():
    import zlib
    vector = HashingEmbedder(16)(["one two one", "", "Three"])[0]
    want = np.zeros(16, np.float32)
    for token in ("one", "two", "one"):
        h = zlib.crc32(token.encode())
        want[h % 16] += 1.0 if (h >> 31) & 1 else -1.0
    assert np.array_equal(vector, want / np.linalg.norm(want))


def test_cleaning_computes_its_steps_once(spark):
    df = spark.createDataFrame([("<jats:p>a &amp; b</jats:p>",), (None,)], "t string")
    assert _plan(df.select(clean_text("t").alias("c"))).count("jats:") == 1


@pytest.mark.parametrize("exclude_self", [False, True])
def test_best_of_a_block_are_found_by_groups_as_by_all_scores(exclude_self, monkeypatch):
    import pandas as pd
    from quire.operators import vector as V
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(3000, 6))
    vectors[100:700] = vectors[0]  # ties
    vectors[2000, 2] = np.nan
    ids = [f"p{i % 2900:05d}" for i in range(2999)] + [None]
    docs = pd.DataFrame({"id": ids, "vec": list(vectors)})
    asked = docs.iloc[rnd.permutation(3000)[:300]].rename(columns={"id": "query_id"})
    asked.iloc[0, 1] = vectors[2000]
    got = V._block_topk(7, exclude_self)(docs, asked)
    monkeypatch.setattr(V, "LEADER_GROUP", 10_000)  # rows too short: all scores are compared
    want = V._block_topk(7, exclude_self)(docs, asked)
    of = lambda x: sorted(map(str, x.itertuples(index=False)))
    assert of(got) == of(want) and len(got) == 300 * 7


def test_english_postings_are_made_where_their_document_is(spark):
    from quire.functions.english import english_postings
    from quire.plans.catalog_search import paper_index, papers
    idx = paper_index(papers(spark, SF001))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(english_postings(idx.postings))
        assert "Exchange" not in plan and "Join" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_papers_neither_store_nor_move_the_text_that_repeats_others(spark):
    from quire.operators.index import by_document, number_documents
    from quire.operators.mapping import CONTENT_COLUMNS, contextual_content
    from quire.plans.common import papers, papers_and_rejects
    from quire.schema import PAPER_COLUMNS
    p = papers(spark, SF001)
    assert "contextualContent" not in spark.read.parquet(p._snapshot_key[-1]).columns and p.columns == PAPER_COLUMNS
    assert papers_and_rejects(spark, SF001)[0].select("id", "contextualContent").exceptAll(p.select("id", "contextualContent")).isEmpty()
    dealt, _ = by_document(number_documents(p), derived={"contextualContent": contextual_content(*map(F.col, CONTENT_COLUMNS))})
    plan = _plan(dealt.select("doc", "contextualContent"))
    assert "concat_ws" in plan[:plan.index("Exchange")] and "concat_ws" not in plan[plan.index("Exchange"):]


def test_a_content_that_is_not_its_parts_is_analysed_itself(spark):
    from quire.operators.index import build_index
    rows = [("a", "One two", "two. THREE", "", "One two two. THREE", "J x"),  # its parts
            ("b", "One two", "two", "one", "other words, other", None),
            ("c", None, "  ", None, "", "J"), ("d", "x", "ΟΔΟΣ", "y", None, ""), ("e", "ΟΔΟΣ", "x", " ", "ΟΔΟΣ x", "")]
    names = ("title", "abstract", "openSummary", "contextualContent", "journal")
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} string" for n in names))
    want = []
    for n in names:
        from quire.functions.text import tokens
        for r in df.select("id", tokens(n).alias("t")).collect():
            want += [(n, t, r["id"], r["t"].count(t), len(r["t"])) for t in set(r["t"])]
    idx = build_index(df)
    got = [tuple(r) for r in idx.postings.select("field", "term", "id", "tf", "dl").collect()]
    assert sorted(got) == sorted(want)


def test_a_stage_leaves_no_shuffle_files(spark):
    import time
    from quire.session import cut_lineage
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in map(str, disk.getAllFiles().toList().mkString("\n").split("\n")) if "/shuffle_" in f}
    before, until = files(), time.time() + 20
    out = cut_lineage(spark.range(1000).repartition(7, "id"), "t")
    while files() - before and time.time() < until:
        time.sleep(.5)
    assert not files() - before and out.count() == 1000


def test_merged_profile_has_every_column(spark):
    from quire.plans.catalog import registry
    from quire.schema import PAPER_COLUMNS
    found = {r["column_name"]: r for r in registry()["profile_merged"](spark, SF001).collect()}
    assert set(found) == set(PAPER_COLUMNS) and all(r["near"] for r in found.values())
    vectors = registry()["table_profile"](spark, SF001).where("column_name = 'embeddingVector'").first()
    assert found["embeddingVector"]["null_count"] == vectors["null_count"]
