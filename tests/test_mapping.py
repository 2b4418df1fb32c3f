"""Date, author and topic mapping rules, and the reject split."""

from pyspark.sql import functions as F

from quire.operators.listing import topic_sort_key
from quire.operators.mapping import date_parts, map_authors, published_at
from quire.operators.requests import normalize_requests, page_bounds, pick_sort, split_topics


def test_dates(spark):
    rows = [(2020, None, 15), (2020, None, None), (None, 5, 5), (2020, 13, 1)]
    df = spark.createDataFrame(rows, "y int, m int, d int")
    out = df.select(published_at(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("p"),
                    date_parts(F.col("y"), F.col("m"), F.col("d")).alias("parts")).collect()
    assert [r.p for r in out] == ["2020-01-15", "2020-01-01", "0001-01-01", None]
    assert [r.parts for r in out] == [[2020, 15], [2020], [], [2020, 13, 1]]


def test_authors(spark):
    df = spark.createDataFrame([([("", "Li", None, "first"), ("", "", "x", "additional"), (" Ann", "Lee ", None, None)],)],
                               "a array<struct<given:string,family:string,ORCID:string,sequence:string>>")
    got = df.select(map_authors(F.col("a")).alias("o")).first().o
    assert [(x.name, x.ORCID, x.sequence) for x in got] == [("Li", "", "first"), ("Ann Lee", "", "")]


def test_topic_sort_first_match_wins(spark):
    topics = [("t", 0.1, 2.0, 5.0, 1.0), ("t", 0.9, 9.0, 9.0, 9.0), ("u", 0.3, None, None, None)]
    df = spark.createDataFrame([(topics,)], "topics array<struct<name:string,relevanceScore:double,topScore:double,"
                                            "hotScore:double,hotScore6m:double>>")
    r = df.select(topic_sort_key("t", "hot").alias("a"), topic_sort_key("u", "hot").alias("b"),
                  topic_sort_key("zz", "top").alias("c")).first()
    assert (r.a, r.b, r.c) == (5.0, 0.0, 0.0)


def test_split_topics_untrimmed(spark):
    df = spark.createDataFrame([("a, b",), (",,",)], "t string")
    got = [r[0] for r in df.select(split_topics(F.col("t"))).collect()]
    assert got == [["a", " b"], []]


def test_request_normalisation(spark):
    assert page_bounds(0, 101) == (0, 10)
    assert page_bounds(2, 100) == (100, 100)
    assert page_bounds(3, 0) == (20, 10)
    assert pick_sort("HOT", "list") == "hot" and pick_sort("zzz", "list") == "latest"
    req = spark.createDataFrame([(1, "  ", 0, 101, "HOT"), (2, "q", 600, 100, "zzz")],
                                "query_id long, query string, page int, per_page int, sort string")
    out = {r.query_id: r for r in normalize_requests(req, "semantic").collect()}
    assert out[1].rejected_reason == "blank_query" and out[1].per_page == 10 and out[1].page == 1
    assert out[2].rejected_reason == "result_window_too_large" and out[2].sort == "latest"
