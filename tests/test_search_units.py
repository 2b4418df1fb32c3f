"""Fuzzy distance, vector validity and highlighting helpers."""

from pyspark.sql import functions as F

from quire.functions.fuzzy import damerau_levenshtein, fuzzy_candidates
from quire.operators.highlight import fragments
from quire.operators.vector import valid_vector


def test_damerau_levenshtein():
    assert damerau_levenshtein("abcdef", "abdcef") == 1
    assert damerau_levenshtein("cat", "cut") == 1
    assert damerau_levenshtein("ca", "abc") == 2
    assert damerau_levenshtein("", "abc") == 3


def test_fuzzy_auto(spark):
    vocab = spark.createDataFrame([("abdcef",), ("cut",), ("ac",), ("abcdefgh",)], "term string")
    q = spark.createDataFrame([("abcdef",), ("cat",), ("ab",)], "qterm string")
    got = {(r.qterm, r.term, r.distance) for r in fuzzy_candidates(q, vocab).collect()}
    # 'ab' has length 2: no edits allowed, so 'ac' is not a match
    assert got == {("abcdef", "abdcef", 1), ("cat", "cut", 1), ("abcdef", "abcdefgh", 2)}


def test_invalid_vectors_never_match(spark):
    rows = [([0.0] * 64,), (None,), ([1.0] * 63,), ([1.0] * 64,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(valid_vector(F.col("v"), 64)).collect()]
    assert got == [False, False, False, True]


def test_fragments_mark_whole_tokens():
    out = fragments("alpha beta gamma alphabet beta", {"beta", "alpha"}, 12, 1)
    assert out == ["<mark>alpha</mark> <mark>beta</mark>"]


def test_variants_are_made_of_near_lengths_only_and_lose_no_pair(spark):
    from quire.functions.fuzzy import damerau_levenshtein, fuzzy_candidates, reached_lengths, vocabulary_variants
    terms = ["a", "an", "ab", "cab", "abc", "abcd", "acbd", "aabbcc", "abcabc", "bacabc", "abcdefg", "abcdefgh", "x" * 300, "y" * 301]
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    asked = ["ab", "abd", "abcab", "abcbac", "abcdegf"]
    q = spark.createDataFrame([(t,) for t in asked], "qterm string")
    k = lambda t: 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
    near = sorted((a, b, damerau_levenshtein(a, b)) for a in asked for b in terms if damerau_levenshtein(a, b) <= k(a))
    assert sorted(map(tuple, fuzzy_candidates(q, vocab).select("qterm", "term", "distance").collect())) == near
    lengths = reached_lengths(q.selectExpr("qterm", "CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END AS k"))
    made = vocabulary_variants(vocab, lengths)
    assert made.where("length(term) > 9").count() == 0  # 300 letters would be 45,151 rows
    assert {(r["variant"], r["dv"]) for r in vocabulary_variants(vocab.where("term = 'abcd'")).collect()} == {
        ("abcd", 0), ("bcd", 1), ("acd", 1), ("abd", 1), ("abc", 1), ("cd", 2), ("bd", 2), ("bc", 2), ("ad", 2), ("ac", 2), ("ab", 2)}


def test_a_term_of_many_requests_meets_its_postings_once(spark):
    from quire.operators import search as S
    from quire.operators.index import build_index
    rows = [(f"d{i}", "common word") for i in range(50)]
    p = spark.createDataFrame([(i, t, t, "", t, "") for i, t in rows], "id string, title string, abstract string, openSummary string, contextualContent string, journal string")
    idx, spec = build_index(p), S.TextQuery({"abstract": 1.0}, fuzzy=True)
    req = spark.createDataFrame([(q, "common") for q in range(40)], "query_id long, query string")
    parts = S._parts(idx, S.scored_parts(req, idx, spec)[0], None, True)
    assert parts.count() == 50  # not 40 x 50
    assert S.score_requests(req, idx, spec).count() == 40 * 50
