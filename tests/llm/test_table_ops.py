"""Sharding, mixing, classifier, URLs, embeddings and WARC: laws, brute force, odd rows."""

import base64
import hashlib
import io
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import embeddings, quality, sharding, warc
from quire.llm.common import apply_llm_conf, shared_path, word_count
from quire.llm.components import connected_components
from quire.llm.mixing import mix_sources, mixed_copies, source_targets
from quire.llm.urls import judge_urls

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def conf(spark):
    apply_llm_conf(spark)


# ---- components -----------------------------------------------------------------------

def test_components_of_a_chain_a_star_and_noise(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(5, k) for k in range(50, 90)]
    edges = chain + star + [(7, 7), (None, 3), (8, 9), (9, 8), (8, 9)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 5 for k in [5, *range(50, 90)]}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- sharding -------------------------------------------------------------------------

def check_shards(rows, sizes, shards):
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    own = {}
    for r in rows:
        own.setdefault(r["shard"], []).append(r)
    assert set(own) <= set(range(shards))
    for part in own.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return [sum(r["size"] for r in own.get(s, [])) for s in range(shards)]


def test_shards_are_near_equal_though_one_text_has_most_rows(spark):
    rng = random.Random(1)
    rows = [(i, "the very same text " * 5 if i % 2 else "w" * rng.randrange(1, 400)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.shard_by_bytes(df, shards=16).collect()
    loads = check_shards(placed, [len(t) + 1 for _, t in rows], 16)
    assert max(loads) - min(loads) < 0.03 * sum(loads) / 16
    assert {(r["id"], r["text_crc32"]) for r in placed} == {(i, zlib.crc32(t.encode())) for i, t in rows}
    again = sharding.shard_by_bytes(df.repartition(5), shards=16).collect()
    assert sorted(placed) == sorted(again)


def test_copies_stay_together_unless_they_are_many(spark):
    rng = random.Random(2)
    rows = [(i, f"text number {rng.randrange(900)} " * 3) for i in range(3000)]
    placed = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    homes = {}
    for r in placed:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_placement_equals_a_plain_one_and_small_groups_beside_a_hot_text_stay_whole(spark):
    rng = random.Random(3)
    rows = [(i, "hot text " * 30 if i % 3 == 0 else f"text {rng.randrange(700)} " * 4 if i % 3 == 1 else "w" * rng.randrange(400)) for i in range(9000)]
    rows += [(20_000 + i, "second hot text " * 20) for i in range(1500)] + [(None, "t"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["id"]), r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df.repartition(7), shards=16).collect())
    keyed = sorted((xxhash.xxh64_intdigest((t or "").encode(), 42), -(2**63) if i is None else i, len((t or "").encode()) + 1, i, t or "") for i, t in rows)
    keyed.sort(key=lambda r: (r[0] - (1 << 64) if r[0] >> 63 else r[0], *r[1:3]))
    share, before, groups = sum(r[2] for r in keyed) / 16, 0, {}
    for r in keyed:
        groups.setdefault(r[0], [before, 0])[1] += r[2]
        before += r[2]
    want, before, slots = [], 0, {}
    for h, _, size, i, t in keyed:
        start, whole = groups[h]
        middle = start + whole / 2 if whole <= .02 * share else before + size / 2
        shard = min(int(middle // share), 15)
        want.append((str(i), zlib.crc32(t.encode()), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    assert got == sorted(want)


def test_shards_of_odd_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (None, "", 0), (3, "é" * 10, 0), (4, "z" * 100_000, 0), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    check_shards(sharding.shard_by_bytes(df, shards=4).collect(), [1, 1, 1, 21, 100_001, 1], 4)
    assert sharding.shard_by_bytes(df.limit(0)).collect() == []


def test_range_numbers_count_splitters_at_or_below():
    rng = np.random.default_rng(0)
    split = np.unique(np.array([(h, t) for h, t in zip(rng.integers(0, 5, 12), rng.integers(0, 9, 12), strict=True)], [("h", int), ("t", int)]))
    h, t = rng.integers(-1, 6, 300), rng.integers(-1, 10, 300)
    want = [sum((a, b) <= (x, y) for a, b in split.tolist()) for x, y in zip(h, t, strict=True)]
    assert sharding.range_numbers(h, t, split["h"], split["t"]).tolist() == want


# ---- mixing ---------------------------------------------------------------------------

def naive_targets(sizes, weights=(5, 2, 1), times=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(times * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > times * sizes[s]}
        if not over:
            return {s: times * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        source = rng.choice(["hot"] * 6 + ["b", "a", "é", "z", None])
        rows.append((i, source, None if i % 97 == 0 else "w " * rng.randrange(0, 60), 1))
    rows += [(9001, "tiny", "just five words in all", 1), (9002, "none", "", 1), (9001, "tiny", "just five words in all", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int").repartition(7)
    mixed = mix_sources(df, "doc_id", "source", word_count(F.col("text"))).collect()
    sizes, taken = {}, {}
    for r in mixed:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix"]["taken"]
        assert 0 <= r["mix"]["taken"] <= 3 * r["size"]
    targets = naive_targets(sizes)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 2, s
    assert all(math.isclose(r["mix"]["target"], targets[r["source"]], rel_tol=1e-12) for r in mixed)
    assert len(mixed) == len(rows)
    again = mix_sources(df.repartition(3), "doc_id", "source", word_count(F.col("text"))).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_targets_of_many_sources_equal_plain_ones(spark):
    rng = random.Random(5)
    sizes = {None if k == 0 else f"s{k:04d}": rng.choice([0, 0, 1, 5, 100, 10_000, 1_000_000]) for k in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in source_targets(df, (5, 2, 1), 3).collect()}
    want = naive_targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert all(math.isclose(got[s][1], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def test_better_documents_are_preferred(spark):
    rows = [(i, "big" if i < 2000 else "a-small", "w w w w w") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    ratings = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1).alias("weight"))
    mixed = mix_sources(df, "doc_id", "source", word_count(F.col("text")), ratings=ratings).collect()
    good = sum(r["mix"]["taken"] for r in mixed if r["source"] == "big" and r["id"] % 2 == 0)
    poor = sum(r["mix"]["taken"] for r in mixed if r["source"] == "big" and r["id"] % 2 == 1)
    assert good > 2 * poor


def test_mixed_copies_keep_rows_whole(spark):
    rows = [(i, f"s{i % 3}", f"t{i} " * (i % 50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, __copy int")
    out = mixed_copies(df, "doc_id", "source", word_count(F.col("text")))
    assert out.columns == df.columns
    assert set(map(tuple, out.collect())) <= set(rows)
    assert mixed_copies(df.limit(0), "doc_id", "source", word_count(F.col("text"))).collect() == []


# ---- quality --------------------------------------------------------------------------

def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    n, dim = 400, 16
    feature, row = rng.integers(0, dim, 5 * n), np.repeat(np.arange(n), 5)
    value = np.ones(5 * n) / 5
    grade = np.digitize(np.bincount(row, weights=(feature < 8) * 1.0, minlength=n), [2, 4])
    model = quality.fit_ordinal(row, feature, value, grade, grades=3, dim=dim)
    tails = model.tails(np.bincount(row, weights=value * model.weights[feature], minlength=n))
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= .5).sum(axis=1) == grade).mean() > .9


def test_fitted_model_is_the_optimum_of_a_plain_likelihood():
    rng = np.random.default_rng(1)
    n, dim, ridge = 300, 6, 1e-2
    feature, row, value = rng.integers(0, dim, 4 * n), np.repeat(np.arange(n), 4), rng.uniform(.1, 1, 4 * n)
    grade = rng.integers(0, 4, n)
    model = quality.fit_ordinal(row, feature, value, grade, grades=4, dim=dim, ridge=ridge)

    def loss(weights, thresholds):
        total = 0.0
        for i in range(n):
            score = sum(value[j] * weights[feature[j]] for j in range(4 * i, 4 * i + 4))
            tails = [1.0, *(1 / (1 + math.exp(t - score)) for t in thresholds), 0.0]
            total -= math.log(tails[grade[i]] - tails[grade[i] + 1])
        return total / n + ridge / 2 * sum(w * w for w in weights)

    step = 1e-4
    for at in range(dim + 3):  # central differences vanish at the optimum
        up, down = np.r_[model.weights, model.thresholds], np.r_[model.weights, model.thresholds]
        up[at] += step
        down[at] -= step
        assert abs(loss(up[:dim], up[dim:]) - loss(down[:dim], down[dim:])) / (2 * step) < 1e-3


def test_shape_of_a_word_is_that_of_all_of_it():
    assert quality.word_shape("a" * 100 + "7" * 100 + "-Ab") == "a0-Aa"


def test_one_grade_or_none_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "")], "doc_id long, text string")
    for labels in ([], [(1, 1, 0)], [(7, 0, 0)], [(None, 1, 0), (1, None, None)]):
        rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rows = quality.classify_quality(docs, rated).collect()
        assert len(rows) == 4 and all(r["quality_score"]["keep"] for r in rows)
    assert quality.classify_quality(docs.limit(0), rated).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = quality.classify_quality(docs, train).select("doc_id", F.col("quality_score.keep").alias("keep"))
    found = {(r["quality"], r["keep"]): r["count"] for r in scored.join(test, "doc_id").groupBy("quality", "keep").count().collect()}
    poor, good = found.get((0, False), 0), found.get((1, True), 0)
    assert poor / (poor + found.get((0, True), 0)) > .97
    assert good / (good + found.get((1, False), 0)) > .995


# ---- URLs -----------------------------------------------------------------------------

def test_rules_and_odd_urls(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "http://example.net/de/1", "http://net/", "http://net", "http://x.net?q", None, "no scheme/net/",
            "http://badexample.net/en/1", "https://example.com/de/5", "https://sub.example.com/fr/5", "http://a.org/fr/", "http://a.org/fr", "://",
            "http://example.net:80/en/", "http://ÄB.net/x"]
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x"), (None, urls[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = judge_urls(df, "page_id", "url", spark.createDataFrame(rules, "rule string, action string"), F.lit(None))
    assert out.count() == len(rows)
    got = {r["id"]: r for r in out.collect()}
    want = {0: "example.net/en/", 1: "net/", 2: "net/", 3: None, 4: None, 5: None, 6: None, 7: "net/", 8: "example.com/de/", 9: None,
            10: "org/fr/", 11: None, 12: None, 13: None, 14: "net/"}
    assert {k: got[k]["rule"] for k in want} == want
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("a.example.net", "/en/1", "allow")
    assert (got[14]["host"], got[13]["host"], got[3]["path"]) == ("Äb.net", "example.net:80", "")
    assert (got[5]["host"], got[5]["path"], got[6]["host"], got[12]["host"]) == ("", "", "", "")
    assert {got[k]["verdict"] for k in (3, 5, 6)} == {"allow"}
    none = judge_urls(df.limit(0), "page_id", "url", spark.createDataFrame(rules, "rule string, action string"), F.lit(None))
    assert none.collect() == []


def test_poor_branches_get_a_template_and_are_rejected(spark):
    rng = random.Random(0)
    rows = []
    for i in range(900):
        part = rng.choice(["news", "blog", "spam"])
        rows.append((i, f"http://h.org/{part}/{rng.choice('abcdefghij')}{i}/{i}.html", None if i % 3 == 0 else part != "spam"))
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    rules = spark.createDataFrame([], "rule string, action string")
    out = {r["id"]: r for r in judge_urls(df, "page_id", "url", rules, F.col("good")).collect()}
    assert {r["template"] for r in out.values()} == {"/spam/*/*", "/*/*/*"} or {r["template"] for r in out.values()} == {
        "/spam/*/*", "/news/*/*", "/blog/*/*"}
    assert all(out[i]["verdict"] == ("block" if "/spam/" in url else "allow") for i, url, _ in rows)


def test_branches_below_the_fourth_segment_get_their_own_verdict(spark):
    rows = [(i, f"http://h.org/2024/05/07/a/{part}/b/c/d/{'xyz'[i % 3]}{i}", None if i % 4 == 0 else part == "news")
            for i, part in enumerate(["news", "casino"] * 100)]
    rows += [(1000 + i, f"http://h.org/2024/05/07/a/{'n/' * 30}{i}", True) for i in range(20)] + [(2000, "http://h.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    rules = spark.createDataFrame([], "rule string, action string")
    out = {r["id"]: r for r in judge_urls(df, "page_id", "url", rules, F.col("good")).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["verdict"] == ("block" if "casino" in url else "allow") for i, url, _ in rows if i < 2000)
    assert out[1]["template"] == "/*/*/*/*/casino/*/*/*/*" and out[2000]["template"] == ""
    assert all(r["template"].count("/") == sum(p != "" for p in r["path"].split("/")) for r in out.values())


# ---- embeddings -----------------------------------------------------------------------

def naive_links(vectors, threshold=0.9):
    unit = {}
    for k, v in enumerate(vectors):
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            w = np.array(v, float)
            unit[k] = w / np.linalg.norm(w)
    return {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold}


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    vectors = [base, base * 3, base + .01, -base, None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0], [2.0], [], base,
               [float("inf")] + [0.0] * 15, base * 1e-30, rng.standard_normal(16)]
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for k, v in enumerate(vectors)]
    rows += [(None, rows[0][1], 0), (2, rows[2][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = embeddings.embedding_near_duplicates(df).collect()
    assert len(got) == len(rows)
    links = naive_links([r[1] for r in rows])
    degree = [sum(a == k for a, _ in links) for k in range(len(rows))]
    assert sorted((str(r["id"]), r["n_links"]) for r in got) == sorted((str(r[0]), degree[k]) for k, r in enumerate(rows))
    by_id = {r["id"]: r for r in got}
    assert all(by_id[k]["component_id"] == 0 for k in (0, 1, 2, 11, 13, None))
    assert by_id[9]["component_id"] == 8 and by_id[4]["kept"] and not by_id[None]["kept"]
    assert embeddings.embedding_near_duplicates(df.limit(0)).collect() == []


def test_recall_close_to_the_threshold_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 64)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(.85, .97, (1500, 1))
    hot = x[0] + .02 * rng.standard_normal((400, 64))
    vectors = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * z, hot]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(8)
    got = {r["id"]: r for r in embeddings.embedding_near_duplicates(df).collect()}
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= .9
    np.fill_diagonal(near, False)
    true = near.sum(1)
    found = np.array([got[k]["n_links"] for k in range(len(vectors))])
    assert (found <= true).all()
    assert found.sum() / true.sum() > .99
    alone = true <= 2  # the pairs near the threshold, without the hot group
    assert found[alone].sum() / true[alone].sum() > .97


def test_recall_in_a_group_of_near_copies_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    n, of = 60_000, 20_000
    vectors = rng.standard_normal((n, 64)).astype(np.float32)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    vectors[:of] = base + .034 * rng.standard_normal((of, 64))  # cosine of about 0.93 to each other
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(vectors.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": lists})).repartition(8)
    got = np.zeros(n, np.int64)
    for r in embeddings.embedding_near_duplicates(df).collect():
        got[r["id"]] = r["n_links"]
    unit = vectors[:of].astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = np.concatenate([(unit[k:k + 1000] @ unit.T >= .9).sum(1) - 1 for k in range(0, of, 1000)])
    assert true.mean() > of / 2
    assert (got[:of] <= true).all() and got[:of].sum() / true.sum() > .999


def test_centres_that_stay_are_apart_and_cover_the_others():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((1500, 16)), rng.standard_normal(16) + .1 * rng.standard_normal((1500, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(3000)].astype(np.float32)
    kept = embeddings.spread_out(x, .62)
    cosines = x @ x[kept].T
    assert (cosines[kept] >= .62).sum() == len(kept) and (cosines >= .62).any(axis=1).all()


def common_direction(rng, n, dim, mean_cosine):
    x = rng.standard_normal((n, dim))
    x *= np.sqrt(1 - mean_cosine) / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += np.sqrt(mean_cosine)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(("dim", "mean_cosine"), [(64, 0.0), (128, 0.5), (128, 0.7), (128, 0.8)])
def test_cells_hold_on_vectors_with_a_common_direction(dim, mean_cosine):
    rng = np.random.default_rng(6)
    x = common_direction(rng, 100_000, dim, mean_cosine)
    centres = embeddings.thinned(x[:781], .9)
    assert len(centres) > 390
    probes = embeddings.probes_needed(centres, .9, 42)
    cells = embeddings.nearest_cells(x, *embeddings.centred(centres), probes)
    assert np.bincount(cells.ravel()).max() < .05 * len(x)
    # pairs at the threshold meet, though no centre was drawn for them
    u = x[-4000:].astype(float)
    z = rng.standard_normal(u.shape)
    z -= (z * u).sum(1, keepdims=True) * u
    v = .9 * u + np.sqrt(.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    other = embeddings.nearest_cells(v.astype(np.float32), *embeddings.centred(centres), probes)
    assert (cells[-4000:, :, None] == other[:, None, :]).any(axis=(1, 2)).mean() > .95


def test_links_of_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(7)
    x = common_direction(rng, 6000, 64, .7)
    z = rng.standard_normal((1000, 64))
    z -= (z * x[:1000]).sum(1, keepdims=True) * x[:1000]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(.9, .97, (1000, 1))
    vectors = np.concatenate([x, cos * x[:1000] + np.sqrt(1 - cos**2) * z]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(8)
    found = np.zeros(len(vectors), int)
    for r in embeddings.embedding_near_duplicates(df).collect():
        found[r["id"]] = r["n_links"]
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= .9).sum(1) - 1
    assert (found <= true).all() and found.sum() / true.sum() > .97


def test_probes_of_few_centres():
    one = np.eye(1, 8, dtype=np.float32)
    assert len(embeddings.thinned(np.repeat(one, 5, axis=0), .9)) == 1
    assert embeddings.probes_needed(one, .9, 1) == embeddings.PROBES
    assert embeddings.probes_needed(np.eye(3, 8, dtype=np.float32), .9, 1) == embeddings.PROBES


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    errors, outside = [], 0
    for seed in range(10):
        rotated = v.astype(np.float32) @ embeddings.rotation(64, seed).T
        code, factor = embeddings.encode(rotated)
        estimate = embeddings.upper_bounds(code, factor, rotated, 0.0)
        off = ~np.eye(400, dtype=bool)
        errors.append((estimate - v @ v.T)[off])
        outside += (embeddings.upper_bounds(code, factor, rotated, 4.0) < v @ v.T)[off].mean()
    assert abs(np.concatenate(errors).mean()) < 2e-3 and outside / 10 < 1e-3


# ---- WARC -----------------------------------------------------------------------------

def test_archives_round_trip_odd_pages(spark):
    rows = [(3, "http://x/ a\n", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (5, "u", ""), (7, "u", "é" * 300_000),
            (None, "u", "<p>same</p>"), (9, "u", "\r\n\r\nWARC/1.1\r\n"), (1, None, "<p>same</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = shared_path(spark, "test_warc")
    warc.write_archives(df, path, archive_bytes=200)
    assert warc.opens_by_range(spark, path) and not warc.opens_by_range(spark, path + "-none")
    for by_range in (False, True, None):
        got = warc.read_archives(spark, path, by_range=by_range).collect()
        want = []
        for i, _, h in rows:
            data = (h or "").encode()
            same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
            first = min(same) if same else None
            revisit = first is not None and i != first
            want.append((str(i) if i is not None else "null", "revisit" if revisit else "response", len(data),
                         base64.b32encode(hashlib.sha1(data).digest()).decode(), str(first) if revisit else None, None if revisit else data))
        assert sorted(map(str, want)) == sorted(str((r["key"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"],
                                                     None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    one = warc.read_archives(spark, path, keys=frozenset(["7"]), by_range=True).collect()
    assert [r["key"] for r in one] == ["7"]


def test_empty_pages_and_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "")], "page_id long, url string, html string")
    path = shared_path(spark, "test_warc")
    warc.write_archives(df, path, min_bytes=3)
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}
    path = shared_path(spark, "test_warc")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).collect() == []


def test_zip64_directories_and_damage(monkeypatch):
    writer = warc.ArchiveWriter()
    for k in range(5):
        writer.add(str(k), warc.warc_record(str(k), "u", b"payload %d" % k, warc.payload_digest(hashlib.sha1(b"payload %d" % k).hexdigest()), None))
    plain = writer.close()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = writer.close()
    assert warc.END64_RECORD in wide and warc.END64_RECORD not in plain
    for data in (plain, wide, b"prefix kept out" * 0 + wide):
        records = dict(warc.ArchiveReader(warc.Content(data)).records())
        assert {k: r.payload for k, r in records.items()} == {str(k): b"payload %d" % k for k in range(5)}
        assert set(warc.ZipDirectory(warc.Content(data)).members) == set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    with pytest.raises(ValueError):
        warc.ZipDirectory(warc.Content(plain[:-3]))
    with pytest.raises(ValueError):
        warc.ArchiveReader(warc.Content(plain)).record(10**6, 10)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA_MEMBER, b"x" * 100)
    with pytest.raises(ValueError):
        warc.ZipDirectory(warc.Content(packed.getvalue())).stored_range(warc.DATA_MEMBER)
    assert struct.calcsize("<2L4Q") == 40
