"""Syncmers, SimHash, BPE and licenses against brute force, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import bpe, syncmers
from quire.llm.common import apply_llm_conf
from quire.llm.licenses import FULL_TEXTS, TEXTS, full_texts, license_digests, loose_digest, scan_licenses
from quire.llm.simhash import (forest_of_buckets, keep_one_per_component, local_roots, majority, shingle_hashes, simhash_components,
                               simhash_near_duplicates)
from quire.llm.syncmers import Anchors, fingerprints_with_next, likeness

WORDS = "the of and rain sky Über été niño 中文 data graph merge spark node lamp river stone light".split()
CLASHING = "id string, row string, fp string, text_hash string, ids string, size string, range string, place string, lines string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    long_text = sentence(rng, 60_000)
    base = sentence(rng, 80)
    return [(1, base), (2, None), (3, ""), (3, ""), (4, " \t\n "), (5, base + " tail"), (6, long_text), (7, "one"), (8, "one two"),
            (9, base), (9, base), (None, base), (None, None), (12, "x" * 5000), (13, "\x1c odd   white space"), (14, "ABC def ÄÖ")]


@pytest.fixture(scope="module")
def odd(spark):
    apply_llm_conf(spark)
    rows = [(i, t, *["clash"] * 9) for i, t in odd_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(4)


def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASHING}")


def hamming(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def naive_print(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if hamming(a, b) <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in ps}


# ---- SimHash --------------------------------------------------------------------------

def test_simhash_equals_brute_force_on_odd_rows(spark, odd):
    got = sorted((r["id"] is None, r["id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in simhash_near_duplicates(odd).collect())
    prints = [(i, naive_print(t)) for i, t in odd_rows()]
    roots = components_of({p for _, p in prints}, 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    assert got == sorted((i is None, i or 0, p, least.get(roots[p])) for i, p in prints)


def test_simhash_of_an_empty_table(spark):
    assert simhash_near_duplicates(empty(spark)).collect() == []
    assert keep_one_per_component(empty(spark)).collect() == []


def test_one_row_of_each_component_stays_with_all_columns(spark, odd):
    kept = keep_one_per_component(odd)
    assert kept.columns == odd.columns
    prints = {(i, t): naive_print(t) for i, t in odd_rows()}
    roots = components_of(set(prints.values()), 3)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(roots.values()))
    for i, t in rows:
        others = [j for (j, u), p in prints.items() if roots[p] == roots[prints[i, t]] and j is not None]
        assert i == (min(others) if others else None)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_forest_connects_what_brute_force_connects(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(700)], np.uint64)
    prints = np.unique(centres[rng.integers(0, 12, 700)] ^ flips)
    keys = np.sort(rng.integers(0, 3, len(prints)))
    a, b = forest_of_buckets(keys, prints, radius)
    place = {int(p): i for i, p in enumerate(prints)}
    found = local_roots(len(prints), np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    want_a, want_b = [], []
    for i in range(len(prints)):
        for j in range(i):
            if keys[i] == keys[j] and int(prints[i] ^ prints[j]).bit_count() <= radius:
                want_a.append(i)
                want_b.append(j)
    assert (found == local_roots(len(prints), np.array(want_a, int), np.array(want_b, int))).all()


def test_hot_buckets_are_cut_into_tiles_without_losing_links(spark, monkeypatch):
    from quire.llm import simhash
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:  # a chain of near ones: one hot bucket per block pair
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
            p ^= 1 << b
        prints.add(p)
    signed = [(k, p - 2**64 if p >= 2**63 else p) for k, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "id long, fp long")
    got = {r["fp"] % 2**64: r["component_id"] for r in simhash_components(df, 3).collect()}
    roots = components_of(prints, 3)
    ids = {p: k for k, p in enumerate(sorted(prints))}
    assert got == {p: ids[roots[p]] for p in prints}


def test_majority_needs_over_half():
    assert majority(np.array([1, 2], np.uint64)) == 0
    assert majority(np.array([1, 3, 2**63], np.uint64)) == 1
    assert majority(shingle_hashes("", 3)) == 0


# ---- syncmers -------------------------------------------------------------------------

def test_fingerprints_of_odd_rows(spark, odd):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    want = []
    for (i, _), t, nxt in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        a, e, n = Anchors([t]), Anchors([edited]), Anchors([nxt])
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a.strings()[0], e.strings()[0],
                     round(float(likeness(a, e)[0]), 12), round(float(likeness(a, n)[0]), 12)))
    got = [(str(r["id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
            round(r["near_edited"], 12), round(r["near_next"], 12)) for r in fingerprints_with_next(odd).collect()]
    assert sorted(got) == sorted(want)
    assert fingerprints_with_next(empty(spark)).collect() == []


def test_anchors_do_not_depend_on_context():
    rng = random.Random(1)
    passage = sentence(rng, 60)
    a, b = Anchors([sentence(rng, 30) + " " + passage + " " + sentence(rng, 40)]), Anchors([passage + " " + sentence(rng, 50)])
    inner = Anchors([passage])
    assert set(inner.value) <= set(a.value) and set(inner.value) <= set(b.value)
    assert np.diff(a.at).max() < 24


def test_likeness_orders_edits():
    rng = random.Random(2)
    text = sentence(rng, 300)
    cuts = [Anchors([text[:int(len(text) * k)] + sentence(rng, 300)[:len(text) - int(len(text) * k)]]) for k in (1, .9, .5, 0)]
    scores = [float(likeness(Anchors([text]), c)[0]) for c in cuts]
    assert scores[0] == 1 and scores == sorted(scores, reverse=True) and scores[1] > .8 and scores[3] < .1


def test_likeness_of_pairs_with_one_short_text():
    rng = random.Random(3)
    text = sentence(rng, 60)
    pairs = [(text[:95], text[:97]), (text[:97], text[:95]), (text[:100], text[:75]), (text[:75], text), ("", text), (text[:80], sentence(rng, 60))]
    a, b = (Anchors(list(side)) for side in zip(*pairs, strict=True))
    got = likeness(a, b)
    assert (got[:2] > .9).all() and got[2] > .7 and got[3] > .2 and got[4] == 0 and got[5] < .2
    assert likeness(a.take(2, 4), b.take(2, 4)).tolist() == got[2:4].tolist()


def plain_hash(points):
    """A polynomial over the mixed code points, one by one; of a run whose
    length is no power of two, over its first and its last such part."""
    step, mult, mask = int(syncmers._STEP), syncmers._MULT, 2**64 - 1

    def run(part):
        out = 0
        for p in part:
            own = (p + 1) * step & mask
            out = (out * mult + (own ^ own >> 31)) & mask
        return out
    width = 1 << len(points).bit_length() - 1
    return run(points) if width == len(points) else (run(points[:width]) * pow(mult, len(points), 1 << 64) + run(points[-width:])) & mask


def plain_mix(x):
    mask = 2**64 - 1
    x = (x ^ x >> 32) * int(syncmers._STEP) & mask
    x = (x ^ x >> 29) * syncmers._MULT & mask
    return x ^ x >> 32


def plain_syncmers(text, s, w):
    """Closed syncmers by a double loop: every k-mer, every inner s-mer."""
    points, found = [ord(c) for c in text], []
    for at in range(len(points) - s - w + 2):
        orders = [plain_mix(plain_hash(points[at + j:at + j + s])) >> 32 for j in range(w)]
        least = min(orders)
        if orders[0] == least or orders.index(least) == w - 1:
            found.append(at)
    return found


def plain_likeness(a, b):
    """By a double loop over two anchor lists (position, hash)."""
    if not a and not b:
        return 1.0
    times, pairs = {}, []
    for side, anchors in ((0, a), (1, b)):
        for at, value in anchors:
            n = times[side, value >> 8] = times.get((side, value >> 8), 0) + 1
            pairs.append((side, value >> 8, n, at))
    first = {(v, n): at for side, v, n, at in pairs if side == 0}
    met = [first[v, n] - at for side, v, n, at in pairs if side == 1 and (v, n) in first]
    good = [d for d in met if met.count(d) > 1 or min(len(a), len(b)) < 2]
    return 2 * len(good) / (len(a) + len(b))


@pytest.mark.parametrize("scale", [syncmers.LONG_SCALE, syncmers.SHORT_SCALE])
def test_closed_syncmers_equal_a_double_loop(scale):
    rng = random.Random(5)
    for text in [sentence(rng, 60), "aaaa" * 30, "ab" * 40, "é漢😀x" * 20, "", "short", sentence(rng, 5)]:
        points = np.array([ord(c) for c in text], np.uint32)
        assert syncmers.closed_syncmers(points, *scale)[0].tolist() == plain_syncmers(text, *scale)


def test_likeness_equals_a_double_loop():
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(20, 90)) for _ in range(12)] + ["tick tock " * 40, "tick tock " * 55, "", "x" * 300]
    texts = [t if len(t) >= syncmers.SHORT or not t else t * 8 for t in texts]
    others = [t[:len(t) // 2] + rng.choice(texts)[:80] + t[len(t) // 2:] for t in texts]
    others = [t if len(t) >= syncmers.SHORT else "" for t in others]
    a, b = Anchors(texts), Anchors(others)
    listed = lambda x, i: list(zip(x.at[x.text == i].tolist(), x.value[x.text == i].tolist(), strict=True))
    assert likeness(a, b).tolist() == pytest.approx([plain_likeness(listed(a, i), listed(b, i)) for i in range(len(texts))])


def test_likeness_of_very_many_short_texts():
    same = Anchors(["a"] * 70_000)
    assert (likeness(same, Anchors(["a"] * 70_000)) == 1).all()
    assert (likeness(same, Anchors(["a", "b"] * 35_000)) == [1, 0] * 35_000).all()


def test_long_runs_of_equal_and_of_null_texts_are_worked_in_blocks(spark, monkeypatch):
    n = 150_000
    df = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id < 80000 THEN 'a' END AS text").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = fingerprints_with_next(df).selectExpr("count(*)", "sum(CASE WHEN near_next < 1 THEN 1 ELSE 0 END)", "sum(CASE WHEN near_edited < 1 THEN 1 ELSE 0 END)").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert tuple(got) == (n, 2, 0)  # only where the runs meet, and from the last to the first
    sizes = []

    class Counted(Anchors):
        def __init__(self, texts, short=False):
            sizes.append(len(texts))
            super().__init__(texts, short)
    monkeypatch.setattr(syncmers, "Anchors", Counted)
    batch = pa.RecordBatch.from_pydict({"range": [0] * 50_000, "ahead": [0] * 50_000, "id": list(range(50_000)), "text": [""] * 50_000})
    assert sum(b.num_rows for b in syncmers._fingerprint_rows(iter([batch]))) == 49_999
    assert max(sizes) <= syncmers.CHUNK_ROWS + 1


def test_edited_text_below_the_short_scale_is_near(spark):
    text = sentence(random.Random(4), 60)[:100]
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {r["id"]: r["near_edited"] for r in fingerprints_with_next(df).collect()}[1] > .7


# ---- BPE ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return path, tokenizers.PATTERN, ranks, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_on_odd_rows(spark, odd, vocabulary):
    path, pattern, _, reference = vocabulary
    rows = bpe.bpe_decode(bpe.bpe_encode(odd, "text", path, pattern, ids_col="tokens"), "tokens", path).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["tokens"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids"] == "clash"
    assert bpe.bpe_encode(empty(spark), "text", path, pattern).collect() == []


def test_bpe_equals_tiktoken_on_random_unicode(vocabulary):
    _, pattern, ranks, reference = vocabulary
    rng = random.Random(7)
    pools = [(32, 127), (0x80, 0x250), (0x3000, 0x9FFF), (0x1F300, 0x1F700), (0, 0xD7FF), (9, 33)]
    texts = ["".join(chr(rng.randrange(*rng.choice(pools))) for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += ["a" * n for n in (1, 2, 3, 100, 2047, 2048, 2049, 4000)] + ["<|endoftext|>", "abc" * 2000, "\n\n  x", "  "]
    encoder, decoder = bpe.Encoder(ranks, bpe.mergeable_pairs(ranks), pattern), bpe.Decoder(ranks)
    ids, counts = encoder.texts(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == reference.encode_ordinary(text)
        assert decoder(part) == text.encode()


def test_both_ways_of_merging_agree_at_the_border(vocabulary, monkeypatch):
    _, pattern, ranks, _ = vocabulary
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeéo") for _ in range(n)) for n in (100, 2000, 2047, 2048, 2049, 2100)]
    encoder = bpe.Encoder(ranks, bpe.mergeable_pairs(ranks), pattern)
    ways = []
    for longest in (0, 2048, 1 << 20):  # all in rows of their own, as it is, all in shared matrices
        monkeypatch.setattr(bpe, "LONGEST_ROW", longest)
        ways.append([x.tolist() for x in encoder.texts(texts)])
    assert ways[0] == ways[1] == ways[2]


def test_long_rows_merge_in_order_whatever_the_ranks(monkeypatch):
    monkeypatch.setattr(bpe, "LONGEST_ROW", 0)
    for seed in range(40):  # ranks are dealt at random: merges often bring pairs of lower rank
        rng = random.Random(seed)
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 60:
            few = [t for t in tokens if len(t) > 1 or t in (b"a", b"b", b"c")]
            tokens.add(rng.choice(few) + rng.choice(few))
        numbers = list(range(len(tokens)))
        rng.shuffle(numbers)
        ranks = dict(zip(sorted(tokens), numbers, strict=True))
        texts = ["".join(rng.choice("abc" if n % 3 else "a") for _ in range(n)) for n in (1, 2, 3, 4, 5, 9, 50, 300, 301)]
        ids, counts = bpe.Encoder(ranks, bpe.mergeable_pairs(ranks), r"\w+").texts(texts)
        for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            parts = [bytes([b]) for b in text.encode()]
            if text.encode() in ranks:  # a piece that is a token is that token
                parts = [text.encode()]
            while True:
                pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
                if not pairs:
                    break
                _, i = min(pairs)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert got.tolist() == [ranks[p] for p in parts]


def test_bpe_decode_refuses_unknown_ids(vocabulary):
    with pytest.raises((ValueError, IndexError)):
        bpe.Decoder(vocabulary[2])(np.array([10**6]))


# ---- licenses -------------------------------------------------------------------------

def test_licenses_survive_case_wrapping_spelling_and_copyright_lines(spark):
    apply_llm_conf(spark)
    mit = next(t for n, _, t in FULL_TEXTS if n == "MIT")
    wrapped = re.sub(r"(.{40,60}) ", r"\1\n", mit)
    british = mit.replace("sublicense", "sub-licence").upper()
    rows = [(1, f"MIT Licence\n\nCopyright (c) 2020 A. Person\n© 2021 Someone\nAll rights reserved.\n\n{wrapped}"), (2, british),
            (3, mit + " And more."), (4, "some text\nRELEASED under the mit licence!\nlicensed under CC BY-NC 4.0"), (5, None), (6, ""),
            (6, ""), (None, "SPDX-License-Identifier: ISC"), (8, "word " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = sorted((str(r["id"]), r["text_license"], r["line_licenses"]) for r in scan_licenses(df).collect())
    assert got == sorted([("1", "MIT", []), ("2", "MIT", ["MIT"] if "\n" not in british else []), ("3", None, []),
                          ("4", None, ["CC-BY-NC-4.0", "MIT"]), ("5", None, []), ("6", None, []), ("6", None, []),
                          ("None", "ISC", ["ISC"]), ("8", None, [])])
    assert scan_licenses(df.limit(0)).collect() == []


def test_whole_texts_of_long_licenses_and_usual_forms_of_short_ones(spark):
    apply_llm_conf(spark)
    body = {n: t for n, _, t in FULL_TEXTS}
    long = {p.stem: p.read_text() for p in TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(long)
    texts = [(n, t) for n, t in long.items()] + [(n, " ".join(t.split())) for n, t in long.items()]
    apache = long["Apache-2.0"]
    texts += [("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Foo")),
              ("Apache-2.0", apache[:apache.index("END OF TERMS")].rstrip())]
    for head in ("The MIT License (MIT)\n\nCopyright (c) 2020 Foo", "Copyright Joyent, Inc. and other Node contributors.", "(c) 2020 Foo",
                 "©2020 Foo", "Copyright <YEAR> <HOLDER>", "The MIT License\n\nCopyright Foo", "Copyright Foo\n\nMIT License"):
        texts.append(("MIT", f"{head}\n\n{body['MIT']}"))
    for mark in ("* ", "- ", "{}) ", "({}) ", "  • ", ""):
        for name in ("BSD-2-Clause", "BSD-3-Clause"):
            texts.append((name, "Copyright (c) 2011, Foo\nAll rights reserved.\n\n"
                          + re.sub(r"(?m)^(\d)\. ", lambda m, mark=mark: mark.format("abc"[int(m[1]) - 1]), body[name])))
    texts += [("None", "Copyright Foo\nAll rights reserved."), ("None", "MIT License"), ("None", "1. a"), ("None", "Copyright Foo\n" + body["MIT"] + " More."),
              ("MIT", body["MIT"].replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: str(r["text_license"]) for r in scan_licenses(df).collect()}
    assert [(i, got[i], t[:60]) for i, (n, t) in enumerate(texts) if got[i] != n] == []
    known = license_digests(spark.createDataFrame(full_texts(), "license string, text string"), loose_digest)
    assert {r["license"] for r in known.collect()} == {n for n, _ in full_texts()}  # no license hides another
