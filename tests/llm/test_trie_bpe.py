"""Trie BPE against the tokenizers library and against plain merging."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.common import apply_llm_conf, table
from quire.llm.queries import registry
from quire.llm.trie_bpe import SuffixTokens, TrieEncoder, Vocabulary, ids_as_bytes, may_follow, sound_tokens, trie_decode, trie_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        vocab = Vocabulary(f.read())
    return TrieEncoder(vocab, SuffixTokens(sound_tokens(vocab)))


def same(ours, theirs, texts):
    ids, counts = ours.encode(texts)
    at = 0
    for text, n, want in zip(texts, counts, theirs.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert ids[at:at + n].tolist() == want.ids, text[:80]
        at += n


def test_every_code_point(ours, theirs):
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(marks), 50_000):
        same(ours, theirs, [f"a{c}b {c} 1{c}{c}! \n{c}" for c in marks[at:at + 50_000]])


def test_random_tokens_letters_and_long_words(ours, theirs):
    rnd, tokens = random.Random(1), [t for t in ours.vocab.bytes_of.values()]
    same(ours, theirs, [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 12))).decode("utf-8", "ignore") for _ in range(5000)])
    same(ours, theirs, ["".join(rnd.choice("ab eo\n's1=-té ") for _ in range(rnd.randint(1, 60))) for _ in range(5000)])
    same(ours, theirs, ["aaaa" * 5000, "=" * 100_000, " " * 70_000, "é" * 3000, "abcdefgh" * 9000, None, "", "don't 'sx'S I'll\n\n\n a"])


def test_spelled_special_tokens(ours, theirs):
    same(ours, theirs, ["a<|endoftext|>b <|endoftext|> <|endoftext|><|endoftext|>", "<|endoftext|>", "<|endoftext|", "  <|endoftext|>  x"])


def test_tokens_that_may_follow_are_those_that_stay_two(ours):
    vocab, rnd = ours.vocab, random.Random(3)
    tokens = list(ours.vocab.halves)

    def merged(data):
        ids = [vocab.id_of_byte[b] for b in data]
        while True:
            pairs = [(vocab.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in vocab.merges]
            if not pairs:
                return ids
            _, i = min(pairs)
            ids[i:i + 2] = [vocab.merges[ids[i], ids[i + 1]][1]]

    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(1500)] + [(t, t) for t in rnd.sample(tokens, 500)]
    for a, b in pairs:
        assert may_follow(vocab, a, b) == (merged(vocab.bytes_of[a] + vocab.bytes_of[b]) == [a, b])


def test_whole_table_equals_the_library(spark, theirs):
    import hashlib

    import numpy as np
    apply_llm_conf(spark)
    got = {r["doc_id"]: r for r in registry()["op12_trie_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = theirs.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_empty_tables(spark, theirs):
    rows = [(None, None, 1), (1, "", 2), (1, "word word", 3), (1, "word word", 3), (2, "x" * 200_000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = trie_decode(ids_as_bytes(trie_encode(df, "text", PATH), "ids", bytes_col="raw"), "ids", PATH).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert all(r["ids"] == theirs.encode(r["text"] or "", add_special_tokens=False).ids and len(r["raw"]) == 4 * len(r["ids"]) for r in out)
    assert trie_encode(df.limit(0), "text", PATH).collect() == []
    broken = spark.createDataFrame([([50256, 127],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in trie_decode(broken, "ids", PATH).collect()] == [theirs.decode([50256, 127], skip_special_tokens=False), "", ""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        trie_decode(spark.createDataFrame([([60000],)], "ids array<int>"), "ids", PATH).collect()


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            Vocabulary(f.read())


def test_a_round_trip_takes_two_python_workers_and_slices_lose_no_row(spark, theirs, monkeypatch):
    import quire.llm.trie_bpe as TB
    apply_llm_conf(spark)
    rows = [(i, None if i % 7 == 0 else f"row {i} " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(TB, "SLICE_CHARS", 500)
    found = TB.trie_round_trip(df, "doc_id", "text", PATH)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == 300
    for i, text in rows:
        assert got[i]["ids"] == theirs.encode(text or "", add_special_tokens=False).ids and got[i]["decoded"] == (text or "")
        assert len(got[i]["ids_bytes"]) == 4 * got[i]["n_tokens"]


def test_a_task_remembers_a_bounded_number_of_pairs(ours, theirs, monkeypatch):
    import quire.llm.trie_bpe as TB
    monkeypatch.setattr(TB, "REMEMBERED_PAIRS", 50)
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(2000))]
    same(ours, theirs, texts)
    assert len(ours.pairs) <= 100
