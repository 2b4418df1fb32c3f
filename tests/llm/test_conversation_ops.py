"""Prefix trie and structure repair of conversations against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import prefix_trie, repair
from quire.llm.prefix_trie import conversation_trie, decompose, listed_digest
from quire.llm.repair import ENDS, Rope, product, repair_damaged, rule_matrices
from quire.llm.turns import numbered_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def content(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, content(r[1], r[2])))


def brute_trie(rows):
    """All prefixes of all rebuilt conversations, written out."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in in_order(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, sums = {}, {}
    for n in members:
        if n:
            children[n[:-1]] = children.get(n[:-1], 0) + 1
    for n, own_members in members.items():
        saved = (len(own_members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            total = sums.setdefault(n[:d], [0, 0])
            total[0] += n not in children
            total[1] += saved
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children.get(n, 0), *sums[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_edits(rows):
    """Cheapest edits of (initial, has to go, truncated) rows, least audit: uniform-cost search."""
    after, kept = {0: 2, 1: 2, 2: 3, 3: 2}, {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 2, audit + "I", i, after[state]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not gone:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, after[state]))
                if state in kept.get(initial, {}):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, kept[initial][state]))


def brute_repair(table):
    convs = {}
    for c, turn, role, text in table:
        rows = convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows, seen, faults = in_order(rows), set(), ""
        for _, role, text in rows:
            end = text.rstrip(WHITE)
            faults += "b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t"
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = brute_edits([(r[1][:1], f in "bd", f == "t") for r, f in zip(rows, faults, strict=True)])
        lines, todo = [], iter(rows)
        for edit in audit:
            last = lines[-1][0] if lines else ""
            new = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{new}:")
            else:
                _, role, text = next(todo)
                lines += {"K": [f"{role}:{text}"], "R": [f"{new}:{text}"], "D": []}[edit]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows(seed, n=400):
    """Nulls in every column, ties, repeated rows, empty and long texts, odd roles."""
    rnd = random.Random(seed)
    texts = ["a b.", "c", None, "", "d e f!  ", "x\t?\n", "é", "long text. " * 3000]
    rows = [(rnd.choice([None, *range(-45, 60)]), rnd.choice([None, 0, 1, 2, 3, 9]), rnd.choice(["user", None, "assistant", "system", "tool", ""]), rnd.choice(texts)) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("task_nodes", [1, 256])
def test_trie_equals_brute_force(spark, task_nodes):
    rows = odd_rows(3)
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA), task_nodes=task_nodes)) == brute_trie(rows)


def test_trie_of_a_long_chain_and_of_one_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(c, i, "user", f"t {i}") for c, n in ((40, 200), (41, 150)) for i in range(n)]
    rows += [(c, i, "u", "same here") for c in range(100, 200) for i in range(4)]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA), task_nodes=40)) == brute_trie(rows)


def test_trie_of_nothing_and_clashing_columns(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "a b", 1, "p", 2), (1, 1, "assistant", "c", 3, "q", 4)]
    clash = spark.createDataFrame(rows, SCHEMA + ", depth int, node string, member int")
    assert found(conversation_trie(clash)) == brute_trie([r[:4] for r in rows])


def test_decomposition_in_a_task_equals_plain_sums():
    rnd = random.Random(5)
    for _ in range(30):
        parent = [-1] + [rnd.choice([i - 1, rnd.randrange(i)]) for i in range(1, 60)]
        own, sums, weight = [rnd.randrange(9) for _ in parent], [0] * 60, [0] * 60
        for i in range(60):
            at = i
            while at >= 0:
                sums[at] += own[i]
                weight[at] += 1
                at = parent[at]
        rows = [(i, parent[i] if i else None, weight[i], [own[i]], [0]) for i in range(60)]
        assert decompose(rows, 1) == [[s] for s in sums]


def test_digest_of_a_long_list_in_pieces(spark):
    df = spark.range(-3000, 3000).selectExpr("'k' AS k", "id").union(spark.sql("SELECT 'one', 7L"))
    want = {"k": hashlib.sha256(",".join(map(str, range(-3000, 3000))).encode()).hexdigest(), "one": hashlib.sha256(b"7").hexdigest()}
    assert {r["k"]: r["d"] for r in listed_digest(df, "k", "id", column="d").collect()} == want


def test_places_of_a_conversation_that_lies_over_all_ranges(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN id % 3 WHEN id % 41 = 1 THEN NULL ELSE 99 END AS c", "id % 700 AS t")
    rows = numbered_turns(df, "c", [F.col("t")]).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (str(r["c"]), r["pos"])):
        by.setdefault(r["c"], []).append(r)
    for members in by.values():
        assert [r["pos"] for r in members] == list(range(1, len(members) + 1))
        assert [r["t"] for r in members] == sorted(r["t"] for r in members)


@pytest.mark.parametrize("block", [2, 256])
def test_repair_equals_brute_force(spark, block):
    rows = odd_rows(7)
    assert found(repair_damaged(spark.createDataFrame(rows, SCHEMA), block=block)) == brute_repair(rows)


def test_repair_of_a_long_conversation_in_groups_of_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(repair, "GROUP", 3)
    rows = [(7, i, rnd.choice(["user", "assistant", "system"]), f"t{i}" + rnd.choice([".", ""])) for i in range(300)]
    assert found(repair_damaged(spark.createDataFrame(rows, SCHEMA), block=8)) == brute_repair(rows)


def test_repair_of_nothing_and_of_conversations_that_lose_all_rows(spark):
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x.")]
    assert found(repair_damaged(spark.createDataFrame(rows, SCHEMA))) == brute_repair(rows) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    clash = spark.createDataFrame([(1, 0, "user", "a.", 5, "z", "b"), (1, 1, "assistant", "c", 3, "q", "d")], SCHEMA + ", pos int, audit string, block string")
    assert found(repair_damaged(clash)) == brute_repair([(1, 0, "user", "a."), (1, 1, "assistant", "c")])


def test_matrices_equal_search_whatever_the_grouping():
    of, rnd = rule_matrices([]), random.Random(4)
    words = [w for n in (1, 2, 3) for w in itertools.product("xsuaoSUAO", repeat=n)]
    words += [tuple(rnd.choice("xsuaoSUAO") for _ in range(rnd.randint(4, 30))) for _ in range(100)]
    for w in words:
        parts = [of[s] for s in w]
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i:i + 2] = [product(parts[i], parts[i + 1])]
        best = min((e[0] + cost, str(e[1]) + more) for e, (cost, more) in zip(parts[0][:4], ENDS, strict=True) if e)
        assert best == brute_edits([(s.lower(), s == "x", s.isupper()) for s in w])


def test_grammar_spells_its_words(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("uaus") for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame([(w, 1) for w in set(words)], "word string, n int")
    packed, rules = repair.re_pair(df, "word", "n", "packed")
    spelled = {}
    for symbol, pair in rules:
        spelled[symbol] = "".join(spelled.get(s, s) for s in pair)
    got = packed.collect()
    assert rules and all("".join(spelled.get(s, s) for s in r["packed"]) == r["word"] for r in got)
    assert sum(len(r["packed"]) for r in got) < sum(len(r["word"]) for r in got) / 2


def test_ropes_compare_like_their_texts():
    rnd = random.Random(8)
    ropes = [Rope("".join(rnd.choice("DK") for _ in range(rnd.randint(0, 3)))) for _ in range(20)]
    for _ in range(200):
        ropes.append(rnd.choice(ropes[-30:]) + rnd.choice(ropes[-30:]))
    for _ in range(2000):
        a, b = rnd.choice(ropes[:120]), rnd.choice(ropes[:120])
        assert (a < b) == (str(a) < str(b))
