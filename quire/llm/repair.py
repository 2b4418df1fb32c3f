"""Repair of conversation structure by a grammar-compressed dynamic program.

**Symbols.** What a row is to the repair takes one of nine symbols: its role's
initial (s, u, a, other; upper case if its text is truncated), or x if it has to
be deleted. A conversation is a string of symbols, in blocks of at most
``BLOCK``, so its length is bounded nowhere and equal blocks of all
conversations are worked once.

**Grammar.** Re-Pair over the distinct blocks: each round counts adjacent pairs
(a Spark aggregation) and replaces the most frequent ones by new symbols, until
no pair repeats. Rules are bounded in number; what stays uncompressed is
multiplied out symbol by symbol, with the same result.

**Program.** The wanted order of roles is read by an automaton of four states:
nothing yet, after s, after u, after a. A symbol's transfer matrix holds, for
each pair of states, the cheapest edits (inserts before the row and what
happens to it) and their audit; a rule's is the min-plus product of its two
symbols' matrices, with audits as ropes (pairs of ropes, shared between
rules). Among audits of equal cost the least stays: edits fix the states they
lead to, so two audits between the same states with the same cost can't be one
the beginning of the other, and least parts make least wholes. Blocks' matrices
are products over their compressed form, once per distinct block; those of
long conversations are multiplied in a tree of bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, null_safe_join, ship_by_value
from quire.llm.turns import numbered_turns

#: Rows of a conversation in one block, and blocks in one group of a product.
BLOCK, GROUP = 256, 32
#: Bounds of the grammar: rules of a round, rounds, first character of a rule.
ROUND_RULES, ROUNDS, FIRST_RULE = 32, 24, 0xE000

#: Costs of edits, state after the next inserted or new role, ends.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEXT = (2, 2, 3, 2)
ENDS = ((0, ""), (4, "II"), (2, "I"), (0, ""))
WHITE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------- ropes and matrices

class Rope:
    """Text made of parts; a part may belong to many ropes."""

    __slots__ = ("text", "left", "right")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def __add__(self, other: Rope) -> Rope:
        return Rope("", self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            at = stack.pop()
            if at.left is None:
                yield at.text
            else:
                stack += [at.right, at.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """Compares as far as needed; a part that both have at the same place
        is passed over whole."""
        a, b = [(self, 0)], [(other, 0)]
        while a and b:
            (x, i), (y, j) = a[-1], b[-1]
            if x is y and i == j:
                a.pop(), b.pop()
            elif x.left is not None:
                a[-1:] = [(x.right, 0), (x.left, 0)]
            elif y.left is not None:
                b[-1:] = [(y.right, 0), (y.left, 0)]
            else:
                n = min(len(x.text) - i, len(y.text) - j)
                p, q = x.text[i:i + n], y.text[j:j + n]
                if p != q:
                    return p < q
                a.pop(), b.pop()
                if i + n < len(x.text):
                    a.append((x, i + n))
                if j + n < len(y.text):
                    b.append((y, j + n))
        return any(r.left is not None or i < len(r.text) for r, i in b) and not any(r.left is not None or i < len(r.text) for r, i in a)


Entry = tuple[int, Rope] | None
Matrix = tuple[Entry, ...]  # 16 entries, by state before and state after


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    return b if b[0] < a[0] or b[0] == a[0] and b[1] < a[1] else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for before in range(4):
        for after in range(4):
            best = None
            for mid in range(4):
                x, y = a[4 * before + mid], b[4 * mid + after]
                if x is not None and y is not None:
                    best = better(best, (x[0] + y[0], x[1] + y[1]))
            out.append(best)
    return tuple(out)


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts before the row, then what happens to it."""
    out: list[Entry] = [None] * 16
    worse = TRUNCATED if symbol.isupper() else 0
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(symbol.lower(), {})
    for before in range(4):
        at, cost, inserts = before, 0, ""
        for _ in range(3):
            moves = [(at, DELETE, "D")]
            if symbol != "x":
                moves.append((NEXT[at], RENAME + worse, "R"))
                if at in kept:
                    moves.append((kept[at], worse, "K"))
            for after, price, edit in moves:
                place = 4 * before + after
                out[place] = better(out[place], (cost + price, Rope(inserts + edit)))
            at, cost, inserts = NEXT[at], cost + INSERT, inserts + "I"
    return tuple(out)


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """Matrices of the nine symbols and of the rules (symbol, pair), which
    refer to earlier ones only."""
    out = {s: symbol_matrix(s) for s in "xsuaoSUAO"}
    for symbol, pair in rules:
        out[symbol] = product(out[pair[0]], out[pair[1]])
    return out


# ----------------------------------------------------------------- grammar

def re_pair(words: DataFrame, column: str, weight: str, packed: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``words`` with their compressed form, and the rules (symbol, pair).

    A round's pairs are counted over all words by their weights; what comes to
    the driver is at most ``ROUND_RULES`` pairs a round.
    """
    words, rules = cut_lineage(words.withColumn(packed, F.col(column)), "repair_words"), []
    for _ in range(ROUNDS):
        long = words.where(F.length(packed) > 1)
        pairs = long.select(weight, F.explode(F.transform(F.sequence(F.lit(1), F.length(packed) - 1), lambda i: F.substring(F.col(packed), i, F.lit(2)))).alias("pair"))
        best = pairs.groupBy("pair").agg(F.sum(weight).alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(ROUND_RULES).collect()
        if not best:
            break
        form = F.col(packed)
        for row in best:
            symbol = chr(FIRST_RULE + len(rules))
            rules.append((symbol, row["pair"]))
            form = F.replace(form, F.lit(row["pair"]), F.lit(symbol))
        words = cut_lineage(words.withColumn(packed, form), "repair_words")
    return words, rules


MATRIX = "array<struct<cost:bigint,audit:string>>"


def _plain(m: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "audit": str(e[1])} for e in m]


def block_matrices(words: DataFrame, column: str, packed: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(column, matrix) of each distinct block."""
    shared = words.sparkSession.sparkContext.broadcast(rule_matrices(rules))

    @F.arrow_udf(MATRIX)
    def matrix(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        of = shared.value
        for forms in batches:
            out = []
            for form in forms.to_pylist():
                m = of[form[0]]
                for symbol in form[1:]:
                    m = product(m, of[symbol])
                out.append(_plain(m))
            yield pa.array(out, kind)

    return words.select(column, matrix(F.col(packed)).alias("matrix"))


def conversation_matrices(blocks: DataFrame) -> DataFrame:
    """(conv, block, matrix) to (conv, matrix): neighbours are multiplied in
    groups of ``GROUP`` until each conversation has one."""

    @F.arrow_udf(MATRIX)
    def multiplied(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for groups in batches:
            out = []
            for group in groups.to_pylist():
                parts = [tuple(None if e is None else (e["cost"], Rope(e["audit"])) for e in g["matrix"]) for g in group]
                m = parts[0]
                for part in parts[1:]:
                    m = product(m, part)
                out.append(_plain(m))
            yield pa.array(out, kind)

    while True:
        most = blocks.agg(F.max("block")).first()[0]
        if not most:
            return blocks.select("conv", "matrix")
        grouped = blocks.groupBy("conv", F.floor(F.col("block") / GROUP).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("parts"))
        blocks = cut_lineage(grouped.select("conv", "block", multiplied("parts").alias("matrix")), "repair_products")


# ------------------------------------------------------------------- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after a reproducible damage: by
    crc32("conv_id:turn") % 20 a row is dropped (0), loses its text (1) or the
    marks .!? (2), stands twice (3) or gets the role user (4). Nulls of role,
    text, and in that string, are one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                                (F.crc32(name.cast("binary")) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice).drop("copy")


def _content(role: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))))


def _repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): rows stream in order behind their
    conversation's audit; a task holds one audit and one hash at a time."""
    texts = rows.select(F.col("conv_id").alias("conv"), F.lit(1).alias("kind"), "turn", _content("role", "text").alias("content"),
                        "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("content"),
                          F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    dealt = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "content")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv = audit = digest = None
        state, at, started = 0, 0, False
        keys, ends = [], []

        def put(role: str, text: str) -> None:
            nonlocal started
            digest.update((("\n" if started else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            started = True

        def inserts() -> None:
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                put("assistant" if state == 2 else "user", "")
                state, at = NEXT[state], at + 1

        def close() -> None:
            if digest is not None:
                inserts()
                keys.append(conv)
                ends.append(digest.hexdigest())

        for batch in batches:
            keys, ends = [], []
            for c, kind, role, text, edits in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", "audit")), strict=True):
                if kind == 0:
                    close()
                    conv, audit, digest, state, at, started = c, edits, hashlib.sha256(), 0, 0, False
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(role, text)
                    state = {"s": 1, "u": 2, "a": 3}[role[0]]
                elif edit == "R":
                    put("assistant" if state == 2 else "user", text)
                    state = NEXT[state]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends, pa.string())], ["conv", "repaired_sha256"])
        keys, ends = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends, pa.string())], ["conv", "repaired_sha256"])

    return dealt.mapInArrow(stream, "conv bigint, repaired_sha256 string")


def repair_rows(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, gaps, cost, audit,
    repaired_sha256) of every conversation in rows (conv_id, turn, role, text),
    of which role and text are not null.

    Rows are ordered by turn, nulls first, those of one turn by the digest of
    role and text. A null conv_id is a conversation. No rows: no rows.
    ``block`` changes no result.
    """
    text = F.rtrim(F.col("text"), F.lit(WHITE))
    light = rows.select(
        F.col("conv_id").alias("conv"), "turn", _content("role", "text").alias("content"), F.substring("role", 1, 1).alias("initial"),
        (text == "").alias("blank"), F.right(text, F.lit(1)).isin(".", "!", "?").alias("closed"))
    placed = numbered_turns(light, "conv", [F.col("turn").asc_nulls_first(), F.col("content")])
    first = placed.groupBy("conv", "content").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    told = null_safe_join(placed, first, ["conv", "pos"], "left")
    told = told.withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    told = told.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("closed"))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    symbol = F.when(F.col("blank") | F.col("duplicate"), F.lit("x")).when(F.col("truncated"), F.upper(role)).otherwise(role)
    told = cut_lineage(told.select("conv", "pos", "turn", "initial", "blank", "duplicate", "truncated", symbol.alias("symbol")), "repair_rows")

    # the last row of a block is also read by the next one, as its row before
    number = F.floor((F.col("pos") - 1) / block)
    seen = told.select("conv", "pos", "initial", "symbol", F.explode(
        F.when(F.col("pos") % block == 0, F.array(number, number + 1)).otherwise(F.array(number))).alias("block"))
    parts = seen.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "symbol"))).alias("rows"))
    own = F.filter("rows", lambda r: r["pos"] > F.col("block") * block)
    pair = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: F.concat(
        F.col("rows")[i - 1]["initial"], F.col("rows")[i]["initial"]))
    illegal = F.when(F.size("rows") > 1, F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    blocks = parts.select("conv", "block", F.array_join(F.transform(own, lambda r: r["symbol"]), "").alias("word"), illegal.alias("illegal"))
    blocks = cut_lineage(blocks, "repair_blocks")
    real = blocks.where(F.col("word") != "")  # a context row alone is no block

    words, rules = re_pair(real.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "n", "packed")
    matrices = cut_lineage(block_matrices(words, "word", "packed", rules), "repair_matrices")
    whole = conversation_matrices(real.select("conv", "block", "word").join(matrices, "word").select("conv", "block", "matrix"))
    ends = [F.when(F.col("matrix")[q].isNotNull(), F.struct((F.col("matrix")[q]["cost"] + cost).alias("cost"),
                                                           F.concat(F.col("matrix")[q]["audit"], F.lit(more)).alias("audit"))) for q, (cost, more) in enumerate(ENDS)]
    chosen = F.array_min(F.filter(F.array(*ends), lambda e: e.isNotNull()))
    audits = cut_lineage(whole.select("conv", chosen.alias("chosen")).select("conv", "chosen.cost", "chosen.audit"), "repair_audits")

    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    faults = told.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"))
    breaks = blocks.groupBy("conv").agg(F.sum("illegal").cast("long").alias("illegal"))
    turns = told.where(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.count(F.lit(1))).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = faults
    for part in (breaks, turns, audits, _repaired_digests(rows, audits)):
        out = null_safe_join(out, part, ["conv"], "left")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))


def repair_damaged(conversations: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation of the table, after ``damaged``.

    Conversations that lose all rows have zeros, an empty audit and the hash of
    the empty text; null conv_id is a conversation. Repeated rows are rows of
    their own (the second is a duplicate). Other columns are not read.
    """
    conversations = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    known = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("conv"))
    out = null_safe_join(known, repair_rows(damaged(conversations), block=block), ["conv"], "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ship_by_value(__name__)
