"""Prefix trie of conversations and sums over its subtrees.

**Nodes.** Every turn has a 128-bit digest of its depth, role and text; the xor
of the digests of the first d turns names the sequence, so names of prefixes
come from a running xor, which can be taken block by block: a conversation
of any length is worked by many tasks. Texts aren't shuffled, only digests and
word counts. Sequences are taken as equal if these names are (two differing
ones share a name with a probability of about 2**-128 a pair).

**Sums over subtrees** (``centroid_rollup``) by centroid decomposition of the
parent-edge forest. The weight of a node is the number of its members, and the
weight of a subtree is known from the grouping that makes the nodes: it's the
number of turns that members still have from there on. In a component with top
t, the nodes whose subtree has more than half of t's weight are the path from
the top to the centroid, its deepest one. A round

1. finds the centroid of each component that is too large for a task,
2. tells which nodes are below it: node u, on the way of conversation c, is if
   c passes through a child of the centroid, which one keyed join on (c, depth)
   answers; those nodes become components with that child as their top,
3. adds the component's totals below the centroid to the nodes on the path, and
   takes the centroid's weight off theirs.

Every component of the next round has at most half the weight, so a chain of
length n takes log2(n) rounds as a bush does, and each round is keyed joins and
sums with partial aggregation. Components of at most ``task_nodes`` nodes go
whole to a task, which decomposes them in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, ship_by_value, word_count
from quire.llm.turns import numbered_turns

#: Positions of a conversation that are xored in one window; ids in one piece of a list.
BLOCK = 1024
#: Rows of fixed width (under 100 bytes) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Components of more nodes than this are split by Spark, others within a task.
TASK_NODES = 256


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# ------------------------------------------------------------------- nodes

def rebuilt_turns(conversations: DataFrame, *, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(member, depth, digest, words), and (member, n_turns) of every member.

    Conversation c has, in place of its first h turns, those of c - c % group
    (all if it has fewer, none if it's absent); h = crc32(decimal c) % heads.
    Turns are ordered by turn, null first, those of the same turn by the digest
    of role and text. Null roles and texts are empty; rows without conv_id
    belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("member"), "turn", digest.alias("digest"), word_count(text).alias("words"))
    turns = numbered_turns(rows, "member", [F.col("turn").asc_nulls_first(), F.col("digest")]).drop("turn")

    own = turns.groupBy("member").agg(F.max("pos").alias("had"))
    base = own.where(F.col("member") % group == 0).select(F.col("member").alias("base"), F.col("had").alias("base_had"))
    heads_of = (F.crc32(F.col("member").cast("string").cast("binary")) % heads).alias("h")
    plan = own.select("member", "had", heads_of, (F.col("member") - F.col("member") % group).alias("base")).join(base, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("base_had", F.lit(0))))
    plan = plan.select("member", "base", "h", "k", (F.col("k") + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("n_turns"))
    plan = cut_lineage(plan, "trie_members")

    tail = turns.join(plan.select("member", "h", "k"), "member").where(F.col("pos") > F.col("h")).select(
        "member", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words")
    first = turns.where((F.col("member") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("member", "base")
    head = plan.where(F.col("k") > 0).select("member", "base", "k").join(first, "base").where(F.col("pos") <= F.col("k")).select(
        "member", F.col("pos").alias("depth"), "digest", "words")
    return tail.unionByName(head), plan.select("member", "n_turns")


def prefix_paths(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(member, depth, node, up, words, below, last): every prefix of every
    member with its name, that of the prefix one shorter (null for the empty
    one), and how many turns are left, this one included."""
    named = turns.join(members, "member").select(
        "member", "depth", "words", "n_turns", F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
        F.xxhash64("depth", "digest").alias("z1"), F.xxhash64("digest", "depth", F.lit(7)).alias("z2"))
    # only members of more than a block take part in the sums over blocks
    in_block = W.partitionBy("member", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = cut_lineage(named.withColumns({"x1": F.bit_xor("z1").over(in_block), "x2": F.bit_xor("z2").over(in_block)}), "trie_xors")
    over = named.where(F.col("n_turns") > BLOCK).groupBy("member", "block").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    earlier = W.partitionBy("member").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    over = over.select("member", "block", F.bit_xor("b1").over(earlier).alias("c1"), F.bit_xor("b2").over(earlier).alias("c2"))
    later = named.where(F.col("block") > 0).join(over, ["member", "block"])
    later = later.withColumns({"x1": F.col("x1").bitwiseXOR(F.col("c1")), "x2": F.col("x2").bitwiseXOR(F.col("c2"))})
    named = named.where(F.col("block") == 0).unionByName(later.drop("c1", "c2"))
    below = F.col("n_turns") - F.col("depth") + 1
    none = F.lit(0).cast("long")
    paths = named.select(
        "member", "depth", F.struct(F.col("x1").alias("a"), F.col("x2").alias("b")).alias("node"),
        F.struct(F.col("x1").bitwiseXOR(F.col("z1")).alias("a"), F.col("x2").bitwiseXOR(F.col("z2")).alias("b")).alias("up"),
        "words", below.alias("below"), (F.col("depth") == F.col("n_turns")).alias("last"))
    root = F.struct(none.alias("a"), none.alias("b"))
    tops = members.select("member", none.alias("depth"), root.alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("up"),
                          none.alias("words"), (F.col("n_turns") + 1).alias("below"), (F.col("n_turns") == 0).alias("last"))
    return cut_lineage(paths.unionByName(tops), "trie_paths")


def listed_digest(rows: DataFrame, key: str, number: str, *, column: str) -> DataFrame:
    """(key, SHA-256 hex of the key's distinct numbers, ascending, in decimal
    and comma-joined). Numbers are joined in pieces of at most BLOCK;
    a key's pieces then stream in order through one hash, which is all that
    a task holds: the digest of one list can't be taken in parts."""
    piece = F.floor(F.col(number) / BLOCK)
    pieces = rows.groupBy(key, piece.alias("piece")).agg(F.array_join(F.sort_array(F.collect_list(number)).cast("array<string>"), ",").alias("joined"))
    schema = rows.select(key, F.lit("").alias(column)).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, state = None, None
        for batch in batches:
            keys, ends = [], []
            for at, joined in zip(batch.column(key).to_pylist(), batch.column("joined").to_pylist(), strict=True):
                if at != now or state is None:
                    if state is not None:
                        keys.append(now)
                        ends.append(state.hexdigest())
                    now, state = at, hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(ends, pa.string())], [key, column])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(key).type), pa.array([state.hexdigest()], pa.string())], [key, column])

    return pieces.repartition(F.col(key)).sortWithinPartitions(key, "piece").mapInArrow(stream, schema)


# ------------------------------------------------------------------ rollup

def centroid_rollup(nodes: DataFrame, paths: DataFrame, values: list[str], *, task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, and each of ``values`` summed over the node's subtree).

    nodes: (node, up, member, depth, weight, values ...): ``member`` passes
    through the node, ``weight`` is a sum over the subtree of something
    positive, a top's ``up`` is no node. paths: (member, depth, node, up), all
    nodes on the way of each member. A forest may have any number of trees.
    """
    acc = [f"acc_{v}" for v in values]
    one = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    state = nodes.select(one.alias("comp"), "node", "up", "member", "depth", "weight", *values, *[F.lit(0).cast("long").alias(a) for a in acc])
    ways = paths.select(F.col("member").alias("way_member"), F.col("depth").alias("way_depth"), F.col("node").alias("way_node"), F.col("up").alias("way_up"))
    done, small = [], []
    while True:
        sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top_weight"))
        sizes = cut_lineage(sizes.where(F.col("n") > task_nodes).select("comp", "top_weight"), "trie_sizes")
        n = sizes.count()
        if not n:
            small.append(state)
            break
        path = state.join(_small(sizes, n), "comp").where(2 * F.col("weight") > F.col("top_weight"))
        splits = cut_lineage(path.groupBy("comp", "top_weight").agg(
            F.max_by(F.struct("node", "weight"), "depth").alias("centre"), F.max("depth").alias("centre_depth")), "trie_splits")
        small.append(state.join(_small(splits.select("comp"), n), "comp", "left_anti"))
        wanted = splits.select((F.col("centre_depth") + 1).alias("way_depth")).distinct()
        mine = state.join(_small(splits, n), "comp")
        found = mine.join(ways.join(_small(wanted, n), "way_depth", "left_semi"),
                          (F.col("member") == F.col("way_member")) & (F.col("centre_depth") + 1 == F.col("way_depth")), "left")
        is_centre = F.col("node") == F.col("centre.node")
        below = F.coalesce((F.col("depth") > F.col("centre_depth")) & (F.col("way_up") == F.col("centre.node")), F.lit(False))
        cut = cut_lineage(found.select(
            "comp", "node", "up", "member", "depth", "weight", *values, *acc, F.col("centre.weight").alias("centre_weight"),
            is_centre.alias("is_centre"), below.alias("below"), (2 * F.col("weight") > F.col("top_weight")).alias("on_path"),
            F.when(below, F.col("way_node")).otherwise(F.col("comp")).alias("next_comp")), "trie_cuts")
        totals = cut_lineage(cut.where(F.col("below") | F.col("is_centre")).groupBy("comp").agg(
            *[F.sum(v).alias(f"total_{v}") for v in values]), "trie_totals")
        after = cut.join(_small(totals, n), "comp").select(
            F.col("next_comp").alias("comp"), "node", "up", "member", "depth",
            (F.col("weight") - F.when(F.col("on_path") & ~F.col("is_centre"), F.col("centre_weight")).otherwise(0)).alias("weight"), *values,
            *[(F.col(a) + F.when(F.col("on_path"), F.col(f"total_{v}")).otherwise(0)).alias(a) for v, a in zip(values, acc, strict=True)], "is_centre")
        done.append(after.where("is_centre").select("node", *[F.col(a).alias(v) for v, a in zip(values, acc, strict=True)]))
        state = after.where(~F.col("is_centre")).drop("is_centre")
    out = _finished_in_tasks(small, values)
    for part in done:
        out = out.unionByName(part)
    return out


def _finished_in_tasks(small: list[DataFrame], values: list[str]) -> DataFrame:
    rows = small[0]
    for part in small[1:]:
        rows = rows.unionByName(part)
    acc = [f"acc_{v}" for v in values]
    schema = rows.select("node", *values).schema

    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def answer(held: list[tuple]) -> pa.RecordBatch:
        sums = decompose(held, len(values))
        nodes = pa.array([{"a": r[0][0], "b": r[0][1]} for r in held], pair)
        return pa.RecordBatch.from_arrays([nodes, *[pa.array([s[j] for s in sums], pa.int64()) for j in range(len(values))]], ["node", *values])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # whole components, some thousand rows of them at a time
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("comp", "node", "up", "weight", *values, *acc)]
            for comp, node, up, weight, *numbers in zip(*columns, strict=True):
                if comp != now and len(held) >= 4096:
                    yield answer(held)
                    held = []
                now = comp
                held.append(((node["a"], node["b"]), (up["a"], up["b"]) if up else None, weight, numbers[:len(values)], numbers[len(values):]))
        if held:
            yield answer(held)

    return rows.repartition(F.col("comp")).sortWithinPartitions("comp", "depth").mapInArrow(finish, schema)


def decompose(rows: list[tuple], n_values: int) -> list[list[int]]:
    """Sums over subtrees in components: rows of (node, up, weight, values,
    sums so far), parents before children; a row whose ``up`` isn't among the
    rows is the top of a component."""
    place = {r[0]: i for i, r in enumerate(rows)}
    parent = [place.get(r[1], -1) if r[1] is not None else -1 for r in rows]
    weight, sums = [r[2] for r in rows], [list(r[4]) for r in rows]
    comp_of = list(range(len(rows)))
    todo: dict[int, list[int]] = {}
    for i, up in enumerate(parent):
        if up >= 0:
            comp_of[i] = comp_of[up]
        todo.setdefault(comp_of[i], []).append(i)
    stack = list(todo.values())
    while stack:
        comp = stack.pop()
        top = comp[0]
        half = weight[top]
        centre = next(i for i in reversed(comp) if 2 * weight[i] > half)  # those nodes are one path, deepest last
        under: dict[int, int] = {}  # node below the centre: the child of the centre above it
        parts: dict[int, list[int]] = {}
        upper, total = [], list(rows[centre][3])
        for i in comp:
            if i == centre:
                continue
            child = i if parent[i] == centre else under.get(parent[i])
            if child is None:
                upper.append(i)
                continue
            under[i] = child
            parts.setdefault(child, []).append(i)
            for j in range(n_values):
                total[j] += rows[i][3][j]
        taken, at = weight[centre], centre
        while True:
            for j in range(n_values):
                sums[at][j] += total[j]
            if at != centre:
                weight[at] -= taken
            if at == top:
                break
            at = parent[at]
        if upper:
            stack.append(upper)
        stack += parts.values()
    return sums


# --------------------------------------------------------------- the table

def conversation_trie(conversations: DataFrame, *, task_nodes: int = TASK_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), one row per node of the prefix trie of the
    rebuilt conversations (see ``rebuilt_turns``).

    conv_id is the smallest member; saved_tokens sums, over the subtree, the
    words of a node's last text times its members less one. Repeated rows are
    turns of their own; other columns are not read. An empty table, or one
    without any conv_id, has no node. ``task_nodes`` changes no result.
    """
    turns, members = rebuilt_turns(conversations)
    paths = prefix_paths(turns, members)
    nodes = paths.groupBy("node", "up", "depth").agg(
        F.min("member").alias("member"), F.count(F.lit(1)).alias("n_convs"), F.sum("below").alias("weight"), F.max("words").alias("words"))
    nodes = cut_lineage(nodes, "trie_nodes")
    children = nodes.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = cut_lineage(nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "trie_nodes")
    sums = centroid_rollup(nodes.select("node", "up", "member", "depth", "weight", "n_leaves", "saved_tokens"),
                           paths.where(F.col("depth") > 0).select("member", "depth", "node", "up"), ["n_leaves", "saved_tokens"], task_nodes=task_nodes)
    ends = listed_digest(paths.where("last").select("node", "member"), "node", "member", column="ends_sha256")
    parents = nodes.select(F.col("node").alias("up"), F.col("member").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(parents, "up", "left").join(sums, "node").join(ends, "node", "left")
    return out.select(
        F.col("member").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ship_by_value(__name__)
