"""Typo-tolerant term matching.

Candidates come from a deletion-neighbourhood equi-join: two strings within
edit distance k share a string reachable by at most k deletions from each,
so joining the deletion variants of the query terms with those of the
vocabulary finds every candidate without comparing all pairs. The few
candidates are then verified with the exact (unrestricted)
Damerau-Levenshtein distance in an Arrow-batched UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions._ship import ship_by_value
from quire.session import checked_broadcast, cut_lineage

ship_by_value(__name__)


def auto_edits(length: Column) -> Column:
    """AUTO fuzziness: 0 edits up to 2 chars, 1 edit for 3-5, 2 beyond."""
    return F.when(length <= 2, F.lit(0)).when(length <= 5, F.lit(1)).otherwise(F.lit(2))


def damerau_levenshtein(a: str, b: str, limit: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance (Lowrance-Wagner).

    With ``limit``, returns ``limit + 1`` as soon as a whole DP row exceeds
    it (row minima never decrease, transpositions included)."""
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return la + lb
    big = la + lb
    last_row: dict[str, int] = {}
    d = [[0] * (lb + 2) for _ in range(la + 2)]
    d[0][0] = big
    for i in range(la + 1):
        d[i + 1][0] = big
        d[i + 1][1] = i
    for j in range(lb + 1):
        d[0][j + 1] = big
        d[1][j + 1] = j
    for i in range(1, la + 1):
        ai = a[i - 1]
        last_match_col = 0
        row, prev = d[i + 1], d[i]
        row_min = big
        for j in range(1, lb + 1):
            bj = b[j - 1]
            i1 = last_row.get(bj, 0)
            j1 = last_match_col
            if ai == bj:
                cost = 0
                last_match_col = j
            else:
                cost = 1
            v = prev[j] + cost
            t = row[j] + 1
            if t < v:
                v = t
            t = prev[j + 1] + 1
            if t < v:
                v = t
            t = d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1)
            if t < v:
                v = t
            row[j + 1] = v
            if v < row_min:
                row_min = v
        if limit is not None and row_min > limit:
            return limit + 1
        last_row[ai] = i
    return d[la + 1][lb + 1]


def _dl_batch(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([damerau_levenshtein(x, y, int(m)) for x, y, m in zip(a, b, k)], dtype="int32")


# Marked non-deterministic only so the optimizer evaluates it once, after the
# candidate pairs are de-duplicated, instead of copying it into pushed filters.
dl_distance = F.pandas_udf(_dl_batch, T.IntegerType()).asNondeterministic()


def variant_rows(df: DataFrame, col: str, depth: Column) -> DataFrame:
    """Rows (col, variant, dv) for 0..depth deletions (depth <= 2), built with
    explode over positions (code-generated), not nested lambda functions. The
    rows of ``df`` are read once: position 0 stands for no deletion.
    Deletion pairs are enumerated once each (i <= j on the shortened string);
    repeated letters can still yield repeated variants, which the candidate
    de-duplication absorbs."""
    base = df.select(F.col(col), depth.alias("_depth"), F.length(col).alias("_n"))
    first = F.sequence(F.lit(0), F.when(F.col("_depth") >= 1, F.col("_n")).otherwise(F.lit(0)))
    one = base.select(col, "_depth", "_n", F.explode(first).alias("_i"))
    cut = F.concat(F.expr(f"substr(`{col}`, 1, _i - 1)"), F.expr(f"substr(`{col}`, _i + 1)"))
    one = one.select(col, "_depth", "_n", "_i", F.when(F.col("_i") == 0, F.col(col)).otherwise(cut).alias("_one"))
    last = F.when((F.col("_i") >= 1) & (F.col("_depth") >= 2) & (F.col("_n") >= 2), F.col("_n") - 1).otherwise(F.lit(0))
    second = F.when(last >= F.col("_i"), F.concat(F.array(F.lit(0)), F.sequence(F.least("_i", last), last))).otherwise(F.array(F.lit(0)))
    two = one.select(col, "_i", "_one", F.explode(F.when(F.col("_i") == 0, F.array(F.lit(0))).otherwise(second)).alias("_j"))
    cut = F.concat(F.expr("substr(_one, 1, _j - 1)"), F.expr("substr(_one, _j + 1)"))
    return two.select(col, F.when(F.col("_j") == 0, F.col("_one")).otherwise(cut).alias("variant"),
                      ((F.col("_i") > 0).cast("int") + (F.col("_j") > 0).cast("int")).alias("dv"))


def vocabulary_variants(vocab: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(term, variant, dv): deletion variants of each distinct term with their
    depth. Depth 2 only for terms of 4+ characters (a 2-edit query term has
    6+ characters, so shorter vocabulary terms can only need one deletion).

    With ``near`` (``_length``, ``_depth``) only terms of these lengths, that
    deep: an edit changes the length by one at most, so a long term that no
    query term comes near doesn't fan out into the square of its length."""
    # each term fans out to dozens of variants: spread the (small) distinct
    # vocabulary over all cores first so the fan-out is not one task
    par = vocab.sparkSession.sparkContext.defaultParallelism
    t = vocab.select("term").distinct()
    depth = F.when(F.length("term") >= 4, F.lit(2)).otherwise(F.lit(1))
    if near is not None:
        t = t.join(F.broadcast(near), F.length("term") == F.col("_length")).select("term", F.least("_depth", depth).alias("_depth"))
        depth = F.col("_depth")
    return variant_rows(t.repartition(par), "term", depth)


def reached_lengths(q: DataFrame) -> DataFrame:
    """(_length, _depth): lengths of terms that may be within ``k`` edits of a
    query term of (qterm, k), and the most deletions that it takes."""
    n = F.length("qterm")
    reached = q.select("k", F.explode(F.sequence(n - F.col("k"), n + F.col("k"))).alias("_length"))
    return reached.groupBy("_length").agg(F.max("k").alias("_depth"))


def fuzzy_candidates(qterms: DataFrame, vocab: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(qterm, term, distance) for every vocabulary term within AUTO edits.

    ``qterms`` has ``qterm``; ``vocab`` has ``term``. A pair qualifies for
    the exact check only if both strings reach a shared variant with at most
    k deletions each, and native Levenshtein rules out pairs with Lev > 2k
    (DL >= Lev / 2) and is the distance of pairs that no transposition can
    bring nearer; only the rest are measured by the Damerau-Levenshtein UDF.
    """
    q = qterms.select("qterm").distinct().withColumn("k", auto_edits(F.length("qterm")))
    qv = checked_broadcast(variant_rows(q, "qterm", F.col("k")).select("qterm", "variant").join(q, "qterm"),
                           name="query_variants")
    vv = variants if variants is not None else vocabulary_variants(vocab, cut_lineage(reached_lengths(q), "query_lengths"))
    lev = F.levenshtein("qterm", "term")
    cand = cut_lineage(qv.join(vv, "variant").where(F.col("dv") <= F.col("k")).select("qterm", "k", "term").distinct()
                       .withColumn("lev", lev).where(F.col("lev") <= 2 * F.col("k")), "fuzzy_pairs")  # DL >= Lev / 2
    # A transposition costs 2 in Lev and 1 in DL, any other edit 1 in both. So DL
    # is Lev unless there's a transposition: none if Lev < 2; of Lev 2 to 4 within
    # 2 edits the transpositions leave Lev 2 and 4 anagrams, Lev 3 one letter off.
    letters = lambda c: F.array_sort(F.split(c, ""))
    off = F.greatest(F.size(F.array_except(F.split("qterm", ""), F.split("term", ""))), F.size(F.array_except(F.split("term", ""), F.split("qterm", ""))))
    moved = F.when(F.col("lev") == 3, (F.abs(F.length("qterm") - F.length("term")) <= 1) & (off <= 1)).otherwise(
        (F.length("qterm") == F.length("term")) & (letters("qterm") == letters("term")))
    plain = cand.where((F.col("lev") <= F.col("k")) & ((F.col("lev") < 2) | ~moved)).select("qterm", "term", F.col("lev").alias("distance"))
    # spread the Python check over all cores: AQE would otherwise coalesce the
    # small post-shuffle input into one task and one Python worker
    par = cand.sparkSession.sparkContext.defaultParallelism
    unsure = cand.where((F.col("lev") >= 2) & moved).repartition(par, "qterm", "term").withColumn("distance", dl_distance("qterm", "term", "k"))
    return plain.unionByName(unsure.where(F.col("distance") <= F.col("k")).select("qterm", "term", "distance"))


def fuzzy_expansions(pairs: DataFrame, term_stats: DataFrame, max_expansions: int | None = None) -> DataFrame:
    """(field, qterm, term, distance): per field, every vocabulary term of
    that field within AUTO edits, from the pairs of ``fuzzy_candidates``; with
    ``max_expansions`` only the first ones by (distance, term).
    """
    per_field = pairs.join(term_stats.select("field", "term"), "term").select("field", "qterm", "term", "distance")
    if max_expansions is None:
        return per_field
    w = Window.partitionBy("field", "qterm").orderBy("distance", "term")
    return per_field.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_expansions).drop("_r")
