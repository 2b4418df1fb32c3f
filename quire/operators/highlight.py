"""Highlighting of result pages: ``<mark>`` around matching tokens.

Runs on the page only (after top-k): per hit and field, the text is cut at
whitespace into consecutive fragments of at most ``size`` characters, the
fragments with the most distinct matched terms are kept (ties: earlier
first), and every whole token equal to a matched term or one of its fuzzy
expansions is wrapped in the tags.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions._ship import ship_by_value
from quire.functions.text import TOKEN_PATTERN
from quire.operators import search as S
from quire.operators.index import TextIndex
from quire.session import cut_lineage

ship_by_value(__name__)

# Per-field fragment size and count, and the tags.
HIGHLIGHT_FIELDS = {"contextualContent": (200, 2), "title": (100, 1), "abstract": (300, 1), "openSummary": (200, 1)}
PRE_TAG, POST_TAG = "<mark>", "</mark>"


def fragments(text: str, terms: set[str], size: int, n: int) -> list[str]:
    import regex
    tok = regex.compile(TOKEN_PATTERN)
    words = (text or "").split()
    frags, cur, cur_len = [], [], 0
    for w in words:
        add = len(w) + (1 if cur else 0)
        if cur and cur_len + add > size:
            frags.append(" ".join(cur))
            cur, cur_len = [w], len(w)
        else:
            cur.append(w)
            cur_len += add
    if cur:
        frags.append(" ".join(cur))
    scored = []
    for i, f in enumerate(frags):
        hit = {m.group(0).lower() for m in tok.finditer(f)} & terms
        if hit:
            scored.append((-len(hit), i, f))
    scored.sort()
    out = []
    for _, _, f in scored[:n]:
        out.append(tok.sub(lambda m: f"{PRE_TAG}{m.group(0)}{POST_TAG}" if m.group(0).lower() in terms else m.group(0), f))
    return out


#: Hits of a request that are marked together.
HITS_AT_ONCE = 100


def _frag_batch(texts: pd.Series, terms: pd.Series, size: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for ts, known, s, k in zip(texts, terms, size, n):
        known = set(known) if known is not None else set()
        out.append([fragments(t, known, int(s), int(k)) for t in ts])
    return pd.Series(out)


def highlight(page: DataFrame, papers: DataFrame, requests: DataFrame, index: TextIndex, spec: S.TextQuery,
              fields: dict[str, tuple[int, int]] = HIGHLIGHT_FIELDS, pairs: DataFrame | None = None) -> DataFrame:
    """page(query_id, id, rank) -> (query_id, id, rank, field, fragments).
    ``pairs``: ``fuzzy_pairs`` of the requests, if the search made them."""
    # the terms and the rows both read the page: it is ranked once, not for each
    page = cut_lineage(page.select("query_id", "id", "rank"), "highlight_page")
    exp = S.expansions(requests.join(page.select("query_id").distinct(), "query_id", "left_semi"), index, spec, pairs)
    exp = cut_lineage(exp.select("query_id", "field", "term"), "highlight_terms")
    words = exp.where(F.col("field").isin(list(fields)))
    for name in [f for f in spec.fields if f.endswith(".english")]:  # its stems mark the words that have them
        stems = exp.where(F.col("field") == name).select("query_id", F.lit(name.removesuffix(".english")).alias("field"), F.col("term").alias("eterm"))
        words = words.unionByName(stems.join(index.english, "eterm").select("query_id", "field", "term"))
    terms = words.groupBy("query_id", "field").agg(F.collect_set("term").alias("terms"))
    # the page meets the papers once; then a row per field that the page asks for
    rows = page.join(papers.select("id", *fields), "id")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.lit(size).alias("size"), F.lit(n).alias("n"))
                               for f, (size, n) in fields.items()])).alias("e")
    long = rows.select("query_id", "id", "rank", each).select("query_id", "id", "rank", "e.*")
    # terms are many: they go to Python once for the hits of a request, not for each
    some = F.floor(F.col("rank") / HITS_AT_ONCE).alias("some")
    hits = long.groupBy("query_id", "field", "size", "n", some).agg(F.collect_list(F.struct("id", "rank", "text")).alias("hits"))
    hits = hits.join(terms, ["query_id", "field"], "left")
    udf = F.pandas_udf(_frag_batch, T.ArrayType(T.ArrayType(T.StringType())))
    out = hits.select("query_id", "field", "hits", udf("hits.text", "terms", "size", "n").alias("found"))
    out = out.select("query_id", "field", F.inline(F.arrays_zip("hits", "found"))).select("query_id", "hits.id", "hits.rank", "field", F.col("found").alias("fragments"))
    return out.where(F.size("fragments") > 0)
