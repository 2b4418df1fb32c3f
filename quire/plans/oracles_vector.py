"""SQL oracles of the vector and hybrid plans (DuckDB, all pairs scored)."""

from __future__ import annotations

from quire.plans.oracles import MAPPED, ORACLES
from quire.plans.oracles_search import CONTEXTUAL, CONTEXTUAL_SORTS, SEARCH_SORTS, ranking_sql, requests_sql, scored_ctes

DV = """dv AS (SELECT p.id, CAST(e.embedding AS DOUBLE[]) AS vec FROM papers p JOIN embeddings e ON e.vec_id = p.doc_id
       WHERE len(e.embedding) = 64 AND list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) > 0)"""


def score(a: str, b: str) -> str:
    return f"round((1e0 + list_cosine_similarity({a}, {b})) / 2e0, 6)"


ORACLES["knn_exact"] = f"""WITH {MAPPED},
{DV},
qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT q.query_id, d.id, {score('q.vec', 'd.vec')} AS score FROM qv q CROSS JOIN dv d)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""

ORACLES["knn_ivf"] = ORACLES["knn_exact"]

ORACLES["related_docs"] = f"""WITH {MAPPED},
{DV},
s AS (SELECT q.id AS query_id, d.id, {score('q.vec', 'd.vec')} AS score FROM dv q JOIN dv d ON q.id <> d.id)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""

SEMANTIC = {"title": 2.0, "abstract": 1.0, "openSummary": 1.0}

ORACLES["search_hybrid"] = f"""WITH {MAPPED},
r AS ({requests_sql("vector")}),
{scored_ctes(SEMANTIC, {}, False, 0.7)},
{DV},
vs AS (SELECT r.query_id, d.id, {score('r.vec', 'd.vec')} AS vscore FROM r CROSS JOIN dv d
       WHERE r.vec IS NOT NULL AND len(r.vec) = 64),
vk AS (SELECT v.query_id, v.id, v.vscore FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vscore DESC, id) AS rk FROM vs) v
       JOIN r ON r.query_id = v.query_id WHERE v.rk <= r."from" + r.size),
comb AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id,
                round(coalesce(v.vscore, 0e0) + coalesce(t.score, 0e0), 6) AS score
         FROM vk v FULL OUTER JOIN scored t ON v.query_id = t.query_id AND v.id = t.id),
{ranking_sql("comb", SEARCH_SORTS, "latest", True)}"""


# every fourth request has no usable vector and takes the contextual search
_FALLBACK_REQUESTS = requests_sql("vector").replace("CAST(e.embedding AS DOUBLE[]) AS vec",
                                                    "CASE WHEN q.query_id % 4 <> 0 THEN CAST(e.embedding AS DOUBLE[]) END AS vec")
_HYBRID_PART = ORACLES["search_hybrid"].replace(requests_sql("vector"), f"SELECT * FROM ({_FALLBACK_REQUESTS}) WHERE vec IS NOT NULL")
_CONTEXT_PART = f"""WITH {MAPPED},
r AS (SELECT * REPLACE (NULL::BOOLEAN AS r_has_abstract) FROM ({_FALLBACK_REQUESTS}) WHERE vec IS NULL),
{scored_ctes(CONTEXTUAL, {}, True, 0.75)},
{ranking_sql("scored", CONTEXTUAL_SORTS, None)}"""
ORACLES["semantic_with_fallback"] = f"""SELECT *, 'semantic' AS search_type FROM ({_HYBRID_PART})
UNION ALL SELECT *, 'contextual' FROM ({_CONTEXT_PART})"""

ORACLES["embed_docs"] = f"""WITH {MAPPED}
SELECT id, CAST(64 AS BIGINT) AS dim, CASE WHEN trim(contextualContent) = '' THEN 'blank' ELSE 'ok' END AS embed_status FROM papers"""
ORACLES["embed_queries"] = """SELECT item_id AS query_id, CAST(64 AS BIGINT) AS dim,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' ELSE 'ok' END AS embed_status FROM benchmark"""

_STATUS = "CASE WHEN contextualContent IS NULL OR trim(contextualContent, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'blank' ELSE 'ok' END"
ORACLES["embed_fallback"] = f"""WITH {MAPPED}
SELECT {_STATUS} AS embed_status, count(*) AS n, count(*) FILTER (WHERE {_STATUS} = 'blank') AS zero_vectors FROM papers GROUP BY 1"""
