"""SQL oracles of the sync and upsert plans: the final table content."""

from __future__ import annotations

from quire.plans.oracles import FLAT, MAPPED, ORACLES

_FLAT_B = FLAT.replace("CAST(citationsCount AS BIGINT) AS citationsCount",
                       "CAST(CASE WHEN doc_id % 4 >= 2 THEN citationsCount + 1 ELSE citationsCount END AS BIGINT) AS citationsCount")
CONTENT = f"""WITH {MAPPED}
SELECT {_FLAT_B}, sha256(contextualContent) AS content FROM papers"""

for _name in ("upsert_apply", "upsert_idempotent", "stream_sync", "stream_resume", "stream_corrections"):
    ORACLES[_name] = CONTENT

ORACLES["upsert_accounting"] = f"""WITH {MAPPED}
SELECT 'A' AS batch, 'created' AS result, CAST(count(*) AS BIGINT) AS n FROM papers WHERE doc_id % 4 < 3
UNION ALL SELECT 'A', 'updated', CAST(0 AS BIGINT)
UNION ALL SELECT 'A', 'rejected', CAST(count(*) AS BIGINT) FROM m WHERE doc_id % 4 < 3 AND reason IS NOT NULL
UNION ALL SELECT 'B', 'created', CAST(count(*) AS BIGINT) FROM papers WHERE doc_id % 4 = 3
UNION ALL SELECT 'B', 'updated', CAST(count(*) AS BIGINT) FROM papers WHERE doc_id % 4 = 2
UNION ALL SELECT 'B', 'rejected', CAST(count(*) AS BIGINT) FROM m WHERE doc_id % 4 >= 2 AND reason IS NOT NULL"""

_SYNCED = """SELECT p.id, p.title, p.journal, CAST(p.publishedAt AS VARCHAR) AS published_at,
  CAST(p.citationsCount AS BIGINT) AS citationsCount, p.hasAbstract, {vector} AS has_vector
FROM papers p"""
ORACLES["sync_full"] = f"WITH {MAPPED}\n" + _SYNCED.format(
    vector="EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.doc_id AND len(e.embedding) = 64)")
ORACLES["sync_embedded"] = f"WITH {MAPPED}\n" + _SYNCED.format(vector="TRUE")

# arrivals 0 to 3 by doc_id % 4, arrival 4 again those with doc_id % 4 >= 2
_ARRIVED = "arrived AS (SELECT doc_id % 4 AS batch_id, * FROM m UNION ALL SELECT 4, * FROM m WHERE doc_id % 4 >= 2)"
ORACLES["sync_status"] = f"""WITH {MAPPED},
{_ARRIVED}
SELECT CAST(5 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS total_retrieved,
  CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS total_indexed,
  CAST(count(*) FILTER (WHERE reason IS NULL AND batch_id < 4) AS BIGINT) AS total_created,
  CAST(count(*) FILTER (WHERE reason IS NULL AND batch_id = 4) AS BIGINT) AS total_updated,
  CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS total_rejected, max(id) AS last_id, TRUE AS map_s, TRUE AS write_s FROM arrived"""
ORACLES["recent_errors"] = f"""WITH {MAPPED},
{_ARRIVED}
SELECT CAST(batch_id AS BIGINT) AS batch_id, 'rejected ' || id || ': ' || reason AS message
FROM arrived WHERE reason IS NOT NULL ORDER BY batch_id DESC, message LIMIT 50"""

ORACLES["published_state"] = f"""WITH {MAPPED}
SELECT 'stable' AS name, id, CAST(citationsCount AS BIGINT) AS citationsCount FROM papers WHERE doc_id % 4 < 3
UNION ALL SELECT 'newest', id, CAST(CASE WHEN doc_id % 4 >= 2 THEN citationsCount + 1 ELSE citationsCount END AS BIGINT) FROM papers"""

ORACLES["drop_target"] = """
WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT 'papers_' || lang AS name, 'dropped' AS outcome, n AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM n
UNION ALL SELECT '.Kibana_' || lang, 'refused', n, n FROM n
UNION ALL SELECT 'gone_' || lang, 'missing', 0, 0 FROM n"""

ORACLES["partition_distribution"] = """
SELECT coalesce(lang, 'none') AS partition, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows,
  round(count(*) / avg(count(*)) OVER (), 6) AS skew, TRUE AS measured FROM documents GROUP BY 1"""

ORACLES["profile_merged"] = ORACLES["table_profile"].replace("SELECT 'id' AS column_name", "SELECT column_name, row_count, null_count, TRUE AS near FROM (SELECT 'id' AS column_name") + ")"

ORACLES["embed_incremental"] = f"""WITH {MAPPED},
a AS (SELECT DISTINCT contextualContent FROM papers WHERE doc_id % 4 < 3),
b AS (SELECT DISTINCT contextualContent FROM papers)
SELECT CAST(0 AS BIGINT) AS pass, (SELECT count(*) FROM a) AS texts_embedded, (SELECT count(*) FROM papers WHERE doc_id % 4 < 3) AS rows_with_vector
UNION ALL SELECT 1, (SELECT count(*) FROM b) - (SELECT count(*) FROM a), (SELECT count(*) FROM papers)
UNION ALL SELECT 2, 0, (SELECT count(*) FROM papers)"""
