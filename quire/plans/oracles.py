"""DuckDB SQL oracles, one per registered query (where SQL can express it).

The oracle recomputes everything from the driver tables with plain SQL on
the *flat* fixture columns, independently of the engine's nested mapping.
Entity decoding is a replace chain with ``&amp;`` last, which equals one-pass
decoding on these tables (no nested references occur in them).
"""

from __future__ import annotations

from quire.sources.fixtures import FLAT_SOURCE_SQL, TOPIC_NAMES

WS = r"[\f\n\r\t\x0B\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
NAMES = "[" + ", ".join(f"'{n}'" for n in TOPIC_NAMES) + "]"
AS_OF = "DATE '2024-12-31'"


def decode_sql(x: str) -> str:
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
             ("&nbsp;", " "), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")]
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def clean_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace({x}, '(?i)</?jats:[^>]*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    t = decode_sql(t)
    t = f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"
    t = f"regexp_replace({t}, '(?i)^(abstract|summary){WS}*', '')"
    return f"(CASE WHEN {x} IS NULL OR regexp_full_match({x}, '{WS}*') THEN '' ELSE {t} END)"


def san(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0e0 ELSE {x} END)"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}')"


def _topic_cols() -> str:
    cols = []
    for i in range(3):
        cols += [
            f"CASE WHEN n_topics > {i} THEN {NAMES}[(doc_id + {i}) % 6 + 1] END AS tname{i}",
            f"(doc_id * {i + 3}) % 100 / 100e0 AS trel{i}",
            f"(doc_id * {i + 5}) % 1000 / 10e0 AS ttop{i}",
            f"CASE WHEN (doc_id + {i}) % 13 = 0 THEN 0e0 ELSE (doc_id * {i + 7}) % 1000 / 10e0 END AS thot{i}",
            f"CASE WHEN (doc_id + {i}) % 13 = 0 THEN 0e0 ELSE (doc_id * {i + 7}) % 1000 / 10e0 / 2 END AS thot6m{i}",
        ]
    return ",\n    ".join(cols)


MAPPED = f"""src AS ({FLAT_SOURCE_SQL.format(documents="documents")}),
m0 AS (
  SELECT *,
    {clean_sql('title_raw')} AS title,
    {clean_sql('abstract_raw')} AS abstract,
    '' AS openSummary,
    coalesce(journal_raw, '') AS journal,
    publisher_raw AS publisher,
    coalesce(doi_raw, id) AS doi,
    {san('hot_raw')} AS publicationHotScore,
    {san('hot6m_raw')} AS publicationHotScore6m,
    {san('pagerank_raw')} AS pageRank,
    citations_raw AS citationsCount,
    0 AS voteScore,
    CASE WHEN pub_year IS NULL THEN DATE '0001-01-01'
         ELSE try_cast(printf('%04d-%02d-%02d', pub_year, coalesce(pub_month, 1), coalesce(pub_day, 1)) AS DATE)
    END AS publishedAt,
    CASE WHEN pub_year IS NULL THEN '' ELSE concat_ws('-', pub_year, pub_month, pub_day) END AS date_parts,
    concat_ws('; ', trim(given_1 || ' ' || family_1),
              CASE WHEN given_2 = '' AND family_2 = '' THEN NULL ELSE trim(given_2 || ' ' || family_2) END) AS author_names,
    concat_ws(',', 'first', CASE WHEN given_2 = '' AND family_2 = '' THEN NULL ELSE 'additional' END) AS author_sequences,
    CASE WHEN given_2 = '' AND family_2 = '' THEN 1 ELSE 2 END AS n_authors,
    array_to_string(list_slice([{NAMES}[doc_id % 6 + 1], {NAMES}[(doc_id + 1) % 6 + 1], {NAMES}[(doc_id + 2) % 6 + 1]],
                               1, n_topics), ', ') AS topic_names,
    {_topic_cols()}
  FROM src),
m AS (
  SELECT *,
    abstract <> '' AS hasAbstract,
    false AS hasOpenSummary,
    concat_ws(' ', nullif(title, ''), nullif(abstract, '')) AS contextualContent,
    CASE WHEN NOT has_crossref THEN 'no_crossref'
         WHEN publishedAt IS NULL THEN 'invalid_date'
         WHEN title = '' AND abstract = '' THEN 'no_title_or_abstract' END AS reason
  FROM m0),
papers AS (SELECT * FROM m WHERE reason IS NULL)"""

FLAT = ("id, title, journal, author_names, topic_names, CAST(publishedAt AS VARCHAR) AS published_at, "
        "publicationHotScore, pageRank, CAST(citationsCount AS BIGINT) AS citationsCount, hasAbstract")


def with_papers(body: str) -> str:
    return f"WITH {MAPPED}\n{body}"


def listing_sql(order: str, where: str = "TRUE", frm: int = 0, size: int = 10) -> str:
    return with_papers(f"""
SELECT {FLAT}, rank FROM (
  SELECT *, row_number() OVER (ORDER BY {order}, id) AS rank FROM papers
  WHERE publishedAt <= {AS_OF} AND {where})
WHERE rank > {frm} AND rank <= {frm + size}""")


def topic_score(topic: str, field: str) -> str:
    parts = " ".join(f"WHEN tname{i} = '{topic}' THEN {field}{i}" for i in range(3))
    return f"(CASE {parts} ELSE 0e0 END)"


def topic_match(topic: str) -> str:
    return "(" + " OR ".join(f"tname{i} = '{topic}'" for i in range(3)) + ")"


def topic_sql(topic: str, sort: str, frm: int, size: int, select: str | None = None) -> str:
    field = {"hot": "thot", "top": "ttop", "relevance": "trel"}.get(sort)
    order = "publishedAt DESC" if field is None else f"{topic_score(topic, field)} DESC"
    sel = select or f"{FLAT}, rank"
    return with_papers(f"""
SELECT {sel} FROM (
  SELECT *, row_number() OVER (ORDER BY {order}, id) AS rank FROM papers
  WHERE publishedAt <= {AS_OF} AND {topic_match(topic)})
WHERE rank > {frm} AND rank <= {frm + size}""")


def text_queries_sql() -> str:
    return "SELECT item_id AS query_id, text AS query FROM benchmark"


ORACLES: dict[str, str] = {}

ORACLES["keyset_page"] = f"""WITH {MAPPED}
SELECT id, pagerank_raw AS pageRank, CAST(n_topics AS BIGINT) AS n_topics FROM src
WHERE id > 'p00000100' ORDER BY id LIMIT 200"""

ORACLES["sample_n"] = f"""WITH {MAPPED}
SELECT id, pagerank_raw AS pageRank FROM src
ORDER BY (doc_id * 2654435761 + 7) % 4294967291, id LIMIT 100"""

ORACLES["point_lookup"] = f"""WITH {MAPPED}
SELECT id, has_crossref AS found, CASE WHEN has_crossref THEN doi_raw END AS doi FROM src"""

ORACLES["read_sources"] = f"""WITH {MAPPED}
SELECT id, CASE WHEN ok THEN CAST(pub_year AS BIGINT) END AS year, CASE WHEN ok THEN CAST(pub_month AS BIGINT) END AS month,
  CASE WHEN ok THEN CAST(pub_day AS BIGINT) END AS day, CASE WHEN ok THEN title_raw END AS title_raw,
  CASE WHEN ok THEN doi_raw END AS doi, CASE WHEN ok THEN CAST(2 AS BIGINT) END AS n_authors,
  CASE WHEN ok THEN CAST(citations_raw AS BIGINT) END AS citations, NOT ok AS parse_error
FROM (SELECT *, doc_id % 59 <> 11 AS ok FROM src WHERE has_crossref)"""

ORACLES["join_sources"] = f"""WITH {MAPPED}
SELECT id, has_crossref AS matched FROM src"""

ORACLES["rejects_by_reason"] = f"""WITH {MAPPED}
SELECT reason, count(*) AS n FROM m WHERE reason IS NOT NULL GROUP BY reason"""

ORACLES["clean_text"] = f"SELECT page_id, {clean_sql('html')} AS text FROM pages"

ORACLES["decode_entities"] = f"SELECT page_id, {decode_sql('html')} AS decoded FROM pages"

ORACLES["sanitize_scores"] = f"""WITH {MAPPED}
SELECT id, publicationHotScore, publicationHotScore6m, pageRank FROM m"""


def _topic_sum(field: str) -> str:
    terms = " + ".join(f"(CASE WHEN n_topics > {i} THEN {field}{i} ELSE 0e0 END)" for i in range(3))
    return f"round(0e0 + {terms}, 6)"


ORACLES["map_topics"] = f"""WITH {MAPPED}
SELECT id, CAST(n_topics AS BIGINT) AS n_topics, topic_names,
  {_topic_sum('trel')} AS relevance_sum, {_topic_sum('ttop')} AS top_sum,
  {_topic_sum('thot')} AS hot_sum, {_topic_sum('thot6m')} AS hot6m_sum
FROM m"""

ORACLES["published_at"] = f"""WITH {MAPPED}
SELECT id, CAST(publishedAt AS VARCHAR) AS published_at, date_parts FROM m WHERE has_crossref"""

ORACLES["map_authors"] = f"""WITH {MAPPED}
SELECT id, author_names, author_sequences AS sequences, CAST(n_authors AS BIGINT) AS n_authors FROM m WHERE has_crossref"""

ORACLES["contextual_content"] = f"""WITH {MAPPED}
SELECT id, contextualContent FROM papers"""

ORACLES["drop_unusable"] = f"""WITH {MAPPED}
SELECT id FROM m WHERE reason = 'no_title_or_abstract'"""

ORACLES["map_paper"] = f"""WITH {MAPPED}
SELECT id, '0' AS oipubId, doi, title, abstract, openSummary, journal, publisher, author_names, date_parts,
  CAST(publishedAt AS VARCHAR) AS published_at, publicationHotScore, publicationHotScore6m, pageRank,
  CAST(citationsCount AS BIGINT) AS citationsCount, CAST(0 AS BIGINT) AS voteScore, topic_names, hasAbstract, hasOpenSummary
FROM papers"""

ORACLES["sync_summary"] = f"""WITH {MAPPED}
SELECT count(*) AS retrieved, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS skipped, max(id) AS last_id FROM m"""

ORACLES["normalize_requests"] = f"""WITH q AS ({text_queries_sql()}),
r AS (
  SELECT query_id,
    CASE WHEN query_id % 10 = 3 THEN '   ' ELSE query END AS query,
    CAST(query_id % 7 - 1 AS INTEGER) AS page,
    CAST(query_id * 13 % 130 - 10 AS INTEGER) AS per_page,
    ['HOT', 'top', 'zzz', 'latest', 'Date'][query_id % 5 + 1] AS sort
  FROM q),
n AS (
  SELECT query_id, query,
    CASE WHEN page IS NULL OR page < 1 THEN 1 ELSE page END AS page,
    CASE WHEN per_page IS NULL OR per_page < 1 OR per_page > 100 THEN 10 ELSE per_page END AS per_page,
    CASE WHEN lower(sort) IN ('hot', 'top', 'latest') THEN lower(sort) ELSE 'latest' END AS sort
  FROM r)
SELECT query_id, CAST(page AS BIGINT) AS page, CAST(per_page AS BIGINT) AS per_page, sort,
  CAST((page - 1) * per_page AS BIGINT) AS "from", CAST(per_page AS BIGINT) AS size,
  CAST(CASE WHEN query_id * 331 - 20 < 1 THEN 1000 WHEN query_id * 331 - 20 > 10000 THEN 10000 ELSE query_id * 331 - 20 END AS BIGINT) AS sync_size,
  CASE WHEN query IS NULL OR regexp_full_match(query, '{WS}*') THEN 'blank_query'
       WHEN (page - 1) * per_page + per_page > 50000 THEN 'result_window_too_large' END AS rejected_reason
FROM n"""

ORACLES["list_latest"] = listing_sql("publishedAt DESC")
ORACLES["list_hot"] = listing_sql("publicationHotScore DESC")
ORACLES["list_top"] = listing_sql("pageRank DESC")
ORACLES["list_page2"] = listing_sql("publishedAt DESC", "hasAbstract", 25, 25)
ORACLES["topic_hot"] = topic_sql("machine learning", "hot", 0, 20)
ORACLES["topic_top"] = topic_sql("ensemble", "top", 0, 20)
ORACLES["topic_relevance"] = topic_sql("data mining", "relevance", 15, 15)
ORACLES["topic_latest"] = topic_sql("microfinance", "latest", 0, 20)
ORACLES["topic_inner_hits"] = topic_sql(
    "neural networks", "hot", 0, 30,
    select=(f"id, rank, {topic_score('neural networks', 'trel')} AS relevanceScore, "
            f"{topic_score('neural networks', 'ttop')} AS topScore, {topic_score('neural networks', 'thot')} AS hotScore"))

ORACLES["filter_journal"] = with_papers(f"SELECT {FLAT} FROM papers WHERE journal = 'Journal of src3'")
ORACLES["filter_journal_term"] = with_papers(
    f"SELECT {FLAT} FROM papers WHERE list_contains({tokens_sql('journal')}, 'src3')")
ORACLES["filter_dates"] = with_papers(
    f"SELECT {FLAT} FROM papers WHERE publishedAt >= DATE '2000-01-01' AND publishedAt <= DATE '2010-06-30'")
ORACLES["filter_topics"] = with_papers(f"SELECT {FLAT} FROM papers WHERE {topic_match('ensemble')} OR {topic_match('data mining')}")
ORACLES["filter_author"] = with_papers(f"SELECT {FLAT} FROM papers WHERE list_contains(string_split(author_names, '; '), 'Co Author3')")
ORACLES["filter_has_abstract"] = with_papers(f"SELECT {FLAT} FROM papers WHERE NOT hasAbstract")
ORACLES["select_fields"] = with_papers(
    "SELECT id, title, publicationHotScore AS hotScore, pageRank, CAST(citationsCount AS BIGINT) AS citationsCount FROM papers")
ORACLES["page_metadata"] = with_papers(f"""
, t AS (SELECT count(*) AS total FROM papers WHERE publishedAt <= {AS_OF})
SELECT rank, id, CAST(total AS BIGINT) AS totalItems, CAST(ceil(total / 10) AS BIGINT) AS totalPages,
  3 < CAST(ceil(total / 10) AS BIGINT) AS hasNextPage
FROM (SELECT id, row_number() OVER (ORDER BY publishedAt DESC, id) AS rank FROM papers WHERE publishedAt <= {AS_OF}), t
WHERE rank > 20 AND rank <= 30""".replace("\n, t AS", ", t AS", 1))

ORACLES["total_count"] = with_papers("SELECT CAST(count(*) AS BIGINT) AS total FROM papers")

ORACLES["duplicate_ids"] = f"""WITH {MAPPED},
u AS (SELECT id FROM src WHERE doc_id % 4 < 3 UNION ALL SELECT id FROM src WHERE doc_id % 4 >= 2)
SELECT id, CAST(count(*) AS BIGINT) AS doc_count, CAST(count(id) AS BIGINT) AS value_count
FROM u GROUP BY id HAVING count(*) >= 2"""


def _profile_sql() -> str:
    topic = [f"CASE WHEN n_topics > {i} THEN concat_ws('|', tname{i}, trel{i}, ttop{i}, thot{i}, thot6m{i}) END" for i in range(3)]
    cols = {c: c for c in (
        "id", "doi", "title", "abstract", "openSummary", "journal", "publisher", "publicationHotScore", "publicationHotScore6m",
        "pageRank", "citationsCount", "voteScore", "hasAbstract", "hasOpenSummary", "publishedAt", "contextualContent")}
    cols |= {"oipubId": "'0'", "authors": "concat(author_names, '/', author_sequences)", "publicationDateParts": "date_parts",
             "topics": f"concat_ws('/', n_topics, {', '.join(topic)})", "embeddingVector": "CAST(embedding AS VARCHAR)"}
    parts = [f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS row_count, "
             f"CAST(count(*) FILTER (WHERE {x} IS NULL) AS BIGINT) AS null_count, "
             f"CAST(count(DISTINCT {x}) AS BIGINT) AS distinct_count FROM pe" for c, x in cols.items()]
    return with_papers(", pe AS (SELECT p.*, e.embedding FROM papers p LEFT JOIN embeddings e ON e.vec_id = p.doc_id AND len(e.embedding) = 64)\n"
                       + "\nUNION ALL\n".join(parts)).replace("\n, pe AS", ", pe AS", 1)


ORACLES["table_profile"] = _profile_sql()

ORACLES["data_distribution"] = with_papers("""
, b AS (SELECT (CAST(substr(id, 2) AS BIGINT) * 2654435761 % 4294967291) % 16 AS bucket, count(*) AS n_rows
        FROM papers GROUP BY 1),
s AS (SELECT min(n_rows) AS mn, max(n_rows) AS mx, avg(n_rows) AS av FROM b)
SELECT CAST(bucket AS BIGINT) AS bucket, CAST(n_rows AS BIGINT) AS n_rows, CAST(mn AS BIGINT) AS min_rows,
  CAST(mx AS BIGINT) AS max_rows, round(mx / av, 6) AS skew FROM b, s""".replace("\n, b AS", ", b AS", 1))

ORACLES["author_profiles"] = with_papers("""
, a AS (SELECT id, citationsCount, publishedAt, unnest(string_split(author_names, '; ')) AS author FROM papers)
SELECT author, '' AS orcid, CAST(count(*) AS BIGINT) AS n_papers, CAST(sum(citationsCount) AS BIGINT) AS citations,
  CAST(min(year(publishedAt)) AS BIGINT) AS first_year, CAST(max(year(publishedAt)) AS BIGINT) AS last_year
FROM a GROUP BY author""".replace("\n, a AS", ", a AS", 1))

ORACLES["journal_by_year"] = with_papers("""
SELECT journal, CAST(year(publishedAt) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n_papers,
  CAST(sum(citationsCount) AS BIGINT) AS citations, round(avg(publicationHotScore), 6) AS avg_hot
FROM papers GROUP BY 1, 2""")


def _topic_rows() -> str:
    parts = [f"SELECT id, citationsCount, pageRank, tname{i} AS topic, thot{i} AS hot, ttop{i} AS top "
             f"FROM papers WHERE n_topics > {i}" for i in range(3)]
    return " UNION ALL ".join(parts)


ORACLES["topic_trends"] = with_papers(f"""
, t AS ({_topic_rows()})
SELECT topic, CAST(count(*) AS BIGINT) AS n_papers, round(avg(hot), 6) AS avg_topic_hot, round(avg(top), 6) AS avg_topic_top,
  CAST(sum(citationsCount) AS BIGINT) AS citations, round(avg(pageRank), 6) AS avg_pagerank
FROM t GROUP BY topic""".replace("\n, t AS", ", t AS", 1))

ORACLES["parse_payload"] = """
SELECT event_id, CASE WHEN json_valid(p) THEN CAST(json_extract(p, '$.k') AS BIGINT) END AS k, p IS NOT NULL AND NOT json_valid(p) AS parse_error
FROM (SELECT event_id, CASE WHEN event_id % 97 = 3 THEN substr(props, 1, length(props) - 1) ELSE props END AS p FROM events)"""

ORACLES["protected_names"] = """
WITH d AS (SELECT DISTINCT source, lang FROM documents),
n AS (SELECT DISTINCT unnest([source, '.Kibana_' || source, '.security-' || lang, 'papers_' || lang, '.OpenSearch-' || source]) AS name FROM d)
SELECT name, (lower(name) LIKE '.opensearch%' OR lower(name) LIKE '.security%' OR lower(name) LIKE '.kibana%'
              OR lower(name) LIKE '.opendistro%') AS protected FROM n"""

ORACLES["vector_dim_check"] = """
SELECT vec_id, CAST(len(v) AS BIGINT) AS dim, len(v) = 64 AND list_dot_product(v, v) > 0 AS valid FROM (
  SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_slice(embedding, 1, 63)::DOUBLE[]
    WHEN vec_id % 10 = 7 THEN list_transform(embedding, lambda x: 0::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings)"""


ORACLE_EXTENSIONS = ("quire.plans.oracles_search", "quire.plans.oracles_vector", "quire.plans.oracles_sync")


def all_oracles() -> dict[str, str]:
    import importlib
    for mod in ORACLE_EXTENSIONS:
        importlib.import_module(mod)
    return dict(ORACLES)
