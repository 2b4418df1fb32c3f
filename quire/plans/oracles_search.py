"""SQL oracles of the text-index and search plans (DuckDB).

DuckDB's edit distance counts bytes; the oracle maps each non-ASCII letter
to a distinct ASCII symbol that never occurs inside a token before calling
it, so the distance is counted in characters as in the engine.
"""

from __future__ import annotations

from quire.functions.english import _STEP2, _STEP3, _STEP4, STOP_WORDS
from quire.plans.oracles import MAPPED, ORACLES, text_queries_sql, tokens_sql

# Oracle device: non-ASCII letters -> ASCII symbols absent from tokens.
_FROM = "àâäáãåæçèéêëìíîïñòóôöõøœßùúûüýÿ’"
_TO = "!\"#$%&()*+,-/:;<=>?@[]^`{|}~\x01\x02\x03\x04"
assert len(_FROM) == len(_TO)


def tr(x: str) -> str:
    to = _TO.replace("'", "''")
    return f"translate({x}, '{_FROM}', '{to}')"


def field_rows(fields, kw_fields) -> str:
    parts = [f"SELECT '{f}' AS field, id, {tokens_sql(f)} AS toks FROM papers" for f in fields]
    for f in kw_fields:
        parts.append(f"SELECT '{f}' AS field, id, CASE WHEN author_names = '' THEN [] "
                     f"ELSE string_split(author_names, '; ') END AS toks FROM papers")
    return " UNION ALL ".join(parts)


def index_ctes(fields, kw_fields=()) -> str:
    return f"""lt AS (SELECT * FROM ({field_rows(fields, kw_fields)}) WHERE len(toks) > 0),
fstat AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM lt GROUP BY field),
post AS (SELECT field, term, id, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT field, id, len(toks) AS dl, unnest(toks) AS term FROM lt) GROUP BY field, term, id),
tstat AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term)"""


def _vc_sql(x: str) -> str:
    """Vowels as V, consonants as C; a y is a vowel after a consonant only."""
    v = f"regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    v = f"regexp_replace({v}, '^y', 'C')"
    for _ in range(3):  # runs of y are read from the left
        v = f"replace(replace({v}, 'Vy', 'VC'), 'Cy', 'CV')"
    return v


def _m_over(x: str, n: int) -> str:
    return f"regexp_matches({_vc_sql(x)}, '^C*{'V+C+' * (n + 1)}')"


def _cvc_sql(x: str) -> str:
    return f"(regexp_matches({_vc_sql(x)}, 'CVC$') AND NOT regexp_matches({x}, '[wxy]$'))"


def _double_sql(x: str) -> str:
    return f"(length({x}) >= 2 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND right({_vc_sql(x)}, 1) = 'C')"


def _one_m(x: str) -> str:
    return f"({_m_over(x, 0)} AND NOT {_m_over(x, 1)})"


def _rules_sql(w: str, rules, cond) -> str:
    """The first rule whose suffix fits decides."""
    whens = " ".join(f"WHEN ends_with({w}, '{suf}') THEN CASE WHEN {cond(f'left({w}, length({w}) - {len(suf)})', suf)} "
                     f"THEN left({w}, length({w}) - {len(suf)}) || '{rep}' ELSE {w} END" for suf, rep in rules)
    return f"CASE {whens} ELSE {w} END"


def english_ctes(terms: str, name: str = "emap") -> str:
    """``name``(term, eterm) for the distinct terms of a table: possessives,
    stop words and the steps of the Porter algorithm, a table each."""
    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ss') THEN w "
        "WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END",
        f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m_over("left(w, length(w) - 3)", 0)} THEN left(w, length(w) - 1) ELSE w END
             WHEN ends_with(w, 'ed') AND contains({_vc_sql("left(w, length(w) - 2)")}, 'V') THEN left(w, length(w) - 2) || chr(1)
             WHEN ends_with(w, 'ing') AND contains({_vc_sql("left(w, length(w) - 3)")}, 'V') THEN left(w, length(w) - 3) || chr(1) ELSE w END""",
        "CASE WHEN NOT ends_with(w, chr(1)) THEN w ELSE left(w, length(w) - 1) || chr(2) END",
        f"""CASE WHEN NOT ends_with(w, chr(2)) THEN w WHEN regexp_matches(w, '(at|bl|iz).$') THEN left(w, length(w) - 1) || 'e'
             WHEN {_double_sql("left(w, length(w) - 1)")} AND NOT regexp_matches(w, '[lsz].$') THEN left(w, length(w) - 2)
             WHEN {_one_m("left(w, length(w) - 1)")} AND {_cvc_sql("left(w, length(w) - 1)")} THEN left(w, length(w) - 1) || 'e'
             ELSE left(w, length(w) - 1) END""",
        f"CASE WHEN ends_with(w, 'y') AND contains({_vc_sql('left(w, length(w) - 1)')}, 'V') THEN left(w, length(w) - 1) || 'i' ELSE w END",
        _rules_sql("w", _STEP2, lambda x, _: _m_over(x, 0)),
        _rules_sql("w", _STEP3, lambda x, _: _m_over(x, 0)),
        _rules_sql("w", [(x, "") for x in _STEP4],
                   lambda x, suf: _m_over(x, 1) + (f" AND regexp_matches({x}, '[st]$')" if suf == "ion" else "")),
        f"""CASE WHEN ends_with(w, 'e') AND ({_m_over("left(w, length(w) - 1)", 1)} OR {_one_m("left(w, length(w) - 1)")}
             AND NOT {_cvc_sql("left(w, length(w) - 1)")}) THEN left(w, length(w) - 1) ELSE w END""",
        f"CASE WHEN {_m_over('w', 1)} AND {_double_sql('w')} AND ends_with(w, 'l') THEN left(w, length(w) - 1) ELSE w END",
    ]
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    out = [f"""{name}_0 AS MATERIALIZED (SELECT term, w, length(w) <= 2 AS short FROM (
         SELECT DISTINCT term, regexp_replace(term, '[''’]s$', '') AS w FROM ({terms})) WHERE w <> '' AND w NOT IN ({stop}))"""]
    for i, step in enumerate(steps):
        out.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT term, short, CASE WHEN short THEN w ELSE {step} END AS w FROM {name}_{i})")
    out.append(f"{name} AS (SELECT term, w AS eterm FROM {name}_{len(steps)})")
    return ",\n".join(out)


def qterms_cte() -> str:
    return f"""qt AS (SELECT query_id, len(list_distinct(toks)) AS nq, unnest(list_distinct(toks)) AS qterm
       FROM (SELECT query_id, {tokens_sql('query')} AS toks FROM r))"""


def letters_sql(x: str) -> str:
    """A bit per character that occurs. Terms within k edits differ in at most 2k of them."""
    return f"list_aggregate(list_transform(string_split({x}, ''), lambda c: 1::BIGINT << (unicode(c) % 61)), 'bit_or')"


def fuzzy_ctes(field_list: str, with_fields: bool = True) -> str:
    return f"""qd AS (SELECT qterm, k, {letters_sql('qterm')} AS letters, length(qterm) AS n FROM (
       SELECT DISTINCT qterm, CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END AS k FROM qt)),
vocab AS (SELECT term, {letters_sql('term')} AS letters, length(term) AS n FROM (SELECT DISTINCT term FROM tstat WHERE field IN ({field_list}))),
near AS MATERIALIZED (SELECT qterm, term, k FROM qd JOIN vocab ON vocab.n BETWEEN qd.n - k AND qd.n + k
         WHERE bit_count(xor(qd.letters, vocab.letters)) <= 2 * k),
cand AS (SELECT qterm, term, k, damerau_levenshtein({tr('qterm')}, {tr('term')}) AS distance FROM near),
exp0 AS (SELECT t.field, c.qterm, c.term, c.distance FROM cand c JOIN tstat t ON t.term = c.term
         WHERE c.distance <= c.k AND t.field IN ({field_list})),
exp AS (SELECT field, qterm, term, 1e0 - distance / least(length(qterm), length(term)) AS weight FROM exp0)"""


def exact_cte(field_list: str) -> str:
    return f"""exp AS (SELECT DISTINCT t.field, q.qterm, q.qterm AS term, 1e0 AS weight
        FROM qt q JOIN tstat t ON t.term = q.qterm AND t.field IN ({field_list}))"""


ENGLISH = "contextualContent.english"


def scored_ctes(fields: dict, kw_fields: dict, fuzzy: bool, msm: float | None) -> str:
    std = {f: b for f, b in fields.items() if f != ENGLISH}
    field_list = ", ".join(f"'{f}'" for f in std) or "''"
    boosts = " ".join(f"WHEN '{f}' THEN {float(b)}e0" for f, b in {**fields, **kw_fields}.items())
    kw_union = ""
    if kw_fields:
        kw_union = " UNION ALL ".join(
            f"SELECT query_id, 1 AS nq, '{f}' AS field, query AS qterm, query AS term, 1e0 AS weight FROM r WHERE query IS NOT NULL"
            for f in kw_fields)
        kw_union = " UNION ALL " + kw_union
    where_msm = ""
    if msm is not None:
        kw_list = ", ".join(f"'{f}'" for f in kw_fields) or "''"
        where_msm = f"WHERE field IN ({kw_list}) OR matched >= greatest(1, floor({msm}e0 * nq))"
    english = ENGLISH in fields
    indexed = list(std) if not english else [*std, *(["contextualContent"] if "contextualContent" not in std else [])]
    ctes = index_ctes(indexed, kw_fields)
    if english:  # postings of the sub-field come from the standard ones
        ctes = ctes.replace("fstat AS (", "fstat_0 AS (").replace("post AS (", "post_0 AS (").replace("tstat AS (", "tstat_0 AS (").replace("FROM post GROUP", "FROM post_0 GROUP")
        ctes += f""",
r_terms AS (SELECT query_id, list_distinct({tokens_sql('query')}) AS toks FROM r),
{english_ctes("SELECT term FROM post_0 WHERE field = 'contextualContent' UNION SELECT unnest(toks) FROM r_terms")},
epost AS (SELECT '{ENGLISH}' AS field, eterm AS term, id, sum(tf) AS tf FROM post_0 JOIN emap USING (term) WHERE field = 'contextualContent' GROUP BY eterm, id),
post AS (SELECT field, term, id, tf, dl FROM post_0 UNION ALL SELECT field, term, id, tf, sum(tf) OVER (PARTITION BY id) AS dl FROM epost),
fstat AS (SELECT field, n_docs, avgdl FROM fstat_0 UNION ALL SELECT '{ENGLISH}', count(DISTINCT id), sum(tf)::DOUBLE / count(DISTINCT id) FROM epost),
tstat AS (SELECT field, term, df FROM tstat_0 UNION ALL SELECT field, term, count(*) FROM epost GROUP BY field, term),
eq AS (SELECT query_id, eterm AS qterm, count(*) OVER (PARTITION BY query_id) AS nq FROM (
       SELECT DISTINCT query_id, eterm FROM (SELECT query_id, unnest(toks) AS term FROM r_terms) JOIN emap USING (term)))"""
    if english:
        field_list += f", '{ENGLISH}'"
    terms = f"""{qterms_cte()},
{(fuzzy_ctes if fuzzy else exact_cte)(field_list)}"""
    per_request = f"SELECT qt.query_id, qt.nq, e.field, e.qterm, e.term, e.weight FROM qt JOIN exp e ON e.qterm = qt.qterm"
    if english:  # query terms of either analysis go through one expansion
        terms = terms.replace("qt AS (", "qs AS (", 1) + ""
        terms = terms.replace("(SELECT query_id, " + tokens_sql('query') + " AS toks FROM r))", "r_terms),\nqt AS (SELECT query_id, qterm FROM qs UNION SELECT query_id, qterm FROM eq)", 1)
        per_request = (f"SELECT q.query_id, q.nq, e.field, e.qterm, e.term, e.weight FROM qs q JOIN exp e ON e.qterm = q.qterm WHERE e.field <> '{ENGLISH}' "
                       f"UNION ALL SELECT q.query_id, q.nq, e.field, e.qterm, e.term, e.weight FROM eq q JOIN exp e ON e.qterm = q.qterm WHERE e.field = '{ENGLISH}'")
    return f"""{ctes},
{terms},
qexp AS ({per_request}{kw_union}),
qx AS (SELECT q.*, ln(1e0 + (f.n_docs - t.df + 0.5e0) / (t.df + 0.5e0)) AS idf, f.avgdl,
              CASE q.field {boosts} END AS boost
       FROM qexp q JOIN tstat t ON t.field = q.field AND t.term = q.term JOIN fstat f ON f.field = q.field),
hits AS (SELECT qx.query_id, qx.nq, qx.field, qx.qterm, p.id, qx.boost,
                qx.weight * qx.idf * (p.tf / (p.tf + 1.2e0 * (1e0 - 0.75e0 + 0.75e0 * p.dl / qx.avgdl))) AS s
         FROM post p JOIN qx ON p.field = qx.field AND p.term = qx.term),
pt AS (SELECT query_id, field, qterm, id, max(s) AS ts, any_value(boost) AS boost, any_value(nq) AS nq
       FROM hits GROUP BY query_id, field, qterm, id),
pf AS (SELECT * FROM (SELECT query_id, field, id, sum(ts) * any_value(boost) AS fs, count(*) AS matched, any_value(nq) AS nq
                      FROM pt GROUP BY query_id, field, id) {where_msm}),
scored AS (SELECT query_id, id, round(max(fs), 6) AS score FROM pf GROUP BY query_id, id)"""


def sort_key(sorts: dict[str, str], default: str | None) -> str:
    def k(c):
        return "CAST(date_diff('day', DATE '1970-01-01', publishedAt) AS DOUBLE)" if c == "publishedAt" else f"CAST({c} AS DOUBLE)"
    whens = " ".join(f"WHEN lower(r_sort) = '{a}' THEN {k(c)}" for a, c in sorts.items())
    other = "score" if default is None else k(sorts[default])
    return f"(CASE {whens} ELSE {other} END)"


SEARCH_SORTS = {"hot": "publicationHotScore", "top": "pageRank", "latest": "publishedAt"}
CONTEXTUAL_SORTS = {"hot": "publicationHotScore", "hotscore": "publicationHotScore", "top": "pageRank",
                    "pagerank": "pageRank", "latest": "publishedAt", "date": "publishedAt",
                    "citationscount": "citationsCount", "votescore": "voteScore"}

FILTER_SQL = """(r_journal IS NULL OR r_journal = '' OR journal = r_journal)
  AND (r_from_date IS NULL OR publishedAt >= r_from_date) AND (r_to_date IS NULL OR publishedAt <= r_to_date)
  AND (r_topics IS NULL OR len(list_filter(string_split(r_topics, ','), lambda x: x <> '')) = 0
       OR list_has_any([tname0, tname1, tname2], list_filter(string_split(r_topics, ','), lambda x: x <> '')))
  AND (r_author IS NULL OR r_author = '' OR list_contains(string_split(author_names, '; '), r_author))
  AND (r_has_abstract IS NULL OR hasAbstract = r_has_abstract)"""


def requests_sql(variant: str) -> str:
    base = f"SELECT query_id, query FROM ({text_queries_sql()})"
    nulls = ("NULL::VARCHAR AS r_journal, NULL::DATE AS r_from_date, NULL::DATE AS r_to_date, NULL::VARCHAR AS r_topics, "
             "NULL::VARCHAR AS r_author, NULL::BOOLEAN AS r_has_abstract")
    if variant == "plain":
        return f"SELECT query_id, query, 0 AS \"from\", 10 AS size, NULL::VARCHAR AS r_sort, {nulls} FROM ({base})"
    if variant == "filtered":
        return f"""SELECT query_id, query, 0 AS "from", 10 AS size, NULL::VARCHAR AS r_sort,
  CASE WHEN query_id % 7 = 3 THEN 'Journal of src' || CAST(query_id % 20 AS VARCHAR) END AS r_journal,
  CASE WHEN query_id % 2 = 0 THEN DATE '1995-01-01' END AS r_from_date,
  CASE WHEN query_id % 4 = 1 THEN DATE '2015-12-31' END AS r_to_date,
  CASE WHEN query_id % 5 = 2 THEN 'ensemble,neural networks' END AS r_topics,
  NULL::VARCHAR AS r_author,
  CASE WHEN query_id % 3 = 0 THEN TRUE WHEN query_id % 3 = 1 THEN FALSE END AS r_has_abstract
FROM ({base})"""
    if variant == "sorted":
        return (f"SELECT query_id, query, 5 AS \"from\", 10 AS size, ['hot', 'TOP', 'latest', 'relevance'][query_id % 4 + 1] AS r_sort, "
                f"{nulls} FROM ({base})")
    if variant == "contextual":
        return (f"SELECT query_id, query, 0 AS \"from\", 10 AS size, CASE WHEN query_id % 2 = 1 THEN 'date' END AS r_sort, "
                f"{nulls} FROM ({base})")
    if variant == "vector":
        return f"""SELECT q.query_id, q.query, CAST(e.embedding AS DOUBLE[]) AS vec, (q.query_id % 2) * 10 AS "from", 10 AS size,
  ['latest', 'HOT', 'top'][q.query_id % 3 + 1] AS r_sort,
  NULL::VARCHAR AS r_journal, NULL::DATE AS r_from_date, NULL::DATE AS r_to_date, NULL::VARCHAR AS r_topics,
  NULL::VARCHAR AS r_author,
  CASE WHEN q.query_id % 3 = 0 THEN TRUE WHEN q.query_id % 3 = 2 THEN FALSE END AS r_has_abstract
FROM ({base}) q LEFT JOIN embeddings e ON e.vec_id = q.query_id"""
    if variant in ("compare", "analyze"):
        size = 10 if variant == "compare" else 20
        return f"SELECT query_id, query, 0 AS \"from\", {size} AS size, 'latest' AS r_sort, {nulls} FROM ({base})"
    if variant == "contextual_sorted":
        return (f"SELECT query_id, query, 0 AS \"from\", 10 AS size, "
                f"['citationscount', 'votescore', 'pagerank', 'hotscore', 'zzz'][query_id % 5 + 1] AS r_sort, {nulls} FROM ({base})")
    raise ValueError(variant)


def ranking_sql(scored_name: str, sorts: dict, default: str | None, score_first: bool = False,
                select: str | None = None) -> str:
    sel = select or ("query_id, CAST(rank AS BIGINT) AS rank, id, score, CAST(total_hits AS BIGINT) AS total_hits "
                     "FROM ranked WHERE rank > \"from\" AND rank <= \"from\" + size")
    order = f"{sort_key(sorts, default)} DESC, id"
    if score_first:
        order = "score DESC, " + order
    return f"""j AS (SELECT s.query_id, s.score, p.*, r."from", r.size, r.r_sort,
             r.r_journal, r.r_from_date, r.r_to_date, r.r_topics, r.r_author, r.r_has_abstract
      FROM {scored_name} s JOIN papers p ON p.id = s.id JOIN r ON r.query_id = s.query_id WHERE {FILTER_SQL}),
tot AS (SELECT query_id, count(*) AS total_hits FROM j GROUP BY query_id),
ranked AS (SELECT j.*, tot.total_hits,
                  row_number() OVER (PARTITION BY j.query_id ORDER BY {order}) AS rank
           FROM j JOIN tot ON tot.query_id = j.query_id)
SELECT {sel}"""


def search_sql(variant: str, fields: dict, kw_fields: dict, fuzzy: bool, msm: float | None, sorts: dict,
               default: str | None, select: str | None = None) -> str:
    return f"""WITH {MAPPED},
r AS ({requests_sql(variant)}),
{scored_ctes(fields, kw_fields, fuzzy, msm)},
{ranking_sql("scored", sorts, default, False, select)}"""


SEARCH_FIELDS = {"title": 3.0, "abstract": 2.0, "journal": 1.0}
KW = {"authors": 1.0}
CONTEXTUAL = {"contextualContent": 3.0, ENGLISH: 2.0, "title": 2.0, "abstract": 1.0, "openSummary": 1.0}

ORACLES["tokenize"] = f"""WITH {MAPPED}
SELECT id, CAST(len({tokens_sql('title')}) AS BIGINT) AS n_tokens, array_to_string({tokens_sql('title')}, ' ') AS tokens FROM papers"""

ALL_FIELDS = ("title", "abstract", "openSummary", "contextualContent", "journal")

ORACLES["build_postings"] = f"""WITH {MAPPED},
{index_ctes(ALL_FIELDS, KW)}
SELECT field, term, id, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM post"""

ORACLES["term_stats"] = f"""WITH {MAPPED},
{index_ctes(ALL_FIELDS, KW)}
SELECT field, term, CAST(df AS BIGINT) AS df FROM tstat"""

ORACLES["bm25"] = f"""WITH {MAPPED},
r AS ({text_queries_sql()}),
{scored_ctes({"abstract": 1.0}, {}, False, None)}
SELECT query_id, id, score FROM scored"""

ORACLES["fuzzy_terms"] = f"""WITH {MAPPED},
r AS ({text_queries_sql()}),
{qterms_cte()},
tstat AS (SELECT DISTINCT 'x' AS field, unnest(toks) AS term FROM ({field_rows(ALL_FIELDS, ())})),
{fuzzy_ctes("'x'")}
SELECT qterm, term, CAST(distance AS BIGINT) AS distance FROM cand WHERE distance <= k"""

ORACLES["search_text"] = search_sql("plain", SEARCH_FIELDS, KW, True, None, SEARCH_SORTS, None)
ORACLES["search_filtered"] = search_sql("filtered", SEARCH_FIELDS, KW, True, None, SEARCH_SORTS, None)
ORACLES["search_sorted"] = search_sql("sorted", SEARCH_FIELDS, KW, True, None, SEARCH_SORTS, None)
ORACLES["total_hits"] = search_sql(
    "filtered", SEARCH_FIELDS, KW, True, None, SEARCH_SORTS, None,
    select="r.query_id, coalesce(tot.total_hits, 0) AS total_hits FROM r LEFT JOIN tot ON tot.query_id = r.query_id")
ORACLES["search_echo"] = search_sql(
    "filtered", SEARCH_FIELDS, KW, True, None, SEARCH_SORTS, None,
    select='r.query_id, r.query, CAST(r."from" AS BIGINT) AS "from", CAST(r.size AS BIGINT) AS size, r_journal AS journal, '
           "CAST(r_from_date AS VARCHAR) AS from_date, CAST(r_to_date AS VARCHAR) AS to_date, r_topics AS topics, r_has_abstract AS has_abstract, "
           "coalesce(tot.total_hits, 0) AS total_hits, '2024-12-31' AS as_of FROM r LEFT JOIN tot ON tot.query_id = r.query_id")
ORACLES["search_contextual_english"] = f"""WITH {MAPPED},
r AS ({text_queries_sql()}),
{scored_ctes({ENGLISH: 2.0}, {}, True, 0.75)}
SELECT query_id, id, score FROM scored"""
ORACLES["analyze_english"] = f"""WITH {MAPPED},
voc AS (SELECT DISTINCT unnest({tokens_sql('contextualContent')}) AS term FROM papers),
{english_ctes("SELECT term FROM voc")}
SELECT term, eterm FROM emap"""
ORACLES["search_contextual"] = search_sql("contextual", CONTEXTUAL, {}, True, 0.75, CONTEXTUAL_SORTS, None)
ORACLES["contextual_sorted"] = search_sql("contextual_sorted", CONTEXTUAL, {}, True, 0.75, CONTEXTUAL_SORTS, None)



def _pair_sql(variant: str) -> str:
    a = search_sql(variant, CONTEXTUAL, {}, True, 0.75, CONTEXTUAL_SORTS, None)
    b = search_sql(variant, SEARCH_FIELDS, KW, True, None, SEARCH_SORTS, None)
    return f"""SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id,
  a.rank AS contextual_rank, b.rank AS search_rank
FROM ({a}) a FULL OUTER JOIN ({b}) b ON a.query_id = b.query_id AND a.id = b.id"""


ORACLES["compare_search"] = _pair_sql("compare")
ORACLES["analyze_search"] = f"""SELECT query_id, CAST(count(contextual_rank) AS BIGINT) AS n_contextual,
  CAST(count(search_rank) AS BIGINT) AS n_search,
  CAST(count(*) FILTER (WHERE contextual_rank IS NOT NULL AND search_rank IS NOT NULL) AS BIGINT) AS overlap,
  round(count(*) FILTER (WHERE contextual_rank IS NOT NULL AND search_rank IS NOT NULL)
        / (count(contextual_rank) + count(search_rank)
           - count(*) FILTER (WHERE contextual_rank IS NOT NULL AND search_rank IS NOT NULL)), 6) AS jaccard,
  round(avg(CASE WHEN contextual_rank IS NOT NULL AND search_rank IS NOT NULL
                 THEN abs(contextual_rank - search_rank) END), 6) AS mean_rank_shift
FROM ({_pair_sql("analyze")}) GROUP BY query_id"""
