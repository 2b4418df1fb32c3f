"""Relevance-scored text search for whole tables of requests.

Data flow (one Spark job for any number of requests):

  requests -> query terms -> (fuzzy) expansions per field  [small side]
           -> postings put together by document, in its bucket
           -> BM25 per (field, term, doc), best expansion per query term, sum
              per field x boost, minimum-should-match per field, max over
              fields (best_fields): arrays of documents x requests (scoring.py)
           -> per-request filters, sort, best rows and counts of a task
           -> page (row_number over these)

A stored index is bucketed by document, so all steps up to the page cut run
where the postings are read: neither postings nor matches are shuffled or
written. An index that is not stored is joined with the expansions instead
(``_per_field``), where a minimum of matches lets only documents through that
have one of the rarest terms of a field (prefix filter, see scored_parts).

Scoring pins: BM25 (k1=1.2, b=0.75, no (k1+1) factor), idf
ln(1 + (N - df + 0.5) / (df + 0.5)) with per-field statistics over the whole
table, fuzzy weight 1 - d / min(len), scores rounded to 6 decimals before
ordering; ties by id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.fuzzy import fuzzy_candidates, fuzzy_expansions
from quire.functions.text import tokens
from quire.operators.index import TextIndex, postings_of, term_hash
from quire.operators.requests import MAX_WINDOW
from quire.operators.scoring import page_rows, request_arrays, scorer
from quire.session import checked_broadcast, cut_lineage

# BM25 parameters.
K1 = 1.2
B = 0.75

# Field boosts of each request type.
SEARCH_FIELDS = {"title": 3.0, "abstract": 2.0, "journal": 1.0}
SEARCH_KEYWORD_FIELDS = {"authors": 1.0}
CONTEXTUAL_FIELDS = {"contextualContent": 3.0, "contextualContent.english": 2.0, "title": 2.0,
                     "abstract": 1.0, "openSummary": 1.0}
SEMANTIC_TEXT_FIELDS = {"title": 2.0, "abstract": 1.0, "openSummary": 1.0}

# Sort name -> column for each request type (all descending).
SEARCH_SORTS = {"hot": "publicationHotScore", "top": "pageRank", "latest": "publishedAt"}
CONTEXTUAL_SORTS = {"hot": "publicationHotScore", "hotscore": "publicationHotScore", "top": "pageRank",
                    "pagerank": "pageRank", "latest": "publishedAt", "date": "publishedAt",
                    "citationscount": "citationsCount", "votescore": "voteScore"}


@dataclass
class TextQuery:
    fields: dict[str, float]
    keyword_fields: dict[str, float] = field(default_factory=dict)
    fuzzy: bool = True
    min_should_match: float | None = None
    max_expansions: int | None = None


def query_terms(requests: DataFrame) -> DataFrame:
    """(query_id, nq, q, qterm): distinct analysed terms, numbered, and how
    many a request has."""
    toks = requests.select("query_id", F.array_distinct(tokens("query")).alias("qts"))
    return toks.select("query_id", F.size("qts").alias("nq"), F.posexplode("qts").alias("q", "qterm"))


def english_query_terms(qterms: DataFrame) -> DataFrame:
    """The same for English sub-fields: stop words dropped, distinct stems
    under the number of their first term."""
    from quire.functions.english import english_map
    forms = english_map(qterms.select(F.col("qterm").alias("term"))).select(F.col("term").alias("qterm"), "eterm")
    stems = qterms.join(forms, "qterm").groupBy("query_id", F.col("eterm").alias("qterm")).agg(F.min("q").alias("q"))
    counts = stems.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("nq"))
    return stems.join(counts, "query_id").select("query_id", "nq", "q", "qterm")


def expansions(requests: DataFrame, index: TextIndex, spec: TextQuery, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, nq, q, field, qterm, term, weight): every field sees the query
    in its own analysis and expands it against its own vocabulary."""
    terms, known = term_expansions(requests, index, spec, pairs)
    return terms.join(known, ["field", "qterm"]).select("query_id", "nq", "q", "field", "qterm", "term", "weight")


def analysed_terms(requests: DataFrame, index: TextIndex, spec: TextQuery) -> list[tuple[DataFrame, list[str]]]:
    """The requests' terms in each analysis, and the fields that have it."""
    std = [f for f in spec.fields if not f.endswith(".english")]
    eng = [f for f in spec.fields if f.endswith(".english")]
    if eng and index.english is None:
        raise ValueError(f"the index has no English sub-field, but {eng} are asked for")
    qt = query_terms(requests)
    return ([(qt, std)] if std else []) + ([(english_query_terms(qt), eng)] if eng else [])


def fuzzy_pairs(requests: DataFrame, index: TextIndex, *specs: TextQuery) -> DataFrame:
    """(qterm, term, distance): one search of the vocabulary for the terms of
    all analyses; searches and highlights of the same requests can share it."""
    asked = None
    for spec in specs:
        for terms, _ in analysed_terms(requests, index, spec):
            asked = terms.select("qterm") if asked is None else asked.unionByName(terms.select("qterm"))
    return cut_lineage(fuzzy_candidates(asked, index.term_stats.select("term"), index.variants), "fuzzy_terms")


def term_expansions(requests: DataFrame, index: TextIndex, spec: TextQuery, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same in two tables: the terms (query_id, nq, q, field, qterm) of the
    requests, and (field, qterm, term, weight) once for every distinct term.
    ``pairs``: what ``fuzzy_pairs`` found for these or more requests."""
    if not spec.fuzzy:
        pairs = None
    elif pairs is None:
        pairs = fuzzy_pairs(requests, index, spec)
    asked, known = None, None
    for terms, fields in analysed_terms(requests, index, spec):
        some = terms.select("query_id", "nq", "q", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), "qterm")
        found = _expand(terms, index, spec, fields, pairs).select("field", "qterm", "term", "weight")
        asked, known = (some, found) if asked is None else (asked.unionByName(some), known.unionByName(found))
    return asked, known


def _expand(qterms: DataFrame, index: TextIndex, spec: TextQuery, fields: list[str], pairs: DataFrame | None) -> DataFrame:
    ts = index.term_stats.where(F.col("field").isin(fields))
    if pairs is not None:
        exp = fuzzy_expansions(pairs.join(qterms.select("qterm").distinct(), "qterm", "left_semi"), ts, spec.max_expansions)
        w = F.lit(1.0) - F.col("distance") / F.least(F.length("qterm"), F.length("term"))
        return exp.select("field", "qterm", "term", w.alias("weight"))
    q = qterms.select("qterm").distinct()
    return q.join(ts.select("field", F.col("term").alias("qterm")), "qterm").select(
        "field", "qterm", F.col("qterm").alias("term"), F.lit(1.0).alias("weight"))


def scored_parts(requests: DataFrame, index: TextIndex, spec: TextQuery, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What scoring needs of the requests' expansions; the size of the requests,
    not the corpus: (field, term, part, w, avgdl) and (query_id, slot, part, rare).

    A part numbers a field and an analysed query term: what a document scores
    for it is the same in all requests that have it. A slot is one number for
    field, query term and its request's number of terms. With a minimum of m of
    a field's n terms a document lacks n - m at most, so it has j of the
    n - m + j terms with the fewest postings (terms that no document has are
    first among these), for any j: those are ``rare`` (j: a third of m). A field
    with fewer than m terms that any document has can't match and is left out.
    """
    boosts = {**spec.fields, **spec.keyword_fields}
    code = {f: i for i, f in enumerate(boosts)}
    terms, known = term_expansions(requests, index, spec, pairs)
    if spec.keyword_fields:
        kw = requests.select("query_id", F.col("query").alias("qterm")).where(F.col("qterm").isNotNull())
        kw = kw.select("query_id", F.lit(1).alias("nq"), F.lit(0).alias("q"),
                       F.explode(F.array(*[F.lit(f) for f in spec.keyword_fields])).alias("field"), "qterm")
        terms = terms.unionByName(kw)
        known = known.unionByName(kw.select("field", "qterm", F.col("qterm").alias("term"), F.lit(1.0).alias("weight")).distinct())
    known = cut_lineage(known.join(index.term_stats, ["field", "term"]), "query_terms")
    parts = known.groupBy("field", "qterm").agg(F.sum("df").alias("moves")).withColumn("part", F.monotonically_increasing_id())
    parts = cut_lineage(parts, "query_parts")
    asked = terms.join(parts, ["field", "qterm"])
    if spec.min_should_match is not None:
        asked = cut_lineage(asked, "asked_terms")
        sizes = asked.groupBy("query_id", "field", "nq", "q").agg(F.sum("moves").alias("moves"))
        need = F.when(F.col("field").isin(list(spec.keyword_fields)), F.lit(1)).otherwise(least_matches(spec))
        by_size = Window.partitionBy("query_id", "field").orderBy("moves", "q")
        sizes = sizes.withColumn("missing", F.col("nq") - F.count(F.lit(1)).over(Window.partitionBy("query_id", "field")))
        sizes = sizes.where(F.col("missing") <= F.col("nq") - need).withColumn(
            "rare", F.row_number().over(by_size) + F.col("missing") <= F.col("nq") - need + least_rare(need))
        asked = asked.join(sizes.select("query_id", "field", "q", "rare"), ["query_id", "field", "q"])
    else:
        asked = asked.withColumn("rare", F.lit(True))
    field_code = F.element_at(F.create_map(*[F.lit(x) for kv in code.items() for x in kv]), F.col("field")).cast("long")
    slot = (F.shiftleft(field_code, 56).bitwiseOR(F.shiftleft(F.col("q").cast("long"), 28)).bitwiseOR(F.col("nq").cast("long")))
    asked = checked_broadcast(asked.select("query_id", slot.alias("slot"), "part", "rare").distinct(), name="asked_parts")
    known = (known.join(parts.drop("moves"), ["field", "qterm"]).join(F.broadcast(index.field_stats), "field")
             .withColumn("idf", F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
             .select("field", "term", "part", (F.col("weight") * F.col("idf")).alias("w"), "avgdl"))
    return cut_lineage(known, "scored_terms"), asked


def scored_terms(requests: DataFrame, index: TextIndex, spec: TextQuery) -> DataFrame:
    """(query_id, field, term, slot, w, avgdl, rare): both tables in one, a row
    per request and expansion."""
    known, asked = scored_parts(requests, index, spec)
    return known.join(asked, "part").select("query_id", "field", "term", "slot", "w", "avgdl", "rare")


def least_matches(spec: TextQuery) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(spec.min_should_match) * F.col("nq")))


def least_rare(need: Column) -> Column:
    """How many of the rare terms a document with ``need`` terms has at least."""
    return F.greatest(F.lit(1), F.floor(need / 3))


def _parts(index: TextIndex, known: DataFrame, score: Column | None, fuzzy: bool, *extra: str) -> DataFrame:
    """(doc, part, ts): what every document scores for every query term in
    every field, its best expansion; once for all requests that have the term."""
    near = known.groupBy("field", "term", "avgdl").agg(F.collect_list(F.struct("part", "w")).alias("near"))
    near = checked_broadcast(near, name="near_terms")
    met = postings_of(index, near).select("field", "term", "doc", *extra).join(near, ["field", "term"])
    met = met.select("doc", *extra, "avgdl", F.inline("near"))
    if score is None:
        met = met.select("doc", "part")
        return met.distinct() if fuzzy else met
    met = met.select("doc", "part", score.alias("ts"))
    return met.groupBy("doc", "part").agg(F.max("ts").alias("ts")) if fuzzy else met  # else a term is its only expansion


def _per_field(index: TextIndex, known: DataFrame, asked: DataFrame, spec: TextQuery, score: Column | None, *extra: str) -> DataFrame:
    """(query_id, doc, field, fs, matched, nq) of the fields that match: the
    best expansion per query term, summed. All of it happens inside a bucket of
    the stored index: joins and groupings are on supersets of ``doc``."""
    boosts = {**spec.fields, **spec.keyword_fields}
    code = {f: i for i, f in enumerate(boosts)}
    field = F.shiftright("slot", 56).cast("int")
    nq = F.max(F.col("slot").bitwiseAND(F.lit((1 << 28) - 1))).alias("nq")
    # texts under one query_id number their terms alike: a slot of several terms counts once, with its best
    shared = not asked.groupBy("query_id", "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    hits = _parts(index, known, score, spec.fuzzy, *extra).join(asked, "part").select("query_id", "doc", "slot", *(["ts"] if score is not None else []))
    if spec.min_should_match is not None:
        rare = asked.where("rare")
        some = known.join(F.broadcast(rare.select("part").distinct()), "part", "left_semi")
        few = _parts(index, some, None, spec.fuzzy).join(rare, "part").select("query_id", "doc", "slot")
        few = few.distinct() if shared else few
        few = few.groupBy("query_id", "doc", field.alias("field")).agg(F.count(F.lit(1)).alias("n"), nq)
        enough = F.when(F.col("field").isin([code[f] for f in spec.keyword_fields]), F.lit(1)).otherwise(least_rare(least_matches(spec)))
        few = few.where(F.col("n") >= enough).select("query_id", "doc", "field").hint("shuffle_hash")
        hits = hits.withColumn("field", field).join(few, ["query_id", "doc", "field"], "left_semi").drop("field")
    best = [F.max("ts").alias("ts")] if score is not None else [F.count(F.lit(1)).alias("_n")]
    per_slot = hits.groupBy("query_id", "doc", "slot").agg(*best) if shared else hits
    sums = [F.sum("ts").alias("fs")] if score is not None else []
    per_field = per_slot.groupBy("query_id", "doc", field.alias("field")).agg(*sums, F.count(F.lit(1)).alias("matched"), nq)
    if spec.min_should_match is not None:
        per_field = per_field.where(F.col("field").isin([code[f] for f in spec.keyword_fields]) | (F.col("matched") >= least_matches(spec)))
    return per_field


def score_documents(requests: DataFrame, index: TextIndex, spec: TextQuery) -> DataFrame:
    """(query_id, doc, score) for every document matching at least one field."""
    if index.stored:
        return _matches_of_documents(requests, index, spec).select("query_id", "doc", "score")
    boosts = {**spec.fields, **spec.keyword_fields}
    tfn = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    per_field = _per_field(index, *scored_parts(requests, index, spec), spec, F.col("w") * tfn, "tf", "dl")
    boost = F.element_at(F.array(*[F.lit(float(b)) for b in boosts.values()]), F.col("field") + 1)
    return per_field.groupBy("query_id", "doc").agg(F.round(F.max(F.col("fs") * boost), 6).alias("score"))


def matching_documents(requests: DataFrame, index: TextIndex, spec: TextQuery) -> DataFrame:
    """(query_id, doc) of the same documents, without reading or computing
    what only a score needs."""
    if index.stored:
        return _matches_of_documents(requests, index, spec, scored=False).select("query_id", "doc")
    known, asked = scored_parts(requests, index, spec)
    if spec.min_should_match is None:
        return _parts(index, known, None, spec.fuzzy).join(asked, "part").select("query_id", "doc").distinct()
    return _per_field(index, known, asked, spec, None).select("query_id", "doc").distinct()


def score_requests(requests: DataFrame, index: TextIndex, spec: TextQuery) -> DataFrame:
    """(query_id, id, score) for every document matching at least one field."""
    if index.stored:
        return _matches_of_documents(requests, index, spec, ("id",)).select("query_id", "id", "score")
    scored = score_documents(requests, index, spec)
    return scored.join(index.docs.select("doc", "id"), "doc").select("query_id", "id", "score")


#: Expansions (field, term, query term), and query terms of requests, that tasks
#: hold at once; a batch with more is scored in groups of its requests.
MAX_PAIRS = 8_000_000
MAX_ASKED = 2_000_000
#: Distinct (field, term) up to which postings of others are left out before they are put together.
MAX_KEYS = 1_000_000


def _matches_of_documents(requests: DataFrame, index: TextIndex, spec: TextQuery, columns: tuple[str, ...] = (), scored: bool = True,
                          pairs: DataFrame | None = None) -> DataFrame:
    """(doc, columns, query_id, score) of a stored index, a row per match. A
    document's postings are put together in its bucket and scored for all
    requests at once, so neither postings nor matches are shuffled; ``columns``
    of ``index.docs`` come with the document. Field and term travel as a hash
    that is unique over the vocabulary (``hash_seed``)."""
    known, asked = scored_parts(requests, index, spec, pairs)
    known = known.withColumn("h", term_hash(index))
    groups = max(-(-known.count() // MAX_PAIRS), -(-asked.count() // MAX_ASKED), 1)
    out = None
    for g in range(groups):
        some, terms = asked, known
        if groups > 1:
            some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
            terms = known.join(some.select("part").distinct(), "part", "left_semi")
        one = _matches_of_group(terms, some, index, spec, columns, scored)
        out = one if out is None else out.unionByName(one)
    return out


def _matches_of_group(known: DataFrame, asked: DataFrame, index: TextIndex, spec: TextQuery, columns: tuple[str, ...], scored: bool) -> DataFrame:
    spark = known.sparkSession
    boosts = {**spec.fields, **spec.keyword_fields}
    code = {f: i for i, f in enumerate(boosts)}
    avgdl = {code[r["field"]]: r["avgdl"] for r in index.field_stats.where(F.col("field").isin(list(code))).collect()}
    arrays = request_arrays(known.select("h", "part", "w").toArrow(), asked.select("query_id", "slot", "part").toArrow(), avgdl,
                            [float(b) for b in boosts.values()], spec.min_should_match, {code[f] for f in spec.keyword_fields})
    met = postings_of(index, known).where(F.col("field").isin(list(code)))
    met = met.select("doc", term_hash(index).alias("h"), *([F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")] if scored else []))
    if len(arrays["keys"]) <= MAX_KEYS:
        met = met.join(F.broadcast(cut_lineage(known.select("h").distinct(), "term_keys")), "h", "left_semi")
    met = met.groupBy("doc").agg(F.collect_list(F.struct("h", "tf", "dl") if scored else F.col("h")).alias("met"))
    if columns:
        met = met.join(index.docs.select("doc", *columns), "doc")
    hit = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*[f for f in met.schema.fields if f.name != "met"], T.StructField("hits", T.ArrayType(hit))])
    found = met.mapInArrow(scorer(spark.sparkContext.broadcast(arrays), to_arrow_schema(schema), K1, B, scored), schema)
    found = found.select("doc", *columns, F.inline("hits"))
    return found.withColumn("score", F.round("score", 6)) if scored else found.drop("score")


def request_filter(names) -> Column:
    """Per-request non-scoring filters over the ``r_*`` request columns of
    ``names`` (null = no filter)."""
    c = lambda n: F.col(f"r_{n}")
    topics = F.filter(F.split(F.coalesce(c("topics"), F.lit("")), ",", -1), lambda t: t != "")
    filters = {
        "journal": lambda: c("journal").isNull() | (c("journal") == "") | (F.col("journal") == c("journal")),
        "from_date": lambda: c("from_date").isNull() | (F.col("publishedAt") >= c("from_date")),
        "to_date": lambda: c("to_date").isNull() | (F.col("publishedAt") <= c("to_date")),
        "topics": lambda: (F.size(topics) == 0) | F.arrays_overlap(F.transform(F.col("topics"), lambda t: t["name"]), topics),
        "author": lambda: c("author").isNull() | (c("author") == "") | F.exists(F.col("authors"), lambda a: a["name"] == c("author")),
        "has_abstract": lambda: c("has_abstract").isNull() | (F.col("hasAbstract") == c("has_abstract")),
    }
    out = F.lit(True)
    for n in filters:
        out = out & filters[n]() if n in names else out
    return out


#: What the filters of requests read of a document.
FILTERED_COLUMNS = {"journal": "journal", "topics": "topics", "author": "authors", "has_abstract": "hasAbstract"}


def _read_by(requests: DataFrame) -> list[str]:
    """Columns of a document that pages and the filters of ``requests`` read."""
    return ["id", *SORT_KEYS, *[c for n, c in FILTERED_COLUMNS.items() if n in requests.columns]]


def page_window(df: DataFrame, order: list[Column], max_window: int) -> DataFrame:
    """Rank per request; the literal bound lets Spark cut each group to
    ``max_window`` rows before the shuffle (partial WindowGroupLimit), so a
    request matching a third of the table still moves only a page's worth."""
    w = Window.partitionBy("query_id").orderBy(*order, F.col("id").asc())
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_window)
    return ranked.where((F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("from") + F.col("size")))


def max_window(requests: DataFrame) -> int:
    """Largest from+size among the requests: one scalar from the small request table."""
    row = requests.agg(F.max(F.col("from") + F.col("size")).alias("m")).first()
    window = int(row["m"] or 0) or 1
    if window > MAX_WINDOW:
        raise ValueError(f"from + size is {window}; at most {MAX_WINDOW} is allowed")
    return window


def sort_columns(sort: Column, mapping: dict[str, str], score_first: bool, default: str | None) -> list[Column]:
    """Request-dependent order, all descending: a CASE per sort alias yields the key."""
    def key_for(colname):
        return F.col(colname).cast("double") if colname != "publishedAt" else F.datediff(F.col("publishedAt"), F.lit("1970-01-01").cast("date")).cast("double")
    key = None
    for alias, colname in mapping.items():
        key = (F.when(sort == alias, key_for(colname)) if key is None else key.when(sort == alias, key_for(colname)))
    if default is None:
        key = key.otherwise(F.col("score"))
    else:
        key = key.otherwise(key_for(mapping[default]))
    return [F.col("score"), key] if score_first else [key]


REQUEST_FILTERS = [("journal", "string"), ("from_date", "date"), ("to_date", "date"), ("topics", "string"),
                   ("author", "string"), ("has_abstract", "boolean"), ("sort", "string")]


def with_filters(requests: DataFrame) -> DataFrame:
    for c, t in REQUEST_FILTERS:
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast(t))
    return requests


def _filtered(found: DataFrame, papers: DataFrame, index: TextIndex, requests: DataFrame, *columns: str) -> DataFrame:
    """Rows (query_id, doc or id, ...) that their request's filters let pass,
    with the id and the sort columns. Rows that lack these meet what the index
    keeps of a document by ``doc``, or the papers by id."""
    asked = [c for c, _ in REQUEST_FILTERS if c in requests.columns]
    r = checked_broadcast(with_filters(requests).select("query_id", "from", "size", *[F.col(c).alias(f"r_{c}") for c in dict.fromkeys([*asked, "sort"])]))
    kept = _read_by(requests)
    if set(kept) <= set(found.columns):
        joined = found
    elif "doc" in found.columns:
        joined = found.join(index.docs.select("doc", *kept), "doc")
    else:
        joined = found.join(papers.select(*kept), "id")
    return joined.join(r, "query_id").where(request_filter(asked)).select("query_id", "id", *columns, "from", "size", "r_sort", *SORT_KEYS)


def matches(papers: DataFrame, index: TextIndex, requests: DataFrame, spec: TextQuery, scored: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Every document that a request scores and its filters let pass, with the
    sort columns."""
    texts = requests.select("query_id", "query")
    if scored is None:
        scored = _matches_of_documents(texts, index, spec, tuple(_read_by(requests)), pairs=pairs) if index.stored else score_documents(texts, index, spec)
    return _filtered(scored, papers, index, requests, "score")


def page_candidates(matched: DataFrame, order: list[Column], window: int) -> DataFrame:
    """Of every request and partition the ``window`` best rows by ``order``
    (descending) and id, with ``hits``: the first one has the number of rows
    that the request had there. So matches are neither written nor sorted as a
    whole; totals and pages need no others."""
    keys = [f"_key{i}" for i in range(len(order))]
    rows = matched.select("*", *[o.alias(k) for o, k in zip(order, keys)])
    schema = T.StructType([*rows.schema.fields, T.StructField("hits", T.LongType())])
    return cut_lineage(rows.mapInArrow(page_rows(window, keys), schema), "search_candidates")


def totals(requests: DataFrame, matched: DataFrame) -> DataFrame:
    """(query_id, total_hits) of every request, those without a hit too;
    ``matched`` has a row per match, or ``hits`` that stand for several."""
    counts = matched.groupBy("query_id").agg((F.sum("hits") if "hits" in matched.columns else F.count(F.lit(1))).alias("total_hits"))
    return requests.select("query_id").join(counts, "query_id", "left").fillna(0, ["total_hits"])


def search_totals(papers: DataFrame, index: TextIndex, requests: DataFrame, spec: TextQuery | None = None) -> DataFrame:
    """Exact number of hits per request, whatever page it asks for: no score is
    computed and no match written. A document's postings lie in one bucket, so
    its matches are told apart there and only counts per request are shuffled."""
    texts, spec = requests.select("query_id", "query"), spec or DEFAULT_SPEC
    if index.stored:
        found = _matches_of_documents(texts, index, spec, tuple(_read_by(requests)), scored=False)
    else:
        found = matching_documents(texts, index, spec)
    return totals(requests, _filtered(found, papers, index, requests))


def echo(requests: DataFrame, total: DataFrame, as_of: str) -> DataFrame:
    """What a response says beside its hits: the request's parameters, its
    exact total (query_id, total_hits) and the date it holds for."""
    r = with_filters(requests).select("query_id", "query", "from", "size", *[c for c, _ in REQUEST_FILTERS])
    return r.join(total, "query_id").withColumn("as_of", F.lit(as_of).cast("date"))


def search(papers: DataFrame, index: TextIndex, requests: DataFrame, spec: TextQuery | None = None,
           sorts: dict[str, str] = SEARCH_SORTS, default_sort: str | None = None, score_first: bool = False,
           with_total: bool = True, scored: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Search requests -> hits (query_id, rank, id, score, total_hits, sort columns).

    ``requests`` columns: query_id, query, from, size and optional sort and
    filter columns journal, from_date, to_date, topics, author, has_abstract.
    Filters run after scoring (they never change the statistics) and
    before ranking; the exact total is counted before the page cut. A request
    whose from + size passes MAX_WINDOW is refused. ``pairs``: ``fuzzy_pairs``
    of these requests, if several searches share them.
    """
    window = max_window(requests)
    order = sort_columns(F.lower(F.col("r_sort")), sorts, score_first, default_sort)
    joined = page_candidates(matches(papers, index, requests, spec or DEFAULT_SPEC, scored, pairs), order, window)
    keys = [F.col(f"_key{i}").desc() for i in range(len(order))]
    if with_total:
        joined = joined.join(totals(requests, joined), "query_id")
    return page_window(joined, keys, window).drop("hits", *[f"_key{i}" for i in range(len(order))])


SORT_KEYS = ["publicationHotScore", "pageRank", "publishedAt", "citationsCount", "voteScore"]
DEFAULT_SPEC = TextQuery(SEARCH_FIELDS, SEARCH_KEYWORD_FIELDS, fuzzy=True)
