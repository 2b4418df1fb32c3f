"""Request normalisation: one row per request, validated as column expressions.

The request endpoints accept a small, fixed grammar of parameters. We keep
them as a DataFrame so thousands of requests are normalised in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank

# Paging and window limits of the request API.
DEFAULT_PER_PAGE = 10
MAX_PER_PAGE = 100
MAX_WINDOW = 50_000
SYNC_DEFAULT_SIZE = 1000
SYNC_MAX_SIZE = 10_000

# Accepted sort names per endpoint and the default of each.
LIST_SORTS = ("hot", "top", "latest")
TOPIC_SORTS = ("hot", "top", "relevance", "latest")
CONTEXTUAL_SORTS = ("hot", "top", "latest", "hotscore", "pagerank", "date", "citationscount", "votescore")
SEMANTIC_SORTS = ("hot", "top", "latest")
DEFAULT_SORT = {"list": "latest", "topic": "hot", "contextual": "latest", "semantic": "latest"}
VALID_SORTS = {"list": LIST_SORTS, "topic": TOPIC_SORTS, "contextual": CONTEXTUAL_SORTS, "semantic": SEMANTIC_SORTS}


def norm_page(page: Column) -> Column:
    return F.when(page.isNull() | (page < 1), F.lit(1)).otherwise(page)


def norm_per_page(per_page: Column) -> Column:
    return F.when(per_page.isNull() | (per_page < 1) | (per_page > MAX_PER_PAGE), F.lit(DEFAULT_PER_PAGE)).otherwise(per_page)


def norm_sort(sort: Column, endpoint: str) -> Column:
    s = F.lower(sort)
    return F.when(s.isin(*VALID_SORTS[endpoint]), s).otherwise(F.lit(DEFAULT_SORT[endpoint]))


def norm_sync_size(size: Column) -> Column:
    return (F.when(size.isNull() | (size < 1), F.lit(SYNC_DEFAULT_SIZE))
            .when(size > SYNC_MAX_SIZE, F.lit(SYNC_MAX_SIZE)).otherwise(size))


def normalize_requests(requests: DataFrame, endpoint: str = "semantic", text_col: str = "query") -> DataFrame:
    """Adds page/per_page/sort normalised, from/size, and a rejection reason.

    ``requests`` needs ``query_id``, ``text_col``, ``page``, ``per_page``, ``sort``.
    """
    page = norm_page(F.col("page").cast("int"))
    per_page = norm_per_page(F.col("per_page").cast("int"))
    out = requests.select(
        "query_id", F.col(text_col).alias("query"),
        page.alias("page"), per_page.alias("per_page"),
        norm_sort(F.col("sort"), endpoint).alias("sort"),
    ).withColumn("from", (F.col("page") - 1) * F.col("per_page")).withColumn("size", F.col("per_page"))
    reason = (F.when(is_blank(F.col("query")), F.lit("blank_query"))
              .when(F.col("from") + F.col("size") > MAX_WINDOW, F.lit("result_window_too_large")))
    return out.withColumn("rejected_reason", reason)


def page_bounds(page: int | None, per_page: int | None) -> tuple[int, int]:
    """Python-side twin of the column rules, for single requests."""
    page = 1 if page is None or page < 1 else page
    per_page = DEFAULT_PER_PAGE if per_page is None or per_page < 1 or per_page > MAX_PER_PAGE else per_page
    return (page - 1) * per_page, per_page


def pick_sort(sort: str | None, endpoint: str) -> str:
    s = (sort or "").lower()
    return s if s in VALID_SORTS[endpoint] else DEFAULT_SORT[endpoint]


def split_topics(topics: Column) -> Column:
    """Comma list -> array; empty pieces dropped, pieces NOT trimmed."""
    return F.filter(F.split(F.coalesce(topics, F.lit("")), ",", -1), lambda t: t != "")
