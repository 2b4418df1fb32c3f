"""Non-scoring filters over ``papers`` (native predicates, pushed to the scan
where the column is a top-level primitive)."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import tokens

DEFAULT_AS_OF = "2024-12-31"


def not_in_future(as_of: str | Column = DEFAULT_AS_OF) -> Column:
    d = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.col("publishedAt") <= d


def journal_is(value: str | Column, mode: str = "keyword") -> Column:
    """``keyword``: exact value. ``term``: the value must equal one analysed token."""
    v = F.lit(value) if isinstance(value, str) else value
    if mode == "keyword":
        return F.col("journal") == v
    if mode == "term":
        return F.array_contains(tokens(F.col("journal")), v)
    raise ValueError(f"unknown journal mode {mode!r}")


def date_between(from_date: str | Column | None = None, to_date: str | Column | None = None) -> Column:
    cond = F.lit(True)
    if from_date is not None:
        cond = cond & (F.col("publishedAt") >= (F.lit(from_date).cast("date") if isinstance(from_date, str) else from_date))
    if to_date is not None:
        cond = cond & (F.col("publishedAt") <= (F.lit(to_date).cast("date") if isinstance(to_date, str) else to_date))
    return cond


def topics_any(names: Iterable[str] | Column) -> Column:
    arr = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])
    return F.arrays_overlap(F.transform(F.col("topics"), lambda t: t["name"]), arr) == F.lit(True)


def topic_is(name: str | Column) -> Column:
    v = F.lit(name) if isinstance(name, str) else name
    return F.exists(F.col("topics"), lambda t: t["name"] == v)


def author_is(name: str | Column) -> Column:
    v = F.lit(name) if isinstance(name, str) else name
    return F.exists(F.col("authors"), lambda a: a["name"] == v)


def has_abstract_is(value: bool | None) -> Column:
    if value is None:
        return F.lit(True)
    return F.col("hasAbstract") == F.lit(value)


def topic_entry(name: str | Column) -> Column:
    """First topic struct with that name (inner hit), or null."""
    v = F.lit(name) if isinstance(name, str) else name
    return F.get(F.filter(F.col("topics"), lambda t: t["name"] == v), 0)


def apply_filters(papers: DataFrame, *, journal: str | None = None, journal_mode: str = "keyword",
                  from_date: str | None = None, to_date: str | None = None, topics: list[str] | None = None,
                  author: str | None = None, has_abstract: bool | None = None) -> DataFrame:
    out = papers
    if journal:
        out = out.where(journal_is(journal, journal_mode))
    if from_date or to_date:
        out = out.where(date_between(from_date, to_date))
    if topics:
        out = out.where(topics_any(topics))
    if author:
        out = out.where(author_is(author))
    if has_abstract is not None:
        out = out.where(has_abstract_is(has_abstract))
    return out
