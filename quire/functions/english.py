"""English analysis of terms: possessive strip, stop words, Porter stemming.

The stemmer sees distinct terms, never occurrences: those of the vocabulary in
an Arrow-batched UDF, and those of a document's postings where these lie. So a
vocabulary of any size needs no join with the postings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions._ship import ship_by_value
from quire.functions.postings import codes_of, counted, numbered

ship_by_value(__name__)

# English stop words (33 words).
STOP_WORDS = frozenset("""a an and are as at be but by for if in into is it no not of on or such
that the their then there these they this to was will with""".split())

_VOWELS = set("aeiou")


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in the stem."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        n += 1
        while i < L and _cons(stem, i):
            i += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


# Suffix rules of the Porter (1980) algorithm, steps 2-4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    flag = False
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, flag = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, flag = w[:-3], True
    if flag:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2, 3
    w = _replace(w, _STEP2, lambda s: _m(s) > 0)
    w = _replace(w, _STEP3, lambda s: _m(s) > 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _m(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5
    if w.endswith("e"):
        stem = w[:-1]
        if _m(stem) > 1 or (_m(stem) == 1 and not _cvc(stem)):
            w = stem
    if _m(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def english_term(t: str) -> str | None:
    """Analysed form of one standard token; None for stop words."""
    if t.endswith("'s") or t.endswith("’s"):
        t = t[:-2]
    if not t or t in STOP_WORDS:
        return None
    return porter_stem(t)


def _english_batch(s: pd.Series) -> pd.Series:
    return s.map(english_term)


# Marked non-deterministic only so that a filter of its result is not a second call.
english_udf = F.pandas_udf(_english_batch, T.StringType()).asNondeterministic()


def english_map(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, eterm) for distinct terms; stop words map to no row."""
    d = terms.select(col).distinct()
    return d.withColumn("eterm", english_udf(F.col(col))).where(F.col("eterm").isNotNull())


#: Terms whose stems a task remembers.
KNOWN_STEMS = 1 << 18


def _stems_of_documents(schema: pa.Schema):
    known: dict[str, str | None] = {}

    def stem(term: str) -> str | None:
        if term not in known:
            known[term] = english_term(term)
        return known[term]

    def stems(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(known) > KNOWN_STEMS:
                known.clear()
            row, met = numbered(batch.column("met"))
            code, terms = codes_of(met.field("term"))
            of, words = codes_of(pa.array([stem(t) if t is not None else None for t in terms.to_pylist()], pa.string()))
            code = of[code]
            kept = code < len(words) - words.null_count  # stop words come last
            if not kept.any():
                continue
            tf = met.field("tf").to_numpy(zero_copy_only=False)
            row, code, tf = counted(row[kept], code[kept], batch.num_rows, tf[kept])
            dl, at = np.bincount(row, tf, minlength=batch.num_rows).astype(np.int64), pa.array(row)
            yield pa.record_batch([words.take(pa.array(code)), batch.column("doc").take(at), batch.column("id").take(at), pa.array(tf), pa.array(dl[row])], schema=schema)

    return stems


def english_postings(postings: DataFrame, source_field: str = "contextualContent",
                     field: str = "contextualContent.english") -> DataFrame:
    """Postings of the English sub-field, from the standard postings. Those of a
    stored index lie by document, so none of them is shuffled."""
    src = postings.where(F.col("field") == source_field).select("term", "doc", "id", "tf")
    per = src.groupBy("doc").agg(F.first("id").alias("id"), F.collect_list(F.struct("term", "tf")).alias("met"))
    schema = T.StructType([T.StructField("term", T.StringType()), src.schema["doc"], src.schema["id"],
                           T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
    found = per.mapInArrow(_stems_of_documents(to_arrow_schema(schema)), schema)
    return found.select(F.lit(field).alias("field"), "term", "doc", "id", "tf", "dl")
