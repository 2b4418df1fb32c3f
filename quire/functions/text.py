"""Native (JVM-side) text expressions: cleaning, entity decoding, tokens.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.entities import entity_table

# The whitespace class of the cleaning rules (tab, LF, VT, FF,
# CR, NEL and every Unicode separator), and the two regexes of the cleaner.
WS_CLASS = r"[\f\n\r\t\x0B\x85\p{Z}]"
JATS_TAG = r"(?i)</?jats:[^>]*>"
ANY_TAG = r"<[^>]*>"
LEADING_LABEL = r"(?i)^(abstract|summary)" + WS_CLASS + "*"

# Fixed value: token pattern (letters, marks, digits, underscore; inner
# apostrophes and dots keep a token whole).
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """Null, empty or only whitespace (Unicode-aware)."""
    c = col_of(c)
    return c.isNull() | c.rlike("^" + WS_CLASS + "*$")


def not_blank(c: Column | str) -> Column:
    return ~is_blank(c)


@lru_cache(maxsize=1)
def _entity_keys_values() -> tuple[list[str], list[str]]:
    table = entity_table()
    keys = sorted(table)
    return keys, [table[k] for k in keys]


def _entity_map() -> Column:
    # One literal string parsed once by constant folding into a map literal;
    # control characters delimit pairs (no entity decodes to them).
    keys, values = _entity_keys_values()
    text = "\u0001".join(f"{k}\u0002{v}" for k, v in zip(keys, values))
    return F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002"))


def _codepoint_to_string(cp: Column) -> Column:
    # UTF-32 big endian bytes of the code point, decoded natively.
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def decode_entities(c: Column | str) -> Column:
    """One-pass HTML entity decode.

    Split on ``&``; each piece after the first may start with ``name;``,
    ``#digits;`` or ``#xhex;``. Known references are replaced, anything else
    keeps its ``&``. Because each piece is decoded once, ``&amp;lt;`` becomes
    ``&lt;`` (not ``<``).
    """
    c = col_of(c)
    emap = _entity_map()

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        dec = F.regexp_extract(p, r"^#([0-9]+);", 1)
        hx = F.regexp_extract(p, r"^#[xX]([0-9A-Fa-f]+);", 1)
        named = F.try_element_at(emap, name)
        # leading zeros mean nothing; what is longer without them is no code point
        short_dec, short_hex = F.regexp_replace(dec, "^0+", ""), F.regexp_replace(hx, "^0+", "")
        dec_cp = F.when((dec != "") & (F.length(short_dec) <= 7), F.concat(F.lit("0"), short_dec).cast("long"))
        hex_cp = F.when((hx != "") & (F.length(short_hex) <= 6), F.conv(F.concat(F.lit("0"), short_hex), 16, 10).cast("long"))
        cp = F.coalesce(dec_cp, hex_cp)
        cp_ok = cp.isNotNull() & (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        cp_len = F.when(dec != "", F.length(dec) + 2).otherwise(F.length(hx) + 3)
        big = F.lit(1 << 30)
        decoded = (
            F.when((name != "") & named.isNotNull(),
                   F.concat(named, p.substr(F.length(name) + 2, big)))
            .when(cp_ok, F.concat(_codepoint_to_string(cp), p.substr(cp_len + 1, big)))
            .otherwise(F.concat(F.lit("&"), p))
        )
        return F.when(i == 0, p).otherwise(decoded)

    def whole(t: Column) -> Column:
        return F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&", -1), piece), "")).otherwise(t)

    # a variable of its own, so what ``c`` takes to compute is computed once
    return F.transform(F.array(c), whole)[0]


def clean_text(c: Column | str) -> Column:
    """Cleaning rules for titles/abstracts, in this exact order:
    blank -> ''; JATS tags -> ' '; other tags -> ' '; entity decode;
    whitespace runs -> ' '; trim; strip a leading 'abstract'/'summary'.
    """
    c = col_of(c)
    t = F.regexp_replace(c, JATS_TAG, " ")
    t = F.regexp_replace(t, ANY_TAG, " ")
    t = decode_entities(t)
    t = F.regexp_replace(t, WS_CLASS + "+", " ")
    t = F.trim(t)  # only single spaces remain at the ends after the collapse
    t = F.regexp_replace(t, LEADING_LABEL, "")
    return F.when(is_blank(c), F.lit("")).otherwise(t)


def sanitize_double(c: Column | str) -> Column:
    """null / NaN / +-Infinity -> 0.0 (isnan(Infinity) is false, so test both)."""
    c = col_of(c)
    bad = c.isNull() | F.isnan(c) | c.isin(math.inf, -math.inf)
    return F.when(bad, F.lit(0.0)).otherwise(c).cast("double")


def tokens(c: Column | str) -> Column:
    """Standard analysis: lower-case, then every token-pattern match."""
    return F.regexp_extract_all(F.lower(F.coalesce(col_of(c), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def first_or_empty(arr: Column) -> Column:
    """First element of an array, '' when the array is null or empty (no ANSI error)."""
    return F.coalesce(F.get(arr, 0), F.lit(""))
