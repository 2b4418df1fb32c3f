"""Edge rows of the cleaning, decoding and mapping rules (hand-written fixtures)."""

import math

from pyspark.sql import functions as F

from quire.functions.text import clean_text, decode_entities, sanitize_double, tokens


def _one(spark, expr, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("out")).first()["out"]


def test_clean_text_rules(spark):
    cases = {
        None: "", "": "", "   ": "",
        "<jats:p>Abstract  A&nbsp;&nbsp;B</JATS:P>": "A B",
        "Abstraction is": "ion is",
        "Summary: x": ": x",
        "a &lt;b&gt; c": "a <b> c",
    }
    for raw, want in cases.items():
        assert _one(spark, clean_text(F.col("s")), raw) == want, raw


def test_decode_is_one_pass(spark):
    got = _one(spark, decode_entities(F.col("s")), "&amp;lt; &bogus; R&D &#8217; &#x2019;")
    assert got == "&lt; &bogus; R&D ’ ’"
    assert _one(spark, decode_entities(F.col("s")), "x &#128512; end&") == "x \U0001F600 end&"


def test_sanitize_double(spark):
    rows = [(None,), (float("nan"),), (math.inf,), (-math.inf,), (1.5,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(sanitize_double("x")).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 1.5]


def test_tokens(spark):
    got = _one(spark, tokens(F.col("s")), "Hello World, it's U.S.A. x_y 3.14")
    assert got == ["hello", "world", "it's", "u.s.a", "x_y", "3.14"]


def test_zero_padded_and_overlong_references(spark):
    rows = spark.createDataFrame([("&#00000065;&#x000000041;",), ("&#99999999;",), ("&#x00110000;",), ("&#0;",)], "t string")
    out = [r[0] for r in rows.select(decode_entities(F.col("t"))).collect()]
    assert out == ["AA", "&#99999999;", "&#x00110000;", "&#0;"]
