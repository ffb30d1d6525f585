"""Patterns against a linear-time engine of the same dialect."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from treeline.functions.patterns import matches, to_java
from treeline.plans.selector import Grep, SelectorError

TEXTS = ["", "a", "ab", "A b", "über", "ÜBER", "a\u2028b", "a\rb", "x\x0by", "a\x0b", "tab\tx", "[", "]", "&&", "a&b", "{1", "a{2}", "foo_bar", "foo-bar", "Grüße", "ΑΒΓ", "αβγ", "12 34", "a.b", "K", "k", "Straße", "end$", "^x", "-", "é", "λx", "\\d"]
PATTERNS = ["a.b", "^a", "b$", "(?i)über", "(?i)ΑΒΓ", r"\bfoo\b", r"\Bo", r"\s", r"\S", r"[\s]", r"[^\S]", "[[:alpha:]]+", "[[:^alpha:]]", "[[:space:][:digit:]]", "(?P<x>a)", "(?:a|b)+?", "[[]", "[]a]", "[&&]", "[a&b]", r"\d{2}", "a{2}", r"\{1", "x{", r"\pL", r"\p{Greek}", r"\P{Greek}", r"[^\d]", r"\Qa.b\E", r"\x41", r"\x{e9}", "(?s)a.b", "(?i:K)", "k|K", r"\v", "[^a]", r"\$", r"[\^x]", "[a-c]", r"[\]]", r"[\w-]+$", "", "()", "a*", "(a|b)*"]


def test_patterns_mean_what_the_other_engine_says(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = frame.select("i", *[matches(F.col("t"), Grep(pattern=p, regex=True)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]).orderBy("i").collect()
    con = duckdb.connect()
    for n, p in enumerate(PATTERNS):
        want = [con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in TEXTS]
        assert [r[f"p{n}"] for r in got] == want, p


@pytest.mark.parametrize("pattern", [r"(a)\1", "a(?=b)", "(?<!a)b", "a*+", "a++", "(?>a)", "(?U)a", r"\Z", r"\k<x>", r"\h", r"\G", "[a", "(a", "a)", "*a", "[[:nope:]]"])
def test_what_is_refused(pattern):
    with pytest.raises(SelectorError):
        to_java(pattern)


def test_plain_words_and_case(spark):
    frame = spark.createDataFrame([("ÜBER a.b",), ("uber axb",)], "t string")
    hit = lambda g: [r[0] for r in frame.select(matches(F.col("t"), g)).collect()]
    assert hit(Grep(pattern="über", regex=False, ignore_case=True)) == [True, False]
    assert hit(Grep(pattern="a.b", regex=False)) == [True, False]
    assert hit(Grep(pattern="a.b", regex=True, invert=True)) == [False, False]
