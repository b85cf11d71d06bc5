"""Python patterns on Java's engine, and the literals that stand in front of them."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilog import load_rules
from vigilog.functions import regex as R

PATTERNS = [
    r"Accepted (password|publickey|keyboard-interactive)",
    r"(?P<src_ip>[\d.]+).*\"POST (?P<uri>/(?:[^/]+/)?login\.php)[^\"]*\" (?:200|302)",
    r"[[]x{2,}b{,3}{y}", r"a(?!b)c|d(?=ef)", r"(?P<q>['\"]).*?(?P=q)", r"^\w+\s\d{3}$", r"x*y?z+",
    r"[^\]&&a]+end\Z", r"kiss|MASK", r"(?:ab){2}c", r"\bnc\b.*\d|\b(?:ncat|netcat)\s", r"é+t",
    r"(?:a|)(?:b|c)?d", r"[\b]|tab\t",
]
TEXTS = [
    "Accepted publickey for x", '10.0.0.1 - "POST /a/login.php?x" 302', "[xxbbb{y}", "ac", "abc", "def",
    "say 'hi' now", "word 123", "word 123\r", "z", "yz", "the end", "Kİſſ", "maſk",
    "Kiss", "ababc", "nc -e 5", "netcat x", "ÉÉT", "bd", "tab\t", "", "a\u0085b", "١٢٣",
]


def test_search_agrees_with_python(spark):
    compiled = [R.compile_pattern(p) for p in PATTERNS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, m string")
    df = df.withColumn("low", F.expr(R.prefilter_text("m")))
    shared = R.shared_clauses(compiled)
    plain = [F.expr(R.search("m", p)).alias(f"p{i}") for i, p in enumerate(compiled)]
    gated = [
        F.expr(f"{R.prefilter('low', p, {})} AND {R.search('m', p)}").alias(f"g{i}")
        for i, p in enumerate(compiled)
    ]
    assert shared == {} or shared
    for row in df.select("i", *plain, *gated).collect():
        for i, pattern in enumerate(PATTERNS):
            expected = re.search(pattern, TEXTS[row.i], re.IGNORECASE) is not None
            assert row[f"p{i}"] == expected, (pattern, TEXTS[row.i])
            assert row[f"g{i}"] == expected, ("prefilter", pattern, TEXTS[row.i])


@settings(max_examples=300, deadline=None)
@given(st.from_regex(re.compile(PATTERNS[1], re.A), fullmatch=False) | st.from_regex(re.compile(PATTERNS[10], re.A)))
def test_required_literals_occur_in_every_match(text):
    for pattern in (PATTERNS[1], PATTERNS[10]):
        if re.search(pattern, text, re.IGNORECASE):
            low = text.lower()
            for clause in R.compile_pattern(pattern).required:
                assert any(lit in low for lit in clause)


def test_optional_parts_are_not_required():
    assert R.compile_pattern("(?:abc)?(?:x|)[qrs]").required == ()
    assert R.compile_pattern("Accepted (pass|key)").required == (("accepted ",), ("key", "pass"))
    assert R.compile_pattern('"GET [^"]{2048,}"').min_length == 2054


def test_bad_patterns():
    with pytest.raises(re.error):
        R.compile_pattern("(")
    with pytest.raises(ValueError):
        R.compile_pattern("(a)?(?(1)b|c)")


@pytest.mark.skipif("VIGILOG_TEST_RULES" not in os.environ, reason="names a directory of rule files")
def test_every_pattern_of_a_rule_directory_compiles_in_java(spark):
    rules = load_rules(os.environ["VIGILOG_TEST_RULES"])
    patterns = [p for r in rules.rules for p in (*r.patterns, *r.steps)]
    compile_java = spark._jvm.java.util.regex.Pattern.compile
    for pattern in patterns:
        assert compile_java(R.FLAGS + pattern.java).matcher("").groupCount() >= len(pattern.groups)
