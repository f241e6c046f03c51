"""Python patterns in Java's dialect give Python's answers, in list and per-row form."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdloom.functions import patterns as P

PATTERNS = [r"/{version}/", r"x{,3}y", r"[[]", r"(a)?(?(1)b|c)", r"(?P<x>abc)", r"(?P<x>d)(?P=x)", r"(?i)/SEARCH", r"(?P<a_b>x)y(?P=a_b)", r"/v\d+\Z",
            r"a\\Zb", r"a$", r"^b", r"(?m)^b$", r"(?s)a.b", r"a.b", r"[^\W\d]+1", r"[^\s/]{2,}", r"[\D]z", r"\bcat\b", r"\Bat\B", r"(?a)\bété\b", r"(?a:\w)x",
            r"(?x) a  b # note", r"(?i:É)t", r"(?-i:a)B", r"a{,}b", r"(?>a+)ab", r"a++b", r"(?<=/)doc", r"(?<!/)doc", r"(?=.*html)x", r"[]a]+]",
            r"[a\-z]-", r"[&&[b]", r"[a-c&&[^b]]", r"\x41\u00e9", r"\141", r"(a)(b)\2\1", r"(a)(b)\2", r"((a)|b)+\2", r"(?:a|b|)c", r"",
            r"(a)(?(1)b)c", r"[\w-]+@", r"{", r"}", r"a{1", r"a{1,x}", r"#frag", r"\#", r"\Aab", "é", r"[À-ÿ]+", r"(?i)[k-m]z", r"\.html?$", r"(?:(a)|b)*(?(1)x|y)"]
TEXTS = ["", "abc", "ab", "c", "http://h/{version}/p", "/v12", "/v12\n", "xxxy", "xxxxy", "x{,3}y", "[", "[[]", "dd", "/search", "xyx", r"a\Zb", "a\nb", "b\na", "a\r\nb",
         "cat", "concat.", "bat s", "été", "un été.", "ex", "éx", "AB", "aB", "Ét", "ét", "aaaaaa", "aab", "aaab", "/doc", "mydoc", "x.html", "x.htm\n", "]]", "a]", "a--", "-", "&&[b", "b]",
         "Aé", "a", "abba", "abb", "aba", "bba", "aac", "\u212az", "Kz", "{", "}", "a{1", "a{1,x}", "#frag", "ñandú@x", "a_1", "é1", "a\u0085b", "a\u2028b", "ab", "x", "ay", "by", "bax", "1z", "/ z", "\U0001F600z"]


def want(pattern, text):
    return re.search(pattern, text) is not None


def test_translated_patterns_give_pythons_answers(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    compiled = P.compiled(PATTERNS)
    assert [p.text for p in compiled] == PATTERNS
    rows = df.select("t", *[F.col("t").rlike(p.java).alias(f"p{i}") for i, p in enumerate(compiled)]).collect()
    wrong = [(p.text, p.java, r.t) for r in rows for i, p in enumerate(compiled) if r[f"p{i}"] != want(p.text, r.t)]
    assert wrong == []


def test_list_joined_and_per_row_forms(spark):
    sets = [PATTERNS[:4], PATTERNS[4:9], [r"(?P<x>abc)", r"(?P<x>d)(?P=x)", r"(a)?(?(1)b|c)"], ["(", r"cat"], [], [r"a{5000000000}", "zz"]]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for patterns in sets:
        good = P.compiled(patterns)
        rows = df.select("t", P.first_match(F.col("t"), good).alias("f"), P.any_match(F.col("t"), good).alias("a")).collect()
        for r in rows:
            first = next((p.text for p in good if want(p.text, r.t)), None)
            assert (r.f, r.a) == (first, first is not None), (patterns, r.t)
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)] + [(99, None)], "i long, ps array<string>").select("i", P.compiled_array("ps").alias("c"))
    rows = df.crossJoin(table).select("t", "i", P.first_match(F.col("t"), F.col("c")).alias("f")).collect()
    for r in rows:
        good = P.compiled(sets[r.i]) if r.i < 99 else []
        assert r.f == next((p.text for p in good if want(p.text, r.t)), None)


def test_refused_patterns():
    for p in ["(", "a{2}{3}", "a{5000000000}", "a{3,1}", "(?P<1>a)", "*a", r"(?P=x)"]:
        with pytest.raises(P.PatternError):
            P.translate(p)


ATOMS = st.sampled_from(["a", "b", ".", r"\w", r"\d", r"\s", "[ab]", "[^a]", r"[\W_]", "^", "$", r"\b", "(a)", "(?:b|c)", r"(?i:A)", "{", "1", "/", "é"])
REPEATS = st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{,2}", "{1,}", "*?"])
TEXT = st.text(alphabet="ab1/ cé\n_{A", max_size=8)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(ATOMS, REPEATS), min_size=1, max_size=4), min_size=20, max_size=20), st.lists(TEXT, min_size=10, max_size=10))
def test_any_pattern(spark, parts, texts):
    found = []
    for p in ["".join(a + r for a, r in x) for x in parts]:
        try:
            found.append(P.Pattern(p, P.translate(p)[0]))
        except P.PatternError:
            pass
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    for p in found:
        compiled = java.compile(p.java)
        for t in texts:
            assert compiled.matcher(t).find(0) == want(p.text, t), (p, t)
