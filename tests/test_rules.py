"""Rule sets, and the dialect against RE2 (DuckDB's engine)."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillscan.functions.dialect import PatternError, group_count, to_java
from quillscan.rules import ConfigError, default_rules, families, load

PATTERNS = [
    r"a$", r"(?m)^b$", r"\bfoo\b", r"\s+x", r"[\s,]y", r".+", r"a{2}", r"a{,2}", r"x{y}", r"\$\{[a-z]+\}", r"[a[b]+", r"[a&&b]+", r"[[:alpha:]]+", r"[^[:digit:]]+", r"(?P<n_1>z)+", r"(?i)straße", r"(?i:A)b", r"(?s:.)q", r"a*?b", r"\Qa.b\E",
    r"[\w-]+@", r"(?:a|b)(c)?", r"\x61", r"[\x60-\x62]", r"é+", r"[^\d\s]{3}", r"\D+", r"a|(?i)b|c",
]
TEXTS = ["a", "a\n", "b\nb", "éfoo foo", "\x0bx \tx", "a,y", "line\rmore\nnext", "aaa", "a{,2}", "x{y}", "${abc}", "a[b&", "Straße STRASSE", "Ab AB", "\nq", "aab a.b axb", "me-1@x", "ac bc", "zz", "éé", "B C c", "", "  12 ab3"]


def test_translated_patterns_match_as_re2_does(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    con = duckdb.connect()
    for p in PATTERNS:
        got = [r.m for r in df.select(F.regexp_extract_all("t", F.lit(to_java(p)), F.lit(0)).alias("m")).collect()]
        assert got == [con.execute("SELECT regexp_extract_all(?, ?)", [t, p]).fetchone()[0] for t in TEXTS], p


@pytest.mark.parametrize("p", [r"(?=a)", r"(a)\1", r"a++", r"(?>a)", r"(a", r"a)", r"*a", r"a{1001}", r"\u0041", r"[a", r"[[:nope:]]", "a\\"])
def test_what_re2_refuses_is_refused(p):
    with pytest.raises(PatternError):
        to_java(p)


def test_groups():
    assert [group_count(p) for p in (r"(a)(?:b)(?P<x>c)", r"\(a\)[(]", "a")] == [2, 0, 0]


RULE = "[[rules]]\nid = '{0}'\nregex = 'a(b)'\n"


@pytest.mark.parametrize(
    "text",
    [
        "[[rules]]\nregex = 'a'", "[[rules]]\nid = 'a'", RULE.format("a") + "secretGroup = 2", RULE.format("a") + RULE.format("a"), RULE.format("a") + "[[rules.allowlists]]\n",
        RULE.format("a") + "[[rules.allowlists]]\nregexTarget = 'file'\nregexes=['x']", RULE.format("a") + "[rules.allowlist]\nregexes=['x']\n[[rules.allowlists]]\nregexes=['x']",
        RULE.format("a") + "required = [{id = 'b'}]", RULE.format("a") + "[[allowlists]]\ntargetRules = ['b']\nregexes = ['x']", "[extend]\nuseDefault = true\npath = 'x'", RULE.format("a") + "[[rules.allowlists]]\ncondition = 'XOR'\nregexes=['x']",
    ],
)
def test_invalid(text):
    with pytest.raises(ConfigError):
        load(text)


def test_weak_types_and_merge():
    base = RULE.format("a") + "keywords = 'K1'\nentropy = '3'\ntags = 't,u'\nsecretGroup = '0x1'\n" + RULE.format("gone")
    s = load("[EXTEND]\npath = 'base'\ndisabledRules = ['gone']\n" + "[[rules]]\nID = 'a'\nkeywords = ['k2']\ndescription = 'new'\n[[rules]]\nid = 'b'\npath = 'x'\n[[allowlists]]\ntargetRules = ['a']\nstopwords = ['W']\n", lambda p: base)
    a = s.rule("a")
    assert [r.id for r in s.rules] == ["a", "b"]
    assert (a.keywords, a.tags, a.entropy, a.secret_group, a.description, a.regex) == (("k1", "k2"), ("t", "u"), 3.0, 1, "new", "a(b)")
    assert a.allowlists[0].stopwords == ("w",) and s.allowlists == ()


def test_third_level_is_passed_over():
    levels = {"1": "[extend]\npath = '2'\n" + RULE.format("one"), "2": "[extend]\npath = '3'\n" + RULE.format("two"), "3": RULE.format("three")}
    assert [r.id for r in load("[extend]\npath = '1'\n", levels.__getitem__).rules] == ["one", "two"]


def test_selection_keeps_helpers_silent():
    s = default_rules().select(["aws-secret-key"])
    assert [(r.id, r.skip_report) for r in s.rules] == [("aws-access-key", True), ("aws-secret-key", False)]
    with pytest.raises(ConfigError):
        s.select(["nope"])


def test_the_pack_is_valid():
    assert len(default_rules().rules) > 200


@pytest.mark.parametrize("line", [x for x in (families.TOKENS + families.ASSIGNED).splitlines() if x])
def test_built_rules_find_what_has_the_form_and_nothing_shorter(line):
    name, *rest, kind, length, _ = line.split()
    rule = next(r for r in families.rules() if r["id"] == name)
    prefix = {"[0-9]{5,16}:A": "123456:A", "A{22}": "A" * 22, "(?:sq[apu]_)?": "squ_", "-": ""}.get(rest[-1])
    prefix = prefix if prefix is not None else re.sub(r"\(\?:([^|)]*)[^)]*\)|\[(.)[^]]*\]", r"\1\2", rest[-1])
    least = int(length.split("-")[0])
    letter = {"digit": "7", "upper": "Q", "HEX": "A", "bech32": "Q"}.get(kind, "a")
    before = "" if len(rest) == 1 else rest[0].split("|")[-1] + "_x = '"
    good, bad = (f"x\n{before}{prefix}{letter * n}'\n" for n in (least, least - 1))
    found = re.search(rule["regex"], good)
    assert found and found[1] == prefix + letter * least and not re.search(rule["regex"], bad)
    assert any(k in good.lower() for k in rule["keywords"])
