"""The detection plan on small cases whose results were worked out by hand."""

import pytest

from quillscan.operators.decode import decode_pass, decode_value, detect_decoded
from quillscan.plans import detect as D
from quillscan.rules import load


def frags(spark, *texts, **more):
    rows = [(k, t, *more.values()) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["fragment_id long", "content string", *(f"{c} {'int' if c == 'start_line' else 'string'}" for c in more)]))


def found(spark, toml, *texts, options=D.Options(), **more):
    return sorted(D.detect(frags(spark, *texts, **more), load(toml), options).collect(), key=lambda r: (r.fragment_id, r.rule_id, r.match_start or 0))


LOCATIONS = [
    ("key=AAAA", "key=(AAAA)", (37, 37, 1, 8), "key=AAAA", (0, 8), (4, 8)),
    ("p\rkey=AAAA\rt", "key=(AAAA)", (37, 37, 3, 10), "p\rkey=AAAA", (2, 10), (6, 10)),
    ("p\r\nkey=AAAA\r\nz", "key=(AAAA)", (38, 38, 2, 9), "\nkey=AAAA\r", (3, 11), (7, 11)),
    ("h\nkey=AAAA\nz", "key=(AAAA)", (38, 38, 2, 9), "\nkey=AAAA", (2, 10), (6, 10)),
    ("h\nkey=AAAA\rt", "key=(AAAA)", (38, 38, 2, 9), "h\nkey=AAAA", (2, 10), (6, 10)),
    ("h\nkey=AAAA", "key=(AAAA)", (38, 38, 2, 9), "h\nkey=AAAA", (2, 10), (6, 10)),
    ("\n\nkey=AAAA\n", "key=(AAAA)", (39, 39, 2, 9), "\nkey=AAAA", (2, 10), (6, 10)),
    ("x\nkey=AA\nAA\r\nz", "key=(A)A\\nAA", (38, 39, 2, 3), "\nkey=AA\nAA\r", (2, 11), (6, 7)),
    ("p\n\nkey=AAAA\n\nz", "\\n*key=(AAAA)\\n*", (38, 39, 1, 7), "\n\nkey=AAAA", (3, 11), (7, 11)),
    ("key=AAAA\n\nz", "key=(AAAA)\\n*", (37, 37, 1, 8), "key=AAAA", (0, 8), (4, 8)),
    ("key=éé\n", "key=(..)", (37, 37, 1, 8), "key=éé", (0, 8), (4, 8)),
]


@pytest.mark.parametrize("text, pattern, at, line, match, secret", LOCATIONS)
def test_locations(spark, text, pattern, at, line, match, secret):
    (r,) = found(spark, f"[[rules]]\nid = 'k'\nregex = '''{pattern}'''\n", text, start_line=37)
    assert (r.start_line, r.end_line, r.start_column, r.end_column) == at
    assert ((r.match_start, r.match_end), (r.secret_start, r.secret_end)) == (match, secret)
    assert r.line == line


def test_capture_tags_keywords_and_spans(spark):
    toml = "[[rules]]\nid = 't'\nregex = '''token\\s*=\\s*\"([^\"\\n]+)\"'''\nkeywords = ['TOKEN']\ntags = ['credential']\n"
    (r,) = found(spark, toml, 'prefix\n token="abc123" tail\n')
    assert (r.start_line, r.start_column, r.end_column, r.line, r.match_start, r.match_end, r.secret, r.tags) == (1, 3, 16, '\n token="abc123" tail', 8, 22, "abc123", ["credential"])
    two = "[[rules]]\nid = 't'\nregex = '''token=\\w+'''\n"
    assert [(r.match_start, r.match_end) for r in found(spark, two, "xx token=BETA yy token=GAMMA")] == [(3, 13), (17, 28)]
    assert found(spark, "[[rules]]\nid = 't'\nregex = 'token'\nkeywords = ['']\n", "token") == []


def test_groups_entropy_markers_and_limits(spark):
    rule = "[[rules]]\nid = 'k'\nregex = '(key)=([A-Z0-9]+)'\nsecretGroup = 2\nentropy = 1.0\n"
    texts = ("key=AB12", "key=AAAA", "key=AB12 # gitleaks:allow", None, "")
    assert [(r.fragment_id, r.secret) for r in found(spark, rule, *texts)] == [(0, "AB12")]
    assert len(found(spark, rule, *texts, options=D.Options(honor_allow_markers=False))) == 2
    assert [len(found(spark, rule, "key=AB12", options=D.Options(max_target_bytes=n))) for n in (7, 8)] == [0, 1]
    other = "[[rules]]\nid = 'k'\nregex = '(?:key=([A-Z0-9]+)|(other))'\nsecretGroup = 2\n"
    (r,) = found(spark, other, "key=AB12")
    assert (r.secret, r.secret_start) == ("", None)


def test_paths(spark):
    toml = "[[rules]]\nid = 'p'\npath = '(?i)secret\\.txt$'\n[[rules]]\nid = 'e'\npath = '\\.env$'\nregex = 'k=(\\w+)'\n"
    rows = spark.createDataFrame([(0, "k=1", "a/Secret.txt"), (1, "k=1", "x.env"), (2, "k=1", "x.txt")], "fragment_id long, content string, file_path string")
    got = sorted((r.fragment_id, r.rule_id, r.match, r.fingerprint) for r in D.detect(rows, load(toml)).collect())
    assert got == [(0, "p", "file detected: a/Secret.txt", "a/Secret.txt:p:0"), (1, "e", "k=1", "x.env:e:0")]


def test_required_rules(spark):
    toml = "[[rules]]\nid = 'p'\nregex = 'pw=(\\w+)'\nrequired = [{{id = 'u', withinLines = {}}}]\n[[rules]]\nid = 'u'\nregex = 'user=(\\w+)'\nskipReport = true\n"
    text = "user=me\n\npw=one\n\n\npw=two\n"
    assert [(r.secret, r.required_findings[0].secret) for r in found(spark, toml.format(2), text)] == [("one", "me")]
    assert len(found(spark, toml.format(5), text)) == 2
    assert found(spark, toml.format(-1), text) == []


def test_generic_gives_way(spark):
    toml = "[[rules]]\nid = 'generic-x'\nregex = 'k=(\\w+)'\n[[rules]]\nid = 'own'\nregex = 'k=(ab\\w+)'\n"
    assert [(r.rule_id, r.secret) for r in found(spark, toml, "k=abc\nk=xyz")] == [("generic-x", "xyz"), ("own", "abc")]


def test_redaction(spark):
    from pyspark.sql import functions as F

    from quillscan.functions.text import masked_secret

    df = spark.createDataFrame([("secret",), ("",)], "s string")
    for percent, want in ((75, "se..."), (90, "s..."), (10, "secre..."), (100, "REDACTED")):
        assert [r[0] for r in df.select(masked_secret(F.col("s"), percent)).collect()] == [want, ""]


@pytest.mark.parametrize(
    "text, want",
    [
        ("bG9uZ2VyLWVuY29kZWQtc2VjcmV0LXRlc3Q=", "longer-encoded-secret-test"), ("bG9uZ2VyLWVuY29kZWQtc2VjcmV0LXRlc3Q", "longer-encoded-secret-test"), ("token: bG9uZ2VyLWVuY29kZWQtc2VjcmV0LXRlc3Q=", "token: longer-encoded-secret-test"),
        ("da39a3ee5e6b4b0d3255bfef95601890afd80709", "da39a3ee5e6b4b0d3255bfef95601890afd80709"), ('secret="466973684D617048756E6B79212121363334"', 'secret="FishMapHunky!!!634"'),
        ("secret=U+0061 U+0062 U+0063 U+0064 U+0065 U+0066", "secret=a b c d e f".replace(" ", "")), ("\\u0068\\u0065\\u006c\\u006c\\u006f", "hello"), ("secret%3D%22q%24%21%40%22", 'secret="q$!@"'),
    ],
)
def test_decode(text, want):
    assert decode_pass(text.encode(), [])[0].decode() == want


def test_surrogates_and_odd_values():
    assert decode_value("unicode", rb"\ud83d\ude00") == "��".encode()
    assert decode_value("hex", b"abcdefabcdefabcdefabcdefabcdefab") is None
    assert decode_value("base64", b"abcdefghijklmnop") is None


def test_decoded_findings_keep_their_places(spark):
    toml = "[[rules]]\nid = 't'\nregex = 'pass=(\\w{10,})'\n"
    import base64

    inner = base64.b64encode(b"xx pass=abcdefghijkl yy").decode()
    got = detect_decoded(frags(spark, f"one\ntwo {inner} three", "pass=plain_text_1"), load(toml)).collect()
    by = {r.fragment_id: r for r in got}
    assert len(got) == 2 and by[1].decode_depth == 0
    r = by[0]
    assert (r.secret, r.start_line, r.start_column, r.end_column, r.tags, r.match_start) == ("abcdefghijkl", 1, 6, 5 + len(inner), ["decoded:base64", "decode-depth:1"], None)
    assert detect_decoded(frags(spark, inner), load(toml), max_depth=0).collect() == []


def test_no_rules_and_empty_input(spark):
    assert D.detect(frags(spark, "x"), load("")).collect() == []
    assert D.detect(frags(spark, "x").limit(0), load("[[rules]]\nid = 'a'\nregex = 'x'\n")).collect() == []


def test_a_hundred_thousand_matches_of_one_text(spark):
    """In time linear in the text: each match by sums over parts and lines, not by a look at all that is before it."""
    n = 100_000
    text = "".join(f"a{k % 7}\n key={k:08d}\n" for k in range(n))
    rows = D.candidates(D.fragments(frags(spark, text)), load("[[rules]]\nid = 'k'\nregex = '''key=([0-9]{8})'''\n"))
    r = rows.selectExpr("count(*) AS n", "max(start_line) AS last", "max(match_end) AS stop", "sum(start_column) AS columns", "max(line) AS line").first()
    assert (r.n, r.last, r.stop, r.columns, r.line) == (n, 2 * n - 1, len(text) - 1, 3 * n, f"\n key={n - 1:08d}")


def test_a_helper_of_another_decode_pass_does_not_count(spark):
    import base64

    toml = "[[rules]]\nid = 'a'\nregex = 'first=(\\w+)'\nrequired = [{id = 'b'}]\n[[rules]]\nid = 'b'\nregex = 'second=(\\w+)'\nskipReport = true\n"
    both = base64.b64encode(b"first=one second=two").decode()
    one = base64.b64encode(b"second=two and more words").decode()
    got = detect_decoded(frags(spark, f"x {both} y", f"first=one {one} y"), load(toml)).collect()
    assert [(r.fragment_id, r.decode_depth) for r in got] == [(0, 1)]


def test_keywords_in_one_pass_open_the_same_gates(spark):
    words = ["api", "apikey", "key", "rapidapi", "s.", "sk", "e\u0301t", "a+b", "tokens", "token", "x"]
    toml = "".join(f"[[rules]]\nid = 'r{k}'\nregex = '''[a-z]'''\nkeywords = ['{w}']\n" for k, w in enumerate(words))
    texts = ["RapidAPIkey", "no s.k", "sk tokens", "A+B", "e\u0301te", "q", "tokenx", ""]
    rules = load(toml)
    got = {(r.fragment_id, r.rule_no) for r in D.opened(D.fragments(frags(spark, *texts)), D.content_rules(rules), D.Options()).collect()}
    order = [r.keywords[0] for r in D.content_rules(rules)]
    assert got == {(k, n) for k, t in enumerate(texts) for n, w in enumerate(order) if w in t.lower()}


def test_decode_passes_read_the_text_once_and_join_nothing(spark):
    import base64

    df = frags(spark, "one " + base64.b64encode(b"pass=abcdefghijkl yy").decode(), "pass=plain_text_1")
    found = detect_decoded(df, load("[[rules]]\nid = 'p'\nregex = '''pass=([a-z_0-9]{8,})'''\n"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r.fragment_id, r.decode_depth) for r in found.collect()) == [(0, 1), (1, 0)]


def test_patterns_are_literals_of_the_plan(spark):
    two = load("[[rules]]\nid = 'a'\nregex = '''\\ba=(x?)([0-9]+)'''\n[[rules]]\nid = 'b'\nregex = '''\\n*b=[0-9]+'''\n")
    found = D.matches(D.fragments(frags(spark, "xa=1 a=1\n\nb=22", "a=x3 \ue000 a=4")), two)
    # an index into an array of patterns would be compiled for each row
    assert "[rule_no" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.fragment_id, r.rule_no, r.match_start, r.match, r.secret) for r in found.collect()) == [(0, 0, 5, "a=1", "1"), (0, 1, 10, "b=22", "b=22"), (1, 0, 0, "a=x3", "x"), (1, 0, 9, "a=4", "4")]
