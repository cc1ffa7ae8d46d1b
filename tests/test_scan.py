"""Whole scans, explanations, templates and further column functions."""

import pytest
from pyspark.sql import functions as F

from quillscan.functions import text as T
from quillscan.operators import report
from quillscan.operators.template import TemplateError, parse, to_template
from quillscan.plans import detect as D
from quillscan.plans.scan import explain, find_rules, scan_directory, scan_table
from quillscan.rules import default_rules, load

RULES = load("[[rules]]\nid = 'k'\nregex = 'key=([A-Z]{4})'\nentropy = 0.5\nkeywords = ['key']\ntags = ['x', 'y']\n")


def frags(spark, *texts):
    return spark.createDataFrame([(k, t, f"f{k}.txt", "c0ffee") for k, t in enumerate(texts)], "fragment_id long, content string, file_path string, commit string")


def test_scan_of_a_table(spark):
    df = frags(spark, "key=ABCD", "key=EFGH", "nothing")
    r = scan_table(df, RULES, ignored=["# note", "f1.txt:k:0"], link=("github", "https://github.com/o/r"))
    assert [(x.secret, x.link) for x in r.findings.collect()] == [("ABCD", "https://github.com/o/r/blob/c0ffee/f0.txt#L0")]
    assert r.metrics == {"fragments": 3, "bytes": 23, "commits": 1, "findings": 1} and r.exit_code() == 1
    assert r.status() == "complete=true fragments=3 bytes=23 commits=1 findings=1 issues=0"
    again = scan_table(df, RULES, baseline=r.findings, max_decode_depth=2)
    assert [x.secret for x in again.findings.collect()] == ["EFGH"]


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "a").write_text("x\n" * 60000 + "key=ABCD\n")
    (tmp_path / "b.7z").write_text("7z")
    (tmp_path / ".quillscan.toml").write_text("[[rules]]\nid = 'own'\nregex = 'key=(\\w+)'\n")
    rules = find_rules(str(tmp_path))
    r = scan_directory(spark, str(tmp_path), rules, archive_depth=1, whole_files=True)
    assert [(x.rule_id, x.start_line) for x in r.findings.collect()] == [("own", 60001)]
    assert (r.complete, r.exit_code()) == (False, 2) and [tuple(x) for x in r.issues.collect()] == [("unsupported-archive", "b.7z")]
    assert find_rules(environment={"QUILLSCAN_CONFIG_TOML": "[[rules]]\nid = 'env'\nregex = 'x'\n"}).rules[0].id == "env"
    assert find_rules() == default_rules()


def test_explanation(spark):
    got = {r.fragment_id: (r.n_matches, r.n_findings, r.reason) for r in explain(frags(spark, "key=ABCD", "key=AAAA key=ABCD", "key=AAAA", "key", "none"), RULES).collect()}
    assert got == {0: (1, 1, "reported"), 1: (2, 1, "reported"), 2: (1, 0, "filtered"), 3: (0, 0, "no-match")}


def test_results_do_not_depend_on_partitions(spark):
    df = frags(spark, *(f"a\nkey=AB{chr(65 + k)}D {'key=WXYZ' * (k % 3)}" for k in range(26)))
    one, many = (sorted(map(str, D.detect(df.repartition(n), RULES).collect())) for n in (1, 9))
    assert one == many and len(one) == 51


def render(spark, template, *texts):
    return "".join(to_template(D.detect(frags(spark, *texts), RULES), template))


def test_templates(spark):
    texts = ("key=ABCD", "key=EFGH")
    assert render(spark, "{{range $i, $f := .}}{{$i}} {{.RuleID | quote}} {{.File}}:{{.StartLine}}\n{{end}}total: {{len .}}\n", *texts) == '0 "k" f0.txt:0\n1 "k" f1.txt:0\ntotal: 2\n'
    assert render(spark, "{{ range . -}}\n  {{ .Secret }}{{ with .Tags }}{{ range . }} {{ . }}{{ end }}{{ end }};\n{{- end }}", *texts) == "ABCD x y;EFGH x y;"
    assert render(spark, "{{$n := len .}}{{range $i, $f := .}}{{.Secret}}{{if ne $i 1}}, {{end}}{{end}} {{sub $n 1}}{{if eq $n 2}}!{{end}}{{if .}}{{`}}`}}{{end}}", *texts) == "ABCD, EFGH 1!}}"
    assert render(spark, "{{range .}}x{{end}}none", "nothing") == "none"


@pytest.mark.parametrize("bad", ["{{", "{{end}}", "{{range .}}", "{{else}}", "{{define \"x\"}}", "{{}}", "{{| x}}", "{{$f.RuleID}}", "{{1 := 2}}"])
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        parse(bad)


@pytest.mark.parametrize("bad", ["{{printf .}}", "{{now}}", "{{.Nope}}", "{{$x}}", "{{range 3}}{{end}}", "{{len . .}}", "{{sub . 1}}"])
def test_templates_that_fail(spark, bad):
    with pytest.raises(TemplateError):
        render(spark, bad, "key=ABCD")


def test_a_template_that_does_too_much(spark):
    with pytest.raises(TemplateError):
        render(spark, "{{range .}}{{range $}}{{.RuleID}}{{end}}{{end}}", "key=ABCD", "key=EFGH")
    assert render(spark, "{{range .}}a{{end}}{{range .}}b{{end}}", "key=ABCD") == "ab"


def test_written_template(spark, tmp_path):
    report.write_report(D.detect(frags(spark, "key=ABCD"), RULES), "template", str(tmp_path / "r.txt"), template="{{range .}}{{.Secret}}{{end}}")
    assert (tmp_path / "r.txt").read_text() == "ABCD"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "remote, want",
    [
        ("git@github.com:o/r.git", ("github", "https://github.com/o/r")), ("https://user:pw@gitlab.com/o/r.git/", ("gitlab", "https://gitlab.com/o/r")), ("ssh://git@bitbucket.org:7999/o/r", ("bitbucket", "https://bitbucket.org/o/r")),
        ("https://dev.azure.com/o/p/_git/r", ("azuredevops", "https://dev.azure.com/o/p/_git/r")), ("https://codeberg.org/o/r", ("gitea", "https://codeberg.org/o/r")), ("https://example.org/o/r.git", (None, "https://example.org/o/r")),
    ],
)
def test_remotes(spark, remote, want):
    platform, web = T.scm_remote(F.lit(remote))
    assert (one(spark, platform), one(spark, web)) == want


def test_removed_secrets_and_segments(spark):
    assert one(spark, T.without_secrets(F.lit("a abc b abc ab"), F.array(F.lit("ab"), F.lit(""), F.lit("abc")))) == "a  b  "
    ok = lambda s: one(spark, T.segment_matches(F.lit(s), r"\{.*\}"))
    assert ok("x.eyJhIjoxfQ.y") and not ok("x.eyJhIjoxfQ") and not ok("x.e30=.y") and ok("x.e30.y") and not ok("x.YWJj.y") and not ok("x.!!.y")


def test_entropies(spark):
    assert one(spark, T.shannon_entropy(F.lit("AB12"))) == 2.0 and one(spark, T.shannon_entropy(F.lit(""))) == 0.0
    assert one(spark, T.byte_entropy(F.lit("éé"))) == 1.0
    # characters are counted, but over the length in bytes
    assert one(spark, T.shannon_entropy(F.lit("éé"))) == 0.5


def test_versions():
    assert T.version_at_least("v8.30.0", "8.30") and not T.version_at_least("8.29.9", "8.30.0") and T.version_at_least("8.30.0+build", "8.30.0")


def test_a_text_without_a_file_and_its_console_report(spark):
    from quillscan.operators.report import escaped, to_console
    from quillscan.plans.scan import scan_text

    r = scan_text(spark, "a\nkey=AB\x1bCD\n", load("[[rules]]\nid = 'k'\nregex = '''key=([^\\n]+)'''\n"))
    assert r.complete and [(x.file, x.start_line, x.secret) for x in r.findings.collect()] == [("", 2, "AB\x1bCD")]
    text = "".join(to_console(r.findings))
    assert "Secret:      AB\\x1bCD\n" in text and "Line:        2\n" in text and "File:" not in text and "Fingerprint: :k:2\n" in text
    assert escaped("a\tb\u202ec\x9f") == "a\tb\\u202ec\\x9f"


def test_stored_tables_are_discarded(spark, tmp_path):
    from quillscan import session

    first = session.stored_so_far()
    df = session.stored(spark.range(3))
    assert df.count() == 3 and session.stored_so_far() == first + 1
    assert session.discard(spark, first) == first
    assert session.stored_so_far() == first
