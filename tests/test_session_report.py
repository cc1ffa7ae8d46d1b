"""Ignore lists, baselines, scores, links and reports."""

import json
import xml.etree.ElementTree as ET

from quillscan.operators import report, session as S
from quillscan.plans import detect as D
from quillscan.rules import load

RULES = load("[[rules]]\nid = 'test-rule'\ndescription = 'Test <Rule>'\nregex = 'key=([A-Z]+)'\ntags = ['t1', 't2']\n")


def findings(spark, *texts, **more):
    rows = [(k, t, f"f{k}.txt") for k, t in enumerate(texts)]
    return D.detect(spark.createDataFrame(rows, "fragment_id long, content string, file_path string"), RULES, **more)


def test_ignore_entries():
    got, odd = S.ignore_entries(" C:\\dir\\file.txt:rule:7 \n# note\n\na:b:c:d:5\nplain:rule:1\n" + "x" * 65536 + "\nafter:rule:1")
    assert got == ["C:/dir/file.txt:rule:7", "a:b:c:d:5", "plain:rule:1"] and odd == ["a:b:c:d:5"]


def test_ignored_and_baseline(spark):
    found = findings(spark, "key=AA", "key=BB", "key=AA")
    left = S.without_ignored(found, spark.createDataFrame([("f1.txt:test-rule:0",), ("f1.txt:test-rule:0",)], "entry string"))
    assert sorted(r.file for r in left.collect()) == ["f0.txt", "f2.txt"]
    changed = findings(spark, "key=AB", "key=BB", "key=AA")
    assert [r.file for r in S.new_findings(found, changed).collect()] == ["f0.txt"]
    # a redacted baseline says nothing of secrets; the entropy still differs
    assert [r.file for r in S.new_findings(found, changed, redacted=True).collect()] == ["f0.txt"]
    assert S.new_findings(found, found.limit(0)).count() == 3


def test_json_csv_and_baseline_round_trip(spark, tmp_path):
    found = findings(spark, 'key=AA <&> "q"', "none", "x\nkey=BCD\n")
    text = "".join(report.to_json(found))
    rows = json.loads(text)
    assert [(r["RuleID"], r["Secret"], r["Tags"], r["StartLine"], r["Description"]) for r in rows] == [("test-rule", "AA", ["t1", "t2"], 0, "Test <Rule>"), ("test-rule", "BCD", ["t1", "t2"], 1, "Test <Rule>")]
    assert list(rows[0]) == [k for k, _ in report.JSON_FIELDS] and "\\u003cRule\\u003e" in text and rows[0]["Entropy"] == 0
    assert "".join(report.to_json(found.limit(0))) == "[]\n" and "".join(report.to_csv(found.limit(0))) == ""
    report.write_report(found, "json", str(tmp_path / "r.json"))
    assert S.new_findings(found, S.read_baseline(spark, str(tmp_path / "r.json"))).collect() == []
    lines = "".join(report.to_csv(found)).splitlines()
    assert lines[0] == ",".join(report.CSV_FIELDS) and lines[1] == "test-rule,,f0.txt,,AA,key=AA,0,0,1,6,,,,,f0.txt:test-rule:0,t1 t2"


def test_junit_and_sarif(spark):
    found = findings(spark, "key=AA", "key=BB")
    root = ET.fromstring("".join(report.to_junit(found)))
    assert root[0].get("failures") == "2" and root[0][0].get("name") == "test-rule has detected a secret in file f0.txt, line 0."
    assert json.loads(root[0][0][0].text)["Secret"] == "AA"
    doc = json.loads("".join(report.to_sarif(found, [(r.id, r.description) for r in RULES.rules])))
    assert [r["locations"][0]["physicalLocation"]["region"]["snippet"]["text"] for r in doc["runs"][0]["results"]] == ["AA", "BB"]
    assert doc["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "test-rule"


def test_score(spark):
    found = spark.createDataFrame([(1, "a", 0, 5, "x"), (1, "b", 0, 5, "x"), (1, "a", 7, 9, "y"), (2, "a", 0, 3, "z"), (2, "a", 8, 9, "u"), (3, "c", 0, 2, "w")], "case_id int, rule_id string, start int, end int, secret string")
    good = spark.createDataFrame([(1, 0, 5, "x", ["a"]), (1, 6, 9, "y", ["a"]), (3, 0, 2, "w", ["a"])], "case_id int, start int, end int, secret string, rule_ids array<string>")
    unknown = spark.createDataFrame([(2, 8, 20)], "case_id int, start int, end int")
    r = S.score(found, good, unknown).first()
    assert (r.tp, r.duplicates, r.attribution_mismatch, r.unknown, r.fp, r.misplaced, r.fn) == (2, 1, 1, 1, 2, 1, 1)
    assert (r.precision, r.recall) == (0.5, 2 / 3)


def test_canonical_order(spark):
    found = findings(spark, "key=B key=A", "key=C")
    assert [r.secret for r in S.canonical(found).collect()] == ["B", "A", "C"]
