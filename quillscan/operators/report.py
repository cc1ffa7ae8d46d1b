"""Report sinks: JSON, CSV, SARIF, JUnit and templates. Rows are rendered on the executors; files stay whole where a format
is one document, so these writers are for reports, not for tables (write those as Parquet)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the report formats: fields in the order in which they are written.
JSON_FIELDS = (
    ("RuleID", "rule_id"), ("Description", "description"), ("StartLine", "start_line"), ("EndLine", "end_line"), ("StartColumn", "start_column"), ("EndColumn", "end_column"), ("Match", "match"), ("Secret", "secret"), ("File", "file"), ("SymlinkFile", None),
    ("Commit", "commit"), ("Entropy", "entropy"), ("Author", "author"), ("Email", "email"), ("Date", "date"), ("Message", "message"), ("Tags", "tags"), ("Fingerprint", "fingerprint"),
)
CSV_FIELDS = ("RuleID", "Commit", "File", "SymlinkFile", "Secret", "Match", "StartLine", "EndLine", "StartColumn", "EndColumn", "Author", "Message", "Date", "Email", "Fingerprint", "Tags")
_COLUMN = dict(JSON_FIELDS)
_ORDER = ["file", "start_line", "start_column", "rule_id", "secret", "match", "commit"]


def json_string(x: Column) -> Column:
    """A JSON string: <, > and &, the separators U+2028 and U+2029 and control characters are escaped."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for c in [*map(chr, range(32)), "<", ">", "&", " ", " "]:
        out = F.replace(out, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def number(x: Column) -> Column:
    """A 32-bit float in its shortest form; whole numbers without a point."""
    return F.when(x == F.floor(x), F.format_string("%d", F.floor(x))).otherwise(x.cast("string"))


def json_object(findings: DataFrame) -> Column:
    """One finding as an indented object, for an array in a report; null texts are empty."""
    lines = []
    for key, c in JSON_FIELDS:
        if c is None:
            value = F.lit('""')
        elif c in ("start_line", "end_line", "start_column", "end_column"):
            value = F.col(c).cast("string")
        elif c == "entropy":
            value = number(F.col(c))
        elif c == "tags":
            inner = F.concat(F.lit("[\n   "), F.array_join(F.transform(F.col(c), json_string), ",\n   "), F.lit("\n  ]"))
            value = F.when(F.coalesce(F.size(c), F.lit(0)) > 0, inner).otherwise("[]")
        else:
            value = json_string(F.coalesce(F.col(c), F.lit("")))
        lines.append(F.concat(F.lit(f'  "{key}": '), F.coalesce(value, F.lit("null"))))
    if "link" in findings.columns:  # after the commit, where there is one
        at = [k for k, _ in JSON_FIELDS].index("Commit") + 1
        lines.insert(at, F.when(F.length("link") > 0, F.concat(F.lit('  "Link": '), json_string(F.col("link")))))
    return F.concat(F.lit(" {\n"), F.concat_ws(",\n", *lines), F.lit("\n }"))


def csv_field(x: Column) -> Column:
    """Quoted if it holds a comma, a quote, CR or LF, or begins with a blank; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike(r'[,"\r\n]|\A[ \t]|\A\\\.\z'), quoted).otherwise(x)


def csv_line(findings: DataFrame) -> Column:
    parts = []
    for key in CSV_FIELDS:
        c = _COLUMN[key]
        x = F.lit("") if c is None else F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") if c == "tags" else F.coalesce(F.col(c).cast("string"), F.lit(""))
        parts.append(csv_field(x))
    if "link" in findings.columns:
        parts.append(csv_field(F.coalesce("link", F.lit(""))))
    return F.concat_ws(",", *parts)


def _rows(findings: DataFrame, *columns: Column) -> Iterator:
    return findings.select(*columns, *_ORDER).orderBy(*_ORDER).toLocalIterator()


def to_json(findings: DataFrame) -> Iterator[str]:
    """The parts of a JSON array of all findings in file order; without any, an empty array."""
    first = True
    for r in _rows(findings, json_object(findings).alias("o")):
        yield ("[\n" if first else ",\n") + r.o
        first = False
    yield "[]\n" if first else "\n]\n"


def to_csv(findings: DataFrame) -> Iterator[str]:
    """Header and lines; nothing without findings."""
    first = True
    for r in _rows(findings, csv_line(findings).alias("line")):
        if first:
            yield ",".join([*CSV_FIELDS, *(["Link"] if "link" in findings.columns else [])]) + "\n"
        yield r.line + "\n"
        first = False


def _place(r) -> str:
    return f"{r.rule_id} has detected a secret in file {r.file}, line {r.start_line}" + (f", at commit {r.commit}." if r.commit else ".")


def to_junit(findings: DataFrame, name: str = "quillscan") -> Iterator[str]:
    n = findings.count()
    quote = lambda x: escape(x or "", {'"': "&#34;", "'": "&#39;", "\n": "&#xA;", "\t": "&#x9;", "\r": "&#xD;"})
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites>\n\t<testsuite failures="{n}" name="{name}" tests="{n}" time="">\n'
    for r in _rows(findings, json_object(findings).alias("o"), F.col("description")):
        place, kind = quote(_place(r)), quote(r.description)
        yield f'\t\t<testcase classname="{kind}" file="{quote(r.file)}" name="{place}" time="">\n\t\t\t<failure message="{place}" type="{kind}">{quote(r.o)}</failure>\n\t\t</testcase>\n'
    yield "\t</testsuite>\n</testsuites>\n"


def to_sarif(findings: DataFrame, rules: Iterable[tuple[str, str]], name: str = "quillscan", version: str = "1.0.0") -> Iterator[str]:
    """SARIF 2.1.0; ``rules``: id and description of each, all of which are listed."""
    listed = [{"id": i, "shortDescription": {"text": d}} for i, d in rules]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
    driver = {"driver": {"name": name, "semanticVersion": version, "rules": listed}}
    yield json.dumps(head)[:-1] + ', "runs": [{"tool": ' + json.dumps(driver) + ', "results": ['
    first = True
    for r in _rows(findings, *(F.col(c) for c in ("end_line", "end_column", "email", "author", "date", "message", "tags"))):
        text = f"{r.rule_id} has detected secret for file {r.file}" + (f" at commit {r.commit}." if r.commit else ".")
        region = {"startLine": r.start_line, "startColumn": r.start_column, "endLine": r.end_line, "endColumn": r.end_column, "snippet": {"text": r.secret}}
        item = {
            "message": {"text": text}, "ruleId": r.rule_id, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.file}, "region": region}}],
            "partialFingerprints": {"commitSha": r.commit, "email": r.email, "author": r.author, "date": r.date, "commitMessage": r.message}, "properties": {"tags": r.tags or []},
        }
        yield ("" if first else ",") + "\n" + json.dumps(item, ensure_ascii=False)
        first = False
    yield "\n]}]}\n"


def escaped(text: str) -> str:
    """``text`` for a terminal: control characters (but for tabs), and those that turn the direction of writing, as escapes."""
    bad = lambda c: (ord(c) < 32 and c != "\t") or 127 <= ord(c) < 160 or ord(c) in (0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A))
    return "".join((f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}") if bad(c) else c for c in text)


def to_console(findings: DataFrame) -> Iterator[str]:
    """A block of labelled lines for each finding; fields that are empty are left out."""
    fields = {"Finding": "match", "Secret": "secret", "RuleID": "rule_id", "Entropy": "entropy", "File": "file", "Line": "start_line", "Commit": "commit", "Author": "author", "Email": "email", "Date": "date", "Fingerprint": "fingerprint"}
    for r in _rows(findings, *(F.col(c) for c in ("match", "entropy", "author", "email", "date", "fingerprint", "tags", "required_findings") if c not in _ORDER)):
        values = {label: getattr(r, c) for label, c in fields.items()} | {"Tags": " ".join(r.tags or [])}
        lines = [f"{label + ':':<13}{escaped(f'{v:f}' if label == 'Entropy' else str(v))}\n" for label, v in values.items() if v not in (None, "")]
        lines += [f"{'Required:':<13}{escaped(h.rule_id)} in line {h.start_line}: {escaped(h.secret)}\n" for h in r.required_findings or []]
        yield "".join(lines) + "\n"


def write_report(findings: DataFrame, kind: str, path: str, rules: Iterable[tuple[str, str]] = (), template: str = "") -> None:
    """Writes one file by the file system that ``path`` names: kind is json, csv, junit, console, sarif (which lists
    ``rules``) or template."""
    from quillscan.operators.template import to_template

    makers = {"json": to_json, "csv": to_csv, "junit": to_junit, "console": to_console, "sarif": lambda f: to_sarif(f, rules), "template": lambda f: to_template(f, template)}
    if kind not in makers:
        raise ValueError(f"unknown report: {kind}")
    spark = findings.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for text in makers[kind](findings):
            out.write(text.encode())
    finally:
        out.close()
