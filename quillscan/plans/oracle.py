"""DuckDB SQL for the queries of the catalog. It uses the rules' own patterns, in its own dialect (RE2)."""

from __future__ import annotations

from quillscan.functions.text import ALLOW_MARKERS
from quillscan.rules import Rule, default_rules

_FILE = "source || '/' || lang || '/' || doc_id || '.txt'"
_DOCS = f"SELECT doc_id AS fid, {_FILE} AS file, md5(source) AS commit, text AS t FROM documents"
_TOKEN = 'token = "([0-9a-f]{40})"'


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _entropy(s: str) -> str:
    """Of ASCII text."""
    return f"list_aggregate(string_split({s}, ''), 'entropy')"


def _found(source: str = _DOCS, pattern: str = _TOKEN, keyword: str = "token", entropy: float | None = 3.5, name: str = "f", first_line: int = 1) -> str:
    """CTEs that end in ``name``: fid, file, commit, t, k, match, secret, s and e (bytes), pre and post (the text around)."""
    p = _quoted(pattern)
    return f"""{name}0 AS ({source}),
{name}1 AS (SELECT *, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, 1) AS ss, string_split_regex(t, {p}) AS gs FROM {name}0 WHERE contains(lower(t), {_quoted(keyword)})),
{name}2 AS (SELECT fid, file, commit, t, unnest(range(1, len(ms) + 1)) AS k, ms, ss, gs FROM {name}1),
{name}3 AS (SELECT fid, file, commit, t, k, ms[k] AS match, ss[k] AS secret, array_to_string(gs[1:k], '') || array_to_string(ms[1:k - 1], '') AS lengths FROM {name}2),
{name}4 AS (SELECT fid, file, commit, t, k, match, secret, strlen(lengths) AS s, strlen(lengths) + strlen(match) AS e, left(t, length(lengths)) AS pre, substr(t, length(lengths) + length(match) + 1) AS post, {_entropy('secret')} AS h FROM {name}3),
{name}5 AS (SELECT *, strlen(pre) - strlen(replace(pre, chr(10), '')) AS first, strlen(t) - strlen(replace(t, chr(10), '')) AS total,
  CASE WHEN contains(pre, chr(10)) THEN strlen(pre) - strlen(string_split(pre, chr(10))[-1]) - 1 ELSE 0 END AS lastnl FROM {name}4),
{name} AS (SELECT *, CAST(first + {first_line} AS INTEGER) AS line_no, s - lastnl + 1 AS col, e - lastnl AS end_col,
  CASE WHEN total = 0 OR first >= total THEN pre || match || regexp_extract(post, '^[^\\r\\n]*')
  ELSE (CASE WHEN contains(pre, chr(10)) THEN chr(10) || string_split(pre, chr(10))[-1] ELSE pre END) || match || string_split(post, chr(10))[1] END AS line
  FROM {name}5{f' WHERE h > {entropy}' if entropy is not None else ''})"""


_BRIEF = "fid AS fragment_id, 'hex-token' AS rule_id, line_no AS start_line, CAST(s AS INTEGER) AS match_start, CAST(e AS INTEGER) AS match_end, secret"


def _brief(where: str = "true", **kw: object) -> str:
    return f"WITH {_found(**kw)} SELECT {_BRIEF} FROM f WHERE {where}"


def _gate(r: Rule) -> str:
    return "(" + " OR ".join(f"contains(lower(t), {_quoted(k)})" for k in r.keywords if k) + ")" if r.keywords else "true"


def _match_counts() -> str:
    source = "SELECT text AS t FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM conversations"
    each = [f"SELECT {_quoted(r.id)} AS rule_id, unnest(regexp_extract_all(t, {_quoted(r.regex)}, 0)) AS m FROM src WHERE {_gate(r)}" for r in default_rules().rules if r.regex]
    return f"WITH src AS ({source}), m AS ({' UNION ALL '.join(each)}) SELECT rule_id, count(*) AS n, CAST(sum(strlen(trim(m, chr(10)))) AS BIGINT) AS bytes FROM m GROUP BY rule_id"


def _json() -> str:
    esc = lambda x: f"replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    number = "CASE WHEN CAST(h AS FLOAT) = floor(CAST(h AS FLOAT)) THEN CAST(CAST(h AS BIGINT) AS VARCHAR) ELSE CAST(CAST(h AS FLOAT) AS VARCHAR) END"
    fields = [
        ("RuleID", "'\"hex-token\"'"), ("Description", "'\"a token\"'"), ("StartLine", "line_no"), ("EndLine", "line_no"), ("StartColumn", "col"), ("EndColumn", "end_col"),
        ("Match", f"'\"' || {esc('match')} || '\"'"), ("Secret", "'\"' || secret || '\"'"), ("File", "'\"' || file || '\"'"), ("SymlinkFile", "'\"\"'"), ("Commit", "'\"' || commit || '\"'"), ("Entropy", number),
        ("Author", "'\"\"'"), ("Email", "'\"\"'"), ("Date", "'\"\"'"), ("Message", "'\"\"'"), ("Tags", "'[]'"), ("Fingerprint", "'\"' || commit || ':' || file || ':hex-token:' || line_no || '\"'"),
    ]
    lines = " || ',' || chr(10) || ".join(f"'  \"{k}\": ' || {v}" for k, v in fields)
    obj = f"' {{' || chr(10) || {lines} || chr(10) || ' }}'"
    csv = "'hex-token,' || commit || ',' || file || ',,' || secret || ',\"' || replace(match, '\"', '\"\"') || '\",' || line_no || ',' || line_no || ',' || col || ',' || end_col || ',,,,,' || commit || ':' || file || ':hex-token:' || line_no || ','"
    return f"WITH {_found()} SELECT fid AS fragment_id, CAST(s AS INTEGER) AS match_start, sha256({obj}) AS json_sha256, sha256({csv}) AS csv_sha256 FROM f"


def _links() -> str:
    lines = lambda a, b: f"CASE WHEN kind = 1 THEN '' WHEN b <= a THEN '{a}' || a ELSE '{a}' || a || '{b}' || b END"
    plain = lambda q: f"CASE WHEN kind = 0 THEN '{q}' ELSE '' END"
    return f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS platform, p_partkey % 3 AS kind, md5(CAST(p_partkey AS VARCHAR)) AS c, p_partkey % 9 + 1 AS a, p_partkey % 9 + 1 + p_partkey % 2 AS b,
  'a%20%25/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.zip' ELSE '.py' END AS path FROM part)
SELECT p_partkey, CASE platform
  WHEN 0 THEN 'https://h/r/blob/' || c || '/' || path || {plain('?plain=1')} || {lines('#L', '-L')}
  WHEN 1 THEN 'https://h/r/blob/' || c || '/' || path || {plain('?plain=1')} || {lines('#L', '-')}
  WHEN 2 THEN 'https://h/r/src/commit/' || c || '/' || path || {plain('?display=source')} || {lines('#L', '-L')}
  WHEN 3 THEN 'https://h/r/src/' || c || '/' || path || {plain('?mode=view')} || {lines('#lines-', ':')}
  ELSE 'https://h/r/commit/' || c || '?path=/' || path || CASE WHEN kind = 1 THEN '' ELSE '&line=' || a || '&lineEnd=' || (b + 1) || '&lineStartColumn=1&lineEndColumn=1&lineStyle=plain&_a=contents' END END AS link FROM p"""


def _reviews() -> str:
    return """WITH c AS (SELECT md5(CAST(c_custkey AS VARCHAR)) AS fp, 'n' || c_nationkey AS src FROM customer),
r AS (SELECT o_orderkey AS id, md5(CAST(o_custkey + o_orderkey % 2 * 1000000 AS VARCHAR)) AS fp, o_orderkey % 5 = 0 AS old_policy, o_orderkey % 7 = 0 AS old_options, 'n' || (o_orderkey % 2 * 3) AS src, o_orderkey % 11 = 0 AS expired
  FROM orders),
k AS (SELECT id, r.fp, CASE WHEN old_policy THEN 'stale-policy' WHEN old_options THEN 'stale-options' WHEN c.fp IS NOT NULL AND c.src <> r.src THEN 'stale-source' WHEN expired THEN 'expired'
  WHEN c.fp IS NOT NULL THEN 'active' ELSE 'stale-occurrence' END AS state FROM r LEFT JOIN c ON r.fp = c.fp),
n AS (SELECT fp FROM c WHERE fp NOT IN (SELECT fp FROM k WHERE state = 'active'))
SELECT 'acknowledged' AS kind, state, count(*) AS n FROM k GROUP BY state UNION ALL SELECT 'new', 'new', count(*) FROM n HAVING count(*) > 0"""


def _encoded(how: str) -> str:
    """The whole value is one encoded run, whose place the columns give; of percent, each escape is decoded in its run."""
    plain = "('token = \"' || sha1(CAST(o_orderkey AS VARCHAR)) || '\"')"
    hexed = f"lower(hex(encode({plain})))"
    length = {"hex": f"length({hexed})", "base64": f"length(base64(encode({plain})))", "nested": f"length(base64(encode({hexed})))", "percent": f"length({plain}) + 10", "unicode": f"7 * length({plain})"}[how]
    tags = {"nested": "decoded:hex,decoded:base64,decode-depth:2"}.get(how, f"decoded:{how},decode-depth:1")
    # columns of a later line count from the line feed before it: x: and a blank stand before the value
    return f"SELECT o_orderkey AS fragment_id, sha1(CAST(o_orderkey AS VARCHAR)) AS secret, 1 AS start_line, 5 AS start_column, CAST(4 + {length} AS INTEGER) AS end_column, '{tags}' AS tags FROM orders"


def _pack() -> str:
    """Each rule over all texts, whichever token was put there."""
    from quillscan.plans.catalog import SAMPLES

    rows = ", ".join(f"({k}, {_quoted(p)}, {n}, {u})" for k, (_, p, n, u) in enumerate(SAMPLES))
    names = {x[0] for x in SAMPLES}
    each = [
        f"SELECT k, {_quoted(r.id)} AS rule_id, t, regexp_extract(t, {_quoted(r.regex)}, 0) AS m, regexp_extract(t, {_quoted(r.regex)}, 1) AS secret, {r.entropy} AS least FROM src WHERE regexp_matches(t, {_quoted(r.regex)}) AND {_gate(r)}"
        for r in default_rules().rules
        if r.id in names
    ]
    return f"""WITH s(i, p, n, u) AS (VALUES {rows}),
o AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) || sha256(o_orderkey || 'x') AS d FROM orders),
src AS (SELECT k, 'first' || chr(10) || 'then ' || p || CASE WHEN u THEN translate(upper(left(d, n)), '0189', 'GHIJ') ELSE left(d, n) END || ' end' || chr(10) AS t FROM o JOIN s ON k % {len(SAMPLES)} = i),
f AS ({' UNION ALL '.join(each)})
SELECT k AS fragment_id, rule_id, 1 AS start_line, CAST(strpos(t, m) - 5 AS INTEGER) AS start_column, CAST(strpos(t, m) - 1 AS INTEGER) AS match_start, secret FROM f
WHERE least = 0 OR {_entropy('secret')} > least"""


def oracle_sql() -> dict[str, str]:
    generic = f"""WITH {_found()}, {_found(pattern='= "([0-9a-f]{20,40})', keyword='=', entropy=None, name='g')}, {_found(pattern='[.] ([A-Z][a-z]{14,})', keyword='', entropy=None, name='c')},
  u AS (SELECT fid, 'generic-quoted' AS rule_id, line_no, s, secret FROM g UNION ALL SELECT fid, 'generic-capital', line_no, s, secret FROM c)
SELECT fid AS fragment_id, rule_id, line_no AS start_line, CAST(s AS INTEGER) AS match_start, secret FROM u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.fid = u.fid AND f.line_no = u.line_no AND contains(f.secret, u.secret))
UNION ALL SELECT fid, 'hex-token', line_no, CAST(s AS INTEGER), secret FROM f"""
    marked = _DOCS.replace("text AS t", f"CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '(token = \"[0-9a-f]{{40}}\")', '\\1 # {ALLOW_MARKERS[0]} ', 'g') ELSE text END AS t")
    masked = "left(secret, 10) || '...'"
    pages = "SELECT page_id AS fid, url AS file, '' AS commit, replace(html, '&quot;', '\"') AS t FROM pages"
    key = "upper(substr(translate(md5(CAST(conv_id AS VARCHAR)), '0189', 'GHIJ'), 1, 16))"
    talks = f"SELECT conv_id * 1000 + turn AS fid, '' AS file, '' AS commit, text || ' AKIA' || {key} || ' ' || text AS t FROM conversations"
    access = next(r for r in default_rules().rules if r.id == "aws-access-key").regex
    out = {
        "generic_token_findings": f"WITH {_found()} SELECT {_BRIEF}, round(CAST(CAST(h AS FLOAT) AS DOUBLE), 4) AS entropy FROM f",
        "keyword_prefilter_hits": "SELECT keyword, count(*) AS n_docs FROM documents, (SELECT unnest(['token', 'password', 'secret', 'license', 'email', 'bearer']) AS keyword) WHERE contains(lower(text), keyword) GROUP BY keyword",
        "entropy_profile": f"SELECT round(h, 3) AS bits, round(h, 3) AS byte_bits, count(*) AS n FROM (SELECT {_entropy('md5(CAST(o_orderkey AS VARCHAR))')} AS h FROM orders) GROUP BY 1, 2",
        "finding_locations": f"WITH {_found()} SELECT fid AS fragment_id, CAST(s AS INTEGER) AS match_start, line_no AS start_line, line_no AS end_line, CAST(col AS INTEGER) AS start_column, CAST(end_col AS INTEGER) AS end_column, sha256(line) AS line_sha256 FROM f",
        "path_only_rule": f"SELECT fid AS fragment_id, 'german-file' AS rule_id, 'file detected: ' || file AS match, 0 AS start_line, file FROM ({_DOCS}) WHERE regexp_matches(file, '(?i)/DE/[0-9]*7\\.txt$')",
        "path_and_regex_rule": _brief("regexp_matches(file, '/(?:de|es)/')"),
        "allowlist_secret": _brief("NOT regexp_matches(secret, '^[0-7]')"),
        "allowlist_match": _brief("NOT regexp_matches(match, '\"[a-f]')"),
        "allowlist_line": _brief("NOT regexp_matches(line, '(?i)\\b(?:der|the)\\b')"),
        "allowlist_stopword": _brief("NOT contains(secret, 'a1') AND NOT contains(secret, 'b2')"),
        "allowlist_and": _brief("NOT (regexp_matches(file, '/(?:en|fr)/') AND regexp_matches(secret, '^[0-7]'))"),
        "allowlist_commit": _brief("commit <> md5('src2')"),
        "allowlist_path": _brief("NOT regexp_matches(file, '^src1[0-9]/')"),
        "allow_marker": _brief(f"NOT contains(line, '{ALLOW_MARKERS[0]}')", source=marked),
        "fingerprints": f"WITH {_found()} SELECT fid AS fragment_id, CAST(s AS INTEGER) AS match_start, commit || ':' || file || ':hex-token:' || line_no AS fingerprint FROM f",
        "redacted_findings": f"WITH {_found()} SELECT fid AS fragment_id, CAST(s AS INTEGER) AS match_start, replace(match, secret, {masked}) AS match, {masked} AS secret, commit || ':' || file || ':hex-token:' || line_no AS fingerprint FROM f",
        "generic_suppression": generic,
        "required_proximity": f"WITH {_found()}, {_found(pattern='(' + chr(92) + 'b[A-Z][a-z]{5,}' + chr(92) + 'b)', keyword='', entropy=None, name='h')} SELECT f.fid AS fragment_id, f.line_no AS start_line, CAST(f.s AS INTEGER) AS match_start, count(*) AS n_helpers FROM f JOIN h ON f.fid = h.fid AND abs(f.line_no - h.line_no) <= 2 GROUP BY ALL",
        "rule_allowlist_path": _brief("NOT regexp_matches(file, '^src[0-4]/')"),
        "byte_entropy_gate": _brief("h >= 3.7", entropy=None),
        "same_candidate": _brief("h > 3.75"),
        "match_window": f"WITH {_found()}, {_found(pattern='(' + chr(92) + 'b[A-Z][a-z]{5,}' + chr(92) + 'b)', keyword='', entropy=None, name='h')} SELECT f.fid AS fragment_id, f.line_no AS start_line, CAST(f.s AS INTEGER) AS match_start, count(*) AS n_helpers FROM f JOIN h ON f.fid = h.fid AND abs(f.line_no - h.line_no) <= 1 GROUP BY ALL",
        "target_limit": _brief("strlen(t) <= 3000"),
        "pack_findings": _pack(),
        "ignore_set": _brief("NOT (fid % 3 = 0 AND line_no <= 9)"),
        "baseline_diff": _brief("fid % 2 = 0"),
        "presentation_groups": f"""WITH {_found()}, {_found(pattern='"([0-9a-f]{40})"', keyword='"', entropy=None, name='q')}, u AS (SELECT fid, s + 9 AS s, secret, 'hex-token' AS r FROM f UNION ALL SELECT fid, s + 1, secret, 'quoted-value' FROM q)
SELECT fid AS fragment_id, CAST(s AS BIGINT) AS secret_start, secret, string_agg(r, ',' ORDER BY r) AS rule_ids, count(*) AS n FROM u GROUP BY fid, s, secret""",
        "rule_match_counts": _match_counts(),
        "page_findings": f"WITH {_found(pages, first_line=0)} SELECT fid AS fragment_id, line_no AS start_line, secret, file || ':hex-token:' || line_no AS fingerprint FROM f",
        "conversation_findings": f"WITH {_found(talks, access, 'a', 3, first_line=0)} SELECT fid AS fragment_id, 'aws-access-key' AS rule_id, line_no AS start_line, secret, CAST(s AS INTEGER) AS match_start FROM f",
        "findings_by_source_lang": f"WITH {_found()} SELECT string_split(file, '/')[1] AS source, string_split(file, '/')[2] AS lang, count(*) AS n, count(DISTINCT secret) AS secrets FROM f GROUP BY CUBE (source, lang) HAVING count(*) > 0",
        "top_sources": f"WITH {_found()} SELECT string_split(file, '/')[1] AS source, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, source LIMIT 5",
        "review_states": _reviews(),
        "quality_score": f"""WITH {_found(entropy=None)}, p AS (SELECT * FROM f WHERE fid % 4 > 0), x AS (SELECT * FROM f WHERE h > 3.75),
  t AS (SELECT count(*) FILTER (fid % 4 > 0) AS tp, count(*) FILTER (fid % 4 = 0 AND fid % 5 = 0) AS unknown, count(*) FILTER (fid % 4 = 0 AND fid % 5 > 0) AS fp FROM x), m AS (SELECT count(*) AS fn FROM p WHERE h <= 3.75)
SELECT tp, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS attribution_mismatch, unknown, fp, CAST(0 AS BIGINT) AS misplaced, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM t, m""",
        "scm_links": _links(),
        "report_rows": _json(),
        "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
    return out | {f"decode_{how}": _encoded(how) for how in ("hex", "base64", "percent", "unicode", "nested")}
