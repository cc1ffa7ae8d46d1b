"""The queries over the library's own operators, and DuckDB SQL for each.

Inputs that the tables don't hold (paths, commits, encodings) are made from their columns, in the same way on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import text as T
from quillscan.operators import decode, report, session as S
from quillscan.plans import detect as D
from quillscan.rules import RuleSet, default_rules, load
from quillscan.session import table
from quillscan.streaming import windowed_counts

PATTERN = 'token = "([0-9a-f]{40})"'
#: The commit that stands for one of the sources.
COMMIT = hashlib.md5(b"src2").hexdigest()
KEYWORDS = ("token", "password", "secret", "license", "email", "bearer")


def rules(extra: str = "", before: str = "", entropy: float = 3.5, name: str = "hex-token") -> RuleSet:
    """The rule for the tables' planted tokens, with more TOML after it or before it."""
    return load(f"{before}\n[[rules]]\nid = '{name}'\ndescription = 'a token'\nregex = '''{PATTERN}'''\nkeywords = ['token']\nentropy = {entropy}\n{extra}")


def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("fragment_id"), F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).alias("file_path"), F.md5("source").alias("commit"), F.lit(1).alias("start_line"), F.col("text").alias("content"))


def _documents(select: list[str], **kw: object) -> Callable[[SparkSession, str], DataFrame]:
    """Findings of ``rules(**kw)`` in the documents."""
    return lambda spark, sf_dir: D.detect(document_fragments(spark, sf_dir), rules(**kw)).selectExpr(*select)


_BRIEF = ["fragment_id", "rule_id", "start_line", "match_start", "match_end", "secret"]


def generic_token_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.detect(document_fragments(spark, sf_dir), rules())
    return found.selectExpr(*_BRIEF, "round(cast(entropy as double), 4) AS entropy")


def keyword_prefilter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "documents").select(F.lower("text").alias("low"))
    hits = low.select(F.explode(F.filter(F.array(*(F.when(F.contains("low", F.lit(k)), F.lit(k)) for k in KEYWORDS)), lambda x: x.isNotNull())).alias("keyword"))
    return hits.groupBy("keyword").agg(F.count("*").alias("n_docs"))


def entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies of commit hashes and of part names, in characters and in bytes."""
    a = table(spark, sf_dir, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("secret"))
    return a.select(F.round(T.shannon_entropy(F.col("secret")), 3).alias("bits"), F.round(T.byte_entropy(F.col("secret")), 3).alias("byte_bits")).groupBy("bits", "byte_bits").agg(F.count("*").alias("n"))


def path_only_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = load("[[rules]]\nid = 'german-file'\npath = '(?i)/DE/[0-9]*7\\.txt$'")
    return D.detect(document_fragments(spark, sf_dir), only).select("fragment_id", "rule_id", "match", "start_line", "file")


def allow_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = document_fragments(spark, sf_dir)
    marked = F.when(F.col("fragment_id") % 2 == 0, F.regexp_replace("content", '(token = "[0-9a-f]{40}")', f"$1 # {T.ALLOW_MARKERS[0]} ")).otherwise(F.col("content"))
    return D.detect(f.withColumn("content", marked), rules()).select(*_BRIEF)


def redacted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(document_fragments(spark, sf_dir), rules(), D.Options(redaction_percent=75)).select("fragment_id", "match_start", "match", "secret", "fingerprint")


_GENERIC = "[[rules]]\nid = 'generic-quoted'\nregex = '''= \"([0-9a-f]{20,40})'''\nkeywords = ['=']\n[[rules]]\nid = 'generic-capital'\nregex = '''[.] ([A-Z][a-z]{14,})'''\n"


def generic_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(document_fragments(spark, sf_dir), rules(_GENERIC)).select("fragment_id", "rule_id", "start_line", "match_start", "secret")


def required_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a capitalised word of 6 letters or more at most two lines away."""
    extra = "required = [{id = 'long-word', withinLines = 2}]\n[[rules]]\nid = 'long-word'\nregex = '''\\b[A-Z][a-z]{5,}\\b'''\nskipReport = true\n"
    found = D.detect(document_fragments(spark, sf_dir), rules(extra))
    return found.select("fragment_id", "start_line", "match_start", F.size("required_findings").cast("long").alias("n_helpers"))


def same_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a stricter helper rule matches at the very same place."""
    extra = f"required = [{{id = 'strict', relation = 'same-candidate'}}]\n[[rules]]\nid = 'strict'\nregex = '''{PATTERN}'''\nentropy = 3.75\nskipReport = true\n"
    return D.detect(document_fragments(spark, sf_dir), rules(extra)).select(*_BRIEF)


def match_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a capitalised word that starts within two lines of the whole match, its own included."""
    extra = "required = [{id = 'long-word', withinLines = 2, relation = 'window'}]\n[[rules]]\nid = 'long-word'\nregex = '''\\b[A-Z][a-z]{5,}\\b'''\nskipReport = true\n"
    found = D.detect(document_fragments(spark, sf_dir), rules(extra))
    return found.select("fragment_id", "start_line", "match_start", F.size("required_findings").cast("long").alias("n_helpers"))


def target_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rules pass over texts of more bytes than a limit."""
    return D.detect(document_fragments(spark, sf_dir), rules(), D.Options(max_target_bytes=3000)).select(*_BRIEF)


def ignore_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.detect(document_fragments(spark, sf_dir), rules())
    entries = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(9)))).select(F.concat_ws(":", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")), F.lit("hex-token"), "line").alias("entry"))
    return S.without_ignored(found, entries).select(*_BRIEF)


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of all finds beyond a scan of every other document."""
    f = document_fragments(spark, sf_dir)
    return S.new_findings(D.detect(f, rules()), D.detect(f.where("fragment_id % 2 = 1"), rules())).select(*_BRIEF)


def presentation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = rules("[[rules]]\nid = 'quoted-value'\nregex = '''\"([0-9a-f]{40})\"'''\nkeywords = ['\"']\n")
    groups = S.presentation_groups(D.detect(document_fragments(spark, sf_dir), two))
    return groups.select("fragment_id", F.col("secret_start").cast("long").alias("secret_start"), "secret", F.concat_ws(",", "rule_ids").alias("rule_ids"), "n")


def rule_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole matches of every rule of the default pack in all texts, before filters."""
    texts = [table(spark, sf_dir, t).select(F.monotonically_increasing_id().alias("fragment_id"), F.col(c).alias("content")) for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    names = F.array(*(F.lit(r.id) for r in D.content_rules(default_rules())))
    found = D.matches(D.fragments(texts[0].union(texts[1]).union(texts[2])), default_rules())
    return found.groupBy(F.get(names, F.col("rule_no")).alias("rule_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("match")).alias("bytes"))


#: Rules of the pack whose tokens are a prefix and letters that a hash has: rule, prefix, length, upper case.
SAMPLES = [
    ("adobe-client-secret", "p8e-", 32, False), ("anthropic-api-key", "sk-ant-api03-", 95, False), ("aws-access-key", "AKIA", 16, True), ("databricks-api-token", "dapi", 32, False),
    ("digitalocean-pat", "dop_v1_", 64, False), ("doppler-api-token", "dp.pt.", 43, False), ("easypost-api-token", "EZAK", 54, False), ("gcp-api-key", "AIza", 35, False),
    ("github-app-token", "ghs_", 36, False), ("github-fine-grained-pat", "github_pat_", 82, False), ("github-oauth", "gho_", 36, False), ("github-pat", "ghp_", 36, False),
    ("gitlab-pat", "glpat-", 20, False), ("gitlab-ptt", "glptt-", 40, False), ("gitlab-rrt", "GR1348941", 20, False), ("grafana-cloud-api-token", "glc_", 60, False),
    ("infracost-api-token", "ico-", 32, False), ("linear-api-key", "lin_api_", 40, False), ("npm-access-token", "npm_", 36, False), ("octopus-deploy-api-key", "API-", 26, True),
    ("openshift-user-token", "sha256~", 43, False), ("prefect-api-token", "pnu_", 36, False), ("pulumi-api-token", "pul-", 40, False), ("readme-api-token", "rdme_", 70, False),
    ("rubygems-api-token", "rubygems_", 48, False), ("scalingo-api-token", "tk-us-", 48, False), ("sentry-user-token", "sntryu_", 64, False), ("shopify-access-token", "shpat_", 32, False),
    ("stripe-access-token", "sk_live_", 24, False), ("twilio-api-key", "SK", 32, False),
    ("datadog-access-token", "datadog_key = ", 40, False), ("fastly-api-token", "FASTLY: ", 32, False), ("okta-access-token", "okta-token => 00", 40, False), ("zendesk-secret-key", "zendesk.secret := ", 40, False),
]


def pack_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of many providers, made from order keys, found by their rules."""
    key = F.col("o_orderkey").cast("string")
    digits = F.concat(F.sha2(key, 256), F.sha2(F.concat(key, F.lit("x")), 256))
    which = (F.col("o_orderkey") % len(SAMPLES)).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(x[k]) for x in SAMPLES)), which)
    cut = F.substring(digits, F.lit(1), pick(2))
    text = F.concat(F.lit("first\nthen "), pick(1), F.when(pick(3), F.translate(F.upper(cut), "0189", "GHIJ")).otherwise(cut), F.lit(" end\n"))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fragment_id"), text.alias("content"))
    found = D.detect(f, default_rules().select([x[0] for x in SAMPLES]))
    return found.select("fragment_id", "rule_id", "start_line", "start_column", "match_start", "secret")


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in pages, whose quotes are escaped."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("fragment_id"), F.col("url").alias("file_path"), F.replace("html", F.lit("&quot;"), F.lit('"')).alias("content"))
    return D.detect(pages, rules()).select("fragment_id", "start_line", "secret", "fingerprint")


def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access keys put into all turns."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit(" AKIA"), F.upper(F.substring(F.translate(F.md5(F.col("conv_id").cast("string")), "0189", "GHIJ"), 1, 16)), F.lit(" "))
    f = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("fragment_id"), F.concat("text", key, "text").alias("content"))
    return D.detect(f, default_rules().select(["aws-access-key"])).select("fragment_id", "rule_id", "start_line", "secret", "match_start")


def findings_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.detect(document_fragments(spark, sf_dir), rules())
    part = found.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("source"), F.split_part("file", F.lit("/"), F.lit(2)).alias("lang"), "secret")
    return part.cube("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("secret").alias("secrets"))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sources with the most findings (a top-k report)."""
    found = D.detect(document_fragments(spark, sf_dir), rules()).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("source"))
    return found.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as review records of customers' occurrences."""
    c = table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("fingerprint"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"))
    o = table(spark, sf_dir, "orders")
    records = o.select(F.col("o_orderkey").alias("record_id"), F.md5((F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000000).cast("string")).alias("fingerprint"), F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise("p1").alias("policy"), F.when(F.col("o_orderkey") % 7 == 0, "old").otherwise("o1").alias("options"), F.concat(F.lit("n"), (F.col("o_orderkey") % 2 * 3).cast("string")).alias("source"), F.when(F.col("o_orderkey") % 11 == 0, 5).cast("long").alias("expires"))
    return S.review_states(c, records, "p1", "o1", 10).groupBy("kind", "state").agg(F.count("*").alias("n"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a stricter rule against those of a wider one as labels."""
    f = document_fragments(spark, sf_dir)
    span = ["fragment_id AS case_id", "rule_id", "secret_start AS start", "secret_end AS end", "secret"]
    labels = D.detect(f, rules(entropy=0)).selectExpr(*span)
    found = D.detect(f, rules(entropy=3.75)).selectExpr(*span)
    unknown = labels.where("case_id % 5 = 0").select("case_id", "start", "end")
    return S.score(found, labels.where("case_id % 4 > 0").select("case_id", "start", "end", "secret", F.array("rule_id").alias("rule_ids")), unknown)


def scm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of parts' lines on each platform."""
    p = table(spark, sf_dir, "part")
    platform = F.element_at(F.array(*map(F.lit, ("github", "gitlab", "gitea", "bitbucket", "azuredevops"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    file = F.concat(F.lit("a %/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".md").when(F.col("p_partkey") % 3 == 1, ".zip!in.txt").otherwise(".py"))
    url = T.scm_link(platform, F.lit("https://h/r"), F.md5(F.col("p_partkey").cast("string")), file, F.col("p_partkey") % 9 + 1, F.col("p_partkey") % 9 + 1 + F.col("p_partkey") % 2)
    return p.select("p_partkey", url.alias("link"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object and a CSV line for each finding."""
    found = D.detect(document_fragments(spark, sf_dir), rules())
    return found.select("fragment_id", "match_start", F.sha2(report.json_object(found), 256).alias("json_sha256"), F.sha2(report.csv_line(found), 256).alias("csv_sha256"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed counts that streaming offers."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def _encoded(how: str) -> Callable[[SparkSession, str], DataFrame]:
    """Tokens made from order keys, encoded in one of five ways, found in decoded text with places in the encoded one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders")
        plain = F.concat(F.lit('token = "'), F.sha1(F.col("o_orderkey").cast("string")), F.lit('"'))
        raw = F.encode(plain, "UTF-8")
        text = {
            "hex": F.lower(F.hex(raw)), "base64": F.base64(raw), "nested": F.base64(F.encode(F.lower(F.hex(raw)), "UTF-8")),
            "percent": F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit('"'), F.lit("%22")), " ", "%20"), "=", "%3D"),
            "unicode": F.regexp_replace(F.hex(raw), "(..)", "\\\\\\\\u00$1"),
        }[how]
        f = o.select(F.col("o_orderkey").alias("fragment_id"), F.concat(F.lit("first line\nx: "), F.regexp_replace(text, "[\r\n]", ""), F.lit(" .\nlast")).alias("content"))
        found = decode.detect_decoded(f, rules(entropy=0), max_depth=5)
        return found.select("fragment_id", "secret", "start_line", "start_column", "end_column", F.concat_ws(",", "tags").alias("tags"))

    return query


_AND = "[[rules.allowlists]]\ncondition = 'AND'\npaths = ['/(?:en|fr)/']\nregexes = ['^[0-7]']\n"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "generic_token_findings": generic_token_findings,
    "keyword_prefilter_hits": keyword_prefilter_hits,
    "entropy_profile": entropy_profile,
    "finding_locations": _documents(["fragment_id", "match_start", "start_line", "end_line", "start_column", "end_column", "sha2(line, 256) AS line_sha256"]),
    "path_only_rule": path_only_rule,
    "path_and_regex_rule": _documents(_BRIEF, extra="path = '/(?:de|es)/'"),
    "allowlist_secret": _documents(_BRIEF, extra="[[rules.allowlists]]\nregexes = ['^[0-7]']\n"),
    "allowlist_match": _documents(_BRIEF, extra="[[rules.allowlists]]\nregexTarget = 'match'\nregexes = ['\"[a-f]']\n"),
    "allowlist_line": _documents(_BRIEF, extra="[[rules.allowlists]]\nregexTarget = 'line'\nregexes = ['(?i)\\b(?:der|the)\\b']\n"),
    "allowlist_stopword": _documents(_BRIEF, before="[[allowlists]]\nstopwords = ['A1', 'b2']\n"),
    "allowlist_and": _documents(_BRIEF, extra=_AND),
    "allowlist_commit": _documents(_BRIEF, before=f"[[allowlists]]\ncommits = ['{COMMIT.upper()}']\n"),
    "allowlist_path": _documents(_BRIEF, before="[[allowlists]]\npaths = ['^src1[0-9]/']\n"),
    "rule_allowlist_path": _documents(_BRIEF, extra="[[rules.allowlists]]\npaths = ['^src[0-4]/']\n"),
    "byte_entropy_gate": _documents(_BRIEF, extra="byteEntropy = 3.7\n", entropy=0),
    "same_candidate": same_candidate,
    "match_window": match_window,
    "target_limit": target_limit,
    "pack_findings": pack_findings,
    "allow_marker": allow_marker,
    "fingerprints": _documents(["fragment_id", "match_start", "fingerprint"]),
    "redacted_findings": redacted_findings,
    "generic_suppression": generic_suppression,
    "required_proximity": required_proximity,
    "ignore_set": ignore_set,
    "baseline_diff": baseline_diff,
    "presentation_groups": presentation_groups,
    "rule_match_counts": rule_match_counts,
    "page_findings": page_findings,
    "conversation_findings": conversation_findings,
    "findings_by_source_lang": findings_by_source_lang,
    "top_sources": top_sources,
    "review_states": review_states,
    "quality_score": quality_score,
    "scm_links": scm_links,
    "report_rows": report_rows,
    "event_windows": event_windows,
    **{f"decode_{how}": _encoded(how) for how in ("hex", "base64", "percent", "unicode", "nested")},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from quillscan.plans.oracle import oracle_sql as found

    return found()
