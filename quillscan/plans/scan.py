"""Whole scans: detection with decode passes, then ignore lists and a baseline; issues and counts beside the findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions import text as T
from quillscan.operators import session as S
from quillscan.operators.decode import detect_decoded
from quillscan.plans import detect as D
from quillscan.rules import RuleSet, default_rules, load
from quillscan.session import stored
from quillscan.sources import files, patches

#: Names under which a folder's own configuration is looked for, in this order.
CONFIG_NAMES = (".quillscan.toml", ".gitleaks.toml")


@dataclass
class ScanResult:
    """``issues`` (kind, path): what wasn't scanned. A scan is complete if it has none."""

    findings: DataFrame
    issues: DataFrame
    metrics: dict[str, int] = field(default_factory=dict)

    @property
    def complete(self) -> bool:
        return not self.issues.limit(1).count()

    def exit_code(self, found: int = 1) -> int:
        """0: nothing found, ``found``: something, 2: the scan is incomplete."""
        return 2 if not self.complete else found if self.findings.limit(1).count() else 0

    def status(self) -> str:
        """One line of key=value."""
        values = {"complete": str(self.complete).lower(), **self.metrics, "issues": self.issues.count()}
        return " ".join(f"{k}={v}" for k, v in values.items())


def find_rules(folder: str | None = None, config: str | None = None, environment: dict[str, str] | None = None) -> RuleSet:
    """The rules of ``config``, else of the file that QUILLSCAN_CONFIG names, else of the text in QUILLSCAN_CONFIG_TOML, else
    of a file of CONFIG_NAMES in ``folder``, else this library's own."""
    env = environment or {}
    if path := config or env.get("QUILLSCAN_CONFIG"):
        return load(Path(path).read_text())
    if text := env.get("QUILLSCAN_CONFIG_TOML"):
        return load(text)
    for name in CONFIG_NAMES if folder else ():
        if (file := Path(folder) / name).is_file():
            return load(file.read_text())
    return default_rules()


def scan_table(
    df: DataFrame, rules: RuleSet, options: D.Options = D.Options(), max_decode_depth: int = 0, ignored: list[str] | None = None, baseline: DataFrame | None = None,
    link: tuple[str, str] | None = None, issues: DataFrame | None = None,
) -> ScanResult:
    """Scans ``df`` (see detect.FRAGMENT). ``ignored``: lines of an ignore file; ``link``: platform and address of a hosted
    repository, for a link column. The findings are a stored table; the metrics count them and what was read."""
    spark = df.sparkSession
    found = detect_decoded(df, rules, options, max_decode_depth) if max_decode_depth else D.detect(df, rules, options)
    if ignored:
        entries, _ = S.ignore_entries("\n".join(ignored))
        found = S.without_ignored(found, spark.createDataFrame([(e,) for e in entries], "entry string"))
    if baseline is not None:
        found = S.new_findings(found, baseline, redacted=options.redaction_percent > 0)
    if link:
        found = found.withColumn("link", F.coalesce(T.scm_link(F.lit(link[0]), F.lit(link[1]), F.col("commit"), F.col("file"), F.col("start_line"), F.col("end_line")), F.lit("")))
    found = stored(found)
    frags = D.fragments(df)
    r = frags.agg(F.count("*").alias("fragments"), F.sum(F.octet_length("content")).alias("bytes"), F.countDistinct(F.nullif("commit", F.lit(""))).alias("commits")).first()
    metrics = {"fragments": r.fragments, "bytes": r.bytes or 0, "commits": r.commits, "findings": found.count()}
    return ScanResult(found, issues if issues is not None else spark.createDataFrame([], "kind string, path string"), metrics)


def scan_directory(spark: SparkSession, path: str, rules: RuleSet, options: D.Options = D.Options(), max_file_size: int | None = None, archive_depth: int = 0, skip: tuple[str, ...] = CONFIG_NAMES, whole_files: bool = False, **more: object) -> ScanResult:
    """Scans all files below ``path``. ``whole_files``: files aren't cut into chunks."""
    part = (1 << 62) if whole_files else files.PART
    frags, issues = files.directory(spark, path, rules, max_file_size, archive_depth, part, skip)
    return scan_table(frags, rules, options, issues=issues, **more)


def scan_text(spark: SparkSession, text: str, rules: RuleSet, options: D.Options = D.Options(), **more: object) -> ScanResult:
    """Scans one text without a file, as from standard input, in chunks."""
    rows = files.chunked(spark.createDataFrame([("", text.encode())], "file_path string, content binary"))
    return scan_table(rows.withColumn("fragment_id", F.xxhash64("file_path", "chunk")), rules, options, **more)


def scan_git(spark: SparkSession, repo: str, rules: RuleSet, options: D.Options = D.Options(), staged: bool | None = None, **more: object) -> ScanResult:
    """Scans what all commits added; ``staged``: what isn't committed instead (True: what is staged of it)."""
    source = patches.git_history(spark, repo) if staged is None else patches.git_diff(spark, repo, staged)
    return scan_table(source.withColumn("fragment_id", F.xxhash64("commit", "file_path", "start_line")), rules, options, **more)


def explain(df: DataFrame, rules: RuleSet, options: D.Options = D.Options()) -> DataFrame:
    """For every fragment and content rule whose gates open, how far it came: fragment_id, rule_id, n_matches, n_findings and
    reason (no-match, filtered, suppressed, reported)."""
    frags = D.fragments(df)
    content = D.content_rules(rules)
    names = F.array(*(F.lit(r.id) for r in content))
    opened = D.opened(frags, content, options).select("fragment_id", F.get(names, F.col("rule_no")).alias("rule_id"))
    key = ["fragment_id", "rule_id"]
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    matched = count(D.matches(frags, rules, options).withColumn("rule_id", F.get(names, F.col("rule_no"))), "n_matches")
    passed = count(D.candidates(frags, rules, options), "n_passed")
    reported = count(D.detect(df, rules, options), "n_findings")
    out = opened.join(matched, key, "left").join(passed, key, "left").join(reported, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(n("n_matches") == 0, "no-match").when(n("n_passed") == 0, "filtered").when(n("n_findings") == 0, "suppressed").otherwise("reported")
    return out.select(*key, n("n_matches").alias("n_matches"), n("n_findings").alias("n_findings"), reason.alias("reason"))
