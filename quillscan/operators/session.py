"""What happens to findings after a scan: ignore lists, baselines, review states, groups, order and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.session import broadcast_if_small

#: What makes a finding of a baseline the same; match and secret only count if the baseline isn't redacted.
BASELINE_KEY = ("rule_id", "description", "start_line", "end_line", "start_column", "end_column", "file", "commit", "author", "email", "date", "message", "entropy")
#: The canonical order of findings.
CANONICAL = ("file", "start_line", "start_column", "end_line", "end_column", "rule_id", "secret", "match", "commit", "description")
#: Bytes at which a line of an ignore file is too long; what follows it isn't read.
MAX_IGNORE_LINE = 65536


def ignore_entries(text: str) -> tuple[list[str], list[str]]:
    """The entries of an ignore file and the lines that have neither three nor four fields (which are kept as they are).

    Blanks around a line, empty lines and comments (#) are dropped; backslashes of the file field become slashes.
    """
    found, odd = [], []
    for line in text.split("\n"):
        if len(line.encode()) >= MAX_IGNORE_LINE:
            break
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        fields = line.split(":")
        # a drive letter's colon makes one field more
        if len(fields) in (3, 4, 5):
            line = ":".join([*fields[:-2], fields[-2], fields[-1]]).replace("\\", "/") if "\\" in line else line
        if len(line.split(":")) not in (3, 4):
            odd.append(line)
        found.append(line)
    return found, odd


def without_ignored(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """``findings`` without those whose file:rule:line, or that after their commit, is in ``ignored`` (entry)."""
    entries = ignored.select(F.col("entry").alias("ignored_entry")).distinct()
    entries = broadcast_if_small(entries)
    plain = F.concat_ws(":", "file", "rule_id", "start_line")
    left = findings.join(entries, plain == F.col("ignored_entry"), "left_anti")
    qualified = F.concat_ws(":", "commit", "file", "rule_id", "start_line")
    return left.join(entries, (F.length("commit") > 0) & (qualified == F.col("ignored_entry")), "left_anti")


def new_findings(findings: DataFrame, baseline: DataFrame, redacted: bool = False) -> DataFrame:
    """``findings`` that no row of ``baseline`` (a table of findings) equals; duplicates are kept."""
    keys = [*BASELINE_KEY, *(() if redacted else ("match", "secret"))]
    known = baseline.select(*(F.col(k).alias(f"known_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"known_{k}"))
    return findings.join(known, same, "left_anti")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report (an array of objects) as a table of findings; names of keys are compared without case.

    Absent fields have their zero value; unknown ones are passed over.
    """
    text = {"rule_id": "RuleID", "description": "Description", "match": "Match", "secret": "Secret", "file": "File", "commit": "Commit", "author": "Author", "email": "Email", "date": "Date", "message": "Message", "fingerprint": "Fingerprint"}
    lines = {"start_line": "StartLine", "end_line": "EndLine", "start_column": "StartColumn", "end_column": "EndColumn"}
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    there = {c.lower(): c for c in rows.columns}

    def of(name: str, kind: str, zero: object) -> Column:
        return F.coalesce(F.col(f"`{there[name.lower()]}`").cast(kind), F.lit(zero)) if name.lower() in there else F.lit(zero).cast(kind)

    return rows.select(*(of(v, "string", "").alias(k) for k, v in text.items()), *(of(v, "int", 0).alias(k) for k, v in lines.items()), of("Entropy", "float", 0.0).alias("entropy"))


def presentation_groups(findings: DataFrame) -> DataFrame:
    """Findings of one secret at one place: fragment_id, secret_start, secret_end, secret, rule_ids, n.

    A finding without a place is a group of its own.
    """
    alone = F.when(F.col("secret_start").isNull(), F.concat_ws(":", "rule_id", "fingerprint", "match"))
    rows = findings.withColumn("alone", alone).groupBy("fragment_id", "secret_start", "secret_end", "secret", "alone")
    return rows.agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"), F.count("*").alias("n")).drop("alone")


def canonical(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*CANONICAL)


def review_states(occurrences: DataFrame, records: DataFrame, policy: str, options: str, now: int, complete: bool = True) -> DataFrame:
    """The state of every review record, and each new occurrence.

    ``records``: record_id, fingerprint, policy, options, source, expires (Unix seconds or null); ``occurrences``:
    fingerprint, source. Of several reasons the first holds: stale-policy, stale-options, stale-source, expired, then
    active (seen), or stale-occurrence (not seen; unobserved if the scan was partial). Returns kind (acknowledged, new),
    record_id, fingerprint, state.
    """
    seen = occurrences.select(F.col("fingerprint").alias("seen"), F.col("source").alias("seen_source")).distinct()
    by_print = seen.groupBy("seen").agg(F.collect_set("seen_source").alias("sources"))
    joined = records.join(by_print, F.col("fingerprint") == F.col("seen"), "left")
    state = (
        F.when(F.col("policy") != policy, "stale-policy")
        .when(F.col("options") != options, "stale-options")
        .when(F.col("sources").isNotNull() & ~F.array_contains("sources", F.col("source")), "stale-source")
        .when(F.col("expires") <= now, "expired")
        .when(F.col("sources").isNotNull(), "active")
        .otherwise("stale-occurrence" if complete else "unobserved")
    )
    known = joined.select(F.lit("acknowledged").alias("kind"), "record_id", "fingerprint", state.alias("state"))
    active = known.where("state = 'active'").select(F.col("fingerprint").alias("seen"))
    new = by_print.join(active, "seen", "left_anti")
    return known.unionByName(new.select(F.lit("new").alias("kind"), F.lit(None).cast(records.schema["record_id"].dataType).alias("record_id"), F.col("seen").alias("fingerprint"), F.lit("new").alias("state")))


def score(findings: DataFrame, positives: DataFrame, unknown: DataFrame) -> DataFrame:
    """One row of counts and ratios of ``findings`` (case_id, rule_id, start, end, secret) against labels.

    ``positives``: case_id, start, end, secret, rule_ids (those that may find it); ``unknown``: case_id, start, end.
    A finding is true if span and secret are equal; else unknown if it overlaps an unknown region; else false: misplaced
    if it overlaps a positive. Further rules on a true span are duplicates.
    """
    spans = findings.groupBy("case_id", "start", "end", "secret").agg(F.collect_set("rule_id").alias("found_by"))
    p = positives.select(F.col("case_id").alias("pc"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("secret").alias("psecret"), "rule_ids").distinct()
    equal = F.expr("case_id = pc AND start = ps AND end = pe AND secret = psecret")
    true = spans.join(p, equal)
    rest = spans.join(p, equal, "left_anti")
    u = unknown.select(F.col("case_id").alias("uc"), F.col("start").alias("us"), F.col("end").alias("ue"))
    overlaps_u = F.expr("case_id = uc AND start < ue AND us < end")
    unknown_rows = rest.join(u, overlaps_u, "left_semi")
    false = rest.join(u, overlaps_u, "left_anti")
    misplaced = false.join(p, F.expr("case_id = pc AND start < pe AND ps < end"), "left_semi")
    missed = p.join(spans, equal, "left_anti")

    def count(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name) if value is not None else F.count("*").alias(name))

    mismatch = F.when(F.size(F.array_intersect("found_by", "rule_ids")) == 0, 1).otherwise(0)
    parts = [count(true, "tp"), count(true, "duplicates", F.size("found_by") - 1), count(true, "attribution_mismatch", mismatch), count(unknown_rows, "unknown"), count(false, "fp"), count(misplaced, "misplaced"), count(missed, "fn")]
    out = parts[0]
    for x in parts[1:]:  # rows of one
        out = out.join(F.broadcast(x))
    ratio = lambda a, b: F.expr(f"try_divide({a}, {b})")
    return out.withColumn("precision", ratio("tp", "tp + fp")).withColumn("recall", ratio("tp", "tp + fn"))
