"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its content (SHA-256). A ledger holds which (blob, rule version) pairs were
scanned and what was found. A scan reduces its input to distinct blobs, scans each only for the rules the ledger doesn't
have for it, and joins the findings back to every path (here: row) that holds the blob. Hot groups of copies are
pre-aggregated to one blob before any text moves; the join back is a plain equi-join of small rows, which AQE can split.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillscan.session import scratch_dir, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same to Java and RE2. A match counts if its ``group`` has ``least`` characters. Every match
    holds one of ``needs`` (if there are any). Whoever changes a rule raises its version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')}"
#: In the order in which spans with one start are listed.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, (":", "=")),
    # A run is matched whole or not at all, so demanding its length in the pattern finds the same spans.
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39, ("AIza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, ("eyJ",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, ("PRIVATE KEY-----",)),
)
RULES = BASE + ADDED


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hit(text: Column, rule: Rule, unseen: Column | None) -> Column:
    """The lengths (code points) of the rule's matches and of what lies between them; null if it has none."""
    pattern = F.lit(rule.pattern)
    found = text.rlike(rule.pattern)
    if rule.needs:
        found = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in rule.needs)) & found
    if unseen is not None:
        found = F.array_contains(unseen, rule.key) & found
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else lengths
    return F.when(
        found,
        F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            F.lit(rule.least).alias("least"),
            F.arrays_zip(lengths.alias("length"), F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), measured.alias("measured")).alias("parts"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, unseen: str | None = None) -> DataFrame:
    """Findings (blob_id, kind, version, start, end: code points, end exclusive) of ``blobs`` (blob_id, text).

    Rows of one blob_id count once. ``unseen``: a column with the keys of the rules to scan for; absent: all.
    """
    columns = [F.col("blob_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")] + ([F.col(unseen)] if unseen else [])
    text, left = F.col("text"), F.col(unseen) if unseen else None
    hits = blobs.select(columns).select("blob_id", F.filter(F.array(*(_hit(text, r, left) for r in rules)), lambda x: x.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    rows = hits.dropDuplicates(["blob_id"]).select("blob_id", F.explode("hits").alias("hit"))
    parts = rows.select("blob_id", "hit.kind", "hit.version", "hit.least", F.posexplode("hit.parts").alias("at", "part"))
    # what stands before the match, the gap right before it included, without the match itself
    so_far = Window.partitionBy("blob_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.col("part.length")).over(so_far)
    placed = parts.where(F.col("part.length").isNotNull()).select("blob_id", "kind", "version", "least", "part.length", "part.measured", end.alias("end"))
    return placed.where("measured >= least").select("blob_id", "kind", "version", (F.col("end") - F.col("length")).alias("start"), "end")


class Ledger:
    """A folder of batches, each of two Parquet tables: ``pairs`` (blob_id, rule) that were scanned, ``findings`` (also the
    rule's key) that this gave.

    A batch counts once its name is in ``commits``, which is written last: what a failed scan leaves is never read.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _files(self, spark: SparkSession) -> tuple[JavaObject, Callable[[str], JavaObject]]:
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def batches(self, spark: SparkSession) -> list[str]:
        fs, path = self._files(spark)
        commits = path(f"{self.folder}/commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(commits)) if fs.exists(commits) else []

    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{b}/{table}" for b in self.batches(spark)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def pairs(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "pairs", "blob_id string, rule string")

    def findings(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "findings", "blob_id string, kind string, version int, start int, end int")

    def append(self, findings: DataFrame, pairs: DataFrame) -> None:
        spark, name = findings.sparkSession, f"batch-{uuid.uuid4().hex}"
        findings.select("blob_id", "kind", "version", F.col("start").cast("int"), F.col("end").cast("int")).write.parquet(f"{self.folder}/{name}/findings")
        pairs.write.parquet(f"{self.folder}/{name}/pairs")
        fs, path = self._files(spark)
        fs.create(path(f"{self.folder}/commits/{name}"), False).close()


def addressed(versions: DataFrame, key: str = "path") -> DataFrame:
    """(path, blob_id) of each row of ``versions``, as a table: texts are hashed once for all that needs their addresses."""
    return stored(versions.select(F.col(key).alias("path"), blob_id(F.col("text")).alias("blob_id")))


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, key: str = "path", addresses: DataFrame | None = None) -> DataFrame:
    """Findings by blob for all texts of ``versions`` (path, text); see ``findings_by_path`` for the join back.

    Only (blob, rule version) pairs that the ledger lacks are scanned: each such blob once, taken from its smallest path.
    They are appended to the ledger, from which all findings of these rule versions in the present blobs are then read.
    """
    spark = versions.sparkSession
    addresses = addressed(versions, key) if addresses is None else addresses
    present = addresses.groupBy("blob_id").agg(F.min("path").alias("first"))
    keys = [r.key for r in rules]
    had = ledger.pairs(spark).where(F.col("rule").isin(keys)).join(present.select("blob_id"), "blob_id", "left_semi").groupBy(F.col("blob_id").alias("had_id")).agg(F.collect_set("rule").alias("had"))
    unseen = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("had", F.array().cast("array<string>")))
    # a table: what is appended to the ledger below can't change what is scanned
    todo = stored(present.join(had, F.col("blob_id") == F.col("had_id"), "left").select(F.col("blob_id").alias("of"), "first", unseen.alias("unseen")).where(F.size("unseen") > 0))
    if todo.limit(1).count():
        hashed = versions.select(F.col(key).alias("path"), "text", blob_id(F.col("text")).alias("blob_id"))
        # hashing by path as well spreads the rows of a hot blob
        blobs = hashed.join(todo, F.expr("blob_id = of AND path <=> first")).select("blob_id", "text", "unseen")
        ledger.append(scan_blobs(blobs, rules, "unseen"), todo.select(F.col("of").alias("blob_id"), F.explode("unseen").alias("rule")))
    current = ledger.findings(spark).where(F.concat_ws("@", "kind", "version").isin(keys)).distinct()
    return current.join(present.select("blob_id"), "blob_id", "left_semi")


def findings_by_path(versions: DataFrame, findings: DataFrame, key: str = "path") -> DataFrame:
    """Each finding at every path that holds its blob: (path, blob_id, kind, version, start, end)."""
    return versions.select(F.col(key).alias("path"), blob_id(F.col("text")).alias("blob_id")).join(findings, "blob_id").select("path", "blob_id", "kind", "version", "start", "end")


def secret_digest(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; a null text is empty): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Repeated rows and equal texts under different ids are scanned once and returned as often as they occur. ``ledger``: what
    earlier scans know; by default an empty one in the shared folder.
    """
    ledger = ledger or Ledger(f"{scratch_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}")
    addresses = addressed(docs, "doc_id")
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(RULES) for x in (r.kind, i)))
    findings = scan_versions(docs, ledger, RULES, "doc_id", addresses).select("blob_id", F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end").alias("f"))
    spans = F.array_sort(F.collect_list("f"))
    joined = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    by_blob = findings.groupBy("blob_id").agg(spans.alias("f"), *(F.count(F.when(F.col("f.kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in BASE))
    by_blob = by_blob.select("blob_id", *(f"n_{r.kind}" for r in BASE), F.sha2(joined(F.filter("f", lambda f: f["rank"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("f")).alias("spans"))
    # a table: then both sides of the join are plain exchanges, and the rows of a hot blob can be split among tasks
    rows = addresses.select(F.col("path").alias("doc_id"), "blob_id").join(stored(by_blob), "blob_id", "left")
    return rows.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``secret_digest``."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, k, length(m[k]) AS n, length(g[k]) AS gap, {f'length(q[k])' if r.group else 'length(m[k])'} >= {r.least} AS good FROM ("
            f"SELECT rid, m, g, q, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS g, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS q FROM d))"
        )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT rid, rank, kind, good, n, sum(gap + n) OVER (PARTITION BY rid, rank ORDER BY k) AS e FROM parts),
f AS (SELECT rid, rank, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE good),
a AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""
