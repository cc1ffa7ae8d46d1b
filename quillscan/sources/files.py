"""Files as fragments: listing, exclusion, binary detection and chunks with safe ends. Reading is Spark's binaryFile, so
any file system that Spark reads will do; what is passed over is a table of issues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions.dialect import to_java
from quillscan.rules import RuleSet, joined
from quillscan.sources import archives

#: Bytes of a chunk, and how far a chunk may reach on to end at a blank line.
PART, READ_AHEAD = 100_000, 25_000
_BLANK_LINE = re.compile(rb"\n[ \t\r]*\n")
_ENDS_BLANK = re.compile(rb"\n[ \t\r]*\n[ \t\r\n]*\Z")

# The first bytes (hex) of formats that hold no text.
BINARY_HEADS = (
    "7F454C46", "4D5A", "CAFEBABE", "CFFAEDFE", "FEEDFACE", "FEEDFACF", "0061736D", "25504446", "D0CF11E0A1B11AE1", "504B0304", "504B0506", "1F8B08", "425A68",
    "FD377A585A00", "28B52FFD", "377ABCAF271C", "526172211A07", "53514C69746520666F726D6174", "213C617263683E", "774F4646", "774F4632",
)
#: Names in a .git folder that are scanned: configuration, hooks and logs, never objects or locks.
GIT_METADATA = r"(?:^|/)\.git/(?:config|description|HEAD|packed-refs|COMMIT_EDITMSG|MERGE_MSG|FETCH_HEAD|ORIG_HEAD|(?:hooks|info|logs)/.*|modules/.*/config)$"


def logical_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_binary(content: Column) -> Column:
    """By the first bytes: executables, documents, archives, databases and fonts; images and sound are scanned."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(False)
    for h in BINARY_HEADS:
        out = out | F.startswith(head, F.lit(h))
    return out


def cut(data: bytes, part: int = PART, ahead: int = READ_AHEAD) -> list[tuple[int, int]]:
    """Ranges that cover ``data``: each has ``part`` bytes and goes on to the end of the next blank line, if one ends within
    ``ahead`` bytes (else that far); a part that ends in a blank line ends there."""
    out, at = [], 0
    while at < len(data):
        end = at + part
        if end >= len(data):
            out.append((at, len(data)))
            break
        if not _ENDS_BLANK.search(data, max(at, end - ahead), end):
            # a blank line may have begun before the end
            tail = re.search(rb"\n[ \t\r]*\Z", data[at:end])
            found = _BLANK_LINE.search(data, at + tail.start() if tail else end, end + ahead)
            end = found.end() if found else min(end + ahead, len(data))
        out.append((at, end))
        at = end
    return out


def chunked(files: DataFrame, part: int = PART, ahead: int = READ_AHEAD) -> DataFrame:
    """``files`` (file_path, content: binary) as fragments (file_path, chunk, start_line, content: text); lines count from
    1. Bytes that aren't UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py() or b""
                rows, line = [], 1
                for k, (a, b) in enumerate(cut(data, part, ahead)):
                    rows.append((path, k, line, data[a:b].decode("utf-8", "replace")))
                    line += data.count(b"\n", a, b)
                for i in range(0, len(rows), 64):
                    p, c, n, t = zip(*rows[i : i + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(c, pa.int32()), pa.array(n, pa.int32()), pa.array(t, pa.string())], ["file_path", "chunk", "start_line", "content"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, chunk int, start_line int, content string")


def excluded(rules: RuleSet) -> Column:
    """Whether a global path allowlist covers ``file_path``."""
    paths = tuple(p for a in rules.allowlists if a.condition == "OR" or not (a.commits or a.regexes or a.stopwords) for p in a.paths)
    return F.col("file_path").rlike(to_java(joined(paths))) if paths else F.lit(False)


def hidden(spark: SparkSession, path: str) -> DataFrame:
    """Files whose path has a part that begins with "." or "_", which Spark's readers pass over: path, length, content.

    The driver lists names only; contents are read by the tasks.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = len(fs.makeQualified(root).toString().rstrip("/")) + 1
    names, listed = [], fs.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().toString()
        if re.search(r"(?:^|/)[._]", name[base:]):
            names.append((name, status.getLen()))
    rows = spark.createDataFrame(names, "path string, length long").repartition(max(1, len(names) // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        from pyarrow.fs import FileSystem, LocalFileSystem

        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scheme, _, rest = name.partition(":")
                store, at = (LocalFileSystem(), rest) if scheme == "file" else FileSystem.from_uri(f"{scheme}:{quote(rest)}")
                with store.open_input_stream(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([f.read()], pa.binary())], ["path", "length", "content"])

    return rows.mapInArrow(run, "path string, length long, content binary")


def directory(spark: SparkSession, path: str, rules: RuleSet = RuleSet(), max_file_size: int | None = None, archive_depth: int = 0, part: int = PART, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All files below ``path`` as (fragments, issues: kind, path). ``skip``: paths that aren't scanned (the configuration).

    Empty files and those on an allowlist are passed over; binary files too, but archives are opened down to
    ``archive_depth``. Issues say what a limit or a format kept out.
    """
    root = re.sub(r"^\w+:/*", "/", path).rstrip("/")
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content").union(hidden(spark, path))
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(root) + "/?", "")
    files = seen.select(logical_path(relative).alias("file_path"), "length", "content").where("length > 0")
    files = files.where(~excluded(rules) & ~F.col("file_path").isin(list(skip)) & (~F.contains("file_path", F.lit(".git/")) | F.col("file_path").rlike(GIT_METADATA)))
    large = F.col("length") > max_file_size if max_file_size is not None else F.lit(False)
    issues = files.where(large).select(F.lit("too-large").alias("kind"), F.col("file_path").alias("path"))
    within = files.where(~large)
    packed = F.col("file_path").rlike(archives.NAMES)
    plain = within.where(~packed if archive_depth else F.lit(True)).where(~is_binary(F.col("content"))).select("file_path", "content")
    if archive_depth:
        members = archives.members(within.where(packed).select("file_path", "content"), archive_depth)
        issues = issues.union(members.where("kind IS NOT NULL").select("kind", F.col("file_path").alias("path")))
        inner = members.where("kind IS NULL").where(~is_binary(F.col("content")) & ~excluded(rules))
        plain = plain.union(inner.select("file_path", "content"))
    fragments = chunked(plain, part)
    return fragments.withColumn("fragment_id", F.xxhash64("file_path", "chunk")), issues
