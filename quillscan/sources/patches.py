"""Patches as fragments: the added lines of each hunk, with their commit. History is read from Git in batches of commits,
one task each."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FIELDS = ("file_path", "commit", "author", "email", "date", "message", "start_line", "content")
SCHEMA = "file_path string, commit string, author string, email string, date string, message string, start_line int, content string"
NO_DATE = "0001-01-01T00:00:00Z"
BATCH = 250
_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
_SIMPLE = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def iso_date(text: str) -> str:
    """Git's date in UTC; the zero date if it is none."""
    try:
        return datetime.strptime(text.strip(), "%a %b %d %H:%M:%S %Y %z").astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return NO_DATE


def unquoted(path: str) -> str:
    """A path as Git writes it: quoted with C escapes if it has odd bytes."""
    if not (len(path) > 1 and path[0] == path[-1] == '"'):
        return path
    raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8) if len(m[1]) == 3 else _SIMPLE.get(m[1].decode(), m[1][0])]), path[1:-1].encode())
    return raw.decode("utf-8", "replace")


def hunks(lines: Iterable[str]) -> Iterator[tuple]:
    """The hunks of ``git log -p`` or ``git diff``, as FIELDS. Deleted and binary files have none."""
    meta = {"commit": "", "author": "", "email": "", "date": "", "message": ""}
    title: list[str] = []
    path, gone, start, left, added = "", False, 0, 0, None

    def done() -> Iterator[tuple]:
        if added and path and not gone:
            yield path, meta["commit"], meta["author"], meta["email"], meta["date"], meta["message"], start, "".join(added)

    for line in lines:
        line = line.removesuffix("\n")
        if added is not None and line.startswith("\\"):  # no line feed at the end of the file
            if added and not old:
                added[-1] = added[-1].removesuffix("\n")
            continue
        if added is not None and (left > 0 or line.startswith("-")):
            if line.startswith("+"):
                added.append(line[1:] + "\n")
                left, old = left - 1, False
                continue
            if line.startswith("-") and not line.startswith("--- "):
                old = True
                continue
            if line.startswith(" "):
                left, old = left - 1, True
                continue
        if m := _HUNK.match(line):
            yield from done()
            start, left, added, old = int(m[1]), int(m[2] or 1), [], True
        elif line.startswith("diff --git "):
            yield from done()
            path, gone, added = "", False, None
            meta["message"] = "\n".join(title).strip()
        elif m := re.match(r"commit ([0-9a-f]{7,64})\b", line):
            yield from done()
            meta = {"commit": m[1], "author": "", "email": "", "date": NO_DATE, "message": ""}
            title, path, added = [], "", None
        elif added is None and (m := re.match(r"Author: (.*?)\s*<(.*)>$", line)):
            meta["author"], meta["email"] = m[1], m[2]
        elif added is None and line.startswith("Date:"):
            meta["date"] = iso_date(line[5:])
        elif line.startswith("    ") and not path and added is None:
            title.append(line[4:])
        elif line == "" and not path and title:
            title.append("")
        elif line.startswith("+++ "):
            name = unquoted(line[4:].split("\t")[0])
            gone = name == "/dev/null"
            path = re.sub(r"^b/", "", name)
        elif line.startswith("deleted file mode"):
            gone = True
    yield from done()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 256:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "start_line" else pa.string()) for n, c in zip(FIELDS, zip(*rows))], list(FIELDS))


def patch_fragments(patches: DataFrame, column: str = "patch") -> DataFrame:
    """Fragments of the texts of patches, one text a row (a row holds whole commits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(h for x in batch.column(0).to_pylist() if x for h in hunks(x.split("\n")))

    return patches.select(column).mapInArrow(run, SCHEMA)


def _git(repo: str, *args: str) -> list[str]:
    return ["git", "-C", repo, *args]


def git_history(spark: SparkSession, repo: str, batch: int = BATCH) -> DataFrame:
    """Fragments of all commits of a repository that driver and executors see under one path."""
    listed = subprocess.run(_git(repo, "rev-list", "--full-history", "--all"), capture_output=True, check=True, text=True).stdout.split()
    parts = [("\n".join(listed[i : i + batch]),) for i in range(0, len(listed), batch)]
    commits = spark.createDataFrame(parts, "commits string").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                args = _git(repo, "log", "-p", "-U0", "--full-history", "--diff-filter=tuxdb", "--no-walk=unsorted", "--stdin")
                out = subprocess.run(args, input=part.encode(), capture_output=True, check=True).stdout.decode("utf-8", "replace")
                yield from _batches(hunks(out.split("\n")))

    return commits.mapInArrow(run, SCHEMA)


def git_diff(spark: SparkSession, repo: str, staged: bool = False) -> DataFrame:
    """Fragments of what isn't committed."""
    out = subprocess.run(_git(repo, "diff", "-U0", "--no-ext-diff", *(["--staged"] if staged else []), "."), capture_output=True, check=True).stdout
    return patch_fragments(spark.createDataFrame([(out.decode("utf-8", "replace"),)], "patch string"))
