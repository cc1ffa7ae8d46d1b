"""Sources: chunks, folders, archives, patches and streams."""

import gzip
import io
import os
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillscan.plans import detect as D
from quillscan.rules import load
from quillscan.sources import files, patches
from quillscan.sources.archives import clean, walk
from quillscan.streaming import scan_stream, windowed_counts


def test_chunks_cover_and_end_at_blank_lines():
    assert files.cut(b"") == []
    assert files.cut(b"abc", 10, 5) == [(0, 3)]
    assert files.cut(b"aaaaaaaaaaaaaaaaaaaaaaa", 10, 5) == [(0, 15), (15, 23)]
    assert files.cut(b"aaaaaaaaaab\n \t\ncccccccc", 10, 8) == [(0, 15), (15, 23)]
    assert files.cut(b"aaaaaaaa\n\nbbbbbbbbbbb", 10, 5) == [(0, 10), (10, 21)]
    assert files.cut(b"aaaaaaaaa\n\nbbbbbbbbbbb", 10, 5) == [(0, 11), (11, 22)]


def test_a_folder(spark, tmp_path):
    (tmp_path / "sub/.git/hooks").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"x\n" * 30 + b"key=ABCD\n\n" + b"y\n" * 30 + b"key=EFGH\xff\n")
    (tmp_path / "sub/b.bin").write_bytes(b"\x7fELF key=NONE")
    (tmp_path / "sub/empty").write_bytes(b"")
    (tmp_path / "sub/large").write_bytes(b"z" * 5000)
    (tmp_path / "sub/.git/config").write_bytes(b"key=CONF")
    (tmp_path / "sub/.git/index").write_bytes(b"key=NONE")
    (tmp_path / ".env").write_bytes(b"key=HIDE")
    (tmp_path / "skip.me").write_bytes(b"key=NONE")
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("d/../m.txt", "key=ZIPS")
        z.writestr("n.txt.gz", gzip.compress(b"key=GZIP"))
    (tmp_path / "bad.tar").write_bytes(b"nothing like a tar archive")
    rules = load("[[allowlists]]\npaths = ['\\.me$']\n[[rules]]\nid = 'k'\nregex = 'key=([A-Z]{4})'\n")
    frags, issues = files.directory(spark, str(tmp_path), rules, max_file_size=4000, archive_depth=2, part=40)
    got = sorted((r.file, r.secret, r.start_line) for r in D.detect(frags, rules).collect())
    assert got == [(".env", "HIDE", 1), ("a.txt", "ABCD", 31), ("a.txt", "EFGH", 63), ("in.zip!d/m.txt", "ZIPS", 1), ("in.zip!n.txt.gz!n.txt", "GZIP", 1), ("sub/.git/config", "CONF", 1)]
    assert sorted((r.kind, r.path) for r in issues.collect()) == [("damaged-archive", "bad.tar"), ("too-large", "sub/large")]


def test_archives():
    assert clean("/a/./b\\..\\c") == "a/b/c"
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("x/y.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert list(walk("p.tar.gz", out.getvalue(), 1, [0])) == [("p.tar.gz!x/y.txt", b"abc", None)]
    assert list(walk("p.7z", b"x", 1, [0])) == [("p.7z", None, "unsupported-archive")]


PATCH = """commit 0123456789abcdef0123456789abcdef01234567
Author: Ann Other <ann@example.org>
Date:   Tue Nov 7 13:12:11 2023 +0200

    First line
    second line

diff --git a/x.txt b/x.txt
index 1..2 100644
--- a/x.txt
+++ b/x.txt
@@ -3 +3,2 @@ head
-old
+new one
+key=ABCD
@@ -9,0 +11 @@
+last
\\ No newline at end of file
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-key=GONE
diff --git "a/\\303\\251.txt" "b/\\303\\251.txt"
new file mode 100644
--- /dev/null
+++ "b/\\303\\251.txt"
@@ -0,0 +1 @@
+accent
"""


def test_patches(spark):
    got = list(patches.hunks(PATCH.splitlines()))
    meta = ("0123456789abcdef0123456789abcdef01234567", "Ann Other", "ann@example.org", "2023-11-07T11:12:11Z", "First line\nsecond line")
    assert got == [("x.txt", *meta, 3, "new one\nkey=ABCD\n"), ("x.txt", *meta, 11, "last"), ("é.txt", *meta, 1, "accent\n")]
    df = patches.patch_fragments(spark.createDataFrame([(PATCH,), (None,)], "patch string"))
    assert df.count() == 3
    assert patches.iso_date("yesterday") == patches.NO_DATE


def test_history(spark, tmp_path):
    env = os.environ | {"GIT_CONFIG_GLOBAL": os.devnull}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True, env=env)
    run("init", "-q")
    for k in range(3):
        (tmp_path / "f.txt").write_text("".join(f"key=AAA{c}\n" for c in "BCD"[: k + 1]))
        run("add", ".")
        run("commit", "-q", "-m", f"step {k}")
    (tmp_path / "f.txt").write_text("key=ZZZZ\n")
    rules = load("[[rules]]\nid = 'k'\nregex = 'key=([A-Z]{4})'\n")
    history = patches.git_history(spark, str(tmp_path), batch=2).withColumn("fragment_id", F.xxhash64("commit", "file_path", "start_line"))
    got = sorted((r.secret, r.start_line, r.message) for r in D.detect(history, rules).collect())
    assert got == [("AAAB", 1, "step 0"), ("AAAC", 2, "step 1"), ("AAAD", 3, "step 2")]
    assert [r.content for r in patches.git_diff(spark, str(tmp_path)).collect()] == ["key=ZZZZ\n"]


def test_a_stream(spark, tmp_path):
    rules = load("[[rules]]\nid = 'k'\nregex = 'key=([A-Z]{4})'\n")
    spark.createDataFrame([(1, "key=ABCD", "a"), (2, "none", "b"), (3, "key=EFGH", "c")], "fragment_id long, content string, file_path string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("fragment_id long, content string, file_path string").parquet(str(tmp_path / "in"))
    ignored = spark.createDataFrame([("c:k:0",)], "entry string")
    query = scan_stream(source, rules, lambda df, _: df.select("fragment_id", "secret").write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"), ignored=ignored)
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "ABCD")]


def test_windows_of_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 09:00:00', 'a'").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    query = windowed_counts(source, "ts", ["kind"], "1 hour", late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.n for r in spark.table("windows").collect()] == [2]


@pytest.mark.parametrize("data, binary", [(b"%PDF-1.4", True), (b"plain", False), (b"\x89PNG\r\n", False), (b"PK\x03\x04", True)])
def test_binary(spark, data, binary):
    df = spark.createDataFrame([(data,)], "content binary")
    assert df.select(files.is_binary(F.col("content"))).first()[0] is binary


def test_zstandard_files_are_opened():
    import io

    import zstandard

    out = io.BytesIO()
    with zstandard.ZstdCompressor().stream_writer(out, closefd=False) as f:
        f.write(b"key = value\n" * 1000)
    assert list(walk("logs/a.txt.zst", out.getvalue(), 1, [0])) == [("logs/a.txt.zst!a.txt", b"key = value\n" * 1000, None)]
    assert list(walk("a.zst", b"damaged", 1, [0])) == [("a.zst", None, "damaged-archive")]
