"""Members of archives and compressed files, nested to a depth, in an Arrow kernel. A member's path follows its archive's
after "!". Formats without a decoder (in Python's library, or zstandard where that is installed) are issues."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import zstandard
except ImportError:  # its files are issues then
    zstandard = None

NAMES = r"(?i)\.(?:zip|jar|war|tar|tgz|tbz2?|txz|gz|bz2|xz|lzma|zz|7z|rar|zst|br|lz4|sz|lz)$"
_UNSUPPORTED = re.compile(rf"(?i)\.(?:7z|rar|{'' if zstandard else 'zst|'}br|lz4|sz|lz)$")
_SUFFIX = re.compile(NAMES)
MAX_ENTRIES, MAX_MEMBER, MAX_TOTAL = 1_000_000, 256 << 20, 1 << 30


class Limit(Exception):
    pass


def clean(name: str) -> str:
    """A member's name without empty parts, "." and ".."."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def _bounded(stream, limit: int) -> bytes:
    data = stream.read(limit + 1)
    if len(data) > limit:
        raise Limit
    return data


def _entries(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    low = name.lower()
    if low.endswith((".zip", ".jar", ".war")):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield clean(info.filename), _bounded(f, MAX_MEMBER)
    elif re.search(r"\.(?:tar|tgz|tbz2?|txz|tar\.(?:gz|bz2|xz))$", low):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile() and (f := t.extractfile(info)):
                    yield clean(info.name), _bounded(f, MAX_MEMBER)
    else:
        inner = re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1])
        if low.endswith(".zz"):
            d = zlib.decompressobj()
            out = d.decompress(data, MAX_MEMBER + 1)
            if len(out) > MAX_MEMBER:
                raise Limit
            yield inner, out
        elif low.endswith(".zst"):
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as f:
                out = bytearray()
                while len(out) <= MAX_MEMBER and (block := f.read(1 << 20)):
                    out += block
            if len(out) > MAX_MEMBER:
                raise Limit
            yield inner, bytes(out)
        else:
            opened = {".gz": gzip.open, "bz2": bz2.open}.get(low[-3:], lzma.open)
            with opened(io.BytesIO(data)) as f:
                yield inner, _bounded(f, MAX_MEMBER)


def walk(path: str, data: bytes, depth: int, total: list[int]) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, None) of each file inside, (path, None, kind) of each issue."""
    if _UNSUPPORTED.search(path):
        yield path, None, "unsupported-archive"
        return
    try:
        for k, (name, content) in enumerate(_entries(path.rsplit("!", 1)[-1], data)):
            total[0] += len(content)
            if k >= MAX_ENTRIES or total[0] > MAX_TOTAL:
                raise Limit
            inner = f"{path}!{name}"
            if not name or not content:
                continue
            if _SUFFIX.search(name):
                if depth > 1:
                    yield from walk(inner, content, depth - 1, total)
                else:
                    yield inner, None, "archive-too-deep"
            else:
                yield inner, content, None
    except Limit:
        yield path, None, "archive-limit"
    except Exception:  # decoders raise what they like for damaged data
        yield path, None, "damaged-archive"


def members(files: DataFrame, depth: int) -> DataFrame:
    """``files`` (file_path, content: binary) -> file_path, content, kind (of an issue; else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for p, content, kind in walk(path, data.as_py(), depth, [0]):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([content], pa.binary()), pa.array([kind], pa.string())], ["file_path", "content", "kind"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, content binary, kind string")
