"""Secrets in encoded text: bounded decode passes in an Arrow kernel, each scanned by the detection plan.

A pass finds runs that look like percent, Unicode-escape, hex or Base64 text, decodes those that give printable text, and
puts the results in their place. Every pass's buffer becomes a row; a match in it counts only if it touches text that this
pass decoded, and its place is that of the encoded text in the original.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions import text as T
from quillscan.plans import detect as D
from quillscan.rules import RuleSet

#: In the order of precedence: of neighbours that touch, the weaker one gives way.
ENCODINGS = ("percent", "unicode", "hex", "base64")
_RUN = re.compile(
    rb"(?P<percent>[^\s%\"'<>=]*+%[0-9A-Fa-f]{2}(?:[^\s\"'<>]*%[0-9A-Fa-f]{2})*)"
    rb"|(?P<unicode>(?:U\+[0-9A-Fa-f]{4}(?:\s|$)?)+|(?:\\{1,2}u[0-9A-Fa-f]{4})+)"
    rb"|(?P<hex>\b[0-9A-Fa-f]{32,}\b)"
    rb"|(?P<base64>[\w/+-]{16,}={0,2})"
)
_PRINTABLE = re.compile(rb"[\x09-\x7e]+")


def _percent(x: bytes) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), x)


def _unicode(x: bytes) -> bytes:
    points = [int(h, 16) for h in re.findall(rb"(?:U\+|u)([0-9A-Fa-f]{4})", x)]
    tail = b" " if x[-1:].isspace() else b""
    return "".join("�" if 0xD800 <= p <= 0xDFFF else chr(p) for p in points).encode() + tail


def _hex(x: bytes) -> bytes | None:
    return bytes.fromhex(x.decode()) if len(x) % 2 == 0 and re.search(rb"[0-9]", x) else None


def _base64(x: bytes) -> bytes | None:
    if not re.search(rb"[0-9+/_-]", x):
        return None
    body = x.rstrip(b"=")
    if len(body) % 4 == 1 or (len(body) != len(x) and len(x) % 4):
        return None
    url = re.search(rb"[_-]", body)
    if url and re.search(rb"[+/]", body):
        return None
    return base64.b64decode(body + b"=" * (-len(body) % 4), b"-_" if url else None)


_CODECS = {"percent": _percent, "unicode": _unicode, "hex": _hex, "base64": _base64}


@dataclass
class Segment:
    """A decoded stretch: its place in the buffer, in the original, and how it was encoded (bits by ENCODINGS)."""

    start: int
    end: int
    first: int
    last: int
    bits: int
    fresh: bool = True


def decode_value(kind: str, raw: bytes) -> bytes | None:
    """What ``raw`` stands for; None if it can't be decoded or isn't printable."""
    out = _CODECS[kind](raw)
    return out if out and (kind == "unicode" or _PRINTABLE.fullmatch(out)) else None


def _original(p: int, end: bool, segments: list[Segment]) -> int:
    shift = 0
    for s in segments:
        if p < s.start or (p == s.start and not end):
            break
        if p < s.end or (end and p <= s.end):
            return s.last if end else s.first
        shift = s.last - s.end
    return p + shift


def decode_pass(data: bytes, segments: list[Segment]) -> tuple[bytes, list[Segment]]:
    """The next buffer and its segments; those that this pass made are fresh. Nothing fresh: nothing was decoded."""
    runs = [(m.start(), m.end(), m.lastgroup) for m in _RUN.finditer(data)]
    rank = ENCODINGS.index
    kept = [r for k, r in enumerate(runs) if not any(0 <= j < len(runs) and runs[j][0] <= r[1] and r[0] <= runs[j][1] and rank(runs[j][2]) < rank(r[2]) for j in (k - 1, k + 1))]
    out, at, made, moved = bytearray(), 0, [], []
    for a, b, kind in kept:
        value = decode_value(kind, data[a:b])
        if value is None or value == data[a:b]:
            continue
        out += data[at:a]
        bits = 1 << rank(kind)
        for s in segments:
            if s.start < b and a < s.end:
                bits |= s.bits
        made.append(Segment(len(out), len(out) + len(value), _original(a, False, segments), _original(b, True, segments), bits))
        moved.append((a, b, len(value)))
        out += value
        at = b
    if not made:
        return data, []
    out += data[at:]
    # what earlier passes decoded and this one left alone moves along
    for s in segments:
        if not any(a < s.end and s.start < b for a, b, _ in moved):
            d = sum(n - (b - a) for a, b, n in moved if b <= s.start)
            made.append(Segment(s.start + d, s.end + d, s.first, s.last, s.bits, False))
    return bytes(out), sorted(made, key=lambda s: s.start)


_PLACES = ("start", "end", "first", "last", "bits")
_SEGMENT = "array<struct<start:int,end:int,first:int,last:int,bits:int,fresh:boolean>>"
#: Bytes of text after which a batch of buffers is handed on.
_BATCH = 16 << 20


def with_passes(frags: DataFrame, max_depth: int) -> DataFrame:
    """``frags`` (content, without nulls, and other columns) and, after each, its decoded buffers: rows with the fragment's columns
    and depth (0: the fragment itself), decoded and segments (null there). The text is read once and nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            depths: list[int] = []
            buffers: list[str | None] = []
            found: list[list[Segment] | None] = []
            size = 0
            for k, text in enumerate(batch.column("content")):
                original = text.as_py().encode()
                of.append(k), depths.append(0), buffers.append(None), found.append(None)
                size += len(original)
                data, segments = original, []
                for depth in range(1, max_depth + 1):
                    data, segments = decode_pass(data, segments)
                    if not segments:
                        break
                    of.append(k), depths.append(depth), buffers.append(data.decode("utf-8", "replace")), found.append(segments)
                    size += len(data) + len(original)
                if size > _BATCH:
                    yield batch_of(batch, of, depths, buffers, found)
                    of, depths, buffers, found, size = [], [], [], [], 0
            if of:
                yield batch_of(batch, of, depths, buffers, found)

    def batch_of(batch: pa.RecordBatch, of: list[int], depths: list[int], buffers: list[str | None], found: list[list[Segment] | None]) -> pa.RecordBatch:
        flat = [s for segments in found if segments for s in segments]
        fields = [pa.array([getattr(s, n) for s in flat], pa.int32()) for n in _PLACES] + [pa.array([s.fresh for s in flat], pa.bool_())]
        # a list begins where the one before ends; the null ones are told by a null offset
        ends = list(itertools.accumulate(len(x or ()) for x in found))
        offsets = pa.array([None if x is None else e - len(x) for x, e in zip(found, ends)] + [len(flat)], pa.int32())
        segments = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, [*_PLACES, "fresh"]))
        rows = batch.take(pa.array(of, pa.int32()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(depths, pa.int32()), pa.array(buffers, pa.string()), segments], [*rows.schema.names, "depth", "decoded", "segments"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frags.schema)
    return frags.mapInArrow(run, f"{columns}, depth int, decoded string, segments {_SEGMENT}")


def _mapped(p: Column, end: bool) -> Column:
    """The original place of a buffer's place: a segment's edge within one, else shifted like the last segment before."""
    inside = (lambda s: (s["start"] < p) & (p <= s["end"])) if end else (lambda s: (s["start"] <= p) & (p < s["end"]))
    hit = F.get(F.filter("segments", inside), F.lit(0))
    before = F.try_element_at(F.filter("segments", lambda s: s["end"] <= p), F.lit(-1))
    return F.coalesce(hit["last" if end else "first"], p + T.let(before, lambda s: s["last"] - s["end"]), p)


def detect_decoded(df: DataFrame, rules: RuleSet, options: D.Options = D.Options(), max_depth: int = 5) -> DataFrame:
    """Findings of ``rules`` in ``df`` (see detect.FRAGMENT) and in up to ``max_depth`` decode passes.

    Those of decoded text have tags (how it was encoded, how deep) and no exact ranges. Suppression sees all passes.
    """
    frags = D.fragments(df)
    if max_depth:
        # columns that df lacks are the same in all rows: they needn't pass through Python
        have = [c for c in frags.columns if c in df.columns or c == "content"]
        passes = with_passes(frags.select(*have), max_depth)
        whole = passes.select("fragment_id", *D.completed(have), "depth", F.col("content").alias("original"), "segments", "decoded")
        whole = whole.withColumn("content", F.coalesce("decoded", "content")).drop("decoded")
    else:
        whole = frags.withColumns({"depth": F.lit(0), "original": F.col("content"), "segments": F.lit(None).cast(_SEGMENT)})
    found = D.candidates(whole, rules, options, relocated)
    found = D.finished(found, rules, options)
    tags = F.concat(F.filter(F.array(*(F.when(F.col("bits").bitwiseAND(1 << k) > 0, F.lit(f"decoded:{e}")) for k, e in enumerate(ENCODINGS))), lambda x: x.isNotNull()), F.array(F.concat(F.lit("decode-depth:"), F.col("depth").cast("string"))))
    found = found.withColumn("tags", F.when(F.col("depth") > 0, F.concat("tags", tags)).otherwise(F.col("tags")))
    for c in ("match_start", "match_end", "secret_start", "secret_end"):
        found = found.withColumn(c, F.when(F.col("depth") == 0, F.col(c)))
    return found.select(*D.REPORT, F.col("depth").alias("decode_depth"))


def relocated(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Matches that touch freshly decoded text (or are of no pass), and their locations in the original text."""
    start, end = F.col("start").cast("int"), (F.col("start") + F.octet_length("match")).cast("int")
    touched = F.filter("segments", lambda s: s["fresh"] & (s["start"] <= end) & (start <= s["end"]))
    plain = F.col("depth") == 0
    # the encodings of what a match touches; null: nothing
    bits = T.let(touched, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0), lambda acc, s: acc.bitwiseOR(s["bits"]))))
    places = {"bits": F.when(plain, F.lit(0)).otherwise(bits), "first_byte": F.when(plain, start).otherwise(_mapped(start, False)), "last_byte": F.when(plain, end).otherwise(_mapped(end, True))}
    rows = D.settled(rows, places).where(F.col("bits").isNotNull()).drop("segments")
    rows = D.settled(rows, {"at": T.location(F.col("original"), F.col("first_byte"), F.col("last_byte"), F.col("start_line"))})
    return rows, {name: F.col("at")[name] for name in ("start_line", "end_line", "start_column", "end_column", "line")}
