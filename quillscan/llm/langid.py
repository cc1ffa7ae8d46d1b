"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are summed per language over all training rows (no sample), the log-probability
matrix (languages x buckets, a fixed size) is broadcast, and batches are scored in numpy straight from Arrow buffers.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillscan.llm.kernels import buffers, chunks, frugal
from quillscan.session import fresh

UND = "und"
BITS, ORDERS, ALPHA = 15, 3, 0.5
#: Numbers of the matrix (languages x buckets) on the driver and on each worker, 8 bytes each: with more languages than
#: fit at 2**BITS buckets each (256) there are fewer buckets, down to 2**LEAST_BITS.
MOST_NUMBERS, LEAST_BITS = 1 << 23, 6
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.cache
def _fold() -> np.ndarray:
    """For each code point below 65,536 its lower case if that is one character; 0 for what isn't a letter."""
    out = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed n-grams of all rows, and where each row's begin (with the end as last)."""
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != at[-1]:  # bytes that aren't UTF-8: row by row
        rows = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:])]
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        points = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    letters = _fold()[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        known, back = np.unique(points[beyond], return_inverse=True)
        letters[beyond] = np.array([ord(c.lower()) if (c := chr(x)).isalpha() else 0 for x in known], np.uint32)[back]
    end = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(letters))
    h = np.zeros(len(letters), np.uint32)
    for k in range(ORDERS):
        h = h[: max(len(letters) - k, 0)] + (letters[k:] + np.uint32(1)) * _M[k]
        # a gram lies within its row, and holds a letter at its start or its end
        good = (place[: len(h)] + k < end[: len(h)]) & ((letters[: len(h)] > 0) | (letters[k:] > 0))
        x = h ^ (h >> np.uint32(15)) ^ np.uint32(k * 0x2545F491)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        yield (x >> np.uint32(32 - bits))[good].astype(np.int64), np.concatenate(([0], np.cumsum(good)))[np.minimum(at, len(h))]


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text, lang -> lang, bucket (-1: documents), n, summed over a task's rows."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        sums = np.zeros((0, 1 << bits), np.int64)
        docs: list[int] = []
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for x in langs:
                if x not in names:
                    names[x] = len(names)
                    docs.append(0)
            if len(names) > len(sums):
                sums = np.vstack([sums, np.zeros((len(names) - len(sums), 1 << bits), np.int64)])
            code = np.array([names[x] for x in langs], np.int64)
            for c, n in zip(*np.unique(code, return_counts=True)):
                docs[c] += int(n)
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                there, local = np.unique(code[i:j], return_inverse=True)
                for grams, at in ngram_buckets(part, offsets[i : j + 1] - offsets[i], bits):
                    of = np.repeat(local, np.diff(at))
                    sums[there] += np.bincount((of << bits) + grams, minlength=len(there) << bits).reshape(len(there), -1)
        for name, k in names.items():
            there = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(there) + 1), pa.string()), pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(sums[k][there], docs[k]), pa.int64())], ["lang", "bucket", "n"]
            )

    return count


class Model:
    """Sorted language names, log-probabilities (languages x buckets) and log priors."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray, bits: int = BITS) -> None:
        self.names, self.bits = names, bits
        totals = counts.sum(axis=1, keepdims=True)
        self.log_p = np.log(counts + ALPHA) - np.log(totals + ALPHA * (1 << bits))
        self.prior = np.log(np.maximum(docs, 1)) - np.log(max(1, docs.sum()))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the likeliest language of each row (of equals the first by name) and its posterior."""
        total = np.tile(self.prior, (len(offsets) - 1, 1))
        for grams, at in ngram_buckets(data, offsets, self.bits):
            rows = np.flatnonzero(np.diff(at))
            if len(rows):
                for k in range(len(self.names)):
                    total[rows, k] += np.add.reduceat(self.log_p[k][grams], at[:-1][rows])
        best = total.argmax(axis=1)
        total -= total.max(axis=1, keepdims=True)
        return best, 1.0 / np.exp(total).sum(axis=1)


def fit(training: DataFrame) -> Model:
    """``training`` has text and lang; rows without a lang or a text are passed over."""
    rows = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages = rows.select("lang").distinct().count()
    bits = max(LEAST_BITS, min(BITS, (MOST_NUMBERS // max(1, languages)).bit_length() - 1))
    found = rows.mapInArrow(_counter(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang = found.column("lang").to_pylist()
    names = sorted(set(lang))
    code = {x: i for i, x in enumerate(names)}
    row = np.array([code[x] for x in lang], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts, docs = np.zeros((len(names), 1 << bits)), np.zeros(len(names))
    grams = bucket >= 0
    counts[row[grams], bucket[grams]] = n[grams]
    docs[row[~grams]] = n[~grams]
    return Model(names, counts, docs, bits)


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the prediction and its score after its own columns (which must not be called so: see ``fresh``).

    A null text, one without letters, and any text if the model has no language: ``und``, score 0.
    """
    if clash := {c.lower() for c in docs.columns} & {pred.lower(), score.lower()}:
        raise ValueError(f"columns of this name are there already: {sorted(clash)}")
    at, names_out = docs.columns.index(text), [*docs.columns, pred, score]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows)
            if m.names:
                for i, j in chunks(offsets):
                    best, p = m.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    names[i:j] = np.array(m.names, object)[best]
                    scores[i:j] = p
                names[~letters] = UND
                scores[~letters] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names_out)

    has = F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False))
    out = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.select("*", has.alias(fresh("letters", names_out))).mapInArrow(run, out)


def language_id(docs: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score: learnt from rows that aren't held out and have a lang.

    Repeated rows count and are returned as often as they occur; a null doc_id is neither held out nor learnt from.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs.where(part != 0))
    return predict(docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text"), model).drop("text")
