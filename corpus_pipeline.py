"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

All but the last return the columns that they were given. A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.llm import decontaminate, langid, linededup, neardup, packing
from quillscan.session import discard, fresh, scratch_dir, stored_so_far, table

#: Below this posterior a language isn't known; documents of several languages lie far above it.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language can't be told."""
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    pred = fresh("lang_pred", docs.columns)
    score = fresh("lang_score", [*docs.columns, pred])
    found = langid.predict(docs, model, pred=pred, score=score)
    return found.where((found[pred] != langid.UND) & (found[score] >= MIN_LANGUAGE_SCORE)).select(*(found[c] for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, and documents of which they were all; n_chars follows the text."""
    n_lines = fresh("n_lines", docs.columns)
    n_dropped = fresh("n_dropped", [*docs.columns, n_lines])
    cut = linededup.dedup_lines(docs, n_lines, n_dropped)
    changed = cut[n_dropped] > 0
    left = cut.where(~changed | cut["text"].rlike(r"\S"))
    return left.select(*(F.when(changed, F.length("text")).otherwise(cut[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else cut[c] for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 8 consecutive words of a benchmark item, or windows of two items (shorter ones whole)."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_neardup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: SQL can express neither hashed models nor similarity classes; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Once a stage is written, what it made on the way and its input are deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done: tuple[str, ...] = ()
    for k, (name, stage) in enumerate(STAGES):
        path, before = f"{folder}/{k}-{name}", stored_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before, done)
        done = (path,)
    return docs
