"""The detection plan over streams, and windowed counts with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillscan.operators import session as S
from quillscan.plans import detect as D
from quillscan.rules import RuleSet


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by window of event time and ``keys``: start, keys, n. ``late``: the watermark's delay, for streams."""
    if late:
        events = events.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def scan_stream(fragments: DataFrame, rules: RuleSet, sink: Callable[[DataFrame, int], None], checkpoint: str, options: D.Options = D.Options(), ignored: DataFrame | None = None, baseline: DataFrame | None = None) -> StreamingQuery:
    """Scans each micro-batch of the streaming ``fragments`` and passes its findings, without ignored and known ones, to
    ``sink(findings, batch_id)``. Batches are independent: a batch that is repeated after a failure gives the same rows.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        found = D.detect(df, rules, options)
        if ignored is not None:
            found = S.without_ignored(found, ignored)
        if baseline is not None:
            found = S.new_findings(found, baseline)
        sink(found, batch_id)

    return fragments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
