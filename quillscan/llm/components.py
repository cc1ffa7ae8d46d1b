"""Connected components of an edge table, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.session import checkpointed, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long): the smallest node that it is connected with.

    Each round takes the neighbours' smallest label and then the label's own label, which halves paths; the lineage is
    cut after each. Neighbours' labels are pre-aggregated, and the joins are plain equi-joins, so that a hub can be split.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("to")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = stepped.select(F.col("node").alias("of"), F.col("label").alias("next"))
        moved = checkpointed(stepped.join(of, F.col("label") == F.col("of")).select("node", F.col("next").alias("label"), (F.col("next") < F.col("old")).alias("moved")))
        labels = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return labels
