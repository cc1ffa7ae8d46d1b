"""Toxicity by a classifier chain of sparse hashed linear models.

Categories are predicted one after the other. Each model after the first also takes the probabilities of the categories
before it; while training, these are out-of-fold predictions, so that a model sees probabilities as honest as those it
will get. The table of labels tells only whether a document is toxic; which category of toxicity a toxic document is of is
told by lexicons, on the labelled documents alone. Training takes a bounded sample of labelled rows; scoring takes whole
texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.kernels import buffers, chunks
from quillscan.llm.linear import Ftrl, Rows, feature_rows, text_features
from quillscan.session import fresh

#: Labelled documents to train on (expected number; at most twice as many), and folds.
SAMPLE, FOLDS = 6000, 3
_EPOCHS = 5


class Chain:
    """Models by category, and the threshold of each: where out-of-fold predictions have the best F1."""

    def __init__(self, categories: Sequence[str]) -> None:
        self.categories = list(categories)
        self.models: list[Ftrl] = []
        self.thresholds: list[float] = []

    def fit(self, features: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> Chain:
        """``labels``: rows x categories, 1, 0 or nan (not labelled: not learnt from)."""
        rows, n = Rows(features), len(features)
        fold = np.arange(n) % folds
        earlier = np.zeros((n, 0))
        at, flat = rows.take(np.arange(n))
        for k in range(len(self.categories)):
            y, known = labels[:, k], ~np.isnan(labels[:, k])
            out = np.zeros(n)
            for f in range(folds):
                model = Ftrl(k).fit(rows, y, earlier, _EPOCHS, which=np.flatnonzero(known & (fold != f)))
                mine = fold == f
                out[mine] = model.score(at, flat, n, earlier)[mine]
            train = np.flatnonzero(known)
            self.models.append(Ftrl(k).fit(rows, y, earlier, _EPOCHS, which=train))
            self.thresholds.append(_best_threshold(out[train], y[train]))
            earlier = np.column_stack([earlier, out])
        return self

    def predict(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros((n, 0))
        for model in self.models:
            p = np.column_stack([p, model.score(rows, buckets, n, p)])
        return p


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    if not y.any():  # nothing to learn what is toxic from: nothing is
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 0.05, 0.95))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain:
    """``categories``: name -> SQL for 1, 0 or null over the columns of ``labels`` (doc_id, ...) and the text, in the chain's
    order. The text's words are in ``words``, lower-cased.

    Several labels of a document count as their maximum; documents that repeat an id each count.
    """
    given = [c for c in labels.columns if c != "doc_id"]
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(*(F.max(c).alias(c) for c in given))
    rate = min(1.0, sample / max(1, of.count()))
    drawn = of.where(F.pmod(F.xxhash64("of"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).limit(2 * sample)
    # at most 2 * sample rows of a few numbers: the bound makes it safe to broadcast
    texts = docs.select("doc_id", "text", F.split(F.lower("text"), r"[^\p{L}]+").alias("words"))
    for c in given:  # a label may be called as a column of the documents is
        drawn = drawn.withColumnRenamed(c, fresh(c, ["doc_id", "text", "words", "of"]))
    joined = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("of"))
    names = [f"y{k}" for k in range(len(categories))]
    chosen = joined.select("text", "doc_id", *(F.expr(sql).cast("double").alias(c) for c, sql in zip(names, categories.values())))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"buckets array<int>, counts array<int>, doc_id {kind}, " + ", ".join(f"{c} double" for c in names)
    t = chosen.mapInArrow(lambda b: feature_rows(b, False), schema).toArrow()
    rows = [np.array(x, np.int64) for x in t.column("buckets").to_pylist()]
    y = np.column_stack([np.array(t.column(c).to_pylist(), float) for c in names]) if len(rows) else np.zeros((0, len(names)))
    ids = t.column("doc_id").to_pylist()
    order = sorted(range(len(rows)), key=lambda k: (ids[k] * 2654435761 % 2**32 if isinstance(ids[k], int) else str(ids[k]), len(rows[k]), rows[k].tolist()[:20]))
    return Chain(list(categories)).fit([rows[k] for k in order], y[order])


def predict_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, p_<category> for each, flagged (the last category, by its threshold).

    A null text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            p = np.zeros((batch.num_rows, len(names)))
            for i, j in chunks(offsets):
                at, buckets, _ = text_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p[i:j] = c.predict(at, buckets, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= c.thresholds[-1])], ["doc_id", *names, "flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} double' for c in names)}, flagged boolean")


#: Words by which a document that is labelled toxic is told to be of a category (fixed values; English, as an example of what
#: a user brings). A document is toxic by its label alone.
LEXICON = {
    "insult": "idiot moron stupid fool dumb imbecile loser clown scum jerk",
    "contempt": "worthless pathetic disgusting trash garbage useless vile filth",
    "threat": "kill hurt die destroy shoot burn punch attack",
}
CATEGORIES = {name: f"CASE WHEN toxic = 0 THEN 0 WHEN toxic = 1 THEN int(coalesce(arrays_overlap(words, split('{words}', ' ')), false)) END" for name, words in LEXICON.items()} | {"toxic": "toxic"}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row doc_id, p_insult, p_contempt, p_threat, p_toxic, toxic, kept (not toxic). Without labels nothing is toxic.

    A null text is an empty one. Repeated rows count in training as often as they are labelled, and are returned as often as
    they occur; long texts are read whole, in time and memory linear in them.
    """
    found = predict_toxicity(docs, fit_chain(docs, labels, CATEGORIES))
    return found.select("doc_id", *(f"p_{c}" for c in CATEGORIES), F.col("flagged").alias("toxic"), (~F.col("flagged")).alias("kept"))
