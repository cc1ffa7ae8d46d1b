"""Quality classifier from weak labels.

Overlapping heuristics vote good, poor or nothing on each document. Documents are grouped by their votes, over all rows;
expectation-maximisation on the groups estimates how reliably each heuristic votes on good documents and on each kind of
poor ones (a kind for each heuristic, which is what that heuristic was made to catch; the others may see it too), and each
group's posterior. A hashed linear scorer, trained on the posteriors of a bounded sample, then scores all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.kernels import U, buffers, chunks, mix, powers, word_hashes
from quillscan.llm.linear import Ftrl, Rows, feature_rows, text_features

#: Documents on whose posteriors the scorer is trained (expected number; at most twice as many).
SAMPLE = 4000
#: Pseudo-counts (poor, good) of votes before any is seen: on good documents, on a heuristic's own kind, on other kinds. They
#: are of about one document, so they decide nothing where there are documents to count.
PRIOR_GOOD, PRIOR_OWN, PRIOR_OTHER = (0.1, 10.0), (1.0, 0.1), (0.1, 1.0)
_STOP = "the of and to in is that for it was on with as by le la les de des et un une que en du der die das und ist nicht zu den ein eine el los las del por con se su no"
HEURISTICS = ("symbols", "bars", "digits", "capitals", "shouting", "stops", "ended", "repeats", "echoes", "empty")


def _hashes(words: str) -> np.ndarray:
    raw = words.encode()
    return np.sort(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


_STOPS = _hashes(_STOP)
_IS = {name: np.isin(np.arange(256), list(chars.encode())) for name, chars in {"symbols": "#$%&*@~^=_<>{}\\+", "bars": "|", "digits": "0123456789", "shouting": "!", "ends": ".!?:;\"')", "space": " \t\r"}.items()}


def vote_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The votes of each row as a number in base 3 (0: none, 1: poor, 2: good; the first heuristic is the lowest digit)."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    h, first = word_hashes(data, offsets)
    words = np.diff(first)
    at = np.minimum(np.searchsorted(_STOPS, h), len(_STOPS) - 1)
    echo = h[1:] == h[:-1] if len(h) else np.zeros(0, bool)
    echoes = np.diff(np.concatenate(([0, 0], np.cumsum(echo)))[first] if len(h) else np.zeros(n + 1)) / np.maximum(words, 1)
    stops = np.diff(np.concatenate(([0], np.cumsum(_STOPS[at] == h)))[first]) / np.maximum(words, 1)
    upper = per_row((data >= 0x41) & (data <= 0x5A))
    letters = upper + per_row((data >= 0x61) & (data <= 0x7A))
    share = {k: per_row(_IS[k][data]) / size for k in ("symbols", "bars", "digits", "shouting")}

    # lines: what ends at a line feed or with the row, by its last byte that isn't a blank
    breaks = data == 10
    solid = ~(breaks | _IS["space"][data])
    line = np.cumsum(np.concatenate(([0], breaks[:-1]))) if len(data) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    line = line + row  # a new row begins a new line
    where = np.flatnonzero(solid)
    lines, ended, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(where):
        begin = np.flatnonzero(np.concatenate(([True], line[where][1:] != line[where][:-1])))
        stop = np.append(begin[1:], len(where))
        of = row[where[begin]]
        lines = np.bincount(of, minlength=n)
        last = data[where[stop - 1]]
        ended = np.bincount(of, weights=_IS["ends"][last] | (last >= 0x80), minlength=n)
        inside = np.arange(len(where)) - np.repeat(begin, stop - begin)
        hashed = mix(np.add.reduceat((data[where].astype(U) + U(1)) * powers(int((stop - begin).max()))[inside], begin) + of.astype(U) * U(0x9E3779B97F4A7C15))
        distinct = np.bincount(of[np.unique(hashed, return_index=True)[1]], minlength=n)
    some = np.maximum(lines, 1)

    long = words >= 20
    poor_good = {
        "symbols": (share["symbols"] > 0.03, share["symbols"] < 0.005),
        "bars": (share["bars"] > 0.02, share["bars"] < 0.001),
        "digits": (long & (share["digits"] > 0.2), share["digits"] < 0.02),
        "capitals": ((upper > 0.5 * letters) & (letters > 20), upper < 0.2 * letters),
        "shouting": (share["shouting"] > 0.02, share["shouting"] < 0.002),
        "stops": (long & (stops < 0.01), long & (stops > 0.05)),
        "ended": ((lines > 1) & (ended < 0.2 * some), (lines > 0) & (ended > 0.6 * some)),
        "repeats": ((lines > 3) & (distinct < 0.5 * some), (lines > 3) & (distinct > 0.9 * some)),
        "echoes": ((words >= 8) & (echoes > 0.3), echoes < 0.05),
        "empty": (words == 0, words > 0),
    }
    code = np.zeros(n, np.int64)
    for k, name in enumerate(HEURISTICS):
        poor, good = poor_good[name]
        code += np.where(poor, 1, np.where(good, 2, 0)) * 3**k
    return code


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Of vote patterns (patterns x heuristics; 0 none, 1 poor, 2 good) with their counts: the probability of good, and
    the estimated P(vote is poor | voted, class) by heuristic and class (good, then the kinds of poor).

    Whoever doesn't vote says nothing, but that a document isn't of the kind that this heuristic was made for. A group begins
    among the kinds whose heuristics vote poor, else as good. With two classes only, heuristics that fire on different
    documents would contradict each other, and but one of them be believed.
    """
    n, h = patterns.shape
    voted, good, poor = (patterns > 0).astype(float), (patterns == 2).astype(float), (patterns == 1).astype(float)
    accusers = poor.sum(axis=1)
    share = np.zeros((n, h + 1))
    share[:, 0] = np.where(accusers > 0, 0.02, 0.98)
    share[:, 1:] = np.where(accusers[:, None] > 0, 0.98 * poor / np.maximum(accusers, 1)[:, None], 0.02 / h)
    yes, no = np.full((h, h + 1), PRIOR_OTHER[0]), np.full((h, h + 1), PRIOR_OTHER[1])
    yes[:, 0], no[:, 0] = PRIOR_GOOD
    np.fill_diagonal(yes[:, 1:], PRIOR_OWN[0])
    np.fill_diagonal(no[:, 1:], PRIOR_OWN[1])
    says, own = np.zeros((h, h + 1)), (np.arange(h), np.arange(1, h + 1))
    for _ in range(rounds):
        weight = share * counts[:, None]
        votes = voted.T @ weight
        votes[own] = weight[:, 1:].sum(axis=0)
        says = np.clip((poor.T @ weight + yes) / (votes + yes + no), 1e-12, 1 - 1e-12)  # logarithms below
        prior = (weight.sum(axis=0) + 0.5) / (weight.sum() + 0.5 * (h + 1))
        logs = poor @ np.log(says) + good @ np.log1p(-says) + np.log(prior)
        logs[:, 1:] += (1 - voted) * np.log1p(-says[own])
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - share).max(initial=0.0)
        share = new
        if moved < 1e-7:
            break
    return share[:, 0], says


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        codes = [vote_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int64)), *batch.columns], ["votes", *batch.schema.names])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(3 ** len(HEURISTICS), np.int64)
    for batch in _vote(batches):
        sums += np.bincount(batch.column(0).to_numpy(), minlength=len(sums))
    there = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["votes", "n"])


def quality_scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, weak_label (the posterior of its votes, 0 to 1), score (of the linear
    scorer, 0 to 1) and kept (their mean is at least one half).

    A null text counts as empty, which is poor. Repeated rows count and are returned as often as they occur; long texts are
    read whole, in time and memory linear in them.
    """
    spark = docs.sparkSession
    groups = docs.select("text").mapInArrow(_count, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 3 ** heuristics
    posterior = np.full(3 ** len(HEURISTICS), 0.5)
    codes = np.array(sorted(r.votes for r in groups), np.int64)
    size = {r.votes: r.n for r in groups}
    counts = np.array([size[c] for c in codes], float)
    if len(codes):
        posterior[codes], _ = posteriors(np.stack([codes // 3**k % 3 for k in range(len(HEURISTICS))], axis=1), counts)

    rate = min(1.0, sample / max(1.0, counts.sum()))
    drawn = docs.select("text").where(F.pmod(F.xxhash64(docs["doc_id"], F.length("text")), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).limit(2 * sample)
    trained = drawn.mapInArrow(lambda b: feature_rows(((pa.RecordBatch.from_arrays([x.column(1), x.column(0)], ["text", "votes"])) for x in _vote(b)), True), "buckets array<int>, counts array<int>, votes long").toArrow()
    rows, votes = [np.array(x, np.int64) for x in trained.column("buckets").to_pylist()], trained.column("votes").to_numpy()
    order = sorted(range(len(rows)), key=lambda k: (int(rows[k].sum()) * 2654435761 % 2**32, len(rows[k]), int(votes[k])))  # not the order of arrival
    model = Ftrl(alpha=0.1, l1=0.5).fit(Rows([rows[k] for k in order]), posterior[votes[order]] if order else np.zeros(0))
    shared = spark.sparkContext.broadcast((model, posterior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weak = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            s, w = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j in chunks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                rows, buckets, _ = text_features(part, at, True)
                s[i:j] = model.score(rows, buckets, j - i)
                w[i:j] = weak[vote_codes(part, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(s), pa.array((w + s) / 2 >= 0.5)], ["doc_id", "weak_label", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, weak_label double, score double, kept boolean")
