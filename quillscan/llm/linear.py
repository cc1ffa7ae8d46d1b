"""Hashed sparse features of whole texts, and a sparse logistic model trained on the driver from a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillscan.llm.kernels import LOWER, U, buffers, chunks, list_array, mix, powers, word_hashes, word_spans

BITS = 17


def text_features(data: np.ndarray, offsets: np.ndarray, gaps: bool = False, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and counts of hashed words; with ``gaps`` also of what stands between words. Rows ascend."""
    n = len(offsets) - 1
    h, first = word_hashes(data, offsets)
    rows = np.repeat(np.arange(n), np.diff(first))
    if gaps and len(data):
        starts, ends, _ = word_spans(data, offsets)
        edge = np.unique(np.concatenate((starts, ends, offsets)))
        a, b = edge[:-1], edge[1:]
        outside = ~np.isin(a, starts)
        a, b = a[outside], b[outside]
        if len(a):
            size = np.minimum(b - a, 8)  # a longer run counts by its first bytes and its length
            at = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(at, size)
            g = np.add.reduceat((LOWER[data[np.repeat(a, size) + inside]].astype(U) + U(1)) * powers(8)[inside], at)
            h = np.concatenate((h, mix(g + np.minimum(b - a, 16).astype(U) * U(0xE7037ED1A0B428DB) + U(17))))
            rows = np.concatenate((rows, np.searchsorted(offsets, a, "right") - 1))
    key, counts = np.unique((rows.astype(np.int64) << bits) | (h >> U(64 - bits)).astype(np.int64), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), counts


def feature_rows(batches: Iterator[pa.RecordBatch], gaps: bool) -> Iterator[pa.RecordBatch]:
    """Batches whose first column is a text: that column becomes two lists, buckets and counts."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for i, j in chunks(offsets):
            rows, buckets, counts = text_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gaps)
            sizes = np.bincount(rows, minlength=j - i)
            yield pa.RecordBatch.from_arrays(
                [list_array(buckets.astype(np.int32), sizes, pa.int32()), list_array(counts.astype(np.int32), sizes, pa.int32()), *(c.slice(i, j - i) for c in batch.columns[1:])],
                ["buckets", "counts", *batch.schema.names[1:]],
            )


class Rows:
    """Sparse rows: the buckets of each, one after the other."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some rows: which of them (0, 1, ...) and which bucket each feature is of."""
        size = self.size[which]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(np.arange(len(which)), size), self.flat[at]


class Ftrl:
    """Logistic regression by FTRL-proximal: a rate for each coordinate, and an L1 term that leaves most weights at zero.

    A feature that is present has the value of its log-odds between the targets (how much more often it occurs with one than
    with the other, over the training rows), so that few telling words count for more than many common ones. Extra dense
    features come after the hashed ones. Rows are fitted a batch at once.
    """

    BATCH = 16

    def __init__(self, extra: int = 0, alpha: float = 0.3, l1: float = 1.0, l2: float = 0.1, bits: int = BITS) -> None:
        self.dims = (1 << bits) + extra + 1  # the last is the bias
        self.extra = extra
        self.alpha, self.l1, self.l2 = alpha, l1, l2
        self.weights = np.zeros(self.dims)

    def fit(self, rows: Rows, targets: np.ndarray, extra: np.ndarray | None = None, epochs: int = 6, seed: int = 1, which: np.ndarray | None = None) -> Ftrl:
        """``which``: the rows to fit on, by default all; ``targets`` and ``extra`` are of all rows."""
        z, n = np.zeros(self.dims), np.zeros(self.dims)
        rng = np.random.default_rng(seed)
        which = np.arange(rows.n) if which is None else which
        tail = np.arange(self.dims - 1 - self.extra, self.dims)
        value = self._log_odds(rows, targets, which)
        for _ in range(epochs):
            order = which[rng.permutation(len(which))]
            for part in (order[k : k + self.BATCH] for k in range(0, len(order), self.BATCH)):
                of, at = rows.take(part)
                dense = np.ones((len(part), self.extra + 1))
                if self.extra:
                    dense[:, :-1] = extra[part]
                used, back = np.unique(at, return_inverse=True)
                w, v = self._weights(z[used], n[used]), self._tail(z, n, tail)
                s = np.bincount(of, weights=(w * value[used])[back], minlength=len(part)) + dense @ v
                error = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35))) - targets[part]
                for place, g, now in ((used, np.bincount(back, weights=error[of], minlength=len(used)) * value[used], w), (tail, error @ dense, v)):
                    z[place] += g - (np.sqrt(n[place] + g * g) - np.sqrt(n[place])) / self.alpha * now
                    n[place] += g * g
        self.weights = self._weights(z, n)
        self.weights[: len(value)] *= value
        self.weights[tail] = self._tail(z, n, tail)
        return self

    def _log_odds(self, rows: Rows, targets: np.ndarray, which: np.ndarray) -> np.ndarray:
        of, at = rows.take(which)
        buckets, y = self.dims - 1 - self.extra, targets[which]
        yes, no = (np.bincount(at, weights=t[of], minlength=buckets) for t in (y, 1 - y))
        return np.log((yes + 1) / (y.sum() + 2)) - np.log((no + 1) / ((1 - y).sum() + 2))

    def _tail(self, z: np.ndarray, n: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Weights of the dense features and the bias, on which there is no L1 penalty."""
        w = -z[tail] / ((1.0 + np.sqrt(n[tail])) / self.alpha + self.l2)
        w[-1] = -z[tail[-1]] / ((1.0 + np.sqrt(n[tail[-1]])) / self.alpha)
        return w

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((1.0 + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def score(self, rows: np.ndarray, buckets: np.ndarray, n: int, extra: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of ``n`` rows, from row numbers and buckets of their features."""
        s = np.bincount(rows, weights=self.weights[buckets], minlength=n) + self.weights[-1]
        if extra is not None and extra.shape[1]:
            s = s + extra @ self.weights[-1 - extra.shape[1] : -1]
        return 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))
