"""Embedding links against all pairs."""

import numpy as np
import pytest

from quillscan.llm import embeddings as E


def brute(rows):
    def good(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = [np.array(r[1], float) if good(r[1]) else None for r in rows]
    for i in range(n):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], links[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


def vectors():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, 1, 1, 2, None):
        centres = rng.normal(size=(6, 16))
        for c in centres:
            for s in rng.choice([0.05, 0.2, 0.5], size=12):
                rows.append((k, (c + s * rng.normal(size=16) * np.linalg.norm(c) / 4).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [1.0, None], 1), (k + 3, [float("nan")] * 16, 1), (k + 4, [float("inf")] + [1.0] * 15, 0), (k + 5, [], 0), (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0)]
    return rows + [rows[0], rows[0], (None, rows[1][1], 0), (k + 9, [0.93, float(np.sqrt(1 - 0.93**2)), 0.0], 7), (k + 10, [1.0, 0.0, 0.0], 7)]


@pytest.mark.parametrize("chunk,pivots", [(2048, 1024), (16, 6), (10, 0)])
def test_equals_brute_force(spark, chunk, pivots):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, uid string").repartition(3)
    got = sorted(map(tuple, E.embedding_duplicates(df, chunk=chunk, pivots=pivots).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert E.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_tree_covers_within_radii_and_nests():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x = np.vstack([x, x[:40] + 0.01 * rng.normal(size=(40, 8)), x[:3], x[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = E.cover_tree(x)
    for k, r in enumerate(E.LEVELS):
        assert (np.linalg.norm(x - x[of[:, k]], axis=1) <= r + 1e-6).all()
        assert (of[of[:, k], k] == of[:, k]).all()
        if k:  # one node above for each node
            assert all(len(set(of[of[:, k] == c, k - 1])) == 1 for c in set(of[:, k]))
