"""Near-duplicates against all pairs by brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillscan.llm import neardup as N
from quillscan.llm.kernels import shingle_cells


def shingles(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        c = min(ids) if ids else None
        out += [(rows[i][0], c, c is None or rows[i][0] == c) for i in members]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    passage = [word() for _ in range(100)]
    for _ in range(25):  # moderately similar to each other by a shared passage: no links
        rows.append(passage + [word() for _ in range(60)])
    for size in (12, 60, 400):
        base = [word() for _ in range(size)]
        for _ in range(12):  # chains of near copies
            copy = list(base)
            for _ in range(max(1, size // 60)):
                copy[rng.randrange(size)] = word()
            rows.append(copy)
            if rng.random() < 0.5:
                base = copy
    texts = [" ".join(r) for r in rows]
    texts += [None, "", "", "one two", "One, two!", "three", "!!!", "!!!", " ".join(word() for _ in range(20000))]
    texts += [texts[-1] + " tail", texts[30], texts[30]]
    out = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]
    rng.shuffle(out)
    return out


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, label int").repartition(4)
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    """Buckets of more members than a block: the main component in parts, the rest against all of them."""
    monkeypatch.setattr(N, "BLOCK", 2)
    rng, base = random.Random(4), [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :])) for k, at in enumerate(rng.choices(range(60), k=24))]  # one word of a text in its place
    rows += [(100 + k, " ".join(base[: 30 + k] + [f"y{k}z{j}" for j in range(30 - k)])) for k in range(0, 30, 3)]
    got = sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute(rows))


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(N, "_node", lambda docs: (F.octet_length("text") * 0).cast("long"))
    got = {r.doc_id: r.kept for r in N.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "a b")], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: True, 3: False}
    kept = N.keep_one(spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "a b")], "doc_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == ["a b", "c d e"]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_weighted_similarity():
    texts = [" ".join(f"w{i % 40}" for i in range(90)) + " " + " ".join(f"x{i}" for i in range(k)) for k in (5, 25)]
    raw = [t.encode() for t in texts]
    cells, rows = shingle_cells(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    sig = N.dart_signatures(cells, rows, 2, k=4000)
    want = similarity(*map(shingles, texts))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03 and (sig != 0).all()


def test_a_pair_just_below_hides_no_link():
    """A-B lies between 0.79 and 0.8, A-C and B-C above: all three are one class, in whatever order they are compared."""
    import itertools

    import pyarrow as pa

    common = list(range(1000, 1890))
    a = common + list(range(5000, 5110))
    b = common + list(range(6000, 6115))
    c = common + a[890:945] + b[890:945]
    sets = [np.sort(np.array(x, "<i8")) for x in (a, b, c)]
    s = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert 0.79 < s(sets[0], sets[1]) < 0.8 < min(s(sets[0], sets[2]), s(sets[1], sets[2]))
    kinds = [("block", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("label", pa.int64()), ("signature", pa.binary()), ("cells", pa.binary())]
    for order in itertools.permutations(range(3)):
        rows = [[1] * 3, [2] * 3, list(order), list(order), [bytes(2 * N.K)] * 3, [sets[k].tobytes() for k in order]]
        batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(rows, kinds)], [k for k, _ in kinds])
        links = {(x, y) for out in N._compare(iter([batch])) for x, y in zip(*out.to_pydict().values())}
        assert links == {(0, 2), (1, 2)}


def test_a_link_within_a_bucket_needs_no_more_equal_coordinates():
    """The signatures of a pair at 0.8 or more may differ in more than 35 % of their coordinates."""
    import pyarrow as pa

    sets = [np.arange(0, 100, dtype="<i8"), np.arange(8, 108, dtype="<i8")]
    columns = {"block": [1, 1], "side": [2, 2], "node": [7, 9], "label": [7, 9], "signature": [b"\0\0" * N.K, b"\1\1" * N.K], "cells": [x.tobytes() for x in sets]}
    assert [x.to_pydict() for x in N._compare(iter([pa.RecordBatch.from_pydict(columns)]))] == [{"a": [7], "b": [9]}]
