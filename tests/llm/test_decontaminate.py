"""Decontamination against a brute-force scan of all windows."""

import hashlib
import re

from quillscan import session
from quillscan.llm import decontaminate as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return W.findall((t or "").translate(LOW))


def brute(docs, bench, size=8):
    windows = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc_id, t in docs:
        w, hit, items = words(t), set(), set()
        for g, of in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items |= {str(x) for x in of if x is not None}
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(items), digest, len(items) >= 2))
    return sorted(out, key=str)


LINE = "Alpha beta, gamma-delta epsilon zeta eta theta iota kappa"
BENCH = [(1, LINE), (2, LINE.lower() + " lambda mu"), (10, "Short Ünique item"), (3, "..."), (4, None), (5, "the the the the the the the the the"), (None, "no id here at all but nine words long"), (6, "one")]
DOCS = [
    (1, "x " + LINE.upper() + " y"),
    (2, None),
    (3, ""),
    (4, "short ünique item / short Ünique item"),
    (5, "the " * 40),
    (6, "no id here at all, but nine words long"),
    (7, "beta gamma delta epsilon zeta eta theta iota " * 2),
    (8, "alpha beta gamma delta epsilon zeta eta"),
    (9, "w " * 20000 + LINE),
    (7, "one"),
    (7, "one"),
    (None, "one two one"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*d, "z") for d in DOCS], "doc_id long, text string, words string").repartition(3)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = D.contamination(docs, bench).drop("h").collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, BENCH)


def test_beyond_every_broadcast_the_result_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = D.contamination(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), spark.createDataFrame(BENCH, "item_id long, text string")).drop("h").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, got), key=str) == brute(DOCS, BENCH)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.contamination(docs, none).collect()] == [0, 0, 0]
    assert D.contamination(docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x x x c"), (2, "a b c"), (3, "a c")], "doc_id long, text string")
    anchors = spark.createDataFrame([(t, True) for t in "abc"], "term string, rarest boolean")
    index = D.build_index(docs, anchors)
    near = lambda d: sorted(r.doc_id for r in D.proximity_matches(index, ["a", "b", "c"], d).collect())
    assert near(2) == [2] and near(4) == [1, 2]


def test_the_stage_drops_what_the_operator_calls_contaminated(spark):
    """Two whole items of fewer words, or one window of eight; one short item alone is no leak."""
    docs = spark.createDataFrame([(1, "short Ünique item, then one"), (2, "one"), (3, "x " + LINE), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "Short Ünique item"), (6, "one"), (1, LINE)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.without_leaks(docs, bench).collect()) == [2, 4]
