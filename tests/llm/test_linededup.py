"""Line dedup against a brute-force version of the template tree."""

import random
import re
import time

import numpy as np

from quillscan.llm import linededup as L

SPACE = re.compile(r"[\x09-\x0D\x20\x85\xA0]+")


def tokens(line):
    return tuple("<*>" if re.search("[0-9]", t) else t for t in SPACE.split(line) if t)


def brute(rows):
    """Rows (id, text) -> (id, text, lines, dropped); links between all lines of a leaf."""
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=str)
    lines = sorted({tokens(x) for d in docs for x in d[2].split("\n") if len(tokens(x)) >= L.MIN_TOKENS})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if len(a) == len(b) and a[: L.DEPTH] == b[: L.DEPTH] and sum(p == q for p, q in zip(a, b)) >= L.SAME * len(a) - 1e-9:
                root[find(a)] = find(b)
    where = {}
    for d in docs:
        for k, x in enumerate(d[2].split("\n")):
            if len(tokens(x)) >= L.MIN_TOKENS:
                where.setdefault(find(tokens(x)), {}).setdefault(d, []).append(k)
    drop = {}
    for t, by in where.items():
        if len(by) >= L.MIN_DOCS:
            keeper = min(by)
            for d, places in by.items():
                drop.setdefault(d, set()).update(places[1:] if d == keeper else places)
    out = []
    for i, t in rows:
        gone = drop.get((i is not None, i or 0, t), set()) if t is not None else set()
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append((i, left, 0 if t is None else len(t.split("\n")), len(gone)))
    return sorted(out, key=str)


LONG = " ".join(f"word{chr(97 + i % 26)}" for i in range(60))
ROWS = [
    (1, f"unique start of one\n{LONG}\nuser 17 logged in from 10.0.0.1 today"),
    (2, f"{LONG}\nanother text that is here only\nuser 99 logged in from 10.9.8.7 today"),
    (3, "user 5 logged in from 1.1.1.1 today\nuser 6 logged in from 2.2.2.2 today\nuser agents were counted and stored today"),
    (4, "the job of alpha has ended well after nine long hours\n\n  \nok"),
    (5, "the job of beta has ended well after nine long hours\nok\nfive words are in here"),
    (6, "the job of beta has started well after nine long hours"),
    (7, None),
    (8, ""),
    (9, "five words are not here\nlone"),
    (10, "\n".join(f"line number {i} of a very long text" for i in range(3000))),
    (2, f"{LONG}\nanother text that is here only\nuser 99 logged in from 10.9.8.7 today"),
    (None, "only here without an id ever"),
] + [(100 + k, f"ok\nsingle {'abcdefghijkl'[k]} tail is unlike every other one") for k in range(12)]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id long, text string, hash string, leaf int").repartition(3)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(df).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_extra_columns_stay_and_names_may_not_clash(spark):
    df = spark.createDataFrame([(1, "a", "kept", 3)], "doc_id long, text string, drop string, of int")
    assert L.dedup_lines(df).columns == ["doc_id", "text", "drop", "of", "n_lines", "n_dropped"]


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def hashes(words):
    data = " ".join(words).encode()
    return L.line_tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[3]


def test_words_of_equal_short_hashes_do_not_agree(spark):
    """Two lines that are equal in 3 of 5 tokens, with 4th words whose hashes agree in 16 bits."""
    names = ["".join(chr(97 + k // 26**p % 26) for p in range(3)) for k in range(3000)]
    by = {}
    for name, h in zip(names, hashes(names)):
        by.setdefault(int(h) >> 48, []).append(name)
    v, w = next(x for x in by.values() if len(x) > 1)[:2]
    rows = [(1, f"alpha beta gamma {v} delta"), (2, f"alpha beta gamma {w} epsilon")]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == [(*r, 0) for r in rows]


def test_a_leader_that_is_unrelated_hides_no_template(spark):
    """A and B share one block alone, whose smallest line is like neither of them."""
    a, b = "go to the old house kk ll mm nn oo", "go to the old house xx ll yy nn oo"
    rows = [(1, a), (2, b)] + [(10 + k, "go to the old house " + " ".join(chr(97 + k) + c * 3 for c in "pqrst")) for k in range(26)]
    key = lambda x: L.line_keys(np.array([0, len(x.split())]), hashes(x.split()))[0][0]
    assert min(rows, key=lambda r: key(r[1]))[0] >= 10
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows) and sum(r[3] for r in got) == 1


def test_tokens_are_cut_at_every_kind_of_blank():
    text = "a b\u00a0c\u0085d\te\x0b7f\r\n\n 9\u2003x é\u00e0"
    data = text.encode()
    row, at, first, h = L.line_tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    lines = [[w for w in SPACE.split(x) if w] for x in text.split("\n")]
    assert at.tolist() == [k for k, x in enumerate(lines) if x] and np.diff(first).tolist() == [len(x) for x in lines if x]
    assert len(set(h.tolist())) == len({t for x in text.split("\n") for t in tokens(x)})


def test_planted_pairs_of_one_leaf_are_all_linked(spark):
    """400 pairs of lines that agree in 10 of 12 tokens and share one block alone, which the whole leaf shares."""
    rows, names = [], iter("".join(chr(97 + k // 26**p % 26) for p in range(4)) for k in range(40000))
    for k in range(400):
        a = ["see", "the", "log", "of", "all", "things"] + [next(names) for _ in range(6)]
        b = a[:6] + [next(names), *a[7:9], next(names), *a[10:]]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got if r.n_dropped} == set(range(1, 800, 2))


def test_large_blocks_are_cut_without_losing_a_pair(spark, monkeypatch):
    """A random leaf against all pairs, with blocks of few lines."""
    monkeypatch.setattr(L, "BLOCK", 4)
    rng = random.Random(3)
    for n in (7, 12, 20):
        lines = [["start", "of", "line"] + [rng.choice("abcd") * (1 + (p < 6)) for p in range(n - 3)] for _ in range(60)]
        for x in lines[:40]:  # copies with a few other words
            lines.append([w if rng.random() > 0.15 or p < 3 else rng.choice("efgh") * 9 for p, w in enumerate(x)])
        rows = [(k, " ".join(x)) for k, x in enumerate(lines)]
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        assert got == brute(rows)


def test_only_texts_with_wanted_lines_are_shuffled_to_be_read_again(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("bcdfghjklmnpqrst", k=9)) for _ in range(2000))) for i in range(300)]
    rows += [(300, "we met at the old bridge\nother"), (301, "nothing\nwe met at the new bridge"), (None, "we met at the wet bridge")]
    path = L.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    keyed = path.select("doc_id", L.F.xxhash64("text").alias("h"), "text")
    places = L.stored(keyed.mapInArrow(L._parse, "doc_id long, h long, at int, line long, leaf long, words array<short>"))
    wanted = L.stored(places.where("size(words) = 6").select("line").distinct())
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        bus.waitUntilEmpty()
        return store.executorList(True).apply(0).totalShuffleWrite()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = shuffled()
        got = L.exact_words(path, places, wanted)
        assert shuffled() - at < 200_000  # 5.3 MB of text are not
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    line, _, first, h = L.line_tokens(*_utf8([r[1] for r in rows[300:]]))
    want = {tuple(h[a:b].view(np.int64).tolist()) for a, b in zip(first, first[1:]) if b - a == 6}
    assert len(want) == 3 and {tuple(r.words) for r in got.collect()} == want


def _utf8(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_the_filter_of_texts_loses_none(spark, monkeypatch):
    df = spark.range(20000).select(L.F.xxhash64("id").alias("h"))
    wanted = df.where("h % 50 = 0 OR h IN (-1, 0)").union(spark.createDataFrame([(h,) for h in (-1, 0, 1, -(2**63), 2**63 - 1)], "h long"))
    texts = df.union(wanted)
    for words in (18, 2, 0):
        monkeypatch.setattr(L, "FILTER_WORDS", words)
        got = {r.h for r in L.perhaps_wanted(texts, wanted.withColumnRenamed("h", "of_h")).collect()}
        assert {r.h for r in wanted.collect()} <= got
        assert words < 18 or len(got) < 500


def test_a_text_of_many_lines_is_cut_once(spark):
    n = 40000
    text = "\n".join(["the same line of six words", *(f"w{chr(97 + k % 26)} x" for k in range(n))])
    docs = L.stored(spark.createDataFrame([(1, text), (2, "a\n" + text)], "doc_id long, text string"))
    L.line_dedup(docs.limit(1)).collect()
    began = time.monotonic()
    rows = {r.doc_id: r for r in L.line_dedup(docs).collect()}
    assert rows[1].text == text and rows[2].text == "a\n" + text.split("\n", 1)[1] and rows[2].n_dropped == 1
    assert time.monotonic() - began < 20  # 40,000 cuts of one text take longer
