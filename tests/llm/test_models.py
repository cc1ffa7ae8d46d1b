"""Language, quality and toxicity models: held-out accuracy, and the same results however rows are dealt."""

import random
import zlib

import numpy as np

from quillscan.llm import langid, quality, toxicity

RNG = random.Random(11)
WORDS = {
    "aa": ["kopa", "kilu", "kamo", "koki", "lakop", "malik"],
    "bb": ["shrem", "shtolz", "brimsh", "tersh", "stromp", "mershk"],
    "cc": ["éaué", "ouéau", "réau", "éuxé", "auéo", "éreau"],
}


def sentence(words, n):
    return " ".join(RNG.choice(words) for _ in range(n)).capitalize() + "."


def test_language_is_found_on_held_out_rows(spark):
    rows = [(k, sentence(WORDS[x], 12), x) for k, x in enumerate("aa bb cc".split() * 120)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 + 3!", "bb"), (1003, sentence(WORDS["bb"], 30000), None), (None, sentence(WORDS["aa"], 9), "aa"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    one, two = (sorted(map(tuple, langid.language_id(df.repartition(n)).collect()), key=str) for n in (1, 5))
    assert one == two and len(one) == len(rows)
    pred = {r[0]: r for r in one}
    for k, _, lang in rows[:360]:
        assert pred[k][1] == (zlib.crc32(str(k).encode()) % 5 == 0) and pred[k][2] == lang and 0.5 < pred[k][3] <= 1
    assert [pred[k][2:] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert pred[1003][2] == "bb" and pred[None][1:3] == (False, "aa")


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.language_id(df).first()[2:] == ("und", 0.0)
    assert langid.language_id(df.limit(0)).collect() == []


def test_quality_rejects_what_heuristics_see(spark):
    prose = ["the house of the river is old and was on the hill", "it was a day of rain and the wind with it", "a bird is in that tree for the night"]
    good = [". ".join(RNG.choice(prose) for _ in range(8)) + ".\n" + RNG.choice(prose) + "." for _ in range(150)]
    poor = [" ".join(w + RNG.choice(["###", "$$$", "%%%"]) for w in sentence(prose[0].split(), 30).split()) for _ in range(15)]
    poor += [" ".join(w.upper() + "!!" for w in sentence(prose[1].split(), 30).split()) for _ in range(15)] + ["word " * 50] * 10
    rows = [(k, t, "x") for k, t in enumerate(good + poor)] + [(900, None, "x"), (901, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    got = {r.doc_id: r for r in quality.quality_scores(df.repartition(3)).collect()}
    assert len(got) == len(rows) and all(0 <= r.weak_label <= 1 and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[k].kept for k in range(150)]) > 0.98
    assert np.mean([got[k].weak_label < 0.5 for k in range(150, 190)]) > 0.95 and not got[900].kept and not got[901].kept
    assert quality.quality_scores(df.limit(0)).collect() == []


def test_estimation_recovers_planted_accuracies():
    """Kinds of poor documents that one heuristic catches and two others half see, with false alarms on good ones."""
    rng = np.random.default_rng(5)
    for _ in range(3):
        n, h = 30000, 8
        kind = np.where(rng.random(n) < 0.7, 0, rng.integers(1, h + 1, n))
        false, caught = rng.uniform(0.001, 0.02, h), rng.uniform(0.7, 0.98, h)
        p = np.where(kind[:, None] == np.arange(1, h + 1), caught, false)
        for shift in (1, 2):
            p = np.where(kind[:, None] == (np.arange(h) + shift) % h + 1, 0.5, p)
        votes = np.where(rng.random((n, h)) < 0.9, np.where(rng.random((n, h)) < p, 1, 2), 0)
        patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        good, says = quality.posteriors(patterns, counts.astype(float))
        good = good[of.reshape(-1)]
        assert np.abs(says[:, 0] - false).max() < 0.02
        found = np.array([((votes[:, k] == 1) * (1 - good)).sum() / ((votes[:, k] > 0) * (1 - good)).sum() for k in range(h)])
        there = np.array([(votes[kind > 0, k] == 1).sum() / (votes[kind > 0, k] > 0).sum() for k in range(h)])
        assert np.abs(found - there).max() < 0.04 and np.mean((good >= 0.5) == (kind == 0)) > 0.9


def test_many_languages_share_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_NUMBERS", 1 << 12)
    rows = [(k, sentence(WORDS[x], 12), x) for k, x in enumerate("aa bb cc".split() * 40)] + [(1000 + k, f"q{k} zz", f"l{k}") for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.names) == 43 and model.log_p.size <= 1 << 12 and model.bits == 6


def test_letters_beyond_the_basic_plane():
    text = "\U0001F600\U00010400a".encode()
    (grams, at), *_ = langid.ngram_buckets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(grams) == 2 and at.tolist() == [0, 2]  # the emoji is no letter, the Deseret capital is


def test_chain_finds_toxic_words_in_unseen_documents(spark):
    base, bad = [f"w{i}" for i in range(300)], ["grud", "idiot", "worthless"]
    rows, labels = [], []
    for k in range(600):
        words = [RNG.choice(base) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(RNG.randrange(60), RNG.choice(bad))
        rows.append((k, " ".join(words), "x"))
        if k % 2 == 0 or k < 300:
            labels.append((k, 1 if k % 3 else 0, int(toxic)))
    rows += [(700, None, "x"), (701, "", "x"), (0, rows[0][1], "x"), (None, rows[1][1], "x")]
    labels += [(3, None, None), (None, 1, 1), (0, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs.repartition(2), table).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id is not None and 300 < r.doc_id < 600 and r.doc_id % 2]
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in unseen]) > 0.97
    insulted = {r[0] for r in rows if r[1] and "idiot" in r[1].split()}
    assert min(r.p_insult for r in unseen if r.doc_id in insulted) > max(r.p_insult for r in unseen if not r.toxic)
    assert all(r.kept != r.toxic for r in got)
    assert not any(r.toxic for r in toxicity.toxicity(docs, table.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), table).collect() == []
