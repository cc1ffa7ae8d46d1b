"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest

from quillscan.llm import decontaminate, embeddings, langid, licenses, linededup, neardup, packing, quality, secrets, toxicity

CLASHES = "doc_id long, text string, label string, node long, h long, n long, of long, kept boolean, score double, lang string, DROP string"
LONG = "word " * 60_000
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "a text of its own"), (None, None), (4, LONG), (5, "one two three four five six"), (6, "\n\n \x00 é\U0001f600")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "l", 1, 2, 3, 4, False, 0.5, "en", None) for r in rows], CLASHES).repartition(2)


BENCH = [(7, "one two three four five six"), (8, None), (None, "own")]
LABELS = [(1, 0, 1), (4, 1, 0), (None, None, None), (3, None, 0)]
OPERATORS = {
    "secrets": lambda s, d: secrets.secret_digest(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "lines": lambda s, d: linededup.line_dedup(d),
    "language": lambda s, d: langid.language_id(d),
    "quality": lambda s, d: quality.quality_scores(d),
    "licences": lambda s, d: licenses.scan_licenses(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame(LABELS, "doc_id long, quality int, toxic int")),
    "benchmark": lambda s, d: decontaminate.contamination(d, s.createDataFrame(BENCH, "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_its_result(spark, name):
    got = OPERATORS[name](spark, docs(spark)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)
    ones = [tuple(r) for r in got if r.doc_id == 1]
    if name != "lines":
        assert ones[0] == ones[1]
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_defined_results(spark):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    near = by(neardup.near_duplicates(docs(spark)))
    assert [near[k].class_id for k in (1, 5, 2, 3, 4, 6)] == [1, 1, 2, 2, 4, 6]
    assert [by(langid.language_id(docs(spark)))[k].lang_pred for k in (2, 3, 6)] == ["und", "und", "en"]
    hit = by(decontaminate.contamination(docs(spark), spark.createDataFrame(BENCH, "item_id long, text string")))
    assert (hit[5].n_hit, hit[5].n_items, hit[2].n_words, hit[4].n_words) == (6, 1, 0, 60_000)
    assert not by(toxicity.toxicity(docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")))[1].toxic


def test_packing_keeps_every_row(spark):
    got = packing.pack(docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.start == 0) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert packing.pack(docs(spark, [])).collect() == []


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1)]
    got = embeddings.embedding_duplicates(spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, node long")).collect()
    linked = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.n_links)
    assert linked == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1)]
    assert sorted(r.vec_id for r in got if not r.n_links) == [3, 4, 5, 6, 7, 8, 9, 10] and all(r.kept for r in got if not r.n_links)
