"""The pipeline's stages, each against a brute-force version on its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_linededup, test_neardup

RNG = random.Random(8)


def words(n):
    return " ".join("".join(RNG.choice("bcdfgklmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string, node int").repartition(3)


def test_line_dedup_stage(spark):
    docs = frame(spark, test_linededup.ROWS)
    got = P.dedup_lines(spark, docs, "")
    assert got.columns == docs.columns
    want = [(i, t) for i, t, _, dropped in test_linededup.brute(test_linededup.ROWS) if not dropped or t.strip()]
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_near_duplicate_stage_keeps_one_of_each_class(spark):
    rows = test_neardup.corpus()
    docs = frame(spark, rows)
    got = P.dedup_documents(spark, docs, "")
    assert got.columns == docs.columns
    want = {c for _, c, _ in test_neardup.brute(rows)}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_decontamination_stage(spark, tmp_path):
    bench = [b for b in test_decontaminate.BENCH if b[0] != 6]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, test_decontaminate.DOCS)
    got = P.decontaminate_benchmark(spark, docs, str(tmp_path))
    long = [b for b in bench if len(test_decontaminate.words(b[1])) >= 8]
    clean = [r[0] for r in test_decontaminate.brute(test_decontaminate.DOCS, long) if not r[2]]
    assert got.columns == docs.columns and sorted((r.doc_id for r in got.collect()), key=str) == sorted(clean, key=str)


def test_run(spark, tmp_path):
    leak = words(40)
    rows = [(k, words(80)) for k in range(60)]
    rows += [(100, words(30) + " " + leak + "."), (101, "12 34 +"), (102, None), (103, rows[0][1]), (104, rows[1][1] + " tail")]
    frame(spark, rows).drop("hash", "node").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(60))
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
