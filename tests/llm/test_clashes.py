"""Stages keep columns of documents that have the names of their own helper columns."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline

NAMES = ("_id", "_copies", "_c", "_score")


def fixture(spark, tmp_path):
    """Good and junk texts with labels, an exact copy (21 of 1) and a near copy (22 of 2)."""
    word = lambda i, k: f"w{zlib.crc32(f'{i}-{k}'.encode()) % 997}"
    good = {i: " ".join(f"the {word(i, k)} was seen by the {word(k, i)}," for k in range(60)) for i in range(1, 21)}
    junk = {i: "zz9 buy!! " * 150 + str(i) for i in range(101, 121)}
    texts = good | junk | {21: good[1], 22: good[2] + " again"}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in (*good, *junk)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in NAMES})


def test_extra_columns_stay(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES), name


def test_run_with_labels(spark, tmp_path):
    docs = fixture(spark, tmp_path)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {*range(2, 22)}
    got = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == want
    out = [(r["doc_id"], r["decodes"]) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "decodes").collect()]
    assert {i for i, _ in out} == want and all(d for _, d in out)
