"""The pipeline stage by stage on a small table."""

from test_llm_operators import ROWS, docs, near_brute

import corpus_pipeline


def test_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = docs(spark, ROWS).drop("_k")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mix", "tokens"]
    exact = stages["exact_dedup"](spark, table, str(tmp_path))
    texts = {}
    for i, t, _ in ROWS:
        texts[t or ""] = max(i, texts.get(t or "", 0))
    assert {r["doc_id"] for r in exact.collect()} == set(texts.values())
    near = stages["near_dedup"](spark, table, str(tmp_path))
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in near_brute(ROWS).items() if i == c}
    mix = stages["mix"](spark, table, str(tmp_path))
    assert exact.columns == near.columns == mix.columns == table.columns
    assert max(r["count"] for r in mix.groupBy("doc_id").count().collect()) <= 3
    tokens = stages["tokens"](spark, mix, str(tmp_path))
    assert tokens.where("NOT decodes").count() == 0 and tokens.count() == mix.count()
    # Without labels every text has the same score, below the threshold: nothing is kept.
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
