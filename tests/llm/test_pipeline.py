"""The pipeline stage by stage on the smallest table."""

import corpus_pipeline
from stellwerk.llm.columnar import stored
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_text_operators import brute_passages


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = stored(stage(spark, docs, sf_dir), name)
        kept.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            groups = components(before, 5)
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, (_, home) in groups.items() if home == i}
        if name == "substring_dedup":
            removed = brute_passages(before)
            after = dict(docs.select("doc_id", "text").collect())
            assert {i for i, t in before if after[i] != t} == {i for i, n in removed.items() if n}
    assert kept[0] >= kept[1] >= kept[2] == kept[3] > 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(after)


def test_empty_table_and_further_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(3).selectExpr("*", "1 AS `a b`", "'x' AS quality", "'y' AS row")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
