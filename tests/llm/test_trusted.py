"""Operator 9 learns from all trusted documents."""

from terralith.llm import perplexity


def test_no_trusted_document_is_left_out(spark):
    labels = spark.range(50_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    found = perplexity.trusted_ids(labels.unionByName(labels.limit(10)))
    assert found.count() == found.select("doc_id").distinct().count() == 25_000 and found.where("doc_id % 2 = 0").count() == 0
    assert 0.2 < found.where("held").count() / 25_000 < 0.3
