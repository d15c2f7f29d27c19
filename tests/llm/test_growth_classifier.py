"""Operator 9 moves its text once and asks parts of the model, however many there are."""

from terralith.llm import perplexity

TEXTS = [f"word{i % 7} of the {'quick' if i % 2 else 'slow'} fox {i}" * (i % 5 + 1) for i in range(60)] + ["", None, "é\u4e2d\U0001f600"]


def test_parts_and_batches_change_no_score(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    model = perplexity.fitted(docs, perplexity.trusted_ids(labels))
    found = [perplexity.scored(docs, model, batch_bytes=b, part_bytes=p) for b, p in ((1 << 20, 1 << 20), (400, 50))]
    whole, cut = ({r.rest.doc_id: (r.n_symbols, round(r.logprob, 9)) for r in f.collect()} for f in found)
    assert len(whole) == len(TEXTS) and whole == cut
    # n-grams aren't joined, once for each order; only ids are, for the counts, which are used twice.
    plan = found[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
