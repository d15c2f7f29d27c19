"""The pipeline's stages, each against a plain version of what it was given."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
from terralith.llm.common import written
from tests.llm.test_llm_small import SCHEMA, alike, edge_rows, plain_lines, raw


def test_stages(spark, tmp_path):
    rows = edge_rows()
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        seen.append([tuple(r) for r in docs.collect()])
        if name != names[-1]:
            assert docs.columns == columns
    good, thin, unique, mixed, packed = seen
    assert 107 not in {r[0] for r in good} and {r[0] for r in good} >= set(range(40))
    want = Counter((r[0], hashlib.sha256(b"\n".join(k)).hexdigest()) for r, k in plain_lines(good, 10))
    assert Counter((r[0], hashlib.sha256(raw(r)).hexdigest()) for r in thin) == want
    # Equal and similar texts leave the one with the least id; these tables have no chains of similar texts.
    groups = []
    for r in sorted(thin, key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(alike(raw(r), raw(g)) for g in groups):
            groups.append(r)
    assert sorted(str(r[0]) for r in unique) == sorted(str(g[0]) for g in groups)
    copies = Counter(r[0] for r in mixed)
    assert set(copies) <= {r[0] for r in unique} and max(copies.values()) <= 2
    assert Counter(r[0] for r in packed if r[1] == 0) == copies
    assert all(zlib.crc32(b"") <= r[4] <= 0xFFFFFFFF for r in packed)
