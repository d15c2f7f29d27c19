"""The registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from terralith.llm import alignment, archive, jaccard, lines, media, mixing, ngram_filter, packing, perplexity, rules, simhash, toxicity, trie
from terralith.llm.common import read

QUERIES = {
    "op1_media": lambda spark, sf_dir: media.digest(read(spark, sf_dir, "documents")),
    "op2_line_dedup": lambda spark, sf_dir: lines.digest(read(spark, sf_dir, "documents")),
    "op3_mixing": lambda spark, sf_dir: mixing.digest(read(spark, sf_dir, "documents")),
    "op4_toxicity": lambda spark, sf_dir: toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op5_warc": lambda spark, sf_dir: archive.digest(read(spark, sf_dir, "pages")),
    "op6_simhash": lambda spark, sf_dir: simhash.digest(read(spark, sf_dir, "documents")),
    "op7_packing": lambda spark, sf_dir: packing.packed_documents(read(spark, sf_dir, "documents")),
    "op8_quality_rules": lambda spark, sf_dir: rules.judged(read(spark, sf_dir, "documents")),
    "op10_lm_scoring": lambda spark, sf_dir: ngram_filter.scored(read(spark, sf_dir, "documents")),
    "op11_tokenizer_alignment": lambda spark, sf_dir: alignment.digest(read(spark, sf_dir, "documents")),
    "op12_jaccard_join": lambda spark, sf_dir: jaccard.linked(read(spark, sf_dir, "documents")),
    "op13_conversation_trie": lambda spark, sf_dir: trie.trie(read(spark, sf_dir, "conversations")),
    "op9_quality_classifier": lambda spark, sf_dir: perplexity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
}

ORACLES = {
    "op2_line_dedup": lines.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op5_warc": archive.ORACLE,
    "op8_quality_rules": rules.ORACLE,
    "op12_jaccard_join": jaccard.ORACLE,
    "op13_conversation_trie": trie.ORACLE,
}
