"""Operators for large text collections: dedup, quality, mixing, packing, media, archives.

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``__spark_entry__.py``
imports it.
"""
