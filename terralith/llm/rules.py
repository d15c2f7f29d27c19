"""Operator 8: quality rules with adaptive thresholds.

Each document gets integer rule metrics. Per (language, source), per language
and over all documents, a mergeable quantile sketch of every metric is kept:
counts per value bucket, with buckets exact below 64 and 1/32 of the value wide
above (6 leading bits). Counts per bucket add up in any order, so partial
aggregation merges them on the map side, a hot source costs no more than its
buckets, and reruns agree. Thresholds are quartile fences read from the
sketches, and a join brings them back to the documents. Texts are read once; what was
measured is written, some 60 bytes a document.

A group's quartiles are drawn to those of its language, and a language's to those of all
documents, as if ``PRIOR`` documents more were there: a group of a few documents takes its parent's
nearly whole, a large one its own, and none changes its source at a size.

Edge cases: null text has no words (base fails); null lang or source form groups
of their own; repeated rows count repeatedly and get equal verdicts; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import text_bytes, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Documents that a parent's quartiles count as in a group's.
PRIOR = 50
#: metric: (least spread between the quartiles, in its unit, whether low values fail too)
METRICS = {"symbol_permille": (50, False), "dup_line_permille": (50, False), "repeat_permille": (30, False), "word_chars_x10": (5, True)}
#: A fence lies this many spreads beyond its quartile.
FENCE = 4
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64) + np.uint64(1)
    keys = np.zeros(n, np.uint64)
    for k, factor in enumerate(_MIX):
        keys = (keys ^ (ids[k : k + n] * factor)) * _MIX[(k + 2) % WINDOW]
        keys ^= keys >> np.uint64(29)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def base_of(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([base_of(t) for t in b.column("body").to_pylist()], np.int64).reshape(-1, 5)
        columns = [b.column(k) for k in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, k]) for k in range(5))], names=[*b.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base columns of every document."""
    kept = docs.select("doc_id", "lang", "source", text_bytes().alias("body"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_measure, f"{fields}, {BASE_SCHEMA}")


def metrics(base: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    over = lambda a, n, unit: F.expr(f"{unit} * {a} div greatest({n}, 1)").cast("bigint")
    return base.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_permille": over("n_symbols", "n_words", 1000),
            "dup_line_permille": over("n_dup_lines", "n_words", 1000),
            "repeat_permille": over("n_repeat_words", "n_words", 1000),
            "word_chars_x10": over("word_chars", "n_words", 10),
        }
    )


def bucket(value: Column) -> Column:
    """The least value of its bucket: the 6 leading bits."""
    bits = F.length(F.bin(value))
    shift = F.greatest(bits - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(scored: DataFrame) -> DataFrame:
    """(lang, source, level, metric, bucket, n): level 0 all, 1 language, 2 language and source.

    Only documents that pass the base rules take part.
    """
    rows = scored.where(~F.col("base_failed")).select("lang", "source", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), bucket(F.col(m)))])).alias("metric", "bucket"))
    fine = rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    return fine.groupingSets([["lang", "source", "metric", "bucket"], ["lang", "metric", "bucket"], ["metric", "bucket"]], "lang", "source", "metric", "bucket").agg(
        F.sum("n").alias("n"), (F.lit(2) - F.grouping("lang") - F.grouping("source")).cast("int").alias("level")
    )


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, docs, q1, q3) of sketches."""
    one = ["level", "lang", "source", "metric"]
    upto = Window.partitionBy(*one).orderBy("bucket")
    q = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(Window.partitionBy(*one)))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket")))
    return q.groupBy(*one, "docs").agg(at(1).alias("q1"), at(3).alias("q3"))


def fences(groups: DataFrame, sketch: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high) of every group: its quartiles drawn to its language's, which are drawn to those of all."""
    known = quartiles(sketch)

    def level(k: int) -> DataFrame:
        names = {"lang": f"lang{k}", "source": f"source{k}", "metric": f"metric{k}", "docs": f"docs{k}", "q1": f"q1_{k}", "q3": f"q3_{k}"}
        return known.where(F.col("level") == k).drop("level").withColumnsRenamed(names)

    lang, source = F.col("lang").eqNullSafe(F.col("lang2")), F.col("source").eqNullSafe(F.col("source2"))
    each = groups.select("lang", "source", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    # Groups by metric are few; the joins' sides have a row a group and metric.
    joined = each.join(level(0), F.col("metric") == F.col("metric0"), "left").join(level(1), F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("metric") == F.col("metric1")), "left")
    joined = joined.join(level(2), lang & source & (F.col("metric") == F.col("metric2")), "left")

    def drawn(side: str) -> Column:
        parent = F.col(f"{side}_0")
        for k in (1, 2):
            n = F.coalesce(F.col(f"docs{k}"), F.lit(0))
            parent = F.call_function("div", F.coalesce(F.col(f"{side}_{k}"), F.lit(0)) * n + parent * prior, n + prior)
        return parent

    least = F.create_map(*[x for m, (spread, _) in METRICS.items() for x in (F.lit(m), F.lit(spread))])
    settled = joined.select("lang", "source", "metric", drawn("q1").alias("q1"), drawn("q3").alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("metric")])
    settled = settled.withColumns({"low": F.col("q1") - fence * spread, "high": F.col("q3") + fence * spread})
    picks = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")]
    return settled.groupBy("lang", "source").agg(*picks)


def judged(docs: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """doc_id, the base columns, base_failed and kept for every document."""
    scored = metrics(written(measured(docs), "measured"))
    limits = fences(scored.select("lang", "source").distinct(), sketches(scored), prior, fence)
    names = [f"{m}_{s}" for m in METRICS for s in ("low", "high")]
    # The thresholds of a group are settled group by group, so the documents are joined once.
    chosen = limits.select(F.col("lang").alias("l_lang"), F.col("source").alias("l_source"), F.struct(*names).alias("limit"))
    lang, source = F.col("lang").eqNullSafe(F.col("l_lang")), F.col("source").eqNullSafe(F.col("l_source"))
    inside = F.lit(True)
    for m, (_, low) in METRICS.items():
        inside &= F.col(m) <= F.col(f"limit.{m}_high")
        if low:
            inside &= F.col(m) >= F.col(f"limit.{m}_low")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return scored.join(chosen, lang & source, "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _oracle() -> str:
    buckets = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, (({m} >> greatest(length(bin({m})) - 6, 0)::BIGINT) << greatest(length(bin({m})) - 6, 0)::BIGINT) AS bucket FROM scored WHERE NOT base_failed" for m in METRICS)
    least = " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in METRICS.items())
    inside = " AND ".join(f"coalesce({m} <= max_{m}, TRUE)" + (f" AND coalesce({m} >= min_{m}, TRUE)" if low else "") for m, (_, low) in METRICS.items())
    pick = ", ".join(f"max(high) FILTER (metric = '{m}') AS max_{m}, max(low) FILTER (metric = '{m}') AS min_{m}" for m in METRICS)
    drawn = lambda q: f"(coalesce(c.{q} * c.docs, 0) + {PRIOR} * ((coalesce(b.{q} * b.docs, 0) + {PRIOR} * a.{q}) // (coalesce(b.docs, 0) + {PRIOR}))) // (coalesce(c.docs, 0) + {PRIOR})"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts)
), windows AS (
  SELECT r, i, CASE WHEN lead(word, {WINDOW - 1}) OVER o IS NOT NULL THEN [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS v FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM windows WHERE v IS NOT NULL) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS k(k) GROUP BY r
), per_word AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), base AS (
  SELECT doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN per_word USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), scored AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // greatest(n_words, 1) AS symbol_permille,
    1000 * n_dup_lines // greatest(n_words, 1) AS dup_line_permille, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_permille, 10 * word_chars // greatest(n_words, 1) AS word_chars_x10
  FROM base
), buckets AS ({buckets}
), sketch AS (
  SELECT 2 AS level, lang, source, metric, bucket, count(*) AS n FROM buckets GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM buckets GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, metric, bucket, count(*) FROM buckets GROUP BY ALL
), upto AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM sketch
), quart AS (
  SELECT level, lang, source, metric, docs, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM upto GROUP BY ALL
), drawn AS (
  SELECT g.lang, g.source, a.metric, ({drawn("q1")})::BIGINT AS q1, ({drawn("q3")})::BIGINT AS q3 FROM (SELECT DISTINCT lang, source FROM scored) g
  JOIN (SELECT * FROM quart WHERE level = 0) a ON TRUE
  LEFT JOIN (SELECT * FROM quart WHERE level = 1) b ON g.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric
  LEFT JOIN (SELECT * FROM quart WHERE level = 2) c ON g.lang IS NOT DISTINCT FROM c.lang AND g.source IS NOT DISTINCT FROM c.source AND a.metric = c.metric
), chosen AS (
  SELECT lang, source, {pick} FROM (
    SELECT *, q1 - {FENCE} * spread AS low, q3 + {FENCE} * spread AS high FROM (SELECT *, greatest(q3 - q1, CASE metric {least} END) AS spread FROM drawn)
  ) GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM scored s LEFT JOIN chosen h ON s.lang IS NOT DISTINCT FROM h.lang AND s.source IS NOT DISTINCT FROM h.source
"""


ORACLE = _oracle()
