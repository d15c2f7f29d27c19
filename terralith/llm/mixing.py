"""Operator 3: mixing sources to target weights.

Words are summed per source, targets follow from the weights (with a ceiling
per source), the repetition rate of a source is target / size, and each
document is emitted floor(rate) times plus one Bernoulli copy that a hash of
its id decides with probability equal to the fraction.

Scale: one narrow aggregation per source, windows over one row per source (one
task: sources may number some hundred thousand, not billions), and a join on the
source that carries only what the caller keeps. Nothing is collected. A hot source is one key of a join whose other side has one row per
key, which adaptive execution broadcasts or splits.

Edge cases: null text has size 0; a null source is a source of its own, ordered
last; a source without words has target 0 and its documents are kept once (they
add no words); repeated rows draw alike, since the draw depends on the id only;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this many times the words of the input.
SHARE = 1.5
#: No source is repeated more often than this.
CEILING = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of a SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def source_rates(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Targets are ``min(ceiling * size, level * weight)``. With the sources in
    order of ceiling * size / weight, the level reached when all before one are
    full rises up to the first source that isn't filled and falls after it, so
    the common level is the maximum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    full = F.lit(float(ceiling)) * F.col("source_size").cast("double")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    levels = (
        weighed.withColumn("full", full)
        .withColumn("fill", F.col("full") / F.col("weight"))
        .withColumn("want", F.lit(float(share)) * F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("want") - F.coalesce(F.sum("full").over(before), zero)) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), zero)))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least("full", F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(1.0))
    return levels.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: str = SEED) -> DataFrame:
    """``doc`` (a struct of the row of ``docs``), size, source_size, target and copies of every document."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    sized = docs.select(whole).withColumn("size", word_count(F.col("doc.text")))
    rates = source_rates(sized.select("doc.source", "size"), weights, share, ceiling).withColumnRenamed("source", "rate_source")
    times = F.floor("rate")
    n = times.cast("int") + (draw(F.col("doc.doc_id"), seed) < F.col("rate") - times).cast("int")
    return sized.join(rates, F.col("doc.source").eqNullSafe(F.col("rate_source"))).select("doc", "size", "source_size", "target", n.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: str = SEED) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as its copies say, in the same columns."""
    taken = copies(docs, weights, share, ceiling, seed).where(F.col("copies") > 0)
    each = taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """What op3 returns: per document its size, its source's size and target, and the words taken."""
    counted = copies(docs.select("doc_id", "text", "source"))
    return counted.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)})::INT + 1] AS weight FROM per
), filled AS (
  SELECT *, {CEILING}::DOUBLE * source_size AS "full", ({CEILING}::DOUBLE * source_size) / weight AS fill FROM weighed
), levels AS (
  SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum("full") OVER before, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0::DOUBLE)) AS level
  FROM filled WINDOW before AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least("full", max(level) OVER () * weight) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1::DOUBLE END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE < rate - floor(rate)
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
