"""Mixing sources to target weights by capped water-filling.

The words of a mix are dealt to the sources by weight. A source is repeated at most ``most`` times: the
targets of sources above that are clamped there, and what they leave is dealt anew to the others by
weight, until no target is above. The level of the water (words per unit of weight) is one number; it
only rises, and the clamped sources follow from it, so a round is one aggregate over a table with one
row per source and only scalars reach the driver.

A source's target is whole repetitions of all its documents plus a part. The part is taken in an order
seeded by the id: documents in that order until the target is met. The one document at the end gives its
first words, so a source's words are its target, rounded, exactly. Sums run over ranges of
(source, order), so a source with most documents is many pieces.

Defined results: null and empty texts have size 0 and nothing of them is taken; a null source is a source
of its own, the last; null ids are ordered by their text; repeated rows are documents of their own; a
source without words has target 0; an empty table gives an empty mix. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.order import numbered_sources, running
from passbook.scratch import scratch_folder, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # repeated over the sources in their order
SHARE = 1.5  # words of the mix, as a share of all words
MOST = 2  # repetitions of a source
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: float, most: int) -> float:
    """Words per unit of weight at which clamped and proportional targets together make ``total``.

    ``sources`` has ``source_size`` and ``weight``. Every round clamps at least one more source or ends.
    A level above every cap is returned when the caps do not hold ``total``.
    """
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        held = cap <= F.lit(level) * F.col("weight")
        caps, weights = sources.agg(F.sum(F.when(held, cap).otherwise(0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))).first()
        if not weights:
            return float("inf") if caps else 0.0
        higher = (total - caps) / weights
        if higher <= level:
            return level
        level = higher


def targets(sizes: DataFrame, folder: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, number, source_size, target) of the sources of ``sizes`` (source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(numbered_sources(per_source, True, folder).withColumn("weight", by_turn), folder, "weighted")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * words, most)
    cap = (F.col("source_size") * most).cast("double")
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (whole copies taken), part (words taken of one more copy)."""
    folder = scratch_folder(docs.sparkSession, "mixture")
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), turn.alias("turn")), folder, "sized")
    sources = written(targets(sized, folder, weights, share, most), folder, "targets")
    known = sources.withColumnRenamed("source", "_source")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    rest = (F.floor(F.col("target") + 0.5) - F.col("repeats") * F.col("source_size")).cast("long")
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("repeats", whole.cast("int")).withColumn("rest", rest)
    placed = placed.select("number", "turn", "doc_id", "source", "size", "source_size", "target", "repeats", "rest")
    summed = running(placed, ["number"], ["turn", "doc_id", "size"], "size", folder, "placed")
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return summed.select("doc_id", "source", "size", "source_size", "target", "repeats", part.alias("part"))


def mixed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, copy (from 1), text: the documents of ``docs`` as often as ``plan`` (of ``mix``) takes them.

    ``doc_id`` has to be unique here. The copy that is taken in part is the text up to its last taken word.
    """
    copies = F.col("repeats") + (F.col("part") > 0).cast("int")
    taken = plan.where(copies > 0).select("doc_id", "repeats", "part", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    begin = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    text = F.when(F.col("copy") <= F.col("repeats"), F.col("text")).otherwise(begin)
    return docs.select("doc_id", "text").join(taken, "doc_id").select("doc_id", "copy", text.alias("text"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.col("repeats") * F.col("size") + F.col("part")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP12_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS turn FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT round + 1, (SELECT (CAST({SHARE} * (SELECT sum(source_size) FROM sources) AS DOUBLE)
      - sum(CASE WHEN {MOST} * source_size <= f.level * weight THEN {MOST} * source_size ELSE 0 END))
      / nullif(sum(CASE WHEN {MOST} * source_size <= f.level * weight THEN 0 ELSE weight END), 0) FROM sources)
  FROM fill f WHERE round < (SELECT count(*) FROM sources) + 1 AND level IS NOT NULL),
goal AS (
  SELECT source, source_size, least(CAST({MOST} * source_size AS DOUBLE), (SELECT max(level) FROM fill) * weight) AS target FROM sources),
placed AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {MOST}) ELSE 0 END AS repeats,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(repeats * size + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - repeats * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
