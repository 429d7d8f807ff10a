"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the mix. Sources that would pass their cap (a maximum number of
epochs over their own words) are clamped there, and what they leave is shared again among the others in
proportion to weight until no source is above its cap. Which sources end clamped follows from one order:
those with the least cap for their weight fill first, so the water level is found by running sums over a
table with one row a source.

A source's target is then met by whole repetitions of all its documents and a seeded fraction of one more:
documents stand in the order of a seeded digest, and those whose middle word lies within the fraction are
taken once more. The order is cut into digest buckets, so running sums need a table of a row for each
source and bucket, and only the one bucket of a source in which its fraction ends is ordered by document.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a source
without words has target 0; documents of size 0 take 0 words, but are repeated like others; repeated rows
are documents of their own; an empty table gives no rows; other columns are kept, and columns already named
like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read, text_or_empty

WEIGHTS, EPOCHS, SEED = (5.0, 2.0, 1.0), 3.0, "mix-1"
#: Hexadecimal digits of a document's digest that name its bucket.
BUCKET_DIGITS = 3


def _digest(doc_id: str, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """sources (source, source_size) with weight and target; one row a source, so single windows stay small."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", F.col("source_size") * F.lit(epochs))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    levelled = weighed.withColumn("level", level).withColumn("clamped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the sources that fill up are the first ones in this order; the first that doesn't sets the level of all the rest
    final = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"]
    target = F.when(F.col("clamped") | final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return levelled.select("source", "source_size", "weight", target.cast("double").alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written rows (doc_id, source, size, digest), and a decision for each source: target, whole
    repetitions, the digest bucket where the fraction ends and the words it still lacks there."""
    size = F.regexp_count(text_or_empty(f"`{text}`"), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    rows = materialize(rows.withColumn("digest", _digest("doc_id", seed)), "mix")
    bucket = F.substring("digest", 1, BUCKET_DIGITS)
    held = materialize(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held")), "mix-buckets")
    targets = water_fill(held.groupBy("source").agg(F.sum("held").alias("source_size")), weights, epochs)
    epoch = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epoch).cast("long"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    filled = held.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = targets.withColumnRenamed("source", "mix_source")
    ends = filled.join(named, F.col("source").eqNullSafe(F.col("mix_source"))).where(F.col("before") < F.col("rest"))
    ends = ends.groupBy(F.col("mix_source").alias("end_source")).agg(F.max("bucket").alias("last_bucket"), F.max("before").alias("before"))
    decided = named.join(ends, F.col("mix_source").eqNullSafe(F.col("end_source")), "left").select(
        "mix_source", "source_size", "weight", "target", "whole", "rest",
        F.coalesce("last_bucket", F.lit("")).alias("last_bucket"), (F.col("rest") - F.coalesce("before", F.lit(0))).alias("lacking"),
    )
    # written, so that the planner knows its size: a row for each source
    return rows, materialize(decided, "mix-sources")


def repeats(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, digest and others) with source_size, target and n, their repetitions."""
    # one row a source and a few numbers: the planner broadcasts this table only while it is small
    joined = rows.join(decided, rows["source"].eqNullSafe(decided["mix_source"])).drop("mix_source")
    bucket = F.substring("digest", 1, BUCKET_DIGITS)
    whole = joined.where(bucket != F.col("last_bucket")).withColumn("extra", (bucket < F.col("last_bucket")).cast("long"))
    edge = joined.where(bucket == F.col("last_bucket"))
    ahead = Window.partitionBy("source").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("size").over(ahead), F.lit(0)) + F.col("size") / 2
    edge = edge.withColumn("extra", (middle <= F.col("lacking")).cast("long"))
    return whole.unionByName(edge).withColumn("n", F.col("whole") + F.col("extra")).drop("whole", "rest", "last_bucket", "lacking", "extra", "weight")


def mix(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of docs, each row as many times as the mix takes it."""
    _, decided = plan_mix(docs, weights, epochs, seed)
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    taken = repeats(inner.withColumn("digest", _digest("doc_id", seed)), decided).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, decided = plan_mix(read(spark, sf_dir, "documents"))
    taken = repeats(rows, decided)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))


ORACLE_SQL = {
    "op4_mix_sources": f"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
  FROM rows GROUP BY source),
filling AS (
  SELECT *, source_size * 3e0 AS cap, source_size * 3e0 / weight AS fill FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER w1, 0)) / sum(weight) OVER w2 AS level
  FROM filling
  WINDOW w1 AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w2 AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT *, CAST(CASE WHEN cap <= level * weight THEN cap
                      ELSE least(cap, weight * (SELECT arg_min(level, fill) FROM levels WHERE cap > level * weight)) END AS DOUBLE) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.digest, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND ahead + size / 2e0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""
}

QUERIES = {"op4_mix_sources": op4_mix_sources}
