"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Up to so many sources, each a name and two numbers, are broadcast.
FEW = 10_000


def n_words(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source: (``source``, ``source_size``, ``target``).

    ``sizes``: (``source``, ``source_size``), one row per source. Sources in order of code point, null last, weigh as
    ``weights`` says, which repeats. They share ``share`` times all words by weight; no target goes beyond ``cap`` times
    the source's own words, and what is above is shared again among the others by weight, until none is above.
    That fixed point is a water level: sources with the least room for their weight are full first, so one sorted
    pass over the sources finds it. The pass holds one row per source, never one per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_room = Window.orderBy("room", "at")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("at", F.row_number().over(by_name) - 1).withColumn("weight", pick)
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("room", F.col("most") / F.col("weight"))
    s = s.withColumn("rank", F.row_number().over(by_room))
    s = s.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("held", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("full")) / (F.col("all_weight") - F.col("held")))
    above = F.when(F.col("room") > F.col("level"), F.col("rank"))
    s = s.withColumn("first", F.min(above).over(everything))
    s = s.withColumn("water", F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first")), F.col("most")).otherwise(F.col("water") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone: 52 bits of a SHA-256."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def n_copies(source_size: Column, target: Column, seed: int) -> Column:
    """floor(rate), and one more with the fraction as its probability."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return F.floor(rate).cast("long") + (draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")


def with_goal(rows: DataFrame, source: Column, goal: DataFrame, name: str) -> DataFrame:
    """``rows`` with the goal of their source, which is broadcast if there are at most ``FEW`` and joined by shuffle else."""
    goal = cut(goal)
    side = F.broadcast(goal) if goal.count() <= FEW else goal
    return rows.join(side, source.eqNullSafe(goal[name]), "left")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, measure: Column | None = None) -> DataFrame:
    """How often each document is taken: (``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``).

    A source's repetition rate is its target over its words. A document is taken floor(rate) times, and once more if
    the number drawn from the seed and its ``doc_id`` is below the fraction. So reruns agree, no document is taken
    more than ``cap`` times, and a source's words come near its target as the sum of independent draws.

    Words are counted once and written with ids and sources; sums per source are made before the shuffle, and the join
    brings a few numbers per source to small rows: broadcast up to ``FEW`` sources, else shuffled, split where skewed.

    Null text or one of white space: size 0. Null source: a source of its own, last in order. Null ``doc_id``: drawn
    as the word null. Repeated rows and ids: each row counts, and rows with one id are taken alike. Empty table: empty.
    A source without words has target 0 and rate 0. Further columns are not read.
    """
    size = n_words(F.col("text")) if measure is None else measure
    rows = cut(docs.select("doc_id", "source", size.alias("size")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, share, cap).withColumnRenamed("source", "goal_source")
    both = with_goal(rows, rows["source"], goal, "goal_source")
    both = both.withColumn("copies", n_copies(F.col("source_size"), F.col("target"), seed))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, copy: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with the same columns, and with the number of the copy,
    from 0, as ``copy`` if a name is given.

    The rate of its source and the draw of its id decide each row where it is; texts move only if there are more than
    ``FEW`` sources.
    """
    totals = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    goal = targets(totals, weights, share, cap).select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    both = with_goal(docs, docs["source"], goal, "__source")
    copies = n_copies(F.col("__size"), F.col("__target"), seed)
    numbers = F.filter(F.sequence(F.lit(0), copies.cast("int")), lambda i: i < copies)
    return both.withColumn("__copy", F.explode(numbers)).select(*(docs[c] for c in docs.columns), *([F.col("__copy").alias(copy)] if copy else []))


def op7_mix_sources(spark, sf_dir):
    from .common import table

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM sizes
), ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS room,
    row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, pos) AS rank FROM weighted
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ranked
), firsts AS (
  SELECT min(rank) AS first_rank FROM levels WHERE room > level
), goal AS (
  SELECT source, source_size, CASE WHEN first_rank IS NULL OR rank < first_rank THEN most
    ELSE (SELECT level FROM levels WHERE rank = first_rank) * weight END AS target FROM levels, firsts
), rated AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
), drawn AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN ('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM drawn
"""
