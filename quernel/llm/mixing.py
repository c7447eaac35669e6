"""Mixing sources to target weights, to the word.

Each document gets a hash-random key. Documents are range-sorted by source and
key, so that a source of any size spreads over many tasks; running sums of
words within a sorted part, plus those of the parts before it, place each
document on its source's line. The mix is the line up to the source's budget,
run through again where the budget is longer than the line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, durable, table

WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2


def prefix_sums(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds `before`: the sum of `value` over earlier rows of the same `group` (nulls are one group, last).

    Sorted parts hold a bounded share of the rows whatever the groups are; only
    one sum for each part and group goes on to the second step.
    """
    keys = [F.col(group).asc_nulls_last(), *[F.col(c) for c in order]]
    sorted_rows = durable(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "sorted")
    sums = sorted_rows.groupBy(group, "part").agg(F.sum(value).alias("part_sum"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = durable(sums.select(F.col(group).alias("b_group"), F.col("part").alias("b_part"), F.coalesce(F.sum("part_sum").over(earlier), F.lit(0)).alias("base")), "bases")
    within = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_rows.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = placed.join(base, (F.col("part") == F.col("b_part")) & F.col(group).eqNullSafe(F.col("b_group")))
    return joined.withColumn("before", F.col("base") + F.col("inner")).drop("b_group", "b_part", "base", "inner", "part")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of a table of source and source_size.

    Sources by code point, null last, take the weights in turn. A target stops
    at `epochs` times its source; what is over is shared out again by weight
    among the rest until none is above. Each round is one aggregate.
    """
    ranked = prefix_sums(sources.withColumns({"all": F.lit(0), "one": F.lit(1), "is_null": F.col("source").isNull()}), "all", ["is_null", "source"], "one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    ranked = durable(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, cap = None, epochs * F.col("source_size")
    while True:
        free = F.lit(True) if level is None else cap > level * F.col("weight")
        got = ranked.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, cap)).alias("full")).first()
        if not got["w"]:
            break
        new = (share * total - (got["full"] or 0)) / got["w"]
        if level is not None and new <= level:
            break
        level = new
    # at the level reached every target is the lesser of its share and its cap
    return ranked.select("source", "source_size", F.round(F.least(cap.cast("double"), F.lit(float(level or 0.0)) * F.col("weight")), 6).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: none) and the hash-random key."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))).alias("key"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    `taken` counts words, repeats included: a document on the line up to the
    budget is taken whole, the one across its end in part, so that a source
    gives its target to the word. A null source is a source, a null text has
    no words and gives none. Documents with equal keys (repeated or null ids)
    follow one another by size; equal rows are interchangeable. Reruns agree.
    """
    sized = durable(sizes(docs), "sizes")
    goal = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "targets")
    goal = goal.withColumnRenamed("source", "g_source")
    line = prefix_sums(sized, "source", ["key", "doc_id", "size"], "size").join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    budget, start, size = F.round("target").cast("long"), F.col("before"), F.col("size")
    epoch = lambda k: F.greatest(F.lit(0), F.least(size, budget - k * F.col("source_size") - start))
    taken = epoch(0)
    for k in range(1, epochs):
        taken = taken + epoch(k)
    return line.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All `documents`, sources weighing 5, 2, 1 in turn, 150 % of all words, two epochs at most."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM sized GROUP BY source),
tot AS (SELECT 1.5 * sum(source_size)::DOUBLE AS b FROM src),
lev(i, level) AS (
  SELECT 0, (SELECT b FROM tot) / (SELECT sum(w) FROM src)
  UNION ALL
  SELECT i + 1, ((SELECT b FROM tot) - coalesce((SELECT sum(2 * source_size) FROM src WHERE 2 * source_size <= level * w), 0)) / (SELECT sum(w) FROM src WHERE 2 * source_size > level * w)
  FROM lev WHERE i < (SELECT count(*) FROM src) AND (SELECT count(*) FROM src WHERE 2 * source_size > level * w) > 0),
goal AS (SELECT source, source_size, round(least(2.0::DOUBLE * source_size, (SELECT max(level) FROM lev) * w), 6) AS target FROM src),
line AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM sized)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - before)) + greatest(0, least(size, round(target)::BIGINT - source_size - before)))::BIGINT AS taken
FROM line JOIN goal ON line.source IS NOT DISTINCT FROM goal.source
"""
