"""Exact deduplication by content-defined chunk recipes.

One pass over the texts cuts each into chunks whose ends depend only on the
characters near them, and keeps a text's recipe: the ordered identifiers of
its chunks. Texts never move; recipes, about a hundredth of their size, do.
Chunks are deduplicated by identifier, and each identifier is verified by a
second, independent digest. Texts are equal when their lists are.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, durable, table

#: Characters of a chunk, at least and at most, and what ends one in between.
CHUNK_MIN, CHUNK_MAX, CHUNK_END = 1024, 8192, "[a-m][\\x20\\n](?=[n-z])"


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, chunks: array of (fp, check, n). Null texts count as empty."""
    cut = f"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?{CHUNK_END}|.{{1,{CHUNK_MAX}}}"
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce("text", F.lit(""))).alias("t"))
    return normal.select(
        "doc_id",
        F.sha2("t", 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all("t", F.lit(cut), F.lit(0)),
            lambda c: F.struct(F.xxhash64(c).alias("fp"), F.xxhash64(F.sha2(c, 256)).alias("check"), F.char_length(c).alias("n")),
        ).alias("chunks"),
    )


def chunk_table(made: DataFrame) -> DataFrame:
    """One row for each chunk identifier: how often it occurs, and whether all its chunks are the same."""
    one = made.select(F.explode("chunks").alias("c")).select("c.*")
    found = one.groupBy("fp").agg(F.count("*").alias("n_uses"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    return found.select("fp", "n_uses", F.col("n_hi").alias("n_chars"), ((F.col("lo") == F.col("hi")) & (F.col("n_lo") == F.col("n_hi"))).alias("verified"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty, and empty texts are equal. Returns doc_id, keep_id, group_size,
    kept, text_sha256, one row per input row. A null doc_id never is keep_id
    unless all rows of the group have none; then keep_id is null and all of
    them are kept. Rows that repeat keep_id are all marked kept. Other columns
    are ignored.
    """
    made = durable(recipes(docs), "recipes")
    # short identifiers are enough unless two different chunks share one
    sound = chunk_table(made).where(~F.col("verified")).limit(1).count() == 0
    ids = F.transform("chunks", (lambda c: c["fp"]) if sound else (lambda c: c))
    lists = made.select("doc_id", "text_sha256", ids.alias("ids"))
    groups = lists.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = durable(groups, "groups")  # as a table of its own, a hot list can be split in the join
    g = groups.select(F.col("ids").alias("g_ids"), "keep_id", "group_size")
    single = F.col("group_size").isNull()
    return lists.join(g, F.col("ids") == F.col("g_ids"), "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row and whole text of `documents`."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
