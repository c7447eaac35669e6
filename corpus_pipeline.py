"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `docs`. `run` writes each stage's rows to the
shared folder and reads them back for the next, so a lost executor costs no
more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe_codec, exact_dedup, language_id, minhash_dedup, mixing
from quernel.llm._shared import WORD, ascii_lower, durable, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go.

    Without any labelled document there are no profiles, and all stay.
    """
    profiles = language_id.fit(docs)
    return language_id.known_only(docs, profiles) if profiles else docs


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat it, one."""
    made = durable(exact_dedup.exact_dedup(docs), "decisions")
    gone = made.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__own", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    left = marked.join(gone.distinct(), marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_anti")
    again = made.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    return (left.dropDuplicates(["doc_id", "__own"]) if again else left).drop("__own")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the row with the least doc_id.

    A row is its doc_id and text, named by a hash of both, so rows of one
    doc_id with different texts are apart. One without doc_id stays only where
    its group has no other.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    made = minhash_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), words=5, num=80, den=100)
    made = durable(made.select(F.col("doc_id").alias("__id"), "component_id").distinct(), "groups")
    ids = rows.select("__row", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    stay = made.join(ids, F.col("__id") == F.col("__row")).groupBy("component_id").agg(F.min_by("__row", order).alias("__stay"))
    gone = durable(made.join(stay.select("__stay"), F.col("__id") == F.col("__stay"), "left_anti").select("__id"), "decisions")
    return rows.join(gone, F.col("__row") == F.col("__id"), "left_anti").drop("__row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix runs over it; one across a budget's end counts whole.

    A null source is a source; a null text has no words and is not in the mix.
    Rows with words that share doc_id and source come as often as the one of
    them that the mix runs over most. Without rows, none.
    """
    name = F.col("doc_id").cast("long")
    key = F.md5(F.coalesce(name.cast("string"), F.lit("")))
    # a source's line is in the order of its keys, so one cut says how often each document comes, and texts stay where they are
    made = mixing.mix(docs).where("taken > 0").select("source", F.struct(F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"), key.alias("key"), name.alias("doc_id")).alias("place"))
    cuts = durable(made.groupBy(F.col("source").alias("__source")).agg(F.max("place").alias("__cut")), "cuts")
    both = docs.where(F.col("text").rlike(WORD)).join(cuts, docs["source"].cast("string").eqNullSafe(F.col("__source")))
    early = F.struct(key.alias("key"), name.alias("doc_id")) <= F.struct(F.col("__cut.key").alias("key"), F.col("__cut.doc_id").alias("doc_id"))
    copies = F.col("__cut.copies") - F.when(early, 0).otherwise(1)
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document.

    A null text counts as empty, a null doc_id stays null; repeated rows each give a row.
    """
    return bpe_codec.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
#: Learned profiles, signatures and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
