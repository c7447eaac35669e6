"""Inverted index: postings, statistics, phrases."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text
from ..schema import IndexSpec
from ..session import exists, remove

#: Buckets of terms that written postings are laid out by.
BUCKETS = 64


#: Tokens that are grouped at a time, a document at least.
TOKENS = 2_000_000
_BLOCKS = "term string, docs array<%s>, tfs array<int>, starts array<int>, places array<int>, df int, total int"
#: What ids are kept as in blocks: whole numbers as numbers, others as text.
_IDS = "bigint", "string"


def _id_kind(docs: DataFrame, key: str) -> str:
    return _IDS[0] if isinstance(docs.schema[key].dataType, T.IntegralType) else _IDS[1]


def blocks(docs: DataFrame, key: str, field: str, analyzer: str = "word", only: Sequence[str] | None = None) -> DataFrame:
    """Postings by term, a row for each term of a few thousand documents: their ids, term frequencies, and places one after the other (`starts`: where a document's begin).

    Texts are analysed by Spark; Arrow batches of terms are grouped by one sort
    of their numbers, so that no posting is a row until it is asked for.
    """

    def grouped(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, begins = batch.column(1).flatten(), np.concatenate([[0], np.cumsum(lengths)])
            low = 0
            while low < len(lengths):
                high = max(low + 1, int(np.searchsorted(begins, begins[low] + TOKENS, "right")) - 1)
                coded = words.slice(begins[low], begins[high] - begins[low]).dictionary_encode()
                code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(high - low, dtype=np.int32), lengths[low:high])
                at = (np.arange(len(code)) - np.repeat(begins[low:high] - begins[low], lengths[low:high])).astype(np.int32)
                wanted = code >= 0
                if only is not None:
                    wanted &= np.append(pc.is_in(coded.dictionary, value_set=pa.array(list(only), coded.dictionary.type)).to_numpy(zero_copy_only=False), False)[code]
                code, doc, at = code[wanted], doc[wanted], at[wanted]
                if len(code):
                    order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else code, kind="stable")
                    code, doc, at = code[order], doc[order], at[order]
                    one = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))  # each posting's first token
                    term = np.flatnonzero(np.append(True, code[one][1:] != code[one][:-1]))  # each term's first posting
                    ends, n = np.append(term, len(one)), np.diff(np.append(one, len(code)))
                    places = np.append(one[term], len(code))
                    of_docs = batch.column(0).slice(low, high - low).take(pa.array(doc[one]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            coded.dictionary.take(pa.array(code[one[term]])), lists(ends, of_docs), lists(ends, pa.array(n, pa.int32())), lists(ends, pa.array(one - np.repeat(one[term], np.diff(ends)), pa.int32())),
                            lists(places, pa.array(at)), pa.array(np.diff(ends), pa.int32()), pa.array(np.diff(places), pa.int32()),
                        ],
                        ["term", "docs", "tfs", "starts", "places", "df", "total"],
                    )
                low = high

    kind = _id_kind(docs, key)
    terms = docs.select(F.col(key).cast(kind).alias("doc_id"), text.analyze(analyzer, F.col(field)).alias("t"))
    return terms.mapInArrow(grouped, _BLOCKS % kind).withColumn("field", F.lit(field))


def unpacked(made: DataFrame) -> DataFrame:
    """The rows of `blocks`: doc_id, field, term, tf, positions, and the bucket if there is one."""
    more = [c for c in ("bucket",) if c in made.columns]
    one = made.select("field", "term", "tfs", "starts", "places", *more, F.posexplode("docs").alias("i", "doc_id"))
    tf = F.get("tfs", F.col("i"))
    return one.select(F.col("doc_id").cast("string").alias("doc_id"), "field", "term", tf.alias("tf"), F.slice("places", F.get("starts", F.col("i")) + 1, tf).alias("positions"), *more)


def postings(docs: DataFrame, key: str, field: str, analyzer: str = "word", positions: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """doc_id, field, term, tf, positions (all, or the first ones) for each document and term, without a shuffle. `only` names the terms wanted, if not all are."""
    rows = unpacked(blocks(docs, key, field, analyzer, only))
    return rows if positions is None else rows.withColumn("positions", F.slice("positions", 1, positions))


def index_documents(docs: DataFrame, spec: IndexSpec, made: Callable[..., DataFrame] = postings) -> DataFrame:
    """Postings (or `blocks`) of every indexed text field; a document's `version` goes along if there is one."""
    out = None
    for f in spec.fields.values():
        if f.indexed and f.kind in ("string", "text") and f.analyzer in ("word", "keyword", "ngram"):
            one = made(docs, spec.key, f.name, f.analyzer)
            out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no text field is indexed")
    return out


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(made: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Rows or blocks partitioned by field and a bucket of the term, sorted by term, so that a lookup reads one folder and skips most of it.

    Rows are dealt by folder and rebalanced: adaptive plans cut a large bucket,
    or one hot term, over several tasks and files and join small ones.
    """
    rows = made.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", F.col("field"), F.col("bucket"))
    rows.sortWithinPartitions("field", "bucket", "term", *[c for c in ("doc_id",) if c in made.columns]).write.mode(mode).partitionBy("field", "bucket").parquet(path)


@dataclass(frozen=True)
class Store:
    """A written index: postings, statistics of terms, and the number of documents."""

    postings: DataFrame
    stats: DataFrame
    n_docs: int
    buckets: int

    def lookup(self, table: DataFrame, wanted: Iterable[tuple[str, str]]) -> DataFrame:
        """The rows of `table` for (field, term) pairs: folders by constants, terms by a filter that reaches the scan."""
        wanted = list(wanted)
        spark = table.sparkSession
        terms = sorted({t for _, t in wanted})
        numbers = spark.sql("SELECT explode(from_json(:t, 'array<string>')) AS t", args={"t": json.dumps(terms)}).select("t", bucket_of(F.col("t"), self.buckets).alias("b"))
        bucket = {r["t"]: r["b"] for r in numbers.collect()}
        of: dict[str, list[str]] = {}
        for f, t in wanted:
            of.setdefault(f, []).append(t)
        keep = F.lit(False)
        for f, ts in of.items():
            keep = keep | ((F.col("field") == f) & F.col("bucket").isin(sorted({bucket[t] for t in ts})) & F.col("term").isin(ts))
        # said once more over all fields, in a form that prunes folders and row groups
        return table.where(F.col("field").isin(sorted(of)) & F.col("bucket").isin(sorted(set(bucket.values()))) & F.col("term").isin(terms)).where(keep)

    def frequencies(self, wanted: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Documents of each (field, term): as many numbers as a query has terms."""
        return {(r["field"], r["term"]): r["df"] for r in self.lookup(self.stats, wanted).select("field", "term", "df").collect()}


def write_store(docs: DataFrame, spec: IndexSpec, path: str, buckets: int = BUCKETS) -> Store:
    """Writes postings and their statistics as a new generation under `path`; the one before is dropped when it is whole.

    A write that fails leaves what was there: the new generation counts only
    once its last part, the statistics, is complete.
    """
    spark = docs.sparkSession
    old, new = _last(spark, path), uuid.uuid4().hex[:8]
    number = (old[0] if old else 0) + 1
    root = f"{path}/g{number:08d}-{new}"
    kind = _id_kind(docs, spec.key)
    write_postings(index_documents(docs, spec, blocks), f"{root}/blocks-{kind}", buckets)
    made = _read_blocks(spark, root, kind)
    n = docs.count()
    stats = made.groupBy("field", "bucket", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total_tf")).withColumns({"n_docs": F.lit(n), "buckets": F.lit(buckets)})
    stats.hint("rebalance", F.col("field"), F.col("bucket")).sortWithinPartitions("field", "bucket", "term").write.partitionBy("field", "bucket").parquet(f"{root}/stats")
    if old:
        remove(spark, old[1])
    return _open(spark, root, buckets, n)


def open_store(spark: SparkSession, path: str) -> Store:
    """The last whole generation under `path`."""
    found = _last(spark, path)
    if found is None:
        raise FileNotFoundError(f"no index under {path}")
    one = spark.read.parquet(f"{found[1]}/stats").select("n_docs", "buckets").first()
    return _open(spark, found[1], one["buckets"] if one else BUCKETS, one["n_docs"] if one else 0)


def _open(spark: SparkSession, root: str, buckets: int, n: int) -> Store:
    stats = "field string, term string, df long, total_tf long, bucket int"
    if exists(spark, f"{root}/postings"):  # written a row for each posting
        made = spark.read.schema("doc_id string, field string, term string, tf int, positions array<int>, bucket int").parquet(f"{root}/postings")
    else:
        made = unpacked(_read_blocks(spark, root, next(x for x in _IDS if exists(spark, f"{root}/blocks-{x}"))))
    return Store(made, spark.read.schema(stats).parquet(f"{root}/stats"), n, buckets)


def _read_blocks(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_BLOCKS % kind}, field string, bucket int").parquet(f"{root}/blocks-{kind}")


def _last(spark: SparkSession, path: str) -> tuple[int, str] | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = sorted((x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().startswith("g")), reverse=True)
    return next(((int(x[1:9]), f"{path}/{x}") for x in names if exists(spark, f"{path}/{x}/stats/_SUCCESS")), None)


def term_stats(made: DataFrame) -> DataFrame:
    return made.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def phrase(made: DataFrame, first: str, second: str, gap: int = 2) -> DataFrame:
    """Documents in which `second` follows `first` within `gap` words: each document's two postings meet in one aggregate.

    Places that the postings kept count: all, unless they were built with `positions`.
    """
    two = made.where(F.col("term").isin(first, second)).groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.when(F.col("term") == first, F.col("positions")))).alias("a"), F.flatten(F.collect_list(F.when(F.col("term") == second, F.col("positions")))).alias("b")
    )
    return two.where(F.exists("a", lambda p: F.exists("b", lambda q: (q > p) & (q - p <= gap)))).select("doc_id")


def clip_newest(rows: DataFrame, key: str, order: list, limit: int, share: float = 0.8) -> DataFrame:
    """Keys over `limit` keep their newest `share` of it; others keep all.

    A key's count is an aggregate with partial sums, and ranks past `limit` are
    cut before rows move, so that a hot key is no more than `limit` rows of
    each task.
    """
    many = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= limit)
    both = ranked.join(many, F.col(key).eqNullSafe(F.col("__key")), "left")
    return both.where(F.col("__n").isNull() | (F.col("__r") <= int(limit * share))).drop("__n", "__r", "__key")
