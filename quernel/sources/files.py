"""Dictionary files, request logs and documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import shape_column
from ..schema import IndexSpec, SpecError

DICTIONARIES = {
    "words": "id long, word string, app int, freq long",
    "english": "id long, word string, freq long",
    "syllables": "id long, syllable string",
    "readings": "ch string, syllable string",
    "characters": "id long, ch string",
    "hot": "app int, word string, n long",
}


def dictionary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A tab-separated dictionary; lines of another shape are left out."""
    rows = spark.read.csv(path, sep="\t", schema=DICTIONARIES[kind], mode="PERMISSIVE", quote="")
    return rows.dropna()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word a line: stop words, sensitive words."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def word_groups(spark: SparkSession, path: str) -> DataFrame:
    """group_id and word of lines of tab-separated words: related words, synonyms."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("group_id", F.monotonically_increasing_id())
    return lines.select("group_id", F.explode(F.split("value", "\t")).alias("word")).where(F.trim("word") != "")


ENVELOPE = "appid int, table_content struct<cmd:string,fields:string>"


def documents(raw: DataFrame, spec: IndexSpec, value: str = "value") -> DataFrame:
    """Typed rows of JSON requests: cmd, doc key and the declared fields; unknown ones are left out.

    A request of another application is an error, as is a value of another
    type in a field (both null the row's `ok`).
    """
    flat = T.StructType([T.StructField(f.name, {"geo_point": T.StringType(), "geo_shape": T.StringType()}.get(f.kind, f.type)) for f in spec.fields.values() if f.kind != "union"])
    made = raw.select(F.from_json(F.col(value), ENVELOPE).alias("r"))
    made = made.select(F.col("r.appid").alias("app"), F.col("r.table_content.cmd").alias("cmd"), F.from_json("r.table_content.fields", flat).alias("f"))
    columns = []
    for f in spec.fields.values():
        if f.kind == "geo_point":
            columns.append(_point(F.col(f"f.{f.name}")).alias(f.name))
        elif f.kind == "geo_shape":
            columns.append(shape_column(F.col(f"f.{f.name}")).alias(f.name))
        elif f.kind != "union":
            columns.append(F.col(f"f.{f.name}").alias(f.name))
    return made.select("cmd", (F.col("app") == spec.app).alias("ok"), *columns)


def _point(c):
    """"lat,lng", ["lat","lng"] or {"latitude":..,"longitude":..} as lat and lng."""
    plain = F.split(F.regexp_replace(c, r'[\[\]"\s]', ""), ",")
    lat = F.coalesce(F.get_json_object(c, "$.latitude"), F.try_element_at(plain, F.lit(1))).try_cast("double")
    lng = F.coalesce(F.get_json_object(c, "$.longitude"), F.try_element_at(plain, F.lit(2))).try_cast("double")
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


ARTICLES = "appid int, fields_count int, table_content array<struct<cmd:string,fields:struct<doc_id:string,title:string,content:string,author:string,url:string,weight:int,publish_time:long>>>"


def articles(raw: DataFrame, value: str = "value") -> DataFrame:
    """Rows of batches of articles: app, cmd, doc_id, title, content, author, url, weight, publish_time, ok.

    `ok` is false for all rows of a batch whose `fields_count` is not the
    number of its articles, or that has none (one row stands for it), and for
    a row without a command or a doc_id. A missing weight is 1, a missing time
    now.
    """
    made = raw.select(F.from_json(F.col(value), ARTICLES).alias("r"))
    whole = F.coalesce((F.size("r.table_content") > 0) & (F.size("r.table_content") == F.col("r.fields_count")), F.lit(False))
    rows = made.select(F.col("r.appid").alias("app"), whole.alias("whole"), F.explode_outer("r.table_content").alias("c"))
    f = F.col("c.fields")
    ok = F.col("whole") & F.coalesce(F.col("c.cmd").isin("add", "update", "delete"), F.lit(False)) & f["doc_id"].isNotNull()
    return rows.select("app", F.col("c.cmd").alias("cmd"), f["doc_id"].alias("doc_id"), f["title"].alias("title"), f["content"].alias("content"), f["author"].alias("author"), f["url"].alias("url"), F.coalesce(f["weight"], F.lit(1)).alias("weight"), F.coalesce(f["publish_time"], F.unix_timestamp()).alias("publish_time"), ok.alias("ok"))


def article_postings(rows: DataFrame, analyzer: str = "word") -> DataFrame:
    """Postings of titles and contents of added articles, both under one field, as a document's terms are counted in each."""
    from ..operators.index import postings

    live = rows.where(F.col("ok") & F.col("cmd").isin("add", "update"))
    both = [postings(live, "doc_id", name, analyzer).withColumn("field", F.lit("article")) for name in ("content", "title")]
    return both[0].union(both[1])


PINS = "appid int, table_content struct<cmd:string,fields:struct<id:string,doc_id:string,sp_words:string,weight:int,top_start_time:long,top_end_time:long>>"


def pin_requests(raw: DataFrame, value: str = "value") -> DataFrame:
    """cmd, doc_id, words, weight, start_time, end_time of requests that pin documents (`top_add`, `top_update`, `top_delete`).

    A missing weight is 1; times are unix seconds there and instants here,
    null where missing; a document is named by `id` or else `doc_id`. Other
    commands, and requests without a document, are left out.
    """
    r = raw.select(F.from_json(F.col(value), PINS).alias("r")).select("r.table_content.*")
    f = F.col("fields")
    rows = r.select("cmd", F.coalesce(f["id"], f["doc_id"]).alias("doc_id"), f["sp_words"].alias("words"), F.coalesce(f["weight"], F.lit(1)).alias("weight"), F.timestamp_seconds(f["top_start_time"]).alias("start_time"), F.timestamp_seconds(f["top_end_time"]).alias("end_time"))
    return rows.where(F.col("cmd").isin("top_add", "top_update", "top_delete") & F.col("doc_id").isNotNull())


def append_log(rows: DataFrame, path: str) -> None:
    """The request log: appended whole, atomically for each write."""
    rows.write.mode("append").json(path)


def checked(rows: DataFrame) -> DataFrame:
    """Fails if a row is of another application."""
    if rows.where("ok is distinct from true").limit(1).count():
        raise SpecError("a request is not of this application")
    return rows.drop("ok")


def request_counts(log: DataFrame, edges: tuple[int, ...] = (5, 10, 50, 100, 500, 1000)) -> DataFrame:
    """app, kind, bucket, n, failed of a request log (app, kind, millis, code): a bucket is the least edge that a request's time is under, null past the last."""
    bucket = F.lit(None).cast("int")
    for edge in reversed(edges):
        bucket = F.when(F.col("millis") < edge, F.lit(edge)).otherwise(bucket)
    return log.groupBy("app", "kind", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("code") != 0).alias("failed"))
