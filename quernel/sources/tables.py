"""Tables in the formats that Spark reads, by name or by the ending of their path."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "avro": "avro", "txt": "text"}
#: What needs a package of its own on the cluster.
PACKAGES = {"avro": "spark-avro", "kafka": "spark-sql-kafka"}


def format_of(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"no format for {path}")
    return FORMATS[ending]


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options: object) -> DataFrame:
    """Rows of a file or folder. Without a schema a format that has none of its own gets strings (csv) or what is found (json)."""
    made = spark.read.format(kind := kind or format_of(path)).options(**({"header": "true"} if kind == "csv" else {}) | ({"sep": "\t"} if path.endswith(".tsv") else {}) | options)
    try:
        return (made if schema is None else made.schema(schema)).load(path)
    except AnalysisException as e:
        if kind in PACKAGES and "FAILED_TO_FIND" in str(e).upper().replace(" ", "_"):
            raise RuntimeError(f"{kind} needs the package {PACKAGES[kind]}") from e
        raise


def write_table(rows: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", by: tuple[str, ...] = (), **options: object) -> None:
    kind = kind or format_of(path)
    made = rows.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | ({"sep": "\t"} if path.endswith(".tsv") else {}) | options)
    (made.partitionBy(*by) if by else made).save(path)


def read_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: object) -> DataFrame:
    """A table behind JDBC, read by ranges of a numeric key, each in a task of its own."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def follow_topic(spark: SparkSession, servers: str, topic: str, schema: str, **options: object) -> DataFrame:
    """A topic of JSON messages as a stream of typed rows with `seq`, their offset."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"} | options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), F.col("offset").alias("seq")).select("r.*", "seq")
