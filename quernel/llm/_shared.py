"""What the operators share: tables, durable intermediate results, Arrow batches."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_folder

#: Rows and bytes that one Arrow batch holds, so that a worker's memory does
#: not depend on how long the texts are.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20
#: ASCII white space, as the word pattern `[^\x20\x09-\x0D]+` has it.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches; on a local master also lets Python workers import this package from where it lies.

    On a cluster the package is installed, or sent along, on every node.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not spark.sparkContext.master.startswith("local"):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/quernel-{app}/{label}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only what it was doing, and
    nothing random is ever computed twice.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def anew(c: str) -> Column:
    """A long column as it is, but placed nobody knows where.

    A join on it deals both sides out again, and so can split a hot key, where
    an aggregate's result by the same key would be joined in place.
    """
    return F.col(c) + F.lit(0)


def forget(df: DataFrame) -> None:
    """Removes the files behind a `durable` result that nothing reads any more."""
    root = f"{shared_folder(df.sparkSession)}/quernel-"
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root.split("://")[-1].lstrip("/") in folder:
            remove(df.sparkSession, folder)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[dict]], dict]], schema: str) -> DataFrame:
    """Applies `make()` of each task to the rows of each Arrow batch.

    `make()` returns a function from columns (name to list) to columns.
    """
    prepare(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work(batch.to_pydict())
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, parsed)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def tidy(spark: SparkSession) -> None:
    """Lets the driver notice plans that are done, so that Spark removes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
