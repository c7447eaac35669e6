"""Continuous work over an operation log and an event stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Store, bucket_of, index_documents, write_postings
from ..operators.mutate import latest, replay, visible
from ..schema import IndexSpec
from ..session import remove

#: Buckets of keys that a maintained table is laid out by.
KEY_BUCKETS = 64


class Maintained:
    """A table of documents kept by a log of adds, updates and deletes, and its postings.

    Under `path`: `rows/gen=N/bucket=B` has the newest row of each key of
    bucket B as batch N left it; `manifest/N.json` names the generation of each
    bucket after batch N. A batch rewrites only the buckets that it touches;
    what no manifest in use names is removed. With a `spec`, `postings/gen=N`
    has the postings of batch N's documents with their version; a posting
    counts while its version is the document's, until `compact` drops the rest.
    A manifest is written last and whole: a batch that fails leaves the table as
    it was, and one that runs again replaces what it had written.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", cmd: str = "cmd", seq: str = "seq", buckets: int = KEY_BUCKETS, spec: IndexSpec | None = None, grace: int | None = None):
        """`grace`: deletes more than so many `seq` behind the newest are forgotten; none are without it."""
        self.spark, self.path, self.key, self.cmd, self.seq, self.buckets, self.spec, self.grace = spark, path.rstrip("/"), key, cmd, seq, buckets, spec, grace

    def _files(self, folder: str) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def manifest(self, upto: int | None = None) -> tuple[int, dict[str, int]]:
        """The number of the last batch (up to one) and the generation of each bucket."""
        numbers = sorted(int(x.removesuffix(".json")) for x in self._files("manifest") if x.endswith(".json") and not x.startswith("."))
        numbers = [n for n in numbers if upto is None or n <= upto]
        if not numbers:
            return -1, {}
        return numbers[-1], json.loads(self.spark.read.text(f"{self.path}/manifest/{numbers[-1]}.json", wholetext=True).first()[0])

    def _publish(self, number: int, made: dict[str, int]) -> None:
        """Writes a manifest under another name and renames it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        draft, final = path(f"{self.path}/manifest/.{number}.json"), path(f"{self.path}/manifest/{number}.json")
        fs = draft.getFileSystem(conf)
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        fs.delete(final, False)
        fs.rename(draft, final)

    def _read(self, made: dict[str, int], only: set[str] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/rows/gen={g}/bucket={b}" for b, g in made.items() if only is None or b in only]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """One batch, for `foreachBatch`; columns that only one side has are null on the other."""
        last, made = self.manifest(number - 1)
        batch = batch.withColumn("__bucket", bucket_of(F.col(self.key).cast("string"), self.buckets))
        touched = sorted(r[0] for r in batch.select("__bucket").distinct().collect())  # at most `buckets` numbers
        if touched:
            old = self._read(made, {str(b) for b in touched})
            rows = batch if old is None else old.withColumn("__bucket", bucket_of(F.col(self.key).cast("string"), self.buckets)).unionByName(batch, allowMissingColumns=True)
            newest = latest(rows, self.key, self.seq, self.cmd)
            if self.grace is not None:
                top = batch.agg(F.max(self.seq)).first()[0]
                newest = newest.where((F.col(self.cmd) != "delete") | (F.col(self.seq) >= top - self.grace))
            newest.withColumnRenamed("__bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/gen={number}")
            if self.spec is not None:
                now = replay(batch.drop("__bucket"), self.key, self.cmd, self.seq)
                postings = index_documents(now, self.spec).join(now.select(F.col(self.key).cast("string").alias("doc_id"), F.col(self.seq).alias("version")), "doc_id")
                write_postings(postings, f"{self.path}/postings/gen={number}", self.buckets)
            there = {x.removeprefix("bucket=") for x in self._files(f"rows/gen={number}") if x.startswith("bucket=")}
            made = {b: g for b, g in made.items() if int(b) not in touched} | dict.fromkeys(there, number)
        self._publish(number, made)
        self._tidy(number, last)

    def _tidy(self, number: int, last: int) -> None:
        """Removes manifests before the last two, and what neither of these names."""
        used = {(b, g) for n in (number, last) if n >= 0 for b, g in self.manifest(n)[1].items()}
        for x in self._files("manifest"):
            if x.endswith(".json") and not x.startswith(".") and int(x.removesuffix(".json")) < last:
                remove(self.spark, f"{self.path}/manifest/{x}")
        for gen in self._files("rows"):
            g = int(gen.removeprefix("gen="))
            parts = [x for x in self._files(f"rows/{gen}") if x.startswith("bucket=")]
            gone = [x for x in parts if (x.removeprefix("bucket="), g) not in used and g <= number]
            for x in [""] if len(gone) == len(parts) and g <= number else gone:
                remove(self.spark, f"{self.path}/rows/{gen}/{x}".rstrip("/"))

    def start(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follows a log from where the checkpoint is; from its start without one."""
        return log.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def load(self, rows: DataFrame) -> None:
        """A full snapshot as generation 0, before a log is followed; `cmd` and `seq` are columns of it."""
        if self.manifest()[0] >= 0:
            raise ValueError(f"{self.path} has rows already")
        self.merge(rows, 0)

    def rows(self) -> DataFrame | None:
        """The newest row of each key, deletes included; nothing before the first batch."""
        return self._read(self.manifest()[1])

    def current(self) -> DataFrame | None:
        """Documents that are live now."""
        found = self.rows()
        return None if found is None else found.where(F.col(self.cmd) != "delete")

    def postings(self) -> DataFrame:
        """Postings of the versions that documents have now; filters on field, bucket and term reach the scan."""
        live = self.current().select(F.col(self.key).cast("string").alias("doc_id"), F.col(self.seq).alias("version"))
        return visible(self._all_postings(), live).drop("gen")

    def _all_postings(self) -> DataFrame:
        """The last whole compaction and the generations after it."""
        gens = [x.removeprefix("gen=") for x in self._files("postings") if x.startswith("gen=")]
        base = max((int(g[1:]) for g in gens if g.startswith("c") and "_SUCCESS" in self._files(f"postings/gen={g}")), default=-1)
        used = [g for g in gens if (g == f"c{base}" if g.startswith("c") else int(g) > base)]
        return self.spark.read.option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/gen={g}" for g in used])

    def compact(self) -> None:
        """Writes the postings that count as those up to the last batch, then removes what they replace."""
        last = self.manifest()[0]
        before = [x for x in self._files("postings") if x != f"gen=c{last}"]
        write_postings(self.postings().drop("bucket"), f"{self.path}/postings/gen=c{last}", self.buckets)
        for x in before:
            remove(self.spark, f"{self.path}/postings/{x}")

    def store(self) -> Store:
        """The postings that count as an index to search; statistics are counted for the terms asked for."""
        found = self.postings()
        stats = found.groupBy("field", "bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
        return Store(found, stats, self.current().count(), self.buckets)


def running_counts(events: DataFrame, word: str = "event_type") -> DataFrame:
    """Counts so far of each word, for update mode."""
    return events.groupBy(word).count()


def _watched(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on `ts`, which has to be an instant; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, every: str, *by: str, late: str = "10 minutes") -> DataFrame:
    rows = _watched(events, late)
    return rows.groupBy(F.window("ts", every), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, length: str, every: str, *by: str, late: str = "10 minutes") -> DataFrame:
    rows = _watched(events, late)
    return rows.groupBy(F.window("ts", length, every), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, *by: str, late: str = "10 minutes") -> DataFrame:
    rows = _watched(events, late)
    return rows.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))


def joined(left: DataFrame, right: DataFrame, on: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Rows of two streams (or tables) with equal `on`, the right one up to `within` after the left.

    Both have `ts`; the right's columns get the prefix `r_`. Watermarks and the
    bound on time let state go.
    """
    a, b = _watched(left, late), _watched(right, late)
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    return a.join(b, (F.col(on) == F.col(f"r_{on}")) & (F.col("r_ts") >= F.col("ts")) & (F.col("r_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}")))


def coalesced_deletes(queue: DataFrame, late: str = "1 minute") -> DataFrame:
    """A delete that is queued again within the watermark counts once."""
    watched = _watched(queue, late)
    return watched.dropDuplicatesWithinWatermark(["doc_id", "version"]) if queue.isStreaming else watched.dropDuplicates(["doc_id", "version"])


def unexpired(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows whose time to live is not over at the time of the batch."""
    return rows.where(F.col("ts") + F.make_interval(secs=F.lit(seconds)) > F.current_timestamp())


def for_each(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Replays a log from its start, or goes on from the checkpoint."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
