"""Versioned documents and key-value writes, as new tables from old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def replay(log: DataFrame, key: str, cmd: str, *order: str, deletes: Sequence[str] = ("delete",)) -> DataFrame:
    """What is left after adds, updates (full replacements) and deletes, whatever order they arrive in."""
    return latest(log, key, *order).where(~F.col(cmd).isin(*deletes))


def visible(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of the version that the document has now."""
    return postings.join(docs.select("doc_id", "version"), ["doc_id", "version"], "left_semi")


def compact(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Drops the postings of queued (doc_id, version) pairs; repeats in the queue count once."""
    return postings.join(gone.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_anti")


def valid_pins(pins: DataFrame, word: str, now: Column) -> DataFrame:
    return pins.where((F.col("word") == word) & (F.col("start_time") <= now) & (now <= F.col("end_time"))).orderBy(F.desc("weight"), F.desc("doc_id"))


def add_pins(pins: DataFrame, new: DataFrame, hours: int = 24) -> DataFrame:
    """Pins one row for each of `words` (split at |, blank ones left out), a day long unless said.

    A pin that ends before it starts never shows, as its times say.
    """
    start = F.coalesce("start_time", F.current_timestamp())
    made = new.select(F.explode(F.split("words", r"\|")).alias("word"), "doc_id", "weight", start.alias("start_time"), F.coalesce("end_time", start + F.make_interval(hours=F.lit(hours))).alias("end_time"))
    return replace(pins, made.where(F.trim("word") != ""), ["word", "doc_id"])


def drop_pins(pins: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the pins of `gone`: (word, doc_id) pairs, or documents with all their words."""
    key = [c for c in ("word", "doc_id") if c in gone.columns]
    return pins.join(gone.select(*key).distinct(), key, "left_anti")


def add_column(table: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """A column added while in use: old rows have the default; an error if it is there."""
    if name in table.columns:
        raise ValueError(f"there is a column {name}")
    return table.withColumn(name, F.lit(default).cast(kind))


def auto_columns(rows: DataFrame, first: int = 1, at: Column | None = None) -> DataFrame:
    """Adds row_id, created and modified: numbers from `first` on, unique and rising with no order of their own; times of the write."""
    at = F.current_timestamp() if at is None else at
    return rows.withColumns({"row_id": F.monotonically_increasing_id() + first, "created": at, "modified": at})


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows, and the rows whose key was there already."""
    there = table.select(*key)
    return table.unionByName(rows.join(there, list(key), "left_anti").dropDuplicates(list(key))), rows.join(there, list(key), "left_semi")


def replace(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows take the place of those with their key."""
    new = rows.dropDuplicates(list(key))
    return table.join(new.select(*key), list(key), "left_anti").unionByName(new)


def update(table: DataFrame, where: Column, changes: dict[str, tuple[str, object]]) -> DataFrame:
    """set, add, sub, or, set_bit and clear_bit on the columns of rows that match."""
    how = {
        "set": lambda c, v: F.lit(v),
        "add": lambda c, v: c + v,
        "sub": lambda c, v: c - v,
        "or": lambda c, v: c.bitwiseOR(F.lit(v)),
        "set_bit": lambda c, v: c.bitwiseOR(F.lit(1 << v)),
        "clear_bit": lambda c, v: c.bitwiseAND(F.lit(~(1 << v))),
    }
    kinds = dict(table.dtypes)
    return table.withColumns({n: F.when(where, how[op](F.col(n), v).cast(kinds[n])).otherwise(F.col(n)) for n, (op, v) in changes.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def expire(table: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    """Rows past their time are gone; rows without one stay."""
    return table.where(F.col(column).isNull() | (F.col(column) > now))


def get(table: DataFrame, key: str, values: Sequence, columns: Sequence[str] = ("*",), where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Point and multi-key reads with projected columns and conditions."""
    out = table.where(F.col(key).isin(list(values)))
    out = (out if where is None else out.where(where)).select(*columns)
    return out if limit is None else out.limit(limit)


def scan(table: DataFrame, where: Column, order: Sequence[Column], columns: Sequence[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """An ordered range read."""
    out = table.where(where).orderBy(*order).select(*columns)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def same_text(a: Column, b: str) -> Column:
    """String columns compare without case; binary ones exactly."""
    return F.lower(a) == b.lower()
