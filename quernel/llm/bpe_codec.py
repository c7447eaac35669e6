"""Byte-level BPE encoding and decoding of a text column."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._shared import map_rows, table


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """`doc_id`, `ids` (array of int): the ids of each whole text.

    A null text counts as empty and has no ids. Rows that repeat are encoded
    as often as they occur; other columns are ignored. No shuffle.
    """

    def make():
        coder = bpe.load(vocabulary)
        return lambda c: {"doc_id": c["doc_id"], "ids": [coder.encode(t or "") for t in c["text"]]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """`doc_id`, `data` (binary): the bytes behind the ids; null ids give no bytes."""

    def make():
        coder = bpe.load(vocabulary)
        return lambda c: {"doc_id": c["doc_id"], "data": [coder.decode(x or []) for x in c["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Per document the digests of its ids and of the bytes that they decode to, and the ids if asked for.

    Encodes and decodes in one pass, so that neither ids nor bytes move. A null
    text counts as empty; repeated rows each give a row.
    """

    def make():
        coder = bpe.load(vocabulary)
        spelled = [str(i) for i in range(max(coder.bytes_of) + 1)]

        def work(c):
            ids = [coder.encode(t or "") for t in c["text"]]
            out = {
                "doc_id": c["doc_id"],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(spelled.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids],
            }
            return out | {"ids": ids} if with_ids else out

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))
