"""The pipeline against a slow plain version of its stages."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from quernel.llm.mixing import OP6_SQL
from tests.llm import fixtures
from tests.llm.test_operators import docs_table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows: list[tuple]) -> Counter:
    """doc_id, n_tokens and ids_sha256 that the pipeline gives for rows with one doc_id each."""
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    largest = {}
    for r in left:
        largest[fixtures.lower(r[1])] = max(r[0], largest.get(fixtures.lower(r[1]), r[0]))
    left = [r for r in left if largest[fixtures.lower(r[1])] == r[0]]
    group = fixtures.near_components([(r[0], r[1]) for r in left], 5, 80, 100)
    left = [r for r in left if group[r[0]] == r[0]]
    con = duckdb.connect()
    con.register("documents", docs_table(left))
    copies = {i: math.ceil(taken / size) if taken else 0 for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({OP6_SQL})").fetchall()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for r in left:
        found = coder.encode_ordinary(r[1])
        if copies[r[0]]:
            out[r[0], len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()] += copies[r[0]]
    return out


def test_the_pipeline_equals_the_plain_version(spark, tmp_path):
    one = {r[0]: r[:5] for r in fixtures.doc_rows()}
    rows = sorted(one.values(), key=lambda r: r[0])
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == plain(rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_near_copies_are_rows_of_their_own(spark):
    """Rows of one doc_id with different texts, near copies without doc_id, and a link through such a row."""
    base, other, third = (fixtures.prose(k, 200) for k in (41, 42, 43))
    swap = lambda text, *at: " ".join("changed" if i in at else w for i, w in enumerate(text.split()))
    middle = swap(third, 20, 60, 80)
    rows = [(1, base), (7, swap(base, 50)), (7, fixtures.prose(44, 200)), (None, other), (None, swap(other, 50)), (4, third), (None, middle), (5, swap(middle, 100, 140, 170))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    assert all(len(a & b) * 100 < 80 * len(a | b) for a, b in [(fixtures.shingles(third, 5), fixtures.shingles(rows[7][1], 5))])
    group = fixtures.near_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80, 100)
    assert [group[k] for k in range(len(rows))] == [0, 0, 2, 3, 3, 5, 5, 5]
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sum(i is None for i, _ in left) == 1 and {t for i, t in left if i is None} < {t for i, t in rows[3:5]}
    assert sorted(x for x in left if x[0] is not None) == sorted([rows[0], rows[2], rows[5]])


def test_stages_take_awkward_and_empty_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    for rows in (fixtures.doc_rows(True), []):
        docs = spark.createDataFrame(rows, fixtures.SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, "")
            if name != "byte_bpe":
                assert made.columns == docs.columns
            if not rows:
                assert made.count() == 0
