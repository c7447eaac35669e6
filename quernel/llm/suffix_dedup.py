"""Repeated passages by a sparse suffix array.

A suffix is kept where its first GRAM words have the least hash among WINDOW
neighbouring positions. GRAM + WINDOW - 1 is the shortest passage sought, so
each repeat of one has such a position at the same place in all its copies.
Positions whose gram occurs once are dropped; the others are range-sorted by
the words that follow, over all tasks whatever the grams' frequencies, and
each is compared with its neighbours: words in common to the right (beyond the
gram) and to the left. Where these make MIN_WORDS or more, the passage is a
repeat. A suffix that agrees longest with its neighbour to the right may still
agree longer to the left with a farther one; so grams of three or more places
are settled exactly, by digests of the passages of MIN_WORDS around the gram.
Places with equal contexts are neighbours and have all their words, so one of
them stands for all there, and a gram whose places all reach to the end of
their contexts needs no settling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import durable, forget, map_rows, prepare, table, tidy
from .minhash_dedup import STEP, Shingler, _mixed

MIN_WORDS, GRAM = 50, 25
WINDOW, REACH = MIN_WORDS - GRAM + 1, MIN_WORDS - GRAM
#: Bytes of a word's hash in the contexts that are sorted and compared; two words agree by chance once in 10^12 comparisons.
WIDTH = 5
#: Rows of a part that the range sort samples.
SAMPLE = 20


class _Words(Shingler):
    def hashes(self, text: str | None) -> np.ndarray:
        known = self.cache.get
        return np.array([known(w) or self._hash(w) for w in (text or "").encode().lower().split()], dtype=np.uint64)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions and the digests of their grams."""
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    g = np.full(n, GRAM, dtype=np.uint64)
    for i in range(GRAM):
        g = g * STEP + h[i : i + n]
    g = _mixed(g)
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.unique(np.concatenate([view[i : i + 8192].argmin(axis=1) + i + np.arange(len(view[i : i + 8192])) for i in range(0, len(view), 8192)]))
    return at, g[at]


def contexts(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WIDTH bytes of each of the REACH words behind the gram, and of those before it, nearest first.

    A place outside the text holds zeros, a word never does.
    """
    short = np.zeros((len(h) + 2 * REACH + GRAM, 8), dtype=np.uint8)
    short[REACH : REACH + len(h)] = (h | np.uint64(1)).view(np.uint8).reshape(-1, 8)
    short = short[:, :WIDTH]
    right = at[:, None] + REACH + GRAM + np.arange(REACH)
    left = at[:, None] + REACH - 1 - np.arange(REACH)
    return short[right], short[left]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in common from the start of each row on; words outside a text are in common with none."""
    same = (a == b).all(axis=2) & a.any(axis=2)
    return np.cumprod(same, axis=1, dtype=np.int64).sum(axis=1)


def _node() -> Column:
    """What a row is called in the search: its doc_id; without one a number of its text, below -2^62."""
    return F.coalesce(F.col("doc_id").cast("long"), -F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) - F.lit(1 << 62) - 1)


def _survey(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_words, a digest of the words, positions and grams of the anchors."""

    def make():
        words = _Words(1)

        def work(c):
            out = {k: [] for k in ("n_words", "d1", "d2", "at", "gram")}
            for text in c["text"]:
                h = words.hashes(text)
                d = xxhash.xxh3_128_digest(h.tobytes())
                at, gram = anchors(h)
                for k, v in (("n_words", len(h)), ("d1", int.from_bytes(d[:8], "little", signed=True)), ("d2", int.from_bytes(d[8:], "little", signed=True)), ("at", at), ("gram", gram.view(np.int64))):
                    out[k].append(v)
            return {"doc_id": c["doc_id"], "node": c["node"]} | out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"), "text"), make, "doc_id long, node long, n_words long, d1 long, d2 long, at array<int>, gram array<long>")


SUFFIX = "key long, id long, pos int, right binary, left binary"


def _suffixes(texts: DataFrame) -> DataFrame:
    """SUFFIX rows of id, text and the positions wanted."""

    def make():
        words = _Words(1)

        def work(c):
            out = {k: [] for k in ("key", "id", "pos", "right", "left")}
            for key, text, wanted in zip(c["id"], c["text"], c["wanted"], strict=True):
                h = words.hashes(text)
                at, gram = anchors(h)
                live = np.isin(at, np.array(wanted))
                at, gram = at[live], gram[live]
                right, left = contexts(h, at)
                out["key"] += gram.view(np.int64).tolist()
                out["id"] += [key] * len(at)
                out["pos"] += at.tolist()
                out["right"] += [x.tobytes() for x in right]
                out["left"] += [x.tobytes() for x in left]
            return out

        return work

    return map_rows(texts.select("id", "text", "wanted"), make, SUFFIX)


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), REACH, WIDTH)


def _neighbours(ordered: DataFrame) -> DataFrame:
    """kind 0: places with the best l and r found so far; kinds 1 and 2: a part's first and last row.

    A place is full if l and r reach to the end of its contexts. Of neighbours
    with equal contexts the first is the lead; only a lead keeps its contexts.
    """
    kinds = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("full", pa.bool_()), ("lead", pa.bool_()), ("right", pa.binary()), ("left", pa.binary())])
    names = ("key", "id", "pos", "right", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, held_l, held_r, held_lead = TaskContext.get().partitionId(), None, 0, 0, True
        edge = lambda kind, x: pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) | {"kind": kind, "part": part, "l": 0, "r": 0, "full": False, "lead": False}], schema=kinds)

        def places(rows: list[list], l: np.ndarray, r: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:  # noqa: E741
            full = (l >= _matrix(rows[4]).any(axis=2).sum(axis=1)) & (r >= _matrix(rows[3]).any(axis=2).sum(axis=1) + GRAM)
            right, left = ([x if f else b"" for x, f in zip(c, lead, strict=True)] for c in rows[3:])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([0] * len(l), [part] * len(l), *rows[:3], l, r, full, lead, right, left), kinds, strict=True)], schema=kinds)

        for batch in batches:
            c = batch.to_pydict()
            rows = [c[k] for k in names]
            if not rows[0]:
                continue
            if held is None:
                yield edge(1, [x[0] for x in rows])
            else:
                rows = [[x, *y] for x, y in zip(held, rows, strict=True)]
            n = len(rows[0])
            key, right, left = np.array(rows[0]), _matrix(rows[3]), _matrix(rows[4])
            l, r, lead = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)  # noqa: E741
            if held is not None:
                l[0], r[0], lead[0] = held_l, held_r, held_lead
            if n > 1:
                cr, cl = _common(right[1:], right[:-1]) + GRAM, _common(left[1:], left[:-1])
                fits = (key[1:] == key[:-1]) & (cr + cl >= MIN_WORDS)
                cr, cl = np.where(fits, cr, 0), np.where(fits, cl, 0)
                for s in (slice(1, None), slice(None, -1)):
                    l[s], r[s] = np.maximum(l[s], cl), np.maximum(r[s], cr)
                lead[1:] = (key[1:] != key[:-1]) | (right[1:] != right[:-1]).any(axis=(1, 2)) | (left[1:] != left[:-1]).any(axis=(1, 2))
                yield places([x[:-1] for x in rows], l[:-1], r[:-1], lead[:-1])
            held, held_l, held_r, held_lead = [x[-1] for x in rows], l[-1], r[-1], lead[-1]
        if held is not None:
            yield edge(2, held)
            yield places([[x] for x in held], np.array([held_l]), np.array([held_r]), np.array([held_lead]))

    return ordered.mapInArrow(run, "kind int, part int, key long, id long, pos int, l int, r int, full boolean, lead boolean, right binary, left binary")


def _seams(edges: DataFrame) -> DataFrame:
    """Spans (id, start, stop) from comparing each part's last row with the first one of the next part that has any.

    Only the numbers of the parts, one for each task, are put in order in one place.
    """
    first, last = edges.where("kind = 1"), edges.where("kind = 2")
    after = first.select(F.col("part").alias("n_part"), F.lead("part").over(Window.orderBy("part")).alias("n_next"))
    other = first.select(*[F.col(c).alias(f"f_{c}") for c in ("part", "key", "id", "pos", "right", "left")])
    both = last.join(after, F.col("part") == F.col("n_part")).join(other, (F.col("n_next") == F.col("f_part")) & (F.col("key") == F.col("f_key")))

    def make():
        def work(c):
            out = {"id": [], "start": [], "stop": []}
            if c["id"]:
                r = _common(_matrix(c["right"]), _matrix(c["f_right"])) + GRAM
                l = _common(_matrix(c["left"]), _matrix(c["f_left"]))  # noqa: E741
                for i in np.flatnonzero(l + r >= MIN_WORDS):
                    for k in ("", "f_"):
                        out["id"].append(c[f"{k}id"][i])
                        out["start"].append(c[f"{k}pos"][i] - int(l[i]))
                        out["stop"].append(c[f"{k}pos"][i] + int(r[i]))
            return out

        return work

    return map_rows(both.select("id", "pos", "right", "left", "f_id", "f_pos", "f_right", "f_left"), make, "id long, start int, stop int")


def _windows(rows: DataFrame) -> DataFrame:
    """digest, id, start of the passages of MIN_WORDS around the gram of each row."""

    def make():
        def work(c):
            if not c["id"]:
                return None
            right, left = _matrix(c["right"]), _matrix(c["left"])
            n_right, n_left = right.any(axis=2).sum(axis=1), left.any(axis=2).sum(axis=1)
            out = {"digest": [], "id": [], "start": []}
            for i, (key, doc, pos) in enumerate(zip(c["key"], c["id"], c["pos"], strict=True)):
                seed, a, b = key & (1 << 64) - 1, left[i].tobytes(), right[i].tobytes()
                for o in range(max(0, REACH - n_right[i]), min(REACH, n_left[i]) + 1):
                    passage = a[: o * WIDTH] + b[: (REACH - o) * WIDTH]
                    out["digest"].append(xxhash.xxh3_64_intdigest(passage + bytes([o]), seed) - (1 << 63))
                    out["id"].append(doc)
                    out["start"].append(pos - int(o))
            return out

        return work

    return map_rows(rows.select("key", "id", "pos", "right", "left"), make, "digest long, id long, start int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of MIN_WORDS words or more that occur at two places or more.

    Words are runs without ASCII white space, A-Z lower-cased. Returns doc_id,
    n_words, n_dup_words, spans (array of start, stop in words, in order and
    apart), one row per input row. A text of at least MIN_WORDS words with an
    exact copy is one span; of its copies one stands for all in the search. A
    null or short text has no span. Rows of one doc_id share their spans; rows
    without one are searched by their texts. Other columns are ignored.
    """
    spark = docs.sparkSession
    made = durable(_survey(docs), "survey")
    long = F.col("n_words") >= MIN_WORDS
    classes = made.where(long).groupBy(F.col("d1").alias("c1"), F.col("d2").alias("c2")).agg(F.min("node").alias("rep"), F.count("*").alias("copies"))
    classes = durable(classes.where("copies > 1").select("c1", "c2", "rep"), "classes")
    same = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & long
    named = durable(made.join(classes, same, "left").select("doc_id", "node", "n_words", F.coalesce("rep", "node").alias("id"), F.col("c1").isNotNull().alias("copied"), "at", "gram"), "named")
    forget(made)

    places = named.where("id = node").select("id", F.explode(F.arrays_zip("gram", "at")).alias("a")).select("id", F.col("a.gram").alias("gram"), F.col("a.at").alias("at"))
    live = durable(places.groupBy("gram").agg(F.count("*").alias("uses")).where("uses > 1").select(F.col("gram").alias("l_gram"), "uses"), "live")
    wanted = places.join(live, F.col("gram") == F.col("l_gram")).groupBy("id").agg(F.collect_set("at").alias("wanted"))
    wanted = durable(wanted.withColumnRenamed("id", "w_id"), "wanted")
    tidy(spark)
    texts = docs.select(_node().alias("id"), "text").join(wanted, F.col("id") == F.col("w_id"))
    suffixes = durable(_suffixes(texts.select("id", "text", "wanted")), "suffixes")
    tidy(spark)

    order = ("key", "right", "left", "id", "pos")
    # the driver orders a sample of the rows, contexts included: a few from each part will do
    sample = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(sample)
    spark.conf.set(sample, str(SAMPLE))
    try:
        compared = durable(_neighbours(suffixes.repartitionByRange(*order).sortWithinPartitions(*order)), "neighbours")
    finally:
        spark.conf.set(sample, before)
    forget(suffixes)
    tidy(spark)
    found = compared.where("kind = 0 and r > 0").select("id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"))
    found = found.union(_seams(compared))

    unsettled = compared.where("kind = 0 and not full").select("key").distinct().join(live.where("uses > 2"), F.col("key") == F.col("l_gram"), "left_semi")
    unsettled = durable(unsettled.withColumnRenamed("key", "o_key"), "unsettled")
    around = durable(_windows(compared.where("kind = 0 and lead").join(unsettled, F.col("key") == F.col("o_key"), "left_semi")), "windows")
    place = F.xxhash64("id", "start")
    twice = durable(around.groupBy("digest").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select(F.col("digest").alias("t_digest")), "twice")
    more = around.join(twice, F.col("digest") == F.col("t_digest"), "left_semi").select("id", "start", (F.col("start") + MIN_WORDS).alias("stop"))
    spans = found.union(more).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found"))
    spans = durable(spans.select(F.col("id").alias("s_id"), "found"), "spans")
    for x in (classes, live, wanted, compared, unsettled, around, twice):
        forget(x)
    tidy(spark)

    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    both = named.join(spans, F.col("id") == F.col("s_id"), "left").select("doc_id", "n_words", F.when(F.col("copied"), whole).otherwise(F.col("found")).alias("found"))

    def make():
        def work(c):
            out = {"spans": [], "n_dup_words": []}
            for found in c["found"]:
                merged: list[list[int]] = []
                for x in found or []:
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["stop"])
                    else:
                        merged.append([x["start"], x["stop"]])
                out["spans"].append([{"start": a, "stop": b} for a, b in merged])
                out["n_dup_words"].append(sum(b - a for a, b in merged))
            return {"doc_id": c["doc_id"], "n_words": c["n_words"]} | out

        return work

    return map_rows(both, make, "doc_id long, n_words long, n_dup_words long, spans array<struct<start:int,stop:int>>")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return repeated_passages(table(spark, sf_dir, "documents"))
