"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams by rank. A text's distance
to a language is the sum, over its own most frequent n-grams, of how far each
is out of place there; an n-gram that the profile lacks counts as the profile
is long. The nearest language wins, the lesser name among equals.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import map_rows, prepare, table

#: n-grams have 1 to 3 characters of a word with a blank on either side.
PROFILE = 400
#: Labelled rows that profiles are fitted on at most: those with the least hashes.
TRAIN_ROWS = 8000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")  # and numerals such as fractions, which `letters` takes out
_BLANK, _ONE, _TWO = np.int64(32), np.int64(21), np.int64(42)


def letters(text: str) -> str:
    """The words of a text in lower case, runs of letters (as `str.isalpha` has them), one blank apart."""
    found = "".join(words := _WORDS.findall(text.lower()))
    if found and not found.isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return " ".join(words)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, by code point, and their counts.

    An n-gram is one number, its characters 21 bits each with the first on
    top, so that numbers sort as the strings do.
    """
    words = letters(text)
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    first, inside = c << _TWO, c != _BLANK
    two = (first[:-1] | c[1:] << _ONE)[inside[:-1] | inside[1:]]
    three = (first[:-2] | c[1:-1] << _ONE | c[2:])[inside[1:-1]]  # a blank is never in the middle
    return np.unique(np.concatenate([first[inside], two, three]), return_counts=True)


def top(text: str) -> np.ndarray:
    """The PROFILE most frequent n-grams, most frequent first, then by code point."""
    found, counts = grams(text)
    return found[np.argsort(-counts, kind="stable")[:PROFILE]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, list[int]]]:
    """Profiles from text and lang of documents that are not held out.

    Of rows with text and lang, at most `rows` are read: those whose doc_id,
    text and lang have the least hash; a repeated row counts once. Profiles are
    a few hundred numbers a language, so they are sent to the driver; languages
    are those of these rows at most.
    """
    one = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text", "lang").alias("h"))
    one = one.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    least = one.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if least is None:
        return []

    def make():
        def work(c):
            by: dict[str, list] = defaultdict(list)
            for text, lang in zip(c["text"], c["lang"], strict=True):
                by[lang].append(grams(text))
            out = {"lang": [], "gram": [], "n": []}
            for lang, found in by.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                out["lang"] += [lang] * len(keys)
                out["gram"] += keys.tolist()
                out["n"] += np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64).tolist()
            return out

        return work

    counts = map_rows(one.where(F.col("h") <= least).dropDuplicates(["h"]).select("text", "lang"), make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counts.withColumn("r", rank).where(F.col("r") <= PROFILE).collect()
    by: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for x in ranked:
        by[x["lang"]].append((x["r"], x["gram"]))
    return [(lang, [g for _, g in sorted(by[lang])]) for lang in sorted(by)]


class Scorer:
    """Predicts texts from profiles; one for each task."""

    def __init__(self, profiles: list[tuple[str, list[int]]]):
        self.langs = [lang for lang, _ in profiles]
        self.known = np.array(sorted({g for _, p in profiles for g in p}), dtype=np.int64)
        self.ranks = np.full((len(self.known) + 1, max(1, len(profiles))), -1, dtype=np.int32)
        for k, (_, found) in enumerate(profiles):
            self.ranks[np.searchsorted(self.known, np.array(found, dtype=np.int64)), k] = np.arange(len(found))
        self.order = np.arange(PROFILE, dtype=np.int32)[:, None]

    def predict(self, text: str | None) -> tuple[str, float]:
        best_grams = top(text) if text and self.langs else ()
        if not len(best_grams):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, best_grams)
        at[self.known[np.minimum(at, len(self.known) - 1)] != best_grams] = len(self.known)
        there = self.ranks[at]
        far = np.where(there < 0, PROFILE, np.abs(there - self.order[: len(at)])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (PROFILE * len(at)))


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; only `text` decides.

    A null text and one without a letter are `und` with score 0, and so is any
    text when there are no profiles. The score is 1 less the distance as a
    share of the greatest possible. Repeated rows each give a row; other
    columns are ignored. No shuffle.
    """

    def make():
        scorer = Scorer(profiles)

        def work(c):
            found = [scorer.predict(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "held_out": c["held_out"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_rows(slim, make, "doc_id long, held_out boolean, lang_pred string, score double")


def known_only(docs: DataFrame, profiles: list[tuple[str, list[int]]]) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has a language. No shuffle."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(profiles)
        for batch in batches:
            yield batch.filter(pa.array([scorer.predict(t)[0] != UNKNOWN for t in batch.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, by profiles of those not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
