"""Quality rules: a decision list learned from labelled documents.

Statistics of each whole text come from one pass. Sequential covering then
grows conjunctions of thresholds that pick out documents labelled poor: each
condition added is the one with the most gain, a held-back third of the
sample prunes the conjunction, documents that it covers go, and the next is
grown from the rest. The list becomes one Spark conditional expression.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import durable, map_rows, table

#: Labelled rows that the list is learned from at most: those with the least hashes.
TRAIN_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 48
#: Share of poor documents among those that a rule covers, at least, and their number.
PRECISION, LEAST_COVER = 0.9, 3
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
CAPITALS, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct")


def count_text(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Lines are those with a word; capitals and digits are ASCII."""
    data = text.encode()
    words = data.split()
    without = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeated = 0
    if len(often) < len(windows):
        upto = 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return (len(words), len(text) - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), without(CAPITALS), without(DIGITS), without(MARKS), len(set(words)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; a null text has none of anything. No shuffle."""

    def make():
        def work(c):
            rows = [count_text(t or "") for t in c["text"]]
            return {"doc_id": c["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(COUNTS)}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def features() -> dict[str, Column]:
    """What conditions may test: rates, so that they mean the same at every length."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], poor: np.ndarray, on: np.ndarray) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        p, n = int((on & poor).sum()), int((on & ~poor).sum())
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for name in sorted(x):
            v = x[name]
            steps = np.linspace(0, 1, CUTS + 1)
            for cut in np.unique([*np.quantile(v[on], steps), *np.quantile(v[on & poor], steps)]):
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    got = on & c.holds(x)
                    q, m = int((got & poor).sum()), int((got & ~poor).sum())
                    if q:
                        gain = q * (math.log2(q / (q + m)) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, c)
        if best[1] is None:
            break
        rule.append(best[1])
        on = on & best[1].holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], poor: np.ndarray, back: np.ndarray) -> list[Rule]:
    """The ordered rules. `back` marks the rows that prune and judge."""
    n, left, out = len(poor), np.ones(len(poor), dtype=bool), []
    while len(out) < MAX_RULES and (left & poor & ~back).any():
        rule = _grow(x, poor, left & ~back)

        def worth(r: Rule) -> float:
            got = _covers(r, x, n) & left & back
            p, m = int((got & poor).sum()), int((got & ~poor).sum())
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = _covers(rule, x, n) & left
        p, m = int((got & poor).sum()), int((got & ~poor).sum())
        if not rule or p < LEAST_COVER or (p + 1) / (p + m + 2) < PRECISION or worth(rule) < 2 * PRECISION - 1:
            break
        out.append(rule)
        left &= ~got
    return out


def fit(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most `rows` labels, those with the least hashes; none without labels.

    A label is a doc_id and a quality; one that repeats counts once, and two
    qualities of a document are two labels. Of documents that share a doc_id
    the one with the least features stands for it. Other columns are ignored.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    wanted = wanted.distinct().orderBy("h", "label_id", "quality").limit(rows)
    made = features()
    got = stats.join(wanted, F.col("doc_id") == F.col("label_id")).groupBy("h", "label_id", (F.col("quality") == 0).alias("poor")).agg(F.min(F.struct(*[c.alias(k) for k, c in made.items()])).alias("x"))
    got = got.select("h", "label_id", "poor", *[F.col("x")[k].alias(k) for k in made]).toPandas()
    got = got.sort_values(["h", "label_id", "poor", *made]).reset_index(drop=True)
    return learn({k: got[k].to_numpy() for k in made}, got["poor"].to_numpy(dtype=bool), np.arange(len(got)) % 3 == 2) if len(got) else []


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the number of the first rule that holds, else null."""
    out = None
    for k, rule in enumerate(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return (F.lit(None) if out is None else out).cast("int")


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the first that rejects, or null) and kept.

    A text without words fails the base. Repeated rows each get a row.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, by rules learned from `labels`."""
    stats = durable(statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    return judge(stats, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
