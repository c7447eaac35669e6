"""Analyzers: texts to terms. Latin text stays in built-in functions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[\p{L}\p{N}]+"
_registered: dict[str, Callable[[Column], Column]] = {}


def word_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def ngram_terms(text: Column, n: int = 3) -> Column:
    """All substrings of 1 to n characters, by start and length."""
    size = F.char_length(text)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), size - i + 1)), lambda k: F.substring(text, i, k))
    return F.flatten(F.transform(starts, one))


def letter_terms(text: Column) -> Column:
    return F.array(F.regexp_replace(F.lower(text), "[^a-z]", ""))


def register_analyzer(name: str, analyzer: Callable[[Column], Column] | Callable[[str], list[str]], native: bool = False) -> None:
    """Adds an analyzer: a column function if `native`, else a Python function that runs in batches."""
    if native:
        _registered[name] = analyzer
        return

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: analyzer(x) if x is not None else [])

    _registered[name] = run


def analyze(name: str, text: Column) -> Column:
    known = {"word": word_terms, "keyword": F.array, "letters": letter_terms, "ngram": ngram_terms} | _registered
    if name not in known:
        raise ValueError(f"no analyzer {name}")
    return known[name](text)


#: Marks of a sentence's ends among its words.
BEGIN, END = "<BEG>", "<END>"


def training_counts(corpus: DataFrame, words: str = "words", punctuation: str = r"^[\p{P}\p{S}]+$") -> DataFrame:
    """kind, a, b, n: what segmenters learn from a corpus with one array of words a sentence.

    `pair`: how often word b follows word a, sentence ends included and
    punctuation left out; `start`, `move`, `emit`: first tags of sentences,
    tags after tags, characters of tags, where a word's characters are tagged
    B, M, E or S. Blank words are left out; a sentence without words counts for
    nothing. One pass and one aggregate with partial sums.
    """
    w = F.filter(words, lambda x: F.length(F.trim(x)) > 0)
    said = F.filter("w", lambda x: ~x.rlike(punctuation))
    ends = F.when(F.size("said") > 0, F.concat(F.array(F.lit(BEGIN)), "said", F.array(F.lit(END)))).otherwise(F.array().cast("array<string>"))
    tags = F.concat_ws("", F.transform("w", lambda x: F.when(F.char_length(x) == 1, F.lit("S")).otherwise(F.concat(F.lit("B"), F.repeat(F.lit("M"), F.char_length(x) - 2), F.lit("E")))))
    rows = corpus.select(w.alias("w")).select("w", said.alias("said")).select(ends.alias("ends"), F.split(F.concat_ws("", "w"), "").alias("chars"), F.split(tags, "").alias("tags"))
    one = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"))
    after = lambda kind, c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: one(kind, F.get(c, i - 1), F.get(c, i)))
    tail = lambda kind, c: F.when(F.size(c) > 1, after(kind, c)).otherwise(F.array().cast("array<struct<kind:string,a:string,b:string>>"))
    found = F.concat(
        tail("pair", F.col("ends")), tail("move", F.col("tags")),
        F.array(one("start", F.get("tags", F.lit(0)), F.lit(""))),
        F.zip_with("tags", "chars", lambda t, c: one("emit", t, c)),
    )
    return rows.select(F.explode(found).alias("x")).select("x.*").where("kind = 'pair' or a <> ''").groupBy("kind", "a", "b").agg(F.count("*").alias("n"))


class Dictionary:
    """Words with frequencies, and what a corpus says about pairs of words and tags of characters."""

    LONGEST, TOTAL = 8, 8_000_000

    def __init__(self, words: Mapping[str, float], corpus: Iterable[list[str]] = (), counts: Iterable[tuple[str, str, str, int]] | None = None):
        """`counts` are rows of `training_counts`; a small `corpus` of lists of words is counted here."""
        self.words = dict(words)
        self.widest = max(map(len, self.words), default=1)
        self.pairs: dict[tuple[str, str], int] = {}
        self.heads: dict[str, int] = {}
        self.start, self.move, self.emit = {}, {}, {}
        for kind, a, b, n in self._count(corpus) if counts is None else counts:
            if kind == "pair":
                self.pairs[a, b] = n
                self.heads[a] = self.heads.get(a, 0) + n
            elif kind == "start":
                self.start[a] = n
            else:
                (self.move if kind == "move" else self.emit)[a, b] = n
        #: Words seen in training, and how often each tag was.
        self.trained = sum(n for (a, _), n in self.pairs.items() if a != BEGIN)
        self.tags = {t: sum(n for (x, _), n in self.emit.items() if x == t) for t in "BMES"}
        self.rarest = min((n / self.tags[t] for (t, _), n in self.emit.items()), default=1.0)

    @staticmethod
    def _count(corpus: Iterable[list[str]]) -> list[tuple[str, str, str, int]]:
        found: Counter = Counter()
        for sentence in corpus:
            w = [x for x in sentence if x.strip()]
            said = [x for x in w if any(c.isalnum() for c in x)]
            if said:
                found.update(("pair", a, b) for a, b in zip([BEGIN, *said], [*said, END], strict=True))
            tags = "".join("S" if len(x) == 1 else "B" + "M" * (len(x) - 2) + "E" for x in w)
            found.update([("start", tags[0], "")] if tags else [])
            found.update(("move", a, b) for a, b in zip(tags, tags[1:], strict=False))
            found.update(("emit", t, c) for t, c in zip(tags, "".join(w), strict=True))
        return [(*k, n) for k, n in found.items()]

    @classmethod
    def trained_on(cls, words: DataFrame, corpus: DataFrame) -> Dictionary:
        """From tables: word and freq, and a corpus with arrays `words`; a dictionary is small by definition."""
        return cls({r["word"]: r["freq"] for r in words.collect()}, counts=[tuple(r) for r in training_counts(corpus).collect()])

    def forward(self, s: str) -> list[str]:
        """Longest word first, from the left."""
        out, i = [], 0
        while i < len(s):
            n = next((k for k in range(min(self.LONGEST, len(s) - i), 1, -1) if s[i : i + k] in self.words), 1)
            out.append(s[i : i + n])
            i += n
        return out

    def backward(self, s: str) -> list[str]:
        """Longest word first, from the right."""
        out, j = [], len(s)
        while j > 0:
            n = next((k for k in range(min(self.LONGEST, j), 1, -1) if s[j - k : j] in self.words), 1)
            out.append(s[j - n : j])
            j -= n
        return out[::-1]

    def likeliest(self, s: str) -> list[str]:
        """The path of the greatest sum of log frequencies over words of any length; the shorter first word among equals.

        A character stands alone where it is a word, or where no word starts.
        """
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(s) + 1)
        for i in range(len(s) - 1, -1, -1):
            ends = [j for j in range(i + 1, min(len(s), i + self.widest) + 1) if s[i:j] in self.words] or [i + 1]
            best[i] = max(((math.log(max(self.words.get(s[i:j], 1), 1)) - math.log(self.TOTAL) + best[j][0], j) for j in ends), key=lambda x: (x[0], -x[1]))
        out, i = [], 0
        while i < len(s):
            out.append(s[i : best[i][1]])
            i = best[i][1]
        return out

    def _score(self, words: list[str]) -> float:
        """How likely words follow one another; the first of a sentence also counts by its frequency."""
        total = 0.0
        for a, b in zip(words, words[1:], strict=False):
            total += math.log((self.pairs.get((a, b), 0) + 1) / (self.heads.get(a, 0) + max(1, self.trained)))
        if len(words) > 1 and words[0] == BEGIN:
            total += math.log(self.words.get(words[1], 0) + 1 / max(1, len(self.heads)) + self.trained)
        return total

    def arbitrated(self, s: str) -> list[str]:
        """Forward and backward; each stretch between words that both have goes to the likelier, backward at a tie."""
        ways = []
        for words in (self.forward(s), self.backward(s)):
            ends = [0]
            for w in words:
                ends.append(ends[-1] + len(w))
            ways.append(list(zip(ends, ends[1:], strict=False)))
        common = [(-1, 0), *sorted(set(ways[0]) & set(ways[1])), (len(s), len(s) + 1)]
        name = lambda span: BEGIN if span[0] < 0 else END if span[0] == len(s) else s[span[0] : span[1]]
        out: list[str] = []
        for left, right in zip(common, common[1:], strict=False):
            if left[1] < right[0]:
                a, b = ([s[i:j] for i, j in way if left[1] <= i and j <= right[0]] for way in ways)
                score = lambda x: self._score([name(left), *x, *([name(right)] if right[0] < len(s) else [])])  # noqa: B023, E731
                out += a if score(a) > score(b) else b
            if right[0] < len(s):
                out.append(name(right))
        return out

    def discover(self, words: list[str]) -> list[str]:
        """Joins runs of single characters into new words by their likeliest tags; a run that is a word stays one."""
        out: list[str] = []
        run = ""
        for w in [*words, ""]:
            if len(w) == 1 and not w.isascii():
                run += w
                continue
            if run:
                out += [run] if len(run) == 1 or run in self.words else self._tagged(run)
                run = ""
            if w:
                out.append(w)
        return out

    def _tagged(self, s: str) -> list[str]:
        """Words by the likeliest tags; what a tag never had counts as the rarest, a move that never was is all but ruled out."""
        before = {"B": "ES", "M": "BM", "E": "BM", "S": "ES"}
        sentences = max(1, sum(self.start.values()))
        emit = lambda t, c: math.log(n / self.tags[t] if (n := self.emit.get((t, c), 0)) else self.rarest)
        move = lambda u, t: math.log((self.move.get((u, t), 0) + 1e-6) / (self.tags[u] + 1))
        paths = {t: (math.log((self.start.get(t, 0) + 1e-6) / sentences) + emit(t, s[0]), t) for t in "BS"}
        for c in s[1:]:
            paths = {t: max((paths[u][0] + move(u, t) + emit(t, c), paths[u][1] + t) for u in before[t] if u in paths) for t in "BMES" if any(u in paths for u in before[t])}
        tags = max(v for t, v in paths.items() if t in "ES")[1]
        out = [""]
        for c, t in zip(s, tags, strict=True):
            out[-1] += c
            if t in "ES":
                out.append("")
        return [x for x in out if x]

    def expand(self, words: list[str]) -> list[str]:
        """Adds the 2- and 3-grams of each longer word that are words; ASCII words stay as they are."""
        out = []
        for w in words:
            if not w.isascii():
                out += [w[i : i + n] for n in (2, 3) if len(w) > n for i in range(len(w) - n + 1) if w[i : i + n] in self.words]
            out.append(w)
        return out

    def segment(self, text: str, mode: str = "backward", discover: bool = False, expand: bool = False) -> list[str]:
        """Runs of ASCII letters and digits are terms; other runs without punctuation are segmented."""
        out: list[str] = []
        for run in re.findall(r"[A-Za-z0-9]+|[^\W\da-zA-Z_]+|\d+", text.lower()):
            if run.isascii():
                out.append(run)
                continue
            words = getattr(self, mode)(run)
            words = self.discover(words) if discover else words
            out += self.expand(words) if expand else words
        return out

    def column(self, c: Column, mode: str) -> Column:
        """A column of words by one of the methods, in Arrow batches; null gives null."""

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(s: pd.Series) -> pd.Series:
            work = getattr(self, mode)
            return s.map(lambda x: work(x) if x is not None else None)

        return run(c)


def register_segmenter(name: str, dictionary: Dictionary, mode: str = "backward", **options: bool) -> None:
    register_analyzer(name, lambda text: dictionary.segment(text, mode, **options))


def valid_terms(rows: DataFrame, stop: DataFrame, words: DataFrame | None = None, term: str = "term") -> DataFrame:
    """Index-time check over (.., term) rows: no stop word; in the dictionary, its stem for Latin words, or a number, if a dictionary is given.

    Both lists are tables with a column `word`; joins, so they may be of any size.
    """
    out = rows.join(stop.select(F.col("word").alias("__stop")), F.col(term) == F.col("__stop"), "left_anti")
    if words is None:
        return out
    look = F.when(F.col(term).rlike("^[A-Za-z]"), stemmed(F.col(term))).otherwise(F.col(term))
    known = words.select(F.col("word").alias("__word")).distinct()
    number = F.regexp_extract(F.col(term), r"^[0-9]+", 0).rlike("[1-9]")
    both = out.withColumn("__look", look).join(known, F.col("__look") == F.col("__word"), "left")
    return both.where(F.col("__word").isNotNull() | number).select(*rows.columns)


_VOWELS = "aeiou"


def _measure(stem: str) -> int:
    kinds = "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS or (w[i] == "y" and i > 0 and not _is_vowel(w, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and not _is_vowel(w, len(w) - 3) and _is_vowel(w, len(w) - 2) and not _is_vowel(w, len(w) - 1) and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if _measure(stem) > least else w
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = [(x, "") for x in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")]


def stem(word: str) -> str:
    """Porter's algorithm."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    if w.endswith("ion") and not any(w.endswith(x) for x, _ in _STEP4) and len(w) > 3 and w[-4] in "st":
        w = w[:-3] if _measure(w[:-3]) > 1 else w
    else:
        w = _swap(w, _STEP4, 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.StringType())
def stemmed(s: pd.Series) -> pd.Series:
    return s.map(stem, na_action="ignore")


def ip_to_long(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    part = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.try_element_at(part, F.lit(i + 1)).try_cast("long")
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}(?<!\.)$"), value)


def data_type(text: Column) -> Column:
    """chinese, english, number, hybrid or empty."""
    han, latin = text.rlike(r"\p{IsHan}"), text.rlike("[A-Za-z]")
    return F.when(F.length(F.trim(text)) == 0, "empty").when(han & latin, "hybrid").when(han, "chinese").when(latin, "english").when(text.rlike(r"^\s*\d+\s*$"), "number").otherwise("other")


def time_text(seconds: Column) -> Column:
    """Unix seconds as `yyyy-MM-dd HH:mm:ss` in the session's time zone; a year before 0 or after 9999 as its plain number, without padding or a plus."""
    at = F.timestamp_seconds(seconds)
    year = F.year(at).cast("string")
    return F.concat(F.when(F.year(at).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(at, "-MM-dd HH:mm:ss"))
