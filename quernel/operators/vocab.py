"""Words: suggestion, correction, related, hot and sensitive words, pinyin."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = 8


def vocabulary(docs: DataFrame, text: Column, pattern: str = "[a-z0-9]+") -> DataFrame:
    """word and freq of a text column."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def suggest_prefix(words: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    return words.where(F.col("word").startswith(prefix)).orderBy(F.desc("freq"), "word").limit(k)


def edit_one(word: str, other: Column) -> Column:
    """Whether one insertion, deletion, replacement or swap of neighbours leads from `word` to `other`."""
    swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})
    near = F.char_length(other).between(len(word) - 1, len(word) + 1) & (F.levenshtein(other, F.lit(word)) <= 1)
    return near | other.isin(swaps) if swaps else near


def correct(words: DataFrame, word: str, k: int = 1) -> DataFrame:
    """A known word as it is, else the most frequent ones one edit away; none where there are none."""
    w = word.lower()
    found = words.where(edit_one(w, F.col("word"))).withColumn("exact", F.col("word") == w)
    return found.orderBy(F.desc("exact"), F.desc("freq"), "word").limit(k).select("word", "freq")


def group_words(groups: DataFrame, word: str, k: int | None = None) -> DataFrame:
    """Other words of the groups (group_id, word) that hold `word`: related words or synonyms."""
    of = groups.where(F.col("word") == word).select("group_id").distinct()
    out = groups.join(of, "group_id", "left_semi").where(F.col("word") != word).select("word").distinct().orderBy("word")
    return out if k is None else out.limit(k)


def merge_groups(groups: DataFrame, new: DataFrame) -> DataFrame:
    """New groups join the first known group that holds one of their words, else get numbers of their own."""
    top = groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top"))
    known = new.join(groups.withColumnRenamed("group_id", "old"), "word").groupBy("group_id").agg(F.min("old").alias("old"))
    put = new.join(known, "group_id", "left").join(F.broadcast(top)).select(F.coalesce("old", F.col("top") + F.col("group_id")).alias("group_id"), "word")
    return groups.select("group_id", "word").union(put).distinct()


def hot_words(counts: DataFrame, app: int | None = None, k: int = 3) -> DataFrame:
    """The k most counted words of (app, word, n) rows, counts of repeats added."""
    rows = counts if app is None else counts.where(F.col("app") == app)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(k)


#: What may begin a syllable by itself, and syllables that may also be read as two.
INITIALS = "b p m f d t n l g k h j q x zh ch sh r z c s y w".split()
TWO_SYLLABLES = dict(
    ("".join(x.split("+")), tuple(x.split("+")))
    for x in (
        "a+o bi+an yu+e bi+ao cu+an di+a di+an di+ao di+e du+an gu+a gu+ai gu+an hu+a hu+ai hu+an hu+o ji+a ji+an ji+ang ji+ao ji+e ju+e ju+an "
        "ku+a ku+ai ku+o li+a li+an li+ang li+ao li+e lu+an mi+an mi+ao mi+e na+o ni+an ni+ao ni+e pi+an pi+ao pi+e qi+a qi+an qi+ang qi+ao qi+e "
        "qu+an qu+e su+an shu+an shu+ang shu+o ti+an ti+e tu+an tu+o xi+a xi+an xi+ao xi+ang xi+e xu+an xu+e ya+o yu+an za+o zu+an zha+o zhu+a zhu+an"
    ).split()
)
_CODA = "[aeiouv]*(?:ng(?![aeiouv])|n(?![aeiouv]))?"
_ONE_SOUND = re.compile(f"(?:[zcs]h|[^aeiouvn]|n(?=[aeiouv]))?{_CODA}")
_TWO_SOUNDS = re.compile(f"(?:[^aeiouvn]|n(?=[aeiouv]))?{_CODA}")


def syllables_by_sound(letters: str, joined: bool = True) -> list[str]:
    """Splits letters before each consonant but a closing n or ng; zh, ch and sh are one consonant if `joined`."""
    return [x for x in (_ONE_SOUND if joined else _TWO_SOUNDS).findall(letters) if x]


def _initials(readings: Sequence[str]) -> list[str]:
    return sorted({y for x in readings for y in (x[:1], x[:2]) if y in INITIALS or len(y) == 1})


class Pinyin:
    """Readings of characters; parses of mixed queries; matching by character, syllable and initial."""

    WINDOW = 6

    def __init__(self, readings: Mapping[str, Sequence[str]]):
        self.readings = {k: tuple(v) for k, v in readings.items()}
        self.syllables = {s for v in self.readings.values() for s in v}

    @classmethod
    def of(cls, rows: DataFrame) -> Pinyin:
        """From a table of ch and syllable, one row a reading; it holds characters, so it is small."""
        found: dict[str, list[str]] = {}
        for r in rows.orderBy("ch", "syllable").collect():
            found.setdefault(r["ch"], []).append(r["syllable"])
        return cls(found)

    def reading(self, word: str) -> str:
        return "".join(self.readings.get(c, (c,))[0] for c in word)

    def longest_match(self, letters: str) -> list[str]:
        """Known syllables within a window, longest first from the left; other letters alone."""
        out, i = [], 0
        while i < len(letters):
            n = next((k for k in range(min(self.WINDOW, len(letters) - i), 1, -1) if letters[i : i + k] in self.syllables), 1)
            out.append(letters[i : i + n])
            i += n
        return out

    def parses(self, query: str) -> list[list[tuple[str, str]]]:
        """Up to four readings of a query as (kind, value) units: char, syllable or initial.

        Letters are split by sound, with doubtful syllables in two, with zh, ch
        and sh apart, and by longest match; what has no unit or more than UNITS is none.
        """
        runs = re.findall(r"[\x00-\x7f]+|[^\x00-\x7f]", query.lower())

        def units(split) -> list[tuple[str, str]]:
            out = []
            for run in runs:
                out += [("initial" if x in INITIALS or len(x) == 1 else "syllable", x) for x in split("".join(run.split()))] if run.isascii() else [("char", run)]
            return out

        first = units(syllables_by_sound)
        ways = [first]
        if any(kind != "char" for kind, _ in first):
            ways.append([(kind, x) for kind, value in first for x in (TWO_SYLLABLES.get(value, (value,)) if kind == "syllable" else (value,))])
            ways += [units(lambda x: syllables_by_sound(x, False)), units(self.longest_match)]
        return [list(x) for x in dict.fromkeys(map(tuple, ways)) if 0 < len(x) <= UNITS]

    def units(self, word: Column) -> Column:
        """array<struct<ch, py: array, ini: array>> of the first UNITS characters: every reading of each, so that any choice of readings is there without listing the choices. A character without readings matches as itself."""
        kind = "array<struct<ch:string,py:array<string>,ini:array<string>>>"

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            one = {c: {"ch": c, "py": list(v), "ini": _initials(v)} for c, v in self.readings.items()}
            return s.map(lambda w: [one.get(c) or {"ch": c, "py": [], "ini": []} for c in w.lower()[:UNITS]] if w is not None else None)

        return run(word)

    def matches(self, units: Column, query: str, anywhere: bool = False) -> Column:
        """Whether `units` start with (or hold) a parse of `query`."""
        out = F.lit(False)
        for parse in self.parses(query):
            for start in range(UNITS - len(parse) + 1 if anywhere else 1):
                one = F.size(units) >= start + len(parse)
                for i, (kind, value) in enumerate(parse):
                    unit = F.get(units, F.lit(start + i))
                    one = one & (unit["ch"] == value if kind == "char" else F.array_contains(unit["py" if kind == "syllable" else "ini"], value))
                out = out | F.coalesce(one, F.lit(False))
        return out

    def matches_word(self, word: Column, query: str, anywhere: bool = False) -> Column:
        """`matches` on the word itself: a parse is a class of characters for each unit, so no units are made."""
        ways = []
        for parse in self.parses(query):
            classes = [[value] if kind == "char" else [c for c, v in self.readings.items() if len(c) == 1 and value in (v if kind == "syllable" else _initials(v))] for kind, value in parse]
            if all(classes):
                skip = f".{{0,{UNITS - len(parse)}}}" if anywhere else ""
                ways.append(skip + "".join("[" + "".join(f"\\x{{{ord(c):x}}}" for c in one) + "]" for one in classes))
        return F.coalesce(F.lower(word).rlike(rf"(?s)\A(?:{'|'.join(ways)})"), F.lit(False)) if ways else F.lit(False)

    def table(self, words: DataFrame) -> DataFrame:
        """word, freq and units of a vocabulary; words repeated count once, with their highest freq."""
        return words.groupBy("word").agg(F.max("freq").alias("freq")).withColumn("units", self.units(F.col("word")))

    def suggest(self, words: DataFrame, query: str, k: int = 5) -> DataFrame:
        """Words of a `table` by units; by plain prefix if none match. One plan: the worse kind counts only without the better."""
        by_units, by_prefix = self.matches_word(F.col("word"), query), F.col("word").startswith(query.lower())
        found = words.select("word", "freq", F.when(by_units, 0).when(by_prefix, 1).alias("kind")).where("kind is not null")
        return _best_kind(found, k).select("word", "freq")

    def correct(self, words: DataFrame, query: str, segment: Callable[[str], list[str]] | None = None) -> DataFrame:
        """word, freq, kind: the likeliest meant word of a `table`, or no row.

        kind 0: the word is known. Else the most frequent by units (1); for
        letters a word that starts so (2), else one edit away (3); for
        characters that `segment` leaves all alone (or without it), a word by
        the same reading (4), else one edit of a character away (5).
        """
        w = query.lower()
        c, latin = F.col("word"), bool(re.fullmatch(r"[\x00-\x7f]+", w))
        near = edit_one(w, c)
        ways = [(0, c == w), (1, self.matches_word(c, w))]
        if latin:
            ways += [(2, c.startswith(w)), (3, near)]
        elif segment is None or all(len(x) == 1 for x in segment(w)):
            ways += [(4, self.matches_word(c, self.reading(w))), (5, near)]
        kind = F.when(F.lit(False), 0)
        for number, holds in ways:
            kind = kind.when(holds, number)
        found = words.select("word", "freq", kind.alias("kind")).where("kind is not null")
        return found.orderBy("kind", F.desc("freq"), "word").limit(1)


def _best_kind(found: DataFrame, k: int) -> DataFrame:
    """The k most frequent words of the least kind there is: the first k with that kind before the other, in one pass over the words."""
    top = found.orderBy("kind", F.desc("freq"), "word").limit(k)
    w = Window.orderBy("kind")  # over k rows
    return top.withColumn("least", F.first("kind").over(w)).where("kind = least").orderBy(F.desc("freq"), "word")


def click_line(rows: DataFrame) -> DataFrame:
    """The line of each click (app, word, rank, url, user, seconds): fields apart by `|`; a missing user is 0, a missing rank or time 0."""
    from ..functions.text import time_text

    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    user = F.when(text("user") == "", "0").otherwise(text("user"))
    return rows.select(F.concat(F.concat_ws("|", text("app"), text("word"), text("rank", "0"), text("url"), user, time_text(F.coalesce("seconds", F.lit(0)).cast("long"))), F.lit("|")).alias("line"))


def update_hot(counts: DataFrame, new: DataFrame) -> DataFrame:
    """(app, word, n) with the counts of new words added to those there; of a word that repeats in `new` the first by n counts."""
    once = new.groupBy("app", "word").agg(F.min("n").alias("n"))
    return counts.select("app", "word", "n").unionByName(once).groupBy("app", "word").agg(F.sum("n").alias("n"))


def update_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """(app, name, value) rows; new values take the place of old ones, other settings stay."""
    from .mutate import replace

    return replace(settings, new.select("app", "name", "value"), ["app", "name"])
