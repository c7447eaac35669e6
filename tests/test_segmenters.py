"""Segmenters, training and readings of characters against brute force and by rule."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import vocab

LETTERS = "абвг"


def splits(s: str) -> list[list[str]]:
    return [[s]] + [[s[:k], *rest] for k in range(1, len(s)) for rest in splits(s[k:])] if s else [[]]


@pytest.fixture(scope="module")
def made():
    r = random.Random(8)
    words = {"".join(r.choice(LETTERS) for _ in range(r.randint(1, 4))): r.randint(1, 900) for _ in range(40)}
    corpus = [["".join(r.choice(LETTERS) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 6))] + (["，"] if k % 3 else []) for k in range(200)]
    return text.Dictionary(words, corpus), corpus


def test_longest_match_from_either_side(made):
    d, _ = made
    r = random.Random(1)
    for _ in range(300):
        s = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 12)))
        assert "".join(d.forward(s)) == s == "".join(d.backward(s))
        for words, side in ((d.forward(s), 1), (d.backward(s), -1)):
            at = 0
            for w in words[::side]:
                rest = s[at:] if side == 1 else s[: len(s) - at]
                longer = [k for k in range(len(w) + 1, min(d.LONGEST, len(rest)) + 1) if (rest[:k] if side == 1 else rest[-k:]) in d.words]
                assert not longer and (len(w) == 1 or w in d.words)
                at += len(w)


def test_the_likeliest_path_is_the_best_of_all(made):
    d, _ = made
    r = random.Random(2)
    for _ in range(200):
        s = "".join(r.choice(LETTERS) for _ in range(r.randint(1, 9)))

        def allowed(path):
            at = 0
            for w in path:
                starts = [k for k in range(1, len(s) - at + 1) if s[at : at + k] in d.words]
                if not (w in d.words or len(w) == 1 and not starts):
                    return False
                at += len(w)
            return True

        weight = lambda path: sum(math.log(max(d.words.get(w, 1), 1)) - math.log(d.TOTAL) for w in path)
        best = max(weight(p) for p in splits(s) if allowed(p))
        got = d.likeliest(s)
        assert "".join(got) == s and allowed(got) and abs(weight(got) - best) < 1e-9


def test_arbitration_takes_the_likelier_of_each_stretch(made):
    d, _ = made
    r = random.Random(3)
    differ = 0
    for _ in range(400):
        s = "".join(r.choice(LETTERS) for _ in range(r.randint(1, 14)))
        a, b, got = d.forward(s), d.backward(s), d.arbitrated(s)
        assert "".join(got) == s
        if a == b:
            assert got == a
            continue
        differ += 1
        spans = lambda words: {(sum(map(len, words[:k])), w) for k, w in enumerate(words)}
        assert spans(a) & spans(b) <= spans(got) <= spans(a) | spans(b)
        if not spans(a) & spans(b):  # one stretch: the whole sentence
            assert got == (a if d._score([text.BEGIN, *a]) > d._score([text.BEGIN, *b]) else b)
    assert differ > 50


def test_sentence_ends_and_punctuation_in_training(spark, made):
    d, corpus = made
    table = spark.createDataFrame([(c,) for c in corpus] + [(None,), (["", " "],)], "words array<string>")
    rows = {(r["kind"], r["a"], r["b"]): r["n"] for r in text.training_counts(table).collect()}
    assert rows == {(k, a, b): n for k, a, b, n in d._count(corpus)}
    assert sum(n for (k, a, _), n in rows.items() if k == "pair" and a == text.BEGIN) == sum(any(w != "，" for w in c) for c in corpus)
    assert not any("，" in (a, b) for k, a, b in rows if k == "pair") and any(b == "，" for k, _, b in rows if k == "emit")
    again = text.Dictionary.trained_on(spark.createDataFrame(list(d.words.items()), "word string, freq long"), table)
    assert (again.pairs, again.emit, again.move, again.start, again.trained) == (d.pairs, d.emit, d.move, d.start, d.trained)


def test_new_words_are_the_likeliest_tags_of_all(made):
    d, _ = made
    r = random.Random(4)
    sentences = sum(d.start.values())

    def weight(path):
        tags = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in path)
        chars = "".join(path)
        emit = lambda t, c: math.log(d.emit[t, c] / d.tags[t] if (t, c) in d.emit else d.rarest)
        out = math.log((d.start.get(tags[0], 0) + 1e-6) / sentences) + sum(emit(t, c) for t, c in zip(tags, chars, strict=True))
        return out + sum(math.log((d.move.get((a, b), 0) + 1e-6) / (d.tags[a] + 1)) for a, b in zip(tags, tags[1:], strict=False))

    for _ in range(100):
        s = "".join(r.choice(LETTERS + "д") for _ in range(r.randint(2, 7)))
        got = d._tagged(s)
        assert "".join(got) == s and abs(weight(got) - max(map(weight, splits(s)))) < 1e-9
    assert d.discover(["аб", "в", "г", "x", "1"])[0] == "аб" and d.discover(["аб", "в", "г", "x", "1"])[-2:] == ["x", "1"]


def test_using_a_dictionary_does_not_grow_it(made):
    d, _ = made
    sizes = lambda: (len(d.pairs), len(d.heads), len(d.emit), len(d.move), len(d.start), len(d.tags))
    before = sizes()
    for k in range(500):
        d.arbitrated(f"а{chr(0x4E00 + k)}бв{chr(0x4F00 + k)}")
        d.discover([chr(0x4E00 + k), chr(0x5000 + k), "а"])
    assert sizes() == before


def test_presplit_and_expansion(spark):
    d = text.Dictionary({"при": 5, "ри": 3, "мер": 4, "пример": 9, "ер": 1})
    assert d.segment("ABC1 пример, мер_x9") == ["abc1", "пример", "мер", "x9"]
    assert d.expand(["пример", "ри", "abc"]) == ["ри", "ер", "при", "мер", "пример", "ри", "abc"]
    text.register_segmenter("expanded", d, "forward", expand=True)
    assert spark.createDataFrame([("пример!",), (None,)], "s string").select(text.analyze("expanded", F.col("s"))).collect()[0][0][-1] == "пример"


def test_terms_that_count(spark):
    words = spark.createDataFrame([("run",), ("мир",)], "word string")
    stop = spark.createDataFrame([("the",), ("runs",)], "word string")
    rows = spark.createDataFrame([(1, t) for t in ("running", "runs", "the", "мир", "дом", "42", "0", "7up", None)], "id int, term string")
    assert {r["term"] for r in text.valid_terms(rows, stop, words).collect()} == {"running", "мир", "42", "7up"}
    assert {r["term"] for r in text.valid_terms(rows, stop).collect()} == {"running", "мир", "дом", "42", "0", "7up", None}


@pytest.mark.parametrize(("letters", "joined", "apart"), [("jintian", "jin tian", None), ("tiananmen", "tia nan men", None), ("shanghai", "shang hai", "s hang hai"), ("zhongguo", "zhong guo", "z hong guo"), ("nx", "n x", None), ("ng", "ng", None), ("nga", "n ga", None), ("minggan", "ming gan", None), ("a", "a", None), ("lvse", "lv se", None), ("fangcao", "fang cao", None), ("angcha", "ang cha", "ang c ha"), ("", "", None)])
def test_letters_split_by_sound(letters, joined, apart):
    assert vocab.syllables_by_sound(letters) == joined.split()
    assert vocab.syllables_by_sound(letters, False) == (apart or joined).split()


def test_readings_of_a_query():
    p = vocab.Pinyin({"书": ["shu"], "乐": ["le", "yue"], "五": ["wu"], "恩": ["en"], "大": ["da"], "西": ["xi"], "安": ["an"], "先": ["xian"]})
    kinds = lambda q: [" ".join(v for _, v in x) for x in p.parses(q)]
    assert kinds("书") == ["书"] and kinds("yue") == ["yue", "yu e"] and kinds("xian") == ["xian", "xi an"]
    assert "wu en da" in kinds("wuenda") and kinds("书yl") == ["书 y l"]
    assert p.parses("sh")[0] == [("initial", "sh")] and [("initial", "s"), ("initial", "h")] in p.parses("sh")
    assert p.parses("") == [] and p.parses("a" * 40) == [] or all(len(x) <= vocab.UNITS for x in p.parses("ab" * 9))
    assert len(vocab.TWO_SYLLABLES) == 72 and all("".join(v) == k for k, v in vocab.TWO_SYLLABLES.items())


def test_matching_by_any_reading(spark):
    p = vocab.Pinyin({"音": ["yin"], "乐": ["le", "yue"], "会": ["hui", "kuai"], "快": ["kuai"], "张": ["zhang"]})
    words = p.table(spark.createDataFrame([("音乐会", 5), ("快乐", 9), ("乐", 2), ("张", 1), ("张", 4)], "word string, freq long"))
    got = lambda q, k=9: [r["word"] for r in p.suggest(words, q, k).collect()]
    assert got("yinyue") == ["音乐会"] and got("yinle") == ["音乐会"] and got("yyk") == ["音乐会"] and got("kuail") == ["快乐"]
    assert got("乐") == ["乐"] and got("z") == got("zh") == got("zhang") == ["张"] and got("快乐x") == []
    assert [r["freq"] for r in p.suggest(words, "张").collect()] == [4]
    units = words.where("word = '快乐'").select(p.matches(F.col("units"), "yue"), p.matches(F.col("units"), "yue", anywhere=True)).first()
    assert list(units) == [False, True]


def test_what_was_meant(spark):
    p = vocab.Pinyin({"春": ["chun"], "天": ["tian"], "田": ["tian"], "夏": ["xia"], "下": ["xia"]})
    words = p.table(spark.createDataFrame([("春天", 8), ("夏天", 9), ("spring", 5), ("summer", 7), ("sprint", 6)], "word string, freq long"))
    meant = lambda q, **k: next((tuple(r) for r in p.correct(words, q, **k).collect()), None)
    assert meant("春天") == ("春天", 8, 0) and meant("summer") == ("summer", 7, 0)
    assert meant("xiatian") == ("夏天", 9, 1) and meant("春tian") == ("春天", 8, 1)
    assert meant("spr") == ("sprint", 6, 2) and meant("sumer")[0] == "summer" and meant("sumer")[2] == 3
    assert meant("春田") == ("春天", 8, 4) and meant("下天") == ("夏天", 9, 4) and meant("冬天") == ("夏天", 9, 5)
    assert meant("冬天", segment=lambda s: [s]) is None and meant("zzzzz") is None
    chars = vocab.Pinyin.of(spark.createDataFrame([("乐", "yue"), ("乐", "le")], "ch string, syllable string"))
    assert chars.readings == {"乐": ("le", "yue")} and chars.reading("乐x") == "lex"


def test_words_match_without_their_units(spark):
    """The class of characters of each unit gives what the units give; the words' units are not made, and words are read once."""
    p = vocab.Pinyin({"音": ["yin"], "乐": ["le", "yue"], "会": ["hui", "kuai"], "快": ["kuai"], "张": ["zhang"], "]": ["yin"], "𠮷": ["ji"]})
    rows = spark.createDataFrame([(w, 1) for w in ("音乐会", "快乐", "乐", "张", "Yin", "y", "]乐", "𠮷乐", "", "音" * 7 + "乐", "音" * 8 + "乐", "a\n乐", None)], "word string, freq long")
    words = p.table(rows)
    for query in ("yinyue", "yyk", "乐", "z", "zh", "y", "kuail", "yin乐", "ji乐", "]", "wit", ""):
        for anywhere in (False, True):
            by = {r["word"]: (r["a"], r["b"]) for r in words.select("word", p.matches(F.col("units"), query, anywhere).alias("a"), p.matches_word(F.col("word"), query, anywhere).alias("b")).collect()}
            assert all(a == b for w, (a, b) in by.items() if w is not None) and by[None][1] is False, (query, anywhere)
    plan = p.suggest(words, "yin")._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "run(" not in plan and "Union" not in plan
