"""Small tables with what is awkward, and slow plain versions of what operators do."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, kept string, h long, d1 long, part int, before string, language string"
_random = random.Random(5)
VOCAB = ["".join(_random.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(_random.randint(1, 9))) for _ in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCAB)
    return " ".join(w)


def doc_rows(null_ids: bool = False) -> list[tuple]:
    """Texts that are null, empty, blank, short, very long, equal, nearly equal, equal but for case; null fields; repeated rows."""
    base, long = prose(1, 120), prose(2, 30_000)
    texts = [None, "", "  \t\n", "a", "A", "one two", "One TWO", "12 34 --", base, base, base.upper(), *[edited(base, k, 2) for k in range(12)], *[edited(base, 50 + k, 30) for k in range(4)], long, long, edited(long, 9, 40), prose(3, 60), "é" * 5000, "x" * 40_000, "naïve words   and\x1cmore\x0bhere ÄÖ", "line one is here\n" * 30, base + "\n" + base]
    texts += [prose(100 + k, 80) for k in range(20)]
    out = [(k * 7 % 101, t, ["en", "fr", None][k % 3], ["s1", "s2", None, "s1", "s1"][k % 5], None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[8], out[8], out[0]]
    out += [(None, base, "en", "s1", 1), (None, None, None, None, None), (None, prose(77, 70), "fr", "s9", 1)] if null_ids else []
    return [(*r, 1, "k", "s", "k", 2, 3, 4, "b", "l") for r in out]


def lower(text: str | None) -> str:
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text: str | None, n: int) -> frozenset:
    w = WORDS.findall(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(rows: list[tuple[int, str | None]], n: int, num: int, den: int) -> dict[int, int]:
    """doc_id to the least doc_id of its component, by comparing all pairs of sets."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and den * both >= num * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i, _ in sets}


def base_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def repeats(rows: list[tuple[int, str | None]], least: int) -> dict[int, set[int]]:
    """Of each document, the words that lie in a passage of `least` words found at two places."""
    at, words = defaultdict(list), {}
    for key, text in rows:
        words[key] = WORDS.findall(lower(text))
        for i in range(len(words[key]) - least + 1):
            at[tuple(words[key][i : i + least])].append((key, i))
    out: dict[int, set[int]] = {key: set() for key in words}
    for places in at.values():
        if len(places) > 1:
            for key, i in places:
                out[key] |= set(range(i, i + least))
    return out


def near_components_by_gram(rows: list[tuple[int, str | None]], n: int, num: int, den: int) -> dict[int, int]:
    """As near_components, over pairs that share a shingle only (others have no link)."""
    sets = {i: shingles(t, n) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common: Counter = Counter()
    for found in where.values():
        for k, i in enumerate(found):
            for j in found[:k]:
                common[i, j] += 1
    up = {i: i for i in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), both in common.items():
        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return {i: find(i) for i in up}


def plain_grams(text: str | None) -> Counter:
    """n-grams of 1 to 3 characters of words of letters, a blank on either side of a word; a lone blank is none."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out: Counter = Counter()
    for w in words:
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def _ranked(found: Counter, size: int) -> list[str]:
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0].ljust(3, "\0")))[:size]]


def plain_profiles(rows, size: int) -> list[tuple[str, list[str]]]:
    by: dict[str, Counter] = defaultdict(Counter)
    for key, text, lang in rows:
        if text is not None and lang is not None and (key is None or zlib.crc32(str(key).encode()) % 4 != 2):
            by[lang] += plain_grams(text)
    return [(lang, _ranked(by[lang], size)) for lang in sorted(by)]


def plain_language(text: str | None, profiles, size: int) -> tuple[str, float]:
    own = _ranked(plain_grams(text), size)
    if not own:
        return "und", 0.0
    best = None
    for lang, profile in profiles:
        place = {g: k for k, g in enumerate(profile)}
        far = sum(abs(place[g] - k) if g in place else size for k, g in enumerate(own))
        if best is None or far < best[0]:
            best = (far, lang)
    return best[1], round(1 - best[0] / (size * len(own)), 9)


#: Notices and plain sentences in words of our own, none of them used in training.
NOTICES = (
    ("MIT", "This package is distributed under the MIT license; see the file LICENSE for the details."),
    ("MIT", "The code in this repository is MIT licensed."),
    ("MIT", "Licensed under the MIT License (MIT)."),
    ("Apache-2.0", "Code released under the Apache License 2.0."),
    ("Apache-2.0", "This software is licensed under the Apache License, version 2 (\"ALv2\")."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" basis; licensed under the Apache License 2.0."),
    ("GPL", "This file is part of a program distributed under the GNU General Public License, version 2 only."),
    ("GPL", "It is free software under the terms of the GNU General Public License version 3 or later."),
    ("GPL", "Licensed under the GPL v3 (GNU General Public License)."),
    ("LGPL", "This library is distributed under the terms of the GNU Lesser General Public License, version 3 or later."),
    ("LGPL", "Released under the GNU Lesser General Public License."),
    ("AGPL", "Licensed under the GNU Affero General Public License v3."),
    ("AGPL", "This server is free software under the GNU Affero General Public License, version 3 or later."),
    ("BSD", "This project is licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution in source and binary forms, with or without modification, is permitted provided that the conditions below are met:"),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Covered code is available under the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "This program is licensed under the ISC License."),
    ("CC-BY", "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Content on this site is licensed under CC BY 4.0."),
    ("CC-BY-SA", "Except where noted, text is under the Creative Commons Attribution-ShareAlike 4.0 License."),
    ("CC-BY-SA", "This page is available under CC BY-SA 4.0."),
    ("CC-BY-NC", "This photo is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."),
    ("CC-BY-NC", "The dataset is released under CC BY-NC 4.0."),
    ("public-domain", "The author has released this work into the public domain."),
    ("public-domain", "This text is in the public domain in the United States."),
    ("proprietary", "Copyright 2019 Example Corp. All rights reserved."),
    ("proprietary", "No part of this document may be reproduced without the prior written permission of the company."),
    ("unknown", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0."),
    ("unknown", "Licensed under the European Union Public Licence, version 1.2."),
    ("unknown", "Distributed under the Boost Software License, Version 1.0."),
    ("unknown", "Use of this software is subject to the terms of the Acme End User License Agreement."),
    ("unknown", "Released under the Zope Public License, version 2.1."),
    ("none", "All rights reserved by the hotel guests."),
    ("none", "Please read the MIT course notes before class."),
    ("none", "A driver must carry a license at all times."),
    ("none", "The commons were free to all, and the creative people of the town met there."),
    ("none", "The public library opens at nine and closes at five."),
    ("none", "He took a general view of the terms and signed the agreement."),
    ("none", "She was granted permission to leave the room."),
    ("none", "The museum reserves the right to change its opening hours without notice."),
    ("none", "The software crashed twice before the new version was published."),
    ("none", "The fishing licence has to be renewed every year at the town hall."),
    ("none", "An attribution of the painting to the younger brother is not certain."),
    ("MIT", "Published under a MIT licence."),
    ("Apache-2.0", "Everything here is Apache-2.0 licensed unless a file says otherwise."),
    ("GPL", "You can redistribute this plugin under the GNU GPL v2."),
    ("BSD", "The library comes with a 2-clause BSD license."),
    ("CC-BY", "Figures may be reused under CC BY 4.0."),
    ("unknown", "This module is made available under the Artistic License 2.0."),
    ("unknown", "Licensed under the Northwind Community Licence, version 3."),
    ("none", "The use of the hall is subject to a small fee."),
    ("none", "They distributed the leaflets under the bridge."),
    ("none", "Version 2.0 of the plan was released in spring."),
    ("none", "The terms of the contract were discussed in general."),
    ("none", "Nobody may copy from another pupil during the test."),
)
