"""Licence scans: a trained classifier of paragraphs, confirmed against templates.

A paragraph is a block of lines up to a blank one, so a notice that is wrapped
over lines is one. It is read by sentences, over its lines and within them;
long ones in overlapping windows. A sparse multinomial logistic regression on
word n-grams is trained here, from notices of well-known licences (whole, cut
and with words lost), against sentences of the corpus, among them such with
words of notices strewn in, and notices whose names are of no known family.
Probabilities are calibrated by a temperature that fits wordings left out of
training; what a notice's family is not sure of is `unknown`. Every sentence
and window goes through the model. A family is reported as confirmed only if
the n-grams also lie in one of its templates. A paragraph gives each family it
holds: stretches that agree with a template go to the family that agrees best
and are classified by themselves, then come sentences and windows that hold
more.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_rows, table

NONE, UNKNOWN = "none", "unknown"
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the terms of the GNU GPL version 2 or later.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0).", "This work is in the public domain."),
    "proprietary": ("All rights reserved.", "Copyright the authors. All rights reserved.", "This document is confidential and proprietary; no part may be reproduced without prior written permission."),
}
#: Notices of no known family: what `unknown` is learned from.
OTHERS = (
    "Licensed under the terms of the Example Community License.",
    "This work is licensed under a licence agreement with the publisher.",
    "Use of this material is subject to the licence terms of the vendor.",
    "Released under the Foo Software License, version 1.",
    "Distributed under the terms of the Universal Source License.",
    "See the file COPYING for the terms of this license.",
)
#: Plain sentences that share words with notices.
PLAIN = (
    "Please read the course notes from MIT before class.",
    "All rights of the guests are reserved by the hotel under its own conditions.",
    "All rights and duties were reserved by the council for the people of the town.",
    "The apache helicopter landed under the terms of the agreement.",
    "Creative work in common rooms is free for the public, and attribution is to the author.",
    "A fishing license is required; see the office in the main square for the terms.",
    "The library is available to the general public without warranty of a seat.",
    "Permission from the owner was granted in writing to copy the notice on the door.",
    "Copies of the source were distributed to all members without modification.",
    "The new version of the software is free of charge for any person who has a license to drive.",
    "The driver must show a valid license to the officer before leaving.",
    "He was granted permission to use the road in any version of the plan.",
    "The general public was free to copy the software and the documents.",
    "This work is available in all rooms, and conditions of the source are good.",
    "Rights of the people were reserved for a later version of the law.",
)
#: What families are called, and how notices speak of a licence by its name.
NAMED: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT license (MIT)", "Expat (MIT) license", "MIT Licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache License v2.0", "Apache-2.0 license"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License", "GNU GPL version 2 or later", "GPL v3", "GNU General Public License v2.0", "GPLv3 license"),
    "LGPL": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU LGPL version 2.1", "LGPL v3", "GNU Lesser General Public License v2.1"),
    "AGPL": ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0 license", "GNU Affero General Public License v3"),
    "BSD": ("3-clause BSD License", "BSD 3-Clause License", "BSD license", "2-clause BSD license", "BSD 2-Clause License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, v. 2.0"),
    "ISC": ("ISC License", "ISC license (ISC)", "ISC Licence"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License", "CC BY 4.0", "Creative Commons Attribution License", "CC BY 3.0 license"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 3.0 license"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC 3.0 license"),
}
LEADS = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the {}.", "Distributed under the terms of the {}.",
    "This * is licensed under the {}.", "This * is licensed under {}.", "This * is released under the {}.", "This * is distributed under the {}; see the file LICENSE.",
    "This * is free software; you can redistribute it under the terms of the {}.", "This * and the accompanying materials are made available under the terms of the {}.",
    "Use of this * is subject to the {}.", "This * is subject to the terms of the {}.", "This * is covered by the {}.", "The * is available under {}.", "The * on this site is licensed under a {}.",
    "All * is under the {} unless stated otherwise.", "Except where noted, the * is available under the {}.", "* released under the {}.", "* licensed under {}.", "License: {}.", "The * is published under a {}.",
    "You may use this * under the {}.", "Permission to use this * is granted under the {}.",
)
THINGS = "software project library package file work program code document text page article dataset content photo repository site material".split()
#: How the public domain and reserved rights are spoken of.
SAYINGS: dict[str, tuple[str, ...]] = {
    "public-domain": ("This * is in the public domain.", "The author has placed this * in the public domain.", "This * has been released into the public domain.", "Dedicated to the public domain under CC0 1.0.", "This * is dedicated to the public domain.", "The * is public domain and may be used freely.", "This * is free of known copyright and in the public domain.", "Released into the public domain by its author."),
    "proprietary": ("Copyright 2020 name. All rights reserved.", "All rights reserved worldwide.", "No part of this * may be reproduced without written permission.", "No part of this * may be reproduced in any form without the prior written permission of the publisher.", "This * is proprietary and confidential.", "Unauthorized copying of this * is strictly prohibited.", "This * is confidential and may not be disclosed.", "(c) 2019 name. All rights reserved. Proprietary and confidential."),
}
#: Words that names of no family are made of.
STRANGE = "Acme Foo Eclipse Boost Zope Example Northwind Public Community Software Open Source European Union Common Artistic Python Academic Free End User".split()
#: Words that name families: without them a notice is of none.
NAMES = frozenset("mit apache gnu gpl lgpl agpl lesser affero bsd bsd-style mozilla mpl isc cc creative commons attribution sharealike attribution-sharealike noncommercial attribution-noncommercial by by-sa by-nc unlicense cc0".split())
#: Documents whose sentences are negatives at most (those with the least hashes), and sentences of them.
NEGATIVE_DOCS, NEGATIVES = 400, 1500
COPIES, ROUNDS, RATE, DECAY = 24, 150, 2.0, 1e-4
#: Parts that ways of speaking are left out in to fit the temperature, each in turn.
FOLDS = 3
#: Words of a window and between starts of windows.
WINDOW, STRIDE = 24, 12
#: Least probability of a family, and least share of a sentence's or template's n-grams in common.
SURE, CONFIRM = 0.6, 0.6
#: A stretch of fewer words than this has to be all of its sentence but two words, unless it is a tag.
SHORT, TAG = 5, "spdx-license-identifier"
#: Different words of a notice that no template confirms, at least.
LEAST = 4
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_BLOCK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(w: list[str]) -> set:
    return {*w, *zip(w, w[1:], strict=False), *zip(w, w[1:], w[2:], strict=False)}


def windows(w: list[str]) -> list[list[str]]:
    return [w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW + STRIDE, STRIDE)]


def paragraphs(text: str | None) -> list[list[tuple[list[str], list[list[str]]]]]:
    """Of each paragraph with a word its sentences: words of the whole, and of its parts by line if it runs over several."""
    out = []
    for block in _BLOCK.split(text or ""):
        whole: list[tuple[list[str], list[list[str]]]] = []
        open_parts: list[list[str]] = []
        for line in block.split("\n"):
            pieces = _SENTENCE.split(line.strip())
            for k, piece in enumerate(pieces):
                w = words(piece)
                if w:
                    open_parts.append(w)
                ended = k < len(pieces) - 1 or piece.endswith((".", "!", "?", ";"))
                if ended and open_parts:
                    whole.append(([x for part in open_parts for x in part], open_parts if len(open_parts) > 1 else []))
                    open_parts = []
        if open_parts:
            whole.append(([x for part in open_parts for x in part], open_parts if len(open_parts) > 1 else []))
        if whole:
            out.append(whole)
    return out


class Model:
    """Weights of n-grams by class, a temperature, and the templates' n-grams."""

    def __init__(self, negatives: list[str]):
        self.classes = [NONE, UNKNOWN, *sorted(TEMPLATES)]
        forms = {k: [words(t) for t in v] + [words(x.replace("*", "work").replace("name", "")) for x in SAYINGS.get(k, ())] for k, v in TEMPLATES.items()}
        self.templates = {k: [grams(w) for w in v] for k, v in forms.items()}
        self.names = {k: [f" {' '.join(words(x))} " for x in v] for k, v in (NAMED | {"public-domain": ("public domain", "CC0 1.0")}).items()}
        self.lengths = {k: [len(w) for w in v] for k, v in forms.items()}
        plain = [w for x in negatives for s in paragraphs(x) for whole, _ in s for w in windows(whole)]
        samples = self._samples(plain)
        known: dict = {}
        for kind, w, _ in samples:
            if kind:
                for g in grams(w):
                    known[g] = known.get(g, 0) + 1
        for x in PLAIN:
            known |= {g: 3 for g in grams(words(x)) if isinstance(g, str)}
        self.index = {g: i for i, g in enumerate(sorted((g for g, n in known.items() if n > 2 and not str(g).count("name0")), key=repr))}
        #: The share of words that no notice has is the last feature.
        self.size = len(self.index) + 1
        y = np.array([k for k, _, _ in samples])
        part = np.array([key for _, _, key in samples])
        rows = [self._features(w) for _, w, _ in samples]
        left_out = []
        for f in range(FOLDS):
            self._train([r for r, p in zip(rows, part, strict=True) if p != f], y[part != f])
            z = np.stack([self.w[i].T @ v + self.b for i, v in (r for r, p in zip(rows, part, strict=True) if p == f)])
            left_out.append((z, y[part == f]))
        z, right = np.concatenate([z for z, _ in left_out]), np.concatenate([k for _, k in left_out])
        #: How often the class is right, over ways of speaking left out of training, and the temperature that makes probabilities say so.
        self.accuracy = float((z.argmax(axis=1) == right).mean())
        loss = lambda t: -np.log(self._soft(z / t)[np.arange(len(z)), right] + 1e-12).mean()
        self.temperature = min((float(t) for t in np.geomspace(0.05, 4, 80)), key=loss)
        self._train(rows, y)

    def _samples(self, plain: list[list[str]]) -> list[tuple[int, list[str], int]]:
        """(class, words, fold): wordings of notices, whole and altered, the same under other names, and plain sentences.

        A way of speaking (a lead, a saying) is in one fold; templates are in none (-1).
        """
        rng = np.random.default_rng(7)
        pick = lambda x: x[int(rng.integers(len(x)))]
        odd = lambda: f"name0{int(rng.integers(10**6))}"
        say = lambda form: words(form.replace("*", pick(THINGS)))
        strange = lambda: " ".join([*(pick(STRANGE) for _ in range(int(rng.integers(1, 4)))), pick(("License", "Licence", "license agreement", "Public License"))]) + pick(("", ", version 1.2", " v2.0", " 1.0", ", Version 3.0"))
        made: list[tuple[int, list[str], int]] = []
        for number, lead in enumerate(LEADS):
            fold = number % FOLDS
            for family, names in NAMED.items():
                made += [(self.classes.index(family), say(lead.format(name)), fold) for name in names]
            made += [(1, say(lead.format(strange())), fold) for _ in range(16)]
        for family, sayings in SAYINGS.items():
            made += [(self.classes.index(family), say(x), k % FOLDS) for k, x in enumerate(sayings) for _ in range(6)]
        for k, texts in [(1, OTHERS), *((self.classes.index(n), t) for n, t in TEMPLATES.items())]:
            for text in texts:
                whole = words(text)
                made += [(k, whole, -1)] * 4
                for copy in range(COPIES):
                    cut, kind = whole, k
                    if len(whole) > 14 and rng.random() < 0.6:
                        a = int(rng.integers(0, len(whole) - 12))
                        cut = whole[a : a + int(rng.integers(12, len(whole) - a + 1))]
                    if copy % 4 == 3 and any(x in NAMES for x in cut) and len(cut) > SHORT:  # names of no family
                        kind, name = 1, odd()
                        cut = [name if x in NAMES else x for x in cut]
                    made.append((kind, cut, -1))
        strewn = [w for k, t, _ in made if k for w in t]
        out = list(made)
        for k, w, fold in made:  # with words lost, and beside plain ones
            cut = [x for x in w if rng.random() > 0.06] or w
            if plain and rng.random() < 0.4:
                other = pick(plain)[: int(rng.integers(0, 8))]
                cut = other + cut if rng.random() < 0.5 else cut + other
            out.append((k, cut, fold))
        plain = plain + [words(x) for x in PLAIN] * 12
        out += [(0, w, k % FOLDS) for k, w in enumerate(plain)]
        for k in range(len(plain) // 2 + 300):  # a notice's words in plain sentences
            w = list(pick(plain))
            for _ in range(int(rng.integers(1, 4))):
                at, i = int(rng.integers(len(w) + 1)), int(rng.integers(len(strewn)))
                w[at:at] = strewn[i : i + int(rng.integers(1, 3))]
            out.append((0, w, k % FOLDS))
        single = sorted(set(strewn) - {TAG}) + sorted(NAMES) * 4
        for k in range(3 * len(single)):  # a few words, some of them of notices, are none
            at = int(rng.integers(1000))
            w = [*(pick(plain)[at % 7 : at % 7 + int(rng.integers(0, 6))] if plain else []), single[k % len(single)], *([pick(single)] if rng.random() < 0.3 else [])]
            out.append((0, [w[i] for i in rng.permutation(len(w))], k % FOLDS))
        return out

    def _train(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """Weighted multinomial regression over sparse rows, by gradient with momentum."""
        n = len(self.classes)
        ids, values = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float32)[:, None]
        row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        starts = np.cumsum([0, *(len(i) for i, _ in rows)])[:-1]
        order = np.argsort(ids, kind="stable")
        used, first = np.unique(ids[order], return_index=True)
        target = np.eye(n, dtype=np.float32)[y]
        weight = (1 / np.maximum(1, np.bincount(y, minlength=n))[y]).astype(np.float32)
        weight = np.where(y == 0, 4 * weight, weight)
        weight = (weight / weight.sum())[:, None]
        self.w, self.b = np.zeros((self.size, n), dtype=np.float32), np.zeros(n, dtype=np.float32)
        speed = np.zeros_like(self.w)
        for _ in range(ROUNDS):
            z = np.add.reduceat(self.w[ids] * values, starts, axis=0) + self.b
            error = (self._soft(z) - target) * weight
            speed = 0.9 * speed + DECAY * self.w
            speed[used] += np.add.reduceat((error[row] * values)[order], first, axis=0)
            self.w -= RATE * speed
            self.b -= RATE * error.sum(axis=0)

    @staticmethod
    def _scale(w: list[str]) -> float:
        """One over the root of how many n-grams there are, known or not; a few words say little."""
        return max(9, 3 * len(w) - 3) ** -0.5

    def _features(self, w: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self._ids(w)
        return np.array([*ids, self.size - 1]), np.array([*[self._scale(w)] * len(ids), 1 - n / max(1, len(w))])

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _ids(self, w: list[str]) -> tuple[list[int], int]:
        """The known n-grams of a sentence, as often as they occur, and how many words are known."""
        get, out, n = self.index.get, [], 0
        one = two = None  # the words before, as far as they are known
        for x in w:
            i = get(x)
            if i is None:
                one = two = None
                continue
            n += 1
            out.append(i)
            if one is not None:
                i = get((one, x))
                if i is not None:
                    out.append(i)
                if two is not None:
                    i = get((two, one, x))
                    if i is not None:
                        out.append(i)
            two, one = one, x
        return out, n

    def probabilities(self, many: list[list[str]]) -> np.ndarray:
        """Calibrated probabilities of the classes, a row for each list of words."""
        z = np.tile(self.b, (len(many), 1))
        flat, ends, scale = [], [0], []
        for k, w in enumerate(many):
            ids, n = self._ids(w)
            z[k] += self.w[-1] * (1 - n / max(1, len(w)))
            flat += ids
            ends.append(len(flat))
            scale.append(self._scale(w))
        if flat:
            total = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(self.w[flat], axis=0, dtype=np.float64)])
            z = z + (total[ends[1:]] - total[ends[:-1]]) * np.array(scale)[:, None]
        return self._soft(z / self.temperature)

    def classes_of(self, many: list[list[str]]) -> list[tuple[str, float]]:
        if not many:
            return []
        p = self.probabilities(many)
        best = p.argmax(axis=1)
        return [(self.classes[k] if x >= SURE or not k else UNKNOWN if 1 - y >= SURE else NONE, float(x)) for k, x, y in zip(best.tolist(), p[np.arange(len(p)), best].tolist(), p[:, 0].tolist(), strict=True)]

    def classify(self, w: list[str]) -> tuple[str, float]:
        """Class and calibrated probability of a sentence or window."""
        return self.classes_of([w])[0]

    def confirmed(self, family: str, w: list[str]) -> bool:
        """Whether a name of the family is here, a template holds most of the n-grams, or most of a template is here and is half of what is here."""
        own, said = grams(w), f" {' '.join(w)} "
        enough = len(set(w)) >= LEAST  # of fewer words most of a template is asked for as well
        for t in self.templates.get(family, ()):
            n = len(own & t)
            if n >= CONFIRM * len(own) and (enough or n >= CONFIRM * len(t)) or n >= CONFIRM * len(t) and 2 * n >= len(own):
                return True
        return any(x in said for x in self.names.get(family, ()))

    def stretches(self, w: list[str]) -> list[tuple[str, float, int, int]]:
        """Family, probability, start and stop of stretches, apart, that hold most of a template; the best agreement goes first."""
        own, found = grams(w), []
        orders = [w, list(zip(w, w[1:], strict=False)), list(zip(w, w[1:], w[2:], strict=False))]
        for family, templates in self.templates.items():
            for t, n in zip(templates, self.lengths[family], strict=True):
                if n > len(w) or len(own & t) < CONFIRM * len(t) or n < SHORT and len(w) > n + 2 and TAG not in t:
                    continue
                share = np.zeros(len(w) - n + 1)
                for k, order in enumerate(orders):
                    if n > k:
                        total = np.cumsum([0, *(g in t for g in order)])
                        share += total[n - k :] - total[: len(total) - n + k]
                share /= sum(max(0, n - k) for k in range(len(orders)))
                found += [(float(share[i]), n, family, int(i)) for i in np.flatnonzero(share >= CONFIRM)]
        taken, out = np.zeros(len(w), dtype=bool), []
        for _, n, family, i in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if not taken[i : i + n].any():
                name, p = self.classify(w[i : i + n])
                if name == family:
                    taken[i : i + n] = True
                    out.append((family, p, i, i + n))
        return out

    def notices(self, w: list[str]) -> list[tuple[str, float, bool]]:
        """Family, probability and confirmation of the notices of a sentence, each family once.

        Neighbouring windows of a class but none make a run. A window's
        confirmed class counts if it still holds without the words that went
        to other families; a run without a confirmed family is `unknown`.
        """
        runs: list[list[tuple[int, int, str, float]]] = []
        parts = windows(w)
        for k, (part, (name, p)) in enumerate(zip(parts, self.classes_of(parts), strict=True)):
            if name != NONE:
                if not runs or runs[-1][-1][0] != (k - 1) * STRIDE:
                    runs.append([])
                runs[-1].append((k * STRIDE, k * STRIDE + len(part), name, p))
        best: dict[tuple[str, bool], float] = {}
        for run in runs:
            base = run[0][0]
            got = self.stretches(w[base : run[-1][1]])
            owner: list[str | None] = [None] * (run[-1][1] - base)
            for family, _, a, b in got:
                owner[a:b] = [family] * (b - a)
            for a, b, name, p in sorted(run, key=lambda x: -x[3]):
                if self.confirmed(name, w[a:b]):
                    free = [x is None or x == name for x in owner[a - base : b - base]]
                    if all(free) or any(self.classify(x)[0] == name and self.confirmed(name, x) for x in _pieces(w[a:b], free)):
                        owner[a - base : b - base] = [name if f else x for f, x in zip(free, owner[a - base : b - base], strict=True)]
                        got.append((name, p, a, b))
            rest = [(UNKNOWN, max(x[3] for x in run), False)] if len(set(w[base : run[-1][1]])) >= LEAST else []
            for name, p, sure in [(x[0], x[1], True) for x in got] or rest:
                best[name, sure] = max(p, best.get((name, sure), 0.0))
        return sorted(((name, p, sure) for (name, sure), p in best.items()), key=lambda x: (not x[2], -x[1], x[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float, bool]]]:
        """Number of paragraphs, and number of paragraph, family, probability, confirmation of its notices.

        A sentence over several lines counts as a whole where that is
        confirmed; else its lines do where they are; else it may be unknown.
        """
        read = paragraphs(text)
        units = [w for sentences in read for whole, lines in sentences for w in (whole, *lines)]
        parts = [windows(w) for w in units]
        names = iter(self.classes_of([x for p in parts for x in p]))
        some = iter([any([next(names)[0] != NONE for _ in p]) for p in parts])
        out = []
        for number, sentences in enumerate(read):
            best: dict[tuple[str, bool], float] = {}
            for whole, lines in sentences:
                found = self.notices(whole) if next(some) else []
                by_line = [x for line in lines if next(some) for x in self.notices(line) if x[2]]
                for name, p, sure in by_line if by_line and not any(x[2] for x in found) else found:
                    best[name, sure] = max(p, best.get((name, sure), 0.0))
            out += [(number, name, p, sure) for (name, sure), p in sorted(best.items(), key=lambda x: (not x[0][1], -x[1], x[0][0]))]
        return len(read), out


def _pieces(w: list[str], free: list[bool]) -> list[list[str]]:
    """The stretches of `w` whose words are free."""
    cuts = [-1, *(i for i, f in enumerate(free) if not f), len(w)]
    return [w[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1]


def fit(docs: DataFrame, rows: int = NEGATIVE_DOCS) -> Model:
    """Trains on the templates and on sentences of at most `rows` documents, those with the least hashes.

    Sentences that hold a notice's words are left out of these.
    """
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).distinct().orderBy("h").limit(rows).select(F.col("doc_id").alias("w_id"))
    texts = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("w_id"), "left_semi").select(F.explode(F.split("text", "\n")).alias("line"), F.xxhash64("doc_id", F.col("text")).alias("h"))
    lines = [r[0] for r in texts.where(F.length("line") > 0).select("line", "h").orderBy("h", "line").limit(NEGATIVES).collect()]
    notice = re.compile(r"licen[sc]|copyright|rights reserved|public domain|creative commons|spdx", re.I)
    return Model([x for x in lines if not notice.search(x)])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Licence notices in every paragraph of whole texts.

    Returns doc_id, n_paragraphs, n_licensed (paragraphs with a notice),
    licences (distinct families, sorted; `unknown` among them), notices (array
    of paragraph, licence, probability, confirmed; each family of a paragraph
    once: confirmed ones first, then by probability, by name at a tie). A
    family that no template confirms is given as `unknown`. A null text has no
    paragraph. Repeated rows each get a row; other columns are ignored. No
    shuffle.
    """

    def make():
        def work(c):
            out = {k: [] for k in ("n_paragraphs", "n_licensed", "licences", "notices")}
            for text in c["text"]:
                n, found = model.scan(text)
                out["n_paragraphs"].append(n)
                out["n_licensed"].append(len({x[0] for x in found}))
                out["licences"].append(sorted({x[1] for x in found}))
                out["notices"].append([{"paragraph": k, "licence": name, "probability": round(p, 6), "confirmed": sure} for k, name, p, sure in found])
            return {"doc_id": c["doc_id"]} | out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_paragraphs long, n_licensed long, licences array<string>, notices array<struct<paragraph:int,licence:string,probability:double,confirmed:boolean>>")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every paragraph of `documents`."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
