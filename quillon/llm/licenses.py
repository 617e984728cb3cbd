"""License scan: a trained classifier names the family of licenses, templates confirm it and tell its licenses apart."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table

# Per license its SPDX identifier, its family, and the titles it is named by.
LICENSES = """
GPL-1.0 | gnu | GNU General Public License version 1; GNU GPL version 1; GPL version 1
GPL-2.0 | gnu | GNU General Public License version 2; GNU GPL version 2; GPL version 2
GPL-3.0 | gnu | GNU General Public License version 3; GNU GPL version 3; GPL version 3
LGPL-2.0 | gnu | GNU Library General Public License version 2; LGPL version 2
LGPL-2.1 | gnu | GNU Lesser General Public License version 2.1; LGPL version 2.1
LGPL-3.0 | gnu | GNU Lesser General Public License version 3; LGPL version 3
AGPL-3.0 | gnu | GNU Affero General Public License version 3; AGPL version 3
GFDL-1.2 | gnu | GNU Free Documentation License version 1.2; GFDL version 1.2
GFDL-1.3 | gnu | GNU Free Documentation License version 1.3; GFDL version 1.3
CC0-1.0 | cc0 | CC0 1.0 Universal; CC0 1.0; Creative Commons Zero 1.0 Universal
Apache-1.1 | apache | Apache Software License version 1.1; Apache License version 1.1; Apache 1.1
Apache-2.0 | apache | Apache License version 2.0; Apache 2.0; Apache Software License version 2.0
MIT | mit | MIT License; MIT Licence
MIT-0 | mit | MIT No Attribution License; MIT No Attribution
0BSD | bsd | BSD Zero Clause License; Zero-Clause BSD License; 0BSD License
BSD-2-Clause | bsd | BSD 2-Clause License; 2-Clause BSD License; Simplified BSD License
BSD-3-Clause | bsd | BSD 3-Clause License; 3-Clause BSD License; Modified BSD License
BSD-4-Clause | bsd | BSD 4-Clause License; 4-Clause BSD License; Original BSD License
ISC | isc | ISC License; ISC Licence
MPL-1.1 | mozilla | Mozilla Public License version 1.1; MPL version 1.1
MPL-2.0 | mozilla | Mozilla Public License version 2.0; MPL version 2.0
EPL-1.0 | eclipse | Eclipse Public License version 1.0; EPL version 1.0
EPL-2.0 | eclipse | Eclipse Public License version 2.0; EPL version 2.0
CDDL-1.0 | cddl | Common Development and Distribution License version 1.0; CDDL version 1.0
CDDL-1.1 | cddl | Common Development and Distribution License version 1.1; CDDL version 1.1
EUPL-1.1 | eupl | European Union Public Licence version 1.1; EUPL version 1.1
EUPL-1.2 | eupl | European Union Public Licence version 1.2; EUPL version 1.2
Artistic-1.0 | artistic | Artistic License 1.0
Artistic-2.0 | artistic | Artistic License 2.0
BSL-1.0 | boost | Boost Software License version 1.0
Zlib | zlib | zlib License; zlib/libpng License
Unlicense | unlicense | Unlicense; The Unlicense
WTFPL | wtfpl | Do What The Fuck You Want To Public License; WTFPL version 2
OFL-1.1 | ofl | SIL Open Font License version 1.1; OFL version 1.1
PSF-2.0 | psf | Python Software Foundation License version 2
PostgreSQL | postgresql | PostgreSQL License
ODbL-1.0 | opendata | Open Database License 1.0; ODbL 1.0
ODC-By-1.0 | opendata | Open Data Commons Attribution License 1.0
BUSL-1.1 | busl | Business Source License 1.1
SSPL-1.0 | sspl | Server Side Public License version 1
Elastic-2.0 | elastic | Elastic License 2.0
"""
# The elements and versions that Creative Commons licenses combine.
CC_ELEMENTS, CC_VERSIONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")
# Sentences that only one license has, the words by which they are known, and words after which it is another's.
BODIES = [
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu 2", ""),
    ("GPL-2.0", "the GNU General Public License version 2 as published by the Free Software Foundation", "gnu 2", ""),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu 3", ""),
    ("LGPL-2.0", "it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu library 2", ""),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "gnu lesser 2.1", ""),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu lesser 3", ""),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu affero 3", ""),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "gnu documentation 1.3", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache 2", ""),
    ("MIT", "to permit persons to whom the Software is furnished to do so, subject to the following conditions", "furnished subject", "acknowledgements"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "substantial permission", "acknowledgements"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither endorse", "acknowledgement advertising"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by", "advertising acknowledgement", ""),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee hereby", "provided"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee provided", "both"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0", "mozilla 2", "1.1"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License", "mozilla 1.1", ""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "eclipse 2", ""),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "eclipse 1", ""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived neighboring", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "held arising", ""),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization accompanying", ""),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "sil 1.1", ""),
]
# Sentences that grant none of the licenses above, some from other licenses and agreements.
OTHERS = [
    "The driver must hold a valid license.", "A fishing license is required in this county.", "The bar lost its license last year.", "All rights reserved.",
    "Copyright law protects creative works.", "The city permitted the use of the public park.", "The software is distributed in many countries.",
    "The general public may visit the museum.", "He worked at the free university.", "The version 2.0 of the plan was published.", "Apache helicopters flew over the base.",
    "She studied at MIT and published her work.", "The license plate was stolen.", "This program is on at eight.", "Permission was granted by the office.", "See the terms and conditions.",
    "Licensed under the Academic Free License version 3.0.", "Licensed under the Open Software License version 3.0.", "Released under the Educational Community License, Version 2.0.",
    "This work is licensed under the LaTeX Project Public License version 1.3c.", "Distributed under the Vim License.", "Released under the Beerware License.",
    "This Agreement is governed by the laws of the State of California.", "You may not copy, modify or distribute the Software except as permitted by this Agreement.",
    "The Licensee shall not sublicense the Licensed Material to any third party.", "Use of this site is subject to the Terms of Service.", "This software is proprietary and confidential.",
    "Licensed under the Oracle Technology Network Developer License.", "Licensed under the Microsoft Reciprocal License.", "The contents are licensed under the IBM Public License version 1.0.",
    "SPDX-License-Identifier: AFL-3.0", "SPDX-License-Identifier: LicenseRef-Proprietary", "SPDX-License-Identifier: MS-PL", "Open Government Licence v3.0", "Licensed under the Sleepycat License.",
    "The museum in the Creative Commons building opens at four.", "Eclipse chasers met on the hill in version 2 of their tour.", "The Mozilla office moved to a new street.",
    "permission to link or combine any covered work with a work licensed under version 3 of the GNU Affero General Public License into a single combined work",
    "the GNU General Public License is a free, copyleft license for software and other kinds of works", "Everyone is permitted to copy and distribute verbatim copies of this license document",
]
# How a grant names a license; {} stands for the title.
FRAMES = [
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.", "Available under the {}.",
    "The code in this repository is covered by the {}.", "License: {}", "{}", "Copyright (c) 2020 the authors, published under the {}, see the file LICENSE.", "Its use is subject to the {}.",
    "You may use it under the terms of the {}.", "This file is part of the project, which is made available under {}.",
]
# Words that name no license by themselves, words before a title that make it no grant, and ends of a cue.
GLUE = frozenset("the a an of and or for in to do you what want it its this license licence version v public general free software creative universal international union no".split())
DENIALS = frozenset("not unlike except formerly previously incompatible compatible replaces than instead".split())
CUES = frozenset("under by to identifier license licence of".split())
UNKNOWN = "unknown"
#: Documents whose paragraphs teach what is no license, at most (those with the least hashes of their ids), and their paragraphs' characters.
FIT_DOCUMENTS, FIT_CHARACTERS = 500, 600
#: Words on both sides of a window that the classifier sees too: the family must be its choice in one view, and in the wider
#: one it must not say unknown.
AROUND, NEARBY = 12, 2
SEED = 11
_forms = [
    (re.compile(p), r)
    for p, r in (
        (r"(?:https?://)?creativecommons\.org/licenses", "cc"), (r"creative\s*commons", "cc"), (r"share[\s-]?alike", "sa"), (r"non[\s-]?commercial", "nc"),
        (r"no[\s-]?deriv(?:ative)?s?(?:\s+works?)?", "nd"), (r"\battribution\b", "by"), (r"\bcc\s?0\b", "cczero"), (r"\bcc\s+zero\b", "cczero"), (r"licence", "license"), (r"(?<=[a-z])v(?=\d)", " "),
        (r"\bv(?:er(?:sion|\.)?|\.)?\s*(?=\d)", "version "), (r"(\d)\.0\b", r"\1"), (r"acknowledgment", "acknowledgement"), (r"\b0bsd\b", "0 bsd"), (r"\bzero[\s-]clause\b", "0 clause"), (r"\bmit[\s-]no by\b", "mit 0"),
    )
]
_words = re.compile(r"[a-z]+|\d+(?:\.\d+)*").findall
_ends = re.compile(r"[.!?:;*#%&$)\"']\s*$").search


def paragraphs(text: str) -> list[str]:
    """Lines, each joined with the next as long as it doesn't end like a sentence and the next isn't blank."""
    found: list[str] = []
    part: list[str] = []
    for line in text.split("\n"):
        if not line.strip():
            if part:
                found.append(" ".join(part))
            part = []
            continue
        part.append(line)
        if _ends(line):
            found.append(" ".join(part))
            part = []
    if part:
        found.append(" ".join(part))
    return found


def canonical(text: str) -> list[str]:
    """The words and numbers of a text in lower case, with one form for what licenses write in several ways."""
    text = text.lower()
    for pattern, form in _forms:
        text = pattern.sub(form, text)
    return _words(text)


def catalogue() -> list[tuple[str, str, list[str]]]:
    """(identifier, family, titles) of every license."""
    found = []
    for line in LICENSES.strip().splitlines():
        name, family, titles = (x.strip() for x in line.split("|"))
        found.append((name, family, [t.strip() for t in titles.split(";")]))
    found = [(n, f, titles + [t.replace(" version", "") for t in titles if " version" in t]) for n, f, titles in found]
    long = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for elements in CC_ELEMENTS:
        for version in CC_VERSIONS:
            words = "-".join(long[e] for e in elements.split("-"))
            found.append((f"CC-{elements}-{version}", "cc", [f"CC {elements} {version}", f"Creative Commons {words} {version} International License"]))
    return found


class Template:
    """A title or sentence of a license: its word pairs, words that must stand in what matches it, and words that must not."""

    def __init__(self, license: str, family: str, words: list[str], need: set[str], bar: set[str], title: bool) -> None:
        need = need | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a == "gnu"}  # GNU General, GNU Lesser, ...
        self.license, self.family, self.words, self.need, self.bar, self.title = license, family, words, need, bar - need - {"library"}, title
        self.pairs = set(zip(words, words[1:], strict=False))


def templates(licenses: list[tuple[str, str, list[str]]]) -> list[Template]:
    """Of every license its titles, its identifier and its sentences.

    What must stand in a match are the words that set the license's titles apart (numbers among them); what must not are
    those that set apart the other licenses of the family.
    """
    marks: dict[str, set[str]] = {}
    by_family: dict[str, set[str]] = {}
    for name, family, titles in licenses:
        marks[name] = {w for t in [*titles, name] for w in canonical(t)} - GLUE
        by_family.setdefault(family, set()).update(marks[name])
    made = []
    families = {name: family for name, family, _ in licenses}
    for name, family, titles in licenses:
        bar = by_family[family] - marks[name]
        for t in titles:
            words = canonical(t)
            made.append(Template(name, family, words, set(words) - GLUE or set(words), bar, True))
        words = canonical(name)
        made.append(Template(name, family, [*canonical("SPDX-License-Identifier"), *words], set(words), bar, False))
    for name, text, need, bar in BODIES:
        if name in families:
            family = families[name]
            own = set(need.split())
            made.append(Template(name, family, canonical(text), own, ((by_family[family] - marks[name]) | set(bar.split())) - set(canonical(text)), False))
    return made


class Scanner:
    """A softmax regression of license families over word 1- to 3-grams, whose unknown class is calibrated on wordings and
    foreign licenses that it wasn't fitted on, and the templates that confirm it."""

    def __init__(self, negatives: list[str], licenses: list[tuple[str, str, list[str]]] | None = None, frames: list[str] = FRAMES) -> None:
        rng = random.Random(SEED)
        licenses = catalogue() if licenses is None else licenses
        self.templates = templates(licenses)
        self.holders: dict[tuple[str, str], list[int]] = {}  # of a word pair, the templates with it
        self.single: dict[str, list[int]] = {}  # templates of one word
        for i, t in enumerate(self.templates):
            for pair in t.pairs:
                self.holders.setdefault(pair, []).append(i)
            if not t.pairs:
                self.single.setdefault(t.words[0], []).append(i)
        self.hints = sorted({h for t in self.templates for h in hints(t)})
        self.families = [*sorted({t.family for t in self.templates}), UNKNOWN]
        self.place = {f: i for i, f in enumerate(self.families)}

        fillers = [w for t in negatives for w in canonical(t)[:200]] or ["word"]
        parts: tuple[list, list] = ([], [])  # examples to fit on, and of other wordings to calibrate on

        def add(words: list[str], label: int, part: int) -> None:
            kept = [w for w in words if rng.random() > 0.03]
            around = [rng.choice(fillers) for _ in range(rng.choice((0, 0, 3, 12)))]
            at = rng.randint(0, len(around))
            parts[part].append(([*around[:at], *kept, *around[at:]], label))

        names = [(t, family) for _, family, titles in licenses for t in titles]
        for t, family in names:
            for i, frame in enumerate(frames):
                add(canonical(frame.format(t)), self.place[family], int(i % 4 == 3))
        for t in self.templates:
            if not t.title:
                for part in (0, 0, 0, 1):
                    add(t.words, self.place[t.family], part)
        unknown = self.place[UNKNOWN]
        for i, t in enumerate(OTHERS):
            for _ in range(12):
                add(canonical(t), unknown, int(i % 4 == 3))
        vocabulary = [w for words, _ in parts[0] for w in words]
        for i in range(400):  # the words of notices without their order
            parts[i % 4 == 3].append(([rng.choice(vocabulary) for _ in range(rng.randint(2, 30))], unknown))
        for i, t in enumerate(rng.sample(negatives, min(len(negatives), 800))):
            words = canonical(t)
            if not self.candidates(words, 0.6):
                parts[i % 4 == 3].append((words[:60], unknown))
        seen: dict[str, int] = {}
        for words, label in parts[0]:
            if label != unknown:
                for g in grams(words):
                    seen[g] = seen.get(g, 0) + 1
        self.code = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
        self.weights = np.zeros((len(self.code) + 1, len(self.families)))
        self._fit(parts[0])
        self.sharpness, self.caution = 1.0, 0.0
        self._calibrate(parts[1])

    def codes(self, words: list[str]) -> list[int]:
        return sorted({c for g in grams(words) if (c := self.code.get(g)) is not None})

    def _matrix(self, examples: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = [[*self.codes(words), len(self.code)] for words, _ in examples]  # the last is the intercept
        starts = np.cumsum([0, *map(len, codes)])[:-1]
        return starts, np.concatenate(codes), np.array([y for _, y in examples])

    def _fit(self, examples: list, rounds: int = 100, ridge: float = 1e-5) -> None:
        starts, col, y = self._matrix(examples)
        row = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(col))))
        order = np.argsort(col, kind="stable")
        used, first = np.unique(col[order], return_index=True)
        share = np.bincount(y, minlength=len(self.families)).astype(float)
        each = (1 / np.maximum(share, 1)[y] / len(self.families))[:, None]
        seen = np.full_like(self.weights, 1e-8)
        for _ in range(rounds):
            p = softmax(np.add.reduceat(self.weights[col], starts))
            p[np.arange(len(y)), y] -= 1
            slope = ridge * self.weights
            slope[used] += np.add.reduceat((p * each)[row[order]], first)
            seen += slope * slope
            self.weights -= 0.3 * slope / np.sqrt(seen)

    def _calibrate(self, examples: list) -> None:
        """The factor of the scores, and what is added to the unknown class, under which the held-out labels are likeliest."""
        starts, col, y = self._matrix(examples)
        scores = np.add.reduceat(self.weights[col], starts)
        share = np.bincount(y, minlength=len(self.families)).astype(float)
        weight = np.where(y == len(self.families) - 1, len(self.families) - 1, 1) / np.maximum(share, 1)[y]  # as many unknown as known
        best = None
        for sharpness in (0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
            for caution in (-1.0, 0.0, 1.0, 2.0):
                shifted = scores * sharpness
                shifted[:, -1] += caution
                loss = (weight * -np.log(softmax(shifted)[np.arange(len(y)), y] + 1e-12)).sum()
                if best is None or loss < best[0]:
                    best = loss, sharpness, caution
        _, self.sharpness, self.caution = best

    def probabilities(self, words: list[str]) -> np.ndarray:
        codes = self.codes(words)
        scores = (self.weights[codes].sum(0) + self.weights[-1]) * self.sharpness
        scores[-1] += self.caution
        return softmax(scores[None])[0]

    def hinted(self, text: str) -> bool:
        """Whether a text has any of the words without which no template matches."""
        text = text.lower()
        return any(h in text for h in self.hints)

    def candidates(self, words: list[str], contained: float) -> list[tuple[Template, int, int, float]]:
        """(template, from, to, contained share) of the windows that hold `contained` of a template's word pairs, all words
        that it needs and none that stand for another license of the family."""
        places: dict[int, list[int]] = {}
        for at, pair in enumerate(zip(words, words[1:], strict=False)):
            for i in self.holders.get(pair, ()):
                places.setdefault(i, []).append(at)
        found = []
        for i, at in places.items():
            t = self.templates[i]
            if len(t.pairs & {(words[k], words[k + 1]) for k in at}) >= contained * len(t.pairs):
                for lo, hi in windows(words, at, len(t.pairs), contained):
                    near = words[max(0, lo - 2) : hi + 3]
                    near = {*near, *map(" ".join, zip(near, near[1:], strict=False))}
                    if t.need <= near and not t.bar & {*near, *words[lo : lo + len(t.words) + 3]}:
                        share = len(t.pairs & set(zip(words[lo:hi], words[lo + 1 : hi], strict=False))) / len(t.pairs)
                        found.append((t, lo, hi, share))
        for k, w in enumerate(words):
            found += [(self.templates[i], k, k + 1, 1.0) for i in self.single.get(w, ())]
        return found

    def classify_all(self, paragraph: str, least: float, contained: float) -> list[tuple[str, float, float]]:
        """(license, probability of its family, contained share of its template) of every license that the paragraph gives.

        A title counts as a grant if it makes up most of the paragraph or follows words like "under the", and nothing
        before it denies that.
        """
        if not self.hinted(paragraph):
            return []
        words = canonical(paragraph)
        found: dict[str, tuple[str, float, float]] = {}
        for t, lo, hi, share in self.candidates(words, contained):
            before = words[max(0, lo - 8) : lo]
            if t.title and (hi - lo < 0.4 * len(words) and not CUES & set(before) or DENIALS & set(before)):
                continue
            k = self.place[t.family]
            for around in (AROUND, NEARBY):
                p = self.probabilities(words[max(0, lo - around) : hi + around])
                if int(p.argmax()) == self.place[UNKNOWN]:
                    break
                if p[k] >= least and int(p.argmax()) == k and (t.license not in found or found[t.license][1:] < (float(p[k]), share)):
                    found[t.license] = (t.license, float(p[k]), share)
        return sorted(found.values())

    def classify(self, paragraph: str, least: float, contained: float) -> tuple[str, float, float] | None:
        """The likeliest license of the paragraph (by name on ties), None for unknown."""
        return max(self.classify_all(paragraph, least, contained), key=lambda x: (x[1], x[2], x[0]), default=None)


def hints(t: Template) -> tuple[str, ...]:
    """Lower-case pieces of which every text that matches the template has one: its longest needed word as texts spell it."""
    word = max((w for w in t.need if " " not in w and not w[0].isdigit() and w not in ("by", "sa", "nc", "nd", "clause")), key=lambda w: (len(w), w), default="cc")
    return {"cc": ("creative", "cc"), "cczero": ("creative", "cc"), "acknowledgement": ("acknowledg",)}.get(word, (word,))


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def windows(words: list[str], at: list[int], size: int, contained: float) -> Iterator[tuple[int, int]]:
    """Ranges of words, a third longer than a template of `size` pairs at most, with the share of its pairs, which stand at `at`."""
    seen: dict[tuple[str, str], int] = {}
    reach, lo = size + size // 3 + 4, 0
    for b in at:
        pair = (words[b], words[b + 1])
        seen[pair] = seen.get(pair, 0) + 1
        while at[lo] <= b - reach:
            old = (words[at[lo]], words[at[lo] + 1])
            seen[old] -= 1
            if not seen[old]:
                del seen[old]
            lo += 1
        if len(seen) >= contained * size:
            yield at[lo], b + 2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, contained: float = 0.6, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """Rows (id, n_paragraphs, found array<struct<paragraph, family, probability, contained>>), one per row of docs.

    `family` is the license's SPDX identifier.  The classifier is fitted on the titles, identifiers and sentences above in
    several wordings, and on foreign licenses and at most 8 paragraphs a document (FIT_CHARACTERS characters of each) of
    at most `fit_documents` documents as the unknown class; then every paragraph of every document is scanned whole.  A
    license counts if `contained` of the word pairs of one of its templates stand in a window of the paragraph, with all
    words that set the license apart (version and variant) and none that set apart another of its family, and the family
    is the classifier's choice there with a calibrated probability of at least `least`.  A paragraph may give several.

    Equal probabilities are told apart by the contained share and the name.  Null texts have no paragraphs; null ids and
    repeated rows are kept as they are; paragraphs of very long texts are handled one at a time.  Other columns are
    ignored.  No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    least_ids = base.select("_id").where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(fit_documents)
    chosen = base.join(F.broadcast(least_ids), "_id", "left_semi")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = sorted({p[:FIT_CHARACTERS] for t in batch.column("_text").to_pylist() for p in paragraphs(t)})
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["p"])

    negatives = sorted({r.p for r in chosen.mapInArrow(sample, "p string").orderBy(F.xxhash64("p"), "p").limit(8 * fit_documents).collect()})
    scanner = Scanner(negatives)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64())]))
        for batch in batches:
            sizes, found = [], []
            for t in (x.as_py() for x in batch.column("_text")):
                parts = paragraphs(t)
                sizes.append(len(parts))
                hits = [(i, h) for i, p in enumerate(parts) for h in scanner.classify_all(p, least, contained)] if scanner.hinted(t) else []
                found.append([{"paragraph": i, "family": h[0], "probability": h[1], "contained": h[2]} for i, h in hits])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(found, shape)], names=["_id", "n_paragraphs", "found"])

    schema = f"_id {kind}, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,contained:double>>"
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_max(F.transform("found", lambda x: F.struct(x["probability"].alias("p"), x["contained"].alias("c"), x["family"].alias("f"))))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_paragraphs",
        F.size(F.array_distinct("found.paragraph")).cast("long").alias("n_license_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("families"),
        best["f"].alias("family"),
        best["p"].alias("probability"),
    )
