import random

import pytest

from quillon.llm import licenses
from quillon.llm.licenses import FRAMES, OTHERS, Scanner, canonical, catalogue, op8_licenses, paragraphs, scan

PLANTED = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License."}
GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Public notices in their own wording, and what they give.
NOTICES = [
    ("GPL-2.0", GNU.format("General Public License", 2)), ("GPL-3.0", GNU.format("General Public License", 3)), ("AGPL-3.0", GNU.format("Affero General Public License", 3)),
    ("LGPL-2.1", GNU.format("Lesser General Public License", 2.1).replace("program", "library")), ("LGPL-2.0", GNU.format("Library General Public License", 2)), ("LGPL-3.0", GNU.format("Lesser General Public License", 3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("GPL-3.0", "You may copy it under GPLv3"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."), ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Text by N. N., licensed under CC BY-NC-SA 4.0"), ("CC-BY-4.0", "https://creativecommons.org/licenses/by/4.0/"), ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("MIT", "The MIT License (MIT)"), ("MIT-0", "MIT No Attribution"), ("MIT-0", "SPDX-License-Identifier: MIT-0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "Licensed under the 3-clause BSD license"),
    ("Apache-2.0", "lib foo: Licensed under the Apache License, Version 2.0 by Someone"), ("Apache-2.0", "Released under Apache 2.0"), ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (None, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (None, "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    (None, "This is not licensed under the MIT License."), (None, "We compared the Apache License version 2.0 and some others in class today"), (None, "Licensed under the GNU General Public License."),
    (None, "Licensed under the Solderpad Hardware License v 0.51."), (None, "Released under the CeCILL Free Software License Agreement v2.1"), (None, "SPDX-License-Identifier: CPAL-1.0"), (None, "Licensed under the Open Publication License v1.0"),
]


@pytest.fixture(scope="module")
def negatives(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    return sorted({p[:600] for t in texts for p in paragraphs(t or "")})


@pytest.fixture(scope="module")
def scanner(negatives):
    return Scanner(negatives)


def named(scanner, text):
    return [f for f, *_ in scanner.classify_all(text, 0.5, 0.6)]


def test_planted_lines_of_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        want[r.doc_id] = ",".join(sorted(f for f, line in PLANTED.items() if line in r.text))
    got = {r.doc_id: r.families for r in op8_licenses(spark, d).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_notices(scanner):
    assert [(t, named(scanner, t)) for f, t in NOTICES if named(scanner, t) != ([f] if f else [])] == []
    assert [t for t in OTHERS if named(scanner, t)] == []


def test_precision_and_recall_per_license_in_wordings_not_trained_on(negatives):
    """Frames of the test are none of those that the classifier was fitted or calibrated on."""
    unseen = ["All sources herein are distributed under {}", "The {} applies: use is licensed under {} terms.", "Code: {}", "N. N. released it in May, under the {}, for all to use."]
    scanner = Scanner(negatives)
    assert not set(unseen) & set(FRAMES)
    hit, said, of = {}, {}, {}
    for license, _, titles in catalogue():
        for text in [f.format(t, t) for t in titles for f in unseen]:
            of[license] = of.get(license, 0) + 1
            for f in named(scanner, text):
                said[f] = said.get(f, 0) + 1
                hit[f] = hit.get(f, 0) + (f == license)
    assert all(hit.get(f, 0) == n for f, n in said.items())  # precision 1 for every license
    recall = {f: hit.get(f, 0) / n for f, n in of.items()}
    assert sum(hit.values()) / sum(of.values()) >= 0.9 and min(recall.values()) >= 0.5, recall


def test_families_that_were_not_trained_on_are_unknown(negatives):
    gone = {"eclipse", "eupl", "boost", "ofl", "psf", "busl", "cddl", "sspl"}
    scanner = Scanner(negatives, [x for x in catalogue() if x[1] not in gone])
    texts = [f.format(t) for name, family, titles in catalogue() if family in gone for t in titles for f in FRAMES]
    assert [(t, named(scanner, t)) for t in texts if named(scanner, t)] == []


def test_candidates_against_brute_force(scanner):
    """Every template that some window of up to a third more than its size contains is found, and no other."""
    rng = random.Random(3)
    texts = [t for _, t in NOTICES] + [" ".join(rng.choice([t for _, t in NOTICES]).split()[: rng.randint(3, 40)]) for _ in range(60)]
    for text in texts:
        words = canonical(text)
        want = set()
        for i, t in enumerate(scanner.templates):
            size = len(t.pairs)
            for lo in range(len(words)):
                for hi in range(lo + 2, min(len(words), lo + size + size // 3 + 5) + 1):
                    pairs = list(zip(words[lo:hi], words[lo + 1 : hi], strict=False))
                    near = words[max(0, lo - 2) : hi + 3]
                    near = {*near, *map(" ".join, zip(near, near[1:], strict=False))}
                    if size and pairs[0] in t.pairs and pairs[-1] in t.pairs and len(t.pairs & set(pairs)) >= 0.6 * size and t.need <= near and not t.bar & {*near, *words[lo : lo + len(t.words) + 3]}:
                        want.add(i)
            if not size and t.words[0] in words:
                want.add(i)
        got = {next(i for i, t in enumerate(scanner.templates) if t is found) for found, *_ in scanner.candidates(words, 0.6)}
        assert got <= want and {scanner.templates[i].license for i in want} == {scanner.templates[i].license for i in got}, text


def test_every_match_has_a_hint(scanner):
    for license, _, titles in catalogue():
        assert all(scanner.hinted(f.format(t)) for t in [*titles, license] for f in FRAMES)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Released under the\nMIT License.\n\nmore", "x"), (3, "word " * 100_000 + "\n" + PLANTED["MIT"], "x"), (3, "plain", "x"), (3, "plain", "x")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, found string")).collect()
    assert sorted((r.doc_id or 0, r.n_paragraphs, tuple(f.family for f in r.found)) for r in got) == [(0, 2, ("MIT",)), (1, 0, ()), (2, 0, ()), (3, 1, ()), (3, 1, ()), (3, 1, ("MIT",))]
    assert scan(spark.createDataFrame(rows, "doc_id long, text string, found string").limit(0)).count() == 0
    assert paragraphs("a\nb.\nc\n\nd") == ["a b.", "c", "d"]


def test_several_notices_in_one_paragraph(spark):
    spdx = lambda *names: "\n".join(f"SPDX-License-Identifier: {n}" for n in names)
    texts = {
        1: ("MIT", "Apache-2.0"), 2: ("ISC", "MPL-2.0", "CC0-1.0"), 3: ("Apache-2.0",),
    }
    rows = [(i, spdx(*names)) for i, names in texts.items()]
    rows.append((4, "word " * 300 + "released under the MIT License " + "word " * 300 + "licensed under CC BY-SA 4.0 " + "word " * 300))
    rows.append((5, " ".join(t.rstrip(".") for t in OTHERS if "License" not in t and "Licence" not in t)))
    texts |= {4: ("MIT", "CC-BY-SA-4.0"), 5: ()}
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: sorted(f.family for f in r.found) for i, r in got.items()} == {i: sorted(names) for i, names in texts.items()}
    assert [r.n_paragraphs for r in got.values()] == [1] * 5


def test_calibration_is_on_other_wordings():
    assert licenses.FRAMES[3::4] and len(licenses.FRAMES) == len(set(licenses.FRAMES))
