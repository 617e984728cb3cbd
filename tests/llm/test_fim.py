"""The learned rank index against plain boundaries, cuts against a plain version, exact restoring."""

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string, _index int"


def plainly(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 90), st.integers(0, 100_000)), max_size=120), st.integers(0, 126))
def test_index_gives_every_offset_within_its_error(gaps, error):
    offsets = np.cumsum([0, *gaps]).astype(np.int64)
    ranks, bases, slopes, residuals = fim.fit(offsets, error)
    of = np.searchsorted(ranks, np.arange(len(offsets)), "right") - 1
    guess = fim._line(bases[of], slopes[of], np.arange(len(offsets)) - ranks[of])
    assert (guess + residuals == offsets).all()
    assert np.abs(guess - offsets).max() <= error + 1  # the line is rounded to whole characters


def test_even_lines_need_few_segments():
    rng = np.random.default_rng(1)
    offsets = np.cumsum([0, *rng.integers(40, 80, 20_000)])
    assert len(fim.fit(offsets)[0]) < 200
    assert len(fim.fit(np.arange(0, 600_000, 60))[0]) == 1


def test_look_up_of_sliced_batches():
    texts = ["", "a\n", "ü\n\n€x", "no newline", "a\n" * 500, "\n"]
    index = fim._indexes(texts, 3)
    for part in (index, index.slice(2, 3)):
        held = texts if part is index else texts[2:5]
        for where in (0.0, 0.5, 1.0):
            ranks = np.array([int(where * (len(fim.boundaries(t)) - 1)) for t in held])
            assert fim.look_up(part, ranks).tolist() == [fim.boundaries(t)[r] for t, r in zip(held, ranks, strict=True)]
    assert len(fim.look_up(pa.array([], index.type), np.empty(0, np.int64))) == 0


def test_cuts_equal_a_plain_version(spark):
    texts = [None, "", "\n", "one", "a\nb\nc", "ä€\n\U0001f600\n\nz\r\n", "holds <M> here\nx", "x\n" * 5000 + "tail", "<\nP>\nS>", "long " * 30_000 + "\n" + "y\n" * 300]
    rows = [(i, t, 1, "f", "o", 2) for i, t in enumerate(texts)] + [(None, "a\nb", 1, "f", "o", 2)] * 2 + [(-5, "q\nr\ns\n", 0, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for args in ({}, {"rate": 50, "spm": 0}, {"seed": 99, "spm": 100}):
        out = fim.fill_in_middle(docs, **args)
        got = out.collect()
        key = lambda r: str(tuple(r))
        assert sorted(map(tuple, got), key=key) == sorted((plainly(r[0], r[1], **args) for r in rows), key=key)
        back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
        assert sorted((str(i), t) for i, t in back) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_empty_table_and_bad_sentinels(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    for marks in (("<P>", "<P>", "<M>x"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(spark.createDataFrame([], SCHEMA), marks=marks)
