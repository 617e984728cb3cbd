"""Elias-Fano arrays and token files: round trips, and the query against the tokenizer's own library."""

import io
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import tokenfile
from quillon.session import shared_dir, table

BPE = public_tokenizers.path("byte_bpe_50k.json")


def reader(raw):
    return lambda at, n: raw[at : at + n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.lists(st.integers(0, 300), max_size=1500), st.data())
def test_elias_fano_round_trip(wide, gaps, data):
    for values in (sorted(wide), np.cumsum([*gaps]).tolist()):
        got = tokenfile.EliasFano(reader(tokenfile.encoded(np.array(values, np.uint64))))
        assert got.values(0, got.n).tolist() == values
        if values:
            first = data.draw(st.integers(0, len(values) - 1))
            end = data.draw(st.integers(first, len(values)))
            assert got.values(first, end).tolist() == values[first:end]
            assert got.select(first) == values[first]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(3).integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(tokenfile.encoded(values)) < 100_000 * 13 / 8


@pytest.mark.parametrize("width", [2, 4])
def test_file_round_trip(width):
    out, rng = io.BytesIO(), np.random.default_rng(5)
    docs = [(None, rng.integers(0, 60_000, 3)), (None, rng.integers(0, 9, 0))] + [(i, rng.integers(0, 60_000, rng.integers(0, 40))) for i in np.sort(rng.integers(-9, 5000, 9000)).tolist()]
    w = tokenfile.Writer(out, width)
    for d in docs:
        w.add(*d)
    w.close()
    f = tokenfile.TokenFile(reader(out.getvalue()), len(out.getvalue()))
    for k in (0, 1, 2, 4095, 9001):
        assert f.document(k).tolist() == docs[k][1].tolist()
        assert f.doc_ids(k, k + 1) == [docs[k][0]]
    got = [(d, ids[a - bounds[0] : b - bounds[0]].tolist()) for ds, bounds, ids in f.documents() for d, a, b in zip(ds, bounds[:-1], bounds[1:], strict=True)]
    assert got == [(d, ids.tolist()) for d, ids in docs]
    for raw in (b"", out.getvalue()[:-1], b"x" * 200):
        with pytest.raises(ValueError):
            tokenfile.TokenFile(reader(raw), len(raw))


def plainly(rows):
    library, at, out = Tokenizer.from_file(BPE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = tokenfile.op12_token_files(spark, sf).collect()
    assert sorted(map(tuple, got)) == plainly(rows)


def test_odd_rows_and_many_files(spark):
    rows = [(9, "nine"), (-3, None), (5, ""), (7, "word " * 60_000), (None, "none"), (4, "a <|endoftext|> b"), (4, "a <|endoftext|> b"), (2**62, "ünï €")] + [(100, f"row {i}") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, path string")
    for limit in (200, 64 << 20):
        files = tokenfile.write_tokens(docs, BPE, f"{shared_dir(spark)}/t{limit}-{id(rows)}", file_bytes=limit)
        assert files.count() > 3 or limit > 200
        got = tokenfile.read_tokens(files, with_ids=True).orderBy("start").collect()
        ids = Tokenizer.from_file(BPE).encode("word " * 60_000, add_special_tokens=False).ids
        assert next(r["ids"] for r in got if r["doc_id"] == 7) == [*ids, 0]
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
        assert [r["doc_id"] for r in got] == [r[0] for r in plainly(rows)]  # of one id, texts come in the order of their hash
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(a), c, d) for a, _, c, d in plainly(rows))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, BPE, f"{shared_dir(spark)}/empty-{id(none)}")).count() == 0
