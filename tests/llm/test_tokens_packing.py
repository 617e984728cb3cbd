import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import tokens
from quillon.llm.packing import best_fit_decreasing, op7_packing, pack
from quillon.llm.tokens import Encoder, count_tokens, op4_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n\n  x", "it's I'll we've", "naïve café ½ ² 100€", "“quoted” — dash…", "a<|endoftext|>b", "<|endof", "日本語 テキスト", "x  y\u0085z\x1cq", "ᚠ 👩‍👩‍👧 ñ", "tab\t\tend  ", "0" * 50, "'s's'"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def as_ids(raw):
    return raw.tolist()


@pytest.mark.parametrize("text", ODD)
def test_encoder_equals_library(text):
    assert as_ids(Encoder(PATH).encode(text)) == ids(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_vocabularies(name):
    path = public_tokenizers.path(name)
    want = Tokenizer.from_file(path)
    for text in ODD:
        assert as_ids(Encoder(path).encode(text)) == want.encode(text, add_special_tokens=False).ids


def test_splicing_equals_whole(sf, spark):
    coder, rng = Encoder(PATH), random.Random(1)
    texts = ["".join(rng.choice([" ", "\n", "ab", "don't", "12", "<|endoftext|>", "...", "é", "  \t", "日本"]) for _ in range(3000)) for _ in range(20)]
    texts += ["x" * 5000, " " * 5000, "x" * 700 + " y " * 400, "<|endoftext|>" * 300, "a" * 300 + "<|endoftext|>" + " " * 400 + "b"]
    for text in texts:
        for size, overlap in [(200, 16), (300, 100), (1000, 2)]:
            assert as_ids(np.concatenate(list(coder.spliced(text, size, overlap)))) == ids(text)


def test_splicing_by_the_library_alone(monkeypatch):
    """Without the rank-merging encoder the chunks' ids come from the library's own offsets."""
    coder, rng = Encoder(PATH), random.Random(2)
    coder.ranked = None
    texts = ["".join(rng.choice([" ", "\n", "ab", "don't", "12", "<|endoftext|>", "...", "é", "  \t", "日本"]) for _ in range(1500)) for _ in range(6)]
    for text in texts:
        for size, overlap in [(200, 16), (1000, 2)]:
            assert as_ids(np.concatenate(list(coder.spliced(text, size, overlap)))) == ids(text)


def test_huge_texts():
    """Texts far above the size from which chunks are spliced, with their own constants."""
    rng = random.Random(3)
    prose = " ".join(rng.choice(["the", "naïve", "river's", "bank,", "12", "(old)", "\n"]) for _ in range(60_000))
    for text in (prose, "x" * 100_000, " " * 70_000 + "end", prose[:40_000] + "日本語" * 10_000):
        assert len(text) > tokens.HUGE and as_ids(Encoder(PATH).encode(text)) == ids(text)


def test_counts_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op4_token_counts(spark, sf).collect()}
    assert got == {i: (len(t.encode()), len(ids(t)), len(ids(t)) > 512) for i, t in texts.items()}


def test_count_edges(spark, monkeypatch):
    rows = [(None, None, 7), (1, "", 7), (1, "", 7), (2, ODD[4], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted([(None, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, len(ODD[4].encode()), len(ids(ODD[4])), False)], key=str)
    assert count_tokens(docs.limit(0), PATH).count() == 0
    monkeypatch.setattr(tokens, "HUGE", 4)
    coder = Encoder(PATH)
    for t in ODD:
        assert as_ids(coder.encode(t)) == ids(t)


def test_rank_merging_is_used_where_it_is_the_same():
    assert Encoder(PATH).ranked is not None
    assert Encoder(public_tokenizers.path("word_bpe_49k.json")).ranked is None


def brute_best_fit(lengths, limit):
    free, where = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [(f, b) for b, f in enumerate(free) if f >= lengths[i]]
        if not fit:
            free.append(limit)
            fit = [(limit, len(free) - 1)]
        _, b = min(fit)
        free[b] -= lengths[i]
        where[i] = b
    return len(free), sorted(free)


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(4)
    for limit in (10, 64, 100):
        lengths = rng.integers(1, limit + 1, 400)
        where, offset = best_fit_decreasing(lengths, limit)
        n, free = brute_best_fit(lengths.tolist(), limit)
        used = np.bincount(where, weights=lengths)
        assert len(used) == n and sorted((limit - used).astype(int).tolist()) == free
        for b in range(n):
            at = sorted((o, ln) for o, ln in zip(offset[where == b], lengths[where == b], strict=True))
            assert [o for o, _ in at] == [0, *np.cumsum([ln for _, ln in at])[:-1].tolist()]


def check_packing(rows, texts, limit):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        whole = [*ids(t or ""), 0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(whole) and all(r.length == limit for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
            at += r.length
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_seq)


def test_packing_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check_packing(op7_packing(spark, sf).collect(), texts, 2048)
    assert n <= 1.02 * sum(len(ids(t)) + 1 for t in texts.values()) / 2048 + 2


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "a b c d e f g", 4: "a b c", 5: " ".join("abcdefghijklmnop")}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int")
    rows = pack(docs, PATH, limit=4, with_ids=True, shard=2).collect()
    check_packing(rows, texts, 4)
    for r in rows:
        assert r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert pack(docs.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in pack(twice, PATH).collect()) == [(0, 2), (1, 3), (1, 3)]
