import random
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import jaccard, simhash
from quillon.session import materialise


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)


def plain_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}
    root = lambda i: i if up[i] == i else root(up[i])
    for i in sets:
        for j in sets:
            if i < j and alike(sets[i], sets[j]) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in sets}


def edited_texts():
    """Texts with edited copies on both sides of a similarity of 0.8, short and long, and a passage common to many."""
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, texts = words(40), []
    for n in (6, 12, 20, 30, 60, 200, 400):
        for k in range(12):
            base = words(n) if k % 3 else passage + words(max(6, n - 40))
            texts.append(base)
            texts.append([*base[:-1], "last"])
            m = len(base) - 4
            for lost in (m // 5, m // 5 + 1):  # of m shingles 4/5, and less
                texts.append(base[: len(base) - lost])
            cut = round(m / 9)  # as many lost as added, just at or below 0.8
            for c in (cut, max(0, cut - 1)):
                texts.append(base[: len(base) - c] + words(c))
    texts += [[], ["one"], ["one"], ["ONE", "two"]]
    r.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("large", [20_000, 5])
def test_all_and_only_links_of_the_similarity(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard, "LARGE_KEY", large)
    texts = edited_texts()
    docs = materialise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    want = plain_components(texts)
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_missing_ids_and_repeated_rows(spark):
    rows = [(5, None), (3, ""), (4, "One two"), (8, "one TWO"), (8, "one TWO"), (None, "one two"), (None, "lonely words here"), (4, "another text")]
    docs = materialise(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int"), "docs")
    found = jaccard.near_components(docs, 0.8, **corpus_pipeline.NEAR)
    got = sorted(map(tuple, found.select("doc_id", "component_id", "kept").collect()), key=str)
    want = [(5, 3, False), (3, 3, True), (4, 4, True), (8, 4, False), (8, 4, False), (None, 4, False), (None, None, True), (4, 4, True)]
    assert got == sorted(want, key=str)
    assert jaccard.near_components(docs.limit(0), 0.8, **corpus_pipeline.NEAR).count() == 0


def test_partners_of_one_set_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 3)
    base = [f"w{i}" for i in range(60)]
    texts = {0: " ".join(base)} | {i: " ".join([*base[:58], f"x{i}", "y"]) for i in range(1, 30)}
    docs = materialise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    found = jaccard.near_components(docs, 0.8, **corpus_pipeline.NEAR).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 for i in texts} == {i: plain_components(texts)[i] for i in texts}


def test_equal_fingerprints_with_many_sketches(spark):
    rng = np.random.default_rng(8)
    marks = rng.integers(0, 256, (50_000, simhash.BINS)).astype(np.uint8)
    marks[40_000:] = marks[rng.integers(0, 40_000, 10_000)]
    changed = rng.integers(0, simhash.BINS, 10_000)
    marks[np.arange(40_000, 50_000), changed] ^= 1
    alike = lambda i, j: (marks[i] == marks[j]).mean(1) >= 0.6
    links = simhash.trie_links(np.full(50_000, 7, np.uint64), [(0, 50_000, 0, 50_000)], 0, 3, alike, simhash.sketch_bands(marks, 0.6))
    assert len(links) == 10_000


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (0, 1, 40, 700, 90_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.5, 0.95, 1.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
            x, y, apart = simhash.least_difference(simhash.parities(a), simhash.parities(b))
            assert (x, y) == (len(a), len(b)) and apart <= len(np.setxor1d(a, b))
    assert simhash.least_difference(simhash.parities(a), simhash.parities(a))[2] == 0


def test_near_copies_take_few_pairs(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    texts = {}
    for i in range(1500):
        words = list(base)
        for _ in range(2):
            words[r.randrange(300)] = f"x{i}-{r.randrange(9)}"
        texts[i] = " ".join(words)
    docs = materialise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    seen, confirmed = [], jaccard._confirmed

    def counted(pairs, *rest):
        pairs = materialise(pairs, "counted")
        seen.append(pairs.selectExpr("least(u, v)", "greatest(u, v)").distinct().count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(jaccard, "_confirmed", counted)
    monkeypatch.setattr(jaccard, "HOT", 5)
    prints = jaccard.simhash_links
    monkeypatch.setattr(jaccard, "simhash_links", lambda *a, **k: (lambda p, g, links: (p, g, links.limit(0)))(*prints(*a, **k)))  # the prefix join alone
    found = jaccard.near_components(docs, 0.8, **corpus_pipeline.NEAR).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(seen) <= 1.5 * len(texts), seen


@pytest.mark.parametrize("crowded", [0.0005, 1e9])
def test_slices_change_no_result(spark, monkeypatch, crowded):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "TOGETHER", 7)
    monkeypatch.setattr(jaccard, "FIRST", 1)
    texts = dict(list(edited_texts().items())[:300])
    docs = materialise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    found = jaccard.near_components(docs, 0.8, **corpus_pipeline.NEAR).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_components(texts)


def test_only_keys_of_several_nodes_stay():
    import pyarrow as pa

    r = np.random.default_rng(2)
    key = np.sort(r.integers(0, 400, 500))
    part = (key % 50 == 0).astype(np.int32)
    rows = pa.table({"key": key, "node": np.arange(500), "place": np.arange(500), "part": part})
    count = dict(zip(*np.unique(key, return_counts=True), strict=True))
    want = [i for i in range(500) if count[key[i]] > 1 or part[i]]
    for size in (1, 2, 7, 500):
        got = [x for b in jaccard._shared(iter(rows.to_batches(size))) for x in b.column("node").to_pylist()]
        assert got == want
    assert sum(b.num_rows for b in jaccard._shared(iter([]))) == 0
