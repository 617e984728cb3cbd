import numpy as np
import pytest
import xxhash

from quillon.llm import simhash
from quillon.llm.simhash import op2_simhash, simhash_components, trie_links

LOWER = bytes(range(256)).lower()


def brute_print(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=2):
    ids = list(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= budget and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return comp


def test_whole_table_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    comp = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in texts}


@pytest.mark.parametrize("large", [50_000, 3])
def test_close_fingerprints_in_large_tries(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_TRIE", large)
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    prints = {}
    for i in range(240):
        x = base[i % 6]
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        prints[i] = x
    rows = [(i, [x - (1 << 64) if x >> 63 else x], b"") for i, x in prints.items()]
    made = spark.createDataFrame(rows, "_id long, fps array<long>, mark binary")
    monkeypatch.setattr(simhash, "_fingerprints", lambda *a: None)

    class Docs:
        sparkSession = spark

        def select(self, *a):
            return self

        def mapInArrow(self, *a):
            return made

    got = {r.doc_id: r.component_id for r in simhash_components(Docs()).collect()}
    assert got == brute_components(prints)


def test_trie_links_equals_brute_force():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) << np.uint64(20))
    links = trie_links(values, [(0, len(values), 0, len(values))], 0, 2, lambda a, b: np.ones(len(a), bool))
    assert all((int(values[a]) ^ int(values[b])).bit_count() <= 2 for a, b in links)
    want = brute_components({i: int(v) for i, v in enumerate(values)})
    assert len(links) == len(values) - len(set(want.values()))


def test_edge_cases(spark):
    rows = [(5, None, "x"), (3, "", "y"), (9, " \t", "z"), (4, "One two", "x"), (8, "one TWO", "x"), (8, "one TWO", "x"), (None, "one two", None), (None, "lonely words here", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash_components(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (8, 4), (8, 4), (None, 4), (None, None)], key=str)
    assert simhash_components(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b " * 200_000), (2, "a b " * 200_001)], "doc_id long, text string")
    assert {r.component_id for r in simhash_components(long).collect()} == {1}


def test_verified_sets(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for i in range(30):
        t = list(rng.choice(words, 300))
        texts[2 * i] = " ".join(t)
        t[150] = "changed"
        texts[2 * i + 1] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = simhash_components(docs, n=1, budget=3, seeds=(1, 2, 3, 4), as_set=True, verify=5, least=0.7)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i - i % 2 for i in texts}


@pytest.mark.parametrize("values", [[7] * 130, [7] * 65 + [15] * 65])
def test_equal_fingerprints_whose_sketches_form_chains(values):
    rng = np.random.default_rng(4)
    for _ in range(20):
        place = rng.permutation(180)[: len(values)]  # neighbours on a line are alike, and the line has gaps
        alike = lambda a, b: np.abs(place[a] - place[b]) == 1
        links = trie_links(np.array(values, np.uint64), [(0, len(values), 0, len(values))], 0, 2, alike)
        assert all(abs(int(place[a]) - int(place[b])) == 1 for a, b in links)
        assert len(links) == sum(int(x) + 1 in set(place.tolist()) for x in place)


def test_crowded_tries_are_compared_in_small_parts(monkeypatch):
    """Of a million small node pairs only some are turned into pairs of positions at once."""
    from quillon.llm import simhash

    made, whole = [], simhash._expand
    monkeypatch.setattr(simhash, "_expand", lambda pairs, same: made.append(int(((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])).sum())) or whole(pairs, same))
    rng = np.random.default_rng(4)
    values = np.sort(rng.integers(0, 1 << 20, 100_000).astype(np.uint64))
    groups = np.stack([np.arange(0, 99_996), np.arange(4, 100_000)] * 2, 1)
    links = trie_links(np.unique(values), groups[groups[:, 1] <= len(np.unique(values))], 0, 2, lambda a, b: np.zeros(len(a), bool))
    assert not links and sum(made) > 1_500_000 and max(made) <= 16 * (1 << 16)
