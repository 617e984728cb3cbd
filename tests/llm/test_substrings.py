import hashlib
import random

import pytest

from quillon.llm.substrings import Automaton, substring_dedup


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for d in range(n):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [rng.choice(words) for _ in range(rng.randint(0, 15))]
            p = rng.choice(passages)
            t += p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((d * 3, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "large"), [(1, 2000), (2, 2)])
def test_against_brute_force(spark, seed, large):
    rows = corpus(seed) + [(1000, "a " * 40), (1001, "a " * 30), (1002, "a b " * 20)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    got = substring_dedup(docs, window=10, gram=4, large=large)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10)


def test_edges(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(None, shared), (7, shared), (7, shared), (7, "x " + shared), (9, "é\n" + shared.replace(" ", "\t") + " end"), (3, None), (4, ""), (5, "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(docs, window=10, gram=4).collect()), key=str) == brute(rows, 10)
    assert substring_dedup(docs.limit(0)).count() == 0
    long = [(1, " ".join(str(i) for i in range(60_000))), (2, "x " + " ".join(str(i) for i in range(100, 59_000)))]
    assert sorted(map(tuple, substring_dedup(spark.createDataFrame(long, "doc_id long, text string")).collect())) == brute(long, 50)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randint(0, 25))] for _ in range(4)]
        a = Automaton()
        for d, t in enumerate(texts):
            a.add(t, d)
        a.finish()
        for d, t in enumerate(texts):
            for w in (1, 3, 6):
                want = [i for i in range(len(t) - w + 1) if any("".join(t[i : i + w]) in "".join(o) for o in texts[:d])]
                assert a.earlier(t, d, w) == want
