import numpy as np
import pytest

from quillon.llm.embeddings import Codes, embedding_links, near_pairs, quantise


def brute(vectors, least=0.9):
    """{position: (n_links, component)} of (id, vector) rows."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    n = len(vectors)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = np.array(vectors[i][1], float), np.array(vectors[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i].add(j)
    comp = {i: vectors[i][0] for i in range(n)}
    for _ in range(n):
        for i in range(n):
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    return sorted((vectors[i][0], len(links[i]), comp[i], comp[i] == vectors[i][0]) for i in range(n))


@pytest.mark.parametrize("tile", [7, 1000])
def test_against_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6))
    rows = []
    for i in range(90):
        v = centres[i % 8] + rng.normal(size=6) * 0.25 * (i % 5)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [(100 + i, rows[3][1]) for i in range(12)] + [(200, [2 * x for x in rows[3][1]])]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (304, [float("inf")] + [0.0] * 5), (305, [1.0, 2.0]), (306, [1.0, 2.0]), (307, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted(map(tuple, embedding_links(docs, tile=tile).collect()))
    assert got == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 16)) * rng.uniform(1e-3, 1e3, (200, 1))
    q, s, e = quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (np.linalg.norm(unit - q * s[:, None], axis=1) <= e).all()
    true = unit @ unit.T
    about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(true - about) <= e[:, None] + (1 + e[:, None]) * e + 1e-9).all()


def test_threshold_is_exact(spark):
    for t in (0.9 - 1e-13, 0.9 + 1e-13):
        docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [t, float(np.sqrt(1 - t * t))])], "vec_id long, embedding array<double>")
        assert {r.n_links for r in embedding_links(docs).collect()} == {int(t > 0.9)}


def test_only_open_vectors_are_fetched():
    """Codes settle all pairs but those within the bounds of the threshold."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 32))
    x[200:] = x[:200] + rng.normal(size=(200, 32)) * rng.uniform(0.05, 1.5, (200, 1))
    ones = np.ones(400, np.int64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true, seen, open_pairs = unit @ unit.T, set(), 0
    for a, b, sure in near_pairs(Codes.of(x, np.arange(400), ones), None, 0.9):
        assert (true[a[sure], b[sure]] >= 0.9).all() and (np.abs(true[a[~sure], b[~sure]] - 0.9) < 0.05).all()
        seen |= set(zip(a.tolist(), b.tolist(), strict=True))
        open_pairs += int((~sure).sum())
    assert {(i, j) for i in range(400) for j in range(i + 1, 400) if true[i, j] >= 0.9} <= seen and open_pairs < len(seen)


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert embedding_links(docs.limit(0)).count() == 0
    got = sorted(map(tuple, embedding_links(docs).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)], key=str)
