import hashlib
import re

from pyspark.sql import functions as F

from quillon.llm.common import components
from quillon.llm.exact_dedup import chunks, exact_dedup
from quillon.llm.mixing import mix

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, len(t or "")))
    out = []
    for i, t in rows:
        g = groups[SPACE.sub("", t or "")]
        keep, n = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out.append((i, keep, len(g), i == keep and len(t or "") == n, hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, "\t\n"), (7, "x" * 9000), (8, "x" * 8999 + "y"), (9, " ".join("x" * 9000)), (9, " ".join("x" * 9000)), (None, "ab"), (10, "é ß"), (11, "é  ß"), (12, "héllo wörld " * 400), (13, "héllo wörld" * 400)]


def test_exact_dedup_edges_and_forced_collisions(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, kept int")
    for hashing in (F.xxhash64, lambda c: F.length(c).cast("long") % 7):
        got = exact_dedup(docs, chunk_hash=hashing)
        assert sorted(map(tuple, got.drop("n_chars").collect()), key=str) == brute_dedup(ROWS)
        assert sorted(((r.doc_id, r.n_chars) for r in got.collect()), key=str) == sorted(((i, len(t or "")) for i, t in ROWS), key=str)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_chunks_make_up_the_text(spark):
    texts = ["", "a" * 10_000, "some words here " * 2000, "日本語テキスト" * 1000, "he\nwe" * 600]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.t and all(len(c) <= 4096 for c in r.c)


def test_mixing_properties(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{min(i % 9, 4)}" if i % 13 else None, 0) for i in range(4000)]
    rows += [(5000, None, "empty", 0), (5001, "", "empty", 0), (7, "w w", "s1", 0)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    total, by = sum(r.size for r in got), {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    names = sorted((k for k in by if k is not None)) + [None]
    weights = dict(zip(names, [5, 2, 1] * 9, strict=False))
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    free, left, target = set(by), 1.5 * total, {}
    while True:
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] >= 2 * size[k]]
        if not over:
            break
        for k in over:
            target[k] = 2.0 * size[k]
            left -= target[k]
            free.remove(k)
    target |= share
    for k, v in by.items():
        assert abs(v[0].target - target[k]) < 1e-6 * max(1, target[k])
        assert abs(sum(r.taken for r in v) - target[k]) <= max(r.size for r in v)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix(blank).collect()] == [(0, 0.0)] * 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100: 90, 95: 90} | {200 + i: 200 for i in range(1, 50)}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
