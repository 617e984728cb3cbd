"""Manifests against a plain tree, the exchange against the top-down proofs, and folding by proofs alone."""

from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillon.llm.merkle import butterfly, folded, merkle_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string, proof string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """The root and the proof (place, siblings) of each node."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % fanout : k - k % fanout + fanout]
            proofs[i].append((k % fanout, run[: k % fanout] + run[k % fanout + 1 :]))
        at = [k // fanout for k in at]
        nodes = [H(*nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plainly(rows, fanout):
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    groups = [sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for _, g in groupby(sorted(rows, key=key), key)]
    trees = [tree([leaf(r) for r in g], fanout) for g in groups]
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, proofs), up in zip(groups, trees, above, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            cur = leaf(r) if r[0] is None or crc32(str(r[0]).encode()) % 3 else leaf((*r[:4], low(r[4])))
            for place, siblings in proof + up:
                cur = H(*siblings[:place], cur, *siblings[place:])
            out.append((r[0], r[2], leaf(r), subroot, root, H(*(s for _, x in proof + up for s in x)), cur, cur == root))
    return out


def manifest(docs, **args):
    bent = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest(docs, COLUMNS, altered={"text": low}, tampered=bent, **args)


def odd_rows(n=120):
    rows = [(i, "s" if i % 3 else None, (None, "en", "de", "é", "")[min(i % 7, 4)], i, f"Text {i}" if i % 5 else None) for i in range(n)]
    return [(*r, 1, "x", "y") for r in [*rows, rows[4], rows[4], (None, None, None, None, None), (None, "q", "only", 2, "ONE"), (3, "s", "en", 9, "other text of an id"), (8, "ü:", "€", 1, "Ü" * 40_000)]]


@pytest.mark.parametrize(("fanout", "height"), [(2, 1), (2, 3), (3, 2), (8, 4)])
def test_manifest_equals_a_plain_tree(spark, fanout, height):
    rows = odd_rows()
    got = manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, height=height).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plainly(rows, fanout)))
    changed = [r for r in got if not r["verified"]]
    assert changed and all(crc32(str(r["doc_id"]).encode()) % 3 == 0 for r in changed)


def test_proofs_fold_to_the_root(spark):
    got = manifest(spark.createDataFrame(odd_rows(40), SCHEMA), fanout=2, height=2, with_proofs=True).collect()
    for r in got:
        proof = [x.asDict() for x in r["proof"]]
        assert folded(r["leaf"], proof) == r["root"]
        assert H(*(s for x in proof for s in x["siblings"])) == r["proof_sha256"]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 27, 65])
def test_exchange_gives_each_node_its_whole_proof(spark, n):
    nodes = [H(str(i)) for i in range(n)]
    rows = [(t, i, n, d) for t in (0, 5) for i, d in enumerate(nodes)] + [(7, 0, 1, "alone")]
    root, proofs = tree(nodes, 3)
    for r in butterfly(spark.createDataFrame(rows, "tree long, block long, n long, digest string"), 3).collect():
        if r["tree"] == 7:
            assert r["top"] == "alone" and r["proof"] == []
            continue
        assert r["top"] == root
        assert [(x["place"], x["siblings"]) for x in r["proof"]] == proofs[r["block"]]


def test_one_row_and_none(spark):
    one = manifest(spark.createDataFrame([(1, None, None, None, None, 1, "x", "y")], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == H("1:1----") and one["proof_sha256"] == H() and one["verified"]
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
