"""Merkle manifests of datasets: aligned blocks of leaves acquire their upper proofs by a butterfly exchange."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import salted_left_join
from quillon.operators.splits import exact_rank
from quillon.session import discard, materialise, table

PROOF = "array<struct<place:int,siblings:array<string>>>"


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as `-` if null, else its UTF-8 byte count, a colon and the value."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(nodes: list[str] | list[bytes]) -> str:
    """The digest of digests in hexadecimal."""
    return sha256(b"".join(n if isinstance(n, bytes) else n.encode() for n in nodes)).hexdigest()


def folded(start: str, proof: list[dict]) -> str:
    """The root that a leaf and its proof (place in its run, siblings; level by level) lead to."""
    for level in proof:
        siblings = list(level["siblings"])
        siblings.insert(level["place"], start)
        start = hashed(siblings)
    return start


def levels(nodes: list[bytes], fanout: int, height: int | None) -> list[list[bytes]]:
    """The levels of digests over an aligned run of leaves: `height` times every `fanout` become one, or until one remains."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([hashed(below[i : i + fanout]).encode() for i in range(0, len(below), fanout)])
    return out


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds proof (level by level the place among the node's run and its siblings) and top (the tree's last digest) to
    nodes (tree, block, n, digest), the n nodes of a tree being numbered from 0.

    In round r a node knows its ancestor of level r.  Aligned groups of `fanout` ancestors swap them: node b meets those
    nodes of the sibling subtrees whose number agrees with b in the lower r digits, so each meets at most fanout - 1 others,
    hashes its next ancestor itself and keeps the siblings.  After the last round all nodes hold the top and their whole
    proof, without a way back down.  The last subtree of a level may lack nodes: those that it has answer for the missing
    ones in turn.  Trees that have come to their top wait for the others.  Each round is one exchange, and is written.
    """
    state = materialise(nodes.select("tree", "block", "n", "digest", F.array().cast(PROOF).alias("proof")), "round")
    most = state.agg(F.max("n")).first()[0] or 0
    step = 1
    while step < most:
        open_ = F.col("n") > step
        ancestor = F.floor(F.col("block") / F.lit(step))
        at = {"group": F.floor(ancestor / fanout), "place": F.pmod(ancestor, F.lit(fanout)).cast("int"), "low": F.pmod("block", F.lit(step))}
        placed = state.withColumns(at)
        there = F.least(F.lit(step).cast("long"), F.col("n") - ancestor * step)  # nodes of the ancestor's subtree
        sent = placed.where(open_).select("tree", "group", F.explode(F.sequence("low", F.lit(step - 1).cast("long"), there)).alias("low"), "place", "digest")
        met = sent.groupBy("tree", "group", "low").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))  # at most fanout
        joined = placed.join(met, ["tree", "group", "low"], "left")
        siblings = F.transform(F.filter("run", lambda x: x["place"] != F.col("place")), lambda x: x["digest"])
        level = F.array(F.struct(F.col("place").alias("place"), siblings.alias("siblings")))
        digest = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), "").cast("binary"), 256)
        last, state = state, materialise(
            joined.select(
                "tree", "block", "n", F.when(open_, digest).otherwise(F.col("digest")).alias("digest"),
                F.when(open_, F.concat("proof", level)).otherwise(F.col("proof")).cast(PROOF).alias("proof"),
            ),
            "round",
        )
        discard(last)
        step *= fanout
    return state.withColumnRenamed("digest", "top")


def _block_digest(fanout: int, height: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        n = rows.column("n")[0].as_py()
        nodes = [x.as_py().hex().encode() for x in rows.column("leaf")]
        top = levels(nodes, fanout, height if n > fanout**height else None)[-1][0].decode()
        return pa.table({"tree": rows.column("tree")[:1], "block": rows.column("block")[:1], "n": pa.array([-(-n // fanout**height)], pa.int64()), "digest": pa.array([top])})

    return run


def _prove(fanout: int, height: int, with_proofs: bool):
    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        n = rows.column("n")[0].as_py()
        found = upper.to_pylist()[0]
        nodes = [x.as_py().hex().encode() for x in rows.column("leaf")]
        local = levels(nodes, fanout, height if n > fanout**height else None)[:-1]
        above = [(b"".join(s[:p]), b"".join(s[p:])) for p, s in ((x["place"], [d.encode() for d in x["siblings"]]) for x in found["proof"])]
        sides = [[(b"".join(a[k - k % fanout : k]), b"".join(a[k + 1 : k - k % fanout + fanout])) for k in range(len(a))] for a in local]
        rest = b"".join(x + y for x, y in above)
        proofs, roots, whole = [], [], []
        for i, (node, bent) in enumerate(zip(nodes, rows.column("bent").to_pylist(), strict=True)):
            path, k = [], i
            for level in sides:
                path.append(level[k])
                k //= fanout
            proofs.append(sha256(b"".join(x + y for x, y in path) + rest).hexdigest())
            start = node if bent is None else bent.hex().encode()
            for before, after in (*path, *above):
                start = sha256(before + start + after).hexdigest().encode()
            roots.append(start.decode())
            if with_proofs:
                cut = lambda side: [side[j : j + 64].decode() for j in range(0, len(side), 64)]
                whole.append([{"place": len(x) // 64, "siblings": cut(x) + cut(y)} for x, y in path] + found["proof"])
        m = len(nodes)
        out = {
            "_id": rows.column("_id"), "by": rows.column("by"), "leaf": pa.array([x.decode() for x in nodes]), "subroot": pa.array([found["subroot"]] * m), "root": pa.array([found["root"]] * m),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(roots), "verified": pa.array([r == found["root"] for r in roots]),
        }
        if with_proofs:
            out["proof"] = pa.array(whole, pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))])))
        return pa.table(out)

    return run


def merkle_manifest(
    docs: DataFrame, columns: list[str], by: str = "lang", id_col: str = "doc_id", fanout: int = 8, height: int = 4, altered: dict[str, Column] | None = None,
    tampered: Column | None = None, with_proofs: bool = False,
) -> DataFrame:
    """Rows (id, by, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]), one per row of docs.

    A row's leaf is the digest of `columns`; the leaves of each value of `by`, in the order of their ids, are a tree in which every
    `fanout` consecutive nodes (in a level's last run fewer) are hashed to one until one remains, the subroot; the subroots, in
    the order of `by`, null first, are a tree likewise.  A leaf's proof is the siblings of its run, level by level up to the
    root.  Rows for which `tampered` is true are verified with the leaf of the `altered` columns: that leaf, or the row's own,
    is folded with the proof and compared with the root.

    Leaves are dealt to aligned blocks of fanout ** height of one tree, which hash their own levels; only block digests, one
    row of some thousand leaves, go through the butterfly exchange.  So one value of `by` may hold any share of the rows.

    Null values, ids and trees have leaves and trees of their own (null ids come first); rows that repeat an id are ordered by
    their leaves.  A tree of one leaf has that leaf as subroot; a single tree's subroot is the root.  Very long texts are hashed
    in the JVM, where they are; other columns are ignored.  No rows give no rows.
    """
    new = altered or {}
    own = leaf([F.col(f"`{c}`") for c in columns])
    bent = F.when(tampered, leaf([new.get(c, F.col(f"`{c}`")) for c in columns])) if tampered is not None else F.lit(None).cast("string")
    of = F.col(by).cast("string")
    leaves = materialise(
        docs.select(F.col(id_col).alias("_id"), of.isNotNull().alias("known"), F.coalesce(of, F.lit("")).alias("by"), F.unhex(own).alias("leaf"), F.unhex(bent).alias("bent")), "leaves"
    )
    ranked = exact_rank(leaves, ["known", "by", "_id", "leaf"], "at")
    trees = materialise(exact_rank(ranked.groupBy("known", "by").agg(F.min("at").alias("first"), F.count("*").alias("n")), ["known", "by"], "tree"), "trees")
    size = fanout**height
    row = F.col("at") - F.col("first")
    dealt = salted_left_join(ranked, trees, ["known", "by"], F.col("at"))
    dealt = dealt.select("tree", "n", F.floor(row / size).alias("block"), F.pmod(row, F.lit(size)).alias("row"), "_id", F.when(F.col("known"), F.col("by")).alias("by"), "leaf", "bent")
    dealt = materialise(dealt, "dealt")
    discard(leaves)
    digests = dealt.select("tree", "block", "n", "row", "leaf").groupBy("tree", "block").applyInArrow(_block_digest(fanout, height), "tree long, block long, n long, digest string")
    blocks = butterfly(digests, fanout)
    count = trees.count()
    tops = butterfly(blocks.where("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("block"), F.lit(count).cast("long").alias("n"), F.col("top").alias("digest")), fanout)
    above = tops.select(F.col("block").alias("tree"), F.col("proof").alias("last"), F.col("top").alias("root"))
    upper = salted_left_join(blocks, above, ["tree"], F.col("block")).select("tree", "block", F.concat("proof", "last").alias("proof"), F.col("top").alias("subroot"), "root")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, by string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {PROOF}" * with_proofs
    out = dealt.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(_prove(fanout, height, with_proofs), schema)
    return out.withColumnRenamed("by", by).withColumnRenamed("_id", id_col)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return merkle_manifest(docs, COLUMNS, altered={"text": lower}, tampered=tampered).drop("lang")


def _sql(deepest: int = 7, trees: int = 2) -> str:
    """One step per level: nodes, runs and what a leaf's fold and proof become there."""
    ctes = [
        "d AS (SELECT row_number() OVER () AS r, * FROM documents)",
        "c AS (SELECT r, doc_id, lang, "
        + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in COLUMNS[:-1])
        + " AS head, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),"
        " lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM d)",
        "l AS (SELECT r, doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,"
        " CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||"
        " translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS bent FROM c)",
        "p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l)",
        "n0 AS (SELECT tree, pos, leaf AS h FROM p)",
        "f0 AS (SELECT r, tree, pos, coalesce(bent, leaf) AS h, '' AS proof FROM p)",
    ]

    def level(k: int, n: str, f: str, out_n: str, out_f: str) -> None:
        ctes.append(
            f"r{k} AS (SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS m, pos // 8 AS up,"
            f" coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,"
            f" coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {n})"
        )
        ctes.append(f"{out_n} AS (SELECT DISTINCT tree, up AS pos, CASE WHEN m > 1 THEN sha256(a || h || b) ELSE h END AS h FROM r{k})")
        ctes.append(
            f"{out_f} AS (SELECT f.r, f.tree, r.up AS pos, CASE WHEN m > 1 THEN sha256(a || f.h || b) ELSE f.h END AS h, CASE WHEN m > 1 THEN proof || a || b ELSE proof END AS proof"
            f" FROM {f} f JOIN r{k} r ON f.tree = r.tree AND f.pos = r.pos)"
        )

    for k in range(deepest):
        level(k, f"n{k}", f"f{k}", f"n{k + 1}", f"f{k + 1}")
    top = deepest + 1
    ctes.append(f"n{top} AS (SELECT 0 AS tree, tree AS pos, h FROM n{deepest})")
    ctes.append(f"f{top} AS (SELECT r, 0 AS tree, tree AS pos, h, proof FROM f{deepest})")
    for k in range(top, top + trees):
        level(k, f"n{k}", f"f{k}", f"n{k + 1}", f"f{k + 1}")
    end = top + trees
    return (
        "WITH " + ",\n".join(f"{c[: c.index(' AS ')]} AS MATERIALIZED {c[c.index(' AS ') + 4 :]}" for c in ctes) + f"\nSELECT doc_id, leaf, s.h AS subroot, t.h AS root,"
        f" sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified FROM p JOIN f{end} f ON p.r = f.r JOIN n{deepest} s ON s.tree = p.tree CROSS JOIN n{end} t"
    )


SQL = _sql()
