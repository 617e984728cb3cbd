"""Embedding near-dedup: int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import components, salted_left_join
from quillon.session import materialise, table

#: Vectors of a tile's side, and rows of a tile that are handled at once.
TILE, STRIP = 8192, 512
#: Above what rounding in double and exact integer products in single precision can add up to.
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the rows of x as (int8 codes, scales, bounds): |unit - scale * code| <= bound for each row."""
    peak = np.abs(x).max(1, keepdims=True)
    unit = x / peak
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None])
    rest = unit - code * scale[:, None]
    return code.astype(np.int8), scale, np.sqrt((rest * rest).sum(1)) * (1 + 1e-9) + 1e-12


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with the same rows of y, in double precision."""
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


class Codes:
    """Quantised vectors of a block: codes, scales, bounds, nodes and weights (how many rows are that vector)."""

    def __init__(self, code: np.ndarray, scale: np.ndarray, bound: np.ndarray, node: np.ndarray, weight: np.ndarray) -> None:
        self.code, self.scale, self.bound, self.node, self.weight = code, scale, bound, node, weight

    @classmethod
    def of(cls, x: np.ndarray, node: np.ndarray, weight: np.ndarray) -> Codes:
        return cls(*quantise(x), node, weight)


def near_pairs(x: Codes, y: Codes | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y (or of rows of x, the second later) that may reach the threshold, a strip at a time:
    (positions in x, positions in y, whether the pair is surely a link).

    With u = s*q + e for unit vectors, |u.v - s*t*(q.r)| <= |e| + (1 + |e|)|f|.  Pairs below the threshold by more than
    that are dropped and pairs above it by more than that are links; only the others are open.
    """
    own = y is None
    y = x if own else y
    exact = np.float32 if x.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(y.code.astype(exact).T)
    for lo in range(0, len(x.code), STRIP):
        s, e = x.scale[lo : lo + STRIP], x.bound[lo : lo + STRIP]
        product = (x.code[lo : lo + STRIP].astype(exact) @ right).astype(np.float64) * y.scale
        floor = (least - SLACK - e - (1 + e) * y.bound.max()) / s
        a, b = np.nonzero(product >= floor[:, None])
        if own:
            later = b > a + lo
            a, b = a[later], b[later]
        about, bound = product[a, b] * s[a], e[a] + (1 + e[a]) * y.bound[b]
        sure = about >= least + bound + SLACK
        may = about >= least - bound - SLACK
        yield a[may] + lo, b[may], sure[may]


class Links:
    """Counts of links per row of two blocks, and pairs of rows that connect what the links connect."""

    def __init__(self, x: Codes, y: Codes | None) -> None:
        self.x, self.y = x, y
        self.base = 0 if y is None else len(x.node)
        self.node = x.node if y is None else np.concatenate([x.node, y.node])
        self.weight = x.weight if y is None else np.concatenate([x.weight, y.weight])
        self.count = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))
        self.joins: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        b = b + self.base
        self.count += np.bincount(a, self.weight[b], len(self.node)).astype(np.int64)
        self.count += np.bincount(b, self.weight[a], len(self.node)).astype(np.int64)
        rows, first = np.unique(a, return_index=True)
        for row, at, to in zip(rows.tolist(), first.tolist(), np.append(first, len(a))[1:].tolist(), strict=True):
            roots = np.unique(np.append(self.label[b[at:to]], self.label[row]))
            for other in roots[1:].tolist():
                self.label[self.label == other] = roots[0]
                self.joins.append((int(roots[0]), other))

    def table(self, open_rows: np.ndarray, i: int, j: int) -> pa.Table:
        """Rows (u, v, n, i, j): counts of u, links u - v, and vectors u that are open in the pair of blocks (i, j)."""
        linked, ends = np.flatnonzero(self.count), np.array(self.joins, np.int64).reshape(-1, 2)
        u = np.concatenate([self.node[linked], self.node[ends[:, 0]], self.node[open_rows]])
        sizes = np.repeat([0, 1, 2], [len(linked), len(ends), len(open_rows)])
        v = np.concatenate([self.node[linked], self.node[ends[:, 1]], self.node[open_rows]])
        n = np.concatenate([self.count[linked], np.zeros(len(ends) + len(open_rows), np.int64)])
        where = {k: pa.array(np.full(len(u), b), mask=sizes != 2) for k, b in (("i", i), ("j", j))}
        return pa.table({"u": u, "v": pa.array(v, mask=sizes != 1), "n": pa.array(n, mask=sizes != 0), **where})


RESULT = "u long, v long, n long, i long, j long"


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, tile: int = TILE, salts: int = 16) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of vectors.

    Vectors link at a cosine of at least `least` (> 0), in double precision; only vectors of the same length are compared.
    n_links counts the other vectors linked directly, component_id is the smallest id that links reach, kept marks it.

    Equal vectors (by a 128-bit hash) are first reduced to one with a weight.  These are dealt by hash into blocks of about
    `tile`, quantised and packed into one row of codes, scales and bounds, and every pair of blocks is one task: an int8
    product, of which the error bounds settle nearly all pairs.  Vectors with a pair left open are named; only they are
    fetched in full precision, once for each pair of blocks in which they are open, and only the open pairs are computed
    again.  Tasks return a count per vector and a spanning forest of the links, never the pairs.  The comparisons grow with
    the square of the different vectors, the codes moved with that over `tile`.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, like rows with a null
    id; they are kept.  Repeated rows link with each other.  Other columns are ignored.  No rows give no rows.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.col("_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    all_rows = vectors.select(F.col(id_col).cast("long").alias("_id"), vec_col).withColumn("v", F.when(fine, v))
    all_rows = all_rows.select("_id", "v", *(F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "v")).alias(f"d{k}") for k in (1, 2)))
    nodes = all_rows.where("v IS NOT NULL").groupBy("d1", "d2").agg(F.min("_id").alias("node"), F.count("*").alias("w"), F.any_value("v").alias("v"))
    nodes = materialise(nodes.withColumn("dim", F.size("v").cast("long")), "vectors")
    blocks = max(1, -(-nodes.count() // tile))
    placed = nodes.withColumn("block", F.pmod("d1", F.lit(blocks)))

    def matrix(rows: pa.Table) -> np.ndarray:
        return rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def gather(rows: pa.Table) -> pa.Table:
        code, scale, bound = quantise(matrix(rows))
        part = {"dim": rows.column("dim")[:1], "block": rows.column("block")[:1]}
        for name, values in (("code", code), ("scale", scale), ("bound", bound), ("node", rows.column("node").to_numpy()), ("weight", rows.column("w").to_numpy())):
            part[name] = pa.array([values.tobytes()], pa.binary())
        return pa.table(part)

    packed = materialise(
        placed.groupBy("dim", "block").applyInArrow(gather, "dim long, block long, code binary, scale binary, bound binary, node binary, weight binary"), "blocks"
    )

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key)
        sides = []
        for r in sorted(rows.to_pylist(), key=lambda r: r["block"]):
            doubles = (np.frombuffer(r[c], np.float64) for c in ("scale", "bound"))
            sides.append(Codes(np.frombuffer(r["code"], np.int8).reshape(-1, dim), *doubles, *(np.frombuffer(r[c], np.int64) for c in ("node", "weight"))))
        x, y = sides[0], sides[1] if len(sides) > 1 else None
        links = Links(x, y)
        is_open = np.zeros(len(links.node), bool)
        if y is not None or i == j:  # (else its partner is an empty block)
            for a, b, sure in near_pairs(x, y, least):
                links.add(a[sure], b[sure])
                is_open[a[~sure]] = True
                is_open[b[~sure] + links.base] = True
        return links.table(np.flatnonzero(is_open), i, j)

    def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        x, block = matrix(rows), rows.column("block").to_numpy()
        node, weight = rows.column("node").to_numpy(), rows.column("w").to_numpy()
        parts = [(x[m], Codes.of(x[m], node[m], weight[m])) for m in ([block == i] if i == j else [block == i, block == j])]
        (vx, cx), (vy, cy) = parts[0], parts[1] if i != j else (parts[0][0], None)
        links = Links(cx, cy)
        for a, b, sure in near_pairs(cx, cy, least):
            a, b = a[~sure], b[~sure]
            good = np.zeros(len(a), bool)
            for s in range(0, len(a), 1 << 15):
                good[s : s + (1 << 15)] = cosines(vx[a[s : s + (1 << 15)]], vy[b[s : s + (1 << 15)]]) >= least
            links.add(a[good], b[good])
        return links.table(np.empty(0, np.int64), i, j)

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sure = materialise(
        packed.select("*", other.alias("other"))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("other")
        .groupBy("dim", "i", "j")
        .applyInArrow(compare, RESULT),
        "links",
    )
    again = sure.where("i IS NOT NULL").select(F.col("u").alias("node"), "i", "j").join(placed.select("node", "dim", "block", "v", "w"), "node")
    settled = materialise(again.groupBy("dim", "i", "j").applyInArrow(settle, RESULT), "links")
    found = sure.unionByName(settled)
    parts = components(found.where("v IS NOT NULL").select("u", "v"))
    counts = found.where("n IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    known = (
        nodes.select("d1", "d2", "node", "w")
        .join(counts, "node", "left")
        .join(parts, "node", "left")
        .select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    return salted_left_join(all_rows.select("_id", "d1", "d2"), known, ["d1", "d2"], F.col("_id"), salts).select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce("component_id", "_id").eqNullSafe(F.col("_id")).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x != 0))
                 THEN embedding::DOUBLE[] END AS v
  FROM embeddings
), l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM e a, e b WHERE a.vec_id != b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (
  SELECT vec_id, vec_id AS reach FROM e
  UNION
  SELECT r.vec_id, l.w FROM r JOIN l ON r.reach = l.u
), c AS (
  SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c ON c.vec_id = e.vec_id
"""
