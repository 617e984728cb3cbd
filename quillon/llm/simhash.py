"""SimHash near-dedup: a self-join of binary tries under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import components, salted_left_join
from quillon.session import materialise, table

LOWER = bytes(range(256)).lower()
#: Distinct fingerprints that one trie may hold before its node pairs are dealt out to several tasks.
LARGE_TRIE = 50_000
#: Node pairs handled at once; small ones stand for 16 pairs of positions each.
FRONTIER = 1 << 16
#: Bytes of a MinHash sketch.
BINS = 16


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of n words joined by spaces, repeats included; fewer words: of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(1, len(words) - n + 1)
    digest = xxhash.xxh64_intdigest
    first, final = starts[:last].tolist(), ends[min(n, len(words)) - 1 :].tolist()
    return np.fromiter((digest(text[a:b], seed) for a, b in zip(first, final, strict=True)), np.uint64, last)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """One permutation MinHash: of each of 16 classes of hashes, a byte of the least (an empty class takes its neighbour's)."""
    if not len(hashes):
        return bytes(BINS)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)  # (wraps)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (mixed >> np.uint64(60)).astype(np.int64), mixed & np.uint64((1 << 60) - 1))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    where = full[np.searchsorted(full, np.arange(BINS)) % len(full)]
    return ((least[where] * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(56)).astype(np.uint8).tobytes()


def parities(found: np.ndarray) -> bytes:
    """Of a set of hashes its size (8 bytes) and, in about one bit per element, the parity of each class of hashes.

    Classes are hashes modulo a power of two, so parities of more classes fold into those of fewer.  Two sets differ in at
    least as many elements as their parities.
    """
    classes = 1 << min(16, max(6, int(len(found) - 1).bit_length())) if len(found) else 64
    bits = np.bincount(((found >> np.uint64(13)) % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return len(found).to_bytes(8, "little") + np.packbits(bits.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> tuple[int, int, int]:
    """(size of one set, of the other, a lower bound of the number of elements that only one has) from their parities."""
    x, y = np.frombuffer(a, np.uint8, offset=8), np.frombuffer(b, np.uint8, offset=8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little"), int(np.bitwise_count(x ^ y).sum())


def _fingerprints(n: int, seeds: tuple[int, ...], as_set: bool, verify: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, marks, whole, signs = [], [], [], []
            for raw in batch.column("_text").cast(pa.binary()).to_pylist():
                words = (raw or b"").translate(LOWER).split()
                used = sorted(set(words)) if as_set else words
                prints.append([np.uint64(majority(shingle_hashes(used, n, s))).astype(np.int64) for s in seeds])
                found = np.unique(shingle_hashes(words, verify)) if verify else np.empty(0, np.uint64)
                marks.append(sketch(found) if verify else b"")
                whole.append(xxhash.xxh128_digest(found.tobytes()) if verify else b"")
                signs.append(parities(found) if verify else b"")
            kept = [c for c in batch.schema.names if c != "_text"]
            made = [pa.array(prints, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (marks, whole, signs))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "fps", "mark", "whole", "signs"])

    return run


class _Forest:
    """Union-find over positions; keeps the links that join two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, pairs_a: np.ndarray, pairs_b: np.ndarray) -> None:
        for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((a, b))


def trie_links(values: np.ndarray, groups: list[tuple[int, int, int, int]], start: int, budget: int, alike, bands: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among values, sorted 64-bit numbers whose ranges of a common prefix are trie nodes.

    groups are node pairs (from, to, from, to) to begin with; a node with itself stands for the pairs inside it.  Pairs of
    nodes go down together bit by bit; a pair whose paths differ in more than `budget` bits is dropped with all below it.
    alike(i, j) confirms candidate positions; of positions that it confirms, at least one column of bands is equal (None:
    nothing is known).  A node pair at depth d has at most the sum of C(d, 0..budget) partners, so
    the work for distinct values grows with their number even if all lie close together.
    """
    forest = _Forest(len(values))
    ones = {}
    stack = [(start, np.array(groups, np.int64).reshape(-1, 4), np.zeros(len(groups), np.int8))]
    while stack:
        level, pairs, used = stack.pop()
        if len(pairs) > FRONTIER:
            for i in range(0, len(pairs), FRONTIER):
                stack.append((level, pairs[i : i + FRONTIER], used[i : i + FRONTIER]))
            continue
        same = pairs[:, 0] == pairs[:, 2]
        sizes = (pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2])
        live = np.where(same, sizes[0] > 1, (sizes[0] > 0) & (sizes[1] > 0)) & (used <= budget)
        pairs, used, same = pairs[live], used[live], same[live]
        if not len(pairs):
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
        if level == 64:
            for lo, hi, _, _ in pairs[same & ~small].tolist():
                _reach(forest, np.arange(lo, hi), None, alike, bands)
            near = np.bitwise_count(values[pairs[:, 0]] ^ values[pairs[:, 2]]) <= budget
            for lo, hi, low, high in pairs[~same & ~small & near].tolist():
                _reach(forest, np.arange(lo, hi), np.arange(low, high), alike, bands)
        if small.any():
            a, b = _expand(pairs[small], same[small])
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            a, b = a[near], b[near]
            good = alike(a, b)
            forest.join(a[good], b[good])
        if level == 64:
            continue
        pairs, used, same = pairs[~small], used[~small], same[~small]
        if not len(pairs):
            continue
        if level not in ones:
            bit = (values >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        count = ones[level]
        a0, a1, b0, b1 = pairs.T
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        cross = ~same & (used < budget)
        once = used < budget
        parts = [
            (np.stack([a0, am, b0, bm], 1), used),
            (np.stack([am, a1, bm, b1], 1), used),
            (np.stack([a0, am, bm, b1], 1)[once], used[once] + 1),
            (np.stack([am, a1, b0, bm], 1)[cross], used[cross] + 1),
        ]
        stack.append((level + 1, np.concatenate([p for p, _ in parts]), np.concatenate([u for _, u in parts])))
    return forest.links


def _expand(pairs: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions (i, j) of small node pairs; i < j inside a node."""
    width = pairs[:, 3] - pairs[:, 2]
    total = (pairs[:, 1] - pairs[:, 0]) * width
    which = np.repeat(np.arange(len(pairs)), total)
    k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    a = pairs[which, 0] + k // width[which]
    b = pairs[which, 2] + k % width[which]
    keep = ~same[which] | (a < b)
    return a[keep], b[keep]


def _reach(forest: _Forest, left: np.ndarray, right: np.ndarray | None, alike, bands: np.ndarray | None = None) -> None:
    """Links within positions of one value (right None), or between those of two values, until nothing more is reached.

    Whatever has been reached is compared once with what has not been (between two values: on the other side) and agrees
    with it in a band, so no link between two components is passed over, and positions that are alike in nothing cost no
    comparison.
    """
    turn = 0 if right is None else 1
    sides = [left, left if right is None else right][: turn + 1]
    if turn and len({forest.root(j) for side in sides for j in side.tolist()}) == 1:
        return
    low = [int(side[0]) for side in sides]
    waiting = [np.ones(len(side), bool) for side in sides]
    sorted_bands = []
    if bands is not None:
        for side in sides:
            order = [np.argsort(bands[side, b], kind="stable") for b in range(bands.shape[1])]
            sorted_bands.append([(o, bands[side[o], b]) for b, o in enumerate(order)])

    def partners(i: int, side: int) -> np.ndarray:
        if bands is None:
            return np.flatnonzero(waiting[side])
        near = []
        for b, (order, values) in enumerate(sorted_bands[side]):
            lo, hi = np.searchsorted(values, bands[i, b], "left"), np.searchsorted(values, bands[i, b], "right")
            near.append(order[lo:hi])
        near = np.unique(np.concatenate(near))
        return near[waiting[side][near]]

    for first in left.tolist():
        if not waiting[0][first - low[0]]:
            continue
        waiting[0][first - low[0]] = False
        queue = [(0, first)]
        while queue:
            side, i = queue.pop()
            other = side ^ turn
            part = partners(i, other) + low[other]
            good = alike(np.full(len(part), i), part)
            found = part[good]
            waiting[other][found - low[other]] = False
            forest.join(np.full(len(found), i), found)
            queue.extend((other, j) for j in found.tolist())


def sketch_bands(marks: np.ndarray, least: float) -> np.ndarray:
    """Numbers of runs of bytes of each sketch, of which two sketches that agree in a share of `least` have one in common."""
    bins = marks.shape[1]
    count = bins - int(np.ceil(least * bins - 1e-9)) + 1
    edges = [bins * i // count for i in range(count + 1)]
    out = np.zeros((len(marks), count), np.int64)
    for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        for c in range(lo, min(hi, lo + 8)):
            out[:, b] = (out[:, b] << 8) | marks[:, c]
    return out


def _rotations(budget: int) -> list[tuple[int, int]]:
    """(left rotation, width) of the blocks, one more than the budget, of which two close fingerprints share one."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _traverse(budget: int, least: float):
    rotations = _rotations(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if data is None or not data.num_rows:
            return
        col = lambda c: data.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        f, r, p, q, fp, node = (col(c) for c in ("f", "r", "p", "q", "fp", "node"))
        marks = np.array([])
        if least > 0:
            marks = np.frombuffer(b"".join(data.column("mark").to_pylist()), np.uint8).reshape(-1, BINS)
        us, vs = [], []
        for rot, (left, width) in enumerate(rotations):
            rows = np.flatnonzero(r == rot)
            if not len(rows):
                continue
            x = fp[rows].astype(np.int64).view(np.uint64)
            x = (x << np.uint64(left)) | (x >> np.uint64(64 - left)) if left else x
            order = np.lexsort((x, q[rows], p[rows], x >> np.uint64(64 - width), f[rows]))
            rows, x = rows[order], x[order]
            key = np.stack([f[rows], p[rows], q[rows], (x >> np.uint64(64 - width)).astype(np.int64)])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(rows)]])
            groups = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                a, b = int(p[rows[lo]]), int(q[rows[lo]])
                if a == b:
                    groups.append((lo, hi, lo, hi))
                else:  # two nodes of a large trie, side by side
                    depth, code = b >> 32, b & 0xFFFFFFFF
                    own = (x[lo:hi] >> np.uint64(64 - width - depth)) & np.uint64((1 << depth) - 1)
                    mid = lo + int(np.searchsorted(own, np.uint64(code)))
                    groups.append((lo, mid, mid, hi))
            m = marks[rows] if least > 0 else None
            bands = sketch_bands(m, least) if least > 0 else None

            def alike(i: np.ndarray, j: np.ndarray, m=m) -> np.ndarray:
                if m is None:
                    return np.ones(len(i), bool)
                same = np.empty(len(i), bool)
                for s in range(0, len(i), 1 << 16):
                    same[s : s + (1 << 16)] = (m[i[s : s + (1 << 16)]] == m[j[s : s + (1 << 16)]]).mean(1) >= least
                return same

            for a, b in trie_links(x, groups, width, budget, alike, bands):
                us.append(int(node[rows[a]]))
                vs.append(int(node[rows[b]]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, budget: int = 2, seeds: tuple[int, ...] = (42,),
    as_set: bool = False, verify: int = 0, least: float = 0.0, salts: int = 16,
) -> DataFrame:
    """Rows (id, fingerprint, component_id), one per row of docs.

    Texts are lower-cased (A-Z) and cut into words at white space; a fingerprint bit is set if over half of the hashes of
    the n-word shingles (with as_set: of the distinct words in order) have it.  Documents link if the fingerprints of one
    of the seeds differ in at most `budget` bits and, with verify > 0, the MinHash sketches of their verify-word shingles
    agree in a share of at least `least`.  component_id is the smallest id that links reach.

    Equal fingerprints are first reduced to one node.  Of two close fingerprints, one of budget + 1 blocks of bits agrees;
    for each block the fingerprints are rotated to begin with it, so that all links lie inside tries whose root is that
    block's value, and each task joins its tries with themselves.  A root with over LARGE_TRIE fingerprints is opened
    further down, and its pairs of nodes (within the budget) are dealt to different tasks.  Tasks return spanning forests.

    Null and blank texts have fingerprint zero and link like any other.  Null ids: such rows take the component of the
    smallest id with their fingerprint, null if there is none.  Repeated rows fall into one component.
    """
    prints, nodes, links = simhash_links(docs, id_col, text_col, n, budget, seeds, as_set, verify, least, salts)
    parts = components(links)
    found = nodes.join(parts, "node", "left").select("fps", "mark", F.coalesce("component", "node").alias("component_id"))
    return salted_left_join(prints, found, ["fps", "mark"], F.col("_id"), salts).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex(F.element_at("fps", 1)), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def simhash_links(
    docs: DataFrame, id_col: str, text_col: str, n: int, budget: int, seeds: tuple[int, ...], as_set: bool, verify: int, least: float, salts: int = 16, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (_id, carried columns, fps, mark, whole, signs) of docs, (fps, mark, node) of the different ones, and links
    (u, v) that span their components.  `whole` is a 128-bit hash of the set of the verify-word shingles, `signs` its parities."""
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    prints = materialise(
        docs.select(F.col(id_col).cast("long").alias("_id"), *carry, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(
            _fingerprints(n, seeds, as_set, verify), f"_id long, {kinds}fps array<long>, mark binary, whole binary, signs binary"
        ),
        "prints",
    )
    nodes = materialise(prints.groupBy("fps", "mark").agg(F.min("_id").alias("node")), "nodes")
    rotations = _rotations(budget)
    block = F.lit(None).cast("long")
    for i, (left, width) in enumerate(rotations):
        block = F.when(F.col("r") == i, F.shiftrightunsigned("fp", 64 - left - width).bitwiseAND((1 << width) - 1)).otherwise(block)
    rows = (
        nodes.where("node IS NOT NULL")
        .select("node", "mark", F.posexplode("fps").alias("f", "fp"))
        .withColumn("r", F.explode(F.array(*map(F.lit, range(len(rotations))))))
        .withColumn("block", block)
    )
    large = materialise(rows.groupBy("f", "r", "block").count().where(F.col("count") > LARGE_TRIE), "large")
    if large.take(1):
        rows = _opened(rows, large, rotations, budget, salts)
    else:
        rows = rows.withColumn("p", F.lit(0).cast("long")).withColumn("q", F.lit(0).cast("long"))
    links = rows.repartition("f", "r", "block", "p", "q").select("f", "r", "p", "q", "fp", "node", "mark").mapInArrow(_traverse(budget, least), "u long, v long")
    return prints, nodes, links


def _opened(rows: DataFrame, large: DataFrame, rotations: list[tuple[int, int]], budget: int, salts: int) -> DataFrame:
    """Rows of large tries, repeated for each pair of nodes, at a depth chosen by size, that they belong to."""
    from itertools import combinations

    spark = rows.sparkSession
    masks = [(d, sum(1 << i for i in bits)) for d in range(1, 13) for k in range(budget + 1) for bits in combinations(range(d), k)]
    masks = F.broadcast(spark.createDataFrame(masks, "depth int, mask long"))
    large = large.withColumn("depth", F.least(F.lit(12), F.ceil(F.log2(F.col("count") / LARGE_TRIE)) + 1).cast("int")).drop("count")
    joined = salted_left_join(rows, large, ["f", "r", "block"], F.col("fp"), salts)
    after = F.lit(None).cast("long")  # the 12 bits after the block
    for i, (left, width) in enumerate(rotations):
        turn = (left + width) % 64
        turned = F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn)) if turn else F.col("fp")
        after = F.when(F.col("r") == i, F.shiftrightunsigned(turned, 52)).otherwise(after)
    tag = F.shiftleft(F.col("depth").cast("long"), 32)
    cut = (
        joined.where("depth IS NOT NULL")
        .withColumn("after", after)
        .join(masks, "depth")
        .withColumn("own", F.expr("shiftright(after, 12 - depth)"))
        .withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
        .withColumn("p", tag + F.least("own", "other"))
        .withColumn("q", tag + F.greatest("own", "other"))
    )
    whole = joined.where("depth IS NULL").withColumn("p", F.lit(0).cast("long")).withColumn("q", F.lit(0).cast("long"))
    columns = ["f", "r", "block", "p", "q", "fp", "node", "mark"]
    return whole.select(*columns).unionByName(cut.select(*columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
