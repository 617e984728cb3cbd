"""Near duplicates by exact Jaccard similarity: links found by SimHash are confirmed, a prefix join finds all others."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, salted_left_join
from quillon.llm.simhash import LOWER, least_difference, shingle_hashes, simhash_links
from quillon.session import discard, materialise, step_settings

#: Sets that one shingle may hold before their pairs are dealt out to several tasks.
LARGE_KEY = 20_000
#: Documents (about) whose shingles tell which are common, and common shingles at most; they change the work, not the result.
ORDER_DOCUMENTS, ORDER_SHINGLES = 10_000, 50_000
#: Pairs of one node that meet a copy of its set.
PARTNERS = 2_000
#: Pairs held before repeated ones are dropped, and rows of whole groups that are paired together.
PAIRS, TOGETHER = 1 << 20, 1 << 16
#: Sampled documents that make a shingle a hot one, and the parts that its rows are dealt to.
HOT, HOT_PARTS = 50, 64
#: Shared elements of a set, the rarest first, around which it is compared with its neighbours.
FIRST = 2
#: Slices of all pairs by a hash of theirs, and pairs for each row above which the first of them are confirmed first.
SLICES, CROWDED = 1 << 20, 0.5


def similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, least: Fraction):
    """Whether sets of a and b elements, of which `shared` in common, have a Jaccard similarity of `least` or more."""
    return shared * (least.numerator + least.denominator) >= least.numerator * (a + b)


def _hashes(raw: bytes | None, n: int) -> np.ndarray:
    """The sorted set of hashed shingles of a text."""
    return np.unique(shingle_hashes((raw or b"").translate(LOWER).split(), n))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(raw, n).tobytes() for raw in batch.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sets, pa.binary())], names=["_id", "hashes"])

    return run


def _elements(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(raw, n) for raw in batch.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["key"])

    return run


def _prefixes(n: int, least: Fraction, common: np.ndarray, counts: np.ndarray):
    """Of each set, in the order of rare shingles first, as many elements as a similar set cannot all lack.

    Rows (key, node, place, part), place holding the size of the set and the position of the key, 32 bits each; part is 0,
    but for hot keys one of 1 to HOT_PARTS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, lengths, hot = [], [], [], []
            for raw in batch.column("_text").cast(pa.binary()).to_pylist():
                x = _hashes(raw, n)
                count = np.zeros(len(x), np.int64)
                if len(common) and len(x):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    count = np.where(common[at] == x, counts[at], 0)
                    order = np.lexsort((x, count))
                    x, count = x[order], count[order]
                length = len(x) + int(-len(x) * least // 1) + 1 if len(x) else 0
                keys.append(x[:length])
                hot.append(count[:length] >= HOT)
                places.append((len(x) << 32) + np.arange(length))
                lengths.append(length)
            node = np.repeat(batch.column("_id").to_numpy(), lengths)
            joined = [np.concatenate([np.empty(0, np.int64), *(k.view(np.int64) for k in part)]) for part in (keys, places)]
            part = np.where(np.concatenate([np.empty(0, bool), *hot]), 1 + node % HOT_PARTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (joined[0], node, joined[1], part)], names=["key", "node", "place", "part"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, pairs of neighbours with the same fingerprints and sketch."""
    last = None
    for batch in batches:
        us, vs = [], []
        for node, fps, mark in zip(batch.column("_id").to_pylist(), batch.column("fps").to_pylist(), batch.column("mark").to_pylist(), strict=True):
            if last is not None and last[1] == (fps, mark) and last[0] != node:
                us.append(last[0])
                vs.append(node)
            last = node, (fps, mark)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of keys, those of keys that several nodes have; hot keys (of a part over 0) are known to be such."""
    names = ["key", "node", "place"]
    held = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)]
    alone = True  # whether no row before the held one has its key

    def sift(found: list[np.ndarray], alone: bool, upto: int) -> pa.RecordBatch:
        key, part = found[0], found[3]
        equal = key[1:] == key[:-1]
        several = part > 0
        several[1:] |= equal
        several[:-1] |= equal
        several[:1] |= not alone
        return pa.RecordBatch.from_arrays([pa.array(x[:upto][several[:upto]]) for x in found[:3]], names=names)

    for batch in batches:
        found = [np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(held, (*names, "part"), strict=True)]
        n = len(found[0])
        if not n:
            continue
        yield sift(found, alone, n - 1)
        alone = n == 1 and alone or n > 1 and found[0][-1] != found[0][-2]
        held = [x[-1:] for x in found]
    yield sift(held, alone, 1)


def _chained(least: Fraction):
    """Of rows in the order of key and set size, pairs of neighbours with the same key whose sizes don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, np.int64)] * 3
        for batch in batches:
            key, node, place = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(last, ("key", "node", "place"), strict=True))
            size = place >> 32
            near = (key[1:] == key[:-1]) & (node[1:] != node[:-1]) & similar(np.minimum(size[1:], size[:-1]), size[1:], size[:-1], least)
            uv = np.unique(np.stack([node[:-1][near], node[1:][near]], 1), axis=0)
            last = [x[-1:] for x in (key, node, place)]
            yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

    return run


def _slice_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number from 0 to SLICES - 1 for each pair u < v."""
    mixed = (u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ v.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(44)).astype(np.int64)


def _pairs(least: Fraction, begin: int = 0, end: int = 1 << 20):
    """Pairs of sets of different components around one key that their sizes and the places of the key don't rule out, of
    the slices begin to end - 1 of all pairs.

    Rows come in the order of key, parts, component and node; as many whole groups as make some ten thousand rows are
    taken together, so a task holds one group at least and few rows more.
    """
    names = ["key", "p", "q", "component", "node", "place", "own"]

    def among(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, p, q, component, node, place, own = found
        size, pos = place >> 32, place & 0xFFFFFFFF
        n = len(key)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        ends = np.repeat(np.r_[cuts, n], np.diff(np.r_[0, cuts, n]))
        runs = np.union1d(cuts, np.flatnonzero(component[1:] != component[:-1]) + 1)
        after = np.repeat(np.r_[runs, n], np.diff(np.r_[0, runs, n]))
        held, total = [], 0

        def batch() -> pa.RecordBatch:
            uv = np.unique(np.concatenate(held), axis=0) if held else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

        live, step = np.arange(n), 0
        while len(live := live[after[live] + step < ends[live]]):
            a, b = live, after[live] + step
            shared = np.minimum(size[a] - pos[a], size[b] - pos[b])  # if this is the first key in common
            keep = similar(shared, size[a], size[b], least) & ((p[a] == q[a]) | (own[a] != own[b]))
            u, v = np.minimum(node[a[keep]], node[b[keep]]), np.maximum(node[a[keep]], node[b[keep]])
            at = _slice_of(u, v)
            uv = np.stack([u, v], 1)[(at >= begin) & (at < end)]
            held.append(uv)
            total += len(uv)
            if total >= PAIRS:
                yield batch()
                held, total = [], 0
            step += 1
        yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append([batch.column(c).to_numpy() for c in names])
            rows += batch.num_rows
            if rows < TOGETHER:
                continue
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            same = (found[0] == found[0][-1]) & (found[1] == found[1][-1]) & (found[2] == found[2][-1])
            whole = int(np.argmax(same))  # the last group may go on
            if whole:
                yield from among([x[:whole] for x in found])
            parts, rows = [[x[whole:] for x in found]], len(found[0]) - whole
        if rows:
            yield from among([np.concatenate(x) for x in zip(*parts, strict=True)])

    return run


def _beside(pairs: DataFrame, many: DataFrame, held: DataFrame, side: str, name: str) -> DataFrame:
    """pairs with the set of their node `side`; the sets of the nodes in `many` have copies, and their pairs are dealt out."""
    pairs = salted_left_join(pairs, many, [side], F.xxhash64("u", "v")).withColumn("part", F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1))))
    sets = held.withColumnRenamed("_id", side).withColumnRenamed("hashes", name).join(many, side, "left")
    sets = sets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    return pairs.drop("parts").join(sets.drop("parts"), [side, "part"]).drop("part")


def _agree(least: Fraction, test):
    """Keeps the pairs (u, v) whose columns a and b pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [test(x.as_buffer(), y.as_buffer(), least) for x, y in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _may_be_similar(a: pa.Buffer, b: pa.Buffer, least: Fraction) -> bool:
    x, y, apart = least_difference(a.to_pybytes(), b.to_pybytes())
    return apart * (least.denominator + least.numerator) <= (x + y) * (least.denominator - least.numerator)


def _are_similar(a: pa.Buffer, b: pa.Buffer, least: Fraction) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)


def _confirmed(pairs: DataFrame, signs: DataFrame, texts: DataFrame, n: int, least: Fraction) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of `least` or more, computed from all their elements.

    signs has (_id, hashes), the parities of the sets: they rule out most pairs that are not similar, for certain.  texts
    has (_id, _text), one row per node; only those of the other pairs are cut into shingles again.
    """
    for known, test in ((signs, _may_be_similar), (texts, _are_similar)):
        pairs = materialise(pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        needed = materialise(pairs.select(F.col("u").alias("_id")).unionByName(pairs.select(F.col("v").alias("_id"))).distinct(), "needed")
        held = known.join(needed, "_id", "left_semi")
        held = materialise(held.mapInArrow(_sets(n), "_id long, hashes binary") if "_text" in held.columns else held, "held")
        degree = lambda side: pairs.groupBy(side).agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("parts")).where("parts > 1")  # noqa: B023, E731
        both = _beside(_beside(pairs, degree("u"), held, "u", "a"), degree("v"), held, "v", "b").select("u", "v", "a", "b")
        found = materialise(both.mapInArrow(_agree(least, test), "u long, v long"), "links")
        discard(held, needed, pairs)
        pairs = found
    return found


def _side_by_side(rows: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (u, v) of sets next to each other around a key, in the order of their sizes, from rows (key, node, place)."""
    order = ["key", F.shiftright("place", 32), "node"]
    return rows.select("key", "node", "place").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chained(least), "u long, v long")


def near_components(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, **search) -> DataFrame:
    """Rows (id, text_key, component_id, kept), one per row of docs: documents link if the sets of their shingles of
    search["verify"] words (lower-cased A-Z, hashed to 64 bits) have a Jaccard similarity of `similarity` or more; all
    links are found.  component_id is the smallest id that links reach; kept marks its row, of several with that id the one
    with the least text_key, the SHA-256 of the text.

    Links of simhash_links(**search), at most two to each document from those after it, come first and are confirmed; they join most
    of what is alike cheaply.  The others come from an exact prefix join: in one order of all shingles, here common ones last, two sets of that similarity share
    one of the first m - ceil(similarity m) + 1 elements of each, m being its own size.  Pairs that share
    one, in different components so far, are confirmed from the whole sets: first those of neighbours around the two rarest
    shared elements of a set, which joins large groups of copies by some pairs a document, then all between components.
    Where these are many, a small slice of them by hash comes first, then ever larger ones, each between the components
    that are left: components that many pairs would join are joined by a few.

    Rows are told apart by a 64-bit hash of id and text, so different texts under one id are judged each for itself and
    repeated rows are one document: all carry the same verdict.  Null and blank texts link with each other.  Null ids come
    after all others; a component of null ids only has a null component_id.  Sets of very long texts are held one at a
    time.  Other columns are ignored.  No rows give no rows.
    """
    least, n = Fraction(str(similarity)), search["verify"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), text.alias("_text"))
    rows = rows.withColumn("_id", F.xxhash64("id", "_text"))
    prints, groups, links = simhash_links(rows, "_id", "_text", salts=salts, carry=("id", "text_key"), **search)
    whole = materialise(prints.groupBy("whole").agg(F.min("_id").alias("first"), F.max("_id").alias("last")), "whole")
    repeated = materialise(prints.groupBy("_id").count().where("count > 1").select("_id"), "repeated")
    once = lambda df: df.join(repeated, "_id", "left_anti").unionByName(df.join(repeated, "_id", "left_semi").dropDuplicates(["_id"]))
    texts, signs = once(rows.select("_id", "_text")), once(prints.select("_id", F.col("signs").alias("hashes")))
    equal = salted_left_join(prints.select("_id", "whole"), whole.where("first != last"), ["whole"], F.col("_id"), salts).where("_id != first")
    equal = materialise(equal.select(F.col("_id").alias("u"), F.col("first").alias("v")).distinct(), "equal")
    firsts = prints.select("_id", "fps", "mark").join(equal.select(F.col("u").alias("_id")), "_id", "left_anti")
    lined = firsts.repartitionByRange("fps", "mark", "_id").sortWithinPartitions("fps", "mark", "_id").mapInArrow(_neighbours, "u long, v long")
    known = prints.select("_id")
    share = min(1.0, ORDER_DOCUMENTS / max(1, known.count()))
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < round(share * 1_000_000)).select("_text")
    with step_settings(docs.sparkSession):
        top = sample.mapInArrow(_elements(n), "key long").groupBy("key").count().where("count >= 4").orderBy(F.desc("count"), "key").limit(ORDER_SHINGLES).collect()
    common, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(common)

    keys = texts.mapInArrow(_prefixes(n, least, common[order], counts[order]), "key long, node long, place long, part int")
    shared = materialise(keys.repartition("key", "part").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long, place long"), "shared")
    rarest = shared.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "key"))), 1, FIRST).alias("of"))  # of one text
    down = links.groupBy(F.greatest("u", "v").alias("u")).agg(F.min(F.least("u", "v")).alias("lo"), F.max(F.least("u", "v")).alias("hi"))
    links = down.select("u", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("v"))  # what is left out, the prefix join finds
    links = links.unionByName(lined).unionByName(_side_by_side(rarest.select("node", F.inline("of")), least))
    found = components(_confirmed(links, signs, texts, n, least).unionByName(equal))
    group, done, width = ["key", "p", "q"], 0, 0
    while done < SLICES:
        placed = materialise(shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        busy = counts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("within"))
        busy = materialise(busy.where("parts > 1"), "busy")
        crowd = busy.agg(F.sum(F.col("n").cast("double") * F.col("n") - F.col("within")) / 2).first()[0] or 0.0
        width = min(SLICES - done, max(8 * width, int(SLICES * min(1.0, CROWDED * placed.count() / max(crowd, 1.0))), 1))
        parts = F.ceil(F.col("n") / F.lit(LARGE_KEY))
        dealt = (
            salted_left_join(placed, busy.select("key", "n"), ["key"], F.col("node"), 4)
            .where("n IS NOT NULL")
            .withColumn("own", F.pmod(F.xxhash64("node"), parts))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "component", "node", "place", "own")
        )
        ordered = dealt.repartition(*group).sortWithinPartitions(*group, "component", "node")
        pairs = ordered.mapInArrow(_pairs(least, done, done + width), "u long, v long")
        links = _confirmed(pairs, signs, texts, n, least)
        discard(placed, busy)
        if links.take(1):  # the components so far, one link a node, and what joins them
            before = found
            found = components(before.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
            discard(before)
        done += width
    discard(shared)

    named = salted_left_join(prints.select("_id", "id", "text_key"), found.withColumnRenamed("node", "_id"), ["_id"], F.col("_id"), 1)
    named = materialise(named.withColumn("component", F.coalesce("component", "_id")), "named")
    least_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best")
    best = named.groupBy("component").agg(least_row, F.count("*").alias("n")).where("n > 1").drop("n")
    out = salted_left_join(named, best, ["component"], F.col("_id"), salts)
    alone = F.col("best").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key")))).alias("kept"),
    )
