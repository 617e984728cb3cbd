"""Best-fit-decreasing packing of token sequences with a segment tree over remaining capacities."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.tokens import encoder
from quillon.session import materialise, table

#: Pieces that one task packs together; the bins that it leaves less than full are a few per million tokens.
SHARD = 100_000


class OpenBins:
    """Open bins by remaining capacity: a segment tree over the capacities 0..limit says which have bins."""

    def __init__(self, limit: int) -> None:
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the bin of least remaining capacity >= need: (capacity, number), or None."""
        count, i = self.count, self.leaves + need
        while not count[i]:  # up to the first right neighbour with bins, then down to its least leaf
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            if not count[i]:
                i += 1
        capacity = i - self.leaves
        number = self.bins[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, number


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all from 0 to limit; longest first, each into the tightest open bin that it fits."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, bins = OpenBins(limit), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            found, bins = (limit, bins), bins + 1
        left, number = found
        where[i], offset[i] = number, limit - left
        if left > need:
            tree.add(left - need, number)
    return where, offset


def token_pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): each text's ids and then end_id, cut so that only the first piece is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stop = encoder(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            for r, text in enumerate(x.as_py() for x in batch.column("_text")):
                ids = np.concatenate([coder.encode(text), stop]).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % limit or limit, n + 1, limit)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(ids[a:b].tobytes()))
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            out = [batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one per piece.

    A text that is longer than a sequence is cut into full pieces, its first piece taking what is left over.  Full pieces
    are sequences by themselves; the others are dealt by hash into shards of about `shard` pieces, so that no task's work
    grows with the input, and each shard is packed best fit decreasing: the next longest piece goes to the open sequence
    with the least room that holds it, which a segment tree over the room left finds in a logarithmic number of steps.

    A null or empty text is one piece, the closing id alone.  Very long texts are encoded whole, in overlapping chunks, and
    cut into as many pieces as they need.  Other columns, whatever their names, are ignored.  Repeated ids are packed as separate documents.  No rows
    give no rows.
    """
    pieces = materialise(token_pieces(docs, vocabulary, limit, 0, id_col, text_col, with_ids), "pieces")
    full = F.col("length") == limit
    shards = max(1, -(-pieces.where(~full).count() // shard))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["_id", "piece", "start", "length", "ids_crc32"]
    loose = pieces.where(~full).withColumn("shard", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("_id", "piece", "ids_crc32")])
        where, offset = best_fit_decreasing(rows.column("length").to_numpy(), limit)
        number = where * shards + rows.column("shard").to_numpy()
        return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = loose.select(*columns, "shard").groupBy("shard").applyInArrow(fill, schema)
    alone = pieces.where(full).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed.unionByName(alone)
    if with_ids:
        out = out.join(pieces.select("_id", "piece", "ids_crc32", "ids").dropDuplicates(["_id", "piece", "ids_crc32"]), ["_id", "piece", "ids_crc32"])
    return out.withColumnRenamed("_id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
