"""Token files: a concatenated id array whose document boundaries and ids are Elias-Fano encoded."""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import file_system
from quillon.llm.tokens import encoder
from quillon.operators.ranking import running
from quillon.session import materialise, shared_dir, table

MAGIC = b"QTOKEF01"
#: One bits between two entries of the select table.
EVERY = 256
#: Bytes of ids after which a task begins its next file.
FILE_BYTES = 64 << 20
#: Documents, and ids, that a reader holds at once (a longer document is held alone).
BLOCK, BLOCK_IDS = 4096, 4 << 20
#: Bytes of ids that a writer gathers before it writes.
GATHERED = 4 << 20
FOOTER = struct.Struct("<BQQQqQQQQ8s")


def encoded(values: np.ndarray) -> bytes:
    """A non-decreasing array of uint64 in about 2 + log2(last / n) bits a value.

    Each value's low bits are stored as they are; its high part h is a one at bit h + k of a bit vector, k being its rank.
    The places of every 256th one are stored as 32-bit numbers, so that a rank is found without scanning from the start.
    """
    n, last = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (last // max(n, 1)).bit_length() - 1)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
    bits[ones] = 1
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return b"".join([struct.pack("<QBQ", n, low, len(bits)), ones[::EVERY].astype("<u4").tobytes(), np.packbits(bits, bitorder="little").tobytes(), np.packbits(lows, bitorder="little").tobytes()])


class EliasFano:
    """An encoded array in a file, read by ranges: read(at, length) gives bytes from the place where it begins."""

    HEAD = 17

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.n, self.low, self.bits = struct.unpack("<QBQ", read(0, self.HEAD))
        self.read = read
        self.ones_at = self.HEAD + 4 * math.ceil(self.n / EVERY)
        self.lows_at = self.ones_at + math.ceil(self.bits / 8)

    def _place(self, sample: int) -> int:
        """Of the one of rank EVERY * sample."""
        return struct.unpack("<I", self.read(self.HEAD + 4 * sample, 4))[0] if sample * EVERY < self.n else self.bits

    def values(self, first: int, end: int) -> np.ndarray:
        """The values of ranks first to end - 1, selected in the stretch of bits between the nearest table entries."""
        if first >= end:
            return np.empty(0, np.uint64)
        sample = first // EVERY
        begin, stop = self._place(sample), self._place(math.ceil(end / EVERY))
        raw = self.read(self.ones_at + begin // 8, math.ceil(stop / 8) - begin // 8)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")) + begin // 8 * 8
        ones = ones[ones >= begin][first - sample * EVERY :][: end - first]
        high = (ones - np.arange(first, end)).astype(np.uint64) << np.uint64(self.low)
        at = first * self.low
        raw = self.read(self.lows_at + at // 8, math.ceil(end * self.low / 8) - at // 8)
        lows = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[at % 8 :][: (end - first) * self.low].reshape(end - first, self.low)
        return high | (lows.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, rank: int) -> int:
        """One value."""
        return int(self.values(rank, rank + 1)[0])


class Writer:
    """Writes documents in ascending order of their ids (null ones first) to a stream that needn't be seekable."""

    def __init__(self, out, width: int) -> None:
        self.out, self.kind = out, np.dtype(f"<u{width}")
        self.bounds, self.docs, self.nulls, self.parts, self.held = [0], [], 0, [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind).tobytes())
        self.held += len(self.parts[-1])
        if self.held >= GATHERED:
            self._flush()
        self.bounds.append(self.bounds[-1] + len(ids))
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def _flush(self) -> None:
        self.out.write(b"".join(self.parts))
        self.parts, self.held = [], 0

    @property
    def size(self) -> int:
        return self.bounds[-1] * self.kind.itemsize

    def close(self) -> None:
        self._flush()
        base = self.docs[0] if self.docs else 0
        bounds, docs = encoded(np.array(self.bounds, np.uint64)), encoded(np.array([d - base for d in self.docs], np.uint64))
        at = len(MAGIC) + self.size
        self.out.write(bounds + docs)
        self.out.write(FOOTER.pack(self.kind.itemsize, len(self.bounds) - 1, self.bounds[-1], self.nulls, base, at, len(bounds), at + len(bounds), len(docs), MAGIC))


class TokenFile:
    """A file that Writer wrote: read(at, length) gives bytes, size is the file's."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        if size < FOOTER.size + len(MAGIC) or read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        width, self.n, self.n_ids, self.nulls, self.base, bounds, bounds_size, docs, docs_size, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or docs + docs_size + FOOTER.size != size:
            raise ValueError("a damaged token file")
        self.read, self.kind = read, np.dtype(f"<u{width}")
        self.bounds = EliasFano(lambda at, n: read(bounds + at, n))
        self.docs = EliasFano(lambda at, n: read(docs + at, n))

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from one place of the array to another."""
        w = self.kind.itemsize
        return np.frombuffer(self.read(len(MAGIC) + start * w, (end - start) * w), self.kind)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        start, end = self.bounds.values(k, k + 2).tolist()
        return self.ids(start, end)

    def doc_ids(self, first: int, end: int) -> list[int | None]:
        """The ids of documents first to end - 1."""
        nulls = max(0, min(end, self.nulls) - first)
        known = self.docs.values(max(first, self.nulls) - self.nulls, max(end, self.nulls) - self.nulls)
        return [None] * nulls + [self.base + d for d in known.tolist()]

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """(document ids, boundaries, ids between the first and the last boundary) of block after block."""
        k = 0
        while k < self.n:
            bounds = self.bounds.values(k, min(self.n, k + BLOCK) + 1).astype(np.int64)
            upto = max(1, int(np.searchsorted(bounds, bounds[0] + BLOCK_IDS, "right")) - 1)
            bounds = bounds[: upto + 1]
            yield self.doc_ids(k, k + upto), bounds, self.ids(int(bounds[0]), int(bounds[-1]))
            k += upto


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encodes whole texts, each followed by end_id, and writes them in ascending id order as token files in a folder that
    all executors share; rows (path, place, docs, ids, ids_before) once all are there, in the order of place.

    Documents are range-partitioned by id (and text, so that one id may have any number of rows), encoded in that order
    and streamed to the file; a task holds its boundaries, one number a document, and ids of some MB.  Ids take two bytes
    where the vocabulary allows it.  Each attempt of a task writes files of its own names, and only those of attempts that
    Spark has accepted are listed.  Null ids come first; null texts are empty, so only the end id stands for them.  Very long
    texts are encoded in overlapping chunks and written whole.  Ids are integers.  Other columns are ignored.  No
    rows give no files.
    """
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    width = 2 if top < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stop = encoder(vocabulary), np.array([] if end_id is None else [end_id], np.uint32)
        part = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
                    yield doc_id, np.concatenate([coder.encode(text.as_py()), stop])

        made, left = [], rows()
        while (row := next(left, None)) is not None:
            system, path = file_system(f"{folder}/{uuid.uuid4().hex}.tokens")
            with system.open_output_stream(path) as out:
                writer = Writer(out, width)
                while row is not None:
                    writer.add(*row)
                    row = next(left, None) if writer.size < file_bytes else None
                writer.close()
            made.append({"path": f"{folder}/{path.rsplit('/', 1)[1]}", "place": (part << 32) + len(made), "docs": len(writer.bounds) - 1, "ids": writer.bounds[-1]})
        yield pa.RecordBatch.from_pylist(made, pa.schema([("path", pa.string()), ("place", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    system, path = file_system(folder)
    system.create_dir(path)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
    files = materialise(ordered.select("_id", "_text").mapInArrow(run, "path string, place long, docs long, ids long"), "tokens")
    return running(files, "place", ["ids"]).select("path", "place", "docs", "ids", F.col("ids_before").cast("long").alias("ids_before"))


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]), one per document of the files (path, ids_before).

    start counts the ids of all documents before it in the dataset, n_tokens and the CRC-32 of the ids as little-endian
    unsigned 32-bit numbers include the end id.  Files are read by ranges: the boundaries of a block of documents by
    select, then its ids.  Damaged files raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["path"])
                with system.open_input_file(path) as f:
                    for doc_ids, bounds, ids in TokenFile(lambda at, n: f.read_at(n, at), f.size()).documents():  # noqa: B023
                        wide, at = ids.astype("<u4"), (bounds - bounds[0]).tolist()
                        raw = memoryview(wide).cast("B")
                        crcs = [crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
                        out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(bounds[:-1] + row["ids_before"]), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crcs, pa.int64())}
                        if with_ids:
                            out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(wide.view("<i4")))
                        yield pa.RecordBatch.from_pydict(out)

    return files.select("path", "ids_before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(files.repartition(max(1, files.count())))
