"""WARC records in ZIP packages: a writer, and a reader that works by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import salted_left_join
from quillon.session import materialise, shared_dir, table

#: Bytes of records after which a new package is begun.
PACKAGE_BYTES = 128 << 20
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member.  A revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or f'urn:page:{page_id}', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """A record from its gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or f"sha1:{digest32(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def write_package(out, records: Iterator[tuple[bytes, int | None]], limit: int = PACKAGE_BYTES) -> int:
    """Writes stored members to a stream that needn't be seekable (so sizes are in the central directory); rows written."""
    index, at, rows = [], 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(DATA, "w", force_zip64=True) as data:
            for member, page_id in records:
                data.write(member)
                index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(member), "filename": DATA}))
                at += len(member)
                rows += 1
                if at >= limit:
                    break
        z.writestr(INDEX, "".join(f"{line}\n" for line in index))
        z.writestr(ABOUT, json.dumps({"profile": "data-package", "resources": [DATA, INDEX]}))
    return rows


class Package:
    """Members of a ZIP archive by range reads: read(offset, length) gives bytes, size is the archive's."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("not a ZIP archive")
        entries, directory_size, directory = struct.unpack_from("<HII", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            (end64,) = struct.unpack_from("<Q", tail, locator + 8)
            record64 = read(end64, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 directory end is not where its locator says")
            entries, directory_size, directory = struct.unpack_from("<QQQ", record64, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, at = read(directory, directory_size), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a damaged central directory")
            method, packed, plain, name_n, extra_n, comment_n = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + name_n].decode()
            extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
            plain, packed, header = _zip64(extra, plain, packed, header)
            self.members[name] = (method, header, packed)
            at += 46 + name_n + extra_n + comment_n

    def range_of(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes are: (offset, length)."""
        method, header, length = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, so it has no ranges")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no member where the directory says: {name}")
        name_n, extra_n = struct.unpack_from("<HH", local, 26)
        return header + 30 + name_n + extra_n, length

    def records(self) -> Iterator[dict]:
        """All records, each read by the range that an index names."""
        for index in sorted(n for n in self.members if n.startswith("indexes/")):
            at, length = self.range_of(index)
            for line in self.read(at, length).splitlines():
                entry = json.loads(line)
                start, whole = self.range_of(entry["filename"]) if entry["filename"] != DATA else self._data()
                if entry["offset"] + entry["length"] > whole:
                    raise ValueError("an index entry beyond its member")
                yield parse(self.read(start + entry["offset"], entry["length"]))

    def _data(self) -> tuple[int, int]:
        if not hasattr(self, "_data_range"):
            self._data_range = self.range_of(DATA)
        return self._data_range


def _zip64(extra: bytes, *values: int) -> tuple[int, ...]:
    """The sizes and offset of an entry, those of 0xFFFFFFFF from its ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return tuple(next(wide) if v == 0xFFFFFFFF else v for v in values)
        at += 4 + n
    return values


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batches(records: Iterator[dict], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = FIELDS if with_payload else FIELDS.remove(len(FIELDS) - 1)
    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += r["payload_bytes"]
        if len(rows) >= 4096 or size >= 16 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of packages given as rows (path), read by ranges, or as rows (path, content), as Spark's binaryFile has them.

    Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]); a revisit has no payload, its
    size and digest are those of the full payload.  Damaged archives and records raise.  Use one partition per few packages.
    """
    whole = "content" in packages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if whole:
                    view = memoryview(row["content"])
                    yield from _batches(Package(lambda at, n: bytes(view[at : at + n]), len(view)).records(), with_payload)  # noqa: B023
                    continue
                system, path = _open(row["path"])
                with system.open_input_file(path) as f:
                    yield from _batches(Package(lambda at, n: f.read_at(n, at), f.size()).records(), with_payload)  # noqa: B023

    return packages.select("path", *(["content"] if whole else [])).mapInArrow(run, RECORD if with_payload else RECORD.rpartition(",")[0])


def record_kinds(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, salts: int = 16) -> DataFrame:
    """Rows (page_id, url, payload, revisit, refers_to): of equal payloads of at least least_bytes, the largest id is the response.

    Payloads are equal if their SHA-256 is: pages made to collide under the header's SHA-1 are no revisits of each other.
    Null html is an empty payload; very long ones are hashed whole.  Other columns, whatever their names, are ignored.
    Rows that repeat the largest id and its payload are responses as well; rows with a
    null id revisit, unless all of their payload's ids are null.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    key = [F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("n")]
    groups = base.select("page_id", *key).groupBy("sha", "n").agg(F.max("page_id").alias("most"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    revisit = F.col("most").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("most")) & (F.col("n") >= least_bytes)
    return salted_left_join(base.select("*", *key), groups, ["sha", "n"], F.col("page_id"), salts).select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("most")).alias("refers_to")
    )


def write_packages(kinds: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Writes record_kinds() rows as packages in a folder that all executors share; rows (path, records) once all are there.

    Each attempt of a task writes files of its own names, and only those of the attempts that Spark has accepted are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members():
            for batch in batches:
                for r in batch.to_pylist():
                    yield record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"]), r["page_id"]

        rows, made = members(), []
        while (first := next(rows, None)) is not None:
            system, path = _open(f"{folder}/{uuid.uuid4().hex}.wacz")
            with system.open_output_stream(path) as f:
                n = write_package(f, (x for source in ((first,), rows) for x in source), limit)
            made.append({"path": f"{folder}/{path.rsplit('/', 1)[1]}", "records": n})
        yield pa.RecordBatch.from_pylist(made, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    system, path = _open(folder)
    system.create_dir(path)
    return materialise(kinds.mapInArrow(run, "path string, records long"), "packages")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/packages-{uuid.uuid4().hex}"
    packages = write_packages(record_kinds(table(spark, sf_dir, "pages")), folder)
    found = read_packages(packages.repartition(max(1, packages.count())), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS most FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 5 * i : 5 + 5 * i])::BIGINT >> (15 - 5 * j)) & 31)]), '')), '') AS payload_digest,
       CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id != most THEN most END AS refers_to
FROM g
"""
