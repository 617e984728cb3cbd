import io
import struct
import zipfile

import pytest

from quillon.llm.warc import DATA, INDEX, Package, digest32, parse, read_packages, record, record_kinds, write_package, write_packages


class Unseekable(io.RawIOBase):
    def __init__(self):
        self.raw = bytearray()

    def writable(self):
        return True

    def write(self, b):
        self.raw += bytes(b)
        return len(b)


def package(n=5, limit=1 << 20):
    out = Unseekable()
    write_package(out, ((record(i, f"http://h/{i}", b"x" * i, None, False), i) for i in range(n)), limit)
    return bytes(out.raw)


def reader(raw, log=None):
    def read(at, n):
        if log is not None:
            log.append((at, n))
        return raw[at : at + n]

    return Package(read, len(raw))


def test_round_trip_by_ranges():
    raw, log = package(50), []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {DATA, INDEX} <= set(z.namelist())
    found = list(reader(raw, log).records())
    assert [(r["page_id"], r["payload"]) for r in found] == [(i, b"x" * i) for i in range(50)]
    assert len(log) > 50


def test_zip64_end_and_damage():
    raw = package(3)
    end = raw.rfind(b"PK\x05\x06")
    size, at = struct.unpack_from("<II", raw, end + 12)
    (entries,) = struct.unpack_from("<H", raw, end + 10)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, size, at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    small = raw[end : end + 8] + b"\xff" * 12 + raw[end + 20 :]
    assert [r["page_id"] for r in reader(raw[:end] + end64 + locator + small).records()] == [0, 1, 2]
    with pytest.raises(ValueError):
        reader(b"no archive")
    with pytest.raises(ValueError):
        reader(raw[:end] + b"PK\x05\x06" + raw[end + 4 : end + 16] + b"\0\0\0\0" + raw[end + 20 :])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(DATA, b"x" * 100)
    with pytest.raises(ValueError):
        reader(out.getvalue()).range_of(DATA)


def test_records():
    r = parse(record(7, "http://a/ü b\r\nX: y", "é".encode(), None, False))
    assert (r["page_id"], r["payload"], r["payload_digest"]) == (7, "é".encode(), digest32("é".encode())) and "\r" not in r["url"]
    r = parse(record(None, None, b"abc", 9, True))
    assert (r["page_id"], r["refers_to"], r["payload_bytes"], r["payload"], r["record_type"]) == (None, 9, 3, None, "revisit")


def test_kinds_and_files(spark, tmp_path):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "u", ""), (5, "u", "big" * 100_000), (2, "u", "a"), (None, "u", "a"), (None, "v", "only")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    packages = write_packages(record_kinds(pages), str(tmp_path / "p"), limit=200)
    assert packages.count() >= 2
    want = sorted(
        [(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (None, "revisit", 2, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 300_000), (None, "response", None, 4)],
        key=str,
    )
    got = read_packages(packages)
    assert sorted(map(tuple, got.select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=str) == want
    files = spark.read.format("binaryFile").load(str(tmp_path / "p"))
    assert sorted(map(tuple, read_packages(files).select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=str) == want
    kinds = {r.page_id: r.revisit for r in record_kinds(pages, least_bytes=1).collect() if r.page_id}
    assert kinds == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert record_kinds(pages.limit(0)).count() == 0 and write_packages(record_kinds(pages.limit(0)), str(tmp_path / "q")).count() == 0
