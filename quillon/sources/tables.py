"""Readers, snapshots with lineage, validity checks and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.basics import without_nan

# Leading bytes of formats.
MAGIC = {"parquet": "50415231", "gzip": "1F8B", "zip": "504B0304", "feather": "4152524F5731", "xz": "FD377A585A00", "zstd": "28B52FFD", "bzip2": "425A68"}
SUFFIX = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "feather": "feather", "arrow": "feather", "orc": "orc"}
CODECS = ("gz", "bz2", "zst")
# Words of statements that change a database.
CHANGES = ["insert", "update", "delete", "merge", "drop", "alter", "create", "truncate", "grant", "revoke", "call", "replace", "copy", "vacuum"]


def _checked(path: str) -> str:
    if ".." in re.split(r"[/\\]", path):
        raise ValueError("a path may not leave its folder")
    return path


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line holds most of."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max([",", "\t", ";", "|"], key=line.count)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file, folder or glob by its suffix (compressed text too); NaN becomes null."""
    parts = _checked(path).lower().rsplit("/", 1)[-1].split(".")
    suffix = parts[-2] if parts[-1] in CODECS and len(parts) > 2 else parts[-1]
    kind = SUFFIX.get(suffix)
    if kind is None:
        raise ValueError(f"no reader for {path!r}")
    if kind == "feather":
        return without_nan(read_feather(spark, path))
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        separator = "\t" if suffix == "tsv" else "," if suffix == "csv" else sniff_separator(spark, path)
        out = reader.csv(path, header=True, sep=separator, inferSchema=schema is None)
    elif kind == "json":
        out = reader.json(path, multiLine=suffix == "json")
    else:
        out = reader.format(kind).load(path)
    return without_nan(out)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, one task per file."""
    files = spark.read.format("binaryFile").load(path)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.ipc.open_file(pa.BufferReader(c.as_py())).schema.serialize().to_pybytes() for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["shape"])

    first = files.select("content").limit(1).mapInArrow(shapes, "shape binary").first()  # of a file only its schema comes to the driver
    shape = spark.createDataFrame(pa.ipc.read_schema(pa.BufferReader(bytes(first.shape))).empty_table()).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from feather.read_table(pa.BufferReader(content.as_py())).to_batches()

    return files.select("content").mapInArrow(run, shape)


def read_archives(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV members of zip and tar archives, stacked; one task per archive, as text rows of `schema`."""

    def run(batches):
        import io
        import tarfile
        import zipfile

        for pdf in batches:
            for content in pdf["content"]:
                members = []
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [z.read(n) for n in sorted(z.namelist()) if n.lower().endswith(".csv")]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        members = [t.extractfile(m).read() for m in sorted(t.getmembers(), key=lambda m: m.name) if m.isfile() and m.name.lower().endswith(".csv")]
                for m in members:
                    yield pd.read_csv(io.BytesIO(m), dtype=str)

    names = [p.split()[0] for p in schema.split(",")]
    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lambda b: (p[names] for p in run(b)), ", ".join(f"{n} string" for n in names))
    return text.select(*(F.expr(f"try_cast({p.split()[0]} AS {p.split()[1]})").alias(p.split()[0]) for p in schema.split(",")))


def read_store(spark: SparkSession, prefix: str, pattern: str, kind: str = "parquet") -> DataFrame:
    """Files under an object-store or local prefix whose names match a glob."""
    return spark.read.format(kind).option("pathGlobFilter", _checked(pattern)).option("recursiveFileLookup", "true").load(_checked(prefix))


def read_query(spark: SparkSession, url: str, query: str, partition: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """One read-only SQL statement over JDBC, in parallel over a numeric column; the driver class goes in the options."""
    check_read_only(query)
    reader = spark.read.format("jdbc").options(url=url, fetchsize="100000", **options)
    if partition and bounds:
        reader = reader.options(dbtable=f"({query}) q", partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    else:
        reader = reader.option("query", query)
    return reader.load()


def check_read_only(query: str) -> None:
    """Raises unless the text is one SELECT (or WITH ... SELECT) without a word that changes data, quoted text and comments aside.

    SELECT ... INTO makes a table, so it is refused.  Functions with side effects can't be told from others here: open the
    connection read-only as well.
    """
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", query, flags=re.DOTALL).strip()
    if not re.match(r"(select|with)\b", bare, re.IGNORECASE) or ";" in bare.rstrip("; \n\t") or re.search(rf"\b({'|'.join(CHANGES)})\b(?!\s*\()|\binto\b", bare, re.IGNORECASE):
        raise ValueError("only one SELECT can be read")


def stack(frames: list[DataFrame]) -> DataFrame:
    """The union of tables with the same columns, in any order."""
    columns = set(frames[0].columns)
    for i, f in enumerate(frames):
        if set(f.columns) != columns:
            raise ValueError(f"table {i} has other columns: {sorted(set(f.columns) ^ columns)}")
    return reduce(DataFrame.unionByName, frames)


def snapshot(df: DataFrame, path: str, source: str, max_rows: int | None = None) -> DataFrame:
    """Freezes a table as Parquet and returns its lineage: one row (source, path, rows, truncated, fetched_at, checksum).

    Without max_rows everything is kept; with it, `truncated` says whether there was more.
    """
    cut = False
    if max_rows is not None:
        from quillon.session import discard, materialise

        taken = materialise(df.limit(max_rows + 1), "taken")  # the source is read once
        cut = taken.count() > max_rows
        taken.limit(max_rows).write.mode("overwrite").parquet(path)
        discard(taken)
    else:
        df.write.mode("overwrite").parquet(path)
    frozen = df.sparkSession.read.parquet(path)
    line = frozen.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*frozen.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
    return line.select(F.lit(source).alias("source"), F.lit(path).alias("path"), "rows", F.lit(cut).alias("truncated"), F.current_timestamp().alias("fetched_at"), "checksum")


def validity(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, looks_like): each file's format by its leading bytes, null if none fits."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = reduce(lambda acc, item: F.when(head.startswith(item[1]), item[0]).otherwise(acc), MAGIC.items(), F.lit(None).cast("string"))
    return files.select("path", "length", kind.alias("looks_like"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Writes features, predictions or queues as Parquet or as CSV with a header (arrays and structs as JSON there)."""
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(F.col(c)) for c in nested}) if nested else df
        df.write.mode(mode).csv(path, header=True, escape='"')
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for {kind!r}")


def append_log(df: DataFrame, path: str, partition: str = "model_id") -> None:
    """Appends predictions, aligned to the columns that the log already has."""
    spark = df.sparkSession
    try:
        columns = spark.read.parquet(path).columns
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").partitionBy(partition).parquet(path)
