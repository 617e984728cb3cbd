"""Session and storage helpers shared by every module."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the tests, the bench and the oracle comparison rely on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in spark.checkpoint.dir.  Only a local session without that setting gets a temporary folder,
    since there the driver and the executor are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With this setting a query's shuffle files go when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that a Python task gets.  Spark's 64 MB, doubled while a batch grows, lie in the executor and in
#: its worker at once for each task, and what a worker makes of a batch (shingles, prefixes) comes back in one piece.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def step_settings(spark: SparkSession) -> Iterator[None]:
    """The settings under which steps run; the session's own come back at the end."""
    before = {key: spark.conf.get(key, None) for key in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage and survives lost executors.

    The shuffle files of the write are deleted at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with step_settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written = path
    return out


def spread(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """rows in so many partitions that none has many more than `most`; for fits, which hold a task's rows as objects."""
    parts = -(-rows.count() // most)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and that nothing reads any more: whatever came from them is written itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
