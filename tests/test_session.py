"""Steps that are written leave no shuffle files behind and take little memory."""

import os

import pyarrow as pa

from quillon.operators import graph
from quillon.session import BATCH, BATCH_BYTES, CLEANUP, materialise


def shuffle_files(spark):
    """Names of the shuffle files that the block manager of a local session holds."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}


def test_written_steps_leave_no_shuffle_files(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    counts = spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count()
    out = [materialise(counts) for _ in range(2)]
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP, None) == set_to
    assert counts.count() == 100 and [x.count() for x in out] == [100, 100]


def test_wide_rows_reach_python_in_small_batches(spark):
    """A task's batches are bounded in bytes, whatever the width of its rows; the session's own limit comes back."""
    set_to = spark.conf.get(BATCH, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    wide = spark.range(0, 6_000, 1, 1).selectExpr("repeat('x', 5000) AS text")
    found = [r.size for r in materialise(wide.mapInArrow(sizes, "size long")).collect()]
    assert sum(found) >= 30_000_000 and max(found) <= 1.1 * BATCH_BYTES
    assert spark.conf.get(BATCH, None) == set_to


def test_settled_components_cost_no_round(spark, monkeypatch):
    """Components given as stars around their least nodes come back as they are; links between them join them in few rounds."""
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    stars = [(10 * i + j, 10 * i) for i in range(20) for j in range(1, 6)]
    for more, rounds in (([], 0), ([(13, 25), (25, 13), (31, 31)], 2)):
        written.clear()
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(stars + more, "u long, v long")).collect()}
        want = dict(stars)
        if more:
            want |= {20: 10} | {i: 10 for i in range(21, 26)}
        assert got == want and len(written) <= 1 + rounds
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
