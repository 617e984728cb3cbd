import gzip
import io
import json
import tarfile
import zipfile

import pandas as pd
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from quillon.operators.events import aggregate_events, entity_features
from quillon.sources import tables
from quillon.streaming import modes

FRAME = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", "z"]})


def test_every_format_reads_alike(spark, tmp_path):
    FRAME.to_csv(tmp_path / "f.csv", index=False)
    FRAME.to_csv(tmp_path / "f.tsv", index=False, sep="\t")
    FRAME.to_csv(tmp_path / "f.txt", index=False, sep=";")
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        FRAME.to_csv(f, index=False)
    FRAME.to_parquet(tmp_path / "f.parquet")
    feather.write_feather(FRAME, str(tmp_path / "f.feather"))
    (tmp_path / "f.json").write_text(json.dumps(FRAME.to_dict("records"), indent=1))
    FRAME.to_json(tmp_path / "f.jsonl", orient="records", lines=True)
    for name in ("f.csv", "f.tsv", "f.txt", "g.csv.gz", "f.parquet", "f.feather", "f.json", "f.jsonl"):
        got = tables.read_table(spark, str(tmp_path / name))
        assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "z")], name
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/../f.csv")
    kinds = {r.path.rsplit("/", 1)[1]: r.looks_like for r in tables.validity(spark, str(tmp_path)).collect()}
    assert (kinds["f.parquet"], kinds["f.feather"], kinds["g.csv.gz"], kinds["f.csv"]) == ("parquet", "feather", "gzip", None)
    assert tables.read_store(spark, str(tmp_path), "*.parquet").count() == 3


def test_archives_and_stacks(spark, tmp_path):
    csv = FRAME.to_csv(index=False).encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.csv", csv)
        z.writestr("2.csv", csv)
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("3.csv")
        info.size = len(csv)
        t.addfile(info, io.BytesIO(csv))
    got = tables.read_archives(spark, str(tmp_path), "a int, b string")
    assert got.count() == 9 and got.agg(F.sum("a")).first()[0] == 18
    one = spark.createDataFrame(FRAME)
    assert tables.stack([one, one.select("b", "a")]).count() == 6
    with pytest.raises(ValueError):
        tables.stack([one, one.drop("b")])


def test_only_reading_statements():
    for good in ("select * from t", "WITH x AS (SELECT 1) SELECT 'delete; drop' FROM x -- update", "select replace(a, 'x', 'y') from t;"):
        tables.check_read_only(good)
    for bad in ("delete from t", "SELECT * INTO t2 FROM t", "WITH x AS (SELECT 1) DELETE FROM t", "select 1; drop table t", "with x as (update t set a = 1 returning a) select * from x"):
        with pytest.raises(ValueError):
            tables.check_read_only(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "k long, xs array<string>")
    for kind in ("csv", "parquet"):
        tables.write_table(df, str(tmp_path / kind), kind)
        assert tables.read_table(spark, str(tmp_path / kind) + f"/*.{kind}").count() == 2
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "x"), "xlsx")


def test_snapshot_and_log(spark, tmp_path):
    one = spark.createDataFrame(FRAME)
    line = tables.snapshot(one, str(tmp_path / "s"), "here", max_rows=2).first()
    assert (line.rows, line.truncated) == (2, True)
    assert tables.snapshot(one, str(tmp_path / "t"), "here").first().truncated is False
    log = str(tmp_path / "log")
    tables.append_log(one.withColumn("model_id", F.lit("m1")), log)
    tables.append_log(one.drop("b").withColumn("extra", F.lit(1)).withColumn("model_id", F.lit("m2")), log)
    got = spark.read.parquet(log)
    assert got.count() == 6 and set(got.columns) == {"a", "b", "model_id"}


def stream_of(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    stream = stream_of(spark, events, str(tmp_path / "e"))
    specs = [{"name": "n", "agg": "count", "where": "event_type = 'click'"}, {"name": "m", "agg": "mean", "column": "value"}]
    run(modes.stream_aggregates(stream, "user_id", "ts", specs, "D"), "agg", "complete")
    batch = {(r.user_id, r.period_start): (r.n_events, r.n, round(r.m, 6)) for r in aggregate_events(events, "user_id", "ts", specs, period="D").collect()}
    assert {(r.user_id, r.period_start): (r.n_events, r.n, round(r.m, 6)) for r in spark.table("agg").collect()} == batch
    run(modes.velocity_stream(stream, "user_id", "ts", "event_id", "24h"), "vel")
    want = {r.event_id: r.n for r in entity_features(events, "user_id", "ts", [{"name": "n", "op": "roll_count", "window": "24h"}]).collect()}
    assert {r.event_id: r.n for r in spark.table("vel").collect()} == want
    q = modes.score_stream(stream, lambda d: d.select("event_id", (F.col("value") > 50).alias("alert")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    q = modes.drift_stream(stream, events, "event_type", "ts", "week", str(tmp_path / "d"), str(tmp_path / "ck2"))
    q.processAllAvailable()
    q.stop()
    drifted = spark.read.parquet(str(tmp_path / "d"))
    assert drifted.agg(F.max("psi")).first()[0] < 0.5 and drifted.agg(F.sum("n")).first()[0] == events.count() and drifted.count() == drifted.select("period").distinct().count()
