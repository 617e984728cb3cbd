"""Aggregates registered by name, in batch, stream and merged periods."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import aggregates
from quillon.operators.events import aggregate_events
from quillon.streaming import modes

SPECS = [{"name": "r", "agg": "value_range", "column": "value"}, {"name": "rc", "agg": "value_range", "column": "value", "where": "event_type = 'click'"}, {"name": "any", "agg": "ever", "where": "event_type = 'error'"}]


@pytest.fixture
def registered():
    aggregates.register("value_range", {"lo": (lambda x, hit, t: F.min(x), "min"), "hi": (lambda x, hit, t: F.max(x), "max")}, lambda p: p["hi"] - p["lo"])
    aggregates.register("ever", {"any": (lambda x, hit, t: F.bool_or(hit), "or")}, lambda p: F.coalesce(p["any"], F.lit(False)), column=False)
    yield
    aggregates.unregister("value_range")
    aggregates.unregister("ever")


def test_batch_stream_and_merged_agree(spark, sf, tmp_path, registered):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    batch = {(r.user_id, r.period_start): (r.n_events, r.r, r.rc, r.any) for r in aggregate_events(events, "user_id", "ts", SPECS, period="D").collect()}
    pandas = events.toPandas()
    for (user, day), rows in list(pandas.groupby(["user_id", pandas["ts"].dt.floor("D")]))[:200]:
        clicks = rows[rows["event_type"] == "click"]["value"]
        want = (len(rows), rows["value"].max() - rows["value"].min(), clicks.max() - clicks.min() if len(clicks) else None, bool((rows["event_type"] == "error").any()))
        assert batch[(user, day.to_pydatetime())] == want
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = modes.stream_aggregates(stream, "user_id", "ts", SPECS, "D").writeStream.outputMode("complete").format("memory").queryName("registered_aggregates").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.period_start): (r.n_events, r.r, r.rc, r.any) for r in spark.table("registered_aggregates").collect()} == batch
    hours = aggregates.partial_rows(events, "user_id", "ts", SPECS, "1h")
    twice = aggregates.merged(hours, ["user_id"], SPECS)
    whole = aggregate_events(events, "user_id", "ts", SPECS)
    assert sorted(map(tuple, twice.select("user_id", "n_events", "r", "rc", "any").collect())) == sorted(map(tuple, whole.select("user_id", "n_events", "r", "rc", "any").collect()))


def test_refusals_and_no_rows(spark, sf, registered):
    events = spark.read.parquet(f"{sf}/events.parquet")
    with pytest.raises(ValueError):
        aggregates.register("mean", {"s": (lambda x, hit, t: F.sum(x), "sum")}, lambda p: p["s"])
    with pytest.raises(ValueError):
        aggregates.register("odd", {"s": (lambda x, hit, t: F.sum(x), "average")}, lambda p: p["s"])
    with pytest.raises(ValueError):
        aggregate_events(events, "user_id", "ts", [{"name": "r", "agg": "value_range"}])
    assert aggregates.merged(aggregates.partial_rows(events.where("false"), "user_id", "ts", SPECS, "D"), ["user_id"], SPECS).count() == 0
    aggregates.unregister("ever")
    with pytest.raises(ValueError):
        aggregate_events(events, "user_id", "ts", [SPECS[2]])
