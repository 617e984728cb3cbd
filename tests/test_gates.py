"""Gates on means that stand exactly at a bound."""

import pytest

from quillon.queries import later

#: The mean is 52; added in this order the doubles come out above it, backwards they don't.
AT_BOUND = [80.91, 51.87, 56.14, 42.61, 5.61, 87.0, 39.86]


@pytest.mark.parametrize("order", [1, -1])
def test_a_mean_at_the_bound_is_not_above_it(spark, tmp_path, order):
    rows = [(7, "purchase", v) for v in AT_BOUND[::order]]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in later.gates(spark, str(tmp_path)).collect()] == [(7, "purchase", "pass")]
