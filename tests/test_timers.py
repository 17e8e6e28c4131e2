"""Streams whose state ends by timers or by a time to live."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from sagebase.streaming import windows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(rng, n, start, users=3, step=4):
    ts = start
    for k in range(n):
        ts += dt.timedelta(seconds=rng.random() * step)
        yield (k, rng.randrange(users), ts, rng.random() < 0.8)


def written(spark, tmp_path, rows, batches):
    schema = "event_id long, user_id long, ts timestamp, failed boolean"
    for k in range(batches):
        spark.createDataFrame([r for r in rows if r[4] == k], schema + ", batch int").drop("batch").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def ran(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query


@pytest.mark.parametrize(("kind", "answer", "value"), [(windows.LOCK, "refused", "failed"), (windows.RATE, "allowed", None)])
def test_events_out_of_order_are_answered_in_order(rocks, tmp_path, kind, answer, value):
    """Neighbouring micro-batches swap events within the allowed lateness; the answers are those of the batch fold."""
    spark, rng = rocks, random.Random(2)
    start = dt.datetime(2024, 5, 1)
    rows = [(*e, min(2, max(0, (k // 60) + rng.choice([0, 0, 0, 1])))) for k, e in enumerate(events(rng, 180, start, step=4 if value else 1))]
    last = (999, 0, start + dt.timedelta(days=2), False, 3)
    stream = written(spark, tmp_path, [*rows, last], 4)
    name = f"timers_{answer}"
    ran(windows.stream_with_timers(stream, ["user_id"], kind, answer, value, late="20 minutes"), tmp_path, name)
    got = {r.event_id: r[answer] for r in spark.table(name).collect()}
    batch = spark.createDataFrame([r[:4] for r in rows], "event_id long, user_id long, ts timestamp, failed boolean")
    want = {r.event_id: r[answer] for r in windows.folded(batch, ["user_id"], kind, answer, value).collect()}
    assert got == want and len(set(want.values())) == 2
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "state").load()
    assert state.count() == 0  # long after the last event nothing is kept


def test_state_lives_for_its_time(rocks, tmp_path):
    """With a time to live of an hour events of the second batch see the first's state; with one of a millisecond they don't."""
    spark, start = rocks, dt.datetime(2024, 5, 1)
    rows = [(k, 1, start + dt.timedelta(seconds=k), True, 0 if k < 5 else 1) for k in range(8)]
    for ttl, name in ((3_600_000, "long_life"), (1, "short_life")):
        path = tmp_path / name
        path.mkdir()
        stream = written(spark, path, rows, 2)
        ran(windows.stream_with_timers(stream, ["user_id"], windows.LOCK, "refused", "failed", ttl_ms=ttl), path, name)
        got = {r.event_id: r.refused for r in spark.table(name).collect()}
        assert got == {k: k >= 5 and ttl > 1 for k in range(8)}
