import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from warden import schemas
from warden.operators.evaluate import Engine
from warden.plans import fixtures as fx
from warden.sources.secured import Principal
from warden.streaming import streams


T0 = dt.datetime(2024, 1, 1)


def batches(spark, folder, frames):
    """One file per frame, read one per micro-batch in order."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if i < len(frames) - 1 else 0)  # file times order the stream
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, sink, checkpoint, mode="update"):
    streams.start_stream(df, sink, str(checkpoint), mode, {"availableNow": True}).awaitTermination()


def test_late_rows_are_dropped(spark, tmp_path):
    def events(rows):
        data = [(str(i), "u", "Finance", "view", None, dt.datetime(2024, 1, 1, h, m), a) for i, (h, m, a) in enumerate(rows)]
        return spark.createDataFrame(data, schemas.STREAM_EVENT)

    source = batches(spark, tmp_path / "in", [events([(10, 0, 1.0), (12, 0, 2.0)]), events([(12, 1, 3.0), (12, 2, 4.0)]),
                                              events([(10, 1, 99.0), (12, 3, 5.0), (11, 56, 7.0)])])
    run(streams.transaction_summary(source, ["Finance"]), streams.updates_to(str(tmp_path / "out")), tmp_path / "cp")
    rows = streams.latest_updates(spark.read.parquet(str(tmp_path / "out")), ["window_start", "department"]).collect()
    totals = {r["window_start"].strftime("%H:%M"): (r["transactionCount"], r["totalAmount"]) for r in rows}
    assert totals == {"10:00": (1, 1.0), "12:00": (4, 14.0), "11:55": (1, 7.0)}


def test_policies_refresh_between_batches(spark, tmp_path, sf):
    requests = fx.requests(spark, sf)
    source = batches(spark, tmp_path / "in", [requests.filter("request_id < 40"), requests.filter("request_id BETWEEN 40 AND 80")])
    seen = []

    def load():
        seen.append(1)
        return fx.policies(spark, [fx.POLICY_1] if len(seen) == 1 else fx.POLICIES)

    run(source, streams.decisions_to(str(tmp_path / "out"), load), tmp_path / "cp", "append")
    found = {r["request_id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = Engine.over(fx.policies(spark, [fx.POLICY_1])).evaluate(requests.filter("request_id < 40"))
    second = Engine.over(fx.policies(spark)).evaluate(requests.filter("request_id BETWEEN 40 AND 80"))
    assert found == {r["request_id"]: r["reason"] for r in first.union(second).collect()} and len(seen) == 2


def test_session_state(spark, tmp_path):
    def rows(*r):
        data = [(q, s, u, op, T0 + dt.timedelta(minutes=q)) for q, s, u, op in r]
        return spark.createDataFrame(data, "seq long, session_id string, user_id string, op string, event_ts timestamp")

    source = batches(spark, tmp_path / "in", [rows((1, "a", "x", "create"), (2, "b", "y", "create")),
                                              rows((3, "a", "x", "remove"), (4, "b", "z", "create"))])
    run(streams.session_state(source), streams.updates_to(str(tmp_path / "out")), tmp_path / "cp")
    state = streams.current_state(streams.latest_updates(spark.read.parquet(str(tmp_path / "out")), ["session_id", "window_start"]))
    assert {(r["session_id"], r["user_id"], r["open"]) for r in state.collect()} == {("a", "x", False), ("b", "z", True)}


def session_events(spark, *rows):
    data = [(q, s, u, op, T0 + dt.timedelta(minutes=m)) for q, s, u, op, m in rows]
    return spark.createDataFrame(data, "seq long, session_id string, user_id string, op string, event_ts timestamp")


def test_tracked_sessions(spark, tmp_path):
    """Out of order, late, expired, closed and reopened sessions, over restarts, from initial sessions."""
    initial = spark.createDataFrame(
        [("old", "o", T0, 0, "open"), ("gone", "g", T0, 0, "expired")], streams.TRACKED)
    parts = [
        session_events(spark, (1, "a", "x", "create", 10), (3, "b", "y", "remove", 40), (4, "c", "z", "create", 41), (7, "k", "m", "create", 100)),
        # b's create came before its remove; c is replaced; 5 minutes is later than 100 - 30
        session_events(spark, (2, "b", "y", "create", 35), (5, "c", "w", "create", 101), (6, "d", "v", "create", 5), (8, "k", "m", "create", 95)),
        session_events(spark, (9, "a", "x2", "create", 200), (10, "n", "q", "create", 300)),
    ]
    dropped = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")).withWatermark("event_ts", "30 minutes")
        query = streams.start_stream(
            streams.tracked_sessions(source, "1 hour", initial), streams.updates_to(str(tmp_path / "out")), str(tmp_path / "cp"),
            trigger={"availableNow": True})
        query.awaitTermination()
        dropped.append(streams.dropped_rows(query))
    rows = spark.read.parquet(str(tmp_path / "out"))
    states = {r["session_id"]: (r["user_id"], r["seq"], r["state"]) for r in streams.latest_updates(rows, ["session_id"]).collect()}
    assert states == {
        "old": ("o", 0, "expired"), "a": ("x2", 9, "expired"), "b": ("y", 3, "closed"), "c": ("w", 5, "expired"),
        "k": ("m", 7, "expired"), "n": ("q", 10, "open")}
    assert dropped == [0, 2, 0]  # b's create at 35 and d's at 5
    assert rows.filter("session_id = 'a' AND state = 'expired'").count() == 2


def test_stream_start_is_checked(spark, tmp_path):
    policy = {"id": "p", "name": "p", "enabled": True, "defaultEffect": "DENY", "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "target": {"actions": ["read"]}}]}
    engine = Engine.over(fx.policies(spark, [policy]))
    ann = Principal("u", "s")
    rate = spark.readStream.format("rate").load()
    with pytest.raises(PermissionError, match="Write access denied"):
        streams.start_secured(rate.writeStream.format("noop"), engine, str(tmp_path / "out"), principal=ann)
    # What the stream reads counts, whatever the caller says of it.
    for name in ("open", "closed"):
        spark.range(3).write.parquet(str(tmp_path / name))
    policy["target"] = {"resources": ["*/open", "*/out"]}
    policy["rules"][0]["target"] = {"actions": ["read", "write"]}
    engine = Engine.over(fx.policies(spark, [policy]))
    for name, refused in (("open", False), ("closed", True)):
        source = spark.readStream.schema("id bigint").parquet(str(tmp_path / name))
        writer = source.writeStream.format("noop").trigger(availableNow=True)
        if refused:
            with pytest.raises(PermissionError, match="Access denied to resource .*closed"):
                streams.start_secured(writer, engine, str(tmp_path / "out"), principal=ann)
        else:
            streams.start_secured(writer, engine, str(tmp_path / "out"), principal=ann).awaitTermination()


def test_parse_events(spark):
    line = '{"eventId":"1","department":"HR","timestamp":"2024-01-01T00:00:00Z","amount":2.5}'
    row = streams.parse_events(spark.createDataFrame([(line,)], "value string").select(F.col("value").cast("binary"))).first()
    assert row["department"] == "HR" and row["amount"] == 2.5
