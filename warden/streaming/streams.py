"""The same decisions and summaries on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from warden import schemas
from warden.operators.evaluate import Engine
from warden.sources.secured import Principal, normalised, require_read, require_write, stream_sources
from warden.sources.store import Refreshed


def parse_events(messages: DataFrame, schema: str = schemas.STREAM_EVENT) -> DataFrame:
    """Message values (any source with a ``value`` column, Kafka say) -> typed columns."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")


def transaction_summary(
    events: DataFrame, allowed: list[str] | None = None, window: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """Count, sum, mean and maximum per tumbling window and department.

    Works on batch and streaming frames; on a stream, rows later than the
    watermark are dropped.
    """
    if allowed is not None:
        events = events.filter(F.col("department").isin(*allowed))
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", window), "department")
        .agg(  # fixed values: the names of the summary's columns
            F.count("*").alias("transactionCount"),
            F.sum("amount").alias("totalAmount"),
            F.avg("amount").alias("avgAmount"),
            F.max("amount").alias("maxAmount"),
        )
        .select(F.col("window.start").alias("window_start"), "department",
                "transactionCount", "totalAmount", "avgAmount", "maxAmount")
    )


def updates_to(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Sink for update mode: every batch's changed rows, tagged with the batch.

    A batch that is retried overwrites its own folder, so nothing doubles.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")

    return write


def latest_updates(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last version of each row written by :func:`updates_to`."""
    values = [c for c in updates.columns if c not in (*key, "batch_id")]
    last = F.max_by(F.struct(*values), F.col("batch_id"))
    return updates.groupBy(*key).agg(last.alias("v")).select(*key, "v.*")


def decisions_to(
    path: str, policies: Callable[[], DataFrame] | Refreshed, fmt: str = "parquet"
) -> Callable[[DataFrame, int], None]:
    """Sink that decides each micro-batch under the policies of that moment.

    Over a store's :class:`Refreshed` engine a batch without a new commit prepares nothing; a function is called, and
    its policies prepared, for each batch.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        engine = policies.engine() if isinstance(policies, Refreshed) else Engine.over(policies())
        decided = engine.evaluate(batch)
        decided.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")

    return decide


def start_stream(
    df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).foreachBatch(sink).start()


def start_secured(
    writer: DataStreamWriter, engine: Engine, sink: str, sink_format: str = "parquet", principal: Principal | None = None,
) -> StreamingQuery:
    """Start only if every source of the stream may be read and the sink written.

    The sources are those of the streaming plan itself, not what a caller names.
    """
    df = writer._df
    for path, fmt in stream_sources(df):
        require_read(df.sparkSession, engine, path, fmt, principal)
    require_write(df.sparkSession, engine, normalised(df.sparkSession, sink), sink_format, principal)
    return writer.start()


# --- state ----------------------------------------------------------------------

def session_state(events: DataFrame, idle: str = "1 day") -> DataFrame:
    """State per session and ``idle`` window from a create/remove stream (update or complete mode).

    ``open`` is false once a remove came last.  Only windows the watermark has
    not passed are kept, so state ends; a session seen in several windows has a
    row for each, and :func:`current_state` takes the last.
    """
    last = F.max_by(F.struct("op", "user_id", "event_ts", "seq"), F.struct("event_ts", "seq"))
    kept = events.withWatermark("event_ts", idle) if events.isStreaming else events
    return kept.groupBy("session_id", F.window("event_ts", idle).alias("w")).agg(last.alias("s")).select(
        "session_id", F.col("w.start").alias("window_start"), F.col("s.user_id").alias("user_id"),
        F.col("s.event_ts").alias("changed_at"), F.col("s.seq").alias("seq"), (F.col("s.op") == "create").alias("open"),
    )


def current_state(states: DataFrame) -> DataFrame:
    """The last state of each session among its windows."""
    last = F.max_by(F.struct("user_id", "changed_at", "open"), F.struct("changed_at", "seq"))
    return states.groupBy("session_id").agg(last.alias("s")).select("session_id", "s.*")


# --- state that ends by itself ----------------------------------------------------

TRACKED = "session_id string, user_id string, changed_at timestamp, seq bigint, state string"



def _session_tracker(idle: int) -> StatefulProcessor:
    """The processor of :func:`tracked_sessions`; a class of its own here, so that executors get it with the query."""

    class Tracker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.known = handle.getValueState("known", "user_id string, micros bigint, seq bigint, open boolean")

        def _keep(self, user, micros: int, seq: int, is_open: bool) -> None:
            if self.known.exists():
                self.handle.deleteTimer(self.known.get()[1] // 1000 + idle)
            self.known.update((user, micros, seq, is_open))
            self.handle.registerTimer(micros // 1000 + idle)

        def _row(self, key, state: str):
            user, micros, seq, _ = self.known.get()
            return pd.DataFrame({
                "session_id": [key[0]], "user_id": [user], "changed_at": [pd.Timestamp(micros, unit="us")], "seq": [seq],
                "state": [state],
            })

        def handleInputRows(self, key, rows, timerValues):
            newest = None
            for batch in rows:
                batch = batch.assign(micros=batch["event_ts"].to_numpy().astype("datetime64[us]").astype("int64"))
                last = batch.sort_values(["micros", "seq"]).iloc[-1]
                found = (int(last["micros"]), int(last["seq"]), last["user_id"], last["op"] == "create")
                newest = found if newest is None else max(newest, found, key=lambda f: f[:2])
            before = self.known.get()[1:3] if self.known.exists() else None
            if before is None or newest[:2] > tuple(before):
                micros, seq, user, is_open = newest
                self._keep(user, micros, seq, bool(is_open))
                yield self._row(key, "open" if is_open else "closed")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.known.exists() and self.known.get()[1] // 1000 + idle <= expiredTimerInfo.getExpiryTimeInMs():
                if self.known.get()[3]:
                    yield self._row(key, "expired")
                self.known.clear()

        def handleInitialState(self, key, initialState, timerValues) -> None:
            for row in initialState.sort_values(["changed_at", "seq"]).tail(1).itertuples():
                if row.state != "expired":
                    micros = int(pd.Timestamp(row.changed_at).value // 1000)
                    self._keep(row.user_id, micros, int(row.seq), row.state == "open")

        def close(self) -> None:
            pass

    return Tracker()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out for being later than the watermark, over the progress it remembers."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def tracked_sessions(events: DataFrame, idle: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """One state per session from a create/remove stream with a watermark on ``event_ts``; a row for each change of it.

    ``state`` is open, closed or expired.  The event with the largest (event_ts, seq) decides, in whatever order events
    arrive; the watermark drops what is later.  A session that nothing happened to for ``idle`` after the event times that the watermark
    has passed expires, and so does what is known of a closed one, which until then holds back older creates.
    ``initial`` has the sessions (columns of ``TRACKED``) at the start of the stream.  An event without a time is dropped.

    State is kept by session in the RocksDB store, a few values each; the rows of a busy session pass in batches.
    """
    spark = events.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    epoch = F.lit(0).cast("timestamp")
    length = spark.range(1).select(F.unix_millis(epoch + F.expr(f"INTERVAL {idle}"))).first()[0]
    start = None if initial is None else initial.select("session_id", "user_id", "changed_at", "seq", "state").groupBy("session_id")
    kept = events.select("session_id", "user_id", "op", "event_ts", "seq").filter("event_ts IS NOT NULL")
    return kept.groupBy("session_id").transformWithStateInPandas(
        _session_tracker(length), TRACKED, "Update", "EventTime", initialState=start
    )
