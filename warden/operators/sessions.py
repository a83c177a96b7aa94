"""User sessions from a log of create and remove events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warden import schemas


def current_sessions(events: DataFrame) -> DataFrame:
    """The last create of each session that no later remove ended.

    ``events(seq, session_id, user_id, op, event_ts[, user_attributes])``; one
    aggregation with map-side combine, no window.
    """
    held = [c for c in ("user_id", "user_attributes") if c in events.columns]
    last = F.max_by(F.struct("op", *held, "event_ts"), F.struct("event_ts", "seq"))
    return (
        events.groupBy("session_id")
        .agg(last.alias("s"))
        .filter(F.col("s.op") == "create")
        .select("session_id", *[F.col(f"s.{c}").alias(c) for c in held], F.col("s.event_ts").alias("created_at"))
    )


def with_session_user(accesses: DataFrame, sessions: DataFrame) -> DataFrame:
    """Accesses with the user of their session, NULL when the session is not open."""
    users = sessions.select("session_id", F.col("user_id").alias("session_user"))
    return accesses.join(users, "session_id", "left")


def identified(accesses: DataFrame, sessions: DataFrame) -> DataFrame:
    """Accesses with ``user_id`` and ``session_id``, ``unknown`` where not known."""
    return with_session_user(accesses, sessions).withColumns(
        {
            "user_id": F.coalesce("session_user", F.lit(schemas.UNKNOWN)),
            "session_id": F.coalesce("session_id", F.lit(schemas.UNKNOWN)),
        }
    ).drop("session_user")
