"""Audit records: one JSON line per decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warden import schemas
from warden.functions import attributes as at


def audit_records(decided: DataFrame) -> DataFrame:
    """Decided requests (optionally with ``trace``) -> audit columns."""
    user = at.username(F.col("subject"))
    visited = F.transform("trace", lambda p: p["policy_id"]) if "trace" in decided.columns else F.array().cast("array<string>")
    return decided.select(
        F.col("request_ts").alias("timestamp"),
        F.when(F.col("effect") == schemas.PERMIT, F.lit("ACCESS_GRANTED")).otherwise(F.lit("ACCESS_DENIED")).alias("event"),
        F.coalesce("subject", F.lit(schemas.UNKNOWN)).alias("user"),
        F.coalesce("session_id", F.lit(schemas.UNKNOWN)).alias("session"),
        "resource",
        "action",
        "reason",
        visited.alias("policy_evaluated"),
        F.struct(
            at.department(user).alias("department"), at.clearance(user).alias("clearance_level")
        ).alias("user_attributes"),
        F.struct(at.sensitivity(F.col("resource")).alias("sensitivity_level")).alias("resource_attributes"),
    )


def audit_lines(decided: DataFrame) -> DataFrame:
    """``(date, line)`` with the record as JSON text."""
    records = audit_records(decided)
    return records.select(F.to_date("timestamp").alias("date"), F.to_json(F.struct(*records.columns)).alias("line"))


def write_audit(decided: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines in one folder per day."""
    records = audit_records(decided).withColumn("date", F.to_date("timestamp"))
    records.write.mode(mode).partitionBy("date").json(path)
