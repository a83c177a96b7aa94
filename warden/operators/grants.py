"""Time-limited access grants: checking requests, issuing, expiry, use, moves.

A grant holds everything about a signed URL but the signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warden.functions import paths
from warden.operators.namespaces import NamespaceRules
from warden.operators.sequences import micros, running_max
from warden.session import written

# Operations, default lifetime and messages.
OPERATIONS = ("read", "write", "delete")
DEFAULT_HOURS = 1
_UNAUTHENTICATED = "Authentication required"
_NO_PATH = "Path is required"
_BAD_OPERATION = "Invalid operation. Must be one of: read, write, delete"


def check_requests(requests: DataFrame) -> DataFrame:
    """Fill defaults and add ``status, error`` (400 or 401; 200 so far otherwise)."""
    path, user = F.col("path"), F.col("username")
    operation = F.coalesce(F.nullif(F.col("operation"), F.lit("")), F.lit("read"))
    hours = F.when(F.col("expiry_hours") > 0, F.col("expiry_hours")).otherwise(F.lit(DEFAULT_HOURS))
    filled = requests.withColumns({"operation": operation, "expiry_hours": hours})
    error = (
        F.when(user.isNull(), F.lit(_UNAUTHENTICATED))
        .when(path.isNull() | (path == ""), F.lit(_NO_PATH))
        .when(~F.col("operation").isin(*OPERATIONS), F.lit(_BAD_OPERATION))
    )
    status = F.when(error.isNull(), F.lit(200)).when(user.isNull(), F.lit(401)).otherwise(F.lit(400))
    return filled.withColumns({"status": status, "error": error})


def answer_requests(requests: DataFrame, rules: NamespaceRules) -> DataFrame:
    """Every grant request with its outcome, and the grant where allowed."""
    checked = rules.check(check_requests(requests)).withColumn("ref", paths.object_reference(F.col("path")))
    fine = F.col("status") == 200
    refused = F.coalesce(
        F.when(~F.col("allowed"), F.concat(F.lit("access denied: "), F.col("reason"))), F.col("ref.error")
    )
    status = F.when(fine & refused.isNotNull(), F.lit(403)).otherwise(F.col("status"))
    error = F.when(fine, refused).otherwise(F.col("error"))
    answered = checked.withColumns({"status": status, "error": error})
    granted = F.col("status") == 200
    provider = paths.provider(F.col("path"))
    url = F.when(provider == "azure", paths.blob_url(F.col("ref.account"), F.col("ref.container"), F.col("ref.object")))
    expires = F.timestamp_add("HOUR", F.col("expiry_hours"), F.col("request_ts"))
    return answered.select(
        *[c for c in answered.columns if c not in ("ref", "allowed", "reason")],
        F.when(granted, provider).alias("provider"),
        F.when(granted, F.col("ref.account")).alias("account"),
        F.when(granted, F.col("ref.container")).alias("container"),
        F.when(granted, F.col("ref.object")).alias("object"),
        F.when(granted, paths.grant_permissions(provider, F.col("operation"))).alias("permissions"),
        F.when(granted, url).alias("url"),
        F.when(granted, expires).alias("expires_at"),
    )


def issue_grants(requests: DataFrame, rules: NamespaceRules) -> DataFrame:
    """Grants of the allowed requests; ``issued_at`` is the request time."""
    answered = answer_requests(requests, rules).filter("status = 200")
    return answered.drop("status", "error").withColumnRenamed("request_ts", "issued_at")


def expired(grants: DataFrame, at: Column) -> DataFrame:
    return grants.filter(F.col("expires_at") < at)


def active(grants: DataFrame, at: Column) -> DataFrame:
    return grants.filter(F.col("expires_at") >= at)


def covering_grant(accesses: DataFrame, grants: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Accesses with the grant that covered them, if any.

    Of the grants issued for the same path and operation up to the access, the
    one that expires last decides.  A running maximum over time buckets finds
    it: no pairs of accesses and grants are built, and a path holding a large
    share of all accesses is spread over its buckets.
    """
    key = ["path", "operation"]
    probes = accesses.withColumns({"__t": micros(F.col("request_ts")), "__kind": F.lit(1), "__grant": _no_grant()})
    offers = grants.select(
        *key,
        micros(F.col("issued_at")).alias("__t"),
        F.lit(0).alias("__kind"),
        F.struct(
            F.col("expires_at").alias("expires_at"), F.col("request_id").cast("bigint").alias("grant_id")
        ).alias("__grant"),
    )
    both = probes.unionByName(offers, allowMissingColumns=True)
    scanned = running_max(both, key, "__t", ["__kind"], "__grant", "__best", bucket_seconds * 1_000_000)
    best = F.col("__best")
    covers = F.coalesce(best["expires_at"] >= F.col("request_ts"), F.lit(False))
    return scanned.filter("__kind = 1").select(
        *accesses.columns,
        covers.alias("granted"),
        F.when(covers, best["grant_id"]).alias("grant_id"),
        F.when(covers, best["expires_at"]).alias("expires_at"),
    )


def _no_grant() -> Column:
    return F.lit(None).cast("struct<expires_at:timestamp,grant_id:bigint>")


# Outcomes of moves.
MOVE = "move"
_NO_SOURCE, _TARGET_EXISTS, _REFUSED = "source does not exist", "target exists", "access denied"
_SOURCE_TAKEN, _TARGET_TAKEN, _CYCLE = "source taken by another move", "target taken by another move", "cycle"


def plan_moves(moves: DataFrame, inventory: DataFrame, rules: NamespaceRules, order: str = "request_id") -> DataFrame:
    """Moves ``(username, src, dst)`` with the grants they need, the ``outcome``, and the ``step`` in which to make them.

    A move reads and deletes the source and writes the target, so it needs three grants.  Of the moves that have them and
    an existing source, the first by ``order`` (a column without repeats) has the source, and of those that have their
    source, the first has the target.  A target that exists must be moved away first, by a move that is itself made:
    such chains are made from their free end, one step a move.  Moves that wait for each other in a circle, or for a
    target that stays, are refused.  A move to an existing path that nobody moves claims nothing.
    """

    def with_verdict(df: DataFrame, operation: str, column: str, name: str) -> DataFrame:
        asked = df.withColumns({"path": paths.to_storage_path(F.col(column)), "operation": F.lit(operation)})
        return rules.check(asked).withColumnRenamed("allowed", name).drop("path", "operation", "reason")

    known = inventory.select(F.col("path").alias("__path")).distinct()
    found = (
        moves.join(known.withColumn("src_exists", F.lit(True)), F.col("src") == F.col("__path"), "left")
        .drop("__path")
        .join(known.withColumn("dst_exists", F.lit(True)), F.col("dst") == F.col("__path"), "left")
        .drop("__path")
        .withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("src_exists", "dst_exists")})
    )
    for operation, column, name in (("read", "src", "may_read"), ("write", "dst", "may_write"), ("delete", "src", "may_delete")):
        found = with_verdict(found, operation, column, name)
    may = F.col("may_read") & F.col("may_write") & F.col("may_delete")
    refused = (
        F.when(~F.col("src_exists"), F.lit(_NO_SOURCE))
        .when(~may, F.lit(_REFUSED))
        .when(F.col("src") == F.col("dst"), F.lit(_TARGET_EXISTS))
    )
    found = written(found.withColumn("__refused", refused))
    settled = settle_moves(found.filter("__refused IS NULL").select(F.col(order).alias("id"), "src", "dst", "dst_exists"))
    joined = found.join(settled.select(F.col("id").alias(order), "outcome", "step"), order, "left")
    return joined.withColumn("outcome", F.coalesce("__refused", "outcome")).drop("__refused")


def settle_moves(wanted: DataFrame) -> DataFrame:
    """``id, outcome, step`` of allowed moves ``(id, src, dst, dst_exists)`` with existing sources.

    Every source and every target is given to one move by partial aggregation, so a path that most moves want is no hot
    key.  What is left is chains and circles: each move waits for the one, at most, that frees its target.  Waiting is
    followed by doubling, so a chain of n moves takes log2(n) rounds; what waits longer than all moves is a circle.
    """
    sources = wanted.select(F.col("src").alias("dst")).distinct()
    stays = wanted.filter("dst_exists").join(sources, "dst", "left_anti").select("id").withColumn("__stays", F.lit(True))
    open_yet = wanted.join(stays, "id", "left").withColumn("__stays", F.coalesce("__stays", F.lit(False)))
    having = open_yet.filter(~F.col("__stays")).groupBy("src").agg(F.min(F.struct("id", "dst", "dst_exists")).alias("m"))
    having = having.select("m.id", "src", "m.dst", "m.dst_exists")
    made = having.groupBy("dst").agg(F.min(F.struct("id", "src", "dst_exists")).alias("m")).select("m.id", "m.src", "dst", "m.dst_exists")
    having, made = written(having.select("id")), written(made)
    frees = made.select(F.col("src").alias("dst"), F.col("id").alias("next"))
    state = made.join(frees, "dst", "left").select(
        "id", "next", F.lit(1).alias("step"), F.when(F.col("next").isNull(), ~F.col("dst_exists")).alias("free")
    )
    ended, waiting = written(state.filter("next IS NULL")), written(state.filter("next IS NOT NULL"))
    left = waiting.count()
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        both = ended.unionByName(waiting)
        ahead = both.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("step").alias("more"), F.col("free").alias("end"))
        further = written(waiting.join(ahead, "next").select(
            "id", F.col("then").alias("next"), (F.col("step") + F.col("more")).alias("step"), F.col("end").alias("free")
        ))
        ended = written(ended.unionByName(further.filter("next IS NULL")))
        waiting = further.filter("next IS NOT NULL")
        left = waiting.count()
    fate = ended.select("id", "step", F.when(F.col("free"), F.lit(MOVE)).otherwise(F.lit(_TARGET_EXISTS)).alias("fate"))
    fate = fate.unionByName(waiting.select("id", "step", F.lit(_CYCLE).alias("fate")))
    named = open_yet.select("id", "__stays").join(having.withColumn("has", F.lit(True)), "id", "left").join(fate, "id", "left")
    outcome = (
        F.when(F.col("__stays"), F.lit(_TARGET_EXISTS))
        .when(F.col("has").isNull(), F.lit(_SOURCE_TAKEN))
        .otherwise(F.coalesce("fate", F.lit(_TARGET_TAKEN)))
    )
    return named.select("id", outcome.alias("outcome"), F.when(outcome == MOVE, F.col("step")).alias("step"))
