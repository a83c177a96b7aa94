"""Reports over decisions and access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warden import schemas
from warden.functions import attributes, paths
from warden.operators.evaluate import Engine

# Denial types.
EXPLICIT_DENY, NO_APPLICABLE_POLICY, UNKNOWN = "EXPLICIT_DENY", "NO_APPLICABLE_POLICY", "UNKNOWN"
CONDITION_FAILED, INSUFFICIENT_CLEARANCE = "CONDITION_FAILED", "INSUFFICIENT_CLEARANCE"


def denial_type(effect: Column) -> Column:
    return (
        F.when(effect == schemas.DENY, F.lit(EXPLICIT_DENY))
        .when(effect == schemas.NOT_APPLICABLE, F.lit(NO_APPLICABLE_POLICY))
        .otherwise(F.lit(UNKNOWN))
    )


def denial_message(action: Column, resource: Column, user: Column, session: Column, reason: Column) -> Column:
    # The wording of denials.
    opening = F.when(action == "write", F.lit("Write access denied")).otherwise(F.lit("Access denied"))
    return F.format_string(
        "%s to resource '%s' for user '%s' in session '%s'. Reason: %s", opening, resource, user, session, reason
    )


def permitted_requests(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    allowed = decisions.filter(F.col("effect") == schemas.PERMIT).select("request_id")
    return requests.join(allowed, "request_id", "left_semi")


def denied_requests(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    allowed = decisions.filter(F.col("effect") == schemas.PERMIT).select("request_id")
    return requests.join(allowed, "request_id", "left_anti")


def denials(decided: DataFrame) -> DataFrame:
    """Decided requests that were not permitted, with type and message."""
    session = F.coalesce("session_id", F.lit(schemas.UNKNOWN))
    return decided.filter(F.col("effect") != schemas.PERMIT).withColumns(
        {
            "denial_type": denial_type(F.col("effect")),
            "message": denial_message(
                F.col("action"), F.col("resource"), F.col("subject"), session, F.col("reason")
            ),
        }
    )


def security_alerts(decided: DataFrame) -> DataFrame:
    """Accesses no policy was found for."""
    text = F.format_string(  # fixed value: the wording of the alert
        "SECURITY ALERT: User %s attempted to access resource %s but no policies were found. "
        "This could indicate a misconfiguration or unauthorized access attempt.",
        F.col("subject"), F.col("resource"),
    )
    found = denials(decided).filter(F.col("denial_type") == NO_APPLICABLE_POLICY)
    return found.withColumn("alert", text)


def denial_summary(decided: DataFrame) -> DataFrame:
    """Denials by type and resource with subtotals (NULL marks a total)."""
    return (
        denials(decided)
        .rollup("denial_type", "resource")
        .agg(F.count("*").alias("denials"), F.count_distinct("subject").alias("users"))
    )


def detailed_denial_type(trace: Column, effect: Column) -> Column:
    """Denial type refined by the first condition that failed in the trace."""
    failed = F.filter(
        F.flatten(F.flatten(F.transform(trace, lambda p: F.transform(p["rules"], lambda r: r["conditions"])))),
        lambda c: ~c["satisfied"],
    )
    first = F.get(failed, F.lit(0))
    return (
        F.when(effect == schemas.PERMIT, F.lit(None).cast("string"))
        .when(first["attribute"] == "user.clearanceLevel", F.lit(INSUFFICIENT_CLEARANCE))
        .when(first.isNotNull(), F.lit(CONDITION_FAILED))
        .otherwise(denial_type(effect))
    )


def access_profile(decided: DataFrame) -> DataFrame:
    """Requests, permits and denials by provider, bucket, namespace and sensitivity."""
    path = F.col("resource")
    located = decided.select(
        F.coalesce(paths.provider(path), F.lit("unsupported")).alias("provider"),
        F.coalesce(paths.bucket(path), F.lit("")).alias("bucket"),
        F.coalesce(paths.path_namespace(path), F.lit("")).alias("namespace"),
        attributes.sensitivity(path).alias("sensitivity"),
        "effect",
    )
    return located.groupBy("provider", "bucket", "namespace", "sensitivity").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("effect") == schemas.PERMIT).alias("permits"),
        F.count_if(F.col("effect") != schemas.PERMIT).alias("denials"),
    )


def what_if(requests: DataFrame, before: Engine, after: Engine) -> DataFrame:
    """The same requests under two policy sets, counted by change.

    The second set decides the rows the first has decided: nothing is joined.
    """
    old = before.evaluate(requests).withColumnRenamed("effect", "old_effect").drop("reason", "permitted")
    new = after.evaluate(old).withColumnRenamed("effect", "new_effect")
    return new.groupBy("old_effect", "new_effect").agg(F.count("*").alias("requests"))


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Policies of both sets whose like, in every field, the other set lacks; a changed one is there as it was and as it is.

    Policies meet by their content in a window: a join would be planned by the size of the files that they are parsed
    from, which is far below their own, and send a whole set through the driver.
    """
    columns = sorted(before.columns)
    both = before.select(*columns, F.lit(0).alias("__side")).unionByName(after.select(*columns, F.lit(1).alias("__side")))
    alike = Window.partitionBy("__content")
    sides = F.max("__side").over(alike) - F.min("__side").over(alike)
    content = F.to_json(F.struct(*columns))
    found = both.withColumn("__content", content).withColumn("__sides", sides).filter("__sides = 0")
    return found.select(*before.columns)


def reevaluated(
    decided: DataFrame, before: DataFrame, after: DataFrame, resolver=None, operators=None
) -> DataFrame:
    """Decided requests that a policy which differs between two policy tables can reach, decided again.

    ``decided`` are requests with the ``effect`` they got under ``before``; it comes back as ``old_effect`` beside the new
    ``effect, reason, permitted``.  All others would get the decision they have: of the policies whose targets they
    meet, all are in both sets, in the same order.
    """
    changed = differing(before, after).drop("valid_from", "valid_to")  # a policy may reach a request at another time
    old = decided.withColumnRenamed("effect", "old_effect").drop("reason", "permitted")
    reached = Engine.over(changed, resolver, operators).reached(old)
    return Engine.over(after, resolver, operators).evaluate(reached)


def what_if_changed(decided: DataFrame, before: DataFrame, after: DataFrame, resolver=None, operators=None) -> DataFrame:
    """:func:`what_if` from decisions that exist: only requests that the changed policies reach are evaluated."""
    old, new, n = F.col("old_effect"), F.col("new_effect"), F.col("requests")
    again = reevaluated(decided, before, after, resolver, operators).withColumnRenamed("effect", "new_effect")
    moved = again.groupBy("old_effect", "new_effect").agg(F.count("*").alias("requests"))
    # each such request leaves the count of those that keep their decision
    moves = F.array(F.struct(old, new, n), F.struct(old, old.alias("new_effect"), (-n).alias("requests")))
    kept = decided.groupBy(F.col("effect").alias("old_effect"), F.col("effect").alias("new_effect")).agg(F.count("*").alias("requests"))
    total = kept.unionByName(moved.select(F.inline(moves))).groupBy("old_effect", "new_effect").agg(F.sum("requests").alias("requests"))
    return total.filter("requests <> 0")


def compare_decisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two decision tables of the same requests, counted by change."""
    old = before.select("request_id", F.col("effect").alias("old_effect"))
    new = after.select("request_id", F.col("effect").alias("new_effect"))
    return old.join(new, "request_id", "full").groupBy("old_effect", "new_effect").agg(F.count("*").alias("requests"))


def group_summary(df: DataFrame, group: str, value: str, count_name: str, mean_name: str) -> DataFrame:
    """Rows and mean value per group."""
    return df.groupBy(group).agg(F.count("*").alias(count_name), F.avg(value).alias(mean_name))


def access_matrix(decided: DataFrame) -> DataFrame:
    """A row for each user, resource and action that was asked for: whether it was permitted."""
    return decided.groupBy("subject", "resource", "action").agg(
        F.max(F.col("effect") == schemas.PERMIT).alias("permitted")
    )
