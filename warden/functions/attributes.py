"""Attribute resolution: what policies can see of a request.

Later steps win: request fields, then the environment, then time, user and
resource attributes.  Nothing is put in a map; each attribute some condition
names becomes one column, and Catalyst prunes the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warden.functions.paths import java_split_trim


class Operand(NamedTuple):
    """One side of a comparison. ``kind`` is NULL when the value is missing."""

    kind: Column
    text: Column
    num: Column
    items: Column | None = None
    valid: Column | None = None


@dataclass(frozen=True)
class Attribute:
    column: str
    source: str  # subject | resource | request | time
    total: bool = False  # set for every request, so the environment never shows
    overridable: bool = False  # the environment's value wins when present


# The attribute names policies refer to.
ATTRIBUTES: dict[str, Attribute] = {
    "subject": Attribute("subject", "request", overridable=True),
    "resource": Attribute("resource", "request", overridable=True),
    "action": Attribute("action", "request", overridable=True),
    "sessionId": Attribute("session_id", "request", overridable=True),
    "currentTime": Attribute("currentTime", "time", total=True),
    "currentHour": Attribute("currentHour", "time", total=True),
    "currentDay": Attribute("currentDay", "time", total=True),
    "user.username": Attribute("user_username", "subject", total=True),
    "user.domain": Attribute("user_domain", "subject"),
    "user.department": Attribute("user_department", "subject"),
    "user.role": Attribute("user_role", "subject"),
    "user.clearanceLevel": Attribute("user_clearanceLevel", "subject", total=True),
    "resource.path": Attribute("resource_path", "resource", total=True),
    "resource.type": Attribute("resource_type", "resource"),
    "resource.bucket": Attribute("resource_bucket", "resource"),
    "resource.prefix": Attribute("resource_prefix", "resource"),
    "resource.sensitivityLevel": Attribute("resource_sensitivityLevel", "resource", total=True),
}

_KINDS = {"string": "string", "int": "int", "bigint": "long", "double": "double", "boolean": "bool"}


def flat_name(name: str) -> str:
    """``user.department`` -> ``user_department``, the form expressions use."""
    return name.replace(".", "_")


# --- subject -----------------------------------------------------------------

def username(subject: Column) -> Column:
    return F.substring_index(subject, "@", 1)


def domain(subject: Column) -> Column:
    return F.when(F.contains(subject, F.lit("@")), F.get(F.split(subject, "@"), F.lit(1)))


def subject_error(subject: Column) -> Column:
    """Message for a subject whose domain part is missing, else NULL."""
    return F.when(subject.rlike(r"\A@+\z"), F.lit("Index 0 out of bounds for length 0")).when(
        subject.rlike(r"\A[^@]*@+\z"), F.lit("Index 1 out of bounds for length 1")
    )


# User profile by username prefix (department, role, clearance).
_PROFILES = (
    ("hr_", "HR", None, 2),
    ("finance_", "Finance", None, 3),
    ("manager_", None, "Manager", 4),
)
_OTHER_PROFILE = ("General", None, 1)


def _profile(user: Column, index: int, otherwise) -> Column:
    chain = F.when(user.isNull(), F.lit(None))
    for prefix, *values in _PROFILES:
        chain = chain.when(F.startswith(user, F.lit(prefix)), F.lit(values[index]))
    return chain.otherwise(F.lit(otherwise))


def department(user: Column) -> Column:
    return _profile(user, 0, _OTHER_PROFILE[0]).cast("string")


def role(user: Column) -> Column:
    return _profile(user, 1, _OTHER_PROFILE[1]).cast("string")


def clearance(user: Column) -> Column:
    return _profile(user, 2, _OTHER_PROFILE[2]).cast("int")


# --- resource ----------------------------------------------------------------

def resource_type(resource: Column) -> Column:
    return F.when(F.startswith(resource, F.lit("s3://")), F.lit("s3"))


def _s3_parts(resource: Column) -> Column:
    return java_split_trim(F.replace(resource, F.lit("s3://"), F.lit("")), "/")


def resource_bucket(resource: Column) -> Column:
    return F.when(F.startswith(resource, F.lit("s3://")), F.get(_s3_parts(resource), F.lit(0)))


def resource_prefix(resource: Column) -> Column:
    parts = _s3_parts(resource)
    return F.when(
        F.startswith(resource, F.lit("s3://")) & (F.size(parts) > 1),
        F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/"),
    )


def sensitivity(resource: Column) -> Column:
    # Path marks and their levels, first match wins.
    return (
        F.when(F.contains(resource, F.lit("/sensitive/")) | F.contains(resource, F.lit("/pii/")), 5)
        .when(F.contains(resource, F.lit("/confidential/")), 4)
        .when(F.contains(resource, F.lit("/internal/")), 3)
        .otherwise(1)
        .cast("int")
    )


# --- time --------------------------------------------------------------------

def current_time(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def current_hour(ts: Column) -> Column:
    return F.hour(ts)


def current_day(ts: Column) -> Column:
    return F.upper(F.date_format(ts, "EEEE"))


# --- resolvers ---------------------------------------------------------------

def with_time_attributes(df: DataFrame) -> DataFrame:
    ts = F.col("request_ts")
    return df.withColumns(
        {"currentTime": current_time(ts), "currentHour": current_hour(ts), "currentDay": current_day(ts)}
    )


def with_resource_attributes(df: DataFrame) -> DataFrame:
    resource = F.col("resource")
    return df.withColumns(
        {
            "resource_path": resource,
            "resource_type": resource_type(resource),
            "resource_bucket": resource_bucket(resource),
            "resource_prefix": resource_prefix(resource),
            "resource_sensitivityLevel": sensitivity(resource),
        }
    )


def with_user_attributes(df: DataFrame) -> DataFrame:
    df = df.withColumns({"user_username": username(F.col("subject")), "user_domain": domain(F.col("subject"))})
    user = F.col("user_username")
    return df.withColumns(
        {"user_department": department(user), "user_role": role(user), "user_clearanceLevel": clearance(user)}
    )


def resolve_attributes(df: DataFrame) -> DataFrame:
    """Add one typed column per known attribute."""
    return with_resource_attributes(with_user_attributes(with_time_attributes(df)))


@dataclass(frozen=True)
class Resolver:
    """A pluggable resolver: a DataFrame function and what it provides."""

    apply: Callable[[DataFrame], DataFrame] = resolve_attributes
    attributes: Mapping[str, Attribute] = field(default_factory=lambda: dict(ATTRIBUTES))


def directory_resolver(directory: DataFrame, key: str = "username") -> Resolver:
    """Take department, role and clearance from a user directory table.

    ``directory(username, department, role, clearance)``; the join is left to
    the optimiser, which broadcasts the directory only if it is small.  Of
    several rows of a user that with the lowest clearance counts, then the
    first department and role by name.
    """
    row = F.struct(F.col("clearance").cast("int").alias("clearance"), "department", "role")
    users = directory.groupBy(F.col(key).alias("__user")).agg(F.min(row).alias("r")).select(
        "__user",
        F.col("r.department").alias("user_department"),
        F.col("r.role").alias("user_role"),
        F.col("r.clearance").alias("user_clearanceLevel"),
    )

    def apply(df: DataFrame) -> DataFrame:
        df = with_resource_attributes(with_time_attributes(df))
        df = df.withColumns({"user_username": username(F.col("subject")), "user_domain": domain(F.col("subject"))})
        return df.join(users, df["user_username"] == users["__user"], "left").drop("__user")

    attributes = dict(ATTRIBUTES)
    attributes["user.clearanceLevel"] = Attribute("user_clearanceLevel", "subject")
    return Resolver(apply, attributes)


def session_resolver(sessions: DataFrame) -> Resolver:
    """Let the attributes of a request's open session stand before those its subject implies.

    ``sessions(session_id, user_attributes map<string,string>)``, one row a
    session; ``department``, ``role`` and ``clearanceLevel`` are looked up.
    """
    held = sessions.select(F.col("session_id").alias("__session"), F.col("user_attributes").alias("__held"))

    def apply(df: DataFrame) -> DataFrame:
        df = resolve_attributes(df).join(held, F.col("session_id") == F.col("__session"), "left")
        given = lambda name: F.element_at("__held", F.lit(name))
        return df.withColumns({
            "user_department": F.coalesce(given("department"), "user_department"),
            "user_role": F.coalesce(given("role"), "user_role"),
            "user_clearanceLevel": F.coalesce(given("clearanceLevel").try_cast("int"), "user_clearanceLevel"),
        }).drop("__session", "__held")

    return Resolver(apply)


# --- reading attributes ------------------------------------------------------

def attr(value: Column, kind: str) -> Column:
    """A typed attribute value, for building environments."""
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("text"))


def _environment_value(df: DataFrame, name: str) -> Column | None:
    if "environment" not in df.columns:
        return None
    value = F.element_at(F.col("environment"), F.lit(name))
    if df.schema["environment"].dataType.valueType.typeName() == "string":
        return F.when(value.isNotNull(), F.struct(F.lit("string").alias("kind"), value.alias("text")))
    return value


def _column_kind(df: DataFrame, column: str) -> str:
    return _KINDS[df.schema[column].dataType.simpleString()]


def operand(df: DataFrame, name: str, attributes: Mapping[str, Attribute]) -> Operand:
    """The named attribute of each request in a resolved DataFrame."""
    spec = attributes.get(name)
    env = _environment_value(df, name)
    if spec is None or spec.column not in df.columns:
        if env is None:
            nothing = F.lit(None).cast("string")
            return Operand(nothing, nothing, F.lit(None).cast("double"))
        return Operand(env["kind"], env["text"], env["text"].try_cast("double"))

    value = F.col(spec.column)
    kind = _column_kind(df, spec.column)
    own = Operand(
        F.lit(kind) if spec.total else F.when(value.isNotNull(), F.lit(kind)),
        value.cast("string"),
        value.try_cast("double") if kind == "string" else value.cast("double"),
    )
    if spec.total or env is None:
        return own
    use_env = F.array_contains(F.map_keys(F.col("environment")), name) if spec.overridable else value.isNull()
    use_env = F.coalesce(use_env, F.lit(False))
    return Operand(
        F.when(use_env, env["kind"]).otherwise(own.kind),
        F.when(use_env, env["text"]).otherwise(own.text),
        F.when(use_env, env["text"].try_cast("double")).otherwise(own.num),
    )


def expression_value(df: DataFrame, flat: str, attributes: Mapping[str, Attribute]) -> Column:
    """The value an expression sees under a flattened name (NULL if absent)."""
    for name, spec in attributes.items():
        if flat_name(name) == flat and spec.column in df.columns:
            if spec.total or _column_kind(df, spec.column) != "string":
                return F.col(spec.column)
            return operand(df, name, attributes).text
    if "environment" not in df.columns:
        return F.lit(None).cast("string")
    entry = F.get(
        F.filter(F.map_entries("environment"), lambda e: F.translate(e["key"], ".", "_") == flat), F.lit(0)
    )
    is_text = df.schema["environment"].dataType.valueType.typeName() == "string"
    return entry["value"] if is_text else entry["value"]["text"]
