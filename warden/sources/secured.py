"""Reading and writing behind a policy check.

What is checked is what is opened: the resolved root paths of a read, the
qualified and normalised path that a write is then given.  These helpers guard
cooperating users: someone holding the raw session can go around them.  Each
check evaluates all paths at once, as one small request table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warden import schemas
from warden.functions import paths
from warden.functions.attributes import attr
from warden.operators.evaluate import Engine
from warden.operators.namespaces import NamespaceRules
from warden.operators.reports import denial_message

# Session settings that say who is asking.
USER_KEY, SESSION_KEY, APP_KEY = "spark.abac.user.id", "spark.abac.session.id", "spark.app.name"


@dataclass(frozen=True)
class Principal:
    user_id: str = schemas.UNKNOWN
    session_id: str = schemas.UNKNOWN

    @classmethod
    def of(cls, spark: SparkSession) -> Principal:
        """The principal named by the session's settings."""
        return cls(
            spark.conf.get(USER_KEY, schemas.UNKNOWN), spark.conf.get(SESSION_KEY, schemas.UNKNOWN)
        )


# --- checks as tables ----------------------------------------------------------

def access_requests(accesses: DataFrame, action: str | None = None) -> DataFrame:
    """Accesses ``(user_id, session_id, path, format[, action, app_name, access_ts])`` -> requests."""
    app = F.col("app_name") if "app_name" in accesses.columns else F.lit(schemas.UNKNOWN)
    moment = F.col("access_ts") if "access_ts" in accesses.columns else F.current_timestamp()
    session = F.coalesce("session_id", F.lit(schemas.UNKNOWN))
    environment = F.create_map(
        F.lit("spark.app.name"), attr(app, "string"),
        F.lit("spark.session.id"), attr(session, "string"),
        F.lit("data.format"), attr(F.col("format"), "string"),
    )
    return accesses.withColumns(
        {
            "subject": F.coalesce("user_id", F.lit(schemas.UNKNOWN)),
            "resource": F.col("path"),
            "action": F.lit(action) if action else F.col("action"),
            "session_id": session,
            "request_ts": moment.cast("timestamp"),
            "environment": environment,
        }
    )


def check_accesses(accesses: DataFrame, engine: Engine, action: str | None = None) -> DataFrame:
    """Accesses with ``effect, reason, permitted, message`` (NULL when permitted)."""
    decided = engine.evaluate(access_requests(accesses, action))
    message = denial_message(
        F.col("action"), F.col("resource"), F.col("subject"), F.col("session_id"), F.col("reason")
    )
    return decided.withColumn("message", F.when(~F.col("permitted"), message))


# --- checks as gates -----------------------------------------------------------

def _require(spark: SparkSession, engine: Engine, principal: Principal, wanted: Iterable[tuple[str, str]], action: str):
    rows = [(principal.user_id, principal.session_id, p, f) for p, f in wanted]
    if not rows:
        return
    app = spark.conf.get(APP_KEY, schemas.UNKNOWN)
    accesses = spark.createDataFrame(rows, "user_id string, session_id string, path string, format string")
    refused = check_accesses(accesses.withColumn("app_name", F.lit(app)), engine, action).filter("NOT permitted")
    first = refused.orderBy("path").select("message").first()
    if first is not None:
        raise PermissionError(first["message"])


def require_read(spark: SparkSession, engine: Engine, path: str, fmt: str = "parquet", principal: Principal | None = None):
    _require(spark, engine, principal or Principal.of(spark), [(path, fmt)], "read")


def require_write(spark: SparkSession, engine: Engine, path: str, fmt: str = "parquet", principal: Principal | None = None):
    _require(spark, engine, principal or Principal.of(spark), [(path, fmt)], "write")


def normalised(spark: SparkSession, path: str) -> str:
    """The path as Hadoop takes it, without ``.`` and ``..``; refused if some are left."""
    plain = _shown(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toString())
    if any(part in (".", "..") for part in plain.split("/")):
        raise PermissionError(f"access control check failed: {path} leads above its root")
    return plain


def _shown(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _as_typed(path: str, typed: str) -> str:
    """An opened path as the policies name it: without the scheme of local files if the caller left it out."""
    return path.removeprefix("file://") if "://" not in typed and not typed.startswith("file:") else path


def read_secured(
    spark: SparkSession, engine: Engine, path: str, fmt: str = "parquet", principal: Principal | None = None,
    schema=None, **options,
) -> DataFrame:
    """Read a file source the principal may read, else raise ``PermissionError``.

    The path is checked as typed (normalised), and so is every root that it
    resolves to, globs included, before the frame is handed out.
    """
    plain = normalised(spark, path)
    require_read(spark, engine, plain, fmt, principal)
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(plain)
    roots = [(_as_typed(_shown(root), path), fmt) for root, _ in sources_of(df)]
    _require(spark, engine, principal or Principal.of(spark), roots, "read")
    return df


def write_secured(
    df: DataFrame, engine: Engine, path: str, fmt: str = "parquet", mode: str = "overwrite",
    principal: Principal | None = None, **options,
) -> None:
    """Write where the principal may write; the path checked is the path written."""
    plain = normalised(df.sparkSession, path)
    require_write(df.sparkSession, engine, plain, fmt, principal)
    df.write.format(fmt).mode(mode).options(**options).save(plain)


_HARMLESS = frozenset(("LocalRelation", "Range", "OneRowRelation", "CTERelationRef"))


def sources_of(df: DataFrame) -> list[tuple[str, str]]:
    """``(root path, format)`` of every file scan of a query, subqueries included.

    Reads the analysed plan through the classic session's JVM handle, as
    :func:`columns_of` does.  Leaves that are neither file scans nor made in
    the query itself are refused.  A reference to a common table expression
    reads nothing of its own: its definition is in the plan and is looked into.
    """
    plan = df._jdf.queryExecution().analyzed()
    plans = [plan]
    nested = plan.subqueriesAll()
    plans += [nested.apply(i) for i in range(nested.size())]
    found: list[tuple[str, str]] = []
    for each in plans:
        leaves = each.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            name = leaf.getClass().getSimpleName()
            if name not in _HARMLESS:
                found += _files_of(leaf, name)
    return sorted(set(found))


def _files_of(leaf, name: str) -> list[tuple[str, str]]:
    relation = leaf.relation() if name == "LogicalRelation" else None
    if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation":
        raise PermissionError(f"access control check failed: cannot tell what {name} reads")
    fmt = _format_label(relation.fileFormat().getClass().getSimpleName())
    roots = relation.location().rootPaths()
    return [(roots.apply(k).toString(), fmt) for k in range(roots.size())]


def _format_label(class_name: str) -> str:
    for label in ("parquet", "delta", "json", "csv"):
        if label in class_name.lower():
            return label
    return schemas.UNKNOWN


def stream_sources(df: DataFrame) -> list[tuple[str, str]]:
    """``(path, format)`` of every file source of a streaming query; sources without a path count by their name."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found: list[tuple[str, str]] = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "StreamingRelation":
            source = leaf.dataSource()
            path = source.options().get("path")
            fmt = source.className()
            found.append((_shown(path.get()) if path.isDefined() else fmt, fmt))
        elif kind == "StreamingRelationV2":
            path = leaf.extraOptions().get("path")
            found.append((_shown(path) if path else leaf.sourceName(), leaf.sourceName()))
        elif kind not in _HARMLESS:
            found += _files_of(leaf, kind)
    return sorted(set(found))


def authorize(df: DataFrame, engine: Engine, principal: Principal | None = None) -> DataFrame:
    """The query unchanged if every file it scans may be read, else an error."""
    spark = df.sparkSession
    wanted = [(_shown(p), f) for p, f in sources_of(df)]
    _require(spark, engine, principal or Principal.of(spark), wanted, "read")
    return df


# --- columns that a query uses ---

# Nodes whose output columns are their children's, under the same ids: what is asked of them is asked of the children.
_PASSING = frozenset((
    "Filter", "Join", "Sort", "Window", "Generate", "GlobalLimit", "LocalLimit", "Offset", "Sample", "Repartition",
    "RepartitionByExpression", "RebalancePartitions", "WindowGroupLimit",
))
# Nodes whose output is made by their own expressions alone.
_MAKING = frozenset(("Project", "Aggregate"))


def columns_of(df: DataFrame) -> list[tuple[str, str, str]]:
    """``(root path, format, column)`` for every source column that a query uses: in its result, or only to filter, join,
    sort or group.  Columns that it drops before they do anything are not used; of nested ones the top level counts.

    The analysed plan is optimised, without what is cached, and walked from the top by expression ids.  A node that is not
    known to pass or make columns uses all of its children's.
    """
    jdf = df._jdf
    plan = jdf.sparkSession().sessionState().optimizer().execute(jdf.queryExecution().analyzed())
    found: set[tuple[str, str, str]] = set()

    def ids(attributes) -> set[int]:
        listed = attributes.toSeq()
        return {listed.apply(i).exprId().id() for i in range(listed.size())}

    def each(listed) -> list:
        return [listed.apply(i) for i in range(listed.size())]

    waiting = [(plan, ids(plan.outputSet()))]
    while waiting:
        node, asked = waiting.pop()
        name = node.getClass().getSimpleName()
        waiting += [(p, ids(p.outputSet())) for p in each(node.subqueries())]
        children = each(node.children())
        if not children and name not in _HARMLESS:
            used = [a.name() for a in each(node.output()) if a.exprId().id() in asked]
            found |= {(_shown(root), fmt, column) for root, fmt in _files_of(node, name) for column in used}
        own = ids(node.references())
        for child in children:
            offered = ids(child.outputSet())
            if name in _PASSING:
                waiting.append((child, (asked | own) & offered))
            else:
                waiting.append((child, own & offered if name in _MAKING else offered))
    return sorted(found)


def authorize_columns(df: DataFrame, engine: Engine, principal: Principal | None = None) -> DataFrame:
    """The query unchanged if every file that it scans and every column that it uses may be read, else an error.

    Columns are asked for as ``path#column``.
    """
    authorize(df, engine, principal)
    spark = df.sparkSession
    wanted = [(f"{path}#{column}", fmt) for path, fmt, column in columns_of(df)]
    _require(spark, engine, principal or Principal.of(spark), wanted, "read")
    return df


# --- row and column control ------------------------------------------------------

def secured_rows(
    df: DataFrame, resource: str, engine: Engine, principal: Principal, action: str = "read"
) -> DataFrame:
    """Rows whose resource the principal may access, decided once per resource."""
    resources = df.select(F.col(resource).alias("path")).distinct()
    accesses = resources.select(
        F.lit(principal.user_id).alias("user_id"),
        F.lit(principal.session_id).alias("session_id"),
        "path",
        paths.data_format(F.col("path")).alias("format"),
    )
    allowed = check_accesses(accesses, engine, action).filter("permitted").select(F.col("path").alias("__path"))
    return df.join(allowed, F.col(resource) == F.col("__path"), "left_semi")


def secured_columns(df: DataFrame, path: str, engine: Engine, principal: Principal) -> DataFrame:
    """Only the columns the principal may read, each asked for as ``path#column``."""
    spark = df.sparkSession
    asked = [(principal.user_id, principal.session_id, f"{path}#{c}", schemas.UNKNOWN, c) for c in df.columns]
    accesses = spark.createDataFrame(
        asked, "user_id string, session_id string, path string, format string, column string"
    )
    allowed = {r["column"] for r in check_accesses(accesses, engine, "read").filter("permitted").collect()}
    return df.select(*[c for c in df.columns if c in allowed])


# --- grant paths -------------------------------------------------------------------

def _granted_path(path: str) -> str:
    """The path without ``.`` and ``..``; what leaves its bucket, or could by alternatives in a glob, is refused."""
    scheme, mark, rest = path.partition("://")
    parts: list[str] = []
    for part in rest.split("/"):
        if part == "..":
            if len(parts) < 2:
                raise PermissionError(f"access denied: {path} leads above its bucket")
            parts.pop()
        elif part != ".":
            parts.append(part)
    if set("{}[]\\") & set(rest):
        raise PermissionError(f"access denied: {path} does not name one place")
    return scheme + mark + "/".join(parts)


def _require_grant(spark: SparkSession, rules: NamespaceRules, username: str, path: str, operation: str) -> str:
    one = spark.createDataFrame([(username, _granted_path(path), operation)], "username string, path string, operation string")
    actual = paths.to_storage_path(F.col("path"))
    row = rules.check(one.withColumn("path", actual)).first()
    if not row["allowed"]:
        raise PermissionError(f"access denied: {row['reason']}")
    return row["path"]


def read_granted(
    spark: SparkSession, rules: NamespaceRules, username: str, path: str, fmt: str = "parquet", locate=None, **options
) -> DataFrame:
    """Read a ``sas://`` path the namespace rules allow.

    ``locate`` maps the storage path to where it can be opened (a mount, say).
    """
    actual = _require_grant(spark, rules, username, path, "read")
    return spark.read.format(fmt).options(**options).load(locate(actual) if locate else actual)


def write_granted(
    df: DataFrame, rules: NamespaceRules, username: str, path: str, fmt: str = "parquet",
    overwrite: bool = False, locate=None, **options,
) -> None:
    """Write to a ``sas://`` path; without ``overwrite`` an existing path is refused."""
    actual = _require_grant(df.sparkSession, rules, username, path, "write")
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.format(fmt).mode(mode).options(**options).save(locate(actual) if locate else actual)
