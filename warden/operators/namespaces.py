"""Namespace rules: may a service account touch a path?

Rules are a table ``(rule_set, rule_id, operation, match, prefix,
service_accounts)``.  ``match`` is ``namespace`` (path and principal share the
namespace), ``prefix`` or ``any``.  A request is allowed as soon as one rule
of one rule set allows it.  Rules stay a table: distinct requests are joined
with them on folder, namespace and account.

Kept on purpose: with no rule sets at all everything is allowed, and a
principal without a namespace matches paths without one.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warden.functions.paths import path_namespace
from warden.functions.principals import principal_account, principal_namespace
from warden.operators.policyset import UNROUTED, folder_of, folders_above

RULES = (
    "rule_set string, rule_id string, operation string, match string, prefix string, service_accounts array<string>"
)
_RULES_JSON = "array<struct<rule_id:string,operation:string,match:string,prefix:string,service_accounts:array<string>>>"

# The standard rules.
STANDARD_SET = "standard"
STANDARD_RULES = (
    (STANDARD_SET, "own-read", "read", "namespace", None, None),
    (STANDARD_SET, "own-write", "write", "namespace", None, ["spark-driver", "spark-executor"]),
    (STANDARD_SET, "admin-delete", "delete", "any", None, ["spark-admin"]),
    (STANDARD_SET, "shared-read", "read", "prefix", "s3://shared-bucket/", None),
    (STANDARD_SET, "public-read", "read", "prefix", "s3://public-datasets/", None),
)
ALLOWED = "Allowed by policy: "
DENIED = "Access denied by all policies"
OPEN = "No policies configured - allowing all access"


def standard_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STANDARD_RULES), RULES)


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rules, errors)`` from a folder of JSON files, one rule set per file.

    Files that do not parse and rules that make no sense are skipped and
    reported.  Read again per batch to pick up changes.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "").alias("rule_set"),
        F.from_json("value", _RULES_JSON).alias("rules"),
    )
    rows = files.select("rule_set", F.explode_outer("rules").alias("r")).select("rule_set", "r.*")
    problem = (
        F.when(F.col("rule_id").isNull(), F.lit("rule id is missing or the file does not parse"))
        .when(F.col("operation").isNull(), F.lit("operation is missing"))
        .when(~F.coalesce(F.col("match").isin("namespace", "prefix", "any"), F.lit(False)), F.lit("match not known"))
        .when((F.col("match") == "prefix") & F.col("prefix").isNull(), F.lit("prefix is missing"))
    )
    rows = rows.withColumn("error", problem)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select(
        "rule_set", "rule_id", "error"
    )


def write_rules(rules: DataFrame, path: str) -> None:
    """One JSON file for each rule set, named after it; an existing file is replaced.

    Rules are configuration; the sets go through the driver one at a time.
    """
    spark = rules.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    columns = [c for c in rules.columns if c != "rule_set"]
    sets = rules.groupBy("rule_set").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("text"))
    for row in sets.toLocalIterator():
        file = hadoop.Path(path, f"{row['rule_set']}.json")
        out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
        try:
            out.write(bytearray(row["text"].encode()))
        finally:
            out.close()


def list_rule_sets(rules: DataFrame) -> DataFrame:
    return rules.select("rule_set").distinct()


_PREFIX, _NAMESPACE, _ANY = "prefix ", "namespace", "any"


@dataclass
class NamespaceRules:
    """Rules as a table that requests are joined with, however many there are."""

    table: DataFrame
    empty: bool
    allow_when_empty: bool = True

    @classmethod
    def load(cls, rules: DataFrame, allow_when_empty: bool = True) -> NamespaceRules:
        empty = rules.isEmpty()
        if empty and allow_when_empty:
            warnings.warn("no namespace rules: every access is allowed", stacklevel=2)
        return cls(rules, empty, allow_when_empty)

    def _routed(self) -> DataFrame:
        """The first rule set by name for each route, account, operation and prefix that a rule allows.

        A prefix is met in the last folder it names, any account as ``*``.
        """
        by_prefix = F.col("match") == "prefix"
        accounts = F.transform("service_accounts", lambda a: F.concat(F.lit("="), a))
        route = (
            F.when(by_prefix, F.concat(F.lit(_PREFIX), folder_of(F.col("prefix"))))
            .when(F.col("match") == "namespace", F.lit(_NAMESPACE))
            .otherwise(F.lit(_ANY))
        )
        return (
            self.table.select(
                route.alias("__route"), F.explode(F.coalesce(accounts, F.array(F.lit("*")))).alias("__who"),
                F.col("operation").alias("__operation"), F.when(by_prefix, F.col("prefix")).alias("__prefix"), "rule_set",
            )
            .groupBy("__route", "__who", "__operation", "__prefix")
            .agg(F.min("rule_set").alias("rule_set"))
        )

    def check(self, requests: DataFrame) -> DataFrame:
        """``(username, path, operation, ...)`` with ``allowed, reason`` added.

        Distinct requests meet the rules on their folders, namespace and
        account; the first allowing rule set by name gives the reason.
        """
        if self.empty:
            allowed = F.lit(self.allow_when_empty)
            return requests.withColumns({"allowed": allowed, "reason": F.lit(OPEN if self.allow_when_empty else DENIED)})
        user, path = F.col("__username"), F.col("__path")
        names = ("username", "path", "operation")
        keys = requests.select(*[F.col(c).alias(f"__{c}") for c in names]).distinct()
        own = principal_namespace(user) == path_namespace(path)
        routes = F.concat(
            F.array(F.lit(_ANY), F.lit(_PREFIX + UNROUTED)),
            F.when(own, F.array(F.lit(_NAMESPACE))).otherwise(F.array().cast("array<string>")),
            F.transform(folders_above(path), lambda f: F.concat(F.lit(_PREFIX), f)),
        )
        who = F.array(F.lit("*"), F.concat(F.lit("="), principal_account(user)))
        met = keys.withColumn("__route", F.explode(routes)).withColumn("__who", F.explode(who))
        met = met.join(self._routed(), ["__route", "__who", "__operation"])
        met = met.filter(F.startswith(path, F.coalesce("__prefix", F.lit(""))))
        found = met.groupBy(*[f"__{c}" for c in names]).agg(F.min("rule_set").alias("__set"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
        joined = requests.join(found, reduce(lambda a, b: a & b, same), "left")
        reason = F.coalesce(F.concat(F.lit(ALLOWED), F.col("__set")), F.lit(DENIED))
        return joined.select(*requests.columns, F.col("__set").isNotNull().alias("allowed"), reason.alias("reason"))
