"""Policy documents: reading, checking, normalising, versioning, rewriting.

A policy store is any DataFrame in the loaded layout (``schemas.POLICY``).
List order is part of the semantics and is kept in ``policy_ord`` and in the
order of the rule and condition arrays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warden import schemas
from warden.functions import conditions, patterns


# --- reading -----------------------------------------------------------------

def read_policies(
    spark: SparkSession, path: str, operators: Iterable[str] = schemas.CONDITION_OPERATORS
) -> tuple[DataFrame, DataFrame]:
    """``(policies, errors)`` from JSON files, each one policy or an array.

    Files follow each other by name; read again per batch to pick up changes.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("src"), "value")
    return parse_policies(files, "value", "src", operators)


def parse_policies(
    documents: DataFrame, text: str = "value", order: str | None = None, operators: Iterable[str] = schemas.CONDITION_OPERATORS
) -> tuple[DataFrame, DataFrame]:
    """``(policies, errors)`` from a column of JSON documents.

    A document that fails the checks is reported and dropped; the others load.
    ``order`` sorts the documents (ties and absence: one document expected).
    """
    parsed = _parse(documents, text, order, operators)
    good = parsed.filter((F.size("errors") == 0) & F.col("doc").isNotNull())
    bad = parsed.filter(F.size("errors") > 0)
    return normalise(good), bad.select("policy_ord", F.col("doc.id").alias("policy_id"), "errors")


def _parse(documents: DataFrame, text: str, order: str | None, operators: Iterable[str]) -> DataFrame:
    """One row per policy with its list position, typed document and problems."""
    value = F.col(text)
    listed = F.when(value.rlike(r"\A\s*\{"), F.concat(F.lit("["), value, F.lit("]"))).otherwise(value)
    docs = documents.select(
        (F.col(order) if order else F.lit(0)).alias("src"),
        F.from_json(listed, f"array<{schemas.POLICY_JSON}>").alias("docs"),
        F.from_json(listed, "array<map<string,string>>").alias("raws"),
    )
    zipped = F.arrays_zip("docs", "raws")
    rows = docs.select("src", F.posexplode_outer(zipped).alias("pos", "entry")).select(
        "src", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("entry.docs").alias("doc"), F.col("entry.raws").alias("raw")
    )
    rows = rows.withColumn("errors", document_errors(F.col("doc"), F.col("raw"), operators))
    if order is None:
        return rows.withColumn("policy_ord", F.col("pos").cast("int"))
    # Files are numbered by name: a window over one row per file, not per policy.
    starts = (
        rows.groupBy("src")
        .agg((F.max("pos") + 1).alias("n"))
        .withColumn("base", F.sum("n").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)))
        .select("src", F.coalesce("base", F.lit(0)).alias("base"))
    )
    return rows.join(starts, "src").withColumn("policy_ord", (F.col("base") + F.col("pos")).cast("int"))


def parse_policy_rows(
    documents: DataFrame, text: str, policy_ord: str, operators: Iterable[str] = schemas.CONDITION_OPERATORS
) -> tuple[DataFrame, DataFrame]:
    """``(policies, errors)`` from one JSON policy per row, with its position.

    The rows are dealt out first: parsing costs far more than reading, and a small file is read in one task.  It stands
    behind a one-element generator, below which no filter on its result is moved.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = documents.repartition(parts, policy_ord).select(
        F.col(policy_ord).cast("int").alias("policy_ord"),
        F.explode_outer(F.array(F.struct(
            F.from_json(text, schemas.POLICY_JSON).alias("doc"), F.from_json(text, "map<string,string>").alias("raw")
        ))).alias("both"),
    ).select("policy_ord", "both.doc", "both.raw").withColumn("errors", document_errors(F.col("doc"), F.col("raw"), operators))
    good = parsed.filter(F.size("errors") == 0)
    bad = parsed.filter(F.size("errors") > 0)
    return normalise(good), bad.select("policy_ord", F.col("doc.id").alias("policy_id"), "errors")


# --- checks ------------------------------------------------------------------

def _unknown(keys: Column, known: tuple[str, ...], where: str) -> Column:
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
    return F.transform(extra, lambda k: F.concat(F.lit(f"unknown {where} field: "), k))


def document_errors(doc: Column, raw: Column, operators: Iterable[str] = schemas.CONDITION_OPERATORS) -> Column:
    """Problems of one policy document, an empty array when it is fine.

    ``operators`` are the condition operators that documents may name.
    """
    known = F.array(*[F.lit(o) for o in operators])
    effects = F.array(*[F.lit(e) for e in schemas.EFFECTS])
    rules_raw = F.from_json(F.element_at(raw, "rules"), "array<map<string,string>>")
    conditions_raw = F.flatten(
        F.transform(rules_raw, lambda r: F.from_json(F.element_at(r, "conditions"), "array<map<string,string>>"))
    )

    def rule_errors(rule: Column) -> Column:
        bad_operator = F.exists(
            F.coalesce(rule["conditions"], F.array().cast(rule_conditions_type)),
            lambda c: c["operator"].isNotNull() & ~F.array_contains(known, c["operator"]),
        )
        return F.array_compact(
            F.array(
                F.when(rule["id"].isNull(), F.lit("Rule ID cannot be null")),
                F.when(rule["name"].isNull(), F.lit("Rule name cannot be null")),
                F.when(rule["effect"].isNull(), F.lit("Rule effect cannot be null")),
                F.when(~F.array_contains(effects, rule["effect"]), F.lit("Rule effect not known")),
                F.when(bad_operator, F.lit("Condition operator not known")),
            )
        )

    rule_conditions_type = f"array<{schemas._CONDITION_JSON}>"
    number = F.element_at(raw, "priority")
    own = F.array_compact(
        F.array(
            F.when(doc.isNull(), F.lit("malformed JSON")),
            F.when(doc["id"].isNull(), F.lit("Policy ID cannot be null")),
            F.when(doc["name"].isNull(), F.lit("Policy name cannot be null")),
            F.when(doc["rules"].isNull(), F.lit("Policy rules cannot be null")),
            F.when(~F.array_contains(effects, doc["defaultEffect"]), F.lit("Default effect not known")),
            F.when(number.isNotNull() & number.try_cast("int").isNull(), F.lit("Priority is not a number")),
        )
    )
    none = F.array().cast("array<string>")
    return F.concat(  # fixed values: the messages above
        own,
        F.coalesce(F.flatten(F.transform(doc["rules"], rule_errors)), none),
        F.coalesce(_unknown(F.map_keys(raw), schemas.POLICY_FIELDS, "policy"), none),
        F.coalesce(
            F.flatten(F.transform(rules_raw, lambda r: _unknown(F.map_keys(r), schemas.RULE_FIELDS, "rule"))), none
        ),
        F.coalesce(
            F.flatten(
                F.transform(conditions_raw, lambda c: _unknown(F.map_keys(c), schemas.CONDITION_FIELDS, "condition"))
            ),
            none,
        ),
    )


# --- normalising -------------------------------------------------------------

def _facet(listed: Column) -> Column:
    """Classified patterns of one target list; NULL and empty both match all."""
    return F.when(F.size(listed) > 0, F.transform(listed, patterns.classify))


def normalise(parsed: DataFrame) -> DataFrame:
    """Documents (``policy_ord, doc``) -> loaded layout with defaults filled in.

    Missing ``enabled`` means false and missing ``priority`` means 0.
    """
    doc = F.col("doc")

    def condition(c: Column) -> Column:
        blank = c["expression"].isNull() | (F.trim(c["expression"]) == "")
        return F.struct(
            c["attributeName"].alias("attribute"),
            c["operator"].alias("operator"),
            conditions.from_variant(c["expectedValue"]).alias("expected"),
            F.when(~blank, c["expression"]).alias("expression"),
        )

    def rule(r: Column, position: Column) -> Column:
        return F.struct(
            position.cast("int").alias("rule_ord"),
            r["id"].alias("rule_id"),
            r["name"].alias("name"),
            r["effect"].alias("effect"),
            F.coalesce(r["enabled"], F.lit(False)).alias("enabled"),
            _facet(r["target"]["resources"]).alias("resources"),
            _facet(r["target"]["actions"]).alias("actions"),
            _facet(r["target"]["subjects"]).alias("subjects"),
            F.transform(r["conditions"], condition).alias("conditions"),
        )

    return parsed.select(
        "policy_ord",
        doc["id"].alias("policy_id"),
        doc["name"].alias("name"),
        F.coalesce(doc["version"], F.lit(schemas.DEFAULT_VERSION)).alias("version"),
        F.coalesce(doc["enabled"], F.lit(False)).alias("enabled"),
        F.coalesce(doc["priority"], F.lit(0)).alias("priority"),
        F.coalesce(doc["defaultEffect"], F.lit(schemas.DENY)).alias("default_effect"),
        _facet(doc["target"]["resources"]).alias("resources"),
        _facet(doc["target"]["actions"]).alias("actions"),
        _facet(doc["target"]["subjects"]).alias("subjects"),
        F.transform(doc["rules"], rule).alias("rules"),
        F.coalesce(doc["createdAt"], F.current_timestamp()).alias("created_at"),
        F.coalesce(doc["updatedAt"], F.current_timestamp()).alias("updated_at"),
    )


# --- the store ---------------------------------------------------------------

def policy_by_id(policies: DataFrame, policy_id: str) -> DataFrame:
    return policies.filter(F.col("policy_id") == policy_id)


def rank_key(priority: Column, policy_ord: Column) -> Column:
    """Sort key of evaluation order: priority descending, then list order."""
    return -priority.cast("bigint") * F.lit(2**31) + policy_ord.cast("bigint")


def with_rank(policies: DataFrame, block: int = 65536) -> DataFrame:
    """Add the 1-based evaluation rank.

    Two levels keep it distributed: positions within (priority, block of list
    positions) plus the sizes of the groups before, one row per group.
    """
    table = policies.withColumn("__block", F.floor(F.col("policy_ord") / block))
    order = [F.col("priority").desc(), F.col("__block")]
    offsets = (
        table.groupBy("priority", "__block")
        .count()
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("count").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy("priority", "__block").orderBy("policy_ord"))
    return (
        table.withColumn("__inside", inside)
        .join(offsets, ["priority", "__block"])
        .withColumn("rank", F.col("__before") + F.col("__inside"))
        .drop("__block", "__inside", "__before")
    )


def _next_ord(policies: DataFrame) -> DataFrame:
    return policies.agg((F.coalesce(F.max("policy_ord"), F.lit(-1)) + 1).alias("__base"))


class PolicyStore:
    """Policies with the store operations; every change is a new snapshot.

    A store opened read-only (the default) refuses changes.
    """

    def __init__(self, policies: DataFrame, writable: bool = False):
        self.policies = policies
        self.writable = writable

    def all(self) -> DataFrame:
        return self.policies

    def get(self, policy_id: str) -> DataFrame:
        return policy_by_id(self.policies, policy_id)

    def _changed(self, policies: DataFrame) -> PolicyStore:
        return PolicyStore(policies, writable=True)

    def _check(self) -> None:
        if not self.writable:
            raise PermissionError("policy store is read-only")

    def upsert(self, changes: DataFrame) -> PolicyStore:
        """Replace policies in their place, by id and version; new ones go to the end.

        A store with versions keeps the others of a policy; a new version takes
        the place of its policy in the order.
        """
        self._check()
        own = self.policies.groupBy("policy_id").agg(F.min("policy_ord").alias("__place"))
        added = (
            changes.join(own, "policy_id", "left")
            .join(F.broadcast(_next_ord(self.policies)), F.lit(True))  # one row
            .withColumn("policy_ord", F.coalesce("__place", F.col("__base") + F.col("policy_ord")).cast("int"))
            .drop("__place", "__base")
        )
        identity = changes.select(F.col("policy_id").alias("__id"), F.col("version").alias("__version"))
        same = (F.col("policy_id") == F.col("__id")) & F.col("version").eqNullSafe(F.col("__version"))
        kept = self.policies.join(identity, same, "left_anti")
        return self._changed(kept.unionByName(added))

    def delete(self, policy_ids: DataFrame) -> PolicyStore:
        self._check()
        return self._changed(self.policies.join(policy_ids.select("policy_id"), "policy_id", "left_anti"))

    def set_enabled(self, policy_id: str, enabled: bool) -> PolicyStore:
        self._check()
        flag = F.when(F.col("policy_id") == policy_id, F.lit(enabled)).otherwise(F.col("enabled"))
        return self._changed(self.policies.withColumn("enabled", flag))


# --- import and export -------------------------------------------------------

def export_policies(policies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write loaded policies as JSON lines; positions travel with them."""
    policies.write.mode(mode).json(path)


def import_policies(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`export_policies` wrote."""
    return spark.read.schema(schemas.POLICY).json(path)


# --- versions ----------------------------------------------------------------

def with_validity(versions: DataFrame) -> DataFrame:
    """Versions of policies -> rows valid from ``updated_at`` until the next one."""
    history = Window.partitionBy("policy_id").orderBy("updated_at", "version")
    return versions.withColumn("valid_from", F.col("updated_at")).withColumn(
        "valid_to", F.lead("updated_at").over(history)
    )


def as_of(versions: DataFrame, when: Column) -> DataFrame:
    """The version of each policy valid at one time."""
    rows = versions if "valid_to" in versions.columns else with_validity(versions)
    return rows.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (when < F.col("valid_to"))))
