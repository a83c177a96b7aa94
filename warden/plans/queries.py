"""Registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warden.functions import attributes as at
from warden.functions import conditions as co
from warden.functions import patterns as pa
from warden.functions import paths as pt
from warden.functions import principals as pr
from warden.functions.expressions import usable, with_expressions
from warden.operators import grants as gr
from warden.operators import namespaces as ns
from warden.operators import policyset
from warden.operators import reports as re_
from warden.operators import sessions as se
from warden.operators.evaluate import Engine
from warden.plans import fixtures as fx
from warden.plans import oracles as orc
from warden.plans.conditions import CASES, EXPRESSIONS
from warden.session import shared_folder, tune
from warden.sources import audit, secured
from warden.sources import policies as ps
from warden.sources.store import Conflict, Refreshed, VersionedStore
from warden.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the oracle's times have no zone
    return tune(spark)


def register(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf: function(_prepared(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, listed=None) -> Engine:
    """Engine over fixture policies, prepared once per application."""
    listed = fx.POLICIES if listed is None else listed
    key = (spark.sparkContext.applicationId, json.dumps(listed))
    if key not in _ENGINES:
        _ENGINES[key] = Engine.over(fx.policies(spark, listed))
    return _ENGINES[key]


def decided(spark: SparkSession, sf: str, listed=None, plan: str = "auto") -> DataFrame:
    return engine(spark, listed).evaluate(fx.requests(spark, sf), plan)


def micros(column: str):
    return F.unix_micros(column).alias(column)


# --- decisions -------------------------------------------------------------------

SUMMARY = "SELECT effect, reason, count(*) AS requests FROM decided GROUP BY effect, reason"
ROWS = "SELECT request_id, effect, reason, effect = 'PERMIT' AS permitted FROM decided"


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("effect", "reason").agg(F.count("*").alias("requests"))


@register("decisions_one_policy", f"WITH {orc.decided(first_only=True)} {SUMMARY}")
def decisions_one_policy(spark, sf):
    return _summary(decided(spark, sf, [fx.POLICY_1]))


@register("decisions", f"WITH {orc.decided()} {ROWS}")
def decisions(spark, sf):
    return decided(spark, sf, plan="compiled").select("request_id", "effect", "reason", "permitted")


@register("decisions_joined", f"WITH {orc.decided()} {ROWS}")
def decisions_joined(spark, sf):
    return decided(spark, sf, plan="joined").select("request_id", "effect", "reason", "permitted")


@register("decision_summary", f"WITH {orc.decided()} {SUMMARY}")
def decision_summary(spark, sf):
    return _summary(decided(spark, sf))


@register("decisions_policy_per_supplier", f"WITH {orc.FOLDER_DECISIONS} SELECT * FROM folder_decided")
def decisions_policy_per_supplier(spark, sf):
    policies, _ = fx.supplier_policies(spark, sf)
    found = Engine.over(policies).evaluate(fx.folder_requests(spark, sf), "joined")
    return found.select("request_id", "effect", "reason")


@register(
    "decisions_policy_per_subject",
    f"""WITH {orc.ATTRS}, owners AS (SELECT c_custkey, c_acctbal, CASE c_custkey % 5 WHEN 0 THEN 'hr_u' WHEN 1 THEN 'finance_u'
        WHEN 2 THEN 'manager_u' WHEN 3 THEN 'analyst_u' ELSE 'svc_u' END || c_custkey || '@company.com' AS owner FROM customer)
      SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN owner IS NULL THEN 'NOT_APPLICABLE' WHEN c_acctbal > 0 THEN 'PERMIT' ELSE 'DENY' END AS effect,
        CASE WHEN bad THEN 'error' WHEN owner IS NULL THEN 'No applicable policies' ELSE
          CASE WHEN c_acctbal > 0 THEN 'Access granted by policy: Customer ' ELSE 'Access denied by policy: Customer ' END || c_custkey END AS reason
      FROM attrs LEFT JOIN owners ON subject = owner AND action IN ('read', 'query')""",
)
def decisions_policy_per_subject(spark, sf):
    """A policy for each customer, told apart by subject alone: no folder to route by."""
    found = Engine.over(fx.subject_policies(spark, sf)).evaluate(fx.requests(spark, sf))
    error = F.startswith("reason", F.lit("Evaluation error"))
    return found.select("request_id", "effect", F.when(error, F.lit("error")).otherwise(F.col("reason")).alias("reason"))


@register(
    "decisions_wildcard_policies",
    f"""WITH r AS ({fx.INNER_REQUESTS}) SELECT request_id,
        CASE WHEN c_custkey IS NULL THEN 'NOT_APPLICABLE' WHEN c_acctbal > 0 THEN 'PERMIT' ELSE 'DENY' END AS effect,
        CASE WHEN c_custkey IS NULL THEN 'No applicable policies' WHEN c_acctbal > 0 THEN 'Access granted by policy: Inner ' || c_custkey
          ELSE 'Access denied by policy: Inner ' || c_custkey END AS reason
      FROM r LEFT JOIN customer ON CAST(regexp_extract(subject, '_u([0-9]+)@', 1) AS BIGINT) = c_custkey""",
)
def decisions_wildcard_policies(spark, sf):
    """A policy for each customer, told apart by text inside a path or a name: met by its rarest gram."""
    found = Engine.over(fx.inner_policies(spark, sf)).evaluate(fx.inner_requests(spark, sf), "joined")
    return found.select("request_id", "effect", "reason")


_BROKEN = {
    "id": "broken", "name": "broken", "enabled": True, "priority": 50, "target": {"actions": ["read"]},
    "rules": [fx._rule("r", "r", "DENY", [], {"resources": ["s3://public-datasets/*", "s3://data-lake/[*"]})],
}


@register(
    "decisions_evaluation_error",
    f"""WITH {orc.ATTRS} SELECT CASE WHEN bad THEN 'subject'
        WHEN starts_with(resource, 's3://public-datasets/') THEN CASE WHEN action IN ('read', 'query') THEN 'permit' ELSE 'none' END
        WHEN action = 'read' THEN 'pattern' ELSE 'none' END AS outcome, count(*) AS requests FROM attrs GROUP BY outcome""",
)
def decisions_evaluation_error(spark, sf):
    """A rule pattern that does not compile denies the requests that reach it."""
    found = engine(spark, [_BROKEN, fx.POLICY_4]).evaluate(fx.requests(spark, sf))
    reason = F.col("reason")
    outcome = (
        F.when(reason.contains("out of bounds"), "subject")
        .when(reason.startswith("Evaluation error"), "pattern")
        .when(F.col("permitted"), "permit")
        .otherwise("none")
    )
    return found.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("requests"))


@register(
    "policy_targets",
    f"""WITH {orc.decided()}, hits AS (
      SELECT request_id, unnest([CASE WHEN a1 THEN 'staff-folders' END, CASE WHEN a2 THEN 'ledger-staff' END,
        CASE WHEN a3 THEN 'internal-by-day' END, CASE WHEN a4 THEN 'policy-004' END, CASE WHEN a6 THEN 'policy-006' END]) AS policy_id
      FROM judged WHERE NOT bad)
    SELECT policy_id, count(*) AS requests FROM hits WHERE policy_id IS NOT NULL GROUP BY policy_id""",
)
def policy_targets(spark, sf):
    pairs = engine(spark).applicable(fx.requests(spark, sf))
    return pairs.groupBy("policy_id").agg(F.count("*").alias("requests"))


def _trace(spark, sf):
    return engine(spark).trace(fx.requests(spark, sf))


@register(
    "trace_policies",
    f"""WITH {orc.decided()}, steps AS (
      SELECT request_id, unnest([
        CASE WHEN a1 THEN {{'policy_id': 'staff-folders', 'effect': CASE WHEN p1 THEN 'PERMIT' ELSE 'DENY' END, 'seen': TRUE}} END,
        CASE WHEN a2 THEN {{'policy_id': 'ledger-staff', 'effect': CASE WHEN p2 THEN 'PERMIT' ELSE 'DENY' END, 'seen': NOT (a1 AND p1)}} END,
        CASE WHEN a3 THEN {{'policy_id': 'internal-by-day', 'effect': CASE WHEN p3 THEN 'PERMIT' WHEN d3 THEN 'DENY' ELSE 'NOT_APPLICABLE' END, 'seen': TRUE}} END,
        CASE WHEN a4 THEN {{'policy_id': 'policy-004', 'effect': 'PERMIT', 'seen': TRUE}} END,
        CASE WHEN a6 THEN {{'policy_id': 'policy-006', 'effect': CASE WHEN p6 THEN 'PERMIT' ELSE 'DENY' END, 'seen': TRUE}} END]) AS s
      FROM judged WHERE NOT bad)
    SELECT s.policy_id AS policy_id, s.effect AS effect, count(*) AS requests FROM steps
    WHERE s IS NOT NULL AND s.seen GROUP BY ALL""",
)
def trace_policies(spark, sf):
    steps = _trace(spark, sf).select(F.explode("trace").alias("s"))
    return steps.groupBy(F.col("s.policy_id").alias("policy_id"), F.col("s.effect").alias("effect")).agg(
        F.count("*").alias("requests")
    )


@register(
    "trace_conditions",
    f"""WITH {orc.decided()}, first_rule AS (
      SELECT starts_with(resource, '{orc._HR}') AS target, starts_with(username, 'hr_') AS c1, hr > 6 AS c2, hr < 20 AS c3
      FROM judged WHERE NOT bad AND a1)
    SELECT reason, conditions, count(*) AS requests FROM (
      SELECT CASE WHEN NOT target THEN 'Rule target not matched' WHEN c1 AND c2 AND c3 THEN 'All conditions satisfied'
                  ELSE 'Conditions not satisfied' END AS reason,
        CASE WHEN NOT target THEN 0 WHEN NOT c1 THEN 1 WHEN NOT c2 THEN 2 ELSE 3 END AS conditions FROM first_rule) GROUP BY ALL""",
)
def trace_conditions(spark, sf):
    """First rule of the first policy: what was visited before the first failure."""
    steps = _trace(spark, sf).select(F.explode("trace").alias("s")).filter("s.policy_id = 'staff-folders'")
    rules = steps.select(F.col("s.rules")[0].alias("r"))
    return rules.groupBy(F.col("r.reason").alias("reason"), F.size("r.conditions").alias("conditions")).agg(
        F.count("*").alias("requests")
    )


@register("trace_nested")
def trace_nested(spark, sf):
    return _trace(spark, sf).select("request_id", "trace")


# --- policy documents ---------------------------------------------------------------

@register(
    "policy_source",
    f"""WITH {orc.SUPPLIER_POLICIES} SELECT CAST(ord AS INTEGER) AS policy_ord, policy_id, name, version, enabled,
      CAST(priority AS INTEGER) AS priority, default_effect, 1 AS rules,
      's3://lake/n' || CAST(nation AS VARCHAR) || '/' AS prefix, CAST(needed AS VARCHAR) AS expected FROM policies""",
)
def policy_source(spark, sf):
    policies, _ = fx.supplier_policies(spark, sf)
    return policies.select(
        "policy_ord", "policy_id", "name", "version", "enabled", "priority", "default_effect",
        F.size("rules").alias("rules"), F.col("resources")[0]["text"].alias("prefix"),
        F.col("rules")[0]["conditions"][0]["expected"]["text"].alias("expected"),
    )


@register(
    "policy_checks",
    """SELECT CAST(s_suppkey AS INTEGER) AS policy_ord, concat_ws('; ',
        CASE WHEN s_suppkey % 17 = 0 THEN 'Policy ID cannot be null' END,
        CASE WHEN s_suppkey % 23 = 0 THEN 'unknown policy field: owner' END) AS errors
      FROM supplier WHERE s_suppkey % 17 = 0 OR s_suppkey % 23 = 0""",
)
def policy_checks(spark, sf):
    _, errors = fx.supplier_policies(spark, sf)
    return errors.select("policy_ord", F.concat_ws("; ", "errors").alias("errors"))


@register(
    "policy_by_id", f"WITH {orc.SUPPLIER_POLICIES} SELECT policy_id, name, enabled FROM policies WHERE policy_id = 'sp-7'"
)
def policy_by_id(spark, sf):
    policies, _ = fx.supplier_policies(spark, sf)
    return ps.PolicyStore(policies).get("sp-7").select("policy_id", "name", "enabled")


@register(
    "policy_upsert_delete",
    f"""WITH {orc.SUPPLIER_POLICIES} SELECT policy_id, CASE WHEN ord % 10 = 1 THEN 'changed' ELSE name END AS name,
      CASE WHEN policy_id = 'sp-2' THEN FALSE ELSE enabled END AS enabled, CAST(ord AS INTEGER) AS policy_ord
      FROM policies WHERE ord % 10 <> 3""",
)
def policy_upsert_delete(spark, sf):
    policies, _ = fx.supplier_policies(spark, sf)
    store = ps.PolicyStore(policies, writable=True)
    changes = policies.filter("policy_ord % 10 = 1").withColumn("name", F.lit("changed"))
    gone = policies.filter("policy_ord % 10 = 3").select("policy_id")
    store = store.upsert(changes).delete(gone).set_enabled("sp-2", False)
    return store.all().select("policy_id", "name", "enabled", "policy_ord")


@register(
    "policy_rank",
    f"""WITH {orc.SUPPLIER_POLICIES} SELECT policy_id,
      row_number() OVER (ORDER BY priority DESC, ord) AS rank FROM policies WHERE enabled""",
)
def policy_rank(spark, sf):
    policies, _ = fx.supplier_policies(spark, sf)
    return ps.with_rank(policies.filter("enabled"), block=64).select("policy_id", F.col("rank").cast("bigint").alias("rank"))


_ORDER_VERSIONS = "SELECT o_custkey AS policy_id, o_orderdate AS updated_at, o_orderkey AS version FROM orders"


@register(
    "policy_versions",
    f"""WITH v AS ({_ORDER_VERSIONS}) SELECT policy_id, version, epoch_us(updated_at) AS valid_from,
      epoch_us(lead(updated_at) OVER (PARTITION BY policy_id ORDER BY updated_at, version)) AS valid_to FROM v""",
)
def policy_versions(spark, sf):
    versions = fx.select(spark, sf, _ORDER_VERSIONS, "orders").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return ps.with_validity(versions).select("policy_id", "version", micros("valid_from"), micros("valid_to"))


def _versioned(spark) -> DataFrame:
    versions = fx.policies(spark, fx.POLICY_3_VERSIONS)
    # All versions keep the list position of the policy.
    return ps.with_validity(versions.withColumn("policy_ord", F.lit(0)))


_AS_OF = orc.decided(
    hours="CASE WHEN request_ts < TIMESTAMP '2024-01-11' THEN hr BETWEEN 8 AND 18 ELSE hr BETWEEN 0 AND 23 END",
    third="request_ts < TIMESTAMP '2024-01-21'",
)


@register(
    "decisions_as_of",
    f"""WITH {_AS_OF} SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN a3 AND p3 THEN 'PERMIT' WHEN a3 AND d3 THEN 'DENY'
      ELSE 'NOT_APPLICABLE' END AS effect FROM judged""",
)
def decisions_as_of(spark, sf):
    """Each request under the policy version valid at its time."""
    return Engine.over(_versioned(spark)).evaluate(fx.requests(spark, sf), "joined").select("request_id", "effect")


@register("decisions_as_of_compiled", ORACLES["decisions_as_of"])
def decisions_as_of_compiled(spark, sf):
    return Engine.over(_versioned(spark)).evaluate(fx.requests(spark, sf), "compiled").select("request_id", "effect")


_NO_TIME = f"""WITH {_AS_OF} SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN request_id % 9 = 0 THEN 'NOT_APPLICABLE'
      WHEN a3 AND p3 THEN 'PERMIT' WHEN a3 AND d3 THEN 'DENY' ELSE 'NOT_APPLICABLE' END AS effect FROM judged"""


def _without_times(spark, sf) -> DataFrame:
    requests = fx.requests(spark, sf)
    return requests.withColumn("request_ts", F.when(F.col("request_id") % 9 != 0, F.col("request_ts")))


@register("decisions_as_of_no_time", _NO_TIME)
def decisions_as_of_no_time(spark, sf):
    """No version is in force for a request without a time."""
    return Engine.over(_versioned(spark)).evaluate(_without_times(spark, sf), "joined").select("request_id", "effect")


@register("decisions_as_of_no_time_compiled", _NO_TIME)
def decisions_as_of_no_time_compiled(spark, sf):
    return Engine.over(_versioned(spark)).evaluate(_without_times(spark, sf), "compiled").select("request_id", "effect")


@register(
    "what_if",
    f"""WITH {orc.decided()}, one AS (SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN a1 AND p1 THEN 'PERMIT'
        WHEN a1 THEN 'DENY' ELSE 'NOT_APPLICABLE' END AS old_effect FROM judged)
      SELECT old_effect, effect AS new_effect, count(*) AS requests FROM one JOIN decided USING (request_id) GROUP BY ALL""",
)
def what_if(spark, sf):
    return re_.what_if(fx.requests(spark, sf), engine(spark, [fx.POLICY_1]), engine(spark))


@register("decision_changes", ORACLES["what_if"])
def decision_changes(spark, sf):
    """The same from two decision tables."""
    return re_.compare_decisions(decided(spark, sf, [fx.POLICY_1]), decided(spark, sf))


@register("what_if_changed", ORACLES["what_if"])
def what_if_changed(spark, sf):
    """The same from the decisions under the first set: only what the added policies reach is evaluated."""
    before, after = fx.policies(spark, [fx.POLICY_1]), fx.policies(spark)
    return re_.what_if_changed(decided(spark, sf, [fx.POLICY_1]), before, after)


def _two_nations_disabled(spark, sf):
    """Requests decided under the suppliers' policies, these policies, and the same without those of two nations."""
    policies, _ = fx.supplier_policies(spark, sf)
    theirs = F.exists("resources", lambda p: p["text"].rlike("^s3://lake/n(3|7)/"))
    found = Engine.over(policies).evaluate(fx.folder_requests(spark, sf), "joined")
    return found, policies, policies.withColumn("enabled", F.col("enabled") & ~theirs)


_WITHOUT_TWO = orc.FOLDER_DECISIONS.replace("s_suppkey % 4 <> 0 AS", "s_suppkey % 4 <> 0 AND s_nationkey NOT IN (3, 7) AS")
_BOTH_SETS = f"""WITH old AS (WITH {orc.FOLDER_DECISIONS} SELECT request_id, effect AS old_effect FROM folder_decided),
  new AS (WITH {_WITHOUT_TWO} SELECT request_id, effect AS new_effect FROM folder_decided)"""


@register("what_if_changed_suppliers", f"{_BOTH_SETS} SELECT old_effect, new_effect, count(*) AS requests FROM old JOIN new USING (request_id) GROUP BY ALL")
def what_if_changed_suppliers(spark, sf):
    """What it would change if the policies of two nations were disabled."""
    return re_.what_if_changed(*_two_nations_disabled(spark, sf))


@register(
    "what_if_reached",
    f"""{_BOTH_SETS}, reached AS (WITH {orc.FOLDER_DECISIONS} SELECT DISTINCT r.request_id FROM folder_requests r JOIN policies p
        ON p.enabled AND p.nation IN (3, 7) AND r.action = 'read' AND starts_with(r.resource, 's3://lake/n' || CAST(p.nation AS VARCHAR) || '/'))
      SELECT request_id, old_effect, new_effect FROM reached JOIN old USING (request_id) JOIN new USING (request_id)""",
)
def what_if_reached(spark, sf):
    """The requests that are evaluated again for that, with both effects."""
    found = re_.reevaluated(*_two_nations_disabled(spark, sf))
    return found.select("request_id", "old_effect", F.col("effect").alias("new_effect"))


# --- attributes ---------------------------------------------------------------------

@register(
    "user_attributes",
    f"""WITH {orc.ATTRS} SELECT username, domain, dept AS department, role, clearance, bad, count(*) AS requests
      FROM attrs GROUP BY ALL""",
)
def user_attributes(spark, sf):
    df = at.resolve_attributes(fx.requests(spark, sf))
    return df.groupBy(
        F.col("user_username").alias("username"),
        F.when(F.col("user_domain").isNotNull(), F.col("user_domain")).alias("domain"),
        F.col("user_department").alias("department"), F.col("user_role").alias("role"),
        F.col("user_clearanceLevel").alias("clearance"), at.subject_error(F.col("subject")).isNotNull().alias("bad"),
    ).agg(F.count("*").alias("requests"))


@register(
    "time_attributes",
    f"""WITH {orc.ATTRS} SELECT request_id, epoch_us(request_ts) // 1000 AS "currentTime", CAST(hr AS INTEGER) AS "currentHour",
      dow AS "currentDay" FROM attrs""",
)
def time_attributes(spark, sf):
    return at.with_time_attributes(fx.requests(spark, sf)).select("request_id", "currentTime", "currentHour", "currentDay")


@register(
    "resource_attributes",
    f"""WITH {orc.ATTRS} SELECT resource AS path, CASE WHEN s3 THEN 's3' END AS type,
      CASE WHEN s3 THEN split_part(rest, '/', 1) END AS bucket,
      CASE WHEN s3 AND contains(rest, '/') THEN substr(rest, instr(rest, '/') + 1) END AS prefix, sens AS sensitivity,
      count(*) AS requests
      FROM (SELECT *, starts_with(resource, 's3://') AS s3, rtrim(replace(resource, 's3://', ''), '/') AS rest FROM attrs)
      GROUP BY ALL""",
)
def resource_attributes(spark, sf):
    df = at.with_resource_attributes(fx.requests(spark, sf))
    return df.groupBy(
        F.col("resource_path").alias("path"), F.col("resource_type").alias("type"),
        F.col("resource_bucket").alias("bucket"), F.col("resource_prefix").alias("prefix"),
        F.col("resource_sensitivityLevel").alias("sensitivity"),
    ).agg(F.count("*").alias("requests"))


@register(
    "environment_merge",
    f"""WITH {orc.ATTRS} SELECT CASE WHEN env_app = 'batch' THEN 'service' ELSE subject END AS subject_seen,
      coalesce(role, CASE WHEN env_app = 'batch' THEN 'Guest' END) AS role_seen,
      CAST(clearance AS VARCHAR) AS clearance_seen, env_app AS app_seen, count(*) AS requests FROM attrs GROUP BY ALL""",
)
def environment_merge(spark, sf):
    """The environment overrides request fields, fills gaps, and cannot override set attributes."""
    df = fx.requests(spark, sf)
    batch = F.col("environment")["spark.app.name"]["text"] == "batch"
    injected = F.create_map(
        F.lit("subject"), at.attr(F.lit("service"), "string"),
        F.lit("user.role"), at.attr(F.lit("Guest"), "string"),
        F.lit("user.clearanceLevel"), at.attr(F.lit(9), "int"),
    )
    df = df.withColumn("environment", F.when(batch, F.map_concat("environment", injected)).otherwise(F.col("environment")))
    df = at.resolve_attributes(df)
    seen = {
        "subject_seen": "subject", "role_seen": "user.role", "clearance_seen": "user.clearanceLevel",
        "app_seen": "spark.app.name",
    }
    return df.groupBy(
        *[at.operand(df, name, at.ATTRIBUTES).text.alias(out) for out, name in seen.items()]
    ).agg(F.count("*").alias("requests"))


@register(
    "data_format",
    f"""WITH {orc.REQUESTS} SELECT CASE WHEN contains(resource, 'parquet') THEN 'parquet' WHEN contains(resource, 'json')
      THEN 'json' WHEN contains(resource, 'csv') THEN 'csv' ELSE 'unknown' END AS format, count(*) AS requests
      FROM requests GROUP BY ALL""",
)
def data_format(spark, sf):
    return fx.requests(spark, sf).groupBy(pt.data_format(F.col("resource")).alias("format")).agg(
        F.count("*").alias("requests")
    )


# --- conditions -----------------------------------------------------------------------

def _case_counts(df: DataFrame, flags: list) -> DataFrame:
    """``(case_id, satisfied, requests)``: partial counts per case, one shuffle."""
    cases = F.explode(
        F.array(*[F.struct(F.lit(i).alias("case_id"), f.alias("satisfied")) for i, f in enumerate(flags)])
    )
    return df.select(cases.alias("c")).groupBy("c.case_id", "c.satisfied").agg(F.count("*").alias("requests"))


def _case_sql(conditions: list[str]) -> str:
    branches = " UNION ALL ".join(f"SELECT {i} AS case_id, ({c}) AS satisfied FROM attrs" for i, c in enumerate(conditions))
    return (
        f"WITH {orc.ATTRS}, cases AS ({branches}) SELECT case_id, coalesce(satisfied, FALSE) AS satisfied, "
        "count(*) AS requests FROM cases GROUP BY ALL"
    )


def _register_operator(operator: str, cases) -> None:
    @register(f"operator_{operator.lower()}", _case_sql([sql for _, _, sql in cases]))
    def query(spark, sf):
        documents = spark.createDataFrame(
            [(i, expected) for i, (_, expected, _) in enumerate(cases)], "case_id int, expected string"
        )
        expected = documents.select("case_id", co.from_variant(F.try_parse_json("expected")).alias("e"))
        values = [r["e"] for r in expected.orderBy("case_id").collect()]
        texts = [v["text"] for v in values if v is not None and v["text"] is not None]
        valid = pa.compilable(spark, texts) if operator == "MATCHES" else {}
        df = at.resolve_attributes(fx.requests(spark, sf))
        flags = []
        for (name, _, _), value in zip(cases, values, strict=True):
            if operator == "MATCHES" and value["text"] is not None and not valid[value["text"]]:
                flags.append(F.lit(False))
            else:
                flags.append(co.satisfied(operator, at.operand(df, name, at.ATTRIBUTES), co.expected_operand(value)))
        return _case_counts(df, flags)


for _operator, _cases in CASES.items():
    _register_operator(_operator, _cases)


@register("expressions", _case_sql([sql for _, sql in EXPRESSIONS]))
def expressions(spark, sf):
    """Expression conditions; refused, failing and non-boolean ones are false."""
    df = at.resolve_attributes(fx.requests(spark, sf))
    sample = at.resolve_attributes(policyset.sample_request(spark))
    tried = usable(spark, [t for t, _ in EXPRESSIONS], sample, at.ATTRIBUTES)
    good = {f"__x{i}": t for i, (t, _) in enumerate(EXPRESSIONS) if tried[t] is None}
    df = with_expressions(df, good, at.ATTRIBUTES)
    flags = [F.col(f"__x{i}") if f"__x{i}" in good else F.lit(False) for i in range(len(EXPRESSIONS))]
    return _case_counts(df, flags)


@register("business_hours", f"WITH {orc.ATTRS} SELECT hr BETWEEN 8 AND 18 AS inside, count(*) AS requests FROM attrs GROUP BY ALL")
def business_hours(spark, sf):
    df = at.resolve_attributes(fx.requests(spark, sf))
    df = with_expressions(df, {"inside": fx._HOURS}, at.ATTRIBUTES)
    return df.groupBy("inside").agg(F.count("*").alias("requests"))


_WILDCARDS = [
    ("*", "TRUE"),
    ("s3://data-lake/*", "starts_with(resource, 's3://data-lake/')"),
    ("*.parquet", "regexp_full_match(resource, '.*.parquet')"),
    ("s3://data-lake/departments/hr/employees.parquet", "resource = 's3://data-lake/departments/hr/employees.parquet'"),
    ("s3://*/finance/*", "regexp_full_match(resource, 's3://.*/finance/.*')"),
    ("(s3|abfs)://*", "regexp_full_match(resource, '(s3|abfs)://.*')"),
    ("s3://data.lake/*", "regexp_full_match(resource, 's3://data.lake/.*')"),
    ("hdfs://nn/tmp/scratch*", "starts_with(resource, 'hdfs://nn/tmp/scratch')"),
    ("s3://data-lake", "FALSE"),
]


@register("wildcard_match", _case_sql([sql for _, sql in _WILDCARDS]))
def wildcard_match(spark, sf):
    df = fx.requests(spark, sf)
    return _case_counts(df, [pa.wildcard_match(F.col("resource"), F.lit(p)) for p, _ in _WILDCARDS])


# --- paths and principals -----------------------------------------------------------------

# Normalised path without a look-behind, which this SQL engine does not have.
_NORMAL = "regexp_replace({p}, '(^|[^:])//+', '\\1/', 'g')"
_PATHS_CTE = f"""paths AS ({fx.PATHS}), flat AS (SELECT path_id, path, {_NORMAL.format(p='path')} AS collapsed FROM paths),
  normal AS (SELECT path_id, path, CASE WHEN length(collapsed) > 1 AND ends_with(collapsed, '/')
    THEN left(collapsed, length(collapsed) - 1) ELSE collapsed END AS normalized FROM flat),
  actual AS (SELECT *, CASE WHEN starts_with(normalized, 'sas://') THEN 's3://' || substr(normalized, 7) ELSE normalized END AS a FROM normal)"""


def _register_path(name: str, function, sql: str) -> None:
    @register(name, f"WITH {_PATHS_CTE} SELECT path, {sql} AS result, count(*) AS requests FROM actual GROUP BY ALL")
    def query(spark, sf):
        df = fx.paths(spark, sf)
        return df.groupBy("path", function(F.col("path")).alias("result")).agg(F.count("*").alias("requests"))


_register_path("path_to_storage", pt.to_storage_path,
               "CASE WHEN starts_with(path, 'sas://') THEN 's3://' || substr(path, 7) ELSE path END")
_register_path("path_to_sas", pt.to_sas_path,
               """CASE WHEN starts_with(path, 's3://') THEN 'sas://' || substr(path, 6)
                  WHEN starts_with(path, 'abfs://') THEN 'sas://' || substr(path, 8)
                  WHEN starts_with(path, 'https://') AND contains(path, '.blob.core.windows.net')
                  THEN 'sas://' || substr(path, 9) ELSE path END""")
_register_path("path_bucket", pt.bucket,
               """CASE WHEN starts_with(a, 's3://') THEN split_part(substr(a, 6), '/', 1)
                  WHEN starts_with(a, 'abfs://') THEN split_part(substr(a, 8), '@', 1) END""")
_register_path("path_key", pt.key,
               """CASE WHEN starts_with(a, 's3://') THEN CASE WHEN contains(substr(a, 6), '/')
                    THEN substr(substr(a, 6), instr(substr(a, 6), '/') + 1) ELSE '' END
                  WHEN starts_with(a, 'abfs://') THEN CASE WHEN contains(substr(a, 8), '/')
                    THEN substr(substr(a, 8), instr(substr(a, 8), '/') + 1) ELSE '' END
                  ELSE path END""")
_register_path("path_is_directory", pt.is_directory, "ends_with(path, '/')")
_register_path("path_normalize", pt.normalize, "normalized")
_register_path("path_namespace", pt.path_namespace,
               """CASE WHEN starts_with(path, 's3://') THEN CASE WHEN contains(substr(path, 6), '/')
                    THEN split_part(substr(path, 6), '/', 2) END
                  WHEN contains(path, 'abfs://') THEN CASE WHEN len(string_split(path, '/')) >= 4
                    THEN split_part(path, '/', 4) END ELSE '' END""")
_register_path("storage_provider", pt.provider,
               """CASE WHEN starts_with(path, 's3://') THEN 's3'
                  WHEN starts_with(path, 'abfs://') OR starts_with(path, 'https://') THEN 'azure' END""")


@register(
    "object_reference",
    f"""WITH paths AS ({fx.PATHS}), cut AS (SELECT path, regexp_extract(path, '^[a-z0-9]+://([^/]*)/?(.*)$', 1) AS authority,
        regexp_extract(path, '^[a-z0-9]+://([^/]*)/?(.*)$', 2) AS rest FROM paths)
      SELECT path, CASE WHEN path LIKE 'abfs://%@%' THEN split_part(split_part(authority, '@', 2), '.', 1)
          WHEN path LIKE 'https://%' THEN split_part(authority, '.', 1) END AS account,
        CASE WHEN path LIKE 's3://%' THEN authority WHEN path LIKE 'abfs://%@%' THEN split_part(authority, '@', 1)
          WHEN path LIKE 'https://%' THEN split_part(rest, '/', 1) END AS container,
        CASE WHEN path LIKE 's3://%' OR path LIKE 'abfs://%@%' THEN rest
          WHEN path LIKE 'https://%' THEN substr(rest, instr(rest, '/') + 1) END AS object,
        CASE WHEN path LIKE 's3://%' OR path LIKE 'https://%' OR path LIKE 'abfs://%@%' THEN NULL
          WHEN path LIKE 'abfs://%' THEN 'invalid ABFS host format' ELSE 'unsupported storage path: ' || path END AS error,
        count(*) AS requests FROM cut GROUP BY ALL""",
)
def object_reference(spark, sf):
    df = fx.paths(spark, sf).withColumn("r", pt.object_reference(F.col("path")))
    return df.groupBy("path", "r.account", "r.container", "r.object", "r.error").agg(F.count("*").alias("requests"))


@register(
    "grant_permissions",
    f"""WITH {orc.NS_DECIDED} SELECT CASE WHEN starts_with(path, 's3://') THEN 's3' ELSE 'azure' END AS provider, op AS operation,
      CASE op WHEN 'read' THEN 'read' WHEN 'delete' THEN 'delete' ELSE
        CASE WHEN starts_with(path, 's3://') THEN 'put' ELSE 'write,create' END END AS permissions, count(*) AS requests
      FROM ns_decided GROUP BY ALL""",
)
def grant_permissions(spark, sf):
    df = gr.check_requests(fx.ns_requests(spark, sf)).withColumn("provider", pt.provider(F.col("path")))
    permissions = F.array_join(pt.grant_permissions(F.col("provider"), F.col("operation")), ",")
    return df.groupBy("provider", "operation", permissions.alias("permissions")).agg(F.count("*").alias("requests"))


@register(
    "principals",
    f"WITH {orc.NS_DECIDED} SELECT username, ns AS namespace, account, count(*) AS requests FROM parts GROUP BY ALL",
)
def principals(spark, sf):
    df, user = fx.ns_requests(spark, sf), F.col("username")
    return df.groupBy(
        "username", pr.principal_namespace(user).alias("namespace"), pr.principal_account(user).alias("account")
    ).agg(F.count("*").alias("requests"))


# --- namespace rules and grants ---------------------------------------------------------------

def _rules(spark) -> ns.NamespaceRules:
    return ns.NamespaceRules.load(ns.standard_rules(spark))


@register(
    "namespace_decisions",
    f"""WITH {orc.NS_DECIDED} SELECT request_id, allowed,
      CASE WHEN allowed THEN 'Allowed by policy: standard' ELSE 'Access denied by all policies' END AS reason FROM ns_decided""",
)
def namespace_decisions(spark, sf):
    found = _rules(spark).check(gr.check_requests(fx.ns_requests(spark, sf)))
    return found.select("request_id", "allowed", "reason")


@register(
    "namespace_no_rules",
    f"WITH {orc.NS_DECIDED} SELECT TRUE AS allowed, 'No policies configured - allowing all access' AS reason, count(*) AS requests FROM ns_decided",
)
def namespace_no_rules(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rules = ns.NamespaceRules.load(ns.standard_rules(spark).limit(0))
    found = rules.check(fx.ns_requests(spark, sf))
    return found.groupBy("allowed", "reason").agg(F.count("*").alias("requests"))


@register(
    "namespace_rules_per_nation",
    f"""WITH folder_requests AS ({fx.FOLDER_REQUESTS}), rules AS (
        SELECT 's3://lake/n' || CAST(n_nationkey AS VARCHAR) || '/' AS prefix, 'set' || CAST(n_regionkey AS VARCHAR) AS rule_set
        FROM nation)
      SELECT request_id, rule_set IS NOT NULL AS allowed,
        coalesce('Allowed by policy: ' || rule_set, 'Access denied by all policies') AS reason
      FROM folder_requests LEFT JOIN rules ON action = 'read' AND starts_with(resource, prefix)""",
)
def namespace_rules_per_nation(spark, sf):
    """Rule sets, one per region with a rule per nation, read from their files."""
    rules, _ = ns.read_rules(spark, _rule_files(spark, sf))
    requests = fx.folder_requests(spark, sf).selectExpr("request_id", "subject AS username", "resource AS path", "action AS operation")
    return ns.NamespaceRules.load(rules).check(requests).select("request_id", "allowed", "reason")


def _rule_files(spark, sf) -> str:
    rules = fx.table(spark, sf, "nation").selectExpr(
        "concat('set', n_regionkey) AS rule_set", "n_name AS rule_id", "'read' AS operation", "'prefix' AS match",
        "concat('s3://lake/n', n_nationkey, '/') AS prefix", "CAST(NULL AS array<string>) AS service_accounts",
    )
    path = f"{shared_folder(spark)}/rules/{uuid.uuid4().hex}"
    ns.write_rules(rules, path)
    return path


@register(
    "rule_sets",
    """SELECT 'set' || CAST(n_regionkey AS VARCHAR) AS rule_set, count(*) AS rules, 0 AS errors FROM nation
       WHERE n_regionkey <> 0 GROUP BY ALL
       UNION ALL SELECT 'set0', count(*) FILTER (n_nationkey % 2 = 0), 0 FROM nation WHERE n_regionkey = 0
       UNION ALL SELECT 'bad', 0, count(*) FROM nation WHERE n_regionkey = 1""",
)
def rule_sets(spark, sf):
    """Rule sets listed from their files after one has changed and one with bad rules has come."""
    path = _rule_files(spark, sf)
    rules, _ = ns.read_rules(spark, path)
    nations = fx.table(spark, sf, "nation")
    fewer = rules.join(nations.filter("n_nationkey % 2 = 0"), F.col("rule_id") == F.col("n_name"), "left_semi").filter("rule_set = 'set0'")
    bad = rules.filter("rule_set = 'set1'").withColumns({"rule_set": F.lit("bad"), "match": F.lit("sometimes")})
    changed = fewer.unionByName(bad)
    ns.write_rules(spark.createDataFrame(changed.collect(), changed.schema), path)  # what is read is replaced
    rules, errors = ns.read_rules(spark, path)
    listed = rules.select("rule_set", F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(
        errors.select("rule_set", F.lit(0).alias("r"), F.lit(1).alias("e"))
    )
    return listed.groupBy("rule_set").agg(F.sum("r").alias("rules"), F.sum("e").alias("errors"))


_STATUS = """CASE WHEN NOT allowed THEN 'access denied: Access denied by all policies' END"""


@register(
    "grant_answers",
    f"""WITH {orc.NS_DECIDED} SELECT request_id, op AS operation, CAST(hours AS INTEGER) AS expiry_hours,
      CASE WHEN allowed THEN 200 ELSE 403 END AS status, {_STATUS} AS error FROM granted""",
)
def grant_answers(spark, sf):
    found = gr.answer_requests(fx.ns_requests(spark, sf), _rules(spark))
    return found.select("request_id", "operation", "expiry_hours", "status", "error")


@register(
    "grant_request_checks",
    """SELECT CASE WHEN user_id % 13 = 0 THEN 401 WHEN event_id % 7 = 0 THEN 400
             WHEN event_type = 'error' THEN 400 ELSE 200 END AS status,
        CASE WHEN user_id % 13 = 0 THEN 'Authentication required' WHEN event_id % 7 = 0 THEN 'Path is required'
             WHEN event_type = 'error' THEN 'Invalid operation. Must be one of: read, write, delete' END AS error,
        count(*) AS requests FROM events GROUP BY ALL""",
)
def grant_request_checks(spark, sf):
    events = fx.table(spark, sf, "events").selectExpr(
        "CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'alice' END AS username",
        "CASE WHEN event_id % 7 = 0 THEN '' ELSE 's3://b/k' END AS path",
        "CASE WHEN event_type = 'error' THEN 'list' ELSE '' END AS operation", "0 AS expiry_hours",
    )
    return gr.check_requests(events).groupBy("status", "error").agg(F.count("*").alias("requests"))


_GRANTS_SQL = f"""WITH {orc.NS_DECIDED}, refs AS (SELECT *,
    regexp_extract(path, '^[a-z0-9]+://([^/]*)/?(.*)$', 1) AS authority, regexp_extract(path, '^[a-z0-9]+://([^/]*)/?(.*)$', 2) AS rest
    FROM granted WHERE ok), grants AS (
  SELECT request_id, path, op AS operation, CASE WHEN starts_with(path, 's3://') THEN 's3' ELSE 'azure' END AS provider,
    CASE WHEN starts_with(path, 's3://') THEN authority WHEN starts_with(path, 'abfs://') THEN split_part(authority, '@', 1)
         ELSE split_part(rest, '/', 1) END AS container,
    CASE WHEN starts_with(path, 'https://') THEN substr(rest, instr(rest, '/') + 1) ELSE rest END AS object,
    CASE WHEN starts_with(path, 'abfs://') THEN split_part(split_part(authority, '@', 2), '.', 1)
         WHEN starts_with(path, 'https://') THEN split_part(authority, '.', 1) END AS account,
    request_ts AS issued_at, expires_at FROM refs)"""


@register(
    "grants",
    f"""{_GRANTS_SQL} SELECT request_id, provider, container, object, account,
      'https://' || account || '.blob.core.windows.net/' || container || '/' || object AS url,
      epoch_us(issued_at) AS issued_at, epoch_us(expires_at) AS expires_at FROM grants""",
)
def grants(spark, sf):
    found = gr.issue_grants(fx.ns_requests(spark, sf), _rules(spark))
    return found.select(
        "request_id", "provider", "container", "object", "account", "url", micros("issued_at"), micros("expires_at")
    )


_AT = "TIMESTAMP '2024-01-15 12:00:00'"


@register("grants_expired", f"{_GRANTS_SQL} SELECT provider, count(*) AS grants FROM grants WHERE expires_at < {_AT} GROUP BY ALL")
def grants_expired(spark, sf):
    issued = gr.issue_grants(fx.ns_requests(spark, sf), _rules(spark))
    return gr.expired(issued, F.expr(_AT)).groupBy("provider").agg(F.count("*").alias("grants"))


@register(
    "grants_active",
    f"{_GRANTS_SQL} SELECT request_id FROM grants WHERE expires_at >= {_AT} AND issued_at <= {_AT}",
)
def grants_active(spark, sf):
    issued = gr.issue_grants(fx.ns_requests(spark, sf), _rules(spark))
    return gr.active(issued, F.expr(_AT)).filter(F.col("issued_at") <= F.expr(_AT)).select("request_id")


@register(
    "grant_at_access",
    f"""{_GRANTS_SQL}, best AS (
      SELECT a.request_id, max(struct_pack(e := g.expires_at, i := g.request_id)) AS g
      FROM ns_decided a JOIN grants g ON g.path = a.path AND g.operation = a.op
        AND g.issued_at <= a.request_ts AND g.expires_at >= a.request_ts GROUP BY a.request_id)
    SELECT a.request_id, g IS NOT NULL AS granted, g.i AS grant_id, epoch_us(g.e) AS expires_at
    FROM ns_decided a LEFT JOIN best USING (request_id)""",
)
def grant_at_access(spark, sf):
    requests = fx.ns_requests(spark, sf)
    accesses = gr.check_requests(requests).select("request_id", "path", "operation", "request_ts")
    issued = gr.issue_grants(requests, _rules(spark))
    found = gr.covering_grant(accesses, issued)
    return found.select("request_id", "granted", "grant_id", micros("expires_at"))


@register(
    "move_plan",
    f"""WITH {orc.NS_DECIDED}, moves AS (SELECT request_id, ns, account, path AS src,
        CASE WHEN request_id % 3 = 0 THEN path ELSE 's3://bucket/teama/moved/' || CAST(request_id % 50 AS VARCHAR) END AS dst
        FROM parts), stock AS (SELECT DISTINCT path FROM ns WHERE starts_with(path, 's3://bucket/')),
      checked AS (SELECT m.*, src IN (SELECT path FROM stock) AS src_exists, account IN ('spark-driver', 'spark-executor')
          AND ns = split_part(substr(src, 6), '/', 2) AND ns = split_part(substr(dst, 6), '/', 2) AS ok FROM moves m),
      judged AS (SELECT *, src_exists AND ok AND src <> dst AS good FROM checked),
      s AS (SELECT *, good AND request_id = min(request_id) FILTER (good) OVER (PARTITION BY src) AS has FROM judged),
      d AS (SELECT *, has AND request_id = min(request_id) FILTER (has) OVER (PARTITION BY dst) AS made FROM s)
      SELECT CASE WHEN NOT src_exists THEN 'source does not exist' WHEN NOT ok THEN 'access denied' WHEN src = dst THEN 'target exists'
        WHEN NOT has THEN 'source taken by another move' WHEN NOT made THEN 'target taken by another move' ELSE 'move' END AS outcome,
        count(*) AS moves FROM d GROUP BY ALL""",
)
def move_plan(spark, sf):
    requests = fx.ns_requests(spark, sf)
    moves = requests.selectExpr(
        "request_id", "username", "path AS src",
        "CASE WHEN request_id % 3 = 0 THEN path ELSE concat('s3://bucket/teama/moved/', request_id % 50) END AS dst",
    )
    inventory = requests.filter(F.startswith("path", F.lit("s3://bucket/"))).select("path")
    planned = gr.plan_moves(moves, inventory, _movers(spark))
    return planned.groupBy("outcome").agg(F.count("*").alias("moves"))


def _movers(spark):
    own = spark.createDataFrame(
        [("movers", "own-delete", "delete", "namespace", None, ["spark-driver", "spark-executor"])], ns.RULES)
    return ns.NamespaceRules.load(ns.standard_rules(spark).unionByName(own))


# Customers' files move along: runs of four files step aside for each other, twos swap places, some go where others stay.
_FILE_MOVES = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 17 = 0 THEN 'alice' ELSE 'system:serviceaccount:teama:spark-driver' END AS username,
    's3://bucket/teama/f' || CAST(c_custkey - c_custkey % 13 % 2 AS VARCHAR(20)) AS src, 's3://bucket/teama/' ||
    CASE WHEN c_custkey % 10 < 4 THEN 'f' || CAST(c_custkey + 1 AS VARCHAR(20))
         WHEN c_custkey % 10 IN (5, 6) THEN 'f' || CAST(c_custkey - c_custkey % 10 + 11 - c_custkey % 10 AS VARCHAR(20))
         WHEN c_custkey % 10 = 7 THEN 'g' || CAST(c_nationkey AS VARCHAR(20))
         ELSE 'f' || CAST(c_custkey * 7 % 1999 AS VARCHAR(20)) END AS dst
  FROM customer"""


@register(
    "move_plan_steps",
    f"""WITH RECURSIVE moves AS ({_FILE_MOVES}),
      stock AS (SELECT 's3://bucket/teama/f' || c_custkey AS path FROM customer WHERE c_custkey % 10 <> 4),
      judged AS (SELECT *, src IN (SELECT path FROM stock) AS src_exists, dst IN (SELECT path FROM stock) AS dst_exists,
        username <> 'alice' AS ok FROM moves),
      good AS (SELECT * FROM judged WHERE src_exists AND ok AND src <> dst),
      live AS (SELECT * FROM good WHERE NOT dst_exists OR dst IN (SELECT src FROM good)),
      s AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY src ORDER BY request_id) = 1),
      d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY dst ORDER BY request_id) = 1),
      walk AS (SELECT request_id, src, 1 AS step, NOT dst_exists AS free FROM d WHERE dst NOT IN (SELECT src FROM d)
        UNION ALL SELECT d.request_id, d.src, step + 1, free FROM walk JOIN d ON d.dst = walk.src)
      SELECT j.request_id, CASE WHEN NOT src_exists THEN 'source does not exist' WHEN NOT ok THEN 'access denied'
          WHEN j.src = j.dst OR j.request_id NOT IN (SELECT request_id FROM live) THEN 'target exists'
          WHEN j.request_id NOT IN (SELECT request_id FROM s) THEN 'source taken by another move'
          WHEN j.request_id NOT IN (SELECT request_id FROM d) THEN 'target taken by another move'
          WHEN free THEN 'move' WHEN NOT free THEN 'target exists' ELSE 'cycle' END AS outcome,
        CASE WHEN free THEN step END AS step
      FROM judged j LEFT JOIN walk USING (request_id)""",
)
def move_plan_steps(spark, sf):
    """Moves that wait for each other: chains in steps, circles refused, every path given to one move."""
    moves = spark.sql(_FILE_MOVES.replace("FROM customer", "FROM {source}"), source=fx.table(spark, sf, "customer"))
    stock = fx.table(spark, sf, "customer").filter("c_custkey % 10 <> 4").selectExpr("concat('s3://bucket/teama/f', c_custkey) AS path")
    return gr.plan_moves(moves, stock, _movers(spark)).select("request_id", "outcome", "step")


# --- sessions ---------------------------------------------------------------------------------

@register(
    "sessions_current",
    f"WITH {orc.SESSIONS} SELECT session_id, user_id, epoch_us(event_ts) AS created_at FROM sessions",
)
def sessions_current(spark, sf):
    return se.current_sessions(fx.session_events(spark, sf)).select("session_id", "user_id", micros("created_at"))


@register(
    "session_users",
    f"""WITH {orc.SESSIONS}, {orc.REQUESTS} SELECT r.request_id, coalesce(s.user_id, 'unknown') AS user_id, r.session_id
      FROM requests r LEFT JOIN sessions s USING (session_id)""",
)
def session_users(spark, sf):
    sessions = se.current_sessions(fx.session_events(spark, sf))
    return se.identified(fx.requests(spark, sf), sessions).select("request_id", "user_id", "session_id")


_BADGES = """SELECT *, map('department', CASE WHEN seq % 2 = 0 THEN 'Finance' ELSE 'Legal' END) AS user_attributes
  FROM {source}"""


@register(
    "session_attribute_decisions",
    f"""WITH {orc.ATTRS}, session_events AS ({fx.SESSION_EVENTS}), held AS (
        SELECT session_id, CASE WHEN seq % 2 = 0 THEN 'Finance' ELSE 'Legal' END AS badge FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, seq DESC) AS rn FROM session_events)
        WHERE rn = 1 AND op = 'create')
      SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN coalesce(badge, dept) = 'Finance' THEN 'PERMIT' ELSE 'NOT_APPLICABLE' END AS effect
      FROM attrs LEFT JOIN held USING (session_id)""",
)
def session_attribute_decisions(spark, sf):
    """The department that a request's session carries decides, that of the subject without one."""
    events = spark.sql(_BADGES, source=fx.session_events(spark, sf))
    policy = {"id": "f", "name": "f", "enabled": True, "defaultEffect": "NOT_APPLICABLE", "rules": [
        fx._rule("r", "r", "PERMIT", [{"attributeName": "user.department", "operator": "EQUALS", "expectedValue": "Finance"}])]}
    resolver = at.session_resolver(se.current_sessions(events))
    return Engine.over(fx.policies(spark, [policy]), resolver).evaluate(fx.requests(spark, sf)).select("request_id", "effect")


@register(
    "directory_decisions",
    f"""WITH {orc.ATTRS}, users AS (SELECT 'hr_u' || c_custkey AS username, c_mktsegment AS segment FROM customer)
      SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN segment = 'BUILDING' THEN 'PERMIT' ELSE 'NOT_APPLICABLE' END AS effect
      FROM attrs LEFT JOIN users USING (username)""",
)
def directory_decisions(spark, sf):
    """Departments from a directory table, here one row for each customer, twice."""
    users = fx.table(spark, sf, "customer").selectExpr(
        "concat('hr_u', c_custkey) AS username", "c_mktsegment AS department", "CAST(NULL AS string) AS role", "1 AS clearance")
    more = users.withColumns({"department": F.lit("BUILDING"), "clearance": F.lit(5)})  # the lower clearance counts
    policy = {"id": "d", "name": "d", "enabled": True, "defaultEffect": "NOT_APPLICABLE", "rules": [
        fx._rule("r", "r", "PERMIT", [{"attributeName": "user.department", "operator": "EQUALS", "expectedValue": "BUILDING"}])]}
    resolver = at.directory_resolver(users.unionByName(more))
    return Engine.over(fx.policies(spark, [policy]), resolver).evaluate(fx.requests(spark, sf)).select("request_id", "effect")


@register(
    "custom_operator_decisions",
    f"""WITH {orc.ATTRS} SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN length(username) > 7 THEN 'PERMIT' ELSE 'NOT_APPLICABLE' END AS effect
      FROM attrs""",
)
def custom_operator_decisions(spark, sf):
    """A condition operator of one's own, named by a policy document."""
    longer = {**co.OPERATORS, "LONGER_THAN": lambda actual, expected: F.length(actual.text) > expected.num}
    policy = {"id": "l", "name": "l", "enabled": True, "defaultEffect": "NOT_APPLICABLE", "rules": [
        fx._rule("r", "r", "PERMIT", [{"attributeName": "user.username", "operator": "LONGER_THAN", "expectedValue": 7}])]}
    policies, _ = ps.parse_policies(fx.policy_documents(spark, [policy]), operators=longer)
    return Engine.over(policies, operators=longer).evaluate(fx.requests(spark, sf)).select("request_id", "effect")


# --- reports ------------------------------------------------------------------------------------

@register("permitted_requests", f"WITH {orc.decided()} SELECT request_id, subject, resource FROM decided WHERE effect = 'PERMIT'")
def permitted_requests(spark, sf):
    kept = re_.permitted_requests(fx.requests(spark, sf), decided(spark, sf))
    return kept.select("request_id", "subject", "resource")


@register("denied_requests", f"WITH {orc.decided()} SELECT request_id, subject, resource FROM decided WHERE effect <> 'PERMIT'")
def denied_requests(spark, sf):
    kept = re_.denied_requests(fx.requests(spark, sf), decided(spark, sf))
    return kept.select("request_id", "subject", "resource")


@register(
    "denials",
    f"""WITH {orc.decided()} SELECT request_id, CASE effect WHEN 'DENY' THEN 'EXPLICIT_DENY' ELSE 'NO_APPLICABLE_POLICY' END AS denial_type,
      CASE WHEN action = 'write' THEN 'Write access denied' ELSE 'Access denied' END || ' to resource ''' || resource
      || ''' for user ''' || subject || ''' in session ''' || session_id || '''. Reason: ' || reason AS message
      FROM decided WHERE effect <> 'PERMIT'""",
)
def denials(spark, sf):
    return re_.denials(decided(spark, sf)).select("request_id", "denial_type", "message")


@register(
    "security_alerts",
    f"""WITH {orc.decided()} SELECT request_id, 'SECURITY ALERT: User ' || subject || ' attempted to access resource ' || resource
      || ' but no policies were found. This could indicate a misconfiguration or unauthorized access attempt.' AS alert
      FROM decided WHERE effect = 'NOT_APPLICABLE'""",
)
def security_alerts(spark, sf):
    return re_.security_alerts(decided(spark, sf)).select("request_id", "alert")


@register(
    "denial_summary",
    f"""WITH {orc.decided()}, d AS (SELECT *, CASE effect WHEN 'DENY' THEN 'EXPLICIT_DENY' ELSE 'NO_APPLICABLE_POLICY' END AS denial_type
        FROM decided WHERE effect <> 'PERMIT')
      SELECT denial_type, resource, count(*) AS denials, count(DISTINCT subject) AS users
      FROM d GROUP BY ROLLUP (denial_type, resource)""",
)
def denial_summary(spark, sf):
    return re_.denial_summary(decided(spark, sf))


@register(
    "denial_types_detailed",
    f"""WITH {orc.decided()}, firsts AS (
      SELECT *, NOT bad AND a1 AND NOT p1 AS f1, NOT bad AND a2 AND NOT p2 AS f2 FROM decided WHERE effect <> 'PERMIT'),
      kinds AS (SELECT *, CASE WHEN bad THEN 'EXPLICIT_DENY' WHEN a1 THEN 'CONDITION_FAILED'
        WHEN a2 THEN CASE WHEN NOT coalesce(dept <> 'Finance', FALSE) THEN 'CONDITION_FAILED'
                          WHEN action <> 'write' THEN 'EXPLICIT_DENY'
                          WHEN NOT clearance > 2 THEN 'INSUFFICIENT_CLEARANCE' ELSE 'CONDITION_FAILED' END
        WHEN a3 THEN CASE WHEN NOT d3 OR (action IN ('read', 'query')) THEN 'CONDITION_FAILED' ELSE 'EXPLICIT_DENY' END
        WHEN a6 THEN 'CONDITION_FAILED' ELSE 'NO_APPLICABLE_POLICY' END AS denial_type FROM firsts)
      SELECT denial_type, count(*) AS denials FROM kinds GROUP BY ALL""",
)
def denial_types_detailed(spark, sf):
    """Denial type refined by the first failed condition of the trace."""
    run, requests = engine(spark), fx.requests(spark, sf)
    both = run.evaluate(run.trace(requests)).filter("NOT permitted")
    kind = re_.detailed_denial_type(F.col("trace"), F.col("effect"))
    return both.groupBy(kind.alias("denial_type")).agg(F.count("*").alias("denials"))


@register(
    "access_profile",
    f"""WITH {orc.decided()}, located AS (SELECT CASE WHEN resource LIKE 's3://%' THEN 's3' WHEN resource LIKE 'abfs://%' THEN 'azure'
          ELSE 'unsupported' END AS provider,
        CASE WHEN resource LIKE 's3://%' THEN split_part(substr(resource, 6), '/', 1)
             WHEN resource LIKE 'abfs://%' THEN split_part(substr(resource, 8), '@', 1) ELSE '' END AS bucket,
        CASE WHEN resource LIKE 's3://%' THEN split_part(substr(resource, 6), '/', 2)
             WHEN resource LIKE 'abfs://%' THEN split_part(resource, '/', 4) ELSE '' END AS namespace,
        sens AS sensitivity, effect FROM decided)
      SELECT provider, bucket, namespace, sensitivity, count(*) AS requests, count(*) FILTER (effect = 'PERMIT') AS permits,
        count(*) FILTER (effect <> 'PERMIT') AS denials FROM located GROUP BY ALL""",
)
def access_profile(spark, sf):
    return re_.access_profile(decided(spark, sf))


@register(
    "access_matrix",
    f"""WITH {orc.decided()} SELECT subject, resource, action, bool_or(effect = 'PERMIT') AS permitted FROM decided
      GROUP BY subject, resource, action""",
)
def access_matrix(spark, sf):
    return re_.access_matrix(decided(spark, sf))


_VISITED = """array_to_string(list_filter([
      CASE WHEN a1 THEN 'staff-folders' END, CASE WHEN a2 AND NOT (a1 AND p1) THEN 'ledger-staff' END, CASE WHEN a3 THEN 'internal-by-day' END,
      CASE WHEN a4 THEN 'policy-004' END, CASE WHEN a6 THEN 'policy-006' END], lambda x: x IS NOT NULL), '","')"""


@register(
    "audit_lines",
    f"""WITH {orc.decided()} SELECT CAST(request_ts AS DATE) AS date,
      '{{"timestamp":"' || strftime(request_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","event":"'
      || CASE WHEN effect = 'PERMIT' THEN 'ACCESS_GRANTED' ELSE 'ACCESS_DENIED' END || '","user":"' || subject
      || '","session":"' || session_id || '","resource":"' || resource || '","action":"' || action || '","reason":"' || reason
      || '","policy_evaluated":[' || CASE WHEN bad OR NOT (a1 OR a2 OR a3 OR a4 OR a6) THEN '' ELSE '"' || {_VISITED} || '"' END
      || '],"user_attributes":{{' || CASE WHEN dept IS NULL THEN '' ELSE '"department":"' || dept || '",' END
      || '"clearance_level":' || clearance || '}},"resource_attributes":{{"sensitivity_level":' || sens || '}}}}' AS line FROM decided""",
)
def audit_lines(spark, sf):
    """A line of JSON for each decision, with the policies that its trace visited."""
    run = engine(spark)
    return audit.audit_lines(run.evaluate(run.trace(fx.requests(spark, sf))))


@register(
    "audit_records",
    f"""WITH {orc.decided()} SELECT CASE WHEN effect = 'PERMIT' THEN 'ACCESS_GRANTED' ELSE 'ACCESS_DENIED' END AS event, action, reason,
      dept AS department, clearance AS clearance_level, sens AS sensitivity_level, count(*) AS records FROM decided GROUP BY ALL""",
)
def audit_records(spark, sf):
    records = audit.audit_records(decided(spark, sf))
    return records.groupBy(
        "event", "action", "reason", "user_attributes.department", "user_attributes.clearance_level",
        "resource_attributes.sensitivity_level",
    ).agg(F.count("*").alias("records"))


# --- secured access ---------------------------------------------------------------------------------

@register(
    "policy_upsert_versions",
    """WITH v AS (SELECT n_nationkey, version FROM nation, (VALUES ('1.0'), ('2.0'), ('3.0')) AS t(version)
        UNION ALL SELECT n_nationkey, '4.0' FROM nation WHERE n_nationkey % 3 = 0)
      SELECT 'n-' || n_nationkey AS policy_id, version, CAST(n_nationkey AS INTEGER) AS policy_ord,
        CASE WHEN version = '2.0' AND n_nationkey % 2 = 0 THEN 'changed' WHEN version = '4.0' THEN 'new' ELSE 'first' END AS name FROM v""",
)
def policy_upsert_versions(spark, sf):
    """A store with three versions of each policy: one version replaced, one added, the others kept."""
    base = fx.policies(spark, fx.POLICY_3_VERSIONS[:1]).drop("policy_id", "policy_ord", "version", "name")
    nations = fx.table(spark, sf, "nation").selectExpr("concat('n-', n_nationkey) AS policy_id", "CAST(n_nationkey AS INT) AS policy_ord")
    order = fx.policies(spark, []).columns

    def rows(keep: str, versions: list[str], name: str) -> DataFrame:
        some = nations.filter(keep).withColumn("version", F.explode(F.array(*map(F.lit, versions)))).withColumn("name", F.lit(name))
        return some.join(F.broadcast(base), F.lit(True)).select(*order)  # base is one row

    store = ps.PolicyStore(rows("true", ["1.0", "2.0", "3.0"], "first"), writable=True)
    changes = rows("policy_ord % 2 = 0", ["2.0"], "changed").unionByName(rows("policy_ord % 3 = 0", ["4.0"], "new"))
    return store.upsert(changes).all().select("policy_id", "version", "policy_ord", "name")


@register(
    "access_checks",
    f"""WITH {orc.decided()} SELECT request_id, effect, CASE WHEN effect <> 'PERMIT' THEN
        CASE WHEN action = 'write' THEN 'Write access denied' ELSE 'Access denied' END || ' to resource ''' || resource
        || ''' for user ''' || subject || ''' in session ''' || session_id || '''. Reason: ' || reason END AS message
      FROM decided""",
)
def access_checks(spark, sf):
    """Checks of a whole access log, with the error text each would raise."""
    accesses = fx.requests(spark, sf).select(
        "request_id", F.col("subject").alias("user_id"), "session_id", F.col("resource").alias("path"), "action",
        pt.data_format(F.col("resource")).alias("format"), F.col("request_ts").alias("access_ts"),
        F.col("environment")["spark.app.name"]["text"].alias("app_name"),
    )
    return secured.check_accesses(accesses, engine(spark)).select("request_id", "effect", "message")


@register(
    "secured_rows",
    f"""WITH {orc.REQUESTS} SELECT resource, count(*) AS row_count FROM requests
      WHERE resource IN ('s3://data-lake/departments/finance/budgets.parquet',
        's3://data-lake/departments/finance/confidential/audit.json', 's3://public-datasets/weather/2024.csv') GROUP BY ALL""",
)
def secured_rows(spark, sf):
    """Rows of the resources a finance user may read, decided once per resource."""
    rows = fx.requests(spark, sf).select("request_id", "resource")
    finance = secured.Principal("finance_bob@corp", "s1")
    run = engine(spark, [fx.POLICY_1, fx.POLICY_4])
    return secured.secured_rows(rows, "resource", run, finance).groupBy("resource").agg(F.count("*").alias("row_count"))


@register(
    "secured_columns",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def secured_columns(spark, sf):
    policy = {
        "id": "c", "name": "columns", "enabled": True, "defaultEffect": "DENY", "rules": [
            {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT",
             "target": {"resources": ["*#c_custkey", "*#c_name", "*#c_mktsegment"]}, "conditions": []}],
    }
    customers = fx.table(spark, sf, "customer")
    return secured.secured_columns(customers, "s3://crm/customer", engine(spark, [policy]), secured.Principal("hr_a"))


_READ_ALL = {
    "id": "all", "name": "files", "enabled": True, "defaultEffect": "DENY", "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "target": {"actions": ["read"]}, "conditions": []}],
}


@register(
    "authorized_query",
    """SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
      WHERE c_acctbal > (SELECT avg(s_acctbal) FROM supplier) GROUP BY n_name""",
)
def authorized_query(spark, sf):
    """Every file of the query, subquery included, is authorised before it runs."""
    frames = {n: fx.table(spark, sf, n) for n in ("customer", "nation", "supplier")}
    query = spark.sql(ORACLES["authorized_query"].replace("FROM customer", "FROM {customer}").replace(
        "JOIN nation", "JOIN {nation}").replace("FROM supplier", "FROM {supplier}"), **frames)
    return secured.authorize(query, engine(spark, [_READ_ALL]))


_OPEN_COLUMNS = {
    "id": "cols", "name": "columns", "enabled": True, "defaultEffect": "DENY", "target": {"subjects": ["analyst@corp"]}, "rules": [
        {"id": "f", "name": "files", "enabled": True, "effect": "PERMIT", "conditions": [],
         "target": {"actions": ["read"], "resources": ["*.parquet", "*/nation.parquet#*"]}},
        {"id": "c", "name": "columns", "enabled": True, "effect": "PERMIT", "conditions": [], "target": {"actions": ["read"],
         "resources": [f"*/customer.parquet#c_{c}" for c in ("custkey", "name", "nationkey", "mktsegment")]}}],
}
_COLUMN_PROBES = {
    "pruned": "SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM customer) GROUP BY c_mktsegment",
    "joined": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "filtered": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment",
    "join_key": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > n_regionkey GROUP BY n_name",
    "subquery": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey > (SELECT avg(c_acctbal) FROM customer) GROUP BY c_mktsegment",
    "ordered": "SELECT c_name, row_number() OVER (ORDER BY c_acctbal) AS n FROM customer",
    "unioned": "SELECT c_name, 1 AS n FROM customer UNION ALL SELECT CAST(c_acctbal AS VARCHAR(20)) AS c_name, 1 AS n FROM customer",
}


@register(
    "authorized_columns",
    " UNION ALL ".join(
        f"SELECT '{name}' AS query, CAST(count(*) AS BIGINT) AS found_rows, CAST(sum(n) AS BIGINT) AS total FROM ({sql})"
        if name in ("pruned", "joined") else f"SELECT '{name}' AS query, NULL AS found_rows, NULL AS total"
        for name, sql in _COLUMN_PROBES.items()
    ),
)
def authorized_columns(spark, sf):
    """Queries authorised by the columns that they use: result, filter, join, order, subquery; null where one is refused."""
    frames, run = {n: fx.table(spark, sf, n) for n in ("customer", "nation")}, engine(spark, [_OPEN_COLUMNS])
    results = []
    for name, sql in _COLUMN_PROBES.items():
        query = spark.sql(re.sub(r"(FROM|JOIN) (customer|nation)", r"\1 {\2}", sql), **frames)
        try:
            found = secured.authorize_columns(query, run, secured.Principal("analyst@corp", "s"))
        except PermissionError:
            found = spark.range(0).selectExpr("CAST(NULL AS BIGINT) AS n")
        counts = found.agg(F.nullif(F.count("*"), F.lit(0)).alias("found_rows"), F.sum("n").alias("total"))
        results.append(counts.select(F.lit(name).alias("query"), "found_rows", "total"))
    return reduce(DataFrame.unionByName, results)


_WRITER = {
    "id": "w", "name": "writers", "enabled": True, "defaultEffect": "DENY", "target": {"subjects": ["etl@corp"]},
    "rules": [fx._rule("r", "r", "PERMIT", [], {"actions": ["read", "write"]})],
}


@register("secured_read", "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment")
def secured_read(spark, sf):
    """A file source read behind the check."""
    customers = secured.read_secured(
        spark, engine(spark, [_WRITER]), f"{sf}/customer.parquet", principal=secured.Principal("etl@corp", "s")
    )
    return customers.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def _written_back(spark, sf, fmt: str) -> DataFrame:
    run, etl = engine(spark, [_WRITER]), secured.Principal("etl@corp", "s")
    path = f"{shared_folder(spark)}/secured/{uuid.uuid4().hex}"
    nations = fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    secured.write_secured(nations, run, path, fmt, principal=etl)
    return secured.read_secured(spark, run, path, fmt, etl, schema=nations.schema)


@register("secured_write_parquet", "SELECT c_custkey, c_name FROM customer")
def secured_write_parquet(spark, sf):
    return _written_back(spark, sf, "parquet")


@register("secured_write_json", "SELECT c_custkey, c_name FROM customer")
def secured_write_json(spark, sf):
    return _written_back(spark, sf, "json")


@register("secured_write_csv", "SELECT c_custkey, c_name FROM customer")
def secured_write_csv(spark, sf):
    return _written_back(spark, sf, "csv")


@register("granted_write_read", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus")
def granted_write_read(spark, sf):
    """``sas://`` paths behind the namespace rules, opened below the shared folder."""
    driver = "system:serviceaccount:teama:spark-driver"
    path = f"sas://bucket/teama/{uuid.uuid4().hex}"
    locate = lambda p: p.replace("s3://", f"{shared_folder(spark)}/granted/")
    orders = fx.table(spark, sf, "orders").select("o_orderstatus")
    secured.write_granted(orders, _rules(spark), driver, path, locate=locate)
    back = secured.read_granted(spark, _rules(spark), driver, path, locate=locate)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@register(
    "policy_export_import",
    f"WITH {orc.SUPPLIER_POLICIES} SELECT policy_id, name, version, CAST(ord AS INTEGER) AS policy_ord FROM policies",
)
def policy_export_import(spark, sf):
    policies, _ = fx.supplier_policies(spark, sf)
    path = f"{shared_folder(spark)}/policies/{uuid.uuid4().hex}"
    ps.export_policies(policies, path)
    return ps.import_policies(spark, path).select("policy_id", "name", "version", "policy_ord")


@register(
    "audit_written",
    f"""WITH {orc.decided()} SELECT CAST(request_ts AS DATE) AS date, CASE WHEN effect = 'PERMIT' THEN 'ACCESS_GRANTED'
      ELSE 'ACCESS_DENIED' END AS event, count(*) AS records FROM decided GROUP BY ALL""",
)
def audit_written(spark, sf):
    """Audit lines written in one folder per day and read back."""
    path = f"{shared_folder(spark)}/audit/{uuid.uuid4().hex}"
    audit.write_audit(decided(spark, sf), path)
    lines = spark.read.schema("event string, date date").json(path)
    return lines.groupBy("date", "event").agg(F.count("*").alias("records"))


# --- example analytics ----------------------------------------------------------------------------------

@register(
    "department_summary",
    """SELECT department, count(*) AS employee_count, round(avg(salary), 4) AS avg_salary FROM (
        SELECT 'HR' AS department, c_acctbal AS salary FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION ALL
        SELECT 'Finance', c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY department""",
)
def department_summary(spark, sf):
    """Two sources united under labels, each authorised on its own, then summarised."""
    run = engine(spark, [_READ_ALL])
    customers = fx.table(spark, sf, "customer")
    parts = [
        secured.authorize(customers.filter(F.col("c_mktsegment") == segment), run).select(
            F.lit(label).alias("department"), F.col("c_acctbal").alias("salary"))
        for label, segment in (("HR", "HOUSEHOLD"), ("Finance", "MACHINERY"))
    ]
    summary = re_.group_summary(parts[0].unionByName(parts[1]), "department", "salary", "employee_count", "avg_salary")
    return summary.withColumn("avg_salary", F.round("avg_salary", 4))


@register(
    "category_summary",
    "SELECT lang AS category, count(*) AS count, round(avg(n_chars), 4) AS avg_value FROM documents GROUP BY lang ORDER BY count DESC",
)
def category_summary(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr("lang AS category", "n_chars AS value")
    summary = re_.group_summary(rows, "category", "value", "count", "avg_value")
    return summary.withColumn("avg_value", F.round("avg_value", 4)).orderBy(F.desc("count"))


@register(
    "top_categories",
    "SELECT source AS category, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, category LIMIT 5",
)
def top_categories(spark, sf):
    rows = fx.table(spark, sf, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), "category").limit(5)


@register(
    "table_overview",
    """SELECT 'documents' AS table_name, count(*) AS row_count, 5 AS column_count FROM documents
      UNION ALL SELECT 'customer', count(*), 5 FROM customer""",
)
def table_overview(spark, sf):
    def one(name):
        df = fx.table(spark, sf, name)
        return df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )

    return one("documents").unionByName(one("customer"))


@register("first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def first_rows(spark, sf):
    return fx.table(spark, sf, "customer").orderBy("c_custkey").limit(10).select("c_custkey", "c_name")


# --- streams -----------------------------------------------------------------------------------------------

_STREAM_SQL = f"""WITH stream AS ({fx.STREAM_EVENTS}) SELECT epoch_us(time_bucket(INTERVAL 5 MINUTES, event_ts)) AS window_start,
  department, count(*) AS "transactionCount", round(sum(amount), 4) AS "totalAmount", round(avg(amount), 6) AS "avgAmount",
  max(amount) AS "maxAmount" FROM stream WHERE department IN ('Finance', 'General') GROUP BY ALL"""


def _rounded(summary: DataFrame) -> DataFrame:
    return summary.select(
        micros("window_start"), "department", "transactionCount", F.round("totalAmount", 4).alias("totalAmount"),
        F.round("avgAmount", 6).alias("avgAmount"), "maxAmount",
    )


@register("transaction_summary", _STREAM_SQL)
def transaction_summary(spark, sf):
    return _rounded(streams.transaction_summary(fx.stream_events(spark, sf), ["Finance", "General"]))


def _run_stream(spark: SparkSession, build, sink, output_mode: str = "update") -> str:
    """Run a stream over all available input; returns the folder of its output."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = streams.start_stream(build, sink(folder), f"{folder}-checkpoint", output_mode, {"availableNow": True})
    query.awaitTermination()
    return folder


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


def _stream_select(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM events", "FROM {source}"), source=_event_stream(spark, sf))


@register("transaction_stream", _STREAM_SQL)
def transaction_stream(spark, sf):
    """Messages -> typed events -> watermark -> window summary in update mode, by micro-batches."""
    events = _stream_select(spark, sf, fx.STREAM_EVENTS)
    fields = ["eventId", "userId", "department", "action", F.lit(None).cast("string").alias("resource"),
              F.col("event_ts").cast("timestamp").alias("timestamp"), "amount"]
    messages = events.select(F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).cast("binary").alias("value"))
    summary = streams.transaction_summary(streams.parse_events(messages), ["Finance", "General"])
    folder = _run_stream(spark, summary, streams.updates_to)
    return _rounded(streams.latest_updates(spark.read.parquet(folder), ["window_start", "department"]))


@register("decision_stream", f"WITH {orc.decided()} SELECT request_id, effect, reason FROM decided")
def decision_stream(spark, sf):
    """A request stream, each micro-batch decided under the policies of that moment."""
    requests = fx.with_environment(_stream_select(spark, sf, fx.REQUESTS))
    requests = requests.withColumn("request_ts", F.col("request_ts").cast("timestamp"))
    folder = _run_stream(
        spark, requests, lambda path: streams.decisions_to(path, lambda: fx.policies(spark)), "append"
    )
    return spark.read.parquet(folder).select("request_id", "effect", "reason")


@register(
    "session_stream",
    f"WITH {orc.SESSIONS} SELECT session_id, user_id, epoch_us(event_ts) AS created_at FROM sessions",
)
def session_stream(spark, sf):
    """Open sessions kept as streaming state."""
    events = _stream_select(spark, sf, fx.SESSION_EVENTS).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    folder = _run_stream(spark, streams.session_state(events), streams.updates_to)
    states = streams.latest_updates(spark.read.parquet(folder), ["session_id", "window_start"])
    state = streams.current_state(states).filter("open")
    return state.select("session_id", "user_id", F.unix_micros("changed_at").alias("created_at"))


# Creates and removes of sessions; most reach the stream up to six days after their time, in three batches.
_ARRIVALS = """SELECT event_id AS seq, 's_' || CAST(event_id % 700 AS VARCHAR(20)) AS session_id, CAST(user_id AS VARCHAR(20)) AS user_id,
  CASE WHEN event_type = 'error' THEN 'remove' ELSE 'create' END AS op, ts AS event_ts FROM events WHERE event_type IN ('signup', 'error')"""
_TRACKED_SQL = f"""WITH e AS (SELECT *, least(2, (epoch_us(event_ts) // 86400000000 - 19723 + seq % 7) // 11) AS b FROM ({_ARRIVALS})),
  marks AS (SELECT n, (SELECT epoch_ms(max(event_ts)) - 172800000 FROM e WHERE b < n) AS mark FROM (VALUES (0), (1), (2), (3)) AS t(n)),
  seen AS (SELECT e.*, coalesce(epoch_us(event_ts) <= mark * 1000, false) AS late FROM e JOIN marks ON b = n)"""


def _track_sessions(spark, sf) -> tuple[str, list[int]]:
    """Runs the arrivals through :func:`streams.tracked_sessions`, restarted for each of three batches: folder, rows dropped."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events = fx.select(spark, sf, _ARRIVALS).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    day = F.floor(F.unix_micros("event_ts") / 86_400_000_000) - 19723
    events = events.withColumn("b", F.least(F.lit(2), F.floor((day + F.col("seq") % 7) / 11)))
    dropped = []
    for b in range(3):
        events.filter(F.col("b") == b).write.mode("append").parquet(f"{folder}-in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}-in").withWatermark("event_ts", "2 days")
        query = streams.start_stream(
            streams.tracked_sessions(source, "3 days"), streams.updates_to(folder), f"{folder}-checkpoint", trigger={"availableNow": True}
        )
        query.awaitTermination()
        dropped.append(streams.dropped_rows(query))
    return folder, dropped


@register(
    "session_stream_tracked",
    f"""{_TRACKED_SQL}, last AS (SELECT session_id, arg_max(user_id, (event_ts, seq)) AS user_id, arg_max(op, (event_ts, seq)) AS op,
        max(event_ts) AS changed_at FROM seen WHERE NOT late GROUP BY session_id)
      SELECT session_id, user_id, epoch_us(changed_at) AS changed_at, CASE WHEN op = 'remove' THEN 'closed'
        WHEN epoch_ms(changed_at) + 259200000 <= (SELECT mark FROM marks WHERE n = 3) THEN 'expired' ELSE 'open' END AS state FROM last""",
)
def session_stream_tracked(spark, sf):
    """Sessions as state with timers: out of order and late rows, expiry, two restarts from the checkpoint."""
    folder, _ = _track_sessions(spark, sf)
    last = streams.latest_updates(spark.read.parquet(folder), ["session_id"])
    return last.select("session_id", "user_id", micros("changed_at"), "state")


@register(
    "session_stream_late",
    f"{_TRACKED_SQL} SELECT CAST(n AS BIGINT) AS batch, count(seq) FILTER (late) AS dropped FROM marks LEFT JOIN seen ON b = n WHERE n < 3 GROUP BY n",
)
def session_stream_late(spark, sf):
    """How many rows each batch lost for being later than the watermark."""
    _, dropped = _track_sessions(spark, sf)
    return spark.createDataFrame(list(enumerate(dropped)), "batch bigint, dropped bigint")


_ZONES = ("click", "purchase", "error")


@register(
    "stream_start_checks",
    " UNION ALL ".join(
        f"SELECT '{zone}' AS zone, '{'refused' if zone == 'error' else 'started'}' AS outcome, "
        + ("0 * count(*)" if zone == "error" else "count(*)") + f" AS written FROM events WHERE event_type = '{zone}'"
        for zone in _ZONES
    ),
)
def stream_start_checks(spark, sf):
    """A stream for each kind of event; it starts only where its source may be read and its sink written."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    policy = {"id": "z", "name": "zones", "enabled": True, "defaultEffect": "DENY", "rules": [fx._rule(
        "r", "r", "PERMIT", [], {"actions": ["read", "write"], "resources": ["*/click", "*/purchase", "*-out"]})]}
    run, events, found = engine(spark, [policy]), fx.table(spark, sf, "events"), []
    for zone in _ZONES:
        events.filter(F.col("event_type") == zone).write.parquet(f"{folder}/{zone}")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/{zone}")
        out = f"{folder}/{zone}-out"
        writer = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/{zone}-log").trigger(availableNow=True)
        try:
            streams.start_secured(writer, run, out, principal=secured.Principal("etl@corp", "s")).awaitTermination()
            rows = spark.read.schema(events.schema).parquet(out).agg(F.lit("started").alias("outcome"), F.count("*").alias("written"))
        except PermissionError:
            rows = spark.range(1).select(F.lit("refused").alias("outcome"), F.lit(0).cast("bigint").alias("written"))
        found.append(rows.select(F.lit(zone).alias("zone"), "outcome", "written"))
    return reduce(DataFrame.unionByName, found)


# --- the store that lasts ------------------------------------------------------------------------------

_DAY = dt.datetime(2024, 1, 1)


def _supplier_store(spark, sf) -> VersionedStore:
    """Policies of the suppliers, committed by several writers: import, change, delete, disable, roll back."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    policies, _ = fx.supplier_policies(spark, sf)
    VersionedStore(spark, folder).commit(policies, 0, "import", "a", _DAY)
    late = VersionedStore(spark, folder)  # starts from commit 1 and is late
    number = F.regexp_extract("policy_id", "([0-9]+)", 1).cast("int")
    raised = policies.filter(number % 3 == 0).withColumn("priority", F.col("priority") + 100)
    VersionedStore(spark, folder).upsert(raised, author="b", at=_DAY + dt.timedelta(days=1))
    try:
        late.delete(policies.filter(number % 2 == 0), parent=1, author="late")
        raise AssertionError("a late writer must be refused")
    except Conflict:
        late.delete(policies.filter(number % 10 == 0), author="late", at=_DAY + dt.timedelta(days=2))
    VersionedStore(spark, folder).set_enabled("sp-1", False, author="b", at=_DAY + dt.timedelta(days=3))
    VersionedStore(spark, folder).rollback(2, author="a", at=_DAY + dt.timedelta(days=4))
    return VersionedStore(spark, folder)


_STORE_SQL = f"""WITH {orc.SUPPLIER_POLICIES}, s AS (SELECT *, CAST(regexp_extract(policy_id, '([0-9]+)', 1) AS INT) AS k FROM policies),
  log(n, operation, author) AS (VALUES (1, 'import', 'a'), (2, 'upsert', 'b'), (3, 'delete', 'late'), (4, 'disable', 'b'), (5, 'rollback to 2', 'a')),
  states AS (SELECT n, policy_id, CASE WHEN n > 1 AND k % 3 = 0 THEN priority + 100 ELSE priority END AS priority,
    enabled AND NOT (n = 4 AND policy_id = 'sp-1') AS enabled FROM s, log WHERE NOT (n IN (3, 4) AND k % 10 = 0))"""


@register(
    "policy_store_history",
    f"""{_STORE_SQL} SELECT CAST(n AS BIGINT) AS "commit", CAST(n - 1 AS BIGINT) AS parent, operation, author, count(policy_id) AS policies,
      count(*) FILTER (enabled) AS enabled, CAST(sum(priority) AS BIGINT) AS priorities
      FROM log JOIN states USING (n) GROUP BY ALL""",
)
def policy_store_history(spark, sf):
    """Every commit of a store that several writers changed, each read as it was."""
    store = _supplier_store(spark, sf)
    each = [
        store.read(c).agg(
            F.count("*").alias("policies"), F.count_if("enabled").alias("enabled"), F.sum("priority").cast("bigint").alias("priorities")
        ).withColumn("commit", F.lit(c).cast("bigint"))
        for c in range(1, store.latest() + 1)
    ]
    states = reduce(DataFrame.unionByName, each)
    return store.history().join(states, "commit").select("commit", "parent", "operation", "author", "policies", "enabled", "priorities")


@register(
    "policy_store_changes",
    f"""{_STORE_SQL}, a AS (SELECT * FROM states WHERE n = 1), b AS (SELECT * FROM states WHERE n = 4)
      SELECT policy_id, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' ELSE 'changed' END AS change
      FROM a FULL JOIN b USING (policy_id) WHERE a.n IS NULL OR b.n IS NULL OR a.priority <> b.priority OR a.enabled <> b.enabled""",
)
def policy_store_changes(spark, sf):
    """What differs between the first day and the fourth."""
    store = _supplier_store(spark, sf)
    since, until = (store.commit_before(_DAY + dt.timedelta(days=d, hours=1)) for d in (0, 3))
    return store.changes(since, until).select("policy_id", "change")


_OPEN = {"id": "open", "name": "Open data", "enabled": True, "priority": 9, "defaultEffect": "PERMIT",
         "target": {"resources": ["s3://public-datasets/*"]}, "rules": []}
_LAKE = {"id": "lake", "name": "Lake", "enabled": True, "defaultEffect": "DENY", "target": {"resources": ["s3://data-lake/*"]}, "rules": []}


@register(
    "decision_stream_commits",
    f"""WITH {orc.ATTRS} SELECT request_id, CASE WHEN bad THEN 'DENY' WHEN event_open AND b <> 3 THEN 'PERMIT'
        WHEN event_lake AND b >= 2 THEN 'DENY' ELSE 'NOT_APPLICABLE' END AS effect,
      CASE WHEN bad THEN 'error' WHEN event_open AND b <> 3 THEN 'Access granted by policy: Open data'
        WHEN event_lake AND b >= 2 THEN 'Access denied by policy: Lake' ELSE 'No applicable policies' END AS reason
      FROM (SELECT *, request_id % 5 AS b, starts_with(resource, 's3://public-datasets/') AS event_open,
        starts_with(resource, 's3://data-lake/') AS event_lake FROM attrs)""",
)
def decision_stream_commits(spark, sf):
    """A stream restarted from its checkpoint for each of five batches, while three commits change the policies."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    store = VersionedStore(spark, f"{folder}-store")
    store.commit(fx.policies(spark, [_OPEN]), 0, "import")
    changes = {
        2: lambda: store.upsert(fx.policies(spark, [_LAKE])),
        3: lambda: store.set_enabled("open", False),
        4: lambda: store.rollback(2),
    }
    policies, events = Refreshed(store), fx.table(spark, sf, "events")
    for b in range(5):
        changes.get(b, lambda: None)()
        events.filter(F.col("event_id") % 5 == b).write.mode("append").parquet(f"{folder}-in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}-in")
        requests = fx.with_environment(spark.sql(fx.REQUESTS.replace("FROM events", "FROM {source}"), source=source))
        requests = requests.withColumn("request_ts", F.col("request_ts").cast("timestamp"))
        sink = streams.decisions_to(folder, policies)
        streams.start_stream(requests, sink, f"{folder}-checkpoint", "append", {"availableNow": True}).awaitTermination()
    error = F.startswith("reason", F.lit("Evaluation error"))
    found = spark.read.parquet(folder)
    return found.select("request_id", "effect", F.when(error, F.lit("error")).otherwise(F.col("reason")).alias("reason"))
