"""Request logs, policies and other inputs derived from the driver tables.

The SELECT texts run unchanged in Spark and in DuckDB, so the oracle sees the
same inputs.  Policies are test data (fixed values).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warden.functions.attributes import attr
from warden.sources.policies import parse_policies, parse_policy_rows

# --- SELECTs shared with the oracle -------------------------------------------

REQUESTS = """
SELECT event_id AS request_id,
  CASE user_id % 5 WHEN 0 THEN 'hr_u' WHEN 1 THEN 'finance_u' WHEN 2 THEN 'manager_u'
                   WHEN 3 THEN 'analyst_u' ELSE 'svc_u' END
    || CAST(user_id AS VARCHAR(20))
    || CASE WHEN user_id % 29 = 0 THEN '@' WHEN user_id % 7 = 0 THEN '' ELSE '@company.com' END AS subject,
  CASE event_id % 8
    WHEN 0 THEN 's3://data-lake/departments/hr/employees.parquet'
    WHEN 1 THEN 's3://data-lake/departments/finance/budgets.parquet'
    WHEN 2 THEN 's3://data-lake/departments/hr/sensitive/salaries.parquet'
    WHEN 3 THEN 's3://data-lake/departments/finance/confidential/audit.json'
    WHEN 4 THEN 's3://data-lake/internal/ops/log.json'
    WHEN 5 THEN 's3://public-datasets/weather/2024.csv'
    WHEN 6 THEN 'abfs://raw@acct.dfs.core.windows.net/finance/pii/p.parquet'
    ELSE 'hdfs://nn/tmp/scratch' END AS resource,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'signup' THEN 'read' WHEN 'click' THEN 'query'
                  WHEN 'purchase' THEN 'write' ELSE 'delete' END AS action,
  'session_' || CAST(user_id % 50 AS VARCHAR(20)) AS session_id,
  ts AS request_ts,
  CASE WHEN value > 50 THEN 'notebook' ELSE 'batch' END AS env_app
FROM events
"""

NS_REQUESTS = """
SELECT event_id AS request_id,
  CASE WHEN user_id % 11 = 0 THEN 'alice' ELSE 'system:serviceaccount:'
     || CASE user_id % 3 WHEN 0 THEN 'teama' WHEN 1 THEN 'teamb' ELSE 'teamc' END || ':'
     || CASE user_id % 4 WHEN 0 THEN 'spark-driver' WHEN 1 THEN 'spark-executor'
                         WHEN 2 THEN 'spark-admin' ELSE 'notebook' END END AS username,
  CASE event_id % 7 WHEN 0 THEN 's3://bucket/teama/data/f.parquet' WHEN 1 THEN 's3://bucket/teamb/data/f.parquet'
    WHEN 2 THEN 's3://shared-bucket/ref/f.parquet' WHEN 3 THEN 's3://public-datasets/x/f.csv'
    WHEN 4 THEN 'abfs://c@acct.dfs.core.windows.net/teama/f.parquet'
    WHEN 5 THEN 'https://acct.blob.core.windows.net/c/teamb/f.parquet' ELSE 's3://bucket' END AS path,
  CASE event_type WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'delete' WHEN 'signup' THEN '' ELSE 'read' END AS operation,
  CAST(user_id % 4 AS INT) - 1 AS expiry_hours, ts AS request_ts
FROM events
"""

SESSION_EVENTS = """
SELECT event_id AS seq, 'session_' || CAST(user_id % 50 AS VARCHAR(20)) AS session_id,
  'user_' || CAST(user_id AS VARCHAR(20)) || '@company.com' AS user_id,
  CASE WHEN event_type = 'error' THEN 'remove' ELSE 'create' END AS op, ts AS event_ts
FROM events WHERE event_type IN ('signup', 'error')
"""

PATHS = """
SELECT event_id AS path_id, CASE event_id % 9
  WHEN 0 THEN 'sas://bkt' || u || '/ns' || e || '/a//b.parquet' WHEN 1 THEN 's3://bkt/ns' || u || '/dir' || e || '/'
  WHEN 2 THEN 's3://bkt' || e WHEN 3 THEN 'abfs://c' || u || '@acct.dfs.core.windows.net/ns' || e || '/f.csv'
  WHEN 4 THEN 'https://acct' || u || '.blob.core.windows.net/c/ns' || e || '/f.json'
  WHEN 5 THEN '//rel' || u || '//path' || e || '/' WHEN 6 THEN 'abfs://c' || e WHEN 7 THEN 'hdfs://nn/tmp//' || e || '//'
  ELSE '' END AS path
FROM (SELECT event_id, CAST(event_id AS VARCHAR(20)) AS e, CAST(user_id AS VARCHAR(20)) AS u FROM events)
"""

STREAM_EVENTS = """
SELECT CAST(event_id AS VARCHAR(20)) AS eventId, CAST(user_id AS VARCHAR(20)) AS userId,
  CASE user_id % 4 WHEN 0 THEN 'Finance' WHEN 1 THEN 'General' WHEN 2 THEN 'HR' ELSE 'Legal' END AS department,
  event_type AS action, ts AS event_ts, value AS amount
FROM events
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def select(spark: SparkSession, sf: str, text: str, source: str = "events") -> DataFrame:
    return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf, source))


def with_environment(df: DataFrame) -> DataFrame:
    """Environment as the read check builds it: app name, session, data format."""
    extension = F.regexp_extract("resource", r"\.([a-z]+)\z", 1)
    entries = (
        F.lit("spark.app.name"), attr(F.col("env_app"), "string"),
        F.lit("spark.session.id"), attr(F.col("session_id"), "string"),
        F.lit("data.format"), attr(extension, "string"),
    )
    return df.withColumn("environment", F.create_map(*entries)).drop("env_app")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    df = select(spark, sf, REQUESTS)
    return with_environment(df).withColumn("request_ts", F.col("request_ts").cast("timestamp"))


def ns_requests(spark: SparkSession, sf: str) -> DataFrame:
    return select(spark, sf, NS_REQUESTS).withColumn("request_ts", F.col("request_ts").cast("timestamp"))


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    return select(spark, sf, SESSION_EVENTS).withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return select(spark, sf, PATHS)


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    df = select(spark, sf, STREAM_EVENTS)
    return df.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withColumnRenamed("event_ts", "timestamp")


# --- policies (fixed values) ---------------------------------------------------

def _condition(attribute: str, operator: str, expected) -> dict:
    return {"attributeName": attribute, "operator": operator, "expectedValue": expected}


def _rule(rule_id: str, name: str, effect: str, conditions, target=None, enabled=True) -> dict:
    return {"id": rule_id, "name": name, "enabled": enabled, "effect": effect, "target": target, "conditions": conditions}


# Fixed value: an expression that conditions must take as it is.
_HOURS = "T(java.time.LocalTime).now().getHour() >= 8 && T(java.time.LocalTime).now().getHour() <= 18"
_DEPARTMENTS = "s3://data-lake/departments/"
_READS = ["read", "query"]

POLICY_1 = {
    "id": "staff-folders", "name": "Staff folders", "version": "1.0", "enabled": True,
    "priority": 100, "defaultEffect": "DENY",
    "target": {"resources": [_DEPARTMENTS + "*"], "actions": _READS},
    "rules": [
        _rule("own", "people by day", "PERMIT",
              [_condition("user.username", "STARTS_WITH", "hr_"), _condition("currentHour", "GREATER_THAN", 6),
               _condition("currentHour", "LESS_THAN", 20)],
              {"resources": [_DEPARTMENTS + "hr/*"]}),
        _rule("ledgers", "ledgers by clearance", "PERMIT",
              [_condition("user.department", "CONTAINS", "Fin"), _condition("user.clearanceLevel", "GREATER_THAN", 2)],
              {"resources": [_DEPARTMENTS + "finance/*"], "actions": ["re*", "query"]}),
        _rule("leads", "leads everywhere", "PERMIT", [{"expression": "#user_role == 'Manager' && user.clearanceLevel > 3"}]),
    ],
}

POLICY_2 = {
    "id": "ledger-staff", "name": "Ledgers for finance staff", "enabled": True, "priority": 100, "defaultEffect": "DENY",
    "target": {"resources": [_DEPARTMENTS + "finance/*"], "actions": ["read", "write"], "subjects": ["*"]},
    "rules": [
        _rule("p2-r1", "p2-r1", "DENY", [_condition("user.department", "NOT_EQUALS", "Finance")]),
        _rule("p2-r2", "p2-r2", "PERMIT",
              [_condition("user.clearanceLevel", "GREATER_THAN", 2),
               _condition("resource.sensitivityLevel", "LESS_THAN_OR_EQUAL", "4")],
              {"actions": ["write"]}),
    ],
}

POLICY_3 = {
    "id": "internal-by-day", "name": "Internal by day", "enabled": True, "priority": 10,
    "defaultEffect": "NOT_APPLICABLE", "target": {"resources": ["s3://data-lake/internal/*"]},
    "rules": [
        _rule("p3-r1", "p3-r1", "DENY", [_condition("currentDay", "IN", ["SATURDAY", "SUNDAY"])]),
        _rule("p3-r2", "p3-r2", "PERMIT", [{"expression": "currentHour >= 8 AND currentHour <= 18"}], {"actions": _READS}),
        _rule("p3-r3", "p3-r3", "PERMIT", [], enabled=False),
    ],
}

POLICY_4 = {
    "id": "policy-004", "name": "Public Data", "enabled": True, "priority": 5,
    "target": {"resources": ["s3://public-datasets/*"], "actions": ["re*", "query"]},
    "rules": [_rule("p4-r1", "p4-r1", "PERMIT", None)],
}

POLICY_5 = {
    "id": "policy-005", "name": "Disabled Permit All", "enabled": False, "priority": 999, "target": None,
    "rules": [_rule("p5-r1", "p5-r1", "PERMIT", [])],
}

POLICY_6 = {
    "id": "policy-006", "name": "Pattern Users", "enabled": True, "priority": 1,
    "target": {"resources": ["abfs://*/finance/*"], "subjects": ["*@company.com"]},
    "rules": [
        _rule("p6-r1", "p6-r1", "PERMIT",
              [_condition("user.username", "MATCHES", "(hr|finance)_u[0-9]+"),
               _condition("spark.app.name", "EQUALS", "notebook")]),
    ],
}

POLICIES = [POLICY_1, POLICY_2, POLICY_3, POLICY_4, POLICY_5, POLICY_6]

POLICY_3_VERSIONS = [
    {**POLICY_3, "version": "1.0", "updatedAt": "2024-01-01T00:00:00Z"},
    {**POLICY_3, "version": "2.0", "updatedAt": "2024-01-11T00:00:00Z",
     "rules": [POLICY_3["rules"][0],
               _rule("p3-r2", "p3-r2", "PERMIT",
                     [{"expression": "currentHour >= 0 AND currentHour <= 23"}], {"actions": _READS})]},
    {**POLICY_3, "version": "3.0", "updatedAt": "2024-01-21T00:00:00Z", "enabled": False},
]


def policy_documents(spark: SparkSession, policies: list[dict]) -> DataFrame:
    """One JSON document holding the list, as a policy file would."""
    return spark.createDataFrame([(json.dumps(policies),)], "value string")


def policies(spark: SparkSession, listed: list[dict] | None = None) -> DataFrame:
    good, _ = parse_policies(policy_documents(spark, POLICIES if listed is None else listed))
    return good


# --- policies derived from tables ------------------------------------------------

# One JSON policy per supplier: a folder per nation, open to two departments,
# with some rows made invalid so that the checks have work.
SUPPLIER_POLICIES = """
SELECT CAST(s_suppkey AS INT) AS policy_ord,
  '{{"id":' || CASE WHEN s_suppkey % 17 = 0 THEN 'null' ELSE '"sp-' || CAST(s_suppkey AS VARCHAR(20)) || '"' END
  || ',"name":"Supplier ' || CAST(s_suppkey AS VARCHAR(20)) || '"'
  || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ',"enabled":true' END
  || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',"priority":' || CAST(s_nationkey % 5 AS VARCHAR(20)) END
  || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ',"version":"2.' || CAST(s_suppkey % 3 AS VARCHAR(20)) || '"' END
  || CASE WHEN s_suppkey % 23 = 0 THEN ',"owner":"x"' ELSE '' END
  || CASE WHEN s_acctbal < 0 THEN ',"defaultEffect":"NOT_APPLICABLE"' ELSE '' END
  || ',"target":{{"resources":["s3://lake/n' || CAST(s_nationkey AS VARCHAR(20)) || '/*"],"actions":["read"]}}'
  || ',"rules":[{{"id":"r1","name":"r1","enabled":true,"effect":"'
  || CASE WHEN s_suppkey % 2 = 0 THEN 'PERMIT' ELSE 'DENY' END
  || '","conditions":[{{"attributeName":"user.clearanceLevel","operator":"GREATER_THAN_OR_EQUAL","expectedValue":'
  || CAST(1 + s_suppkey % 4 AS VARCHAR(20)) || '}}]}}]}}' AS value
FROM supplier
"""

# One JSON policy per customer, met by its subject alone: no resource, no folder.
SUBJECT_POLICIES = """
SELECT CAST(c_custkey AS INT) AS policy_ord,
  '{{"id":"cu-' || CAST(c_custkey AS VARCHAR(20)) || '","name":"Customer ' || CAST(c_custkey AS VARCHAR(20))
  || '","enabled":true,"defaultEffect":"' || CASE WHEN c_acctbal > 0 THEN 'PERMIT' ELSE 'DENY' END
  || '","target":{{"subjects":["' || CASE c_custkey % 5 WHEN 0 THEN 'hr_u' WHEN 1 THEN 'finance_u' WHEN 2 THEN 'manager_u'
                                     WHEN 3 THEN 'analyst_u' ELSE 'svc_u' END
  || CAST(c_custkey AS VARCHAR(20)) || '@company.com"],"actions":["read","query"]}},"rules":[]}}' AS value
FROM customer
"""

# Requests against those folders: one per customer order.
# A policy for each customer by text inside a path or a name alone, and requests that meet them.
INNER_POLICIES = """
SELECT '{{"id":"w' || c_custkey || '","name":"Inner ' || c_custkey || '","enabled":true,"defaultEffect":"DENY","target":{{'
    || CASE WHEN c_custkey % 2 = 0 THEN '"resources":["*/u' || c_custkey || '/*"]'
            ELSE '"subjects":["*_u' || c_custkey || '@mail*.org","nobody*@' || c_custkey || '"]' END
    || '}},"rules":[' || CASE WHEN c_acctbal > 0 THEN '{{"id":"r","name":"r","enabled":true,"effect":"PERMIT","conditions":[]}}' ELSE '' END
    || ']}}' AS value, CAST(c_custkey AS INT) AS policy_ord
FROM customer
"""

INNER_REQUESTS = """
SELECT event_id AS request_id,
  'p_u' || CAST(user_id AS VARCHAR(20)) || '@mail' || CAST(user_id % 7 AS VARCHAR(20)) || '.example.org' AS subject,
  's3://lake/' || CAST(event_id % 13 AS VARCHAR(20)) || '/u' || CAST(user_id AS VARCHAR(20)) || '/' || event_type || '.parquet' AS resource,
  'read' AS action, 's' AS session_id, ts AS request_ts
FROM events
"""

FOLDER_REQUESTS = """
SELECT o_orderkey AS request_id,
  CASE o_custkey % 4 WHEN 0 THEN 'hr_u' WHEN 1 THEN 'finance_u' WHEN 2 THEN 'manager_u' ELSE 'svc_u' END
    || CAST(o_custkey % 100 AS VARCHAR(20)) AS subject,
  's3://lake/n' || CAST(o_orderkey % 25 AS VARCHAR(20)) || '/orders/' || o_orderstatus AS resource,
  CASE WHEN o_orderkey % 10 = 0 THEN 'write' ELSE 'read' END AS action,
  's' || CAST(o_custkey % 20 AS VARCHAR(20)) AS session_id, o_orderdate AS request_ts
FROM orders
"""


def supplier_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = SUPPLIER_POLICIES.replace("FROM supplier", "FROM {source}")
    return spark.sql(text, source=table(spark, sf, "supplier"))


def supplier_policies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return parse_policy_rows(supplier_documents(spark, sf), "value", "policy_ord")


def subject_policies(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.sql(SUBJECT_POLICIES.replace("FROM customer", "FROM {source}"), source=table(spark, sf, "customer"))
    return parse_policy_rows(documents, "value", "policy_ord")[0]


def folder_requests(spark: SparkSession, sf: str) -> DataFrame:
    df = select(spark, sf, FOLDER_REQUESTS, "orders")
    return df.withColumn("request_ts", F.col("request_ts").cast("timestamp"))


def inner_policies(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.sql(INNER_POLICIES.replace("FROM customer", "FROM {source}"), source=table(spark, sf, "customer"))
    return parse_policy_rows(documents, "value", "policy_ord")[0]


def inner_requests(spark: SparkSession, sf: str) -> DataFrame:
    df = select(spark, sf, INNER_REQUESTS, "events")
    return df.withColumn("request_ts", F.col("request_ts").cast("timestamp"))
