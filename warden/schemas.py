"""Column layouts shared by every module.

Attribute values are untyped in policies and environments, so a value travels
as ``STRUCT<kind, text>``: the kind keeps ``3`` apart from ``"3"`` and an int
apart from a long, the text is what string operators see.
"""

from __future__ import annotations

# Decision effects, enum members and defaults of the policy model.
PERMIT = "PERMIT"
DENY = "DENY"
NOT_APPLICABLE = "NOT_APPLICABLE"
EFFECTS = (PERMIT, DENY, NOT_APPLICABLE)
CONDITION_OPERATORS = (
    "EQUALS",
    "NOT_EQUALS",
    "GREATER_THAN",
    "GREATER_THAN_OR_EQUAL",
    "LESS_THAN",
    "LESS_THAN_OR_EQUAL",
    "CONTAINS",
    "NOT_CONTAINS",
    "STARTS_WITH",
    "ENDS_WITH",
    "MATCHES",
    "IN",
    "NOT_IN",
)
DEFAULT_VERSION = "1.0"
UNKNOWN = "unknown"

ATTR = "struct<kind:string,text:string>"
ENVIRONMENT = f"map<string,{ATTR}>"

REQUEST = (
    "request_id bigint, subject string, resource string, action string, "
    f"session_id string, request_ts timestamp, environment {ENVIRONMENT}"
)

# Policy documents as they are written (JSON field names).
_TARGET_JSON = "struct<resources:array<string>,actions:array<string>,subjects:array<string>,environments:array<string>>"
_CONDITION_JSON = "struct<attributeName:string,operator:string,expectedValue:variant,expression:string>"
_RULE_JSON = (
    "struct<id:string,name:string,description:string,effect:string,"
    f"target:struct<resources:array<string>,actions:array<string>,subjects:array<string>>,"
    f"conditions:array<{_CONDITION_JSON}>,priority:int,enabled:boolean>"
)
POLICY_JSON = (
    "struct<id:string,name:string,description:string,version:string,"
    f"rules:array<{_RULE_JSON}>,target:{_TARGET_JSON},defaultEffect:string,"
    "createdAt:timestamp,updatedAt:timestamp,enabled:boolean,priority:int>"
)
POLICY_FIELDS = (
    "id", "name", "description", "version", "rules", "target", "defaultEffect",
    "createdAt", "updatedAt", "enabled", "priority",
)
RULE_FIELDS = ("id", "name", "description", "effect", "target", "conditions", "priority", "enabled")
CONDITION_FIELDS = ("attributeName", "operator", "expectedValue", "expression")

# Policies after loading: one row per policy, list order kept by the arrays.
PATTERN = "struct<kind:string,text:string,lead:string,regex:string>"
EXPECTED = f"struct<kind:string,text:string,items:array<{ATTR}>>"
CONDITION = f"struct<attribute:string,operator:string,expected:{EXPECTED},expression:string>"
RULE = (
    "struct<rule_ord:int,rule_id:string,name:string,effect:string,enabled:boolean,"
    f"resources:array<{PATTERN}>,actions:array<{PATTERN}>,subjects:array<{PATTERN}>,"
    f"conditions:array<{CONDITION}>>"
)
POLICY = (
    "policy_ord int, policy_id string, name string, version string, enabled boolean, "
    "priority int, default_effect string, "
    f"resources array<{PATTERN}>, actions array<{PATTERN}>, subjects array<{PATTERN}>, "
    f"rules array<{RULE}>, created_at timestamp, updated_at timestamp"
)

STREAM_EVENT = (
    "eventId string, userId string, department string, action string, resource string, "
    "timestamp timestamp, amount double"
)
