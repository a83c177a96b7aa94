"""SQL building blocks of the oracle queries, written independently of the library."""

from __future__ import annotations

from warden.plans import fixtures as fx

REQUESTS = f"requests AS ({fx.REQUESTS})"

# What conditions see of a request.
ATTRS = f"""{REQUESTS}, named AS (
  SELECT *, split_part(subject, '@', 1) AS username,
    CASE WHEN contains(subject, '@') THEN split_part(subject, '@', 2) END AS domain,
    regexp_full_match(subject, '[^@]*@+') AS bad,
    hour(request_ts) AS hr, upper(dayname(request_ts)) AS dow,
    CASE WHEN contains(resource, '/sensitive/') OR contains(resource, '/pii/') THEN 5
         WHEN contains(resource, '/confidential/') THEN 4 WHEN contains(resource, '/internal/') THEN 3 ELSE 1 END AS sens
  FROM requests), attrs AS (
  SELECT *,
    CASE WHEN starts_with(username, 'hr_') THEN 'HR' WHEN starts_with(username, 'finance_') THEN 'Finance'
         WHEN starts_with(username, 'manager_') THEN NULL ELSE 'General' END AS dept,
    CASE WHEN starts_with(username, 'manager_') THEN 'Manager' END AS role,
    CASE WHEN starts_with(username, 'hr_') THEN 2 WHEN starts_with(username, 'finance_') THEN 3
         WHEN starts_with(username, 'manager_') THEN 4 ELSE 1 END AS clearance
  FROM named)"""

_HR, _FIN = "s3://data-lake/departments/hr/", "s3://data-lake/departments/finance/"


def judged(hours: str = "hr BETWEEN 8 AND 18", third: str = "TRUE") -> str:
    """Per policy: does it apply (a), permit (p), deny (d)? ``third`` says when policy 3 is in force."""
    return f"""judged AS (
  SELECT *,
    starts_with(resource, 's3://data-lake/departments/') AND action IN ('read', 'query') AS a1,
    coalesce(starts_with(resource, '{_HR}') AND dept = 'HR' AND hr BETWEEN 7 AND 19, FALSE)
      OR coalesce(starts_with(resource, '{_FIN}') AND dept = 'Finance' AND clearance >= 3, FALSE)
      OR coalesce(role = 'Manager' AND clearance >= 4, FALSE) AS p1,
    starts_with(resource, '{_FIN}') AND action IN ('read', 'write') AS a2,
    action = 'write' AND clearance > 2 AND sens <= 4 AS p2,
    starts_with(resource, 's3://data-lake/internal/') AND ({third}) AS a3,
    action IN ('read', 'query') AND ({hours}) AS p3,
    dow IN ('SATURDAY', 'SUNDAY') AS d3,
    starts_with(resource, 's3://public-datasets/') AND (starts_with(action, 're') OR action = 'query') AS a4,
    regexp_full_match(resource, 'abfs://.*/finance/.*') AND regexp_full_match(subject, '.*@company.com') AS a6,
    regexp_full_match(username, '(hr|finance)_u[0-9]+') AND env_app = 'notebook' AS p6
  FROM attrs)"""


def decided(first_only: bool = False, **how) -> str:
    """CTEs ending in ``decided(request_id, subject, ..., effect, reason)``."""
    names = {
        1: "Staff folders", 2: "Ledgers for finance staff", 3: "Internal by day",
        4: "Public Data", 6: "Pattern Users",
    }
    used = [1] if first_only else [1, 2, 3, 4, 6]
    permit = {1: "a1 AND p1", 2: "a2 AND p2", 3: "a3 AND p3", 4: "a4", 6: "a6 AND p6"}
    deny = {1: "a1", 2: "a2", 3: "a3 AND d3", 6: "a6"}
    reasons = [f"WHEN {permit[i]} THEN 'Access granted by policy: {names[i]}'" for i in used]
    reasons += [f"WHEN {deny[i]} THEN 'Access denied by policy: {names[i]}'" for i in reversed(used) if i in deny]
    any_applies = " OR ".join(f"a{i}" for i in used)
    return f"""{ATTRS}, {judged(**how)}, decided AS (
  SELECT *, CASE WHEN bad THEN 'DENY' WHEN reason LIKE 'Access granted%' THEN 'PERMIT'
                 WHEN reason LIKE 'Access denied%' THEN 'DENY' ELSE 'NOT_APPLICABLE' END AS effect
  FROM (SELECT *, CASE
      WHEN bad THEN 'Evaluation error: ' || CASE WHEN regexp_full_match(subject, '@+')
        THEN 'Index 0 out of bounds for length 0' ELSE 'Index 1 out of bounds for length 1' END
      {' '.join(reasons)}
      WHEN {any_applies} THEN 'No rules matched' ELSE 'No applicable policies' END AS reason
    FROM judged))"""


# Supplier policies against folder requests.
SUPPLIER_POLICIES = """policies AS (
  SELECT s_suppkey AS ord, 'sp-' || CAST(s_suppkey AS VARCHAR) AS policy_id,
    'Supplier ' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 4 <> 0 AS enabled,
    CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_nationkey % 5 END AS priority,
    CASE WHEN s_suppkey % 5 = 0 THEN '1.0' ELSE '2.' || CAST(s_suppkey % 3 AS VARCHAR) END AS version,
    CASE WHEN s_acctbal < 0 THEN 'NOT_APPLICABLE' ELSE 'DENY' END AS default_effect,
    s_nationkey AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'PERMIT' ELSE 'DENY' END AS rule_effect,
    1 + s_suppkey % 4 AS needed
  FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 23 <> 0)"""

FOLDER_DECISIONS = f"""{SUPPLIER_POLICIES}, folder_requests AS ({fx.FOLDER_REQUESTS}), pairs AS (
  SELECT r.request_id, p.name, CASE WHEN r.clearance >= p.needed THEN p.rule_effect ELSE p.default_effect END AS effect,
    CAST(-p.priority AS BIGINT) * 1000000000 + p.ord AS rank
  FROM (SELECT *, CASE WHEN starts_with(subject, 'hr_') THEN 2 WHEN starts_with(subject, 'finance_') THEN 3
                       WHEN starts_with(subject, 'manager_') THEN 4 ELSE 1 END AS clearance FROM folder_requests) r
  JOIN policies p ON p.enabled AND r.action = 'read'
    AND starts_with(r.resource, 's3://lake/n' || CAST(p.nation AS VARCHAR) || '/')), merged AS (
  SELECT request_id, arg_min(name, rank) FILTER (effect = 'PERMIT') AS granted,
    arg_max(name, rank) FILTER (effect = 'DENY') AS denied
  FROM pairs GROUP BY request_id), folder_decided AS (
  SELECT r.request_id,
    CASE WHEN granted IS NOT NULL THEN 'PERMIT' WHEN denied IS NOT NULL THEN 'DENY' ELSE 'NOT_APPLICABLE' END AS effect,
    CASE WHEN granted IS NOT NULL THEN 'Access granted by policy: ' || granted
         WHEN denied IS NOT NULL THEN 'Access denied by policy: ' || denied
         WHEN m.request_id IS NOT NULL THEN 'No rules matched' ELSE 'No applicable policies' END AS reason
  FROM folder_requests r LEFT JOIN merged m USING (request_id))"""

# Namespace decisions.
NS_DECIDED = f"""ns AS ({fx.NS_REQUESTS}), parts AS (
  SELECT *, split_part(username, ':', 3) AS ns, split_part(username, ':', 4) AS account,
    CASE WHEN operation = '' THEN 'read' ELSE operation END AS op,
    CASE WHEN expiry_hours > 0 THEN expiry_hours ELSE 1 END AS hours,
    CASE WHEN starts_with(path, 's3://') THEN nullif(split_part(substr(path, 6), '/', 2), '')
         WHEN contains(path, 'abfs://') THEN nullif(split_part(path, '/', 4), '') ELSE '' END AS path_ns
  FROM ns), ns_decided AS (
  SELECT *, coalesce(CASE op
      WHEN 'read' THEN coalesce(ns = path_ns, FALSE) OR starts_with(path, 's3://shared-bucket/')
                       OR starts_with(path, 's3://public-datasets/')
      WHEN 'write' THEN ns = path_ns AND account IN ('spark-driver', 'spark-executor')
      WHEN 'delete' THEN account = 'spark-admin' END, FALSE) AS allowed
  FROM parts), granted AS (
  SELECT *, allowed AND (starts_with(path, 's3://') OR starts_with(path, 'abfs://') OR starts_with(path, 'https://')) AS ok,
    request_ts + to_hours(hours) AS expires_at
  FROM ns_decided)"""

# Current sessions.
SESSIONS = f"""session_events AS ({fx.SESSION_EVENTS}), sessions AS (
  SELECT session_id, user_id, event_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, seq DESC) AS rn FROM session_events)
  WHERE rn = 1 AND op = 'create')"""
