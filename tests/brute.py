"""One-request-at-a-time evaluation in plain Python, to test the Spark plans against."""

import math
import re


def attributes(request):
    """Attribute map, or None when the subject has no usable domain."""
    subject, resource = request["subject"], request["resource"]
    found = {"subject": subject, "resource": resource, "action": request["action"], "sessionId": request["session_id"]}
    found.update(request.get("environment") or {})
    ts = request["request_ts"]
    found["currentHour"] = ts.hour
    found["currentDay"] = ts.strftime("%A").upper()
    name, at, domain = subject.partition("@")
    if at:
        if not domain.strip("@"):
            return None
        found["user.domain"] = domain.split("@")[0]
    found["user.username"] = name
    level = 1
    if name.startswith("hr_"):
        found["user.department"], level = "HR", 2
    elif name.startswith("finance_"):
        found["user.department"], level = "Finance", 3
    elif name.startswith("manager_"):
        found["user.role"], level = "Manager", 4
    else:
        found["user.department"] = "General"
    found["user.clearanceLevel"] = level
    marks = ((("/sensitive/", "/pii/"), 5), (("/confidential/",), 4), (("/internal/",), 3))
    found["resource.sensitivityLevel"] = next((n for words, n in marks if any(w in resource for w in words)), 1)
    return found


class BadPattern(Exception):
    pass


def wildcard(value, pattern):
    if pattern == "*":
        return True
    if "*" not in pattern:
        return value == pattern
    try:
        return re.fullmatch(pattern.replace("*", ".*"), value) is not None
    except re.error as error:
        raise BadPattern from error


def target(request, wanted):
    for facet, field in (("resources", "resource"), ("actions", "action"), ("subjects", "subject")):
        listed = (wanted or {}).get(facet)
        if listed and not any(wildcard(request[field], p) for p in listed):
            return False
    return True


def same(a, b):
    return type(a) is type(b) and a == b


def printed(value):
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def holds(condition, found):
    actual, expected = found.get(condition["attributeName"]), condition.get("expectedValue")
    if actual is None:
        return False
    op = condition["operator"]
    if op == "EQUALS":
        return same(actual, expected)
    if op == "NOT_EQUALS":
        return not same(actual, expected)
    if op == "IN":
        return isinstance(expected, list) and any(same(actual, e) for e in expected)
    if op == "NOT_IN":
        return not (isinstance(expected, list) and any(same(actual, e) for e in expected))
    if expected is None:
        return False
    if op in ("GREATER_THAN", "GREATER_THAN_OR_EQUAL", "LESS_THAN", "LESS_THAN_OR_EQUAL"):
        try:
            a, e = float(printed(actual)), float(printed(expected))
        except ValueError:
            return False
        return {"GREATER_THAN": a > e, "GREATER_THAN_OR_EQUAL": a >= e, "LESS_THAN": a < e,
                "LESS_THAN_OR_EQUAL": a <= e}[op] and not math.isnan(a)
    a, e = printed(actual), printed(expected)
    if op == "MATCHES":
        try:
            return re.fullmatch(e, a) is not None
        except re.error:
            return False
    return {"CONTAINS": e in a, "NOT_CONTAINS": e not in a, "STARTS_WITH": a.startswith(e), "ENDS_WITH": a.endswith(e)}[op]


def decide(request, policies):
    """``(effect, reason)`` under policies in list order."""
    found = attributes(request)
    if found is None:
        return "DENY", "Evaluation error"
    try:
        ranked = sorted((p for p in policies if p.get("enabled") and target(request, p.get("target"))),
                        key=lambda p: -p.get("priority", 0))
        if not ranked:
            return "NOT_APPLICABLE", "No applicable policies"
        last = None
        for policy in ranked:
            effect = policy.get("defaultEffect", "DENY")
            for rule in policy["rules"]:
                if not rule.get("enabled") or not target(request, rule.get("target")):
                    continue
                if all(holds(c, found) for c in rule.get("conditions") or []):
                    if rule["effect"] == "PERMIT":
                        effect = "PERMIT"
                        break
                    if rule["effect"] == "DENY":
                        effect = "DENY"
            if effect == "PERMIT":
                return "PERMIT", "Access granted by policy: " + policy["name"]
            if effect == "DENY":
                last = policy["name"]
    except BadPattern:
        return "DENY", "Evaluation error"
    return ("DENY", "Access denied by policy: " + last) if last else ("NOT_APPLICABLE", "No rules matched")
