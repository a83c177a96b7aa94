import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from warden import schemas
from warden.functions import attributes as at
from warden.operators import reports
from warden.operators.evaluate import Engine
from warden.operators.policyset import PolicySet
from warden.plans import fixtures as fx
from warden.sources.policies import parse_policies

BASE = "s3://data-lake/departments/"
SCENARIO_3 = {
    "id": "hours", "name": "Internal by day", "enabled": True,
    "rules": [{"id": "r", "name": "r", "effect": "PERMIT", "conditions": [{"expression": fx._HOURS}]}],
}
GRANTED = "Access granted by policy: Staff folders"
REFUSED = "Access denied by policy: Staff folders"


def frame(spark, rows):
    """Requests from dicts with plain environment values."""
    kinds = {str: "string", int: "int", float: "double", bool: "bool"}
    data = []
    for i, r in enumerate(rows):
        env = {k: (kinds[type(v)], brute.printed(v)) for k, v in (r.get("environment") or {}).items()}
        data.append((i, r["subject"], r["resource"], r["action"], r["session_id"], r["request_ts"], env))
    return spark.createDataFrame(data, schemas.REQUEST)


def request(subject, resource, action, hour=10, environment=None):
    return {"subject": subject, "resource": resource, "action": action, "session_id": "s",
            "request_ts": dt.datetime(2024, 1, 3, hour, 30), "environment": environment}


def answers(engine, df, plan):
    rows = engine.evaluate(df, plan).select("request_id", "effect", "reason").orderBy("request_id").collect()
    return [(r["effect"], "Evaluation error" if r["reason"].startswith("Evaluation error: ") else r["reason"]) for r in rows]


GOLDEN = [
    ("hr_alice@company.com", BASE + "hr/employees.parquet", "read", 10, "PERMIT", GRANTED),
    ("hr_alice@company.com", BASE + "hr/employees.parquet", "read", 18, "PERMIT", GRANTED),
    ("hr_alice@company.com", BASE + "hr/employees.parquet", "read", 20, "DENY", REFUSED),
    ("hr_alice@company.com", BASE + "finance/budgets.parquet", "read", 10, "DENY", REFUSED),
    ("finance_bob@company.com", BASE + "finance/budgets.parquet", "read", 3, "PERMIT", GRANTED),
    ("manager_carol@company.com", BASE + "hr/employees.parquet", "query", 3, "PERMIT", GRANTED),
    ("finance_bob@company.com", BASE + "finance/aggregated/", "write", 10, "NOT_APPLICABLE", "No applicable policies"),
    ("unknown_user@company.com", BASE + "finance/budgets.parquet", "read", 10, "DENY", REFUSED),
    ("hr_alice@company.com", "s3://data-lake/other/x", "read", 10, "NOT_APPLICABLE", "No applicable policies"),
    ("bob@", "anything", "read", 10, "DENY", "Evaluation error"),
]


@pytest.mark.parametrize("plan", ["compiled", "joined"])
def test_golden_decisions(spark, plan):
    df = frame(spark, [request(s, r, a, h) for s, r, a, h, _, _ in GOLDEN])
    engine = Engine.over(fx.policies(spark, [fx.POLICY_1]))
    assert answers(engine, df, plan) == [(e, r) for *_, e, r in GOLDEN]


def test_missing_enabled_means_disabled(spark):
    df = frame(spark, [request("a@b", "x", "read"), request("hr_alice@c", BASE + "hr/employees.parquet", "read", 20)])
    denied = ("DENY", "Access denied by policy: Internal by day")
    assert answers(Engine.over(fx.policies(spark, [SCENARIO_3])), df, "auto")[0] == denied
    assert answers(Engine.over(fx.policies(spark, [fx.POLICY_1, SCENARIO_3])), df, "auto")[1] == denied


def test_no_policies_permit_nothing(spark):
    engine = Engine.over(fx.policies(spark).limit(0))
    df = frame(spark, [request("a@b", "x", "read")])
    for plan in ("compiled", "joined"):
        assert answers(engine, df, plan) == [("NOT_APPLICABLE", "No applicable policies")]


def test_subject_shapes(spark):
    subjects = ["user@", "@", "a@@", "@d", "a@b@c", "@@", "plain", "a@@c"]
    df = frame(spark, [request(s, "x", "read") for s in subjects])
    rows = at.resolve_attributes(df).withColumn("e", at.subject_error(F.col("subject"))).orderBy("request_id").collect()
    assert [r["e"] is not None for r in rows] == [True, True, True, False, False, True, False, False]
    assert [(r["user_username"], r["user_domain"]) for r in rows if r["e"] is None] == [
        ("", "d"), ("a", "b"), ("plain", None), ("a", "")]


def test_resource_shapes(spark):
    paths = ["s3://b/k/x/", "s3://", "s3:///", "s3://b", "s3://b//k", "hdfs://n/x"]
    df = frame(spark, [request("a", p, "read") for p in paths])
    rows = at.with_resource_attributes(df).orderBy("request_id").collect()
    assert [(r["resource_bucket"], r["resource_prefix"]) for r in rows] == [
        ("b", "k/x"), ("", None), (None, None), ("b", None), ("b", "/k"), (None, None)]


RESOURCES = ["s3://a/x/1", "s3://a/x/pii/2", "s3://a/y/1", "s3://b/x", "abfs://c@h/n/1", "plain", "s3://a/x/l\nbreak", "s3://a/"]
PATTERNS = ["*", "s3://a/*", "s3://a/x/*", "s3://a/x/1", "*/1", "s3://(a|b)/x*", "s3://a/[*", "s3://a/x/?*", "plain", "p*",
            "abfs://*/n/*", "s3://a/x/1**", "x|s3://b/x*"]
SUBJECTS = ["hr_1@c", "finance_2@c", "manager_3", "z@c", "bad@"]
ACTIONS = ["read", "write"]
CONDITIONS = [
    ("user.department", "EQUALS", "HR"), ("user.department", "NOT_EQUALS", "HR"), ("user.role", "NOT_EQUALS", "x"),
    ("user.clearanceLevel", "GREATER_THAN", 2), ("user.clearanceLevel", "LESS_THAN_OR_EQUAL", "3"),
    ("user.clearanceLevel", "EQUALS", "2"), ("user.username", "MATCHES", "(hr|finance)_[0-9]"), ("user.username", "MATCHES", "("),
    ("app", "EQUALS", "nb"), ("app", "CONTAINS", "n"), ("level", "IN", [1, "2", None]), ("level", "NOT_IN", [1]), ("level", "NOT_IN", 1),
    ("subject", "STARTS_WITH", "hr"), ("currentHour", "GREATER_THAN_OR_EQUAL", 12), ("user.department", "EQUALS", None),
    ("resource.sensitivityLevel", "LESS_THAN", 4.5), ("user.domain", "ENDS_WITH", "c"), ("user.department", "NOT_CONTAINS", "R"),
]


def random_policies(rng, n, bad=True):
    pool = [p for p in PATTERNS if bad or "[" not in p]

    def facet(options, k):
        return None if rng.random() < 0.4 else rng.sample(options, rng.randint(0, k))

    def some_target():
        return None if rng.random() < 0.3 else {
            "resources": facet(pool, 3), "actions": facet([*ACTIONS, "re*"], 2), "subjects": facet(["*@c", "manager_3", "*"], 2)}

    def rule(i):
        conditions = [{"attributeName": a, "operator": o, "expectedValue": e}
                      for a, o, e in rng.sample(CONDITIONS, rng.randint(0, 2))]
        return {"id": f"r{i}", "name": f"r{i}", "enabled": rng.random() < 0.9,
                "effect": rng.choice(["PERMIT", "DENY", "NOT_APPLICABLE"]), "target": some_target(),
                "conditions": rng.choice([conditions, conditions, None])}

    return [{"id": f"p{i}", "name": f"p{i}", "enabled": rng.random() < 0.9, "priority": rng.randint(0, 3),
             "defaultEffect": rng.choice(schemas.EFFECTS), "target": some_target(),
             "rules": [rule(k) for k in range(rng.randint(0, 3))]} for i in range(n)]


def random_requests(rng, n):
    rows = []
    for _ in range(n):
        environment = {}
        if rng.random() < 0.6:
            environment["app"] = rng.choice(["nb", "batch"])
        if rng.random() < 0.6:
            environment["level"] = rng.choice([1, "2", 3])
        if rng.random() < 0.2:
            environment["subject"] = "hr_env"
        if rng.random() < 0.2:
            environment["user.role"] = "Guest"
        rows.append(request(rng.choice(SUBJECTS), rng.choice(RESOURCES), rng.choice(ACTIONS), rng.randint(0, 23), environment))
    return rows


@pytest.mark.parametrize("seed,n,bad", [(1, 6, False), (2, 6, True), (3, 12, False), (4, 4, True)])
def test_plans_agree_with_brute_force(spark, seed, n, bad):
    rng = random.Random(seed)
    policies, rows = random_policies(rng, n, bad), random_requests(rng, 150)
    engine = Engine.over(fx.policies(spark, policies))
    df = frame(spark, rows)
    wanted = [brute.decide(r, policies) for r in rows]
    for plan in ("compiled", "joined"):
        assert answers(engine, df, plan) == wanted, plan


def test_distributed_policy_table_gives_the_same(spark, sf):
    """A set above the snapshot limit is joined without being collected or broadcast."""
    rng = random.Random(9)
    policies, rows = random_policies(rng, 10), random_requests(rng, 80)
    big = Engine(PolicySet.load(fx.policies(spark, policies), limit=3))
    assert big.policies.rows is None and not big.policies.broadcastable()
    assert answers(big, frame(spark, rows), "auto") == [brute.decide(r, policies) for r in rows]


@pytest.mark.parametrize("seed,bad", [(11, False), (12, True), (13, True)])
def test_what_if_by_changed_policies(spark, seed, bad):
    """One policy added, one removed, one changed: the others' requests are not evaluated, the counts are those of two full runs."""
    rng = random.Random(seed)
    listed, rows = random_policies(rng, 6, bad), random_requests(rng, 200)
    edited = dict(listed[2], defaultEffect="PERMIT", enabled=True, target={"resources": ["s3://b/x", "s3://a/y*"]})
    added = dict(listed[0], id="new", name="new", enabled=True, target={"subjects": ["manager_3", "a@"]})
    before = fx.policies(spark, listed)
    after = fx.policies(spark, [*listed[:2], edited, *listed[3:5], added])
    df, old = frame(spark, rows), Engine.over(before)
    decided, full = old.evaluate(df), Engine.over(after).evaluate(df)
    by_id = {r["request_id"]: (r["effect"], r["reason"]) for r in full.collect()}
    was = {r["request_id"]: r["effect"] for r in decided.collect()}
    again = {r["request_id"]: (r["effect"], r["reason"]) for r in reports.reevaluated(decided, before, after).collect()}
    assert all(by_id[i] == e for i, e in again.items())
    assert {i for i in was if was[i] != by_id[i][0]} <= set(again)
    assert {p["policy_id"] for p in reports.differing(before, after).collect()} == {"p2", "p5", "new"}
    # what is evaluated again is what the changed policies' targets meet, no more
    met = {(r["request_id"], r["policy_id"]) for e in (Engine.over(before), Engine.over(after)) for r in e.applicable(df).collect()}
    bad_ids = {i for i, (_, reason) in by_id.items() if reason.startswith("Evaluation error")}
    assert {i for i, p in met if p in ("p2", "p5", "new")} - bad_ids == set(again) - bad_ids
    wanted = Counter((was[i], by_id[i][0]) for i in was)
    counts = reports.what_if_changed(decided, before, after).collect()
    assert {(r["old_effect"], r["new_effect"]): r["requests"] for r in counts} == wanted
    # a set that stays distributed reaches the same requests
    big = Engine(PolicySet.load(reports.differing(before, after), limit=3)).reached(df)
    assert {r["request_id"] for r in big.collect()} == set(again)


def test_what_if_without_a_change(spark):
    before = fx.policies(spark)
    decided = Engine.over(before).evaluate(frame(spark, [request("hr_alice@c", BASE + "hr/e", "read"), request("a@", "x", "read")]))
    assert reports.reevaluated(decided, before, before).count() == 0
    assert {(r["old_effect"], r["new_effect"]) for r in reports.what_if_changed(decided, before, before).collect()} == {
        (e, e) for e in (r["effect"] for r in decided.collect())}
    empty = reports.what_if_changed(decided.limit(0), before, before.limit(0))
    assert empty.count() == 0


def test_changed_policies_are_found_without_a_broadcast(spark, sf):
    """The files that policies are parsed from are far smaller than they are: planned by these, a join sent a whole set through the driver."""
    before, _ = fx.supplier_policies(spark, sf)
    theirs = F.exists("resources", lambda p: p["text"].rlike("^s3://lake/n(3|7)/"))
    found = reports.differing(before, before.withColumn("enabled", F.col("enabled") & ~theirs))
    ids = Counter(r["policy_id"] for r in found.collect())
    wanted = {r["policy_id"] for r in before.filter(F.col("enabled") & theirs).collect()}
    assert wanted and ids == Counter({i: 2 for i in wanted})
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_order_and_disabled_policies(spark):
    rng = random.Random(5)
    policies, rows = random_policies(rng, 6, bad=False), random_requests(rng, 60)
    for i, p in enumerate(policies):
        p["priority"] = i  # distinct priorities
    df = frame(spark, rows)
    first = answers(Engine.over(fx.policies(spark, policies)), df, "auto")
    disabled = {"id": "d", "name": "d", "enabled": False, "priority": 99, "rules": []}
    assert answers(Engine.over(fx.policies(spark, [disabled, *policies[::-1]])), df, "auto") == first
    permit = {"id": "x", "name": "x", "enabled": True, "priority": -1,
              "rules": [{"id": "r", "name": "r", "enabled": True, "effect": "PERMIT"}]}
    more = answers(Engine.over(fx.policies(spark, [*policies, permit])), df, "auto")
    assert all(b[0] == "PERMIT" for a, b in zip(first, more, strict=True) if a[0] == "PERMIT")


def test_trace_agrees_with_decision(spark):
    rng = random.Random(7)
    policies, rows = random_policies(rng, 8, bad=False), random_requests(rng, 100)
    engine, df = Engine.over(fx.policies(spark, policies)), frame(spark, rows)
    traced = engine.evaluate(engine.trace(df)).collect()
    for row in traced:
        effects = [p["effect"] for p in row["trace"]]
        if row["reason"].startswith("Evaluation error") or row["reason"] == "No applicable policies":
            assert effects == []
        elif row["effect"] == "PERMIT":
            assert effects[-1] == "PERMIT" and "PERMIT" not in effects[:-1]
        else:
            assert "PERMIT" not in effects and ("DENY" in effects) == (row["effect"] == "DENY")
        for policy in row["trace"]:
            for rule in policy["rules"]:
                flags = [c["satisfied"] for c in rule["conditions"]]
                assert all(flags[:-1])


@pytest.mark.parametrize("seed,bad", [(21, False), (22, True)])
def test_traces_of_small_sets_are_made_where_requests_are_read(spark, seed, bad):
    """No exchange, no join; the traces are those of the joined plan, versions and broken patterns included."""
    rng = random.Random(seed)
    policies, df = fx.policies(spark, random_policies(rng, 8, bad)), frame(spark, random_requests(rng, 100))
    day = dt.datetime(2024, 1, 1)
    older = policies.withColumns({"valid_from": F.lit(day), "valid_to": F.when(F.col("policy_ord") % 2 == 0, F.lit(day + dt.timedelta(hours=60)))})
    newer = policies.filter("policy_ord % 2 = 0").withColumns(
        {"default_effect": F.lit("PERMIT"), "valid_from": F.lit(day + dt.timedelta(hours=60)), "valid_to": F.lit(None).cast("timestamp")})
    for table in (policies, older.unionByName(newer)):
        run = Engine.over(table)
        small = run.trace(df)
        text = small._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Join" not in text and "Python" not in text
        same = [sorted(map(str, t.select("request_id", "trace").collect())) for t in (small, run.trace(df, "joined"))]
        assert same[0] == same[1] and (bad or any("policy_id" in row for row in same[0]))
    nothing = Engine.over(policies.limit(0)).trace(df)
    assert nothing.filter(F.size("trace") > 0).isEmpty() and nothing.schema["trace"].dataType == small.schema["trace"].dataType


def test_hot_key_and_no_python_in_plans(spark, sf):
    """One key holding most requests collapses before the shuffle; nothing leaves the JVM."""
    rows = [request("hr_a@c", "s3://a/x/1", "read")] * 300 + [request("z@c", "s3://b/x", "write")] * 3
    engine = Engine.over(fx.policies(spark, random_policies(random.Random(1), 5)))
    df = frame(spark, rows)
    for plan in ("compiled", "joined"):
        text = engine.evaluate(df, plan)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Exchange" not in engine.evaluate(df, "compiled")._jdf.queryExecution().executedPlan().toString()


def test_custom_operator_and_directory(spark):
    from warden.functions import conditions as co

    operators = {**co.OPERATORS, "LONGER_THAN": lambda a, e: F.length(a.text) > e.num}
    policy = {"id": "p", "name": "p", "enabled": True, "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "conditions": [
            {"attributeName": "user.department", "operator": "EQUALS", "expectedValue": "Legal"},
            {"attributeName": "resource", "operator": "LONGER_THAN", "expectedValue": 4}]}]}
    directory = spark.createDataFrame([("ann", "Legal", None, 7)], "username string, department string, role string, clearance int")
    policies, errors = parse_policies(fx.policy_documents(spark, [policy]), operators=operators)
    assert errors.isEmpty() and fx.policies(spark, [policy]).isEmpty()  # unknown without being named
    engine = Engine.over(policies, at.directory_resolver(directory), operators)
    df = frame(spark, [request("ann@x", "s3://a", "read"), request("ann@x", "s3:", "read"), request("bob@x", "s3://a", "read")])
    for plan in ("compiled", "joined"):
        assert [e for e, _ in answers(engine, df, plan)] == ["PERMIT", "DENY", "DENY"]


def test_no_time_means_no_version(spark):
    policies = fx.policies(spark, [{
        "id": "v", "name": "v", "enabled": True, "rules": [{"id": "r", "name": "r", "enabled": True, "effect": "PERMIT"}]}])
    versions = policies.withColumn("valid_from", F.lit(dt.datetime(2024, 1, 1))).withColumn("valid_to", F.lit(None).cast("timestamp"))
    engine = Engine.over(versions)
    rows = [request("a", "x", "read"), request("a", "x", "read") | {"request_ts": None}, request("a", "x", "read") | {"request_ts": dt.datetime(2023, 1, 1)}]
    expected = [("PERMIT", "Access granted by policy: v")] + [("NOT_APPLICABLE", "No applicable policies")] * 2
    for plan in ("compiled", "joined"):
        assert answers(engine, frame(spark, rows), plan) == expected


def test_equality_with_absent_values(spark):
    texts = ["#user_role != 'Manager'", "#user_role == null", "!(#user_role == 'Manager')", "#user_role == 'Manager'",
             "#user_role != null", "#user_role <> 'x' && !(#user_role == 'y')"]
    policies = [{"id": f"p{i}", "name": f"p{i}", "enabled": True, "target": {"resources": [f"r{i}"]}, "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "conditions": [{"expression": t}]}]} for i, t in enumerate(texts)]
    engine = Engine.over(fx.policies(spark, policies))
    df = frame(spark, [request("nobody@x", f"r{i}", "read") for i in range(len(texts))])
    for plan in ("compiled", "joined"):
        assert [e == "PERMIT" for e, _ in answers(engine, df, plan)] == [True, True, True, False, False, True]


def test_bad_expressions_are_found_among_good_ones(spark):
    texts = ["subject == 'a'", "subject ===", "reflect('java.lang.System', 'exit')", "1 + ", "action == 'read'", "nosuch(1)"]
    policies = [{"id": f"p{i}", "name": f"p{i}", "enabled": True, "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "conditions": [{"expression": t}]}]} for i, t in enumerate(texts)]
    found = PolicySet.load(fx.policies(spark, policies))
    assert sorted(found.expressions) == sorted([texts[0], texts[4]])
    assert sorted(found.expression_errors) == sorted(texts[i] for i in (1, 2, 3, 5))


@pytest.mark.parametrize("limit", [0, None])
def test_policies_are_met_by_subject_or_action(spark, limit):
    def policy(i, target):
        return {"id": f"p{i}", "name": f"p{i}", "enabled": True, "target": target, "defaultEffect": "PERMIT", "rules": []}

    targets = [{"subjects": ["ann", "bob"]}, {"actions": ["write"]}, {"subjects": ["c*"]}, {"resources": ["s3://a/*"], "subjects": ["dan"]},
               {"actions": ["delete", "re*"], "subjects": ["eve"]}]
    policies = fx.policies(spark, [policy(i, t) for i, t in enumerate(targets)])
    engine = Engine(PolicySet.load(policies, limit=limit))
    asked = [("ann", "x", "read"), ("bob", "s3://a/b", "write"), ("cat", "y", "query"), ("dan", "s3://a/q", "query"), ("dan", "s3://b/q", "query"),
             ("eve", "x", "read"), ("eve", "x", "query"), ("fay", "x", "query")]
    df = frame(spark, [request(*a) for a in asked])
    expected = ["p0", "p0", "p2", "p3", None, "p4", None, None]
    for plan in ("compiled", "joined"):
        assert [r.removeprefix("Access granted by policy: ") if e == "PERMIT" else None for e, r in answers(engine, df, plan)] == expected


def test_plain_text_or_missing_environment(spark):
    policy = {"id": "p", "name": "p", "enabled": True, "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "conditions": [
            {"attributeName": "app", "operator": "EQUALS", "expectedValue": "nb"}, {"expression": "app == 'nb'"}]}]}
    engine = Engine.over(fx.policies(spark, [policy]))
    df = frame(spark, [request("a", "x", "read"), request("b", "x", "read")])
    text = df.withColumn("environment", F.when(F.col("subject") == "a", F.create_map(F.lit("app"), F.lit("nb"))))
    for plan in ("compiled", "joined"):
        assert [e for e, _ in answers(engine, text, plan)] == ["PERMIT", "DENY"]
        assert [e for e, _ in answers(engine, df.drop("environment"), plan)] == ["DENY", "DENY"]


INNER = ["*/pii/*", "*@x.com", "a*b.c*", "*.pdf", "s3://b/*/raw/*", "*/raw", "*[xy]/z", "lake*", "*", "*ab*", "s3://b/k", "*é/ü.*", "*a|*b"]


@pytest.mark.parametrize("limit", [None, 0])
def test_inner_text_routes_equal_brute_force(spark, limit, monkeypatch):
    """Policies met by grams, folders and by every request, as a snapshot and as a table."""
    rng = random.Random(11)
    parts = ["pii", "raw", "x", "é", "ü.d", "z", "a.pdf", "k", "abb.c", "lake"]
    rows = [
        request(rng.choice(["u", "hr_a", "é"]) + "@" + rng.choice(["x.com", "xacom", "y.org"]),
                rng.choice(["s3://b/", "lake", ""]) + "/".join(rng.choices(parts, k=rng.randrange(1, 4))), "read")
        for _ in range(150)
    ]
    policies = []
    for i in range(60):
        target = {"resources": rng.sample(INNER, rng.randrange(3)), "subjects": rng.sample(["*@x.com", "hr_*", "*a@x*", "u@y.org", "*"], rng.randrange(3))}
        policies.append({
            "id": f"p{i}", "name": f"p{i}", "enabled": True, "priority": i % 7, "target": {k: v for k, v in target.items() if v},
            "rules": [{"id": "r", "name": "r", "enabled": True, "effect": rng.choice(["PERMIT", "DENY"]), "conditions": []}],
        })
    engine = Engine(PolicySet.load(fx.policies(spark, policies), limit=limit))
    df = frame(spark, rows)
    assert answers(engine, df, "joined") == [brute.decide(r, policies) for r in rows]
    pairs = {(r.request_id, r.policy_id) for r in engine.applicable(df).select("request_id", "policy_id").collect()}
    assert engine.applicable(df).count() == len(pairs)
    assert pairs == {(i, p["id"]) for i, r in enumerate(rows) for p in policies if brute.target(r, p["target"])}
    routes = engine.policies.routed(["policy_id"])
    assert routes.filter("__route LIKE '% gram %'").count() > 0


def test_many_versions_as_of_their_time(spark):
    """Thousands of changes, requests on, between and without them: no change time enters the plan."""
    rng, base = random.Random(2), dt.datetime(2024, 1, 1)
    seconds = sorted(rng.sample(range(0, 40 * 86_400), 3000))
    one = fx.policies(spark, [{"id": "p", "name": "v", "enabled": True, "defaultEffect": "PERMIT", "rules": []}])
    starts = spark.createDataFrame([(i, base + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "i long, valid_from timestamp")
    ends = spark.createDataFrame([(i, base + dt.timedelta(seconds=s - 1)) for i, s in enumerate(seconds[1:])], "i long, valid_to timestamp")
    versions = one.drop("name", "policy_id").crossJoin(starts.join(ends, "i", "left")).withColumns(
        {"name": F.concat(F.lit("v"), "i"), "policy_id": F.concat(F.lit("p"), "i"), "policy_ord": F.col("i").cast("int")}).drop("i")
    asked = [rng.choice(seconds) + rng.choice([-1, 0, 1, 0.5]) for _ in range(150)] + [-5, 50 * 86_400]
    rows = [dict(request("u@c.com", "x", "read"), request_ts=base + dt.timedelta(seconds=s)) for s in asked]
    df = frame(spark, rows).unionByName(frame(spark, [dict(rows[0], request_ts=None)]).withColumn("request_id", F.lit(900).cast("bigint")))
    engine = Engine.over(versions)
    found = engine.evaluate(df, "joined")
    got = {r.request_id: r.reason for r in found.collect()}
    for i, s in enumerate(asked):
        live = [n for n, t in enumerate(seconds) if t <= s and (n + 1 == len(seconds) or s < seconds[n + 1] - 1)]
        assert got[i] == (f"Access granted by policy: v{live[0]}" if live else "No applicable policies"), s
    assert got[900] == "No applicable policies"
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_only_routes_that_policies_are_met_on(spark, sf):
    """A distributed set told apart by subject alone: a request looks for its subject, not for hundreds of grams."""
    engine = Engine(PolicySet.load(fx.subject_policies(spark, sf), limit=0))
    routes = engine.policies.routes_of(F.col("resource"), F.col("action"), F.col("subject"))
    found = fx.requests(spark, sf).limit(20).select("subject", routes.alias("r")).collect()
    assert [r.r for r in found] == [[f"subject {r.subject}"] for r in found]
    folders = PolicySet.load(fx.supplier_policies(spark, sf)[0], limit=0)
    found = fx.folder_requests(spark, sf).limit(20).select("resource", folders.routes_of(F.col("resource"), F.col("action"), F.col("subject")).alias("r"))
    assert all(r.r == ["resource " + "/".join(r.resource.split("/")[:4]) + "/"] for r in found.collect())


def test_policies_are_dealt_out_before_they_are_parsed(spark, sf):
    plan = fx.subject_policies(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan[plan.index("RepartitionByExpression"):] and "from_json" in plan


@pytest.mark.parametrize("limit", [None, 0])
def test_word_routes_equal_brute_force(spark, limit):
    """Words that a pattern holds whole are routes; words that run on behind a star or a dot are none."""
    rng = random.Random(5)
    listed = ["*/u1/*", "*/u12/*", "*/u1*", "s3://b/u1*", "*.u1", "*/u.2/*", "u1*", "*_u1/x", "*u1", "*/é1/*"]
    values = ["s3://b/u1/x", "s3://b/u12/x", "s3://b/u13", "s3://b/k_u1/x", "a.u1", "axu1", "q/u.2/r", "q/ux2/r", "u1", "u12", "z/é1/y", "u1/u12/u1/"]
    policies = [{
        "id": f"p{i}", "name": f"p{i}", "enabled": True, "priority": i % 5,
        "target": rng.choice([{"resources": rng.sample(listed, 2)}, {"subjects": rng.sample(listed, 2)}, {"resources": rng.sample(listed, 1), "subjects": rng.sample(listed, 3)}]),
        "rules": [{"id": "r", "name": "r", "enabled": True, "effect": rng.choice(["PERMIT", "DENY"]), "conditions": []}],
    } for i in range(40)]
    rows = [request(rng.choice(values) + "@c.com" * rng.randrange(2), rng.choice(values), "read") for _ in range(120)]
    engine, df = Engine(PolicySet.load(fx.policies(spark, policies), limit=limit)), frame(spark, rows)
    assert answers(engine, df, "joined") == [brute.decide(r, policies) for r in rows]
    pairs = Counter((r.request_id, r.policy_id) for r in engine.applicable(df).select("request_id", "policy_id").collect())
    assert pairs == {(i, p["id"]): 1 for i, r in enumerate(rows) for p in policies if brute.target(r, p["target"])}
    routes = {r[0] for r in engine.policies.routed(["policy_id"]).select("__route").collect()}
    assert "by gram of resource wu12" in routes and "by gram of resource wu2" not in routes


def test_inner_policies_meet_few_keys(spark, sf):
    """Policies by a number inside a path: a number's policy is met by its own word, not by four digits that many share."""
    policies = PolicySet.load(fx.inner_policies(spark, sf), limit=0)
    met = policies.routed(["policy_id"]).groupBy("__route").count().agg(F.max("count")).first()[0]
    assert met == 1 and policies.kinds == {("by gram of resource ", "w"), ("by gram of subject ", "w")}


def test_crowded_routes_are_dealt_into_parts(spark, sf, monkeypatch):
    """Few keys meet many policies on one route: the same decisions, the pairs in more tasks than there are routes."""
    policies, asked = fx.supplier_policies(spark, "/root/testdata/sf0.01")[0], fx.folder_requests(spark, sf)
    whole = Engine(PolicySet.load(policies)).evaluate(asked, "joined").select("request_id", "effect", "reason")
    monkeypatch.setattr("warden.operators.policyset.CROWD", 2)
    engine = Engine(PolicySet.load(policies, limit=0))
    dealt = engine.evaluate(asked, "joined").select("request_id", "effect", "reason")
    assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, whole.collect()))
    assert "__part" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_large_sets_are_not_broadcast_whole(spark, sf):
    """However small their files are: policies take many times as much in memory."""
    policies, requests = fx.supplier_policies(spark, sf)[0], fx.folder_requests(spark, sf)
    engine = Engine(PolicySet.load(policies, limit=0))
    plan = engine.evaluate(requests)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__route" in plan and "SortMergeJoin [__rank" in plan


def test_routes_by_grams_are_found_without_a_broadcast(spark, sf):
    """However small the files of a large set are: its patterns have many grams each. The routes are those of a snapshot."""
    inner = fx.inner_policies(spark, sf)
    large = PolicySet.load(inner, limit=0)
    found = large._by_grams(large._without_grams()).select("policy_id", F.array_sort("__routes").alias("r"))
    rows = found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    small = PolicySet.load(inner, limit=1 << 30)._routes.select("policy_id", F.array_sort("__routes").alias("r")).collect()
    assert len(rows) > 100 and sorted(map(tuple, rows)) == sorted(map(tuple, small))
