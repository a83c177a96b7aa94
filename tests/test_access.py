import datetime as dt
import random
import json

import pytest
from pyspark.sql import functions as F

from warden.functions import paths as pt
from warden.operators import grants as gr
from warden.operators import namespaces as ns
from warden.operators.evaluate import Engine
from warden.plans import fixtures as fx
from warden.sources import audit, secured
from warden.sources.secured import Principal


def user(namespace, account):
    return f"system:serviceaccount:{namespace}:{account}"


GOLDEN = [
    (user("teama", "x"), "read", "s3://bucket/teama/f", True),
    (user("teama", "x"), "read", "s3://bucket/teamb/f", False),
    (user("teama", "spark-driver"), "write", "s3://bucket/teama/f", True),
    (user("teama", "notebook"), "write", "s3://bucket/teama/f", False),
    (user("teamb", "spark-admin"), "delete", "s3://bucket/teama/f", True),
    ("anyone", "read", "s3://shared-bucket/f", True),
    ("anyone", "read", "s3://public-datasets/f", True),
    (user("teama", "x"), "read", "s3://bucket", False),
    (user("teama", "x"), "read", "abfs://c@h/teama/f", True),
    ("", "read", "https://acct.blob.core.windows.net/c/f", True),
]


def test_namespace_golden(spark):
    df = spark.createDataFrame([g[:3] for g in GOLDEN], "username string, operation string, path string")
    rules = ns.NamespaceRules.load(ns.standard_rules(spark))
    found = {(r["username"], r["operation"], r["path"]): r["allowed"] for r in rules.check(df).collect()}
    assert found == {g[:3]: g[3] for g in GOLDEN}


def test_no_rule_sets_allow_with_a_warning(spark):
    with pytest.warns(UserWarning):
        rules = ns.NamespaceRules.load(ns.standard_rules(spark).limit(0))
    df = spark.createDataFrame([("u", "write", "x")], "username string, operation string, path string")
    assert rules.check(df).first()["allowed"]
    closed = ns.NamespaceRules.load(ns.standard_rules(spark).limit(0), allow_when_empty=False)
    assert not closed.check(df).first()["allowed"]


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"rule_id": "r1", "operation": "read", "match": "prefix", "prefix": "s3://x/"},
        {"rule_id": "r2", "operation": "read", "match": "sometimes"}]))
    (tmp_path / "b.json").write_text("{oops")
    rules, errors = ns.read_rules(spark, str(tmp_path))
    assert [r["rule_id"] for r in rules.collect()] == ["r1"] and errors.count() == 2
    assert [r["rule_set"] for r in ns.list_rule_sets(rules).collect()] == ["a"]


def test_move_needs_three_grants(spark):
    everything = spark.createDataFrame(
        [("s", op, op, "any", None, None) for op in ("read", "write", "delete")], ns.RULES)
    moves = spark.createDataFrame(
        [(1, "u", "s3://b/1", "s3://b/9"), (2, "u", "s3://b/1", "s3://b/2"), (3, "u", "s3://b/7", "s3://b/8")],
        "request_id long, username string, src string, dst string")
    stock = spark.createDataFrame([("s3://b/1",), ("s3://b/2",)], "path string")
    plan = gr.plan_moves(moves, stock, ns.NamespaceRules.load(everything))
    assert {r["dst"]: r["outcome"] for r in plan.collect()} == {
        "s3://b/9": "move", "s3://b/2": "target exists", "s3://b/8": "source does not exist"}
    fewer = ns.NamespaceRules.load(everything.filter("operation <> 'delete'"))
    assert gr.plan_moves(moves, stock, fewer).filter("outcome = 'move'").count() == 0


def test_settled_moves_can_be_made_in_their_steps(spark):
    """Steps made in order never write over a path; what is refused waits for a path that stays, or in a circle."""
    rng = random.Random(4)
    stock = set(range(60))
    wanted = [(i, rng.randrange(60), rng.randrange(90)) for i in range(90)] + [(200 + i, 300 + i, 301 + i) for i in range(40)]
    stock |= set(range(300, 340))
    wanted = [w for w in wanted if w[1] != w[2]]
    df = spark.createDataFrame([(i, f"p{a}", f"p{b}", b in stock) for i, a, b in wanted], "id long, src string, dst string, dst_exists boolean")
    found = {r["id"]: r for r in gr.settle_moves(df).collect()}
    assert set(found) == {w[0] for w in wanted}
    made = sorted((found[i]["step"], i, a, b) for i, a, b in wanted if found[i]["outcome"] == "move")
    assert len({m[2] for m in made}) == len({m[3] for m in made}) == len(made) and made[-1][0] == 40
    now = set(stock)
    for _, _, a, b in made:
        assert a in now and b not in now
        now = now - {a} | {b}
    source = {a for i, a, b in wanted}
    first = {}
    for i, a, b in sorted(wanted):
        if b not in stock or b in source:
            first.setdefault(a, (i, b))
    target = {}
    for a, (i, b) in sorted(first.items(), key=lambda x: x[1]):
        target.setdefault(b, (i, a))
    waits = {a: b for b, (i, a) in target.items()}
    for b, (i, a) in target.items():
        seen, at = {a}, b
        while at in waits and at not in seen:
            seen.add(at)
            at = waits[at]
        want = "cycle" if at in seen else ("target exists" if at in stock else "move")
        assert found[i]["outcome"] == want, (i, a, b)


def test_covering_grant_prefers_the_one_that_lasts(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    grants = spark.createDataFrame([(1, "p", "read", t(0), t(9)), (2, "p", "read", t(1), t(2)), (3, "p", "write", t(0), t(9))],
                                   "request_id long, path string, operation string, issued_at timestamp, expires_at timestamp")
    accesses = spark.createDataFrame([(10, "p", "read", t(0)), (11, "p", "read", t(5)), (12, "p", "read", t(10)), (13, "q", "read", t(5))],
                                     "request_id long, path string, operation string, request_ts timestamp")
    found = gr.covering_grant(accesses, grants).orderBy("request_id").collect()
    assert [(r["granted"], r["grant_id"]) for r in found] == [(True, 1), (True, 1), (False, None), (False, None)]


def test_object_reference_and_url(spark):
    paths = ["s3://b/k/x?y", "abfs://c@acct.dfs.core.windows.net/d/f", "abfs://c", "https://acct.blob.core.windows.net/c/d/f", "ftp://x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(pt.object_reference(F.col("p")).alias("r")).select("r.*")
    assert [tuple(r) for r in df.collect()] == [
        (None, "b", "k/x", None), ("acct", "c", "d/f", None), (None, None, None, "invalid ABFS host format"),
        ("acct", "c", "d/f", None), (None, None, None, "unsupported storage path: ftp://x")]


# --- secured reads and writes ---------------------------------------------------

def open_to(subject, actions):
    return {"id": "p", "name": "p", "enabled": True, "defaultEffect": "DENY", "target": {"subjects": [subject]},
            "rules": [{"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "target": {"actions": actions}}]}


def test_secured_read_and_write(spark, tmp_path):
    engine = Engine.over(fx.policies(spark, [open_to("writer", ["read", "write"]), open_to("reader", ["read"])]))
    path = str(tmp_path / "t")
    with pytest.raises(PermissionError, match="Write access denied to resource '.*' for user 'reader' in session 's'"):
        secured.write_secured(spark.range(3), engine, path, principal=Principal("reader", "s"))
    secured.write_secured(spark.range(3), engine, path, principal=Principal("writer", "s"))
    assert secured.read_secured(spark, engine, path, principal=Principal("reader", "s")).count() == 3
    with pytest.raises(PermissionError, match="for user 'unknown' in session 'unknown'. Reason: No applicable policies"):
        secured.read_secured(spark, engine, path)


def test_what_is_opened_is_checked(spark, tmp_path):
    for name in ("hr", "fin"):
        spark.range(5).write.parquet(str(tmp_path / name / "f"))
    policy = open_to("ann", ["read", "write"])
    policy["target"]["resources"] = [f"{tmp_path}/hr/*"]
    engine, ann = Engine.over(fx.policies(spark, [policy])), Principal("ann", "s")
    assert secured.read_secured(spark, engine, f"{tmp_path}/fin/../hr/./f", principal=ann).count() == 5
    for path in ("hr/../fin/f", "hr/{f,../fin/f}", "hr/*/../../fin/f", "fin/f"):
        with pytest.raises(PermissionError):
            secured.read_secured(spark, engine, f"{tmp_path}/{path}", principal=ann)
    with pytest.raises(PermissionError):
        secured.write_secured(spark.range(1), engine, f"{tmp_path}/hr/../fin/new", principal=ann)
    assert not (tmp_path / "fin" / "new").exists()
    with pytest.raises(PermissionError, match="above its root"):
        secured.normalised(spark, "/../x")


def test_common_table_expressions_are_looked_into(spark, tmp_path):
    for name in ("open", "closed"):
        spark.range(5).write.parquet(str(tmp_path / name))
    policy = open_to("ann", ["read"])
    policy["target"]["resources"] = ["*/open"]
    engine, ann = Engine.over(fx.policies(spark, [policy])), Principal("ann", "s")
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in ("open", "closed"))
    twice = "WITH c AS (SELECT id + rand() AS id FROM {a}) SELECT count(*) FROM c WHERE id > (SELECT min(id) FROM c)"
    inner = "SELECT * FROM {a} WHERE id IN (WITH c AS (SELECT id FROM {b}), d AS (SELECT * FROM c) SELECT id FROM d)"
    assert secured.authorize(spark.sql(twice, a=a), engine, ann).count() == 1
    assert secured.authorize(spark.sql(inner, a=a, b=a), engine, ann).count() == 5
    for query in (spark.sql(twice, a=b), spark.sql(inner, a=a, b=b)):
        with pytest.raises(PermissionError):
            secured.authorize(query, engine, ann)


def test_sessions_are_isolated(spark, tmp_path):
    engine = Engine.over(fx.policies(spark, [open_to("ann", ["read"])]))
    spark.range(2).write.parquet(str(tmp_path / "t"))
    one, two = spark.newSession(), spark.newSession()
    one.conf.set("spark.abac.user.id", "ann")
    two.conf.set("spark.abac.user.id", "bob")
    assert secured.read_secured(one, engine, str(tmp_path / "t")).count() == 2
    with pytest.raises(PermissionError):
        secured.read_secured(two, engine, str(tmp_path / "t"))


def test_authorize_looks_into_subqueries_and_refuses_the_unknown(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "open"))
    spark.range(5).write.parquet(str(tmp_path / "closed"))
    policy = open_to("ann", ["read"])
    policy["target"]["resources"] = ["*/open"]
    engine, ann = Engine.over(fx.policies(spark, [policy])), Principal("ann", "s")
    allowed, hidden = spark.read.parquet(str(tmp_path / "open")), spark.read.parquet(str(tmp_path / "closed"))
    assert secured.authorize(allowed.join(spark.range(3), "id"), engine, ann).count() == 3
    inside = spark.sql("SELECT * FROM {a} WHERE id > (SELECT min(id) FROM {b})", a=allowed, b=hidden)
    for query in (inside, allowed.union(hidden), hidden.filter(F.lit(False))):
        with pytest.raises(PermissionError):
            secured.authorize(query, engine, ann)
    with pytest.raises(PermissionError, match="cannot tell"):
        secured.authorize(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int"), engine, ann)


def test_granted_paths(spark, tmp_path):
    rules = ns.NamespaceRules.load(ns.standard_rules(spark))
    here = lambda path: path.replace("s3://", f"{tmp_path}/")
    driver = user("teama", "spark-driver")
    secured.write_granted(spark.range(4), rules, driver, "sas://b/teama/t", locate=here)
    assert secured.read_granted(spark, rules, driver, "sas://b/teama/t", locate=here).count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        secured.write_granted(spark.range(4), rules, driver, "sas://b/teama/t", locate=here)
    with pytest.raises(PermissionError):
        secured.read_granted(spark, rules, user("teamb", "x"), "sas://b/teama/t", locate=here)
    secured.write_granted(spark.range(4), rules, user("teamb", "spark-driver"), "sas://b/teamb/x", locate=here)
    for path in ("teama/../teamb/x", "teama/./../teamb/x", "teama/{t,../teamb/x}", "../c/x"):
        with pytest.raises(PermissionError):
            secured.read_granted(spark, rules, driver, f"sas://b/{path}", locate=here)
    assert secured.read_granted(spark, rules, driver, "sas://b/teamb/../teama/t", locate=here).count() == 4


def test_audit_lines(spark, sf, tmp_path):
    engine, requests = Engine.over(fx.policies(spark)), fx.requests(spark, sf).limit(50)
    decided = engine.evaluate(engine.trace(requests))
    audit.write_audit(decided, str(tmp_path / "audit"))
    back = spark.read.json(str(tmp_path / "audit"))
    assert back.count() == 50 and "date" in back.columns
    line = json.loads(audit.audit_lines(decided.filter("effect = 'PERMIT'")).first()["line"])
    assert line["event"] == "ACCESS_GRANTED" and line["policy_evaluated"]


def test_columns_that_a_query_uses(spark, tmp_path):
    """Result, filter, join, order, group, set operation, subquery and window count; what is dropped does not."""
    people, teams = str(tmp_path / "people"), str(tmp_path / "teams")
    spark.createDataFrame([(1, "x", 5.0, "t")], "id long, name string, pay double, team string").write.partitionBy("team").parquet(people)
    spark.createDataFrame([("t", "boss")], "team string, head string").write.parquet(teams)
    spark.read.parquet(people).createOrReplaceTempView("people")
    spark.read.parquet(teams).createOrReplaceTempView("teams")

    def used(query):
        return {f"{path.rsplit('/', 1)[1]}.{c}" for path, _, c in secured.columns_of(query if not isinstance(query, str) else spark.sql(query))}

    assert used("SELECT id FROM (SELECT * FROM people)") == {"people.id"}
    assert used("SELECT id FROM people WHERE pay > 1") == {"people.id", "people.pay"}
    assert used("SELECT id FROM people WHERE team = 't'") == {"people.id", "people.team"}
    assert used("SELECT count(*) FROM people") == set()
    assert used("SELECT name AS n FROM people ORDER BY pay") == {"people.name", "people.pay"}
    assert used("SELECT count(*) FROM people GROUP BY upper(name)") == {"people.name"}
    assert used("SELECT head FROM people JOIN teams USING (team)") == {"people.team", "teams.team", "teams.head"}
    assert used("SELECT id FROM people WHERE EXISTS (SELECT 1 FROM teams WHERE teams.team = people.team AND head > '')") == {
        "people.id", "people.team", "teams.team", "teams.head"}
    assert used("SELECT id FROM people WHERE pay > (SELECT length(max(head)) FROM teams)") == {"people.id", "people.pay", "teams.head"}
    assert used("SELECT team FROM teams UNION SELECT name FROM people") == {"teams.team", "people.name"}
    assert used("SELECT * FROM teams UNION ALL SELECT team, name FROM people") == {
        "teams.team", "teams.head", "people.team", "people.name"}
    assert used("WITH a AS (SELECT * FROM people) SELECT x.id FROM a x JOIN a y ON x.id = y.id WHERE y.pay > rand()") == {"people.id", "people.pay"}
    assert used("SELECT id, sum(pay) OVER (PARTITION BY name) s FROM people") == {"people.id", "people.pay", "people.name"}
    assert used("SELECT id FROM (SELECT id, sum(pay) OVER (PARTITION BY name) s FROM people)") == {"people.id"}
    assert used(spark.table("people").dropDuplicates(["name"]).select("id")) == {"people.id", "people.name"}
    assert used(spark.table("people").exceptAll(spark.table("people").filter("id > 3")).select("id")) >= {"people.id", "people.pay"}
    cached = spark.table("people").cache()
    assert used(cached.filter("pay > 1").select("id")) == {"people.id", "people.pay"}
    cached.unpersist()
    python = spark.table("people").mapInPandas(lambda frames: frames, "id long, name string, pay double, team string").select("id")
    assert used(python) == {"people.id", "people.name", "people.pay", "people.team"}
    # The gate: files by path, columns by path#column; the first refused column is named.
    policy = {"id": "p", "name": "p", "enabled": True, "defaultEffect": "DENY", "rules": [
        {"id": "r", "name": "r", "enabled": True, "effect": "PERMIT", "target": {"resources": ["*/people", "*#id", "*#name"]}}]}
    engine, ann = Engine.over(fx.policies(spark, [policy])), Principal("u", "s")
    assert secured.authorize_columns(spark.sql("SELECT id FROM people WHERE name > ''"), engine, ann).count() == 1
    with pytest.raises(PermissionError, match="people#pay"):
        secured.authorize_columns(spark.sql("SELECT id FROM people WHERE pay > 1"), engine, ann)
    with pytest.raises(PermissionError, match="teams"):
        secured.authorize_columns(spark.sql("SELECT id FROM people JOIN teams USING (team)"), engine, ann)
    with pytest.raises(PermissionError, match="cannot tell"):
        secured.columns_of(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a long"))
