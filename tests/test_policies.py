import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from warden.functions import conditions as co
from warden.functions import expressions as ex
from warden.functions import patterns as pa
from warden.operators.evaluate import Engine
from warden.operators.policyset import PolicySet
from warden.plans import fixtures as fx
from warden.sources import policies as ps
from warden.sources.store import Conflict, Refreshed, VersionedStore


def write(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_read_defaults_order_and_errors(spark, tmp_path):
    write(tmp_path, "a.json", fx.POLICY_1)
    write(tmp_path, "b.json", [fx.POLICY_3, {"id": "x", "name": "n"}, fx.POLICY_4])
    write(tmp_path, "c.json", "[{not json")
    write(tmp_path, "d.json", [{"id": "m", "name": "m", "rules": [{"id": "r", "name": "r", "effect": "MAYBE"}]},
                               {"id": "o", "name": "o", "rules": [], "priority": "high"}])
    good, bad = ps.read_policies(spark, str(tmp_path))
    rows = good.orderBy("policy_ord").collect()
    assert [(r["policy_ord"], r["policy_id"]) for r in rows] == [(0, "staff-folders"), (1, "internal-by-day"), (3, "policy-004")]
    assert rows[2]["version"] == "1.0" and rows[2]["default_effect"] == "DENY" and rows[2]["rules"][0]["conditions"] is None
    problems = {r["policy_ord"]: list(r["errors"]) for r in bad.collect()}
    assert problems[2] == ["Policy rules cannot be null"]
    assert "malformed JSON" in problems[4]
    assert problems[5] == ["Rule effect not known"] and problems[6] == ["Priority is not a number"]


def test_refresh_sees_new_policies(spark, tmp_path):
    write(tmp_path, "a.json", [fx.POLICY_1])
    assert ps.read_policies(spark, str(tmp_path))[0].count() == 1
    write(tmp_path, "b.json", [fx.POLICY_4])
    assert ps.read_policies(spark, str(tmp_path))[0].count() == 2


def test_store_is_read_only_unless_opened_for_writing(spark):
    store = ps.PolicyStore(fx.policies(spark))
    with pytest.raises(PermissionError):
        store.delete(spark.createDataFrame([("staff-folders",)], "policy_id string"))
    assert store.get("nothing").count() == 0
    changed = ps.PolicyStore(fx.policies(spark), writable=True).upsert(
        fx.policies(spark, [{**fx.POLICY_2, "name": "new"}, {**fx.POLICY_4, "id": "policy-100"}]))
    rows = {r["policy_id"]: (r["policy_ord"], r["name"]) for r in changed.all().collect()}
    assert rows["ledger-staff"] == (1, "new") and rows["policy-100"][0] >= 6 and len(rows) == 7


def test_export_and_import(spark, tmp_path):
    before = fx.policies(spark)
    ps.export_policies(before, str(tmp_path / "out"))
    after = ps.import_policies(spark, str(tmp_path / "out"))
    columns = ["policy_ord", "policy_id", "priority", "enabled", "rules"]
    assert before.select(columns).orderBy("policy_ord").collect() == after.select(columns).orderBy("policy_ord").collect()


def test_values_keep_their_kind(spark):
    values = ['"3"', "3", "3.0", "99999999999", "true", '["a", 1]', "null", '{"k": 1}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", co.from_variant(F.parse_json("v")).alias("e")).orderBy("i").collect()
    assert [(r["e"]["kind"], r["e"]["text"]) for r in rows[:6]] == [
        ("string", "3"), ("int", "3"), ("double", "3.0"), ("long", "99999999999"), ("bool", "true"), ("list", "[a, 1]")]
    assert rows[6]["e"]["kind"] is None and rows[7]["e"]["kind"] == "object"


@pytest.mark.parametrize("pattern,kind,lead", [
    ("*", "any", ""), ("abc", "literal", "abc"), ("s3://a/*", "prefix", "s3://a/"), ("a.b*", "regex", "a"),
    ("ab?*", "regex", "a"), ("a|b*", "regex", ""), ("s3://*/x/*", "regex", "s3://"), ("a**", "prefix", "a")])
def test_pattern_kinds(spark, pattern, kind, lead):
    row = spark.range(1).select(pa.classify(F.lit(pattern)).alias("p")).first()["p"]
    assert (row["kind"], row["lead"]) == (kind, lead)


def test_wildcard_covers_the_whole_value(spark):
    cases = [("s3://a/b", "s3://a/*", True), ("s3://a/\nb", "s3://a/*", False), ("x\n", "x*", False), ("ab", "a", False),
             ("axb", "a.b*", True), ("ab\n", "*b", False)]
    df = spark.createDataFrame(cases, "v string, p string, w boolean")
    assert df.filter(pa.wildcard_match(F.col("v"), F.col("p")) != F.col("w")).count() == 0


def test_compilable_finds_the_bad_ones(spark):
    texts = [f"a{i}" for i in range(30)] + ["(", "[", "x*"]
    assert [t for t, ok in pa.compilable(spark, texts).items() if not ok] == ["(", "["]


@pytest.mark.parametrize("text", ["reflect('java.lang.Runtime', 'x')", "java_method('a', 'b')", "raise_error('x')", "input_file_name() = 'x'"])
def test_expressions_may_not_call_out(text):
    with pytest.raises(ex.RefusedExpression):
        ex.to_sql(text)


def test_expression_text_inside_quotes_is_kept():
    sql, names = ex.to_sql("user.department == 'a && user.x' || #resource_type = \"s3\"")
    assert "'a && user.x'" in sql and names == {"user_department", "resource_type"}


def test_as_of(spark):
    versions = ps.with_validity(fx.policies(spark, fx.POLICY_3_VERSIONS))
    at = lambda day: [r["version"] for r in ps.as_of(versions, F.lit(day).cast("timestamp")).collect()]
    assert (at("2023-12-31"), at("2024-01-01"), at("2024-01-15"), at("2024-02-01")) == ([], ["1.0"], ["2.0"], ["3.0"])


# --- the store that lasts -------------------------------------------------------

def test_store_keeps_every_commit_and_refuses_late_writers(spark, tmp_path):
    path = str(tmp_path / "store")
    first, late = VersionedStore(spark, path), VersionedStore(spark, path)
    assert first.latest() == 0 and first.read().count() == 0
    assert first.commit(fx.policies(spark), 0, "import") == 1
    assert late.delete(fx.policies(spark).limit(1), parent=1, author="x") == 2
    with pytest.raises(Conflict):
        first.set_enabled(fx.POLICY_4["id"], False, parent=1)
    # a writer that did not see the other commit is refused by the file itself
    first.latest = lambda: 1
    with pytest.raises(Conflict):
        first.commit(fx.policies(spark), 1, "stale")
    del first.latest
    assert first.rollback(1) == 3 and VersionedStore(spark, path).read().count() == fx.policies(spark).count()
    assert [VersionedStore(spark, path).read(n).count() for n in (1, 2, 3)] == [6, 5, 6]
    assert {r["change"] for r in first.changes(1, 2).collect()} == {"removed"} and first.changes(1, 3).count() == 0
    assert [(r["commit"], r["parent"], r["author"]) for r in first.history().orderBy("commit").collect()] == [(1, 0, ""), (2, 1, "x"), (3, 2, "")]
    first.rollback(2, at=dt.datetime(2999, 1, 1))
    assert first.commit_before(dt.datetime(2998, 1, 1)) == 3 and first.commit_before(dt.datetime(2000, 1, 1)) == 0
    with pytest.raises(LookupError):
        first.read(99)


def test_refreshed_engine_prepares_changes_alone(spark, tmp_path, sf, monkeypatch):
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.commit(fx.policies(spark), 0, "import")
    live, requests = Refreshed(store), fx.requests(spark, sf).limit(300)
    loads = []
    load = PolicySet.load.__func__
    monkeypatch.setattr(PolicySet, "load", classmethod(lambda cls, p, *a, **k: loads.append(p.count()) or load(cls, p, *a, **k)))
    for edit in (None, lambda: store.set_enabled(fx.POLICY_1["id"], False), None, lambda: store.upsert(fx.policies(spark, [fx.POLICY_1])),
                 lambda: store.delete(fx.policies(spark, [fx.POLICY_2])), lambda: store.rollback(1)):
        if edit is not None:
            edit()
        got = live.engine().evaluate(requests).select("request_id", "effect", "reason")
        want = Engine(load(PolicySet, store.read())).evaluate(requests).select("request_id", "effect", "reason")
        assert sorted(got.collect()) == sorted(want.collect())
    # going back, the policy that was put in again differs by its times
    assert live.prepared == 5 and loads == [6, 1, 1, 0, 2]

