"""Policy evaluation: requests in, decisions out.

Two plans give the same answers.

*Compiled* turns a small policy set into column expressions.  Each request is
decided where it is read: no shuffle, no join, so skew and key counts do not
matter.

*Joined* serves larger sets.  Requests are reduced to distinct decision keys
(partial aggregation collapses hot keys before the shuffle), keys meet the
policies that can match them by a hash join on the most selective facet of each
policy's target, and the decisions are joined back.  The second aggregation
reuses the partitioning of the first, so policies cost no further exchange.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warden import schemas
from warden.functions import attributes as at
from warden.functions import conditions as co
from warden.functions import patterns as pa
from warden.functions.expressions import with_expressions
from warden.operators import policyset as ps
from warden.operators.policyset import PolicySet, effect_code
from warden.operators.sequences import bucket_of, micros

# Policies, rules, patterns and conditions up to which the compiled plan is used
# by default.  Both plans give the same answers; only the time differs.
COMPILED_TERMS = 300

# Requests are given the last policy change before them by buckets of this many microseconds.
EPOCH_BUCKET = 3600 * 1_000_000
NO_EPOCH = -(2**63)

# Texts of decisions.
NO_POLICIES = "No applicable policies"
NO_RULES = "No rules matched"
GRANTED = "Access granted by policy: "
DENIED = "Access denied by policy: "
ERROR = "Evaluation error: "
_BAD_PATTERN = "invalid target pattern"

_SUBJECT, _RESOURCE, _ACTION = "__subject", "__resource", "__action"


def request_error(df: DataFrame) -> Column:
    """Message of a request that cannot be evaluated, else NULL."""
    return F.coalesce(
        F.when(F.col("subject").isNull(), F.lit("Subject cannot be null")),
        F.when(F.col("resource").isNull(), F.lit("Resource cannot be null")),
        F.when(F.col("action").isNull(), F.lit("Action cannot be null")),
        at.subject_error(F.col("subject")),
    )


@dataclass(frozen=True)
class _Key:
    """Columns two requests must share to get the same decision."""

    context: dict[str, str]  # attribute name -> key column, for what varies per request
    versioned: bool  # whether policies have times at which they start and end

    @property
    def columns(self) -> list[str]:
        moments = ["__epoch"] if self.versioned else []
        return [_SUBJECT, _RESOURCE, _ACTION, "__flags", *moments, *self.context.values()]

    def in_force(self, valid_from: Column, valid_to: Column) -> Column:
        """Whether the key's epoch starts within a version's validity."""
        start = F.col("__epoch")
        during = (start >= micros(valid_from)) & (valid_to.isNull() | (start < micros(valid_to)))
        return F.coalesce((start != NO_EPOCH) & during, F.lit(False))


@dataclass
class Engine:
    """Evaluates request tables or micro-batches against a policy set."""

    policies: PolicySet
    operators: Mapping[str, co.Operator] = None

    def __post_init__(self):
        self.operators = self.operators or co.OPERATORS

    @classmethod
    def over(
        cls,
        policies: DataFrame,
        resolver: at.Resolver | None = None,
        operators: Mapping[str, co.Operator] | None = None,
    ) -> Engine:
        """Engine over a policy table (optionally with ``valid_from/valid_to``)."""
        return cls(PolicySet.load(policies, resolver), operators)

    # --- public ---------------------------------------------------------------

    def evaluate(self, requests: DataFrame, plan: str = "auto") -> DataFrame:
        """Requests with ``effect, reason, permitted`` added.

        A policy set that stays distributed is always joined, whatever ``plan``.
        """
        if plan == "auto":
            plan = "compiled" if self.policies.terms <= COMPILED_TERMS else "joined"
        if self.policies.rows is None:
            plan = "joined"
        decided = {"compiled": self._compiled, "joined": self._joined}[plan](requests)
        return decided.withColumn("permitted", F.col("effect") == schemas.PERMIT)

    def trace(self, requests: DataFrame, plan: str = "auto") -> DataFrame:
        """Requests with ``trace``: what was visited, policy by policy.

        Plans are chosen as for decisions.
        """
        policies = self.policies
        small = policies.rows is not None and (plan == "compiled" or plan == "auto" and policies.terms <= COMPILED_TERMS)
        return self._compiled_trace(requests) if small else self._joined_trace(requests)

    def _joined_trace(self, requests: DataFrame) -> DataFrame:
        keyed, dk = self._keyed(requests)
        steps = self._key_policies(self._keys(keyed, dk), dk, self._trace_columns)
        key = dk.columns
        stop = F.min(F.when(F.col("code").isin(ps.PERMIT, ps.RULE_ERROR), F.col("rank")))
        visited = F.array_sort(
            F.collect_list(F.when(F.col("state") == 1, F.struct("rank", "step")))  # at most the policy count
        )
        traces = steps.groupBy(*key).agg(stop.alias("stop"), visited.alias("steps"),
                                         F.max("code").alias("worst"))
        kept = F.filter("steps", lambda s: F.col("stop").isNull() | (s["rank"] <= F.col("stop")))
        failed = (F.col("worst") == ps.TARGET_ERROR) | F.exists(
            kept, lambda s: s["step"]["effect"].isNull()
        )
        traces = traces.select(*key, F.when(failed, F.array()).otherwise(F.transform(kept, lambda s: s["step"])).alias("trace"))
        joined = keyed.join(traces, key, "left")
        empty = F.array().cast(traces.schema["trace"].dataType)
        return joined.select(*requests.columns, F.coalesce("trace", empty).alias("trace"))

    def applicable(self, requests: DataFrame) -> DataFrame:
        """``(request columns, policy_id)`` for every policy whose target matches."""
        keyed, dk = self._keyed(requests)
        pairs = self._key_policies(self._keys(keyed, dk), dk, lambda df: [F.col("policy_id")])
        pairs = pairs.filter(F.col("state") == 1).select(*dk.columns, "policy_id")
        return keyed.join(pairs, dk.columns).select(*requests.columns, "policy_id")

    def reached(self, requests: DataFrame) -> DataFrame:
        """Requests that the target of some policy matches, or fails on, at whatever time the policy is in force.

        No other request can be decided differently because of these policies.
        """
        policies = self.policies
        if policies.rows is None or policies.terms > COMPILED_TERMS:
            keyed, dk = self._keyed(requests)
            met = self._key_policies(self._keys(keyed, dk), dk, lambda df: []).select(*dk.columns).distinct()
            return keyed.join(met, dk.columns, "left_semi").select(*requests.columns)
        plain = {f"__{c}_plain": pa.single_line(F.col(c)) for c in ("resource", "action", "subject")}
        terms, met = _Terms(self, {}), F.lit(False)
        for match, fails in map(terms.target, policies.rows):
            met = met | match if fails is None else met | match | fails
        df = requests.withColumns(plain).withColumn("__bad", request_error(requests).isNotNull())
        return df.filter(~F.col("__bad") & met).select(*requests.columns)

    # --- compiled plan ----------------------------------------------------------

    def _compiled(self, requests: DataFrame) -> DataFrame:
        policies = self.policies
        df = policies.resolver.apply(requests)
        df = with_expressions(df, policies.expression_columns, policies.resolver.attributes)
        df = df.withColumns(
            {
                "__error": request_error(df),
                "__resource_plain": pa.single_line(F.col("resource")),
                "__action_plain": pa.single_line(F.col("action")),
                "__subject_plain": pa.single_line(F.col("subject")),
            }
        )
        terms = _Terms(self, {n: at.operand(df, n, policies.resolver.attributes) for n in policies.names})
        scores = _Scores(len(policies.rows))
        each = [self._policy_score(p, terms, scores, i) for i, p in enumerate(policies.rows)]
        best = each[0] if len(each) == 1 else F.greatest(*each) if each else F.lit(scores.none)
        # A filter on the effect would be moved below this projection with a
        # copy of all policies in it.  Filters on request columns pass a
        # generator, filters on what it generates do not.
        df = df.withColumn("__score", best).select(
            *requests.columns, "__error", F.explode_outer(F.array("__score")).alias("__outcome")
        )
        effects, reasons = scores.meanings([p["name"] for p in policies.rows])
        effect, reason = (F.get(F.array(*[F.lit(v) for v in t]), F.col("__outcome")) for t in (effects, reasons))
        error = F.col("__error")
        return df.select(
            *requests.columns,
            F.when(error.isNotNull(), F.lit(schemas.DENY)).otherwise(effect).alias("effect"),
            F.when(error.isNotNull(), F.concat(F.lit(ERROR), error)).otherwise(reason).alias("reason"),
        )

    def _policy_score(self, policy, terms: _Terms, scores: _Scores, i: int) -> Column:
        match, fails = terms.target(policy)
        if self.policies.versioned:
            ts = F.col("request_ts")
            valid = ts >= F.lit(policy["valid_from"])
            if policy["valid_to"] is not None:
                valid = valid & (ts < F.lit(policy["valid_to"]))
            valid = F.coalesce(valid, F.lit(False))  # at no known time no version is in force
            match = valid & match
            fails = None if fails is None else valid & fails
        code = F.when(fails, F.lit(scores.target_error)) if fails is not None else None
        code = (code.when if code is not None else F.when)(~match, F.lit(scores.none))
        denies = []
        for rule in policy["rules"]:
            rule_match, rule_fails = terms.target(rule)
            if rule_fails is not None:
                code = code.when(rule_fails, F.lit(scores.error(i)))
            if rule["effect"] == schemas.PERMIT:
                code = code.when(rule_match & terms.rule_holds(rule), F.lit(scores.permit(i)))
            elif rule["effect"] == schemas.DENY:
                denies.append(rule_match & terms.rule_holds(rule))
        if denies:
            code = code.when(reduce(lambda a, b: a | b, denies), F.lit(scores.deny(i)))
        default = {schemas.PERMIT: scores.permit(i), schemas.DENY: scores.deny(i)}
        return code.otherwise(F.lit(default.get(policy["default_effect"], scores.silent)))

    # --- joined plan ------------------------------------------------------------

    def _in_key(self, df: DataFrame, name: str) -> bool:
        """Whether an attribute can differ between requests of one subject and resource."""
        spec = self.policies.resolver.attributes.get(name)
        if spec is None or spec.column not in df.columns:
            return True
        if spec.source in ("subject", "resource"):
            return self.policies.resolver.apply is not at.resolve_attributes or not spec.total
        return True

    def _keyed(self, requests: DataFrame) -> tuple[DataFrame, _Key]:
        """Requests plus their decision key (no NULLs, so plain equality joins)."""
        policies = self.policies
        resolver = policies.resolver
        df = resolver.apply(requests)
        df = with_expressions(df, policies.expression_columns, resolver.attributes)
        varying = [n for n in policies.names if self._in_key(df, n)]
        key = _Key(
            {n: f"__c{i}" for i, n in enumerate(varying)}, policies.versioned
        )
        flags = [F.when(F.col(c), F.lit("1")).otherwise(F.lit("0")) for c in policies.expression_columns]
        columns = {
            "__error": request_error(df),
            _SUBJECT: F.coalesce("subject", F.lit("")),
            _RESOURCE: F.coalesce("resource", F.lit("")),
            _ACTION: F.coalesce("action", F.lit("")),
            "__flags": F.concat(F.lit(""), *flags),
        }
        for name, column in key.context.items():
            value = at.operand(df, name, resolver.attributes)
            columns[column] = F.coalesce(F.concat(value.kind, F.lit(":"), value.text), F.lit(""))
        if policies.versioned:
            df = self._with_epoch(df)
        return df.withColumns(columns).select(*requests.columns, "__error", *key.columns), key

    def _with_epoch(self, df: DataFrame) -> DataFrame:
        """Adds ``__epoch``: the time (in microseconds) of the last policy change up to the request.

        It is the same for all requests between two changes.  Times are cut into buckets: one row for each bucket that
        holds requests has the changes inside it and the last one before it, and requests look theirs up.
        """
        bounds = self.policies.table.select(F.explode(F.array("valid_from", "valid_to")).alias("t")).where("t IS NOT NULL")
        changes = bounds.select(micros(F.col("t")).alias("t")).distinct().withColumn("__bucket", bucket_of(F.col("t"), EPOCH_BUCKET))
        changes = changes.groupBy("__bucket").agg(F.collect_list("t").alias("__inside"), F.max("t").alias("__top"))
        moment = micros(F.col("request_ts"))
        asked = df.select(bucket_of(moment, EPOCH_BUCKET).alias("__bucket")).where("__bucket IS NOT NULL").distinct()
        buckets = asked.join(changes, "__bucket", "full")
        # last change in earlier buckets: inside stretches of buckets, then over one row for each stretch
        stretch = F.floor(F.col("__bucket") / 4096).alias("__stretch")
        buckets = buckets.select("*", stretch)
        earlier = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = buckets.groupBy("__stretch").agg(F.max("__top").alias("m")).select("__stretch", F.max("m").over(earlier).alias("__carry"))
        before = Window.partitionBy("__stretch").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = buckets.withColumn("__before", F.max("__top").over(before)).join(carried, "__stretch")
        spans = found.select("__bucket", "__inside", F.greatest("__before", "__carry").alias("__before"))
        joined = df.withColumn("__bucket", bucket_of(moment, EPOCH_BUCKET)).join(spans, "__bucket", "left")
        inside = F.array_max(F.filter("__inside", lambda t: t <= moment))
        epoch = F.coalesce(inside, "__before", F.lit(NO_EPOCH))
        return joined.withColumn("__epoch", epoch).drop("__bucket", "__inside", "__before")

    def _keys(self, keyed: DataFrame, key: _Key) -> DataFrame:
        """Distinct decision keys with what the policies look at."""
        keys = keyed.filter(F.col("__error").isNull()).select(*key.columns).distinct()
        policies = self.policies
        resolver = policies.resolver
        base = keys
        if len(key.context) < len(policies.names):
            # The rest follow from subject and resource alone: derive them again.
            request = keys.withColumns(
                {
                    "subject": F.col(_SUBJECT),
                    "resource": F.col(_RESOURCE),
                    "action": F.col(_ACTION),
                    "session_id": F.lit(None).cast("string"),
                    "request_ts": F.lit(None).cast("timestamp"),
                }
            )
            base = resolver.apply(request)
        values = []
        for name in policies.names:
            if name in key.context:
                packed = F.col(key.context[name])
                at_mark = F.instr(packed, ":")
                kind = F.when(packed != "", F.substring(packed, F.lit(1), at_mark - 1))
                text = F.when(packed != "", F.substr(packed, at_mark + 1))
            else:
                value = at.operand(base, name, resolver.attributes)
                kind, text = value.kind, value.text
            values.append(F.struct(kind.alias("kind"), text.alias("text")))
        packed_values = F.array(*values).cast(f"array<{schemas.ATTR}>")
        return base.select(
            *key.columns,
            packed_values.alias("__values"),
            pa.single_line(F.col(_RESOURCE)).alias("__resource_plain"),
            pa.single_line(F.col(_ACTION)).alias("__action_plain"),
            pa.single_line(F.col(_SUBJECT)).alias("__subject_plain"),
        )

    def _target_state(self, resources: Column, actions: Column, subjects: Column) -> Column:
        """0 no match, 1 match, 2 a pattern that does not compile was reached."""
        bad = self.policies.bad_patterns

        def facet(listed: Column, value: str) -> Column:
            column, plain = F.col(f"__{value}"), F.col(f"__{value}_plain")
            if not bad:
                hit = F.exists(listed, lambda p: pa.matches(column, plain, p))
                return F.when(listed.isNull() | hit, F.lit(1)).otherwise(F.lit(0))
            usable = lambda p: ~((p["kind"] == pa.REGEX) & p["text"].isin(*sorted(bad)))
            first = F.get(
                F.filter(
                    listed,
                    lambda p: F.when(usable(p), pa.matches(column, plain, p)).otherwise(F.lit(True)),
                ),
                F.lit(0),
            )
            return (
                F.when(listed.isNull(), F.lit(1))
                .when(first.isNull(), F.lit(0))
                .when(usable(first), F.lit(1))
                .otherwise(F.lit(2))
            )

        by_resource, by_action = facet(resources, "resource"), facet(actions, "action")
        return (
            F.when(by_resource != 1, by_resource)
            .when(by_action != 1, by_action)
            .otherwise(facet(subjects, "subject"))
        )

    def _condition_holds(self, condition: Column) -> Column:
        policies = self.policies
        names = F.array(*[F.lit(n) for n in policies.names]).cast("array<string>")
        texts = F.array(*[F.lit(t) for t in policies.expressions]).cast("array<string>")
        flag = F.substring("__flags", F.array_position(texts, condition["expression"]).cast("int"), F.lit(1))
        known = F.array_contains(texts, condition["expression"])
        value = F.get(F.col("__values"), (F.array_position(names, condition["attribute"]) - 1).cast("int"))
        actual = at.Operand(value["kind"], value["text"], value["text"].try_cast("double"))
        expected = co.expected_column(
            condition["expected"], policies.not_bad(condition["expected"]["text"], policies.bad_matches)
        )
        by_operator = co.satisfied(condition["operator"], actual, expected, self.operators)
        by_expression = F.coalesce(known & (flag == "1"), F.lit(False))
        return F.when(condition["expression"].isNotNull(), by_expression).otherwise(by_operator)

    def _rule_code(self, rule: Column) -> Column:
        state = self._target_state(rule["resources"], rule["actions"], rule["subjects"])
        holds = F.coalesce(F.forall(rule["conditions"], self._condition_holds), F.lit(True))
        return (
            F.when(state == 2, F.lit(ps.RULE_ERROR))
            .when((state == 1) & holds, effect_code(rule["effect"]))
            .otherwise(F.lit(ps.SILENT))
        )

    def _policy_columns(self) -> list[str]:
        moments = ["valid_from", "valid_to"] if self.policies.versioned else []
        return ["rank", "policy_id", "name", "default_effect", "resources", "actions", "subjects", "rules", *moments]

    def _key_policies(self, keys: DataFrame, key: _Key, extra) -> DataFrame:
        """Keys x matching policies with target state, code and extra columns.

        Candidates are the policies whose route the key has; the full target
        test follows, and only what passes it goes on to the rules.
        """
        routes = self.policies.routes_of(F.col(_RESOURCE), F.col(_ACTION), F.col(_SUBJECT))
        candidates = self.policies.met(keys.withColumn("__route", F.explode(routes)), self._policy_columns())
        # of several routes of a policy that a key has, the first counts; the key's are found again for such policies alone
        several = (F.size("__routes") > 1) & (F.col("__route") != F.array_min(F.array_intersect("__routes", routes)))
        candidates = candidates.filter(~several).drop("__routes")
        state = self._target_state(F.col("resources"), F.col("actions"), F.col("subjects"))
        in_force = F.col("rank").isNotNull()
        if self.policies.versioned:
            in_force = in_force & key.in_force(F.col("valid_from"), F.col("valid_to"))
        candidates = candidates.withColumn("state", F.when(in_force, state).otherwise(F.lit(0))).filter("state <> 0")
        rule_codes = F.transform("rules", self._rule_code)
        candidates = candidates.withColumn("__codes", F.when(F.col("state") == 1, rule_codes))
        permit = F.array_position("__codes", ps.PERMIT)
        error = F.array_position("__codes", ps.RULE_ERROR)
        code = (
            F.when(F.col("state") == 2, F.lit(ps.TARGET_ERROR))
            .when(F.col("state") == 0, F.lit(ps.NONE))
            .when((error > 0) & ((permit == 0) | (error < permit)), F.lit(ps.RULE_ERROR))
            .when(permit > 0, F.lit(ps.PERMIT))
            .when(F.array_contains("__codes", ps.DENY), F.lit(ps.DENY))
            .otherwise(effect_code(F.col("default_effect")))
        )
        candidates = candidates.withColumn("code", code)
        return candidates.select(*key.columns, "rank", "state", "code", *extra(candidates))

    def _joined(self, requests: DataFrame) -> DataFrame:
        keyed, dk = self._keyed(requests)
        key = dk.columns
        steps = self._key_policies(self._keys(keyed, dk), dk, lambda df: [])
        rank, code = F.col("rank"), F.col("code")
        decided = steps.groupBy(*key).agg(
            F.max(code).alias("__worst"),
            F.min(F.when(code == ps.PERMIT, rank)).alias("__permit"),
            F.min(F.when(code == ps.RULE_ERROR, rank)).alias("__broken"),
            F.max(F.when(code == ps.DENY, rank)).alias("__deny"),
            F.max((code != ps.NONE)).alias("__any"),
        )
        permit, broken = F.col("__permit"), F.col("__broken")
        failed = (F.col("__worst") == ps.TARGET_ERROR) | (
            broken.isNotNull() & (permit.isNull() | (broken < permit))
        )
        decided = decided.select(
            *key,
            F.when(failed, F.lit(ps.RULE_ERROR))
            .when(permit.isNotNull(), F.lit(ps.PERMIT))
            .when(F.col("__deny").isNotNull(), F.lit(ps.DENY))
            .when(F.col("__any"), F.lit(ps.SILENT))
            .otherwise(F.lit(ps.NONE))
            .alias("__code"),
            F.when(~failed, F.coalesce(permit, "__deny")).alias("__rank"),
        )
        versioned = self.policies.versioned
        named = ["name", "valid_from", "valid_to"] if versioned else ["name"]
        names = self.policies.joinable(self.policies.table.select("rank", *named))
        same = F.col("__rank") == F.col("rank")
        if versioned:  # versions of a policy share its rank
            same = same & dk.in_force(F.col("valid_from"), F.col("valid_to"))
        decided = decided.join(names, same, "left").select(*key, "__code", "name")
        found = keyed.join(decided, key, "left")
        code, error = F.coalesce("__code", F.lit(ps.NONE)), F.col("__error")
        effect = (
            F.when(error.isNotNull() | code.isin(ps.RULE_ERROR, ps.DENY), F.lit(schemas.DENY))
            .when(code == ps.PERMIT, F.lit(schemas.PERMIT))
            .otherwise(F.lit(schemas.NOT_APPLICABLE))
        )
        reason = (
            F.when(error.isNotNull(), F.concat(F.lit(ERROR), error))
            .when(code == ps.RULE_ERROR, F.lit(ERROR + _BAD_PATTERN))
            .when(code == ps.PERMIT, F.concat(F.lit(GRANTED), "name"))
            .when(code == ps.DENY, F.concat(F.lit(DENIED), "name"))
            .when(code == ps.SILENT, F.lit(NO_RULES))
            .otherwise(F.lit(NO_POLICIES))
        )
        return found.select(*requests.columns, effect.alias("effect"), reason.alias("reason"))

    # --- trace --------------------------------------------------------------------

    def _compiled_trace(self, requests: DataFrame) -> DataFrame:
        """Traces of a small set, each made where its request is read.

        What several columns look at is computed once, in projections one above the other.
        """
        policies, resolver = self.policies, self.policies.resolver
        df = resolver.apply(requests)
        df = with_expressions(df, policies.expression_columns, resolver.attributes)
        plain = {f"__{c}_plain": pa.single_line(F.col(c)) for c in ("resource", "action", "subject")}
        values, operands = {}, {}
        for i, name in enumerate(policies.names):
            found = at.operand(df, name, resolver.attributes)
            values |= {f"__kind{i}": found.kind, f"__text{i}": found.text, f"__num{i}": found.num}
            operands[name] = at.Operand(F.col(f"__kind{i}"), F.col(f"__text{i}"), F.col(f"__num{i}"))
        df = df.withColumns({"__error": request_error(df), **plain, **values})
        terms = _Terms(self, operands)
        rows = [_TracedPolicy(i, p, terms, policies.versioned) for i, p in enumerate(policies.rows)]
        for step in ("tests", "codes"):
            columns = {name: column for r in rows for name, column in getattr(r, step)().items()}
            df = df.withColumns(columns) if columns else df

        first = F.when(F.lit(False), F.lit(0).cast("bigint"))
        for r in rows:
            first = first.when(r.code.isin(ps.PERMIT, ps.RULE_ERROR), F.lit(r.policy["rank"]).cast("bigint"))
        df = df.withColumn("__stop", first)
        failed, seen = F.col("__error").isNotNull(), []
        for r in rows:
            rank = F.lit(r.policy["rank"]).cast("bigint")
            reached = F.col("__stop").isNull() | (rank <= F.col("__stop"))
            failed = failed | (r.code == ps.TARGET_ERROR) | ((r.code == ps.RULE_ERROR) & reached)
            step = F.struct(rank.alias("rank"), r.step().alias("step"))
            seen.append(F.when((r.code != ps.NONE) & reached, step))
        empty = F.array().cast(_TRACE)
        if seen:
            listed = F.array_compact(F.array(*seen))
            if len({r.policy["rank"] for r in rows}) < len(rows):  # versions of a policy share its rank
                listed = F.array_sort(listed)
            trace = F.when(failed, empty).otherwise(F.transform(listed, lambda s: s["step"]).cast(_TRACE))
        else:
            trace = empty
        # As with decisions: filters on the trace stay above the generator.
        return df.select(*requests.columns, F.explode_outer(F.array(trace)).alias("trace"))

    def _trace_columns(self, candidates: DataFrame) -> list[Column]:
        """What was visited of one policy, in the order of its rules and conditions.

        The texts of the reasons are fixed values.
        """

        names = F.array(*[F.lit(n) for n in self.policies.names]).cast("array<string>")

        def seen_condition(c: Column) -> Column:
            value = F.get(F.col("__values"), (F.array_position(names, c["attribute"]) - 1).cast("int"))
            looked = F.struct(self._condition_holds(c).alias("holds"), value.alias("value"))
            return _let(looked, lambda v: described(c, v["holds"], v["value"]))

        def described(c: Column, holds: Column, value: Column) -> Column:
            by_expression = c["expression"].isNotNull()
            expected = F.coalesce(c["expected"]["text"], F.lit("null"))
            outcome = F.when(holds, F.lit("satisfied")).otherwise(F.lit("not satisfied"))
            reason = (
                F.when(by_expression & holds, F.lit("Expression evaluated to true"))
                .when(by_expression, F.lit("Expression evaluated to false"))
                .when(
                    value["kind"].isNull(),
                    F.concat(F.lit("Attribute not found: "), F.coalesce(c["attribute"], F.lit("null"))),
                )
                .otherwise(F.format_string("Attribute %s %s %s: %s", c["attribute"], c["operator"], expected, outcome))
            )
            return F.struct(
                c["attribute"].alias("attribute"),
                c["operator"].alias("operator"),
                holds.alias("satisfied"),
                reason.alias("reason"),
                F.when(by_expression, holds.cast("string")).otherwise(value["text"]).alias("actual"),
                F.when(by_expression, F.lit("true")).otherwise(c["expected"]["text"]).alias("expected"),
            )

        def seen_rule(r: Column) -> Column:
            state = self._target_state(r["resources"], r["actions"], r["subjects"])
            seen = F.when(state == 1, F.transform(r["conditions"], seen_condition)).cast(_SEEN)
            looked = F.struct((state == 1).alias("target"), F.coalesce(seen, F.array().cast(_SEEN)).alias("seen"))
            return _let(looked, lambda v: judged(r, v["target"], v["seen"]))

        def judged(r: Column, target: Column, seen: Column) -> Column:
            failed = F.array_position(F.transform(seen, lambda s: s["satisfied"]), False)
            holds = target & (failed == 0)
            return F.struct(
                r["rule_id"].alias("rule_id"),
                r["name"].alias("name"),
                F.when(holds, r["effect"]).otherwise(F.lit(schemas.NOT_APPLICABLE)).alias("effect"),
                F.when(~target, F.lit("Rule target not matched"))
                .when(holds, F.lit("All conditions satisfied"))
                .otherwise(F.lit("Conditions not satisfied"))
                .alias("reason"),
                F.when(failed > 0, F.slice(seen, F.lit(1), failed.cast("int"))).otherwise(seen).alias("conditions"),
            )

        codes = F.col("__codes")
        permit = F.array_position(codes, ps.PERMIT)
        last_deny = F.size(codes) - F.array_position(F.reverse(codes), ps.DENY)  # 0-based
        decider = (
            F.when(F.col("code").isNull() | (F.col("state") != 1), F.lit(None).cast("int"))
            .when(permit > 0, (permit - 1).cast("int"))
            .when(F.array_contains(codes, ps.DENY), last_deny.cast("int"))
        )
        rule_name = F.get(F.col("rules"), decider)["name"]
        reason = (
            F.when(permit > 0, F.concat(F.lit("Rule "), rule_name, F.lit(" granted access")))
            .when(decider.isNotNull(), F.concat(F.lit("Rule "), rule_name, F.lit(" denied access")))
            .otherwise(F.lit("Default policy effect"))
        )
        visited = F.when(permit > 0, F.slice("rules", F.lit(1), permit.cast("int"))).otherwise(F.col("rules"))
        step = F.struct(
            F.col("policy_id").alias("policy_id"),
            F.col("name").alias("name"),
            _effect_of(F.col("code")).alias("effect"),
            reason.alias("reason"),
            F.transform(visited, seen_rule).alias("rules"),
        )
        return [F.when(F.col("state") == 1, step).alias("step")]


class _Scores:
    """Numbers for the outcomes of single policies such that the largest decides.

    Policies are counted in rank order: an earlier permit (or error) beats a
    later one, any of them beats a denial, and a later denial an earlier one.
    """

    none, silent = 0, 1

    def __init__(self, policies: int):
        self.n = policies
        self.target_error = 2 + 3 * policies

    def deny(self, i: int) -> int:
        return 2 + i

    def permit(self, i: int) -> int:
        return 2 + self.n + 2 * (self.n - 1 - i)

    def error(self, i: int) -> int:
        return self.permit(i) + 1

    def meanings(self, names: list[str]) -> tuple[list[str], list[str]]:
        """Effect and reason of every number."""
        effects = [schemas.NOT_APPLICABLE] * (self.target_error + 1)
        reasons = [NO_POLICIES] * (self.target_error + 1)
        reasons[self.silent] = NO_RULES
        failed = [self.error(i) for i in range(self.n)] + [self.target_error]
        for number in failed:
            effects[number], reasons[number] = schemas.DENY, ERROR + _BAD_PATTERN
        for i, name in enumerate(names):
            effects[self.deny(i)], reasons[self.deny(i)] = schemas.DENY, DENIED + name
            effects[self.permit(i)], reasons[self.permit(i)] = schemas.PERMIT, GRANTED + name
        return effects, reasons


class _Terms:
    """Columns of targets and conditions known as the plan is built.

    Policies repeat themselves, so equal targets and conditions share a column.
    """

    def __init__(self, engine: Engine, operands: dict[str, at.Operand]):
        self.policies = engine.policies
        self.operators = engine.operators
        self.operands = operands
        self._made: dict = {}

    def _once(self, key, make):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def target(self, holder) -> tuple[Column, Column | None]:
        """``(matches, fails)``; ``fails`` is None when every pattern compiles.

        A pattern that does not compile fails the request only if it is
        reached: facets before it matched and no pattern before it did.
        """
        match, fails = F.lit(True), None
        for facet, column in (("resources", "resource"), ("actions", "action"), ("subjects", "subject")):
            listed = holder[facet]
            if not listed:
                continue
            texts = tuple(p["text"] + "|" + p["kind"] for p in listed)
            hit, broken = self._once((facet, texts), lambda: self._facet(listed, column))
            if broken is not None:
                fails = (match & broken) if fails is None else fails | (match & broken)
            match = match & hit
        return match, fails

    def _facet(self, listed, column: str) -> tuple[Column, Column | None]:
        value, plain = F.col(column), F.col(f"__{column}_plain")
        hit, broken = None, None
        for pattern in listed:
            if pattern["kind"] == pa.REGEX and pattern["text"] in self.policies.bad_patterns:
                reached = F.lit(True) if hit is None else ~hit
                broken = reached if broken is None else broken | reached
            else:
                match = pa.matches_literal(value, plain, pattern)
                match = match if broken is None else ~broken & match
                hit = match if hit is None else hit | match
        return (F.lit(False) if hit is None else hit), broken

    def rule_holds(self, rule) -> Column:
        holds = F.lit(True)
        for condition in rule["conditions"] or ():
            holds = holds & self.condition_holds(condition)
        return holds

    def condition_holds(self, condition) -> Column:
        return self._once(str(condition), lambda: self._condition(condition))

    def _condition(self, condition) -> Column:
        text = condition["expression"]
        if text:
            known = text in self.policies.expressions
            return F.col(f"__x{self.policies.expressions.index(text)}") if known else F.lit(False)
        if condition["attribute"] is None:
            return F.lit(False)
        expected = condition["expected"]
        valid = expected is None or expected["text"] not in self.policies.bad_matches
        if condition["operator"] == "MATCHES" and not valid:
            return F.lit(False)
        return co.satisfied(
            condition["operator"] or "", self.operands[condition["attribute"]],
            co.expected_operand(expected), self.operators,
        )


class _TracedPolicy:
    """Columns of one policy's step in a trace, known as the plan is built."""

    def __init__(self, i: int, policy, terms: _Terms, versioned: bool):
        self.i, self.policy, self.terms, self.versioned = i, policy, terms, versioned
        self.code = F.col(f"__code{i}")

    def _named(self, kind: str, j: int) -> str:
        return f"__{kind}{self.i}_{j}"

    def tests(self) -> dict[str, Column]:
        """Target and rule targets, and of each rule the number of its first condition that fails."""
        match, fails = self.terms.target(self.policy)
        if self.versioned:
            ts = F.col("request_ts")
            valid = ts >= F.lit(self.policy["valid_from"])
            if self.policy["valid_to"] is not None:
                valid = valid & (ts < F.lit(self.policy["valid_to"]))
            valid = F.coalesce(valid, F.lit(False))
            match, fails = valid & match, None if fails is None else valid & fails
        broken = F.lit(False) if fails is None else fails
        good = F.col("__error").isNull()  # other requests have no trace
        found = {f"__match{self.i}": good & match, f"__fails{self.i}": good & broken}
        for j, rule in enumerate(self.policy["rules"]):
            rule_match, rule_fails = self.terms.target(rule)
            found[self._named("target", j)] = rule_match
            found[self._named("broken", j)] = F.lit(False) if rule_fails is None else rule_fails
            first = F.when(F.lit(False), F.lit(0))
            for k, condition in enumerate(rule["conditions"] or ()):
                first = first.when(~self.terms.condition_holds(condition), F.lit(k + 1))
            found[self._named("failed", j)] = first.otherwise(F.lit(0))
        return found

    def _holds(self, j: int) -> Column:
        return F.col(self._named("target", j)) & (F.col(self._named("failed", j)) == 0)

    def codes(self) -> dict[str, Column]:
        """The outcome of the policy and the place of the rule that decided it."""
        code = F.when(F.col(f"__fails{self.i}"), F.lit(ps.TARGET_ERROR)).when(~F.col(f"__match{self.i}"), F.lit(ps.NONE))
        decider = F.when(F.lit(False), F.lit(0))
        rules = self.policy["rules"]
        for j, rule in enumerate(rules):
            code = code.when(F.col(self._named("broken", j)), F.lit(ps.RULE_ERROR))
            if rule["effect"] == schemas.PERMIT:
                code = code.when(self._holds(j), F.lit(ps.PERMIT))
                decider = decider.when(self._holds(j), F.lit(j))
        for j, rule in reversed(list(enumerate(rules))):
            if rule["effect"] == schemas.DENY:
                code = code.when(self._holds(j), F.lit(ps.DENY))
                decider = decider.when(self._holds(j), F.lit(j))
        default = ps.EFFECT_CODES.get(self.policy["default_effect"], ps.SILENT)
        return {f"__code{self.i}": code.otherwise(F.lit(default)), f"__decider{self.i}": decider}

    def step(self) -> Column:
        rules, decider = self.policy["rules"], F.col(f"__decider{self.i}")
        reason, visited = F.when(decider.isNull(), F.lit("Default policy effect")), F.lit(len(rules))
        for j, rule in enumerate(rules):
            permits = rule["effect"] == schemas.PERMIT
            verb = "granted" if permits else "denied"
            name = None if rule["name"] is None else f"Rule {rule['name']} {verb} access"
            reason = reason.when(decider == j, F.lit(name).cast("string"))
            if permits:
                visited = F.when(decider == j, F.lit(j + 1)).otherwise(visited)
        listed = F.slice(F.array(*[self._rule(j) for j in range(len(rules))]), F.lit(1), visited) if rules else F.array().cast(_RULES)
        return F.struct(
            F.lit(self.policy["policy_id"]).alias("policy_id"),
            F.lit(self.policy["name"]).alias("name"),
            _effect_of(self.code).alias("effect"),
            reason.alias("reason"),
            listed.alias("rules"),
        )

    def _rule(self, j: int) -> Column:
        rule, target, failed = self.policy["rules"][j], F.col(self._named("target", j)), F.col(self._named("failed", j))
        conditions, seen = rule["conditions"] or (), F.array().cast(_SEEN)
        if conditions:
            each = F.array(*[self._condition(c, k, failed) for k, c in enumerate(conditions)])
            count = F.when(failed > 0, failed).otherwise(F.lit(len(conditions)))
            seen = F.when(~target, seen).otherwise(F.slice(each, F.lit(1), count))
        return F.struct(
            F.lit(rule["rule_id"]).alias("rule_id"),
            F.lit(rule["name"]).alias("name"),
            F.when(self._holds(j), F.lit(rule["effect"])).otherwise(F.lit(schemas.NOT_APPLICABLE)).alias("effect"),
            F.when(~target, F.lit("Rule target not matched"))
            .when(failed == 0, F.lit("All conditions satisfied"))
            .otherwise(F.lit("Conditions not satisfied"))
            .alias("reason"),
            seen.alias("conditions"),
        )

    def _condition(self, c, k: int, failed: Column) -> Column:
        """Of a condition up to the first that fails: those before it hold."""
        holds = failed != k + 1
        if c["expression"] is not None:
            reason = F.when(holds, F.lit("Expression evaluated to true")).otherwise(F.lit("Expression evaluated to false"))
            actual, expected = holds.cast("string"), "true"
        else:
            value = self.terms.operands.get(c["attribute"])
            expected = None if c["expected"] is None else c["expected"]["text"]
            shown = ["null" if t is None else t for t in (c["attribute"], c["operator"], expected)]
            absent = F.lit(True) if value is None else value.kind.isNull() | value.text.isNull()
            text = "Attribute {} {} {}: ".format(*shown)
            reason = (
                F.when(absent, F.lit(f"Attribute not found: {shown[0]}"))
                .when(holds, F.lit(text + "satisfied"))
                .otherwise(F.lit(text + "not satisfied"))
            )
            actual = F.lit(None).cast("string") if value is None else F.when(~absent, value.text)
        return F.struct(
            F.lit(c["attribute"]).cast("string").alias("attribute"),
            F.lit(c["operator"]).cast("string").alias("operator"),
            holds.alias("satisfied"),
            reason.alias("reason"),
            actual.alias("actual"),
            F.lit(expected).cast("string").alias("expected"),
        )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, inside lambda functions too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SEEN = (
    "array<struct<attribute:string,operator:string,satisfied:boolean,reason:string,actual:string,expected:string>>"
)
_RULES = f"array<struct<rule_id:string,name:string,effect:string,reason:string,conditions:{_SEEN}>>"
_TRACE = f"array<struct<policy_id:string,name:string,effect:string,reason:string,rules:{_RULES}>>"


def _effect_of(code: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for name, number in ps.EFFECT_CODES.items():
        chain = chain.when(code == number, F.lit(name))
    return chain
