"""A policy table made ready for evaluation.

Policies are configuration: a store holds thousands, a request log holds
billions.  The size is measured once, in bytes; a set within ``SNAPSHOT_BYTES``
is read to the driver (one job) so that every plan uses the same snapshot and
may broadcast it.  A larger set stays distributed: it is written once to the
shared folder, with its routes, and joined by a shuffle on both sides.
Answers do not depend on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warden import schemas
from warden.functions import expressions as ex
from warden.functions import patterns
from warden.functions.attributes import Resolver
from warden.session import written
from warden.sources.policies import rank_key

SNAPSHOT_BYTES = 16 << 20  # of the policies as JSON, each counted once for every route it is joined on

# decision codes of one policy or rule
NONE, PERMIT, DENY, SILENT, RULE_ERROR, TARGET_ERROR = range(6)
EFFECT_CODES = {schemas.PERMIT: PERMIT, schemas.DENY: DENY, schemas.NOT_APPLICABLE: SILENT}
UNROUTED = "*"
_FOLDER, _SUBJECT, _ACTION = "resource ", "subject ", "action "
_GRAMS = {"resources": "by gram of resource ", "subjects": "by gram of subject "}
CROWD = 512  # policies on one route of a distributed set above which they are dealt into parts of about so many
KNOWN_GRAMS = 10_000  # grams of a distributed set up to which those of requests are compared with them before the join


def effect_code(effect: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(NONE))
    for name, code in EFFECT_CODES.items():
        chain = chain.when(effect == name, F.lit(code))
    return chain.otherwise(F.lit(SILENT))


def folder_of(lead: Column) -> Column:
    """Literal text up to its last slash, ``*`` when it has none."""
    folder = F.regexp_extract(lead, r"(?s)\A.*/", 0)
    return F.when(folder == "", F.lit(UNROUTED)).otherwise(folder)


def folders_above(path: Column, depths: Column | None = None) -> Column:
    """Every prefix of a path that ends in a slash, or those with the listed numbers of slashes."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    numbers = F.sequence(F.lit(1), last) if depths is None else F.filter(depths, lambda n: n <= last)
    above = F.transform(numbers, lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    return F.when(last > 0, above).otherwise(F.array().cast("array<string>"))


@dataclass
class PolicySet:
    """Enabled policies with everything evaluation looks up."""

    spark: SparkSession
    table: DataFrame
    rows: list | None
    resolver: Resolver
    versioned: bool
    names: list[str] = field(default_factory=list)
    expressions: list[str] = field(default_factory=list)
    expression_errors: dict[str, str] = field(default_factory=dict)
    bad_patterns: frozenset[str] = frozenset()
    bad_matches: frozenset[str] = frozenset()
    terms: int = 0
    tried: dict = field(default_factory=dict)  # expression or regular expression -> its error, or whether it compiles

    @classmethod
    def load(cls, policies: DataFrame, resolver: Resolver | None = None, limit: int | None = None) -> PolicySet:
        resolver = resolver or Resolver()
        spark = policies.sparkSession
        limit = SNAPSHOT_BYTES if limit is None else limit
        versioned = "valid_from" in policies.columns
        validity = ["valid_from", "valid_to"] if versioned else []
        enabled = policies.filter("enabled").select(
            rank_key(F.col("priority"), F.col("policy_ord")).alias("rank"),
            "policy_id",
            "name",
            "default_effect",
            "resources",
            "actions",
            "subjects",
            F.filter("rules", lambda r: r["enabled"]).alias("rules"),
            *validity,
        )
        routes = sum(F.greatest(F.lit(1), F.size(f)) for f in ("resources", "subjects", "actions"))
        size = F.length(F.to_json(F.struct(*enabled.columns))) * routes
        if (enabled.agg(F.sum(size)).first()[0] or 0) <= limit:
            found = cls._snapshot(spark, enabled.collect(), enabled.schema, resolver, versioned)
            found._read_snapshot()
        else:
            # Read several times from here on, and rows must keep their numbers.
            table = written(enabled.withColumn("__row", F.monotonically_increasing_id()))
            found = cls(spark, table, None, resolver, versioned)
            found._read_table()
        return found

    @classmethod
    def _snapshot(cls, spark, rows, schema, resolver, versioned) -> PolicySet:
        rows = sorted(rows, key=lambda r: r["rank"])
        return cls(spark, spark.createDataFrame(rows, schema), rows, resolver, versioned)

    def merged(self, policies: DataFrame, changed: DataFrame) -> PolicySet:
        """This set brought up to ``policies``, which differ from it in the policies whose ids ``changed`` lists.

        Only those are read to the driver, and only expressions and patterns not met before are tried.  A set that is
        not a snapshot, or would not be one any more, is loaded anew.
        """
        if self.rows is None or self.versioned:
            return PolicySet.load(policies, self.resolver)
        ids = {r[0] for r in changed.limit(len(self.rows) + 1).collect()}
        if len(ids) > len(self.rows):
            return PolicySet.load(policies, self.resolver)
        news = PolicySet.load(policies.join(changed, "policy_id", "left_semi"), self.resolver)
        if news.rows is None:
            return PolicySet.load(policies, self.resolver)
        rows = [r for r in self.rows if r["policy_id"] not in ids] + news.rows
        if sum(len(str(r.asDict(recursive=True))) for r in rows) > SNAPSHOT_BYTES:
            return PolicySet.load(policies, self.resolver)
        found = PolicySet._snapshot(self.spark, rows, self.table.schema, self.resolver, self.versioned)
        found.tried = self.tried | news.tried
        found._read_snapshot()
        return found

    # --- what the plan must know ---------------------------------------------

    def _read_snapshot(self) -> None:
        conditions, targets, rules = [], [], 0
        for policy in self.rows:
            rules += len(policy["rules"])
            targets += [p for facet in _FACETS for p in policy[facet] or ()]
            for rule in policy["rules"]:
                targets += [p for facet in _FACETS for p in rule[facet] or ()]
                conditions += rule["conditions"] or ()
        self.terms = len(self.rows) + rules + len(targets) + len(conditions)
        self._set_lookups(
            names={c["attribute"] for c in conditions if not c["expression"] and c["attribute"] is not None},
            texts={c["expression"] for c in conditions if c["expression"]},
            regexes={p["text"] for p in targets if p["kind"] == patterns.REGEX and re.search(patterns.NOT_PLAIN, p["text"])},
            matches={
                c["expected"]["text"]
                for c in conditions
                if c["operator"] == "MATCHES" and c["expected"] is not None and c["expected"]["text"] is not None
            },
        )

    def _read_table(self) -> None:
        """The same for a distributed table: only distinct texts that must be tried or looked up reach the driver."""
        rules = self.table.select(F.explode("rules").alias("r"))
        conditions = rules.select(F.explode("r.conditions").alias("c")).select("c.*")
        targets = self.table.select(*_FACETS).unionByName(rules.select(*[f"r.{f}" for f in _FACETS]))
        listed = targets.select(
            F.explode(F.flatten(F.array_compact(F.array(*[F.col(f) for f in _FACETS])))).alias("p")
        ).select("p.*")

        def distinct(df: DataFrame, column: str) -> set[str]:
            return {r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()}

        self.terms = 1 << 30
        self._set_lookups(
            names=distinct(conditions.filter(F.col("expression").isNull()), "attribute"),
            texts=distinct(conditions, "expression"),
            regexes=distinct(listed.filter((F.col("kind") == patterns.REGEX) & F.col("text").rlike(patterns.NOT_PLAIN)), "text"),
            matches=distinct(
                conditions.filter(F.col("operator") == "MATCHES").select(F.col("expected.text").alias("m")), "m"
            ),
        )

    def _set_lookups(self, names, texts, regexes, matches) -> None:
        self.names = sorted(names)
        news = sorted(t for t in texts if ("expression", t) not in self.tried)
        sample = self.resolver.apply(sample_request(self.spark)) if news else None
        for text, error in ex.usable(self.spark, news, sample, self.resolver.attributes).items():
            self.tried["expression", text] = error
        tried = {t: self.tried["expression", t] for t in sorted(texts)}
        self.expressions = [t for t, error in tried.items() if error is None]
        self.expression_errors = {t: e for t, e in tried.items() if e is not None}
        # Valid both alone and wrapped, as whole() uses it.
        forms = {t: t.replace("*", ".*") for t in regexes}
        wanted = {f for t in (*forms.values(), *matches) for f in (t, rf"\A(?:{t})\z")}
        found = patterns.compilable(self.spark, [t for t in wanted if ("pattern", t) not in self.tried])
        self.tried |= {("pattern", t): compiles for t, compiles in found.items()}
        ok = {t: self.tried["pattern", t] for t in wanted}
        self.bad_patterns = frozenset(t for t, f in forms.items() if not (ok[f] and ok[rf"\A(?:{f})\z"]))
        self.bad_matches = frozenset(t for t in matches if not (ok[t] and ok[rf"\A(?:{t})\z"]))

    # --- pieces of plans -----------------------------------------------------

    @property
    def expression_columns(self) -> dict[str, str]:
        return {f"__x{i}": text for i, text in enumerate(self.expressions)}

    def not_bad(self, pattern_text: Column, bad: frozenset[str]) -> Column:
        return ~pattern_text.isin(*sorted(bad)) if bad else F.lit(True)

    def broadcastable(self) -> bool:
        return self.rows is not None

    def joinable(self, table: DataFrame) -> DataFrame:
        """A table of these policies as the right side of a join: broadcast if they are a snapshot, never otherwise.

        Left alone, a join is planned by the size of the written files, of which policies take many times as much in memory.
        """
        return F.broadcast(table) if self.broadcastable() else table.hint("merge")

    @cached_property
    def grams(self) -> dict[str, str]:
        """Of a snapshot with policies that need them: target pattern to its rarest gram."""
        if self.rows is None or not self._without_grams().filter(F.array_contains("__routes", UNROUTED)).limit(1).count():
            return {}
        return {r.text: r.gram for r in self._rarest_grams().collect()}  # one for each pattern at most

    @cached_property
    def kinds(self) -> set[tuple[str, str]]:
        """Kinds of routes that policies are met on: ``(mark, "")``, of folders with their number of slashes, of grams with their form."""
        routes = self._routes.select(F.explode("__routes").alias("r"))
        mark = F.regexp_extract("r", f"^({'|'.join((*_GRAMS.values(), _FOLDER, _SUBJECT, _ACTION))})", 1)
        slashes = F.length("r") - F.length(F.replace("r", F.lit("/"), F.lit("")))
        form = F.substring("r", F.length(mark) + 1, F.lit(1))
        detail = F.when(mark == _FOLDER, slashes.cast("string")).when(mark.isin(*_GRAMS.values()), form).otherwise(F.lit(""))
        return {tuple(r) for r in routes.select(mark, detail).distinct().collect()}  # as many as paths are deep

    @cached_property
    def known_grams(self) -> list[str] | None:
        """Grams and words that policies are met by; None when there are too many to list."""
        if self.broadcastable():
            return sorted(set(self.grams.values()))
        marks = "|".join(_GRAMS.values())
        route = F.explode("__routes").alias("r")
        used = self._routes.select(route).filter(F.col("r").rlike(f"^({marks})")).distinct()
        found = {r[0] for r in used.limit(KNOWN_GRAMS + 1).collect()}
        return None if len(found) > KNOWN_GRAMS else sorted({re.sub(f"^({marks})", "", r) for r in found})

    def routes_of(self, resource: Column, action: Column, subject: Column) -> Column:
        """The routes on which a request meets policies: its folders, subject and action, grams of both values, and ``*``.

        Only kinds that some policy is met on; grams are those that policies are met by, unless these are very many.
        """
        marks = {mark for mark, _ in self.kinds}
        routes = [F.array(
            *[F.concat(F.lit(m), v) for m, v in ((_SUBJECT, subject), (_ACTION, action)) if m in marks],
            *[F.lit(UNROUTED) for _ in range("" in marks)],
        ).cast("array<string>")]
        if _FOLDER in marks:
            depths = sorted(int(n) for m, n in self.kinds if m == _FOLDER)
            routes.append(_marked(_FOLDER, folders_above(resource, F.array(*map(F.lit, depths)))))
        for facet, value in (("resources", resource), ("subjects", subject)):
            used = {form for m, form in self.kinds if m == _GRAMS[facet]}
            forms = sorted(int(f) for f in used - {patterns.WORD})
            if not used:
                continue
            grams = [patterns.value_words(value)] if patterns.WORD in used else []
            grams += [patterns.value_grams(value, forms)] if forms else []
            each = F.concat(*grams)
            if self.known_grams is not None:
                each = F.filter(each, lambda g: g.isin(*self.known_grams))
            routes.append(_marked(_GRAMS[facet], each))
        return F.concat(*routes)

    def _rarest_grams(self) -> DataFrame:
        """``text, gram`` for every target pattern that has words or grams: the one that the fewest patterns share."""
        listed = F.flatten(F.array_compact(F.array("resources", "subjects")))
        texts = self.table.select(F.explode(F.transform(listed, _written)).alias("text")).distinct()
        text = F.col("text")
        grams = texts.select("text", F.explode(F.concat(patterns.pattern_words(text), patterns.pattern_grams(text))).alias("gram"))
        # Planned by the size of the written files, of which grams take many times as much, it would be broadcast.
        rarity = grams.groupBy("gram").agg(F.count("*").alias("patterns")).hint("merge")
        least = F.min(F.struct("patterns", ~F.startswith("gram", F.lit(patterns.WORD)), "gram"))
        return grams.join(rarity, "gram").groupBy("text").agg(least.alias("least")).select("text", F.col("least.gram").alias("gram"))

    def _sound(self, facet: str) -> Column:
        if not self.bad_patterns:
            return F.lit(True)
        return F.forall(facet, lambda p: (p["kind"] != patterns.REGEX) | self.not_bad(p["text"], self.bad_patterns))

    def _without_grams(self) -> DataFrame:
        """The policies with ``__routes`` by folder, subject or action, ``*`` where there is none.

        A policy with resources is met in the folders that all matches lie in; nested folders of one policy are reduced
        to the outermost.  Without a fixed folder it is met by its literal subjects, else by its literal actions.  A
        policy holding a pattern that does not compile must be seen by all requests that can reach it.
        """
        folders = F.array_distinct(F.transform("resources", lambda p: folder_of(p["lead"])))
        lead_routes = F.filter(
            folders,
            lambda f: ~F.exists(folders, lambda other: (other != f) & F.startswith(f, other)),
        )

        def literal(facet: str) -> Column:
            return F.col(facet).isNotNull() & F.forall(facet, lambda p: p["kind"] == patterns.LITERAL)

        def named(facet: str, mark: str) -> Column:
            return F.array_distinct(F.transform(facet, lambda p: F.concat(F.lit(mark), p["text"])))

        # Facets are tested in the order resource, action, subject: a broken pattern in an earlier one is reached
        # by requests that a later one does not match.
        steady = F.col("resources").isNull() | self._sound("resources")
        steady_actions = steady & (F.col("actions").isNull() | self._sound("actions"))
        by_folder = F.col("resources").isNotNull() & self._sound("resources") & ~F.array_contains(lead_routes, UNROUTED)
        routes = (
            F.when(by_folder, F.transform(lead_routes, lambda f: F.concat(F.lit(_FOLDER), f)))
            .when(steady_actions & literal("subjects"), named("subjects", _SUBJECT))
            .when(steady & literal("actions"), named("actions", _ACTION))
            .otherwise(F.array(F.lit(UNROUTED)))
        )
        return self.table.withColumn("__routes", routes).withColumn("__may", F.struct(
            self._sound("resources").alias("resources"),
            (steady_actions & F.coalesce(self._sound("subjects"), F.lit(False))).alias("subjects"),
        ))

    def _by_grams(self, policies: DataFrame) -> DataFrame:
        """Routes by the rarest gram of every pattern, for policies that have no other route.

        By resources first, else by subjects; each pattern of the facet must have a gram (or, of resources, a folder).
        """
        known = self.broadcastable()
        rarest = self.spark.createDataFrame(sorted(self.grams.items()), "text string, gram string") if known else self._rarest_grams()
        rarest = self.joinable(rarest)
        routed = policies
        for facet in ("resources", "subjects"):
            open_yet = F.array_contains("__routes", UNROUTED) & F.col(f"__may.{facet}") & F.col(facet).isNotNull()
            each = routed.select("__row", F.explode(F.when(open_yet, F.col(facet))).alias("p"))
            folder = folder_of(F.col("p.lead")) if facet == "resources" else F.lit(UNROUTED)
            each = each.select("__row", F.when(folder != UNROUTED, F.concat(F.lit(_FOLDER), folder)).alias("folder"), _written(F.col("p")).alias("text"))
            each = each.join(rarest, "text", "left")
            route = F.coalesce("folder", F.concat(F.lit(_GRAMS[facet]), "gram"))
            found = each.groupBy("__row").agg(
                F.collect_set(route).alias("__found"), F.max(route.isNull()).alias("__lacks")
            ).filter("NOT __lacks").drop("__lacks")  # as many routes as one policy has patterns
            routed = routed.join(self.joinable(found), "__row", "left")
            routed = routed.withColumn("__routes", F.coalesce("__found", "__routes")).drop("__found")
        return routed

    @cached_property
    def _routes(self) -> DataFrame:
        """The policies with all their ``__routes``."""
        table = self._without_grams()
        if self.broadcastable():
            return self._by_grams(table.withColumn("__row", F.monotonically_increasing_id())) if self.grams else table
        needed = table.filter(F.array_contains("__routes", UNROUTED)).limit(1).count()
        return written(self._by_grams(table) if needed else table)

    def routed(self, columns: list[str]) -> DataFrame:
        """Policies with one row for each route on which requests that they can match look for them.

        ``__route`` by folder, literal subject or action, else by the rarest gram of each pattern; a policy that has none
        of these is met by every request.  ``__routes`` is all of them: one request can meet a policy on several.
        """
        return self._routes.select(F.explode("__routes").alias("__route"), "__routes", *columns)

    @cached_property
    def _crowded(self) -> DataFrame | None:
        """``__route, __parts`` of the routes of a distributed set with many policies, a row for ``CROWD`` of them at most."""
        counted = self._routes.select(F.explode("__routes").alias("__route")).groupBy("__route").count()
        parts = F.ceil(F.col("count") / CROWD).cast("int").alias("__parts")
        found = counted.filter(F.col("count") > CROWD).select("__route", parts)
        return F.broadcast(found) if found.limit(1).count() else None

    def met(self, keys: DataFrame, columns: list[str]) -> DataFrame:
        """Keys, a row for each ``__route`` of theirs, with the policies on it.

        Few keys and policies can make very many pairs: policies of a crowded route are dealt into parts that keys meet
        one by one, in a fixed number of tasks.
        """
        table = self.routed(columns)
        if self.broadcastable() or self._crowded is None:
            return keys.join(self.joinable(table), "__route")
        parts = F.coalesce("__parts", F.lit(1))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = [c for c in ("rank", "valid_from") if c in table.columns]
        mine = keys.join(self._crowded, "__route", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
        theirs = table.join(self._crowded, "__route", "left").withColumn("__part", F.pmod(F.xxhash64(*own), parts).cast("int"))
        both = ["__route", "__part"]
        return mine.drop("__parts").repartition(tasks, *both).join(self.joinable(theirs.drop("__parts")), both).drop("__part")


def _written(p: Column) -> Column:
    """The pattern as it was written: the text of a prefix lacks its star."""
    return F.when(p["kind"] == patterns.PREFIX, F.concat(p["text"], F.lit("*"))).otherwise(p["text"])


def _marked(mark: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(mark), v))


_FACETS = ("resources", "actions", "subjects")


def sample_request(spark: SparkSession) -> DataFrame:
    """One made-up request, for trying expressions out."""
    return spark.range(1).selectExpr(
        "id AS request_id",
        "'someone@example.com' AS subject",
        "'s3://bucket/folder/file' AS resource",
        "'read' AS action",
        "'session' AS session_id",
        "TIMESTAMP '2024-01-01 00:00:00' AS request_ts",
        f"CAST(map() AS {schemas.ENVIRONMENT}) AS environment",
    )
