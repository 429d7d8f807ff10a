"""Value, existence and consistency assertions over bindings of facts to variables.

A binding takes one fact for each variable; a variable without a match takes none. By default all combinations
within a filing are bound; with match_on, facts bind only where they agree on those columns (context_id, unit_id),
which is an equi-join and the form to use on large filings. Existence never forms combinations.

evaluate() plans one assertion; evaluate_all() matches the variables of many in one pass over the facts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xpath import NUMBER, Scope, Unsupported, Value, compile_expression
from ..session import local_table, materialize
from .filters import VariableFilter, predicate
from .findings import finding, union

#: Columns of a bound fact.
FACT = ("fact_ord", "concept", "context_id", "unit_id", "value", "decimals", "precision", "period_type", "instant", "start", "end", "entity_id", "entity_scheme", "measure", "dims", "typed", "dims_key", "typed_key")


@dataclass(frozen=True)
class Assertion:
    assertion_id: str
    kind: str  # value, existence, consistency
    variables: Mapping[str, VariableFilter]
    expression: str = ""
    severity: str = "error"
    absolute_radius: str | None = None
    relative_radius: str | None = None
    customs: Mapping = None


def bind(facts: DataFrame, assertion: Assertion, match_on: Sequence[str] = ()) -> DataFrame:
    """instance_id, the columns of match_on, and a struct for each variable (null where none matches)."""
    keys = ["instance_id", *match_on]
    there = [c for c in FACT if c in facts.columns]
    chosen = {name: facts.where(predicate(f)).select(*keys, F.struct(*there).alias(f"v_{name}")) for name, f in assertion.variables.items()}
    if match_on:
        base = reduce(DataFrame.unionByName, [c.select(*keys) for c in chosen.values()]).distinct()
    else:
        base = facts.select(*keys).distinct()
    for name, rows in chosen.items():
        renamed = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), f"v_{name}")
        base = base.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    return base


class _Slot:
    """A variable's fact in a binding that has a column for each of its columns asked for; those of the keys are the binding's own."""

    def __init__(self, number: int, keys: Sequence[str], asked: set[str]):
        self.name, self.keys, self.asked = f"s{number}", keys, asked

    def isNotNull(self) -> Column:
        return F.col(f"{self.name}_there").isNotNull()

    def isNull(self) -> Column:
        return ~self.isNotNull()

    def getField(self, column: str) -> Column:
        if column in self.keys:
            return F.when(self.isNotNull(), F.col(column))
        self.asked.add(column)
        return F.col(f"{self.name}_{column}")

    def number(self) -> Column:
        """The fact's value as a number, read once a binding rather than by each expression."""
        return F.col(f"{self.name}_number")


def _read(text: Column) -> Column:
    return F.trim(text).try_cast(NUMBER)


class _First:
    """The first bound fact of some."""

    def __init__(self, facts: Sequence[Column | _Slot]):
        self.facts = facts

    def isNotNull(self) -> Column:
        return reduce(lambda a, b: a | b, (f.isNotNull() for f in self.facts), F.lit(False))

    def of(self, part: Callable[[Column | _Slot], Column]) -> Column:
        return reduce(lambda found, f: found.when(f.isNotNull(), part(f)), self.facts[1:], F.when(self.facts[0].isNotNull(), part(self.facts[0]))) if self.facts else F.lit(None)

    def getField(self, column: str) -> Column:
        return self.of(lambda f: f.getField(column))

    def number(self) -> Column:
        return self.of(lambda f: f.number() if isinstance(f, _Slot) else _read(f.getField("value")))


def _scope(assertion: Assertion, columns: Sequence[str], at: Mapping[str, Column | _Slot]) -> tuple[Scope, _First]:
    """What an expression may refer to, given what holds each variable's fact, and the first bound fact."""
    first = _First([at[n] for n in assertion.variables])

    def value(name: str, f: VariableFilter) -> Value:
        here = at[name]
        absent = F.lit(None).cast("string") if f.fallback == "()" else F.lit(f.fallback if f.fallback is not None else "0")
        number = F.when(here.isNotNull(), here.number()).otherwise(_read(absent)) if isinstance(here, _Slot) else None
        return Value("any", F.when(here.isNotNull(), here.getField("value")).otherwise(absent), fact=here, reported=number)

    variables = {n: value(n, f) for n, f in assertion.variables.items()}
    return Scope(variables, fact=lambda c: F.col(c) if c in columns else first.getField(c), customs=assertion.customs or {}), first


def _judged(assertion: Assertion, columns: Sequence[str], at: Mapping[str, Column | _Slot]) -> dict[str, Column]:
    """For a binding: whether it has a finding (keep), and the finding's status, message, concept and context."""
    scope, first = _scope(assertion, columns, at)
    about = {"concept": first.getField("concept"), "context_id": first.getField("context_id")} if assertion.variables else {c: F.lit(None).cast("string") for c in ("concept", "context_id")}
    if assertion.kind == "value":
        passed = F.coalesce(compile_expression(assertion.expression, scope).boolean(), F.lit(False))
        absent = [at[n].isNull() for n, f in assertion.variables.items() if f.fallback is None]
        none = reduce(lambda a, b: a & b, (at[n].isNull() for n in assertion.variables), F.lit(bool(assertion.variables)))
        skipped = reduce(lambda a, b: a | b, absent, none)
        return {"keep": F.lit(True), "status": F.when(skipped, "NOT_EVALUATED").when(passed, "PASS").otherwise("FAIL"), "message": F.lit(assertion.expression), **about}
    if not assertion.variables:
        raise Unsupported("a consistency assertion without variables has no fact to compare with")
    computed, actual = compile_expression(assertion.expression, scope).number(), first.number()
    apart = F.abs(computed - actual)
    if assertion.absolute_radius is not None:
        close = apart <= F.lit(assertion.absolute_radius).cast(NUMBER)
    elif assertion.relative_radius is not None:
        close = F.when(actual != 0, apart <= (F.lit(assertion.relative_radius).cast(NUMBER) * F.abs(actual)).cast(NUMBER)).otherwise(apart == 0)
    else:
        close = apart == 0
    text = F.concat(F.lit("computed "), computed.cast("string"), F.lit(", actual "), actual.cast("string"))
    return {"keep": first.isNotNull() & computed.isNotNull() & actual.isNotNull(), "status": F.when(close, "PASS").otherwise("FAIL"), "message": text, **about}


def _bound_findings(facts: DataFrame, assertion: Assertion, match_on: Sequence[str]) -> DataFrame:
    bound = bind(facts, assertion, match_on)
    judged = _judged(assertion, [c for c in bound.columns if not c.startswith("v_")], {n: F.col(f"v_{n}") for n in assertion.variables})
    rows = bound.where(judged.pop("keep"))
    return finding(rows, assertion.assertion_id, "formula", judged.pop("message"), assertion.severity, judged.pop("status"), **judged)


def value_findings(facts: DataFrame, assertion: Assertion, match_on: Sequence[str] = ()) -> DataFrame:
    """PASS, FAIL (also where the test can't be evaluated) or NOT_EVALUATED (an operand is missing without a
    fallback, or all are) for each binding."""
    return _bound_findings(facts, assertion, match_on)


def existence_findings(facts: DataFrame, assertion: Assertion) -> DataFrame:
    """PASS for each filing in which some variable has a match; FAIL for others."""
    any_match = reduce(lambda a, b: a | b, (predicate(f) for f in assertion.variables.values()), F.lit(False))
    found = facts.groupBy("instance_id").agg(F.bool_or(any_match).alias("found"))
    return finding(found, assertion.assertion_id, "formula", F.lit("existence"), assertion.severity, F.when(F.col("found"), "PASS").otherwise("FAIL"))


def consistency_findings(facts: DataFrame, assertion: Assertion, match_on: Sequence[str] = ()) -> DataFrame:
    """Compares the computed value with the first bound fact's, within the absolute radius, else the relative one,
    else exactly. Bindings without a fact or number are left out."""
    return _bound_findings(facts, assertion, match_on)


def evaluate(facts: DataFrame, assertion: Assertion, match_on: Sequence[str] = ()) -> DataFrame:
    """The findings of one assertion; one that can't be compiled is a finding of its own, once a filing."""
    try:
        if assertion.kind == "existence":
            return existence_findings(facts, assertion)
        return (value_findings if assertion.kind == "value" else consistency_findings)(facts, assertion, match_on)
    except Unsupported as error:
        return finding(facts.select("instance_id").distinct(), f"internal:{assertion.assertion_id}", "formula", F.lit(str(error)))


#: Assertions whose expressions share a CASE, and filters whose matches share a row for each fact and a folder.
TOGETHER = 16


class _Wanted:
    """The different filters of many variables, and the different conditions besides the concept among them."""

    def __init__(self):
        self.filters, self.rests = {}, {}

    def number(self, f: VariableFilter) -> int:
        """The filter's number; Unsupported if it can't be compiled."""
        f = replace(f, fallback=None)
        if repr(f) not in self.filters:
            other = replace(f, concept=None)
            if repr(other) not in self.rests:
                self.rests[repr(other)] = (len(self.rests), predicate(other))
            self.filters[repr(f)] = (len(self.filters), self.rests[repr(other)][0], f.concept)
        return self.filters[repr(f)][0]

    def matches(self, facts: DataFrame, keys: Sequence[str], asked: Sequence[str]) -> DataFrame:
        """(part, bits, keys, columns asked for): a row for each fact and TOGETHER filters, with a bit for each that it passes.

        Facts find the filters that want their concept by a join with the list of filters; those of any concept
        are tried on all. Filters of a part that differ in the concept alone share their condition.
        """
        shape, rests, wanted = "array<struct<part:int,masks:array<int>>>", {}, {}
        for number, rest, concept in self.filters.values():
            part = number // TOGETHER
            places = rests.setdefault(part, {})
            wanted.setdefault(concept, []).append((part, places.setdefault(rest, len(places)), 1 << number % TOGETHER))
        anyway = wanted.pop(None, [])

        def masks(entries: list) -> list[dict]:
            found = {}
            for part, place, bit in entries:
                found.setdefault(part, [0] * len(rests[part]))[place] |= bit
            return [{"part": part, "masks": m} for part, m in found.items()]

        always = F.array(*(F.struct(F.lit(m["part"]).alias("part"), F.array(*map(F.lit, m["masks"])).alias("masks")) for m in masks(anyway))).cast(shape)
        named = local_table(facts.sparkSession, [(concept, masks(entries + anyway)) for concept, entries in wanted.items()], f"concept string, _wanted {shape}")
        tried = facts.join(named, "concept", "left").withColumn("_w", F.explode(F.coalesce("_wanted", always)))
        conditions, bits = dict(self.rests.values()), F.when(F.lit(False), F.lit(0))
        for part, places in rests.items():
            held = ((F.get("_w.masks", F.lit(place)), conditions[rest]) for rest, place in places.items())
            bits = bits.when(F.col("_w.part") == part, reduce(lambda a, b: a.bitwiseOR(b), (F.when((mask != 0) & fits, mask).otherwise(0) for mask, fits in held)))
        # exploded, for a filter on an expression would have it evaluated twice
        return tried.select("_w.part", *keys, *asked, F.explode(F.array(bits)).alias("bits")).where("bits <> 0")


def _bound_together(matches: DataFrame, instances: DataFrame, bindings: Sequence[Sequence[int]], keys: Sequence[str], asked: Sequence[str]) -> DataFrame:
    """bind, keys and the columns of each slot's fact: the bindings of a few lists of filters."""
    spark, on = matches.sparkSession, ["bind", *keys]
    uses = [(number // TOGETHER, 1 << number % TOGETHER, bind, slot) for bind, numbers in enumerate(bindings) for slot, number in enumerate(numbers)]
    rows = matches.where(F.col("part").isin(*{u[0] for u in uses})).join(local_table(spark, uses, "part int, mask int, bind int, slot int"), "part").where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    if len(keys) > 1:
        base = rows.select(*on).distinct()
    else:
        base = instances.withColumn("bind", F.explode(F.array(*map(F.lit, range(len(bindings))))))
    slots = max(map(len, bindings))
    for slot in range(slots):
        held = rows.where(F.col("slot") == slot).select(*(F.col(k).alias(f"_{k}") for k in on), F.lit(True).alias(f"s{slot}_there"), *(F.col(c).alias(f"s{slot}_{c}") for c in asked))
        base = base.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on], "left").drop(*(f"_{k}" for k in on))
    # below the join with the assertions, so that it isn't done for each of them
    return base.withColumns({f"s{slot}_number": _read(_Slot(slot, keys, set()).getField("value")) for slot in range(slots)}) if slots else base


def _bound_findings_together(bound: DataFrame, rules: Sequence[tuple[int, Assertion, Mapping[str, Column]]], slots: int, keys: Sequence[str]) -> DataFrame:
    """Findings of a few (bind, assertion, what is judged of it), given the bindings."""
    ids = local_table(bound.sparkSession, [(bind, rule, a.assertion_id, a.severity) for rule, (bind, a, _) in enumerate(rules)], "bind int, rule int, rule_id string, severity string")

    def judged(name: str) -> Column:
        return reduce(lambda found, r: found.when(F.col("rule") == r[0], r[1][2][name]), enumerate(rules), F.when(F.lit(False), F.lit(None)))

    first = _First([_Slot(slot, keys, set()) for slot in range(slots)])
    rows = bound.join(ids, "bind").where(judged("keep"))
    return finding(rows, F.col("rule_id"), "formula", judged("message"), F.col("severity"), judged("status"), concept=first.getField("concept"), context_id=first.getField("context_id"))


def _existing_together(matches: DataFrame, instances: DataFrame, asked: Sequence[tuple[Assertion, Sequence[int]]]) -> DataFrame:
    """Findings of existence assertions with their filters' numbers: a filing's bits are joined to it once, whatever their number."""
    parts = sorted({number // TOGETHER for _, numbers in asked for number in numbers})
    if parts:
        found = matches.where(F.col("part").isin(*parts)).groupBy("instance_id").agg(*(F.bit_or(F.when(F.col("part") == p, F.col("bits"))).alias(f"b{p}") for p in parts))
        instances = instances.join(found, "instance_id", "left")
    rules = [(a.assertion_id, a.severity, *(sum({1 << n % TOGETHER for n in numbers if n // TOGETHER == p}) for p in parts)) for a, numbers in asked]
    each = instances.crossJoin(F.broadcast(local_table(instances.sparkSession, rules, ", ".join(["rule_id string, severity string", *(f"m{p} int" for p in parts)]))))
    hit = reduce(lambda a, p: a | F.coalesce(F.col(f"b{p}").bitwiseAND(F.col(f"m{p}")) != 0, F.lit(False)), parts, F.lit(False))
    return finding(each, F.col("rule_id"), "formula", F.lit("existence"), F.col("severity"), F.when(hit, "PASS").otherwise("FAIL"))


def _packed(bindings: Mapping[tuple[int, ...], list]) -> list[list[tuple[int, ...]]]:
    """Lists of filters that are bound in one plan: such as have TOGETHER assertions between them, or a single one with more."""
    packs, room = [], 0
    for numbers, rules in bindings.items():
        if not packs or len(rules) > room:
            packs.append([])
            room = TOGETHER
        packs[-1].append(numbers)
        room -= len(rules)
    return packs


def evaluate_all(facts: DataFrame, assertions: Sequence[Assertion], match_on: Sequence[str] = ()) -> DataFrame:
    """The findings that evaluate() gives for each assertion, from one pass over facts (and one over their instance ids).

    What filters match is written once, a row for each fact and TOGETHER filters with the columns that expressions
    ask for, and bound from there; facts that nothing asks for are never shuffled. Assertions on the same filters share
    their bindings, which meet the assertions after the last shuffle. Plans grow by one for each TOGETHER assertions.
    """
    if not assertions:
        return finding(facts.limit(0), "", "formula", F.lit(""))
    keys = ["instance_id", *match_on]
    instances = materialize(facts.select("instance_id").distinct(), "instances")
    wanted, bindings, existing, found, asked = _Wanted(), {}, [], [], set()
    for assertion in assertions:
        try:
            numbers = tuple(wanted.number(f) for f in assertion.variables.values())
            if assertion.kind == "existence":
                existing.append((assertion, numbers))
                continue
            here = {"concept", "context_id", "value"}
            judged = _judged(assertion, keys, {n: _Slot(i, keys, here) for i, n in enumerate(assertion.variables)})
            bindings.setdefault(numbers, []).append((assertion, judged))
            asked |= here
        except Unsupported as error:
            found.append(finding(instances, f"internal:{assertion.assertion_id}", "formula", F.lit(str(error))))
    fields = sorted(asked - set(keys))
    matches = materialize(wanted.matches(facts, keys, fields), "matches", by="part") if existing or bindings else None
    if existing:
        found.append(_existing_together(matches, instances, existing))
    for pack in _packed(bindings):
        slots = max(map(len, pack))
        bound = _bound_together(matches, instances, pack, keys, fields)
        rules = [(bind, assertion, judged) for bind, numbers in enumerate(pack) for assertion, judged in bindings[numbers]]
        found += [_bound_findings_together(bound, rules[at : at + TOGETHER], slots, keys) for at in range(0, len(rules), TOGETHER)]
    return union(found)


def enrich(facts: DataFrame, contexts: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Facts with what filters and expressions refer to: their context's columns and their unit's measure."""
    from ..functions.keys import dims_key, period_key, typed_key

    ctx = contexts.select("instance_id", "context_id", "entity_scheme", "entity_id", "period_type", "instant", "start", "end", "dims", "typed", dims_key(F.col("dims")).alias("dims_key"), typed_key(F.col("typed")).alias("typed_key"), period_key(F.col("period_type"), F.col("instant"), F.col("start"), F.col("end")).alias("period_key"))
    if units is None:
        return facts.join(ctx, ["instance_id", "context_id"], "left")
    # units first: what contexts add is the wider, and so crosses the network once
    measured = facts.join(units.select("instance_id", "unit_id", F.get("numerator", F.lit(0)).alias("measure")), ["instance_id", "unit_id"], "left")
    return measured.join(ctx, ["instance_id", "context_id"], "left").select("instance_id", *(c for c in measured.columns if c not in ("instance_id", "measure")), *(c for c in ctx.columns if c not in ("instance_id", "context_id")), "measure")


def filing_aggregates(contexts: DataFrame, indicators: DataFrame) -> DataFrame:
    """What expressions may ask of a filing as a whole: identifiers, dates and filing indicators, each once."""
    once = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    whole = contexts.groupBy("instance_id").agg(once("entity_id").alias("all_identifiers"), once("start").alias("all_starts"), once("end").alias("all_ends"), once("instant").alias("all_instants"))
    filed = indicators.groupBy("instance_id").agg(F.array_sort(F.collect_set(F.when(F.col("filed"), F.col("template")))).alias("filed"), F.array_sort(F.collect_set(F.when(~F.col("filed"), F.col("template")))).alias("not_filed"))
    return whole.join(filed, "instance_id", "left")
