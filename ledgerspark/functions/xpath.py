"""Expressions of assertions and filters, compiled to columns.

The supported part of XPath 2.0: literals, $variables, the context item, sequences, arithmetic, value and general
comparisons, and, or, if, for and quantifiers over one or more sequences, cast as, castable as, instance of, and
the functions of FUNCTIONS. What is not
supported raises Unsupported when the expression is compiled; nothing passes silently. Arithmetic and casts that
fail at run time give null, which callers read as they must (a failed test, a kept fact).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"


class Unsupported(ValueError):
    """An expression outside the supported part of the language."""


@dataclass
class Value:
    """A compiled expression: kind is number, string, boolean, date, dateTime, any (a reported lexical value) or sequence."""

    kind: str
    column: Column
    items: list[Value] | None = None
    fact: Column | None = None
    #: a reported value's number where it has been read before
    reported: Column | None = None

    def number(self) -> Column:
        if self.reported is not None:
            return self.reported
        if self.kind == "number":
            return self.column
        if self.kind == "boolean":
            return self.column.cast("int").cast(NUMBER)
        if self.kind == "sequence":
            return F.get(self.array(), F.lit(0)).try_cast(NUMBER)
        return F.trim(self.column.cast("string")).try_cast(NUMBER)

    def text(self) -> Column:
        if self.kind == "number":
            plain = F.regexp_replace(self.column.cast("string"), "(\\.\\d*?)0+$", "$1")
            return F.regexp_replace(plain, "\\.$", "")
        if self.kind == "sequence":
            return F.coalesce(F.get(self.array(), F.lit(0)), F.lit(""))
        if self.kind == "dateTime":
            return F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss")
        return self.column.cast("string")

    def boolean(self) -> Column:
        if self.kind == "boolean":
            return self.column
        if self.kind == "number":
            return self.column != 0
        if self.kind == "sequence":
            return F.size(self.array()) > 0
        return F.when(self.column.isNull(), F.lit(False)).otherwise(~F.lower(self.column.cast("string")).isin("", "false", "0"))

    def array(self) -> Column:
        """The items as texts, absent ones left out."""
        if self.items is not None:
            parts = [i.array() if i.kind == "sequence" else F.array(i.text()) for i in self.items]
            return F.filter(F.concat(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
        return self.column if self.kind == "sequence" else F.filter(F.array(self.text()), lambda x: x.isNotNull())


@dataclass
class Scope:
    """What an expression may refer to: variables by name, and the columns of the current fact."""

    variables: Mapping[str, Value] = field(default_factory=dict)
    item: Value | None = None
    fact: Callable[[str], Column] = F.col
    customs: Mapping[tuple[str, int], tuple[tuple[str, ...], str]] = field(default_factory=dict)
    inside: tuple = ()


TOKENS = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')|\$(?P<variable>[\w.:-]+)
    |(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?)|(?P<sign><=|>=|!=|<<|>>|\|\||[-+*/=<>(),.\[\]|?]))""",
    re.X,
)
#: Binding strength of binary operators.
BINARY = {"or": 1, "and": 2, "eq": 3, "ne": 3, "lt": 3, "le": 3, "gt": 3, "ge": 3, "=": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "to": 4, "+": 5, "-": 5, "*": 6, "div": 6, "idiv": 6, "mod": 6}
COMPARE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = re.sub(r"\(:.*?:\)", " ", text, flags=re.S).rstrip()
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m or m.end() == at:
            raise Unsupported(f"can't read {text[at:at + 20]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return found


class Parser:
    """Compiles as it parses, by operator precedence."""

    def __init__(self, text: str, scope: Scope):
        self.tokens, self.at, self.scope = [*tokens(text), ("end", "")], 0, scope

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def next(self, expected: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if expected is not None and token[1] != expected:
            raise Unsupported(f"{expected!r} expected, not {token[1]!r}")
        self.at += 1
        return token

    def whole(self) -> Value:
        value = self.expression()
        if self.peek()[0] != "end":
            raise Unsupported(f"unexpected {self.peek()[1]!r}")
        return value

    def expression(self, least: int = 1) -> Value:
        left = self.unary()
        while (power := BINARY.get(self.peek()[1], 0)) >= least and self.peek()[0] in ("sign", "name"):
            sign = self.next()[1]
            left = binary(sign, left, self.expression(power + 1))
        return left

    def unary(self) -> Value:
        kind, text = self.peek()
        if kind == "sign" and text in "+-":
            self.next()
            value = self.unary().number()
            return Value("number", -value if text == "-" else value)
        if kind == "name" and text == "if" and self.tokens[self.at + 1][1] == "(":
            return self.conditional()
        if kind == "name" and text in ("some", "every") and self.tokens[self.at + 1][0] == "variable":
            return self.quantified()
        if kind == "name" and text == "for" and self.tokens[self.at + 1][0] == "variable":
            return self.each()
        value = self.primary()
        while self.peek() in (("name", "cast"), ("name", "castable"), ("name", "instance")):
            which = self.next()[1]
            self.next("of" if which == "instance" else "as")
            name = self.next()[1]
            if self.peek()[1] == "?":
                self.next()
            value = {"cast": lambda v, n: call(n, [v], self.scope), "castable": castable, "instance": instance_of}[which](value, name)
        return value

    def conditional(self) -> Value:
        self.next()
        self.next("(")
        test = self.expression().boolean()
        self.next(")")
        self.next("then")
        yes = self.expression()
        self.next("else")
        no = self.expression()
        if yes.kind == no.kind and yes.kind in ("number", "boolean", "date"):
            return Value(yes.kind, F.when(test, yes.column).otherwise(no.column))
        if {yes.kind, no.kind} <= {"number", "any"}:
            return Value("number", F.when(test, yes.number()).otherwise(no.number()))
        return Value("any", F.when(test, yes.text()).otherwise(no.text()))

    def bound(self, over: Callable[[Column, Callable[[Column], Column]], Column], end: str, body: Callable[[], Column]) -> Column:
        """body over all combinations of items of the sequences that follow; a sequence may refer to variables before it."""
        name = self.next()[1]
        self.next("in")
        items = self.expression().array()

        def inside(x: Column) -> Column:
            outer = self.scope
            self.scope = Scope({**outer.variables, name: Value("any", x)}, outer.item, outer.fact, outer.customs, outer.inside)
            if self.peek()[1] == ",":
                self.next()
                found = self.bound(over, end, body)
            else:
                self.next(end)
                found = body()
            self.scope = outer
            return found

        return over(items, inside)

    def quantified(self) -> Value:
        over = F.exists if self.next()[1] == "some" else F.forall
        return Value("boolean", self.bound(over, "satisfies", lambda: self.expression().boolean()))

    def each(self) -> Value:
        self.next()
        return Value("sequence", self.bound(lambda items, f: F.flatten(F.transform(items, f)), "return", lambda: self.expression().array()))

    def primary(self) -> Value:
        kind, text = self.next()
        if kind == "number":
            return Value("number", F.lit(text).cast(NUMBER))
        if kind == "string":
            return Value("string", F.lit(text[1:-1].replace(text[0] * 2, text[0])))
        if kind == "variable":
            if text not in self.scope.variables:
                raise Unsupported(f"unknown variable ${text}")
            return self.scope.variables[text]
        if (kind, text) == ("sign", "."):
            if self.scope.item is None:
                raise Unsupported("no context item")
            return self.scope.item
        if (kind, text) == ("sign", "("):
            items = self.arguments()
            return items[0] if len(items) == 1 else Value("sequence", F.lit(None), items)
        if kind == "name" and self.peek()[1] == "(":
            self.next()
            return call(text, self.arguments(), self.scope)
        raise Unsupported(f"unexpected {text!r}")

    def arguments(self) -> list[Value]:
        items: list[Value] = []
        while self.peek()[1] != ")":
            items.append(self.expression())
            if self.peek()[1] != ")":
                self.next(",")
        self.next(")")
        return items


def compare(sign: str, a: Column, b: Column) -> Column:
    return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[sign]()


def compared(sign: str, a: Value, b: Value) -> Column:
    """Numbers compare as numbers, dates as dates, reported values as numbers where both are some, else as text."""
    kinds = {a.kind, b.kind}
    if "boolean" in kinds:
        return compare(sign, a.boolean(), b.boolean())
    if "number" in kinds:
        return compare(sign, a.number(), b.number())
    if "dateTime" in kinds:
        return compare(sign, a.column.cast("string").try_cast("timestamp_ntz"), b.column.cast("string").try_cast("timestamp_ntz"))
    if "date" in kinds:
        return compare(sign, a.column.cast("string").try_cast("date"), b.column.cast("string").try_cast("date"))
    if kinds == {"string"} or "string" in kinds:
        return compare(sign, a.text(), b.text())
    both = a.number().isNotNull() & b.number().isNotNull()
    return F.when(both, compare(sign, a.number(), b.number())).otherwise(compare(sign, a.text(), b.text()))


#: Spark's types of atomic types.
ATOMIC = {"xs:decimal": NUMBER, "xs:double": "double", "xs:float": "float", "xs:integer": NUMBER, "xs:int": "int", "xs:boolean": "boolean", "xs:date": "date", "xs:dateTime": "timestamp_ntz", "xs:string": "string"}


def castable(value: Value, name: str) -> Value:
    if name not in ATOMIC:
        raise Unsupported(f"unknown type {name}")
    text = F.trim(value.text())
    fits = text.try_cast(ATOMIC[name]).isNotNull()
    if name in ("xs:integer", "xs:int"):
        fits = fits & F.regexp_like(text, F.lit("^[-+]?[0-9]+$"))
    if name in ("xs:date", "xs:dateTime"):
        fits = fits & F.regexp_like(text, F.lit("^-?[0-9]{4}-[0-9]{2}-[0-9]{2}" + ("T.*$" if name == "xs:dateTime" else "$")))
    return Value("boolean", F.coalesce(fits, F.lit(False)))


def instance_of(value: Value, name: str) -> Value:
    """By the kind that the expression was compiled to; reported values count as what they can be read as."""
    if name not in ATOMIC:
        raise Unsupported(f"unknown type {name}")
    if value.kind in ("any", "number"):
        return castable(value, name) if name not in ("xs:string", "xs:boolean") or value.kind == "any" else Value("boolean", F.lit(False))
    return Value("boolean", F.lit({"string": "xs:string", "boolean": "xs:boolean", "date": "xs:date", "dateTime": "xs:dateTime"}.get(value.kind) == name))


def binary(sign: str, a: Value, b: Value) -> Value:
    if sign in ("and", "or"):
        return Value("boolean", a.boolean() & b.boolean() if sign == "and" else a.boolean() | b.boolean())
    if sign in COMPARE:
        return Value("boolean", compared(COMPARE[sign], a, b))
    if sign in COMPARE.values():
        if a.kind != "sequence" and b.kind != "sequence":
            return Value("boolean", compared(sign, a, b))
        # general comparison: some pair of items
        return Value("boolean", F.exists(a.array(), lambda x: F.exists(b.array(), lambda y: compared(sign, Value("any", x), Value("any", y)))))
    if sign == "to":
        return Value("sequence", F.transform(F.sequence(a.number().cast("int"), b.number().cast("int")), lambda i: i.cast("string")))
    x, y = a.number(), b.number()
    whole = {
        "+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y), "div": lambda: F.try_divide(x, y),
        "idiv": lambda: F.try_divide(x, y), "mod": lambda: F.try_mod(x, y),
    }[sign]()
    if sign == "idiv":
        whole = F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole))
    return Value("number", whole.try_cast(NUMBER))


def _number(f: Callable[..., Column]) -> Callable:
    return lambda args, scope: Value("number", f(*(a.number() for a in args)).cast(NUMBER))


def _string(f: Callable[..., Column]) -> Callable:
    return lambda args, scope: Value("string", f(*(F.coalesce(a.text(), F.lit("")) for a in args)))


def _boolean(f: Callable[..., Column]) -> Callable:
    return lambda args, scope: Value("boolean", f(*(F.coalesce(a.text(), F.lit("")) for a in args)))


def _numbers(args: list[Value]) -> Column:
    return F.transform(Value("sequence", F.lit(None), args).array(), lambda x: F.trim(x).try_cast(NUMBER))


def _sum(args: list[Value], scope: Scope) -> Value:
    return Value("number", F.aggregate(_numbers(args[:1]), F.lit(0).cast(NUMBER), lambda acc, x: F.try_add(acc, x).cast(NUMBER)))


def _average(args: list[Value], scope: Scope) -> Value:
    return Value("number", F.try_divide(_sum(args, scope).column, F.size(_numbers(args[:1])).cast(NUMBER)).cast(NUMBER))


def _fact(name: str, kind: str = "string") -> Callable:
    return lambda args, scope: Value(kind, scope.fact(name))


def _fixed(kind: str, make: Callable[[], Column]) -> Callable:
    return lambda args, scope: Value(kind, make())


def _same(*names: str) -> Callable:
    """Equality of facts in the named columns; an argument that is no fact stands for the current one."""

    def equal(args: list[Value], scope: Scope) -> Value:
        side = lambda v, n: v.fact.getField(n) if v.fact is not None else scope.fact(n)
        one = lambda n: side(args[0], n).eqNullSafe(side(args[1], n))
        return Value("boolean", reduce(lambda a, b: a & b, [one(n) for n in names]))

    return equal


def _all_same(args: list[Value], scope: Scope) -> Value:
    items = Value("sequence", F.lit(None), args[:1]).array()
    return Value("boolean", F.size(F.array_distinct(items)) <= 1)


def _member(args: list[Value], scope: Scope, column: str) -> Column:
    return F.element_at(scope.fact(column), args[-1].text())


def _contains_key(column: str) -> Callable:
    return lambda args, scope: Value("boolean", F.coalesce(F.map_contains_key(scope.fact(column), args[-1].text()), F.lit(False)))


def _value_of(column: str) -> Callable:
    return lambda args, scope: Value("string", F.coalesce(_member(args, scope, column), F.lit("")))


def _member_is(args: list[Value], scope: Scope) -> Value:
    return Value("boolean", F.coalesce(F.element_at(scope.fact("dims"), args[-2].text()) == args[-1].text(), F.lit(False)))


def _within(column: str) -> Callable:
    return lambda args, scope: Value("boolean", F.coalesce(F.array_contains(scope.fact(column), args[-1].text()), F.lit(False)))


def _single(column: str) -> Callable:
    return lambda args, scope: Value("any", F.when(F.size(scope.fact(column)) == 1, F.get(scope.fact(column), F.lit(0))))


def _format_number(args: list[Value], scope: Scope) -> Value:
    x, picture = args[0].number(), args[1].text()
    # places are what is left behind the last point without its closing signs, as in the behaviour to match
    places = F.length(F.regexp_replace(F.regexp_extract(picture, "\\.([^.]*)$", 1), "[0#]+$", ""))
    plain = F.replace(F.call_function("format_number", x, places), F.lit(","), F.lit(""))
    return Value("string", F.when(F.contains(picture, F.lit(",")), F.format_number(x, 2)).when(F.contains(picture, F.lit(".")), plain).otherwise(x.cast("bigint").cast("string")))


EMPTY = _fixed("sequence", lambda: F.array().cast("array<string>"))
NOTHING = _fixed("string", lambda: F.lit(""))
FALSE = _fixed("boolean", lambda: F.lit(False))

FUNCTIONS: dict[str, Callable[[list[Value], Scope], Value]] = {
    "abs": _number(F.abs), "floor": _number(F.floor), "ceiling": _number(F.ceil), "number": _number(lambda x: x),
    "round": _number(lambda x: F.floor(x + F.lit("0.5").cast(NUMBER))), "round-half-to-even": lambda a, s: Value("number", F.bround(a[0].number(), 0).cast(NUMBER)),
    "sum": _sum, "avg": _average, "count": lambda a, s: Value("number", F.size(Value("sequence", F.lit(None), a).array()).cast(NUMBER)),
    "max": lambda a, s: Value("number", F.array_max(_numbers(a))), "min": lambda a, s: Value("number", F.array_min(_numbers(a))),
    "empty": lambda a, s: Value("boolean", F.size(Value("sequence", F.lit(None), a).array()) == 0), "exists": lambda a, s: Value("boolean", F.size(Value("sequence", F.lit(None), a).array()) > 0),
    "not": lambda a, s: Value("boolean", ~a[0].boolean()), "boolean": lambda a, s: Value("boolean", a[0].boolean()), "true": _fixed("boolean", lambda: F.lit(True)), "false": FALSE,
    "distinct-values": lambda a, s: Value("sequence", F.array_distinct(Value("sequence", F.lit(None), a).array())),
    "string": _string(lambda x: x), "concat": _string(F.concat), "string-length": lambda a, s: Value("number", F.length(F.coalesce(a[0].text(), F.lit(""))).cast(NUMBER)),
    "normalize-space": _string(lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), "upper-case": _string(F.upper), "lower-case": _string(F.lower),
    "contains": _boolean(F.contains), "starts-with": _boolean(F.startswith), "ends-with": _boolean(F.endswith), "matches": _boolean(lambda x, p: F.regexp_like(x, p)),
    "replace": _string(lambda x, p, r: F.regexp_replace(x, p, r)), "translate": lambda a, s: Value("string", F.call_function("translate", *(v.text() for v in a))),
    "substring": lambda a, s: Value("string", F.substring(a[0].text(), a[1].number().cast("int"), a[2].number().cast("int") if len(a) > 2 else F.lit(2**31 - 1))),
    "string-join": lambda a, s: Value("string", F.array_join(a[0].array(), "") if len(a) < 2 else F.call_function("array_join", a[0].array(), a[1].text())),
    "xs:decimal": _number(lambda x: x), "xs:double": _number(lambda x: x), "xs:float": _number(lambda x: x), "xs:integer": _number(F.floor), "xs:int": _number(F.floor),
    "xs:string": _string(lambda x: x), "xs:boolean": lambda a, s: Value("boolean", a[0].boolean()), "xs:date": lambda a, s: Value("date", a[0].text().try_cast("date")),
    "QName": lambda a, s: Value("string", F.concat(F.lit("{"), a[0].text(), F.lit("}"), F.regexp_replace(a[1].text(), "^.*:", ""))),
    "year-from-date": lambda a, s: Value("number", F.year(a[0].column.cast("date")).cast(NUMBER)), "month-from-date": lambda a, s: Value("number", F.month(a[0].column.cast("date")).cast(NUMBER)), "day-from-date": lambda a, s: Value("number", F.day(a[0].column.cast("date")).cast(NUMBER)),
    # periods, entities, units and numeric properties of the current fact
    "xfi:context": _fact("context_id"), "xfi:is-instant-period": lambda a, s: Value("boolean", s.fact("period_type") == "instant"), "xfi:is-forever-period": FALSE,
    "xfi:period-instant": _fact("instant", "date"), "xfi:period-start": _fact("start", "date"), "xfi:period-end": _fact("end", "date"),
    "xfi:decimals": lambda a, s: Value("number", F.coalesce(s.fact("decimals").try_cast("int"), F.lit(0)).cast(NUMBER)), "xfi:precision": lambda a, s: Value("number", F.coalesce(s.fact("precision").try_cast("int"), F.lit(0)).cast(NUMBER)),
    "xfi:is-numeric": lambda a, s: Value("boolean", s.fact("unit_id").isNotNull()), "xfi:is-non-numeric": lambda a, s: Value("boolean", s.fact("unit_id").isNull()), "xfi:is-fraction": FALSE,
    "xfi:unit-numerator": lambda a, s: Value("sequence", F.array(s.fact("measure"))),
    # dimensions of the current fact
    "xfi:fact-has-explicit-dimension": _contains_key("dims"), "xfi:fact-has-typed-dimension": _contains_key("typed"), "xfi:fact-has-explicit-dimension-value": _member_is, "xfi:fact-dimension-s-equal": _member_is,
    "xfi:fact-explicit-dimension-value": _value_of("dims"), "xfi:fact-typed-dimension-value": _value_of("typed"), "xfi:fact-typed-dimension-simple-value": _value_of("typed"),
    "xfi:fact-explicit-dimensions": lambda a, s: Value("sequence", F.map_keys(s.fact("dims"))), "xfi:fact-typed-dimensions": lambda a, s: Value("sequence", F.map_keys(s.fact("typed"))),
    "xfi:fact-dimension-s-equal2": _same("dims_key", "typed_key"),
    # equality of facts
    "xfi:v-equal": lambda a, s: Value("boolean", F.when(a[0].number().isNotNull() & a[1].number().isNotNull(), a[0].number() == a[1].number()).otherwise(a[0].text() == a[1].text())),
    "xfi:start-equal": _same("start"), "xfi:end-equal": _same("end"), "xfi:u-equal": _same("unit_id"), "xfi:identical-nodes": _same("fact_ord"), "xfi:s-equal": _same("context_id", "unit_id", "value"), "xfi:x-equal": _same("context_id", "unit_id", "value"),
    # the filing as a whole: columns that the binding carries as arrays
    "xfi:facts": lambda a, s: Value("sequence", s.fact("all_facts")), "xfi:any-identifier": lambda a, s: Value("any", F.get(s.fact("all_identifiers"), F.lit(0))),
    "xfi:unique-identifiers": lambda a, s: Value("sequence", s.fact("all_identifiers")), "xfi:single-unique-identifier": _single("all_identifiers"), "xfi:distinct-entity-strings": lambda a, s: Value("sequence", s.fact("all_identifiers")),
    "xfi:positive-filing-indicators": lambda a, s: Value("sequence", s.fact("filed")), "xfi:negative-filing-indicators": lambda a, s: Value("sequence", s.fact("not_filed")), "xfi:positive-filing-indicator": _within("filed"), "xfi:negative-filing-indicator": _within("not_filed"),
    "xfi:format-number": _format_number, "xfi:concept-label": _string(lambda x: x), "xfi:concept-data-type-derived-from": FALSE,
    "iaf:sum": _sum, "iaf:error-margin": _fixed("number", lambda: F.lit(0).cast(NUMBER)), "iaf:numeric-add": _number(lambda a, b: a + b), "iaf:numeric-unary-minus": _number(lambda a: -a),
    "iaf:numeric-equal": lambda a, s: Value("boolean", F.abs(a[0].number() - a[1].number()) <= (a[2].number() if len(a) > 2 else F.lit(0).cast(NUMBER))),
    "iaf:numeric-less-equal-than": lambda a, s: Value("boolean", a[0].number() <= a[1].number() + (a[2].number() if len(a) > 2 else F.lit(0).cast(NUMBER))),
    "iaf:numeric-greater-equal-than": lambda a, s: Value("boolean", a[0].number() >= a[1].number() - (a[2].number() if len(a) > 2 else F.lit(0).cast(NUMBER))),
    "efn:imp": lambda a, s: Value("boolean", ~a[0].boolean() | a[1].boolean()), "efn:iff": lambda a, s: Value("boolean", a[0].boolean().eqNullSafe(a[1].boolean())),
}
FUNCTIONS["xs:dateTime"] = lambda a, s: Value("dateTime", a[0].text().try_cast("timestamp_ntz"))
for _part in ("year", "month", "day", "hours", "minutes", "seconds"):
    FUNCTIONS[f"{_part}-from-dateTime"] = lambda a, s, f=getattr(F, _part.removesuffix("s")): Value("number", f(a[0].column.cast("timestamp_ntz")).cast(NUMBER))
FUNCTIONS["substring-before"] = _string(lambda x, y: F.when(F.contains(x, y), F.call_function("left", x, F.call_function("instr", x, y) - 1)).otherwise(F.lit("")))
FUNCTIONS["substring-after"] = _string(lambda x, y: F.when(F.contains(x, y), F.call_function("substring", x, F.call_function("instr", x, y) + F.length(y))).otherwise(F.lit("")))
for _names, _call in (
    ("xfi:context-period xfi:period", _fact("period_key")),
    ("xfi:is-duration-period xfi:is-start-end-period", lambda a, s: Value("boolean", s.fact("period_type") == "duration")),
    ("xfi:entity xfi:context-entity xfi:identifier xfi:context-identifier xfi:entity-identifier xfi:identifier-value xfi:fact-identifier-value", _fact("entity_id")),
    ("xfi:identifier-scheme xfi:fact-identifier-scheme", _fact("entity_scheme")),
    ("xfi:unit xfi:measure-name", _fact("measure")),
    ("xfi:segment xfi:entity-segment xfi:context-segment xfi:scenario xfi:context-scenario xfi:unit-denominator xfi:fact-segment-remainder xfi:fact-scenario-remainder xfi:taxonomy-refs xfi:linkbase-link-roles xfi:fact-footnotes xfi:concept-relationships xfi:distinct-nonAbstract-parent-concepts xfi:concept-substitutions xfi:filter-member-network-selection xfi:items-in-tuple xfi:tuples-in-tuple", EMPTY),
    ("xfi:arcrole-definition xfi:role-definition xfi:relationship-from-concept xfi:relationship-to-concept xfi:relationship-attribute xfi:relationship-link-attribute xfi:relationship-name xfi:relationship-link-name xfi:concept-balance xfi:concept-period-type xfi:concept-custom-attribute xfi:concept-data-type", NOTHING),
    ("xfi:c-equal xfi:p-equal xfi:pc-equal xfi:duplicate-tuple", _same("context_id")),
    ("xfi:cu-equal xfi:pcu-equal xfi:duplicate-item", _same("context_id", "unit_id")),
    ("xfi:identical-node-set xfi:s-equal-set xfi:v-equal-set xfi:c-equal-set xfi:u-equal-set", _all_same),
):
    FUNCTIONS |= dict.fromkeys(_names.split(), _call)
for _date in ("start", "end", "instant"):
    FUNCTIONS[f"xfi:any-{_date}-date"] = lambda a, s, d=_date: Value("any", F.get(s.fact(f"all_{d}s"), F.lit(0)))
    FUNCTIONS[f"xfi:unique-{_date}-dates"] = lambda a, s, d=_date: Value("sequence", s.fact(f"all_{d}s"))
    FUNCTIONS[f"xfi:single-unique-{_date}-date"] = _single(f"all_{_date}s")


def call(name: str, args: list[Value], scope: Scope) -> Value:
    custom = scope.customs.get((name, len(args)))
    if custom is not None:
        if name in scope.inside:
            raise Unsupported(f"{name} calls itself")
        names, body = custom
        inner = Scope(dict(zip(names, args, strict=True)), scope.item, scope.fact, scope.customs, (*scope.inside, name))
        return Parser(body, inner).whole()
    found = FUNCTIONS.get(name) or FUNCTIONS.get(name.removeprefix("fn:"))
    if found is None:
        raise Unsupported(f"unknown function {name}()")
    try:
        return found(args, scope)
    except (IndexError, TypeError) as error:
        raise Unsupported(f"{name}() doesn't take {len(args)} arguments") from error


def compile_expression(text: str, scope: Scope | None = None) -> Value:
    return Parser(text, scope or Scope()).whole()


def compile_filter(text: str, column: str = "value") -> Column:
    """A filter on a fact: its value is the context item; null where it can't be evaluated."""
    return compile_expression(text, Scope(item=Value("any", F.col(column)))).boolean()


def called_functions(text: str) -> set[str]:
    """Names that an expression calls."""
    found = tokens(text)
    return {a[1] for a, b in zip(found, found[1:]) if a[0] == "name" and b[1] == "(" and a[1] not in ("if", "in", "return", "then", "else", "satisfies", "and", "or")}


def needed_functions(text: str, bodies: Mapping[str, str]) -> set[str]:
    """Custom functions that an expression calls, directly or through others."""
    needed, open_ = set(), [text]
    while open_:
        new = {n for n in called_functions(open_.pop()) if n in bodies and n not in needed}
        needed |= new
        open_ += [bodies[n] for n in new]
    return needed
