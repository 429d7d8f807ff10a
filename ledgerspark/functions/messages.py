"""Messages of assertions: texts whose {expressions} are evaluated for each binding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .xpath import Scope, Unsupported, compile_expression

PLACE = re.compile(r"\{((?:[^{}]|\{[^{}]*\})*)\}")


def render(template: str, scope: Scope, passed: Column | None = None, test: str = "") -> Column:
    """The template with its places filled. If one can't be compiled, the test is shown with its variables' values
    and, where it is known, the verdict."""
    try:
        parts, at = [], 0
        for place in PLACE.finditer(template):
            parts += [F.lit(template[at : place.start()]), F.coalesce(compile_expression(place[1], scope).text(), F.lit(""))]
            at = place.end()
        return F.concat(*parts, F.lit(template[at:]))
    except Unsupported:
        return fallback(test or template, scope, passed)


def fallback(test: str, scope: Scope, passed: Column | None = None) -> Column:
    """The test's text with variables replaced by their values, and TRUE or FALSE."""
    parts, at = [], 0
    for name in re.finditer(r"\$([\w.:-]+)", test):
        known = scope.variables.get(name[1])
        parts += [F.lit(test[at : name.start()]), F.coalesce(known.text(), F.lit("()")) if known else F.lit(name[0])]
        at = name.end()
    parts.append(F.lit(test[at:]))
    return F.concat(*parts) if passed is None else F.concat(*parts, F.when(passed, " TRUE").otherwise(" FALSE"))


def filter_text(f) -> str:
    """What a variable filter asks for, in words."""
    said = []
    if f.concept:
        said.append(f"concept {f.concept}")
    if f.period_type:
        said.append(f"{f.period_type} period")
    if f.unit:
        said.append(f"unit with {f.unit}")
    for d in f.dimensions:
        said.append(f"{d.dim} {'not ' if d.exclude else ''}{'in ' + ', '.join(d.members) if d.members else 'present'}")
    for t in f.typed:
        said.append(f"{t.dim} {'absent' if t.exclude else 'present'}")
    said += [f"{b.kind} of {len(b.children)} filters{' (complement)' if b.complement else ''}" for b in f.booleans]
    said += list(f.xpaths)
    return "; ".join(said)
