"""Variable filters as one column predicate over facts joined to their contexts.

Rows are expected to have concept, period_type, measure, dims and typed. Filters combine by and; the
planner pushes what it can to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xpath import compile_filter


@dataclass(frozen=True)
class DimensionFilter:
    dim: str
    members: tuple[str, ...] = ()
    exclude: bool = False


@dataclass(frozen=True)
class TypedFilter:
    dim: str
    exclude: bool = False


@dataclass(frozen=True)
class BooleanFilter:
    kind: str  # and, or
    children: tuple = ()
    complement: bool = False


@dataclass(frozen=True)
class VariableFilter:
    concept: str | None = None
    period_type: str | None = None
    unit: str | None = None
    dimensions: Sequence[DimensionFilter] = ()
    typed: Sequence[TypedFilter] = ()
    booleans: Sequence[BooleanFilter] = ()
    xpaths: Sequence[str] = ()
    fallback: str | None = None
    namespaces: dict = field(default_factory=dict)


def _in(dim: str, members: Sequence[str]) -> Column:
    return F.coalesce(F.element_at("dims", dim).isin(*members), F.lit(False))


def _has(column: str, dim: str) -> Column:
    return F.coalesce(F.map_contains_key(column, dim), F.lit(False))


def dimension_predicate(f: DimensionFilter, nested: bool = False) -> Column:
    """Includes want a listed member, or any where none is listed. Excludes drop listed members and keep facts
    without the dimension; without members they keep all, but inside a boolean filter they want it absent."""
    if not f.exclude:
        return _in(f.dim, f.members) if f.members else _has("dims", f.dim)
    if f.members:
        return ~_in(f.dim, f.members)
    return ~_has("dims", f.dim) if nested else F.lit(True)


def typed_predicate(f: TypedFilter) -> Column:
    return ~_has("typed", f.dim) if f.exclude else _has("typed", f.dim)


def boolean_predicate(f: BooleanFilter) -> Column:
    parts = [boolean_predicate(c) if isinstance(c, BooleanFilter) else typed_predicate(c) if isinstance(c, TypedFilter) else dimension_predicate(c, nested=True) for c in f.children]
    whole = reduce((lambda a, b: a & b) if f.kind == "and" else (lambda a, b: a | b), parts) if parts else F.lit(True)
    return ~whole if f.complement else whole


def predicate(f: VariableFilter) -> Column:
    parts = []
    if f.concept is not None:
        parts.append(F.col("concept") == f.concept)
    if f.period_type is not None:
        parts.append(F.coalesce(F.col("period_type") == f.period_type, F.lit(False)))
    if f.unit is not None:
        parts.append(F.coalesce(F.contains("measure", F.lit(f.unit)), F.lit(False)))
    parts += [dimension_predicate(d) for d in f.dimensions]
    parts += [typed_predicate(t) for t in f.typed]
    parts += [boolean_predicate(b) for b in f.booleans]
    # a filter that can't be evaluated for a fact keeps it
    parts += [F.coalesce(compile_filter(x), F.lit(True)) for x in f.xpaths]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def select(facts: DataFrame, f: VariableFilter) -> DataFrame:
    return facts.where(predicate(f))


def with_set_filters(f: VariableFilter, shared: VariableFilter) -> VariableFilter:
    """f with the filters of its assertion set, except where it has one on the same aspect."""
    from dataclasses import replace

    own = {d.dim for d in f.dimensions}
    return replace(f, concept=f.concept or shared.concept, period_type=f.period_type or shared.period_type, dimensions=[*f.dimensions, *(d for d in shared.dimensions if d.dim not in own)])
