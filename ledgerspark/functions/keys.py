"""Canonical keys: maps can't be compared in joins, so dimensions and units become strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dims_key(dims: Column) -> Column:
    """A map as one string, independent of order; the empty string for null and empty maps."""
    pairs = F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, "|"), F.lit(""))


def normalized_dims(dims: Column, defaults: dict[str, str] | Column | None = None, ignored: tuple[str, ...] = ()) -> Column:
    """dims without ignored dimensions and without members that are their dimension's default."""
    kept = F.coalesce(dims, F.create_map().cast("map<string,string>"))
    if ignored:
        kept = F.map_filter(kept, lambda k, v: ~k.isin(*ignored))
    if defaults is None:
        return kept
    if isinstance(defaults, dict):
        if not defaults:
            return kept
        defaults = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    return F.map_filter(kept, lambda k, v: ~F.coalesce(v == F.element_at(defaults, k), F.lit(False)))


def typed_key(typed: Column) -> Column:
    return dims_key(F.map_filter(F.transform_values(typed, lambda k, v: F.trim(v)), lambda k, v: v != ""))


def period_key(period_type: Column, instant: Column, start: Column, end: Column) -> Column:
    return F.when(period_type == "instant", F.concat(F.lit("i:"), instant.cast("string"))).otherwise(F.concat(F.lit("d:"), start.cast("string"), F.lit("/"), end.cast("string")))


def s_equal_key(scheme: Column, entity: Column, period: Column, dims: Column, typed: Column, containers: Column | None = None) -> Column:
    """Contexts with this key in common are structurally equal: entity, period and members, segment and scenario apart."""
    if containers is not None:
        dims = F.transform_keys(dims, lambda k, v: F.concat(F.coalesce(F.element_at(containers, k), F.lit("scenario")), F.lit("#"), k))
        typed = F.transform_keys(typed, lambda k, v: F.concat(F.coalesce(F.element_at(containers, k), F.lit("scenario")), F.lit("#"), k))
    return F.concat_ws("\n", scheme, entity, period, dims_key(dims), typed_key(typed))


def context_id(canonical: Column) -> Column:
    """A context's name, made from its content."""
    return F.concat(F.lit("ctx_"), F.substring(F.sha2(canonical, 256), 1, 8))


def unit_signature(numerator: Column, denominator: Column) -> Column:
    """The multiset of a unit's measures, numerator and denominator apart."""
    join = lambda m: F.array_join(F.array_sort(F.coalesce(m, F.array().cast("array<string>"))), "*")
    return F.when(F.size(F.coalesce(denominator, F.array().cast("array<string>"))) > 0, F.concat(join(numerator), F.lit("/"), join(denominator))).otherwise(join(numerator))


def canonical_context(window_key: Column) -> Column:
    """The least context id of each structural-equality class; use with contexts of one filing per partition."""
    from pyspark.sql import Window

    return F.min("context_id").over(Window.partitionBy("instance_id", window_key))
