"""Structural rules on facts, contexts and units of many filings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import canonical_context, unit_signature
from ..functions.scalars import is_numeric_type
from ..schemas import ISO4217, XBRLI
from .findings import finding, union


def with_canonical_contexts(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """facts with context_id replaced by the least id of its structural-equality class; unresolved ones go."""
    canonical = contexts.select("instance_id", "context_id", canonical_context(F.col("s_equal_key")).alias("canonical"))
    return facts.join(canonical, ["instance_id", "context_id"]).withColumn("context_id", F.col("canonical")).drop("canonical")


def missing_schema_refs(instances: DataFrame) -> DataFrame:
    return finding(instances.where(F.coalesce(F.trim("schema_ref"), F.lit("")) == ""), "structural:missing-schemaref", "structural", F.lit("The filing names no taxonomy."))


def incomplete_contexts(contexts: DataFrame) -> DataFrame:
    period = F.when(F.col("period_type") == "instant", F.col("instant").isNull()).otherwise(F.col("start").isNull() | F.col("end").isNull())
    bad = contexts.where(F.col("entity_id").isNull() | F.col("period_type").isNull() | period)
    return finding(bad, "structural:incomplete-context", "structural", F.concat(F.lit("Entity or period is missing in "), F.col("context_id")))


def unresolved_contexts(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    bad = facts.join(contexts.select("instance_id", "context_id"), ["instance_id", "context_id"], "left_anti")
    return finding(bad, "structural:unresolved-context-ref", "structural", F.concat(F.lit("No such context: "), F.coalesce("context_id", F.lit(""))))


def period_mismatches(facts: DataFrame, contexts: DataFrame, concepts: DataFrame) -> DataFrame:
    known = concepts.select("concept", F.col("period_type").alias("asked"))
    joined = facts.join(contexts.select("instance_id", "context_id", "period_type"), ["instance_id", "context_id"]).join(known, "concept")
    bad = joined.where(F.col("asked") != F.col("period_type"))
    return finding(bad, "structural:period-type-mismatch", "structural", F.concat(F.lit("Wants "), F.col("asked"), F.lit(", context has "), F.col("period_type")))


def unresolved_units(facts: DataFrame, units: DataFrame, concepts: DataFrame) -> DataFrame:
    numeric = concepts.where(is_numeric_type(F.col("data_type"))).select("concept")
    bad = facts.join(numeric, "concept", "left_semi").join(units.select("instance_id", "unit_id"), ["instance_id", "unit_id"], "left_anti")
    return finding(bad, "structural:unresolved-unit-ref", "structural", F.concat(F.lit("No such unit: "), F.coalesce("unit_id", F.lit("(none)"))))


def _measured(facts: DataFrame, units: DataFrame, concepts: DataFrame) -> DataFrame:
    traits = concepts.select("concept", F.col("data_type"), (F.col("monetary") if "monetary" in concepts.columns else F.lower("data_type").contains("monetaryitemtype")).alias("monetary"))
    return facts.join(units.select("instance_id", "unit_id", "form", "numerator", "denominator"), ["instance_id", "unit_id"]).join(traits, "concept", "left")


def monetary_units(facts: DataFrame, units: DataFrame, concepts: DataFrame) -> DataFrame:
    """Monetary facts need one ISO 4217 measure and no division."""
    one = F.element_at("numerator", 1)
    good = (F.col("form") == "simple") & (F.size("numerator") == 1) & one.rlike("^\\{" + ISO4217.replace(".", "\\.") + "\\}[A-Z]{3}$")
    bad = _measured(facts, units, concepts).where(F.coalesce("monetary", F.lit(False)) & ~F.coalesce(good, F.lit(False)))
    return finding(bad, "structural:monetary-unit-measure", "structural", F.concat(F.lit("No single currency: "), unit_signature(F.col("numerator"), F.col("denominator"))))


def unit_consistency(facts: DataFrame, units: DataFrame, concepts: DataFrame) -> DataFrame:
    """Measures of the base namespace other than pure and shares; share items in other units; units that cancel."""
    none = F.array().cast("array<string>")
    rows = _measured(facts, units, concepts).withColumn("over", F.coalesce("numerator", none)).withColumn("under", F.coalesce("denominator", none))
    odd = F.filter(F.concat("over", "under"), lambda m: F.startswith(m, F.lit(f"{{{XBRLI}}}")) & ~m.isin(f"{{{XBRLI}}}pure", f"{{{XBRLI}}}shares"))
    share = (F.col("data_type") == f"{{{XBRLI}}}sharesItemType") & ~((F.col("form") == "simple") & (F.col("over") == F.array(F.lit(f"{{{XBRLI}}}shares"))))
    cancels = (F.col("form") == "divide") & F.arrays_overlap("over", "under")
    problems = F.concat(F.transform(odd, lambda m: F.concat(F.lit("measure "), m)), F.when(F.coalesce(share, F.lit(False)), F.array(F.lit("shares expected"))).otherwise(none), F.when(cancels, F.array(F.lit("not in simplest form"))).otherwise(none))
    return finding(rows.withColumn("problem", F.explode(problems)), "structural:unit-consistency", "structural", F.col("problem"))


def decimals_problem(numeric: Column) -> Column:
    """What is wrong with a fact's decimals and precision; null if nothing is."""
    d, p, nil = F.col("decimals").isNotNull(), F.col("precision").isNotNull(), F.coalesce("is_nil", F.lit(False))
    return (
        F.when(nil & (d | p), "a nil fact has decimals or precision")
        .when(nil & F.col("unit_id").isNotNull() & ~numeric, "a nil fact of a type that is not numeric has a unit")
        .when(nil | ~numeric, F.lit(None))
        .when(d & p, "both decimals and precision")
        .when(~d & ~p, "neither decimals nor precision")
    )


def decimals_precision(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    typed = facts.join(concepts.select("concept", is_numeric_type(F.col("data_type")).alias("numeric")), "concept", "left")
    bad = typed.withColumn("problem", decimals_problem(F.coalesce("numeric", F.lit(False)))).where("problem IS NOT NULL")
    return finding(bad, "structural:decimals-precision", "structural", F.col("problem"))


def conflicting_duplicates(facts: DataFrame) -> DataFrame:
    """Facts of one concept, canonical context and unit with different values as written."""
    values = facts.groupBy("instance_id", "concept", "context_id", "unit_id").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    bad = values.where("least <> most")
    return finding(bad, "structural:duplicate-fact", "structural", F.concat(F.lit("Values from "), F.col("least"), F.lit(" to "), F.col("most")))


def foreign_context_elements(elements: DataFrame, concept_roots: DataFrame) -> DataFrame:
    """Elements (instance_id, context_id, element) in a segment or scenario that substitute an item or tuple."""
    reported = concept_roots.where(F.col("root").isin(f"{{{XBRLI}}}item", f"{{{XBRLI}}}tuple")).select(F.col("concept").alias("element"))
    bad = elements.join(reported, "element", "left_semi")
    return finding(bad, "structural:segment-scenario-substitution", "structural", F.concat(F.lit("In a context: "), F.col("element")))


def essence_alias_units(facts: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts of an (essence, alias) pair in one canonical context whose units differ."""
    signed = facts.join(units.select("instance_id", "unit_id", unit_signature(F.col("numerator"), F.col("denominator")).alias("signature")), ["instance_id", "unit_id"], "left").select("instance_id", "context_id", "concept", "unit_id", "signature")
    essence = signed.join(pairs, F.col("concept") == F.col("essence")).select("instance_id", "context_id", "concept", "alias", F.col("signature").alias("a"), F.col("unit_id").alias("unit_a"))
    alias = signed.join(pairs.select(F.col("alias").alias("concept")).distinct(), "concept", "left_semi").select("instance_id", "context_id", F.col("concept").alias("alias"), F.col("signature").alias("b"), F.col("unit_id").alias("unit_b"))
    bad = essence.join(alias, ["instance_id", "context_id", "alias"]).where(~F.col("a").eqNullSafe(F.col("b"))).dropDuplicates(["instance_id", "context_id", "concept", "alias", "unit_a", "unit_b"])
    return finding(bad, "structural:essence-alias-unit", "structural", F.concat_ws(" ", F.col("alias"), F.coalesce("a", F.lit("(none)")), F.coalesce("b", F.lit("(none)"))))


def validate(instances: DataFrame, facts: DataFrame, contexts: DataFrame, units: DataFrame, concepts: DataFrame) -> DataFrame:
    return union(
        [
            missing_schema_refs(instances), incomplete_contexts(contexts), unresolved_contexts(facts, contexts), period_mismatches(facts, contexts, concepts), unresolved_units(facts, units, concepts),
            monetary_units(facts, units, concepts), unit_consistency(facts, units, concepts), decimals_precision(facts, concepts), conflicting_duplicates(with_canonical_contexts(facts, contexts)),
        ]
    )
