"""Links: ends of arcs that nothing is, references declared twice, elements where none belong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import XBRLI
from .findings import finding, union


def open_arcs(arcs: DataFrame, locators: DataFrame, resources: DataFrame) -> DataFrame:
    """Arcs with an end that no locator or resource of their link has."""
    ends = locators.select("link", "label").unionByName(resources.select("link", "label")).distinct()
    sides = arcs.select("link", "elr", F.explode(F.array("source", "target")).alias("label"))
    return finding(sides.join(ends, ["link", "label"], "left_anti"), "xlink:validation-error", "linkbase", F.concat_ws(" ", F.lit("No end"), "label", "elr"))


def lost_locators(locators: DataFrame, ids: DataFrame) -> DataFrame:
    """Locators of fragments that no element of the file has, in files that are known; ids: file, fragment."""
    known = locators.join(ids.select("file").distinct(), "file", "left_semi")
    bad = known.where("fragment <> ''").join(ids, ["file", "fragment"], "left_anti")
    return finding(bad, "xbrl:linkbase-reference-error", "linkbase", F.concat_ws("#", "file", "fragment"))


def repeated_references(references: DataFrame) -> DataFrame:
    """Role and arcrole references that a document makes twice; references: path, how, file, fragment."""
    twice = references.where(F.col("how").isin("roleRef", "arcroleRef")).groupBy("path", "how", "file", "fragment").agg(F.count("*").alias("n")).where("n > 1")
    rule = F.when(F.col("how") == "roleRef", "xbrl:duplicate-role-ref").otherwise("xbrl:duplicate-arcrole-ref")
    return finding(twice, rule, "linkbase", F.concat_ws("#", "file", "fragment"), instance_id=F.col("path"))


def base_elements_in_contexts(elements: DataFrame) -> DataFrame:
    """Elements of the base namespace inside a segment or scenario; elements: instance_id, context_id, element."""
    bad = elements.where(F.startswith("element", F.lit(f"{{{XBRLI}}}")))
    return finding(bad, "structural:segment-scenario-substitution", "structural", F.col("element"))


def tuple_attributes(elements: DataFrame, tuples: DataFrame) -> DataFrame:
    """Tuples that carry attributes of the base or link namespaces; elements: instance_id, concept, attributes array."""
    bad = elements.join(tuples.select("concept"), "concept", "left_semi").where(F.exists("attributes", lambda a: F.startswith(a, F.lit(f"{{{XBRLI}}}")) | F.startswith(a, F.lit("{http://www.w3.org/1999/xlink}"))))
    return finding(bad, "xbrl:schema-validation-error", "structural", F.col("concept"))


def element_constraints(elements: DataFrame, roots: DataFrame) -> DataFrame:
    """Items without a period type and tuples with one; elements: concept, period_type; roots: concept, root."""
    joined = elements.join(roots, "concept")
    item = (F.col("root") == f"{{{XBRLI}}}item") & F.col("period_type").isNull()
    tuple_ = (F.col("root") == f"{{{XBRLI}}}tuple") & F.col("period_type").isNotNull()
    return finding(joined.where(item | tuple_), "xbrl:schema-validation-error", "taxonomy", F.when(item, "an item without a period type").otherwise("a tuple with a period type"))


def lax_values(values: DataFrame) -> DataFrame:
    """Attribute values of known integer, language and space kinds that don't fit; values: instance_id, kind, value."""
    fits = F.when(F.col("kind") == "integer", F.col("value").rlike("^\\s*[+-]?\\d+\\s*$")).when(F.col("kind") == "lang", F.col("value").rlike("^([a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*)?$")).when(F.col("kind") == "space", F.col("value").isin("default", "preserve")).otherwise(True)
    return finding(values.where(~fits), "xmlschema:lax-validation-error", "taxonomy", F.concat_ws(" ", "kind", "value"))


def validate(arcs: DataFrame, locators: DataFrame, resources: DataFrame, references: DataFrame, ids: DataFrame) -> DataFrame:
    return union([open_arcs(arcs, locators, resources), lost_locators(locators, ids), repeated_references(references)])
