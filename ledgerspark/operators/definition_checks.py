"""Structure of dimensional taxonomies: what may stand at either end of each kind of arc.

One table says which kind of element each end must or must not be; all arcs are checked in one pass by arrays of
problems, so the number of rules doesn't change the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import finding, union
from .graph import substitution_closure

#: Substitution groups of hypercubes and dimensions.
HYPERCUBE, DIMENSION = "{http://xbrl.org/2005/xbrldt}hypercubeItem", "{http://xbrl.org/2005/xbrldt}dimensionItem"
#: Fixed values: (arcrole, end, the kinds allowed there, the error's name); other is any other concept.
ENDS = (
    ("hypercube-dimension", "source", ("hypercube",), "HypercubeDimensionSourceError"),
    ("hypercube-dimension", "target", ("dimension",), "HypercubeDimensionTargetError"),
    ("all", "source", ("other",), "HasHypercubeSourceError"),
    ("all", "target", ("hypercube",), "HasHypercubeTargetError"),
    ("notAll", "source", ("other",), "HasHypercubeSourceError"),
    ("notAll", "target", ("hypercube",), "HasHypercubeTargetError"),
    ("dimension-domain", "source", ("dimension",), "DimensionDomainSourceError"),
    ("dimension-domain", "target", ("other",), "DimensionDomainTargetError"),
    ("domain-member", "source", ("other",), "DomainMemberSourceError"),
    ("domain-member", "target", ("other",), "DomainMemberTargetError"),
    ("dimension-default", "source", ("dimension",), "DimensionDefaultSourceError"),
    ("dimension-default", "target", ("other",), "DimensionDefaultTargetError"),
)
WITH_ROLE = ("hypercube-dimension", "all", "notAll", "dimension-domain", "domain-member")


def kinds(concepts: DataFrame) -> DataFrame:
    """(concept, kind, abstract): hypercube or dimension by the chain of substitution groups, else other."""
    reached = substitution_closure(concepts.where("substitution_group IS NOT NULL").select("concept", "substitution_group"), (HYPERCUBE, DIMENSION))
    named = reached.groupBy("concept").agg(F.max(F.col("root") == HYPERCUBE).alias("cube"))
    kind = F.when(F.col("cube").isNull(), "other").when(F.col("cube"), "hypercube").otherwise("dimension")
    return concepts.select("concept", "abstract").join(named, "concept", "left").select("concept", kind.alias("kind"), F.coalesce("abstract", F.lit(False)).alias("abstract"))


def validate(concepts: DataFrame, arcs: DataFrame, declared_roles: DataFrame | None = None) -> DataFrame:
    """All xbrldte findings. arcs as schemas.DEFINITION_ARC with short arcroles; declared_roles: role."""
    known = kinds(concepts)
    abstract = known.where("kind <> 'other' AND NOT abstract")
    rule = F.when(F.col("kind") == "hypercube", "xbrldte:HypercubeElementIsNotAbstractError").otherwise("xbrldte:DimensionElementIsNotAbstractError")
    ends = arcs.join(known.select(F.col("concept").alias("source"), F.col("kind").alias("source_kind")), "source", "left").join(known.select(F.col("concept").alias("target"), F.col("kind").alias("target_kind")), "target", "left")
    wrong = [F.when((F.col("arcrole") == role) & F.col(f"{end}_kind").isNotNull() & ~F.col(f"{end}_kind").isin(*allowed), F.lit(f"xbrldte:{name}")) for role, end, allowed, name in ENDS]
    wrong.append(F.when(F.col("arcrole").isin("all", "notAll") & F.col("context_element").isNull(), F.lit("xbrldte:HasHypercubeMissingContextElementAttributeError")))
    if declared_roles is not None:
        ends = ends.join(declared_roles.select(F.col("role").alias("target_role"), F.lit(True).alias("declared")).distinct(), "target_role", "left")
        wrong.append(F.when(F.col("arcrole").isin(*WITH_ROLE) & F.col("target_role").isNotNull() & F.col("declared").isNull(), F.lit("xbrldte:TargetRoleNotResolvedError")))
    problems = ends.withColumn("rule", F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())))
    many = arcs.where("arcrole = 'dimension-default'").groupBy("source").agg(F.count_distinct("target").alias("n")).where("n > 1")
    say = F.concat_ws(" ", "elr", "source", "target")
    return union(
        [
            finding(abstract, rule, "taxonomy", F.col("concept")),
            finding(problems, F.col("rule"), "taxonomy", say, concept=F.col("source")),
            finding(many, "xbrldte:TooManyDefaultMembersError", "taxonomy", F.col("source"), dimension=F.col("source")),
        ]
    )


def first_violation(found: DataFrame) -> DataFrame:
    """The one finding that a loader which stops at the first would report."""
    return found.orderBy("rule_id", "message").limit(1)
