"""Dimensional validity: do a fact's members fit the hypercubes that cover its concept?

Facts share few combinations of concept and members, so combinations are judged once each and only the wrong
ones are joined back to facts. Taxonomy relations are small; the planner broadcasts them while they are.

cubes: cube (unique), arcrole (all or notAll), closed, context_element, cube_ord. cube_items: cube, concept.
cube_dims: cube, dim, dim_ord. cube_members: cube, dim, member, the declared usable members. dimensions: dim,
dim_type, default_member; one without a row there has no model, so its members aren't checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import dims_key, normalized_dims
from ..session import materialize
from .findings import finding, union
from .graph import member_network

INVALID = "xbrldie:PrimaryItemDimensionallyInvalidError"
#: Fixed value: the substitution group of dimension elements.
DIMENSION_ITEM = "{http://xbrl.org/2005/xbrldt}dimensionItem"


def scoped_members(cube_dims: DataFrame, domain_arcs: DataFrame, member_arcs: DataFrame) -> DataFrame:
    """(cube, dim, member): usable members under a cube's dimension. cube_dims: cube, dim, elr; arcs as in
    schemas.DEFINITION_ARC, domain arcs from dimensions to domains, member arcs below."""
    heads = cube_dims.join(domain_arcs.select(F.col("elr"), F.col("source").alias("dim"), F.col("target").alias("member"), F.coalesce("target_role", "elr").alias("in_role"), F.coalesce("usable", F.lit(True)).alias("usable")), ["elr", "dim"])
    reached = member_network(heads.select("cube", "dim", F.col("in_role").alias("elr"), "member"), member_arcs)
    unusable = domain_arcs.where("NOT coalesce(usable, true)").select(F.col("target").alias("member")).unionByName(member_arcs.where("NOT coalesce(usable, true)").select(F.col("target").alias("member"))).distinct()
    return reached.select("cube", "dim", "member").distinct().join(unusable, "member", "left_anti")


def patterns(facts: DataFrame, contexts: DataFrame, ignored: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Facts with the key of their members, and each combination of concept and members once."""
    keyed = contexts.select("instance_id", "context_id", normalized_dims(F.col("dims"), ignored=ignored).alias("members"))
    keyed = keyed.withColumn("members_key", dims_key(F.col("members")))
    joined = facts.join(keyed, ["instance_id", "context_id"])
    combos = joined.groupBy("concept", "members_key").agg(F.first("members").alias("members"))
    return joined.drop("members"), combos


def judge(combos: DataFrame, cubes: DataFrame, cube_items: DataFrame, cube_dims: DataFrame, cube_members: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(concept, members_key, cube, dim, constraint_type): what is wrong with each combination."""
    names = F.array().cast("array<string>")
    with_model = cube_dims.join(dimensions.select("dim", "default_member", F.lit(True).alias("known")), "dim", "left")
    shape = with_model.groupBy("cube").agg(
        F.sort_array(F.collect_list(F.struct("dim_ord", "dim")))["dim"].alias("dims"),
        F.collect_list(F.when(F.col("default_member").isNull(), F.col("dim"))).alias("required"),
        F.collect_list(F.when(F.col("known"), F.col("dim"))).alias("checked"),
    )
    full = cubes.join(shape, "cube", "left").withColumns({c: F.coalesce(c, names) for c in ("dims", "required", "checked")})
    covering = materialize(cube_items.join(full, "cube"), "covering")
    expected = covering.where("arcrole = 'all'").groupBy("concept").agg(F.array_distinct(F.flatten(F.collect_list("dims"))).alias("expected"))
    # written, so that the planner knows the taxonomy's size; combinations alone may be many
    met = combos.join(materialize(covering.join(expected, "concept", "left"), "covering"), "concept")
    used = F.map_keys("members")
    undeclared = F.when(F.col("closed"), F.array_except(used, F.coalesce("expected", names))).otherwise(names)
    missing = F.array_except("required", used)
    each = met.withColumn("undeclared", undeclared).withColumn("missing", missing)
    pairs = each.select("concept", "members_key", "cube", F.explode(F.map_entries(F.map_filter("members", lambda k, v: F.array_contains("checked", k)))).alias("e"))
    pairs = pairs.select("concept", "members_key", "cube", F.col("e.key").alias("dim"), F.col("e.value").alias("member"))
    bad = pairs.join(cube_members.select("cube", "dim", "member"), ["cube", "dim", "member"], "left_anti")
    bad = bad.groupBy("concept", "members_key", "cube").agg(F.sort_array(F.collect_list("dim")).alias("invalid"))
    judged = each.join(bad, ["concept", "members_key", "cube"], "left").withColumn("invalid", F.coalesce("invalid", names))
    positive = judged.where("arcrole = 'all'").withColumn("errors", F.size("undeclared") + F.size("missing") + F.size("invalid"))
    best = Window.partitionBy("concept", "members_key").orderBy("errors", "cube_ord", "cube")
    chosen = positive.withColumn("nth", F.row_number().over(best)).where("nth = 1 AND errors > 0")
    kinds = (("undeclared", "UNDECLARED_DIMENSION"), ("invalid", "INVALID_MEMBER"), ("missing", "CLOSED_MISSING_DIMENSION"))
    problems = F.flatten(F.array(*(F.transform(c, _problem(kind)) for c, kind in kinds)))
    wrong = chosen.select("concept", "members_key", "cube", F.explode(problems).alias("p")).select("concept", "members_key", "cube", "p.dim", "p.constraint_type")
    # a forbidden combination has all of the cube's dimensions, each with a model and a declared member
    negative = judged.where("arcrole = 'notAll' AND size(dims) > 0 AND size(invalid) = 0").where((F.size(F.array_except("dims", used)) == 0) & (F.size(F.array_except("dims", "checked")) == 0))
    forbidden = negative.select("concept", "members_key", "cube", F.element_at("dims", 1).alias("dim"), F.lit("PROHIBITED_COMBINATION").alias("constraint_type"))
    return wrong.unionByName(forbidden)


def _problem(kind: str):
    return lambda d: F.struct(d.alias("dim"), F.lit(kind).alias("constraint_type"))


def fact_findings(facts: DataFrame, contexts: DataFrame, cubes: DataFrame, cube_items: DataFrame, cube_dims: DataFrame, cube_members: DataFrame, dimensions: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The findings of each fact, from its combination's."""
    keyed, combos = patterns(facts, contexts, ignored)
    wrong = judge(combos, cubes, cube_items, cube_dims, cube_members, dimensions)
    rows = keyed.join(wrong, ["concept", "members_key"])
    return finding(rows, INVALID, "dimensional", F.concat_ws(" ", "constraint_type", "dim", "cube"), hypercube=F.col("cube"), dimension=F.col("dim"))


def container_mismatches(facts: DataFrame, contexts: DataFrame, cubes: DataFrame, cube_items: DataFrame, cube_dims: DataFrame) -> DataFrame:
    """Members in a part of the context (segment or scenario) that no covering cube of their dimension accepts."""
    accepted = cube_items.join(cubes.where("arcrole = 'all'"), "cube").join(cube_dims, "cube").groupBy("concept", "dim").agg(F.collect_set("context_element").alias("accepted"), F.min_by("cube", "cube_ord").alias("cube"))
    placed = contexts.select("instance_id", "context_id", F.explode(F.map_entries("containers")).alias("e")).select("instance_id", "context_id", F.col("e.key").alias("dim"), F.col("e.value").alias("container"))
    bad = facts.join(placed, ["instance_id", "context_id"]).join(accepted, ["concept", "dim"]).where(~F.array_contains("accepted", F.col("container")))
    return finding(bad, INVALID, "dimensional", F.concat_ws(" ", "dim", "container"), hypercube=F.col("cube"), dimension=F.col("dim"), constraint_type=F.lit("CONTEXT_ELEMENT_MISMATCH"))


def _members(contexts: DataFrame, column: str) -> DataFrame:
    return contexts.select("instance_id", "context_id", F.explode(F.map_entries(column)).alias("e")).select("instance_id", "context_id", F.col("e.key").alias("dim"), F.col("e.value").alias("member"))


def context_findings(contexts: DataFrame, concepts: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Members of what is no dimension of their kind, unknown members, defaults that are reported."""
    groups = concepts.select(F.col("concept").alias("dim"), "substitution_group", F.col("typed_domain").isNotNull().alias("typed"))
    explicit, typed = _members(contexts, "dims").join(groups, "dim", "left"), _members(contexts, "typed").join(groups, "dim", "left")
    no_explicit = explicit.where(~F.coalesce((F.col("substitution_group") == DIMENSION_ITEM) & ~F.col("typed"), F.lit(False)))
    no_typed = typed.where(~F.coalesce((F.col("substitution_group") == DIMENSION_ITEM) & F.col("typed"), F.lit(False)))
    known = concepts.select(F.col("concept").alias("member"))
    names = concepts.select(F.regexp_extract("concept", "^\\{([^}]*)\\}", 1).alias("ns")).distinct()
    # only dimensions of namespaces that the taxonomy knows: others may come from elsewhere
    unknown = _members(contexts, "dims").withColumn("ns", F.regexp_extract("dim", "^\\{([^}]*)\\}", 1)).join(names, "ns", "left_semi").join(known, "member", "left_anti")
    defaults = _members(contexts, "dims").join(dimensions.where("default_member IS NOT NULL"), "dim").where("member = default_member")
    say = F.concat_ws(" ", "dim", "member")
    return union(
        [
            finding(no_explicit, "xbrldie:ExplicitMemberNotExplicitDimensionError", "dimensional", say, dimension=F.col("dim")),
            finding(no_typed, "xbrldie:TypedMemberNotTypedDimensionError", "dimensional", say, dimension=F.col("dim")),
            finding(unknown, "xbrldie:ExplicitMemberUndefinedQNameError", "dimensional", say, dimension=F.col("dim")),
            finding(defaults, "xbrldie:DefaultValueUsedInInstanceError", "dimensional", say, dimension=F.col("dim")),
        ]
    )


def repeated_dimensions(members: DataFrame) -> DataFrame:
    """Dimensions that one context gives twice; members: instance_id, context_id, dim (as shredded)."""
    bad = members.groupBy("instance_id", "context_id", "dim").agg(F.count("*").alias("n")).where("n > 1")
    return finding(bad, "xbrldie:RepeatedDimensionInInstanceError", "dimensional", F.col("dim"), dimension=F.col("dim"))


def too_many_defaults(default_arcs: DataFrame) -> DataFrame:
    """(dim, defaults): dimensions with more than one default member; arcs: source, target."""
    return default_arcs.groupBy(F.col("source").alias("dim")).agg(F.array_sort(F.collect_set("target")).alias("defaults")).where("size(defaults) > 1")


def validate(facts: DataFrame, contexts: DataFrame, concepts: DataFrame, cubes: DataFrame, cube_items: DataFrame, cube_dims: DataFrame, cube_members: DataFrame, dimensions: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    return union(
        [
            context_findings(contexts, concepts, dimensions),
            fact_findings(facts, contexts, cubes, cube_items, cube_dims, cube_members, dimensions, ignored),
            container_mismatches(facts, contexts, cubes, cube_items, cube_dims),
        ]
    )


def global_members(domain_arcs: DataFrame, member_arcs: DataFrame) -> DataFrame:
    """(dim, member, usable): members of each dimension whatever the link role; repeats of an arc must all be usable.

    Dimensions without a domain arc have no rows, hence no model.
    """
    from .graph import closure, usable_members

    arcs = usable_members(domain_arcs.select("source", "target", "usable").unionByName(member_arcs.select("source", "target", "usable")))
    edges = arcs.select(F.col("source").alias("member"), F.col("target").alias("to_member"))
    seeds = domain_arcs.select(F.col("source").alias("dim"), F.col("target").alias("member")).distinct()
    reached = closure(seeds, edges, ["member"])
    flags = arcs.groupBy(F.col("target").alias("member")).agg(F.bool_and("usable").alias("usable"))
    return reached.join(flags, "member").select("dim", "member", "usable").distinct()
