"""Recursive operators over edge tables: closures, member networks, trees.

A closure grows by a frontier: join it with the edges, drop what is visited already (so cycles end), repeat
until nothing is new. The rounds are as many as the network is deep; each is a join and an anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_table, materialize

#: The four roots that make an element a concept, in Clark form.
CONCEPT_ROOTS = ("{http://www.xbrl.org/2003/instance}item", "{http://www.xbrl.org/2003/instance}tuple", "{http://xbrl.org/2005/xbrldt}hypercubeItem", "{http://xbrl.org/2005/xbrldt}dimensionItem")


def closure(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], depth: bool = False) -> DataFrame:
    """All states reached from seeds, themselves included.

    seeds: columns `keys` and any others, which name the start and stay. edges: a column for each key, and one
    called to_<key> for each key of the state it leads to. With depth, a column of that name counts the steps.
    """
    keys = list(keys)
    start = [c for c in seeds.columns if c not in keys]
    steps = edges.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(f"to_{k}") for k in keys)).distinct()
    steps = materialize(steps, "steps")
    level = 0
    frontier = materialize(seeds.select(*start, *keys).distinct().withColumn("depth", F.lit(level)), "frontier")
    visited = frontier
    while not frontier.isEmpty():
        level += 1
        met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        reached = frontier.drop("depth").join(steps, met).select(*start, *(F.col(f"to_{k}").alias(k) for k in keys)).distinct()
        old = visited.select(*(F.col(c).alias(f"_{c}") for c in [*start, *keys]))
        new = reached.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*start, *keys]], "left_anti")
        frontier = materialize(new.withColumn("depth", F.lit(level)), "frontier")
        visited = visited.unionByName(frontier)
    return visited if depth else visited.drop("depth")


def substitution_closure(candidates: DataFrame, roots: Sequence[str] = CONCEPT_ROOTS) -> DataFrame:
    """(concept, root): elements (concept, substitution_group) whose chain of heads reaches a root."""
    spark = candidates.sparkSession
    heads = local_table(spark, [(r, r) for r in roots], "root string, concept string")
    edges = candidates.select(F.col("substitution_group").alias("concept"), F.col("concept").alias("to_concept"))
    return closure(heads, edges, ["concept"]).where(~F.col("concept").isin(*roots)).select("concept", "root")


def member_edges(arcs: DataFrame) -> DataFrame:
    """Domain-member arcs as edges of (elr, member) states; a target role moves on to that link role."""
    return arcs.select("elr", F.col("source").alias("member"), F.coalesce("target_role", "elr").alias("to_elr"), F.col("target").alias("to_member"))


def member_network(heads: DataFrame, arcs: DataFrame) -> DataFrame:
    """Every member under each head (elr, member and columns that name it), over link roles, cycles cut."""
    return closure(heads, member_edges(arcs), ["elr", "member"])


def usable_members(arcs: DataFrame) -> DataFrame:
    """(source, target, usable): repeats of an arc are usable only if all of them are."""
    return arcs.groupBy("source", "target").agg(F.bool_and(F.coalesce("usable", F.lit(True))).alias("usable"))


def roots(arcs: DataFrame, parent: str = "parent", child: str = "child", within: Sequence[str] = ("elr",)) -> DataFrame:
    """Parents that are nobody's child, by network."""
    parents = arcs.select(*within, F.col(parent).alias("node")).distinct()
    return parents.join(arcs.select(*within, F.col(child).alias("node")).distinct(), [*within, "node"], "left_anti")


def active_arcs(arcs: DataFrame, within: Sequence[str] = ("elr",)) -> DataFrame:
    """Arcs that are neither prohibited nor cancelled by a prohibited twin of their network and key."""
    banned = arcs.where("use = 'prohibited' AND eq_key IS NOT NULL").select(*within, "eq_key").distinct()
    return arcs.where(F.coalesce(F.col("use"), F.lit("optional")) != "prohibited").join(banned, [*within, "eq_key"], "left_anti")


def tree_paths(nodes: DataFrame, key: str = "node_id", parent: str = "parent_id", order: Sequence[Column] = (), within: Sequence[str] = ("table_id", "axis")) -> DataFrame:
    """nodes with path, an array that sorts in pre-order, and level; roots have a null parent.

    Paths hold the node's rank among its siblings at each level, so they sort as arrays do.
    """
    from pyspark.sql import Window

    siblings = Window.partitionBy(*within, parent).orderBy(*(order or (F.col("ord"), F.col(key))))
    ranked = materialize(nodes.withColumn("_rank", F.row_number().over(siblings)), "ranked")
    level = ranked.where(F.col(parent).isNull()).withColumn("path", F.array("_rank")).withColumn("level", F.lit(0))
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select(*(F.col(w).alias(f"_{w}") for w in within), F.col(key).alias("_up"), F.col("path").alias("_path"))
        met = [F.col(w) == F.col(f"_{w}") for w in within] + [F.col(parent) == F.col("_up")]
        level = ranked.join(above, met).withColumn("path", F.concat("_path", F.array("_rank"))).withColumn("level", F.lit(depth)).select(*found.columns)
        level = materialize(level, "level")
        found = found.unionByName(level)
    return found.drop("_rank")


def first_arcs(arcs: DataFrame, within: Sequence[str] = ("elr", "parent", "child")) -> DataFrame:
    """One arc of each pair of ends: the one of least order."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*within).orderBy("ord"))
    return arcs.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def arcs_by_source(arcs: DataFrame) -> DataFrame:
    """(elr, source, targets, n): what each source of a network leads to, in order."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "target")))
    return arcs.groupBy("elr", "source").agg(F.transform(listed, lambda x: x["target"]).alias("targets"), F.count("*").alias("n"))


def descendants(heads: DataFrame, arcs: DataFrame, leaves_only: bool = False) -> DataFrame:
    """(head, member): members below each head (head, elr, member) over link roles, the head itself left out.

    With leaves_only, those that no arc of their network leads on from.
    """
    reached = member_network(heads.select("head", "elr", "member"), arcs)
    tops = heads.select("head", F.col("member").alias("_top"))
    below = reached.join(tops, "head").where("member <> _top").drop("_top")
    if leaves_only:
        below = below.join(arcs.select("elr", F.col("source").alias("member")).distinct(), ["elr", "member"], "left_anti")
    return below.select("head", "member").distinct()


def enumeration_members(domains: DataFrame, arcs: DataFrame) -> DataFrame:
    """(concept, member): values of extensible enumerations; domains: concept, elr, head, head_usable.

    Arcs that are not usable lead nowhere; the head counts only where it is usable.
    """
    usable = arcs.where(F.coalesce("usable", F.lit(True)))
    reached = member_network(domains.select("concept", "elr", F.col("head").alias("member")), usable)
    heads = domains.where("NOT head_usable").select("concept", F.col("head").alias("member"))
    return reached.select("concept", "member").distinct().join(heads, ["concept", "member"], "left_anti")


def members_in_role(heads: DataFrame, arcs: DataFrame) -> DataFrame:
    """(head, member): members reached inside one link role, target roles not followed."""
    stay = arcs.withColumn("target_role", F.lit(None).cast("string"))
    return member_network(heads.select("head", "elr", "member"), stay).select("head", "member").distinct()
