"""Report tables: axes from breakdown trees, cells from axes, facts into cells.

Axis tables are small and cells grow with rows times columns of one table; facts meet cells by an equi-join on
concept and members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import dims_key, normalized_dims, typed_key
from ..functions.scalars import cell_code
from ..session import materialize
from .graph import tree_paths

NO_DIMS = "map<string,string>"


def _accumulated(nodes: DataFrame) -> DataFrame:
    """nodes with path and level, and concept and dims inherited down the tree: a child's own win."""
    placed = materialize(tree_paths(nodes), "tree")
    level = placed.where("level = 0").withColumn("all_dims", F.coalesce("dims", F.create_map().cast(NO_DIMS)))
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select("table_id", "axis", F.col("node_id").alias("_up"), F.col("concept").alias("_concept"), F.col("all_dims").alias("_dims"))
        level = placed.where(F.col("level") == depth).join(above, ["table_id", "axis"]).where("parent_id = _up")
        own = F.coalesce("dims", F.create_map().cast(NO_DIMS))
        merged = F.map_concat(F.map_filter("_dims", lambda k, v: ~F.map_contains_key(F.coalesce("dims", F.create_map().cast(NO_DIMS)), k)), own)
        level = materialize(level.withColumn("all_dims", merged).withColumn("concept", F.coalesce("concept", "_concept")).select(*found.columns), "inherited")
        found = found.unionByName(level)
    return found.drop("dims").withColumnRenamed("all_dims", "dims")


def axis_rows(nodes: DataFrame) -> DataFrame:
    """Every node as a row, in pre-order: nodes with row_ord (from 0), level and inherited constraints."""
    order = Window.partitionBy("table_id", "axis").orderBy("path")
    return _accumulated(nodes).withColumn("row_ord", F.row_number().over(order) - 1)


def axis_leaves(nodes: DataFrame) -> DataFrame:
    """The columns of an axis from left to right: leaves, and for each parent that is not abstract a column of its
    own before or after its children; with leaf_ord (from 0) and inherited constraints."""
    placed = _accumulated(nodes)
    parents = nodes.where("parent_id IS NOT NULL").select("table_id", "axis", F.col("parent_id").alias("node_id")).distinct().withColumn("is_parent", F.lit(True))
    marked = placed.join(parents, ["table_id", "axis", "node_id"], "left").withColumn("is_parent", F.coalesce("is_parent", F.lit(False)))
    leaves = marked.where("NOT is_parent OR NOT is_abstract")
    # a parent's own column sorts before all children, or after them
    own = F.when(F.coalesce("parent_first", F.lit(True)), F.lit(0)).otherwise(F.lit(2**31 - 1))
    order = Window.partitionBy("table_id", "axis").orderBy(F.when(F.col("is_parent"), F.concat("path", F.array(own))).otherwise(F.col("path")))
    return leaves.withColumn("leaf_ord", F.row_number().over(order) - 1)


def header_spans(nodes: DataFrame) -> DataFrame:
    """(table_id, axis, node_id, level, span): how many columns stand under each node, one at least."""
    leaves = axis_leaves(nodes).select("table_id", "axis", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("above"))
    counted = leaves.groupBy("table_id", "axis", F.col("above").alias("path")).agg(F.count("*").alias("leaves"))
    placed = tree_paths(nodes)
    return placed.join(counted, ["table_id", "axis", "path"], "left").select("table_id", "axis", "node_id", "level", F.greatest(F.lit(1), F.coalesce("leaves", F.lit(1))).cast("int").alias("span"))


def cells(rows: DataFrame, columns: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """The body: rows (row_ord, code, concept, dims) by columns (leaf_ord, ...) by sheets (z_ord, dims) of each table."""
    r = rows.select("table_id", "row_ord", F.col("code").alias("row_code"), F.col("concept").alias("row_concept"), F.col("dims").alias("row_dims"))
    c = columns.select("table_id", F.col("leaf_ord").alias("col_ord"), F.col("code").alias("col_code"), F.col("concept").alias("col_concept"), F.col("dims").alias("col_dims"))
    body = r.join(c, "table_id")
    if sheets is None:
        body = body.withColumn("z_ord", F.lit(0)).withColumn("z_dims", F.create_map().cast(NO_DIMS))
    else:
        body = body.join(sheets.select("table_id", "z_ord", F.col("dims").alias("z_dims")), "table_id")
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), F.col(b))
    body = body.withColumn("_rc", later("row_dims", "col_dims")).withColumn("dims", later("_rc", "z_dims"))
    return body.select("table_id", "z_ord", "row_ord", "col_ord", F.coalesce("col_concept", "row_concept").alias("concept"), "dims", cell_code(F.col("row_code"), F.col("col_code")).alias("cell_code"))


def fill(body: DataFrame, facts: DataFrame, contexts: DataFrame, defaults: dict[str, str] | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Cells with each filing's value: the first fact whose concept and members, defaults left out, are the cell's.

    Columns added: instance_id, value, decimals, duplicates (facts that match); cells without a match have none.
    """
    keyed = contexts.select("instance_id", "context_id", dims_key(normalized_dims(F.col("dims"), defaults, ignored)).alias("key"), typed_key(F.col("typed")).alias("typed_key"))
    reported = facts.join(keyed, ["instance_id", "context_id"]).groupBy("instance_id", "concept", "key", "typed_key").agg(
        F.min_by("value", "fact_ord").alias("value"), F.min_by("decimals", "fact_ord").alias("decimals"), F.count("*").alias("duplicates")
    )
    asked = body.withColumn("key", dims_key(normalized_dims(F.col("dims"), defaults, ignored))).withColumn("typed_key", F.lit(""))
    return asked.join(reported, ["concept", "key", "typed_key"], "left").drop("key", "typed_key")


def excluded_cells(body: DataFrame, cubes: DataFrame, cube_items: DataFrame, cube_members: DataFrame, table_roles: DataFrame) -> DataFrame:
    """body with excluded: its concept has closed cubes under the table's role and none of them fits its members.

    table_roles: table_id, elr; a cube belongs to a table whose role is its own or a prefix of it up to a slash.
    """
    own = cubes.where("arcrole = 'all' AND closed").join(cube_items, "cube")
    keyed = body.withColumn("cell", F.struct("table_id", "z_ord", "row_ord", "col_ord"))
    scope = own.join(table_roles, (F.col("elr") == F.col("table_elr")) | F.startswith("elr", F.concat("table_elr", F.lit("/")))).select("table_id", "cube", "concept")
    candidates = keyed.select("cell", "table_id", "concept", F.map_entries("dims").alias("entries")).join(scope, ["table_id", "concept"])
    pairs = candidates.select("cell", "cube", F.explode_outer("entries").alias("e")).select("cell", "cube", F.col("e.key").alias("dim"), F.col("e.value").alias("member"))
    met = pairs.join(cube_members.withColumn("ok", F.lit(True)), ["cube", "dim", "member"], "left").groupBy("cell", "cube").agg(F.bool_and(F.col("dim").isNull() | F.coalesce("ok", F.lit(False))).alias("fits"))
    verdict = met.groupBy("cell").agg(F.bool_or("fits").alias("fits"))
    return keyed.join(verdict, "cell", "left").withColumn("excluded", ~F.coalesce("fits", F.lit(True))).drop("fits", "cell")


def open_rows(facts: DataFrame, contexts: DataFrame, concept: str, base: dict[str, str], varying: str) -> DataFrame:
    """(instance_id, member): members of the varying dimension among facts that have the base members and no others."""
    fixed = F.create_map(*(F.lit(x) for kv in base.items() for x in kv)).cast(NO_DIMS) if base else F.create_map().cast(NO_DIMS)
    rest = F.map_filter("dims", lambda k, v: k != varying)
    keyed = contexts.where(F.map_contains_key("dims", varying) & (dims_key(rest) == dims_key(fixed))).select("instance_id", "context_id", F.element_at("dims", varying).alias("member"))
    return facts.where(F.col("concept") == concept).join(keyed, ["instance_id", "context_id"]).select("instance_id", "member").distinct()


def open_row_candidates(leaves: DataFrame) -> DataFrame:
    """(table_id, parent_id, dim): abstract parents whose leaves share a concept and vary in exactly one dimension.

    leaves: table_id, parent_id, concept, dims.
    """
    listed = leaves.select("table_id", "parent_id", "concept", F.explode("dims").alias("dim", "member"))
    varied = listed.groupBy("table_id", "parent_id", "dim").agg(F.count_distinct("member").alias("members")).where("members > 1")
    single = leaves.groupBy("table_id", "parent_id").agg(F.count_distinct("concept").alias("concepts")).where("concepts = 1")
    one = varied.groupBy("table_id", "parent_id").agg(F.count("*").alias("n"), F.first("dim").alias("dim")).where("n = 1")
    return one.join(single, ["table_id", "parent_id"]).select("table_id", "parent_id", "dim")


def open_aspect_rows(facts: DataFrame, contexts: DataFrame, concepts: list[str], dims: list[str]) -> DataFrame:
    """The distinct keys over aspect dimensions (explicit or typed) of facts of an open table's column concepts."""
    key = [F.coalesce(F.element_at("dims", d), F.element_at("typed", d)).alias(d) for d in dims]
    keyed = contexts.select("instance_id", "context_id", *key)
    return facts.where(F.col("concept").isin(*concepts)).join(keyed, ["instance_id", "context_id"]).select("instance_id", *dims).where(" AND ".join(f"`{d}` IS NOT NULL" for d in dims)).distinct()


def used_members(contexts: DataFrame) -> DataFrame:
    """(dim, member, contexts): members in use for each dimension, for choosing sheets."""
    return contexts.select(F.explode("dims").alias("dim", "member")).groupBy("dim", "member").agg(F.count("*").alias("contexts"))


def sheet_choice(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """(dim, member): each dimension's sheet to show first: preferred, else used, else the first candidate.

    candidates: dim, member, ord, preferred.
    """
    order = Window.partitionBy("dim").orderBy(F.coalesce("preferred", F.lit(False)).desc(), F.col("contexts").isNull(), "ord", "member")
    return candidates.join(used, ["dim", "member"], "left").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("dim", "member")


def filed_tables(tables: DataFrame, indicators: DataFrame) -> DataFrame:
    """Tables (table_id, template) that a filing reports, under any spelling of the template."""
    from ..functions.scalars import indicator_aliases

    spelt = tables.select("table_id", F.explode(indicator_aliases(F.col("template"))).alias("alias"))
    filed = indicators.where("filed").select("instance_id", F.explode(indicator_aliases(F.col("template"))).alias("alias"))
    return filed.join(spelt, "alias").select("instance_id", "table_id").distinct()


def has_data(filled: DataFrame) -> DataFrame:
    return filled.groupBy("instance_id", "table_id").agg(F.bool_or(F.col("value").isNotNull()).alias("has_data"))


def z_leaves(nodes: DataFrame) -> DataFrame:
    """(table_id, z_ord, label, dims): the sheets of a z axis, one called Default for a table without any leaf."""
    leaves = axis_leaves(nodes).select("table_id", F.col("leaf_ord").alias("z_ord"), "label", "dims")
    bare = nodes.select("table_id").distinct().join(leaves.select("table_id").distinct(), "table_id", "left_anti")
    return leaves.unionByName(bare.select("table_id", F.lit(0).alias("z_ord"), F.lit("Default").alias("label"), F.create_map().cast(NO_DIMS).alias("dims")))


def table_order(tables: DataFrame, groups: DataFrame) -> DataFrame:
    """tables (table_id) with place: their pre-order in the group tree (node_id, parent_id, ord), unlisted ones last."""
    tree = tree_paths(groups.select(F.lit("all").alias("table_id"), F.lit("g").alias("axis"), "node_id", "parent_id", "ord"))
    met = tables.join(tree.select(F.col("node_id").alias("table_id"), "path"), "table_id", "left")
    return met.withColumn("place", F.row_number().over(Window.orderBy(F.col("path").isNull(), "path", "table_id"))).drop("path")


def node_captions(nodes: DataFrame, best_labels: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """nodes with caption (their own label, else their concept's, else nothing) and code (their own, else by label)."""
    found = nodes.join(best_labels.select("concept", F.col("text").alias("_text")), "concept", "left").withColumn("caption", F.coalesce("label", "_text", F.lit(""))).drop("_text")
    if codes is None:
        return found
    return found.join(codes.select("concept", F.col("text").alias("_code")), "concept", "left").withColumn("code", F.coalesce("code", "_code")).drop("_code")


def cell_options(body: DataFrame, concepts: DataFrame) -> DataFrame:
    """Cells with the values that their concept may take, for concepts that enumerate some."""
    return body.join(concepts.where("size(enumeration) > 0").select("concept", F.col("enumeration").alias("options")), "concept")


def locate(findings: DataFrame, contexts: DataFrame, body: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Findings with the first cell, row by row, of their concept and members."""
    keyed = contexts.select("instance_id", "context_id", dims_key(normalized_dims(F.col("dims"), defaults)).alias("key"))
    cells_ = body.withColumn("key", dims_key(normalized_dims(F.col("dims"), defaults))).groupBy("concept", "key").agg(F.min(F.struct("table_id", "z_ord", "row_ord", "col_ord")).alias("cell"))
    return findings.drop("table_id").join(keyed, ["instance_id", "context_id"]).join(cells_, ["concept", "key"]).select("instance_id", "rule_id", "concept", "context_id", "cell.*")


def facts_at(facts: DataFrame, contexts: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Facts whose context has exactly the members of a coordinate (concept, dims), defaults included as reported."""
    keyed = contexts.select("instance_id", "context_id", dims_key(F.col("dims")).alias("key"))
    asked = coordinates.select("concept", dims_key(F.col("dims")).alias("key")).distinct()
    return facts.join(keyed, ["instance_id", "context_id"]).join(asked, ["concept", "key"]).drop("key")


def compatible_members(candidates: DataFrame, combinations: DataFrame, selected: dict[str, str]) -> DataFrame:
    """Candidates (dim, member) that occur together with the other selected members; all of a dimension's if none does.

    combinations: dims, the members that contexts use together.
    """
    seen = combinations.select("dims", F.explode("dims").alias("dim", "member"))
    fits = [F.when(F.col("dim") == d, F.lit(True)).otherwise(F.coalesce(F.element_at("dims", d) == m, F.lit(False))) for d, m in selected.items()]
    met = seen.where(F.forall(F.array(*fits), lambda x: x)) if fits else seen
    good = candidates.join(met.select("dim", "member").distinct(), ["dim", "member"], "left_semi")
    return good.unionByName(candidates.join(good.select("dim").distinct(), "dim", "left_anti"))
