"""Queries of names, edits, members, labels and checks that the other modules leave, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, scalars
from ..functions.keys import s_equal_key
from ..functions.xpath import Scope, Value
from ..operators import dimensional, dml, filters, graph, labels, linkbase_checks, structural, tables
from ..operators.filters import DimensionFilter, VariableFilter
from ..session import local_table
from . import model

QUERIES: dict = {}
ORACLE_SQL: dict = {}
T = "{http://e.com/t}"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@query(
    "scalar_names",
    f"""SELECT p_partkey, 'http://e.com/t#P' || p_partkey AS uri, '{T}P' || p_partkey || ',http://e.com/t#P' || p_partkey || ',x:P' || p_partkey AS forms,
CASE WHEN p_partkey % 2 = 0 THEN 'id' || p_partkey || ',' ELSE '' END || 'x_P' || p_partkey || ',' || substr(sha256('http://e.com/t'), 1, 8) || '_P' || p_partkey || ',P' || p_partkey AS aliases FROM part""",
)
def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, own = F.concat(F.lit(f"{T}P"), model.text("p_partkey")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("id"), model.text("p_partkey")))
    return model.table(spark, sf_dir, "part").select("p_partkey", scalars.enumeration_uri(name).alias("uri"), F.array_join(scalars.name_forms(name, F.lit("x")), ",").alias("forms"), F.array_join(scalars.concept_aliases(name, F.lit("x"), own), ",").alias("aliases"))


@query(
    "scalar_shown",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN format('{:,.2f}', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE)) WHEN 1 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) ELSE 'n/a' END AS shown,
CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 10) * 100 || ' ms' ELSE format('{:.2f}', c_custkey + 1e0) || ' s' END AS took FROM customer""",
)
def scalar_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    value = F.when(kind == 2, "n/a").otherwise(model.text(F.col("c_acctbal").cast(model.MONEY)))
    shown = scalars.formatted(value, F.when(kind == 1, f"{T}stringItemType").otherwise(f"{T}monetaryItemType"), F.lit("2"))
    seconds = F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 10) / 10).otherwise(F.col("c_custkey") + 1.0)
    return model.table(spark, sf_dir, "customer").select("c_custkey", shown.alias("shown"), scalars.duration_text(seconds).alias("took"))


ORDERS = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS i, o_orderkey AS k, o_orderstatus AS s, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM orders)"


@query("dml_update_remove", f"WITH {ORDERS} SELECT k AS fact_ord, CASE WHEN s = 'F' THEN 'new' ELSE v END AS value FROM o WHERE s <> 'P'")
def dml_update_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = model.order_facts(spark, sf_dir)
    status = model.table(spark, sf_dir, "orders").select(model.text("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("fact_ord"), "o_orderstatus")
    changed = dml.update_facts(facts, status.where("o_orderstatus = 'F'").select("instance_id", "fact_ord", F.lit("new").alias("value")))
    return dml.remove_facts(changed, status.where("o_orderstatus = 'P'")).select("fact_ord", "value")


@query(
    "dml_reassign",
    f"""WITH {ORDERS}, m AS (SELECT *, 'o' || k AS ctx, CASE WHEN s = 'F' THEN 'moved' || CAST(k % 3 AS VARCHAR) END AS target FROM o),
clash AS (SELECT i FROM m GROUP BY i, coalesce(target, ctx) HAVING count(*) > 1 AND count(target) > 0)
SELECT k AS fact_ord, CASE WHEN target IS NOT NULL AND i NOT IN (SELECT i FROM clash) THEN target ELSE ctx END AS context_id FROM m""",
)
def dml_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = model.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    moves = finished.select(model.text("o_custkey").alias("instance_id"), model.order_id().alias("context_id"), F.concat(F.lit("moved"), model.text(F.col("o_orderkey") % 3)).alias("new_context_id"))
    moved, _ = dml.reassign_contexts(model.order_facts(spark, sf_dir), moves)
    return moved.select("fact_ord", "context_id")


@query(
    "dml_upsert_cells",
    f"""WITH {ORDERS}, e AS (SELECT * FROM o WHERE s = 'F')
SELECT 'o' || k AS context_id, v AS value FROM o WHERE s <> 'F' UNION ALL SELECT 'o' || k, '7' FROM e WHERE k % 2 = 0 UNION ALL SELECT 'new' || k, '9' FROM e WHERE k % 3 = 0""",
)
def dml_upsert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = model.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    cell = lambda context, value: finished.select(model.text("o_custkey").alias("instance_id"), F.lit("OrderTotal").alias("concept"), context.alias("context_id"), F.lit("USD").alias("unit_id"), F.lit("0").alias("decimals"), value.alias("value"), F.col("o_orderkey").alias("k"))
    old = cell(model.order_id(), F.when(F.col("o_orderkey") % 2 == 0, " 7").otherwise(" "))
    fresh = cell(F.concat(F.lit("new"), model.text("o_orderkey")), F.lit("9")).where("k % 3 = 0")
    again = fresh.withColumn("value", F.lit("8"))
    return dml.upsert_cells(model.order_facts(spark, sf_dir), old.unionByName(fresh).unionByName(again).drop("k")).select("context_id", "value")


@query(
    "dml_ensure_contexts",
    """WITH c AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS i, c_mktsegment AS s FROM customer)
SELECT i AS instance_id, s AS member, s <> 'BUILDING' AS fresh FROM c""",
)
def dml_ensure_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    wanted = model.table(spark, sf_dir, "customer").select(
        model.text("c_nationkey").alias("instance_id"), F.lit("s").alias("entity_scheme"), model.text("c_nationkey").alias("entity_id"), F.lit("instant").alias("period_type"), F.lit("2024-12-31").cast("date").alias("instant"),
        F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.create_map(F.lit("segment"), "c_mktsegment").alias("dims"), none.alias("typed"), none.alias("containers"),
    )
    key = s_equal_key(F.col("entity_scheme"), F.col("entity_id"), F.concat(F.lit("i:"), F.col("instant").cast("string")), F.col("dims"), F.col("typed"), F.col("containers"))
    there = wanted.where("dims['segment'] = 'BUILDING'").dropDuplicates(["instance_id"])
    known = there.withColumn("s_equal_key", key).withColumn("context_id", F.lit("own"))
    found = dml.ensure_contexts(known, wanted)
    return found.select("instance_id", F.element_at("dims", "segment").alias("member"), F.startswith("context_id", F.lit("ctx_")).alias("fresh"))


@query(
    "ctx_s_equal_raw",
    """WITH k AS (SELECT CAST(o_custkey AS VARCHAR) AS i, 'o' || o_orderkey AS id, o_orderpriority = '5-LOW' AS low, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p, CASE WHEN o_orderstatus = 'F' THEN 1 END AS f,
c_mktsegment AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000 END AS clerk, o_orderkey % 3 = 0 AS inside FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT id AS context_id, min(id) OVER (PARTITION BY i, CASE WHEN NOT low THEN d END, low, p, f, s, clerk, inside) AS canonical FROM k""",
)
def ctx_s_equal_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import canonical_context, period_key

    period = F.coalesce(period_key(F.col("period_type"), F.when(F.col("period_type") == "instant", F.col("instant")), F.col("start"), F.col("end")), F.lit("d"))
    key = s_equal_key(F.col("entity_scheme"), F.col("entity_id"), period, F.col("dims"), F.col("typed"), F.col("containers"))
    return model.contexts(spark, sf_dir).select("context_id", canonical_context(key).alias("canonical"))


@query("struct_incomplete_context", "SELECT 'o' || o_orderkey AS context_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW'")
def struct_incomplete_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.incomplete_contexts(model.contexts(spark, sf_dir)).select("context_id")


@query("filter_set_filters", "SELECT 'o' || o_orderkey AS context_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def filter_set_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = VariableFilter("OrderTotal", dimensions=[DimensionFilter("segment", ("BUILDING",))])
    shared = VariableFilter("Other", "duration", dimensions=[DimensionFilter("segment", ("MACHINERY",)), DimensionFilter("status")])
    from .reporting import _facts

    return filters.select(_facts(spark, sf_dir), filters.with_set_filters(own, shared)).select("context_id")


@query("message_rendered", "SELECT c_custkey, 'balance ' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END || ' of ' || CAST(2 * c_custkey AS VARCHAR) AS text, '$a gt 5 is ' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey > 5 THEN ' TRUE' ELSE ' FALSE' END AS otherwise FROM customer".replace("'$a gt 5 is ' || CAST(c_custkey AS VARCHAR)", "CAST(c_custkey AS VARCHAR) || ' gt 5'"))
def message_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = model.text("c_custkey")
    scope = Scope({"a": Value("any", key), "b": Value("any", F.when(F.col("c_custkey") % 4 != 0, key))})
    text = messages.render("balance {$b} of {2 * $a}", scope)
    return model.table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), messages.render("{a/b}", scope, F.col("c_custkey") > 5, "$a gt 5").alias("otherwise"))


@query(
    "label_prohibition",
    """SELECT 'c' || n_regionkey AS concept, n_name AS text, CAST(greatest(n_nationkey % 4, 2) AS INTEGER) AS priority FROM nation WHERE n_nationkey % 3 <> 0""",
)
def label_prohibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = model.table(spark, sf_dir, "nation")
    arcs = nations.select(F.lit("l").alias("link"), F.concat(F.lit("c"), model.text("n_regionkey")).alias("from"), model.text("n_nationkey").alias("to"), F.lit("optional").alias("use"), (F.col("n_nationkey") % 4).cast("int").alias("priority"))
    banned = arcs.where("CAST(to AS INT) % 3 = 0").withColumn("use", F.lit("prohibited"))
    resources = nations.select(F.lit("l").alias("link"), model.text("n_nationkey").alias("label_id"), F.col("n_name").alias("text"), F.lit(2).alias("priority"))
    return labels.active_labels(arcs.unionByName(banned), resources).select(F.col("from").alias("concept"), "text", "priority")


@query("label_best_resources", "SELECT CAST(n_regionkey AS VARCHAR) AS assertion_id, n_name AS text, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3 DESC, n_name) AS INTEGER) AS nth FROM nation n WHERE (n_nationkey % 2 = 0) = (EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey % 2 = 0))")
def label_best_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "nation").select(model.text("n_regionkey").alias("assertion_id"), F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("xx").alias("lang"), F.col("n_name").alias("text"), (F.col("n_nationkey") % 3).alias("priority"))
    return labels.best_resources(rows).select("assertion_id", "text", "nth")


@query("net_first_arcs", "SELECT 'R' || (c_nationkey % 5) AS parent, c_mktsegment AS child, min(c_custkey) AS ord FROM customer GROUP BY ALL")
def net_first_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = model.table(spark, sf_dir, "customer").select(F.lit("r").alias("elr"), F.concat(F.lit("R"), model.text(F.col("c_nationkey") % 5)).alias("parent"), F.col("c_mktsegment").alias("child"), F.col("c_custkey").alias("ord"))
    return graph.first_arcs(arcs).select("parent", "child", "ord")


@query("net_members_in_role", "SELECT 'R' || r_regionkey AS head, 'R' || r_regionkey AS member FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def net_members_in_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = model.table(spark, sf_dir, "nation"), model.table(spark, sf_dir, "region")
    name = lambda letter, column: F.concat(F.lit(letter), model.text(column))
    shape = [F.lit(True).alias("usable"), F.lit(None).cast("string").alias("target_role")]
    arcs = nations.select(F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("elr"), name("R", "n_regionkey").alias("source"), name("N", "n_nationkey").alias("target"), *shape)
    heads = regions.select(name("R", "r_regionkey").alias("head"), F.lit("a").alias("elr"), name("R", "r_regionkey").alias("member"))
    return graph.members_in_role(heads, arcs).select("head", "member")


@query("table_has_data", "SELECT CAST(c_nationkey AS VARCHAR) AS instance_id, c_mktsegment AS table_id, bool_or(c_acctbal > 9000) AS has_data FROM customer GROUP BY ALL")
def table_has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.has_data(model.table(spark, sf_dir, "customer").select(model.text("c_nationkey").alias("instance_id"), F.col("c_mktsegment").alias("table_id"), F.when(F.col("c_acctbal") > 9000, "1").alias("value")))


@query("table_aspect_rows", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS instance_id, o_orderkey % 1000 AS clerk, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0")
def table_aspect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.open_aspect_rows(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), ["OrderTotal"], ["clerk", "segment"])
    return found.select("instance_id", F.col("clerk").cast("long").alias("clerk"), "segment")


@query("table_row_candidates", "SELECT CAST(n_regionkey AS VARCHAR) AS parent_id, 'nation' AS dim FROM nation WHERE n_regionkey % 2 = 0 GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def table_row_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("n_regionkey") % 2 == 0
    leaves = model.table(spark, sf_dir, "nation").select(F.lit("t").alias("table_id"), model.text("n_regionkey").alias("parent_id"), F.lit("Balance").alias("concept"), F.create_map(F.lit("nation"), "n_name", F.lit("other"), F.when(even, "same").otherwise(model.text("n_nationkey"))).alias("dims"))
    return tables.open_row_candidates(leaves).select("parent_id", "dim")


@query("table_sheet_choice", "SELECT CAST(n_regionkey AS VARCHAR) AS dim, arg_min(n_name, (n_nationkey % 3 <> 0)::INT * 1000 + n_nationkey) AS member FROM nation GROUP BY 1")
def table_sheet_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = model.table(spark, sf_dir, "nation")
    candidates = nations.select(model.text("n_regionkey").alias("dim"), F.col("n_name").alias("member"), F.col("n_nationkey").alias("ord"), F.lit(None).cast("boolean").alias("preferred"))
    used = nations.where("n_nationkey % 3 = 0").select(model.text("n_regionkey").alias("dim"), F.col("n_name").alias("member"), F.lit(1).alias("contexts"))
    return tables.sheet_choice(candidates, used)


@query("table_cell_options", "SELECT 'N' || n_nationkey AS concept, n_name || ',x' AS options FROM nation WHERE n_nationkey % 2 = 0")
def table_cell_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = model.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), model.text("n_nationkey")).alias("concept"), F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("enumeration"))
    return tables.cell_options(nations.select("concept"), nations).select("concept", F.array_join("options", ",").alias("options"))


@query("table_captions", "SELECT 'n' || n_nationkey AS node_id, CASE n_nationkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN n_name ELSE '' END AS caption, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey ELSE CASE WHEN n_nationkey % 3 = 1 THEN '00' || n_nationkey END END AS code FROM nation")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    nodes = model.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), model.text("n_nationkey")).alias("node_id"), "n_name", key.alias("k"), model.text("n_nationkey").alias("concept"), F.when(key % 3 == 0, "own").alias("label"), F.when(key % 2 == 0, F.concat(F.lit("c"), model.text("n_nationkey"))).alias("code"))
    named = nodes.where("k % 3 = 1")
    found = tables.node_captions(nodes, named.select("concept", F.col("n_name").alias("text")), named.select("concept", F.concat(F.lit("00"), "concept").alias("text")))
    return found.select("node_id", "caption", "code")


@query("dim_undefined_member", f"SELECT CAST(c_custkey AS VARCHAR) AS context_id, 'xbrldie:ExplicitMemberUndefinedQNameError' AS rule_id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_custkey % 2 = 0")
def dim_undefined_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.when(F.col("c_custkey") % 2 == 0, f"{T}Segment").otherwise("{http://far.org}Segment")
    contexts = model.table(spark, sf_dir, "customer").select(F.lit("i").alias("instance_id"), model.text("c_custkey").alias("context_id"), F.create_map(dim, F.concat(F.lit(T), "c_mktsegment")).alias("dims"), F.create_map().cast("map<string,string>").alias("typed"))
    rows = [(f"{T}Segment", dimensional.DIMENSION_ITEM, None), ("{http://far.org}Segment".replace("far", "other"), dimensional.DIMENSION_ITEM, None), (f"{T}BUILDING", None, None), (f"{T}MACHINERY", None, None)]
    concepts = local_table(spark, rows, "concept string, substitution_group string, typed_domain string")
    defaults = local_table(spark, [], "dim string, default_member string")
    found = dimensional.context_findings(contexts, concepts, defaults)
    return found.where("rule_id = 'xbrldie:ExplicitMemberUndefinedQNameError'").select("context_id", "rule_id")


@query("check_links", "SELECT 'xlink:validation-error' AS rule_id, count(*) AS findings FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'xbrl:duplicate-role-ref', count(*) FROM region")
def check_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = model.table(spark, sf_dir, "nation"), model.table(spark, sf_dir, "region")
    arcs = nations.select(F.lit("l").alias("link"), F.lit("r").alias("elr"), F.lit("top").alias("source"), F.col("n_name").alias("target"))
    locators = nations.where("n_nationkey % 3 <> 0").select(F.lit("l").alias("link"), F.col("n_name").alias("label"), F.lit("f").alias("file"), F.lit("").alias("fragment"))
    resources = local_table(spark, [("l", "top")], "link string, label string")
    twice = regions.select(F.lit("p").alias("path"), F.lit("roleRef").alias("how"), F.lit("f").alias("file"), F.col("r_name").alias("fragment"))
    found = linkbase_checks.open_arcs(arcs, locators, resources).unionByName(linkbase_checks.repeated_references(twice.unionByName(twice)))
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"))


@query("check_lax_values", "SELECT 'integer ' || n_name AS message FROM nation UNION ALL SELECT 'space ' || n_name FROM nation UNION ALL SELECT 'lang ' || n_name || '_' FROM nation")
def check_lax_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = model.table(spark, sf_dir, "nation")
    kind = lambda k, v: nations.select(F.lit("i").alias("instance_id"), F.lit(k).alias("kind"), v.alias("value"))
    values = [kind("integer", F.col("n_name")), kind("integer", model.text("n_nationkey")), kind("space", F.col("n_name")), kind("space", F.lit("preserve")), kind("lang", F.concat("n_name", F.lit("_"))), kind("lang", F.lit("en-GB"))]
    whole = values[0]
    for v in values[1:]:
        whole = whole.unionByName(v)
    return linkbase_checks.lax_values(whole).select("message")


@query("check_element_constraints", "SELECT 'N' || n_nationkey AS concept FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'R' || r_regionkey FROM region WHERE r_regionkey % 2 = 1")
def check_element_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import XBRLI

    named = lambda t, letter, key, root, odd: model.table(spark, sf_dir, t).select(F.concat(F.lit(letter), model.text(key)).alias("concept"), F.when(F.col(key) % 2 == 1, "instant").alias("period_type"), F.lit(f"{{{XBRLI}}}{root}").alias("root"))
    rows = named("nation", "N", "n_nationkey", "item", 0).unionByName(named("region", "R", "r_regionkey", "tuple", 1))
    return linkbase_checks.element_constraints(rows.select("concept", "period_type"), rows.select("concept", "root")).select("concept")

