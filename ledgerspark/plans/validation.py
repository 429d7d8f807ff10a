"""Queries of the calculation, structural and dimensional rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_context, context_id, dims_key
from ..operators import calculation, dimensional, graph, structural
from ..schemas import ISO4217, XBRLI
from ..session import local_table
from . import model

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


LINES = """
lines AS (SELECT 'o' || l_orderkey || '-' || l_linenumber AS context_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS off, CAST(l_tax AS DECIMAL(18,2)) AS tax FROM lineitem),
valued AS (SELECT context_id, count(*) OVER (PARTITION BY context_id) AS n, round_even(CAST(price * (1 - off) * (1 + tax) AS DOUBLE), 0) AS reported,
           round_even(CAST(price AS DOUBLE) - round_even(CAST(price * off AS DOUBLE), 0) + round_even(CAST(price * (1 - off) * tax AS DOUBLE), 0), 0) AS computed FROM lines)"""


@query(
    "calc_summation_inconsistent",
    f"WITH {LINES} SELECT context_id, 'USD' AS unit_id, 'LineCharge' AS concept, reported, computed FROM valued WHERE n = 1 AND reported <> computed",
)
def calc_summation_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculation.totals(model.line_facts(spark, sf_dir), model.line_arcs(spark), model.concepts(spark))
    return found.where("NOT consistent").select("context_id", "unit_id", F.col("parent").alias("concept"), F.col("reported").cast("double").alias("reported"), F.col("computed").cast("double").alias("computed"))


@query(
    "calc_totals_by_verdict",
    f"""WITH {LINES}, bound AS (SELECT context_id, min(n) AS n, max(reported) AS r, max(computed) AS c FROM valued GROUP BY context_id)
SELECT CASE WHEN n > 1 THEN 'blocked' WHEN r = c THEN 'consistent' ELSE 'inconsistent' END AS verdict, count(*) AS totals FROM bound GROUP BY 1""",
)
def calc_totals_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calculation.totals(model.line_facts(spark, sf_dir), model.line_arcs(spark), model.concepts(spark))
    verdict = F.when(F.col("blocked"), "blocked").when(F.col("consistent"), "consistent").otherwise("inconsistent")
    return found.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("totals"))


def _part_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = model.table(spark, sf_dir, "lineitem")
    weight = F.when(F.col("l_discount") == 0, 0.0).when(F.col("l_tax") > 0.04, -1.0).otherwise(1.0)
    return lines.select(
        F.col("l_linestatus").alias("elr"), model.text("l_partkey").alias("parent"), model.text("l_suppkey").alias("child"), weight.alias("weight"),
        F.when(F.col("l_returnflag") == "R", "prohibited").otherwise("optional").alias("use"), F.concat_ws("-", model.text("l_partkey"), model.text("l_suppkey")).alias("eq_key"),
    )


def _part_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return model.table(spark, sf_dir, "part").select(
        model.text("p_partkey").alias("concept"), F.when(size % 2 == 0, "{t}monetaryItemType").otherwise("{t}stringItemType").alias("data_type"), F.lit("instant").alias("period_type"),
        F.when(size % 3 == 0, "debit").when(size % 3 == 1, "credit").alias("balance"), (size % 7 == 0).alias("abstract"),
    )


@query(
    "calc_arc_prohibition",
    """SELECT l_linestatus AS elr, CAST(l_partkey AS VARCHAR) AS parent, count(*) AS arcs FROM lineitem a WHERE l_returnflag <> 'R'
AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_linestatus = a.l_linestatus AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey) GROUP BY 1, 2""",
)
def calc_arc_prohibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.active_arcs(_part_arcs(spark, sf_dir)).groupBy("elr", "parent").agg(F.count("*").alias("arcs"))


ARCS = """
arcs AS (SELECT l_linestatus AS elr, l_partkey AS parent, l_suppkey AS child, CASE WHEN l_discount = 0 THEN 0e0 WHEN l_tax > 0.04 THEN -1e0 ELSE 1e0 END AS weight FROM lineitem WHERE l_returnflag <> 'R'),
c AS (SELECT p_partkey AS k, p_size % 2 = 0 AS numeric, CASE p_size % 3 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' END AS balance, p_size % 7 = 0 AS abstract FROM part)"""


@query(
    "calc_arc_findings",
    f"""WITH {ARCS}, j AS (SELECT a.*, p.numeric AS pn, p.balance AS pb, p.abstract AS pa, q.numeric AS cn, q.balance AS cb, q.abstract AS ca FROM arcs a LEFT JOIN c p ON p.k = parent LEFT JOIN c q ON q.k = child)
SELECT 'calculation:invalid-endpoint' AS rule_id, count(*) AS findings FROM j WHERE pa OR ca OR NOT pn OR NOT cn
UNION ALL SELECT 'calculation:invalid-weight', count(*) FROM j WHERE weight = 0
UNION ALL SELECT 'calculation:balance-weight-inconsistent', count(*) FROM j WHERE weight <> 0 AND pb IS NOT NULL AND cb IS NOT NULL AND (pb = cb) <> (weight > 0)""",
)
def calc_arc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculation.arc_findings(_part_arcs(spark, sf_dir), _part_concepts(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("findings"))


def _early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select(F.lit("lines").alias("instance_id"), model.order_id().alias("context_id"), F.when(F.col("o_orderstatus") == "F", "duration").otherwise("instant").alias("period_type"))


@query(
    "struct_unresolved_context",
    """SELECT CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'Shipped' END AS concept, 'o' || l_orderkey AS context_id, count(*) AS facts FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate < TIMESTAMP '1996-01-01') GROUP BY ALL""",
)
def struct_unresolved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.unresolved_contexts(model.quantity_facts(spark, sf_dir), _early(spark, sf_dir)).groupBy("concept", "context_id").agg(F.count("*").alias("facts"))


@query(
    "struct_period_mismatch",
    """SELECT CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'Shipped' END AS concept, 'o' || l_orderkey AS context_id, count(*) AS facts FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate < TIMESTAMP '1996-01-01'
WHERE (o_orderstatus = 'F') <> (l_returnflag = 'R') GROUP BY ALL""",
)
def struct_period_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.period_mismatches(model.quantity_facts(spark, sf_dir), _early(spark, sf_dir), model.concepts(spark)).groupBy("concept", "context_id").agg(F.count("*").alias("facts"))


@query("struct_unresolved_unit", "SELECT 'Returned' AS concept, 'o' || l_orderkey AS context_id, count(*) AS facts FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F' GROUP BY ALL")
def struct_unresolved_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = local_table(spark, [("lines", "F")], "instance_id string, unit_id string")
    return structural.unresolved_units(model.quantity_facts(spark, sf_dir), units, model.concepts(spark)).groupBy("concept", "context_id").agg(F.count("*").alias("facts"))


@query(
    "struct_duplicate_conflict",
    """SELECT concept, context_id, least, most FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'Shipped' END AS concept, 'o' || l_orderkey AS context_id, l_linestatus AS u,
min(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)) AS least, max(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)) AS most FROM lineitem GROUP BY ALL) WHERE least <> most""",
)
def struct_duplicate_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structural.conflicting_duplicates(model.quantity_facts(spark, sf_dir))
    return found.select("concept", "context_id", F.regexp_extract("message", "from (\\S+) to", 1).alias("least"), F.regexp_extract("message", "to (\\S+)$", 1).alias("most"))


@query(
    "struct_decimals_precision",
    """WITH f AS (SELECT l_returnflag = 'R' AS num, l_linenumber % 3 <> 0 AS d, l_linenumber % 2 = 0 AS p, l_quantity > 49 AS nil FROM lineitem),
g AS (SELECT CASE WHEN nil AND (d OR p) THEN 'a nil fact has decimals or precision' WHEN nil AND NOT num THEN 'a nil fact of a type that is not numeric has a unit' WHEN nil OR NOT num THEN NULL
WHEN d AND p THEN 'both decimals and precision' WHEN NOT d AND NOT p THEN 'neither decimals nor precision' END AS message FROM f)
SELECT message, count(*) AS facts FROM g WHERE message IS NOT NULL GROUP BY 1""",
)
def struct_decimals_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.decimals_precision(model.quantity_facts(spark, sf_dir), model.concepts(spark)).groupBy("message").agg(F.count("*").alias("facts"))


UNITS = f"""
u AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 0 THEN '{{{XBRLI}}}' || lower(substr(n_name, 1, 3)) ELSE '{{{ISO4217}}}' || upper(substr(n_name, 1, 3)) END AS m FROM nation)"""


@query("struct_monetary_unit", f"WITH {UNITS} SELECT CAST(c_custkey AS VARCHAR) AS context_id FROM customer JOIN u ON k = c_nationkey WHERE k % 5 = 0 OR NOT regexp_full_match(m, '\\{{http://www.xbrl.org/2003/iso4217\\}}[A-Z]{{3}}')")
def struct_monetary_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.monetary_units(model.customer_facts(spark, sf_dir), model.nation_units(spark, sf_dir), model.concepts(spark)).select("context_id")


@query(
    "struct_unit_consistency",
    f"""WITH {UNITS}, p AS (SELECT k, 'measure ' || m AS message FROM u WHERE k % 7 = 0 UNION ALL SELECT k, 'measure ' || m FROM u WHERE k % 7 = 0 AND k % 5 = 0 UNION ALL SELECT k, 'not in simplest form' FROM u WHERE k % 5 = 0)
SELECT CAST(c_custkey AS VARCHAR) AS context_id, message FROM customer JOIN p ON k = c_nationkey""",
)
def struct_unit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.unit_consistency(model.customer_facts(spark, sf_dir), model.nation_units(spark, sf_dir), model.concepts(spark)).select("context_id", "message")


@query(
    "struct_essence_alias",
    """WITH f AS (SELECT DISTINCT 'o' || l_orderkey AS context_id, l_returnflag = 'R' AS r, l_linestatus AS u FROM lineitem)
SELECT a.context_id AS context_id, a.u AS essence_unit, b.u AS alias_unit FROM f a JOIN f b ON a.context_id = b.context_id AND a.r AND NOT b.r WHERE a.u <> b.u""",
)
def struct_essence_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = local_table(spark, [("lines", u, "simple", [u], []) for u in "FO"], "instance_id string, unit_id string, form string, numerator array<string>, denominator array<string>")
    pairs = local_table(spark, [("Returned", "Shipped")], "essence string, alias string")
    found = structural.essence_alias_units(model.quantity_facts(spark, sf_dir), units, pairs)
    return found.select("context_id", F.split("message", " ")[1].alias("essence_unit"), F.split("message", " ")[2].alias("alias_unit"))


@query(
    "ctx_canonical_s_equal",
    """SELECT 'o' || o_orderkey AS context_id, min('o' || o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus, EXTRACT(year FROM o_orderdate)) AS canonical FROM orders""",
)
def ctx_canonical_s_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = model.table(spark, sf_dir, "orders")
    key = F.concat_ws("|", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string"))
    return orders.select(F.col("o_custkey").alias("instance_id"), model.order_id().alias("context_id"), key.alias("s_equal_key")).select("context_id", canonical_context(F.col("s_equal_key")).alias("canonical"))


@query(
    "ctx_hash_id",
    """SELECT 'o' || o_orderkey AS context_id, 'ctx_' || substr(sha256('priority=' || o_orderpriority || '|status=' || o_orderstatus), 1, 8) AS name FROM orders""",
)
def ctx_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = model.table(spark, sf_dir, "orders")
    dims = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return orders.select(model.order_id().alias("context_id"), context_id(dims_key(dims)).alias("name"))


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a member network; nations go on in a link role of their own."""
    nation, customer = model.table(spark, sf_dir, "nation"), model.table(spark, sf_dir, "customer")
    down = nation.select(F.lit("geo").alias("elr"), F.concat(F.lit("r"), model.text("n_regionkey")).alias("source"), F.concat(F.lit("n"), model.text("n_nationkey")).alias("target"), F.lit("people").alias("target_role"))
    people = customer.select(F.lit("people").alias("elr"), F.concat(F.lit("n"), model.text("c_nationkey")).alias("source"), F.concat(F.lit("c"), model.text("c_custkey")).alias("target"), F.lit(None).cast("string").alias("target_role"))
    # customers in debt lead back to their region, so the network has cycles
    back = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal < 0").select(F.lit("people").alias("elr"), F.concat(F.lit("c"), model.text("c_custkey")).alias("source"), F.concat(F.lit("r"), model.text("n_regionkey")).alias("target"), F.lit("geo").alias("target_role"))
    return down.unionByName(people).unionByName(back)


@query(
    "dim_member_closure",
    """SELECT 'r' || n_regionkey AS head, 1 + count(DISTINCT n_nationkey) + count(DISTINCT c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
)
def dim_member_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = model.table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), model.text("n_regionkey")).alias("head")).distinct().select("head", F.lit("geo").alias("elr"), F.col("head").alias("member"))
    reached = graph.member_network(heads, _geography(spark, sf_dir))
    return reached.groupBy("head").agg(F.countDistinct("member").alias("members"))


@query("dim_usable_members", "SELECT c_nationkey AS source, c_mktsegment AS target, bool_and(c_acctbal > -900) AS usable FROM customer GROUP BY ALL")
def dim_usable_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.usable_members(model.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") > -900).alias("usable")))


@query("dim_too_many_defaults", "SELECT c_nationkey AS dim, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS defaults FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def dim_too_many_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = model.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("target"))
    return dimensional.too_many_defaults(arcs).select("dim", F.array_join("defaults", ",").alias("defaults"))


def _cubes(spark: SparkSession) -> tuple[DataFrame, ...]:
    """A closed cube over segment and priority, an open one over segment alone, and a forbidden combination."""
    cubes = local_table(spark, [("narrow", "all", True, "scenario", 1), ("wide", "all", False, "scenario", 2), ("banned", "notAll", False, "scenario", 3)], "cube string, arcrole string, closed boolean, context_element string, cube_ord int")
    items = local_table(spark, [(c, "OrderTotal") for c in ("narrow", "wide", "banned")], "cube string, concept string")
    dims = local_table(spark, [("narrow", "segment", 1), ("narrow", "priority", 2), ("wide", "status", 1), ("banned", "segment", 1), ("banned", "priority", 2)], "cube string, dim string, dim_ord int")
    segments, priorities = ("AUTOMOBILE", "BUILDING", "MACHINERY"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    members = local_table(spark, 
        [*(("narrow", "segment", s) for s in segments), *(("narrow", "priority", p) for p in priorities), ("banned", "segment", "BUILDING"), ("banned", "priority", "1-URGENT"), ("wide", "status", "O")],
        "cube string, dim string, member string",
    )
    dimensions = local_table(spark, [("segment", "explicit", None), ("priority", "explicit", None), ("status", "explicit", "F")], "dim string, dim_type string, default_member string")
    return cubes, items, dims, members, dimensions


ORDERS = """
o AS (SELECT 'o' || o_orderkey AS context_id, o_orderkey AS k, o_custkey, o_orderstatus AS st, c_mktsegment AS seg, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS prio FROM orders JOIN customer ON o_custkey = c_custkey),
narrow AS (SELECT *, (seg NOT IN ('AUTOMOBILE','BUILDING','MACHINERY'))::INT AS bad_seg, (prio IS NOT NULL AND prio NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW'))::INT AS bad_prio, (prio IS NULL)::INT AS no_prio, (st = 'F')::INT AS bad_status FROM o)"""
# the status dimension belongs to the open cube, so the closed one doesn't mind it; its default may be absent


@query(
    "dim_invalid_facts",
    f"""WITH {ORDERS}, w AS (SELECT *, bad_seg + bad_prio + no_prio AS e1, bad_status AS e2 FROM narrow),
b AS (SELECT *, e1 > 0 AND e2 > 0 AND e1 <= e2 AS use1, e1 > 0 AND e2 > 0 AND e1 > e2 AS use2 FROM w)
SELECT context_id, 'narrow' AS hypercube, 'segment' AS dimension, 'INVALID_MEMBER' AS constraint_type FROM b WHERE use1 AND bad_seg = 1
UNION ALL SELECT context_id, 'narrow', 'priority', 'INVALID_MEMBER' FROM b WHERE use1 AND bad_prio = 1
UNION ALL SELECT context_id, 'narrow', 'priority', 'CLOSED_MISSING_DIMENSION' FROM b WHERE use1 AND no_prio = 1
UNION ALL SELECT context_id, 'wide', 'status', 'INVALID_MEMBER' FROM b WHERE use2 AND bad_status = 1
UNION ALL SELECT context_id, 'banned', 'segment', 'PROHIBITED_COMBINATION' FROM b WHERE seg = 'BUILDING' AND prio = '1-URGENT'""",
)
def dim_invalid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dimensional.fact_findings(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), *_cubes(spark))
    return found.select("context_id", "hypercube", "dimension", "constraint_type")


@query(
    "dim_invalid_facts_one_cube",
    f"""WITH {ORDERS} SELECT context_id, 'UNDECLARED_DIMENSION' AS constraint_type, 'status' AS dimension FROM narrow WHERE bad_status = 1
UNION ALL SELECT context_id, 'INVALID_MEMBER', 'segment' FROM narrow WHERE bad_seg = 1 UNION ALL SELECT context_id, 'INVALID_MEMBER', 'priority' FROM narrow WHERE bad_prio = 1
UNION ALL SELECT context_id, 'CLOSED_MISSING_DIMENSION', 'priority' FROM narrow WHERE no_prio = 1""",
)
def dim_invalid_facts_one_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes, items, dims, members, dimensions = _cubes(spark)
    found = dimensional.fact_findings(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), cubes.where("cube = 'narrow'"), items.where("cube = 'narrow'"), dims, members, dimensions)
    return found.select("context_id", "constraint_type", "dimension")


@query("dim_ignored_dimension", f"WITH {ORDERS} SELECT constraint_type, count(*) AS facts FROM (SELECT 'INVALID_MEMBER' AS constraint_type FROM narrow WHERE bad_seg = 1 UNION ALL SELECT 'INVALID_MEMBER' FROM narrow WHERE bad_prio = 1 UNION ALL SELECT 'CLOSED_MISSING_DIMENSION' FROM narrow WHERE no_prio = 1) GROUP BY 1")
def dim_ignored_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes, items, dims, members, dimensions = _cubes(spark)
    found = dimensional.fact_findings(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), cubes.where("cube = 'narrow'"), items.where("cube = 'narrow'"), dims, members, dimensions, ignored=("status",))
    return found.groupBy("constraint_type").agg(F.count("*").alias("facts"))


@query("dim_container_mismatch", "SELECT 'o' || o_orderkey AS context_id, 'segment' AS dimension FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0")
def dim_container_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes, items, dims, _, _ = _cubes(spark)
    return dimensional.container_mismatches(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), cubes, items, dims).select("context_id", "dimension")


@query("dim_default_used", "SELECT 'o' || o_orderkey AS context_id, 'status' AS dimension FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def dim_default_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = local_table(spark, [(d, dimensional.DIMENSION_ITEM, None) for d in ("segment", "priority", "status")], "concept string, substitution_group string, typed_domain string")
    found = dimensional.context_findings(model.contexts(spark, sf_dir), concepts, _cubes(spark)[4])
    return found.where("rule_id = 'xbrldie:DefaultValueUsedInInstanceError'").select("context_id", "dimension")


@query("dim_not_explicit", "SELECT 'xbrldie:ExplicitMemberNotExplicitDimensionError' AS rule_id, count(*) AS members FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'xbrldie:TypedMemberNotTypedDimensionError', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0")
def dim_not_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = local_table(spark, [("segment", "other", None), ("priority", dimensional.DIMENSION_ITEM, None), ("status", dimensional.DIMENSION_ITEM, None)], "concept string, substitution_group string, typed_domain string")
    found = dimensional.context_findings(model.contexts(spark, sf_dir), concepts, _cubes(spark)[4])
    return found.where("rule_id LIKE '%MemberNot%'").groupBy("rule_id").agg(F.count("*").alias("members"))


@query("dim_repeated", "SELECT 'o' || l_orderkey AS context_id, l_returnflag AS dimension FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dim_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = model.table(spark, sf_dir, "lineitem").select(F.lit("lines").alias("instance_id"), model.order_id("l_orderkey").alias("context_id"), F.col("l_returnflag").alias("dim"))
    return dimensional.repeated_dimensions(members).select("context_id", "dimension")


@query(
    "sg_closure",
    """WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN -1 WHEN p_size = 1 THEN 0 ELSE p_partkey // 2 END AS head FROM part),
r AS (SELECT k FROM e WHERE head = 0 UNION SELECT e.k FROM e JOIN r ON e.head = r.k) SELECT CAST(k AS VARCHAR) AS concept FROM r""",
)
def sg_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = model.table(spark, sf_dir, "part")
    head = F.when(F.col("p_partkey") % 11 == 0, "-1").when((F.col("p_size") == 1) | (F.col("p_partkey") < 2), "item").otherwise(model.text(F.floor(F.col("p_partkey") / 2)))
    return graph.substitution_closure(part.select(model.text("p_partkey").alias("concept"), head.alias("substitution_group")), ("item",)).select("concept")


@query("net_roots", "SELECT DISTINCT l_linestatus AS elr, l_partkey AS node FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linestatus = a.l_linestatus AND b.l_suppkey = a.l_partkey)")
def net_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = model.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("elr"), F.col("l_partkey").alias("parent"), F.col("l_suppkey").alias("child"))
    return graph.roots(arcs)


@query(
    "dim_global_members",
    """SELECT 'region' AS dim, 'n' || n_nationkey AS member, TRUE AS usable FROM nation
UNION ALL SELECT 'region', 'c' || c_custkey, c_acctbal >= 0 FROM customer""",
)
def dim_global_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = model.table(spark, sf_dir, "nation"), model.table(spark, sf_dir, "customer")
    domains = nation.select(F.lit("region").alias("source"), F.concat(F.lit("n"), model.text("n_nationkey")).alias("target"), F.lit(True).alias("usable"))
    members = customer.select(F.concat(F.lit("n"), model.text("c_nationkey")).alias("source"), F.concat(F.lit("c"), model.text("c_custkey")).alias("target"), (F.col("c_acctbal") >= 0).alias("usable"))
    return dimensional.global_members(domains, members)


@query("net_enumeration_members", "SELECT 'r' || n_regionkey AS concept, 'c' || c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region WHERE r_regionkey > 2")
def net_enumeration_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = _geography(spark, sf_dir).join(model.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), model.text("c_custkey")).alias("target"), (F.col("c_acctbal") >= 0).alias("usable")), "target", "left")
    region = model.table(spark, sf_dir, "region")
    head = F.concat(F.lit("r"), model.text("r_regionkey"))
    domains = region.select(head.alias("concept"), F.lit("geo").alias("elr"), head.alias("head"), (F.col("r_regionkey") > 2).alias("head_usable"))
    return graph.enumeration_members(domains, arcs)


@query("net_descendant_leaves", "SELECT 'r' || n_regionkey AS head, 'c' || c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def net_descendant_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = model.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), model.text("r_regionkey")).alias("head")).select("head", F.lit("geo").alias("elr"), F.col("head").alias("member"))
    return graph.descendants(heads, _geography(spark, sf_dir), leaves_only=True)
