"""Queries of filters, assertions, tables, labels, reports and edits, with their SQL twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.keys import unit_signature
from ..functions.xpath import Scope, Value, compile_expression
from ..operators import conformance, dml, filters, formula, graph, labels, report, tables
from ..operators.filters import BooleanFilter, DimensionFilter, TypedFilter, VariableFilter
from ..operators.findings import finding
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


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = model.table(spark, sf_dir, "customer").select(model.text("c_custkey").alias("instance_id"), F.lit("USD").alias("unit_id"), F.array(F.lit("{iso}USD")).alias("numerator"))
    return formula.enrich(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), units)


OC = "orders JOIN customer ON o_custkey = c_custkey"
ID = "'o' || o_orderkey AS context_id"


def _filter(name: str, f: VariableFilter, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: filters.select(_facts(spark, sf_dir), f).select("context_id", "value")
    ORACLE_SQL[name] = f"SELECT {ID}, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM {OC} WHERE {where}"


_filter("filter_concept_period", VariableFilter("OrderTotal", "duration"), "o_orderpriority = '5-LOW'")
_filter("filter_unit", VariableFilter(unit="US", dimensions=[DimensionFilter("status")]), "o_orderstatus = 'F'")
_filter("filter_dim_include", VariableFilter(dimensions=[DimensionFilter("segment", ("BUILDING", "MACHINERY"))]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_dim_exclude", VariableFilter(dimensions=[DimensionFilter("priority", ("1-URGENT",), exclude=True), DimensionFilter("status", exclude=True)]), "o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT'")
_filter("filter_typed_presence", VariableFilter(typed=[TypedFilter("clerk")]), "o_orderkey % 2 = 0")
_filter(
    "filter_boolean_tree",
    VariableFilter(booleans=[BooleanFilter("or", (DimensionFilter("status", exclude=True), BooleanFilter("and", (DimensionFilter("segment", ("BUILDING",)), TypedFilter("clerk", exclude=True)), complement=True)))]),
    "o_orderstatus <> 'F' OR NOT (c_mktsegment = 'BUILDING' AND o_orderkey % 2 <> 0)",
)
_filter("filter_xpath_value", VariableFilter(xpaths=[". gt 200000 and . lt 400000"]), "CAST(o_totalprice AS DECIMAL(18,2)) > 200000 AND CAST(o_totalprice AS DECIMAL(18,2)) < 400000")


def _assertion(kind: str, expression: str = "", **more) -> formula.Assertion:
    both = {"big": VariableFilter("OrderTotal", xpaths=[". gt 300000"]), "any": VariableFilter("OrderTotal", dimensions=[DimensionFilter("status")])}
    return formula.Assertion("a1", kind, both, expression, **more)


BOUND = f"""
f AS (SELECT {ID}, CAST(o_custkey AS VARCHAR) AS instance_id, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderstatus = 'F' AS any_, CAST(o_totalprice AS DECIMAL(18,2)) > 300000 AS big FROM {OC})"""


@query(
    "formula_value_assertion",
    f"WITH {BOUND} SELECT context_id, CASE WHEN NOT any_ OR NOT big THEN 'NOT_EVALUATED' WHEN v < 350000 THEN 'PASS' ELSE 'FAIL' END AS status FROM f WHERE any_ OR big",
)
def formula_value_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formula.evaluate(_facts(spark, sf_dir), _assertion("value", "$big lt 350000 and $any eq $big"), match_on=["context_id", "unit_id"])
    return found.select("context_id", "status")


@query("formula_existence", f"WITH {BOUND} SELECT instance_id, CASE WHEN bool_or(any_ OR big) THEN 'PASS' ELSE 'FAIL' END AS status FROM f GROUP BY 1")
def formula_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula.evaluate(_facts(spark, sf_dir), _assertion("existence")).select("instance_id", "status")


@query(
    "formula_consistency_radius",
    f"WITH {BOUND} SELECT context_id, CASE WHEN abs((CASE WHEN any_ THEN v ELSE 0 END) * 0.9 - v) <= 40000 THEN 'PASS' ELSE 'FAIL' END AS status FROM f WHERE any_ OR big",
)
def formula_consistency_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formula.evaluate(_facts(spark, sf_dir), _assertion("consistency", "$any * 0.9", absolute_radius="40000"), match_on=["context_id", "unit_id"])
    return found.select("context_id", "status")


@query(
    "formula_cartesian_binding",
    """WITH f AS (SELECT o_custkey AS i, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT DISTINCT i FROM f),
b AS (SELECT i, v AS big FROM f WHERE v > 480000), m AS (SELECT i, v AS small FROM f WHERE v < 20000)
SELECT CAST(s.i AS VARCHAR) AS instance_id, CASE WHEN big IS NULL OR small IS NULL THEN 'NOT_EVALUATED' WHEN big - small > 475000 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS bindings
FROM s LEFT JOIN b ON s.i = b.i LEFT JOIN m ON s.i = m.i GROUP BY ALL""",
)
def formula_cartesian_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = {"big": VariableFilter("OrderTotal", xpaths=[". gt 480000"]), "small": VariableFilter("OrderTotal", xpaths=[". lt 20000"])}
    found = formula.evaluate(_facts(spark, sf_dir), formula.Assertion("a2", "value", variables, "$big - $small gt 475000"))
    return found.groupBy("instance_id", "status").agg(F.count("*").alias("bindings"))


def many_assertions(times: int) -> list[formula.Assertion]:
    """times value, existence and consistency assertions each, with thresholds of their own."""
    made = []
    for i in range(times):
        value = _assertion("value", f"$big lt {300000 + 7000 * i} and $any eq $big")
        there = {"big": VariableFilter("OrderTotal", xpaths=[f". gt {200000 + 9000 * i}"])}
        near = _assertion("consistency", "$any * 0.9", absolute_radius=str(20000 + 2000 * i))
        made += [replace(value, assertion_id=f"v{i}"), formula.Assertion(f"e{i}", "existence", there, severity="warning"), replace(near, assertion_id=f"c{i}")]
    return made


@query(
    "formula_many_assertions",
    f"""WITH {BOUND}, n AS (SELECT range AS i FROM range(12)), found AS (
SELECT 'v' || i AS rule_id, 'error' AS severity, CASE WHEN NOT any_ OR NOT big THEN 'NOT_EVALUATED' WHEN v < 300000 + 7000 * i THEN 'PASS' ELSE 'FAIL' END AS status FROM f, n WHERE any_ OR big
UNION ALL SELECT 'e' || i, 'warning', CASE WHEN bool_or(v > 200000 + 9000 * i) THEN 'PASS' ELSE 'FAIL' END FROM f, n GROUP BY i, instance_id
UNION ALL SELECT 'c' || i, 'error', CASE WHEN abs((CASE WHEN any_ THEN v ELSE 0 END) * 0.9 - v) <= 20000 + 2000 * i THEN 'PASS' ELSE 'FAIL' END FROM f, n WHERE any_ OR big)
SELECT rule_id, severity, status, count(*) AS findings FROM found GROUP BY ALL""",
)
def formula_many_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formula.evaluate_all(_facts(spark, sf_dir), many_assertions(12), ["context_id", "unit_id"])
    return found.groupBy("rule_id", "severity", "status").agg(F.count("*").alias("findings"))


def _expression(name: str, expression: str, kind: str, sql: str, variables: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scope = Scope({v: Value("any", model.text(F.col(c).cast(model.MONEY))) for v, c in (variables or {}).items()})
        value = compile_expression(expression, scope)
        column = {"boolean": value.boolean, "number": lambda: value.number().cast("double"), "string": value.text}[kind]()
        return model.table(spark, sf_dir, "orders").select("o_orderkey", column.alias("result"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT o_orderkey, {sql} AS result FROM orders"


PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_expression("xpath_conditional", "if ($p ge 100000) then floor($p div 1000) else abs(-$p)", "number", f"CAST(CASE WHEN {PRICE} >= 100000 THEN floor({PRICE} / 1000) ELSE {PRICE} END AS DOUBLE)", {"p": "o_totalprice"})
_expression("xpath_sequence", "sum(($p, 10, 5)) - max((1, $p)) + count((1, 2, 3))", "number", f"CAST({PRICE} + 15 - greatest(1, {PRICE}) + 3 AS DOUBLE)", {"p": "o_totalprice"})
_expression("xpath_text", "concat(substring(string($p), 1, 3), '-', upper-case('ab'))", "string", f"substr(rtrim(rtrim(CAST({PRICE} AS VARCHAR), '0'), '.'), 1, 3) || '-AB'", {"p": "o_totalprice"})
_expression("xpath_quantified", "some $x in (1000, $p, 250000) satisfies $x > 250000", "boolean", f"{PRICE} > 250000", {"p": "o_totalprice"})
_expression("iaf_numeric_equal", "iaf:numeric-equal($p, 150000, 50000)", "boolean", f"abs({PRICE} - 150000) <= 50000", {"p": "o_totalprice"})
_expression("efn_imp", "efn:imp($p gt 100000, $p gt 200000)", "boolean", f"NOT ({PRICE} > 100000) OR {PRICE} > 200000", {"p": "o_totalprice"})


@query(
    "xfi_filing_aggregates",
    """SELECT CAST(o_custkey AS VARCHAR) AS instance_id, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS instants,
CASE WHEN count(DISTINCT CAST(o_orderdate AS DATE)) = 1 THEN strftime(min(o_orderdate), '%Y-%m-%d') END AS single FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def xfi_filing_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicators = local_table(spark, [], "instance_id string, template string, filed boolean")
    whole = formula.filing_aggregates(model.contexts(spark, sf_dir), indicators)
    single = compile_expression("xfi:single-unique-instant-date()").text()
    return whole.select("instance_id", F.array_join("all_instants", ",").alias("instants"), single.alias("single"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations over a column each for odd nations, as an axis: regions of even keys are roll-ups."""
    region, nation = model.table(spark, sf_dir, "region"), model.table(spark, sf_dir, "nation")
    blank, none = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    top = spark.range(1).select(F.lit("all").alias("node_id"), blank.alias("parent_id"), F.lit(0.0).alias("ord"), F.lit("All").alias("label"), F.lit("0").alias("code"), F.lit(True).alias("is_abstract"), F.lit(True).alias("parent_first"), F.lit("Balance").alias("concept"), none.alias("dims"))
    regions = region.select(F.concat(F.lit("r"), model.text("r_regionkey")).alias("node_id"), F.lit("all").alias("parent_id"), (-F.col("r_regionkey")).cast("double").alias("ord"), F.col("r_name").alias("label"), model.text(F.col("r_regionkey") * 100).alias("code"), (F.col("r_regionkey") % 2 == 1).alias("is_abstract"), (F.col("r_regionkey") % 4 == 0).alias("parent_first"), blank.alias("concept"), F.create_map(F.lit("region"), "r_name").alias("dims"))
    nations = nation.select(F.concat(F.lit("n"), model.text("n_nationkey")).alias("node_id"), F.concat(F.lit("r"), model.text("n_regionkey")).alias("parent_id"), F.lit(1.0).alias("ord"), F.col("n_name").alias("label"), model.text("n_nationkey").alias("code"), F.lit(False).alias("is_abstract"), F.lit(True).alias("parent_first"), blank.alias("concept"), F.create_map(F.lit("nation"), "n_name").alias("dims"))
    return top.unionByName(regions).unionByName(nations).select(F.lit("t1").alias("table_id"), F.lit("y").alias("axis"), "*")


TREE = """
w AS (SELECT 'n' || n_nationkey AS node_id, n_regionkey AS rk, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY 'n' || n_nationkey) AS i, n_nationkey AS nk FROM nation),
t AS (SELECT 'all' AS node_id, 0 AS a, 0 AS b, 0 AS level, NULL AS rk, TRUE AS abs_ UNION ALL SELECT 'r' || r_regionkey, 100 - r_regionkey, 0, 1, r_regionkey, r_regionkey % 2 = 1 FROM region UNION ALL SELECT node_id, 100 - rk, i, 2, rk, FALSE FROM w)"""


@query("table_axis_rows", f"WITH {TREE} SELECT node_id, level, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS row_ord FROM t")
def table_axis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.axis_rows(_tree(spark, sf_dir)).select("node_id", "level", F.col("row_ord").cast("int").alias("row_ord"))


@query("table_axis_leaves", f"WITH {TREE}, l AS (SELECT *, CASE WHEN level = 1 AND rk % 4 <> 0 THEN 1000 ELSE b END AS b2 FROM t WHERE level = 2 OR level = 1 AND NOT abs_) SELECT node_id, CAST(row_number() OVER (ORDER BY a, b2) - 1 AS INTEGER) AS leaf_ord FROM l")
def table_axis_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.axis_leaves(_tree(spark, sf_dir)).select("node_id", F.col("leaf_ord").cast("int").alias("leaf_ord"))


@query(
    "table_header_spans",
    f"""WITH {TREE}, c AS (SELECT rk, count(*) + CASE WHEN rk % 2 = 0 THEN 1 ELSE 0 END AS n FROM t WHERE level = 2 GROUP BY rk)
SELECT node_id, CAST(CASE level WHEN 2 THEN 1 WHEN 1 THEN (SELECT n FROM c WHERE c.rk = t.rk) ELSE (SELECT sum(n) FROM c) END AS INTEGER) AS span FROM t""",
)
def table_header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_spans(_tree(spark, sf_dir)).select("node_id", "span")


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.axis_rows(_tree(spark, sf_dir)).where("NOT is_abstract").select("table_id", "row_ord", "code", "concept", F.map_filter("dims", lambda k, v: k == "nation").alias("dims"))
    segments = model.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s")).distinct()
    columns = segments.select(F.lit("t1").alias("table_id"), F.dense_rank().over(_by("s")).alias("leaf_ord"), model.text(F.dense_rank().over(_by("s")) * 1000).alias("code"), F.lit(None).cast("string").alias("concept"), F.create_map(F.lit("segment"), "s").alias("dims"))
    return tables.cells(rows, columns)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


CELLS = f"""
{TREE}, r AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS row_ord, * FROM t), s AS (SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment) AS c FROM (SELECT DISTINCT c_mktsegment FROM customer)),
cells AS (SELECT row_ord, CAST(c AS INTEGER) AS col_ord, seg, w.n_name, printf('%04d', coalesce(w.nk, r.rk * 100) + c * 1000) AS cell_code FROM r LEFT JOIN w ON w.node_id = r.node_id CROSS JOIN s WHERE NOT abs_)"""


@query("table_cells", f"WITH {CELLS} SELECT row_ord, col_ord, 'Balance' AS concept, cell_code, coalesce('nation=' || n_name || '|', '') || 'segment=' || seg AS dims FROM cells")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import dims_key

    return _body(spark, sf_dir).select(F.col("row_ord").cast("int").alias("row_ord"), F.col("col_ord").cast("int").alias("col_ord"), "concept", "cell_code", dims_key(F.col("dims")).alias("dims"))


@query(
    "table_fact_match",
    f"""WITH {CELLS}, f AS (SELECT n_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg, arg_min(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), c_custkey) AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT row_ord, col_ord, f.value AS value, n AS duplicates FROM cells LEFT JOIN f ON f.n_name = cells.n_name AND coalesce(f.seg, 'BUILDING') = cells.seg""",
)
def table_fact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = model.table(spark, sf_dir, "customer"), model.table(spark, sf_dir, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # the default member of the segment is never reported
    dims = F.map_filter(F.create_map(F.lit("nation"), "n_name", F.lit("segment"), "c_mktsegment"), lambda k, v: v != "BUILDING")
    contexts = joined.select(F.lit("all").alias("instance_id"), model.text("c_custkey").alias("context_id"), dims.alias("dims"), F.create_map().cast("map<string,string>").alias("typed"))
    facts = model.customer_facts(spark, sf_dir).withColumns({"instance_id": F.lit("all"), "concept": F.lit("Balance")})
    filled = tables.fill(_body(spark, sf_dir), facts, contexts, {"segment": "BUILDING"})
    return filled.select(F.col("row_ord").cast("int").alias("row_ord"), F.col("col_ord").cast("int").alias("col_ord"), "value", "duplicates")


@query("table_excluded_cells", f"WITH {CELLS} SELECT row_ord, col_ord, NOT (n_name IS NOT NULL AND seg IN ('BUILDING', 'MACHINERY')) AS excluded FROM cells")
def table_excluded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes = local_table(spark, [("c1", "role/t1/a", "all", True), ("c2", "role/t10", "all", True)], "cube string, elr string, arcrole string, closed boolean")
    items = local_table(spark, [("c1", "Balance"), ("c2", "Balance")], "cube string, concept string")
    roles = local_table(spark, [("t1", "role/t1")], "table_id string, table_elr string")
    nations = model.table(spark, sf_dir, "nation").select(F.lit("c1").alias("cube"), F.lit("nation").alias("dim"), F.col("n_name").alias("member"))
    segments = local_table(spark, [("c1", "segment", s) for s in ("BUILDING", "MACHINERY")], "cube string, dim string, member string")
    body = _body(spark, sf_dir)
    # a row without a nation lacks the dimension that the cube asks for
    body = body.withColumn("dims", F.when(F.map_contains_key("dims", "nation"), F.col("dims")).otherwise(F.map_concat("dims", F.create_map(F.lit("nation"), F.lit("(none)")))))
    found = tables.excluded_cells(body, cubes, items, nations.unionByName(segments), roles)
    return found.select(F.col("row_ord").cast("int").alias("row_ord"), F.col("col_ord").cast("int").alias("col_ord"), "excluded")


@query("table_open_rows", f"SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS instance_id, o_orderpriority AS member FROM {OC} WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'")
def table_open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.open_rows(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), "OrderTotal", {"segment": "BUILDING"}, "priority")


@query(
    "table_z_members",
    f"""SELECT dim, member, count(*) AS contexts FROM (SELECT 'segment' AS dim, c_mktsegment AS member FROM {OC} UNION ALL SELECT 'priority', o_orderpriority FROM {OC} WHERE o_orderstatus <> 'P' UNION ALL SELECT 'status', 'F' FROM {OC} WHERE o_orderstatus = 'F') GROUP BY ALL""",
)
def table_z_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.used_members(model.contexts(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = model.table(spark, sf_dir, "part")
    lang = F.when(F.col("p_size") % 3 == 0, "en").when(F.col("p_size") % 3 == 1, "es").otherwise("fr")
    return part.select(F.col("p_brand").alias("concept"), F.concat_ws(" ", "p_name", model.text("p_partkey")).alias("text"), lang.alias("lang"), F.when(F.col("p_size") % 2 == 0, labels.STANDARD).otherwise("terse").alias("role"), F.lit("standard").alias("source"), F.col("p_size").alias("priority"))


@query(
    "label_best",
    """WITH l AS (SELECT p_brand AS concept, p_name || ' ' || p_partkey AS text, p_size % 3 AS g, p_size % 2 = 0 AS std, p_size AS priority FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY std, CASE g WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END, priority DESC, text) AS i FROM l) SELECT concept, text FROM k WHERE i = 1""",
)
def label_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labels(spark, sf_dir)
    return labels.best_labels(found.select("concept").distinct(), found, "terse", ("es", "en"))


@query("label_search", "SELECT DISTINCT p_brand AS concept FROM part WHERE lower(p_name || ' ' || p_partkey) LIKE '%77%' OR lower(p_brand) LIKE '%77%'")
def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.search(_labels(spark, sf_dir), "77")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = model.table(spark, sf_dir, "events").select(model.text(F.col("user_id") % 50).alias("instance_id"), F.col("event_type").alias("table_id"), "value", F.col("event_id"))
    status = F.when(F.col("value") > 60, "PASS").when(F.col("value") > 50, "NOT_EVALUATED").otherwise("FAIL")
    return finding(events, F.concat(F.lit("rule:"), "table_id"), "formula", F.lit(""), status=status, severity="error").withColumn("severity", F.when(F.col("table_id") == "click", "warning").otherwise("error"))


EVENTS = "e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS instance_id, event_type AS table_id, CASE WHEN value > 60 THEN 'PASS' WHEN value > 50 THEN 'NOT_EVALUATED' ELSE 'FAIL' END AS status, CASE WHEN event_type = 'click' THEN 'warning' ELSE 'error' END AS severity FROM events)"


@query(
    "report_summary",
    f"""WITH {EVENTS} SELECT instance_id, count(*) FILTER (status = 'FAIL' AND severity = 'error') AS errors, count(*) FILTER (status = 'FAIL' AND severity = 'warning') AS warnings,
count(*) FILTER (status = 'PASS') AS passes, count(*) FILTER (status = 'NOT_EVALUATED') AS not_evaluated, errors = 0 AS passed FROM e GROUP BY 1""",
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_findings(spark, sf_dir))


@query("report_facets", f"WITH {EVENTS} SELECT table_id, count(*) AS findings, count(*) FILTER (status = 'PASS') AS passes, count(*) FILTER (status = 'FAIL' AND severity = 'error') AS errors FROM e GROUP BY 1")
def report_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.facets(_findings(spark, sf_dir))


@query("report_slice", f"WITH {EVENTS} SELECT instance_id, count(*) AS findings FROM e WHERE status = 'FAIL' AND severity = 'warning' AND table_id = 'click' GROUP BY 1")
def report_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.only(_findings(spark, sf_dir), "warning", "click").groupBy("instance_id").agg(F.count("*").alias("findings"))


@query(
    "suite_rollup",
    """WITH v AS (SELECT l_returnflag AS suite_id, l_orderkey * 10 + l_linenumber AS variation_id, max(l_quantity) AS q, min(l_linenumber) AS n, bool_or(l_tax > 0.05) AS t FROM lineitem GROUP BY ALL),
o AS (SELECT suite_id, CASE WHEN n = 7 THEN 'skipped' WHEN (q > 25) = t THEN 'pass' ELSE 'fail' END AS outcome FROM v)
SELECT suite_id, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'error') AS error, count(*) FILTER (outcome = 'skipped') AS skipped,
CASE WHEN count(*) FILTER (outcome = 'fail') > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, CAST(CASE WHEN count(*) FILTER (outcome = 'fail') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM o GROUP BY 1""",
)
def suite_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = model.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("suite_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("variation_id"), "l_quantity", "l_linenumber", "l_tax")
    variations = lines.groupBy("suite_id", "variation_id").agg(F.when(F.max("l_quantity") > 25, "error").otherwise("valid").alias("expected_type"), F.lit("xbrl:oops").alias("expected_code"), F.lit(True).alias("mandatory"))
    bad = lines.where("l_tax > 0.05").select("suite_id", "variation_id", F.lit("{x}oops").alias("code"))
    skipped = lines.where("l_linenumber = 7").select("suite_id", "variation_id", F.lit("skipped").alias("code"))
    actual = bad.unionByName(skipped).withColumn("exception_message", F.lit(None).cast("string"))
    return conformance.rollup(conformance.outcomes(variations, actual))


@query("indicator_alias_match", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS instance_id, 'table' || (event_id % 7) AS table_id FROM events WHERE value > 50")
def indicator_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = local_table(spark, [(f"table{i}", f"b_0{i}.00") for i in range(7)], "table_id string, template string")
    events = model.table(spark, sf_dir, "events")
    filed = events.select(model.text("user_id").alias("instance_id"), F.concat(F.lit("ES_T_0"), model.text(F.col("event_id") % 7), F.lit(".00")).alias("template"), (F.col("value") > 50).alias("filed"))
    return tables.filed_tables(listed, filed)


@query("scalar_cell_code", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN printf('%04d', p_size * 10 + CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END) END AS code FROM part")
def scalar_cell_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return model.table(spark, sf_dir, "part").select("p_partkey", scalars.cell_code(F.when(size % 4 == 0, "x").otherwise(model.text(size * 10)), F.when(size % 3 != 0, model.text(size))).alias("code"))


@query(
    "scalar_normalized_number",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS number FROM orders""",
)
def scalar_normalized_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast(model.MONEY)
    plain = F.format_number(price, 2)
    continental = F.translate(plain, ",.", ".,")
    written = F.when(F.col("o_orderkey") % 3 == 0, plain).when(F.col("o_orderkey") % 3 == 1, continental).otherwise(F.concat(F.lit(" "), model.text(F.floor("o_totalprice"))))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", scalars.normalized_number(written).alias("number"))


@query("scalar_unit_signature", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_name || '/' || n_comment ELSE least(n_name, n_comment) || '*' || greatest(n_name, n_comment) END AS signature FROM (SELECT *, 'M' || n_regionkey AS n_comment FROM nation)")
def scalar_unit_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    other, none = F.concat(F.lit("M"), model.text("n_regionkey")), F.array().cast("array<string>")
    over = F.when(F.col("n_regionkey") == 0, F.array("n_name")).otherwise(F.array("n_name", other))
    return model.table(spark, sf_dir, "nation").select("n_nationkey", unit_signature(over, F.when(F.col("n_regionkey") == 0, F.array(other)).otherwise(none)).alias("signature"))


@query("scalar_valid_value", "SELECT event_id, event_type <> 'click' OR length(CAST(user_id AS VARCHAR)) > 0 AS ok FROM events")
def scalar_valid_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_type") == "click", "integer").otherwise("string")
    return model.table(spark, sf_dir, "events").select("event_id", scalars.valid_value(model.text("user_id"), category).alias("ok"))


@query(
    "dml_add_facts",
    """WITH old AS (SELECT l_partkey % 5 AS c, l_orderkey AS x FROM lineitem WHERE l_returnflag = 'R'), new AS (SELECT l_partkey % 5 AS c, l_orderkey AS x, row_number() OVER (PARTITION BY l_partkey % 5, l_orderkey) AS nth FROM lineitem WHERE l_returnflag = 'A'),
tried AS (SELECT nth = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.c = new.c AND old.x = new.x) AS free FROM new)
SELECT CASE WHEN free THEN 'accepted' ELSE 'refused' END AS outcome, count(*) AS facts FROM tried GROUP BY 1""",
)
def dml_add_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(flag: str) -> DataFrame:
        lines = model.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
        return lines.select(model.text(F.col("l_orderkey") % 100).alias("instance_id"), model.text(F.col("l_partkey") % 5).alias("concept"), model.text("l_orderkey").alias("context_id")).withColumns({"fact_ord": F.lit(0).cast("long"), "value": F.lit(flag)})

    old = of("R")
    both, refused = dml.add_facts(old, of("A"))
    counted = both.agg(F.count_if(F.col("value") == "A").alias("facts")).select(F.lit("accepted").alias("outcome"), "facts")
    return counted.unionByName(refused.agg(F.count("*").alias("facts")).select(F.lit("refused").alias("outcome"), "facts"))


@query(
    "dml_set_indicators",
    """WITH old AS (SELECT user_id AS i, event_type AS t, bool_or(value > 50) AS f FROM events GROUP BY ALL), new AS (SELECT user_id AS i, event_type AS t, bool_or(value > 90) AS f FROM events WHERE event_type <> 'click' GROUP BY ALL)
SELECT CAST(coalesce(old.i, new.i) AS VARCHAR) AS instance_id, coalesce(old.t, new.t) AS template, coalesce(new.f, old.f) AS filed FROM old FULL JOIN new ON old.i = new.i AND old.t = new.t""",
)
def dml_set_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = model.table(spark, sf_dir, "events")

    def of(events: DataFrame, least: float) -> DataFrame:
        return events.groupBy(model.text("user_id").alias("instance_id"), F.col("event_type").alias("template")).agg(F.bool_or(F.col("value") > least).alias("filed"))

    return dml.set_indicators(of(events, 50), of(events.where("event_type <> 'click'"), 90))


@query("net_tree_order", f"WITH {TREE} SELECT node_id, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS place FROM t")
def net_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    placed = graph.tree_paths(_tree(spark, sf_dir))
    return placed.select("node_id", F.row_number().over(Window.partitionBy("table_id").orderBy("path")).alias("place"))


@query(
    "table_z_leaves",
    f"WITH {TREE}, l AS (SELECT *, CASE WHEN level = 1 AND rk % 4 <> 0 THEN 1000 ELSE b END AS b2 FROM t WHERE level = 2 OR level = 1 AND NOT abs_) SELECT CAST(row_number() OVER (ORDER BY a, b2) - 1 AS INTEGER) AS z_ord, coalesce((SELECT n_name FROM w WHERE w.node_id = l.node_id), (SELECT r_name FROM region WHERE r_regionkey = rk)) AS label FROM l",
)
def table_z_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.z_leaves(_tree(spark, sf_dir)).select(F.col("z_ord").cast("int").alias("z_ord"), "label")


@query("table_order", f"WITH {TREE} SELECT nation.n_name AS table_id, CAST(row_number() OVER (ORDER BY t.node_id IS NULL, a, b, nation.n_name) AS INTEGER) AS place FROM nation LEFT JOIN w ON w.nk = n_nationkey AND n_regionkey <> 2 LEFT JOIN t ON t.node_id = w.node_id")
def table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir).where("parent_id IS NULL OR parent_id <> 'r2'")
    named = tree.withColumn("node_id", F.when(F.startswith("node_id", F.lit("n")), F.col("label")).otherwise(F.col("node_id")))
    # siblings of equal order stand by name of the node, as in the tree itself
    rank = tree.select(F.col("label").alias("node_id"), F.col("node_id").alias("by"))
    groups = named.join(rank, "node_id", "left").withColumn("ord", F.when(F.col("by").isNull(), F.col("ord")).otherwise(F.dense_rank().over(_by("by")).cast("double")))
    return tables.table_order(model.table(spark, sf_dir, "nation").select(F.col("n_name").alias("table_id")), groups.select("node_id", "parent_id", "ord")).select("table_id", F.col("place").cast("int").alias("place"))


@query("table_findings_located", f"WITH {CELLS} SELECT CAST(c_custkey AS VARCHAR) AS context_id, row_ord, col_ord FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN cells ON cells.n_name = n.n_name AND cells.seg = c_mktsegment WHERE c_acctbal < 0")
def table_findings_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = model.table(spark, sf_dir, "customer"), model.table(spark, sf_dir, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    contexts = joined.select(F.lit("all").alias("instance_id"), model.text("c_custkey").alias("context_id"), F.create_map(F.lit("nation"), "n_name", F.lit("segment"), "c_mktsegment").alias("dims"))
    found = finding(customer.where("c_acctbal < 0").select(F.lit("all").alias("instance_id"), model.text("c_custkey").alias("context_id"), F.lit("Balance").alias("concept")), "debt", "formula", F.lit(""))
    return tables.locate(found, contexts, _body(spark, sf_dir)).select("context_id", F.col("row_ord").cast("int").alias("row_ord"), F.col("col_ord").cast("int").alias("col_ord"))


@query("table_facts_at", f"SELECT {ID} FROM {OC} WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'")
def table_facts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = local_table(spark, [("OrderTotal", {"segment": "BUILDING", "priority": "2-HIGH"})], "concept string, dims map<string,string>")
    return tables.facts_at(model.order_facts(spark, sf_dir), model.contexts(spark, sf_dir), asked).select("context_id")


@query(
    "table_compatible_members",
    f"""SELECT DISTINCT 'priority' AS dim, o_orderpriority AS member FROM {OC} WHERE o_orderstatus <> 'P' AND c_mktsegment = 'BUILDING'
UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM {OC}""",
)
def table_compatible_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = model.contexts(spark, sf_dir)
    candidates = tables.used_members(contexts).where("dim IN ('priority', 'segment')").select("dim", "member")
    return tables.compatible_members(candidates, contexts.select("dims").where("dims IS NOT NULL"), {"segment": "BUILDING"})


@query("net_arcs_by_source", "SELECT l_linestatus AS elr, CAST(l_partkey AS VARCHAR) AS source, count(*) AS n, CAST(arg_min(l_suppkey, l_orderkey * 1e10 + l_suppkey * 100 + l_linenumber) AS VARCHAR) AS first FROM lineitem GROUP BY ALL")
def net_arcs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = model.table(spark, sf_dir, "lineitem")
    order = (F.col("l_orderkey") * F.lit(1e10) + F.col("l_suppkey") * 100 + F.col("l_linenumber")).cast("double")
    arcs = lines.select(F.col("l_linestatus").alias("elr"), model.text("l_partkey").alias("source"), model.text("l_suppkey").alias("target"), order.alias("ord"))
    return graph.arcs_by_source(arcs).select("elr", "source", "n", F.get("targets", F.lit(0)).alias("first"))


@query("report_findings_union", f"WITH {EVENTS} SELECT 'click' AS family, count(*) AS findings FROM e WHERE table_id = 'click' UNION ALL SELECT 'other', count(*) FROM e WHERE table_id <> 'click'")
def report_findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    whole = report.all_findings(found.where("table_id = 'click'"), found.where("table_id <> 'click'"))
    return whole.groupBy(F.when(F.col("source_ord") == 0, "click").otherwise("other").alias("family")).agg(F.count("*").alias("findings"))


@query("sink_prefixes", "SELECT 'http://x.com/' || n_regionkey || '/tax' || (n_nationkey % 4) AS ns, 'tax' || (n_nationkey % 4) || CASE WHEN row_number() OVER (PARTITION BY n_nationkey % 4 ORDER BY 'http://x.com/' || n_regionkey || '/tax' || (n_nationkey % 4)) = 1 THEN '' ELSE '_' || row_number() OVER (PARTITION BY n_nationkey % 4 ORDER BY 'http://x.com/' || n_regionkey || '/tax' || (n_nationkey % 4)) END AS prefix FROM (SELECT DISTINCT n_regionkey, n_nationkey % 4 AS n_nationkey FROM nation)")
def sink_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import prefixes

    nation = model.table(spark, sf_dir, "nation")
    return prefixes(nation.select(F.concat(F.lit("{http://x.com/"), model.text("n_regionkey"), F.lit("/tax"), model.text(F.col("n_nationkey") % 4), F.lit("}"), F.col("n_name")).alias("name")))
