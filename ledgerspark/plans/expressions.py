"""Queries of the expression language by family of functions, with their SQL twins.

Every order is a fact of its customer's filing. A query evaluates a family's expressions for each fact, a column
for each; the second operand of comparisons, $b, is the filing's first fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xpath import Scope, Value, compile_expression
from ..operators import formula
from . import model

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The facts as SQL: a row for each order, with the columns that the twins below refer to.
FACTS = """
f AS (
  SELECT 'o' || o_orderkey AS context_id, CAST(o_custkey AS VARCHAR) AS filing, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(o_orderdate AS DATE) AS d, o_orderpriority = '5-LOW' AS low,
         o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, o_orderkey % 2 = 0 AS clerk, CAST(o_orderkey % 1000 AS VARCHAR) AS clerk_no FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT filing AS of, arg_min(context_id, k) AS context_id, arg_min(p, k) AS p, arg_min(d, k) AS d, arg_min(low, k) AS low, min(k) AS k, arg_min(coalesce(CASE WHEN status <> 'P' THEN priority END, '') || '|' || segment || '|' || CASE WHEN status = 'F' THEN 'F' ELSE '' END || '|' || CASE WHEN clerk THEN clerk_no ELSE '' END, k) AS dims FROM f GROUP BY filing),
w AS (SELECT filing AS whole, count(*) AS n, string_agg(DISTINCT CASE WHEN NOT low THEN CAST(d AS VARCHAR) END, ',' ORDER BY CASE WHEN NOT low THEN CAST(d AS VARCHAR) END) AS instants, string_agg(DISTINCT CASE WHEN low THEN CAST(d AS VARCHAR) END, ',' ORDER BY CASE WHEN low THEN CAST(d AS VARCHAR) END) AS starts,
             string_agg(DISTINCT CASE WHEN low THEN CAST(d + 30 AS VARCHAR) END, ',' ORDER BY CASE WHEN low THEN CAST(d + 30 AS VARCHAR) END) AS ends,
             string_agg(DISTINCT CASE WHEN priority = '1-URGENT' THEN segment END, ',') AS filed, string_agg(DISTINCT CASE WHEN priority <> '1-URGENT' THEN 'X' || segment END, ',') AS not_filed FROM f GROUP BY filing)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with everything that an expression may ask of them or of their filing, and the struct b."""
    contexts = model.contexts(spark, sf_dir)
    low = F.col("period_type") == "duration"
    contexts = contexts.withColumns({"start": F.when(low, F.col("instant")), "end": F.when(low, F.date_add("instant", 30)), "instant": F.when(~low, F.col("instant"))})
    units = model.table(spark, sf_dir, "customer").select(model.text("c_custkey").alias("instance_id"), F.lit("USD").alias("unit_id"), F.array(F.lit("{iso}USD")).alias("numerator"))
    found = formula.enrich(model.order_facts(spark, sf_dir), contexts, units)
    orders = model.table(spark, sf_dir, "orders").join(model.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    indicators = orders.select(model.text("o_custkey").alias("instance_id"), F.when(urgent, F.col("c_mktsegment")).otherwise(F.concat(F.lit("X"), "c_mktsegment")).alias("template"), urgent.alias("filed")).distinct()
    whole = formula.filing_aggregates(contexts, indicators)
    first = found.groupBy("instance_id").agg(F.min_by(F.struct(*(c for c in formula.FACT if c in found.columns)), "fact_ord").alias("b"), F.sort_array(F.collect_list("value")).alias("all_facts"))
    return found.join(first, "instance_id").join(whole, "instance_id")


def _shown(value: Value) -> Column:
    if value.kind == "number":
        return value.column.cast("double")
    if value.kind == "boolean":
        return value.column
    return F.array_join(value.array(), ",") if value.kind == "sequence" else value.text()


def family(name: str, **expressions: tuple[str, str]) -> None:
    """Registers a query with a column for each expression, given with its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts(spark, sf_dir)
        own = F.struct(*(c for c in formula.FACT if c in rows.columns))
        scope = Scope({"a": Value("any", F.col("value"), fact=own), "b": Value("any", F.col("b.value"), fact=F.col("b"))}, Value("any", F.col("value")))
        return rows.select("context_id", *(_shown(compile_expression(text, scope)).alias(column) for column, (text, _) in expressions.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {FACTS} SELECT f.context_id AS context_id, {', '.join(f'{sql} AS {column}' for column, (_, sql) in expressions.items())} FROM f JOIN b ON b.of = f.filing JOIN w ON w.whole = f.filing"


PERIOD = "CASE WHEN low THEN 'd:' || CAST(f.d AS VARCHAR) || '/' || CAST(f.d + 30 AS VARCHAR) ELSE 'i:' || CAST(f.d AS VARCHAR) END".replace("WHEN low", "WHEN f.low")
family(
    "xfi_periods",
    instant=("xfi:is-instant-period(xfi:period($a))", "NOT f.low"), duration=("xfi:is-duration-period(xfi:period($a))", "f.low"), start_end=("xfi:is-start-end-period(xfi:period($a))", "f.low"), forever=("xfi:is-forever-period(xfi:period($a))", "FALSE"),
    period=("xfi:period($a)", PERIOD), context_period=("xfi:context-period(xfi:context($a))", PERIOD), at=("xfi:period-instant(xfi:period($a))", "CASE WHEN NOT f.low THEN CAST(f.d AS VARCHAR) END"),
    starts=("xfi:period-start(xfi:period($a))", "CASE WHEN f.low THEN CAST(f.d AS VARCHAR) END"), ends=("xfi:period-end(xfi:period($a))", "CASE WHEN f.low THEN CAST(f.d + 30 AS VARCHAR) END"),
)
family(
    "xfi_entities",
    context=("xfi:context($a)", "f.context_id"), entity=("xfi:entity($a)", "f.filing"), context_entity=("xfi:context-entity(xfi:context($a))", "f.filing"), identifier=("xfi:identifier($a)", "f.filing"), context_identifier=("xfi:context-identifier(xfi:context($a))", "f.filing"),
    entity_identifier=("xfi:entity-identifier(xfi:entity($a))", "f.filing"), identifier_value=("xfi:identifier-value(xfi:identifier($a))", "f.filing"), fact_identifier_value=("xfi:fact-identifier-value($a)", "f.filing"),
    identifier_scheme=("xfi:identifier-scheme(xfi:identifier($a))", "'cust'"), fact_identifier_scheme=("xfi:fact-identifier-scheme($a)", "'cust'"),
)
family(
    "xfi_units_and_numbers",
    unit=("xfi:unit($a)", "'{iso}USD'"), measure=("xfi:measure-name(xfi:unit($a))", "'{iso}USD'"), numerator=("xfi:unit-numerator(xfi:unit($a))", "'{iso}USD'"), denominator=("xfi:unit-denominator(xfi:unit($a))", "''"),
    is_numeric=("xfi:is-numeric($a)", "TRUE"), is_non_numeric=("xfi:is-non-numeric($a)", "FALSE"), is_fraction=("xfi:is-fraction($a)", "FALSE"), decimals=("xfi:decimals($a)", "2e0"), precision=("xfi:precision($a)", "0e0"),
    shown=("xfi:format-number($a, '#,##0.00')", "format('{:,.2f}', CAST(f.p AS DOUBLE))"), plain=("xfi:format-number($a, '0.00')", "format('{:.0f}', CAST(f.p AS DOUBLE))"), whole=("xfi:format-number($a, '0')", "CAST(CAST(trunc(f.p) AS BIGINT) AS VARCHAR)"), label=("xfi:concept-label('OrderTotal')", "'OrderTotal'"),
)
DIMS = "array_to_string(list_sort(list_filter([CASE WHEN status <> 'P' THEN 'priority' END, 'segment', CASE WHEN status = 'F' THEN 'status' END], x -> x IS NOT NULL)), ',')"
OWN_DIMS = "coalesce(CASE WHEN f.status <> 'P' THEN f.priority END, '') || '|' || f.segment || '|' || CASE WHEN f.status = 'F' THEN 'F' ELSE '' END || '|' || CASE WHEN f.clerk THEN f.clerk_no ELSE '' END"
family(
    "xfi_dimensions",
    has_explicit=("xfi:fact-has-explicit-dimension($a, 'status')", "f.status = 'F'"), has_typed=("xfi:fact-has-typed-dimension($a, 'clerk')", "f.clerk"), has_value=("xfi:fact-has-explicit-dimension-value($a, 'segment', 'BUILDING')", "f.segment = 'BUILDING'"),
    s_equal=("xfi:fact-dimension-s-equal($a, 'segment', 'MACHINERY')", "f.segment = 'MACHINERY'"), explicit=("xfi:fact-explicit-dimension-value($a, 'priority')", "CASE WHEN f.status <> 'P' THEN f.priority ELSE '' END"),
    typed=("xfi:fact-typed-dimension-value($a, 'clerk')", "CASE WHEN f.clerk THEN f.clerk_no ELSE '' END"), simple=("xfi:fact-typed-dimension-simple-value($a, 'clerk')", "CASE WHEN f.clerk THEN f.clerk_no ELSE '' END"),
    typed_dims=("xfi:fact-typed-dimensions($a)", "CASE WHEN f.clerk THEN 'clerk' ELSE '' END"), n_explicit=("count(xfi:fact-explicit-dimensions($a))", "CAST(1 + (f.status <> 'P')::INT + (f.status = 'F')::INT AS DOUBLE)"),
    s_equal2=("xfi:fact-dimension-s-equal2($a, $b)", f"{OWN_DIMS} = b.dims"),
)
SAME = "f.context_id = b.context_id"
family(
    "xfi_equality",
    c=("xfi:c-equal($a, $b)", SAME), p=("xfi:p-equal($a, $b)", SAME), pc=("xfi:pc-equal($a, $b)", SAME), cu=("xfi:cu-equal($a, $b)", SAME), pcu=("xfi:pcu-equal($a, $b)", SAME), item=("xfi:duplicate-item($a, $b)", SAME), tuples=("xfi:duplicate-tuple($a, $b)", SAME),
    u=("xfi:u-equal($a, $b)", "TRUE"), s=("xfi:s-equal($a, $b)", f"{SAME} AND f.p = b.p"), x=("xfi:x-equal($a, $b)", f"{SAME} AND f.p = b.p"), v=("xfi:v-equal($a, $b)", "f.p = b.p"), nodes=("xfi:identical-nodes($a, $b)", "f.k = b.k"),
    starts=("xfi:start-equal($a, $b)", "CASE WHEN f.low THEN f.d END IS NOT DISTINCT FROM CASE WHEN b.low THEN b.d END"), ends=("xfi:end-equal($a, $b)", "CASE WHEN f.low THEN f.d END IS NOT DISTINCT FROM CASE WHEN b.low THEN b.d END"),
    node_set=("xfi:identical-node-set(($a, $b))", "f.p = b.p"), s_set=("xfi:s-equal-set(($a, $b))", "f.p = b.p"), v_set=("xfi:v-equal-set(($a, $b))", "f.p = b.p"), c_set=("xfi:c-equal-set(($a, $b))", "f.p = b.p"), u_set=("xfi:u-equal-set(($a, $b))", "f.p = b.p"),
)
ONE = "CASE WHEN strpos({0}, ',') = 0 THEN {0} END"
family(
    "xfi_filings",
    n=("count(xfi:facts())", "CAST(w.n AS DOUBLE)"), any_identifier=("xfi:any-identifier()", "f.filing"), identifiers=("xfi:unique-identifiers()", "f.filing"), single_identifier=("xfi:single-unique-identifier()", "f.filing"), entities=("xfi:distinct-entity-strings()", "f.filing"),
    any_start=("xfi:any-start-date()", "split_part(w.starts, ',', 1)"), any_end=("xfi:any-end-date()", "split_part(w.ends, ',', 1)"), any_instant=("xfi:any-instant-date()", "split_part(w.instants, ',', 1)"),
    starts=("xfi:unique-start-dates()", "coalesce(w.starts, '')"), ends=("xfi:unique-end-dates()", "coalesce(w.ends, '')"), instants=("xfi:unique-instant-dates()", "coalesce(w.instants, '')"),
    one_start=("xfi:single-unique-start-date()", ONE.format("w.starts")), one_end=("xfi:single-unique-end-date()", ONE.format("w.ends")), one_instant=("xfi:single-unique-instant-date()", ONE.format("w.instants")),
    filed=("xfi:positive-filing-indicators()", "coalesce(w.filed, '')"), not_filed=("xfi:negative-filing-indicators()", "coalesce(w.not_filed, '')"),
    is_filed=("xfi:positive-filing-indicator('BUILDING')", "coalesce(w.filed = 'BUILDING', FALSE)"), is_not_filed=("xfi:negative-filing-indicator('XBUILDING')", "coalesce(w.not_filed = 'XBUILDING', FALSE)"),
)
family(
    "iaf_arithmetic",
    added=("iaf:numeric-add($a, $b)", "CAST(f.p + b.p AS DOUBLE)"), minus=("iaf:numeric-unary-minus($a)", "CAST(-f.p AS DOUBLE)"), total=("iaf:sum(($a, $b, 10))", "CAST(f.p + b.p + 10 AS DOUBLE)"), margin=("iaf:error-margin($a)", "0e0"),
    at_most=("iaf:numeric-less-equal-than($a, $b, 1000)", "f.p <= b.p + 1000"), at_least=("iaf:numeric-greater-equal-than($a, $b, 1000)", "f.p >= b.p - 1000"), equal=("iaf:numeric-equal($a, $b, 50000)", "abs(f.p - b.p) <= 50000"),
    both=("efn:iff($a gt 100000, $b gt 100000)", "(f.p > 100000) = (b.p > 100000)"), follows=("efn:imp($a gt 100000, $b gt 100000)", "f.p <= 100000 OR b.p > 100000"),
)
#: Functions that have no data behind them: always empty, or never true.
EMPTY = (
    "segment entity-segment context-segment scenario context-scenario fact-segment-remainder fact-scenario-remainder taxonomy-refs linkbase-link-roles fact-footnotes concept-relationships distinct-nonAbstract-parent-concepts concept-substitutions "
    "filter-member-network-selection items-in-tuple tuples-in-tuple arcrole-definition role-definition relationship-from-concept relationship-to-concept relationship-attribute relationship-link-attribute relationship-name relationship-link-name "
    "concept-balance concept-period-type concept-custom-attribute concept-data-type"
).split()
family("xfi_without_data", **{name.replace("-", "_"): (f"xfi:{name}($a)", "''") for name in EMPTY}, derived=("xfi:concept-data-type-derived-from($a, 'x')", "FALSE"))
LAST = "CAST(f.d + 31 AS VARCHAR)"
family(
    "xpath_core",
    arithmetic=("($a - $b) * 2 + 7 mod 4 - (9 idiv 2)", "CAST((f.p - b.p) * 2 - 1 AS DOUBLE)"), rounded=("round($a) + ceiling($b) + floor(1.5) + round-half-to-even(2.5)", "CAST(floor(f.p + 0.5) + ceil(b.p) + 3 AS DOUBLE)"),
    extremes=("max(($a, $b)) - min(($a, $b)) + avg((1, 2, 3))", "CAST(greatest(f.p, b.p) - least(f.p, b.p) + 2 AS DOUBLE)"), some_item=("($a, 5) = ($b, 6)", "f.p = b.p"), kept=("not($a lt $b) and boolean(1) or false()", "NOT f.p < b.p"),
    each=("for $x in (1, 2), $y in (10, 20) return $x * $y", "'10,20,20,40'"), over=("sum(for $x in ($a, $b) return $x * 2)", "CAST(2 * (f.p + b.p) AS DOUBLE)"), pairs=("some $x in ($a, 1), $y in ($b, 2) satisfies $x eq $y", "f.p = b.p"), every_=("every $x in ($a, $b), $y in (0, 1) satisfies $x gt $y", "f.p > 1 AND b.p > 1"),
    number=("$a castable as xs:decimal", "TRUE"), day=("$a castable as xs:date", "FALSE"), is_number=("($a + 1) instance of xs:decimal", "TRUE"), is_text=("'x' instance of xs:decimal", "FALSE"), cast_=("$a cast as xs:integer", "CAST(floor(f.p) AS DOUBLE)"),
    later=("xs:dateTime('2020-01-02T03:04:05') gt xs:dateTime('2020-01-02T00:00:00')", "TRUE"), hours=("hours-from-dateTime(xs:dateTime('2020-01-02T03:04:05'))", "3e0"), years=("year-from-date(xs:date('1999-12-31'))", "1999e0"),
    joined=("string-join(('a', 'b', 'c'), '-')", "'a-b-c'"), cut=("concat(substring-before('k=v', '='), substring-after('k=v', '='), normalize-space('  x   y '))", "'kvx y'"), found=("contains('abc', 'b') and starts-with('abc', 'a') and ends-with('abc', 'c') and matches('abc', '^a.c$')", "TRUE"),
    changed=("replace(translate(lower-case('ABBA'), 'b', 'x'), 'x+', '_')", "'a_a'"), lengths=("string-length('four') + count(distinct-values((1, 1, 2)))", "6e0"),
)
