"""Formula and table linkbases, and names under their several spellings."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import scalars
from ledgerspark.operators import dml, formula, linkbase_checks, tables
from ledgerspark.operators.filters import BooleanFilter, DimensionFilter, TypedFilter
from ledgerspark.sources.taxonomies import Taxonomy, infer_catalog

FORMULA = """<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:e="http://e.com/tax"
 xmlns:va="http://xbrl.org/2008/assertion/value" xmlns:ea="http://xbrl.org/2008/assertion/existence" xmlns:variable="http://xbrl.org/2008/variable" xmlns:cf="http://xbrl.org/2008/filter/concept"
 xmlns:pf="http://xbrl.org/2008/filter/period" xmlns:df="http://xbrl.org/2008/filter/dimension" xmlns:bf="http://xbrl.org/2008/filter/boolean" xmlns:gf="http://xbrl.org/2008/filter/general" xmlns:cfi="http://xbrl.org/2010/custom-function">
<link:gen xlink:type="extended" xlink:role="r">
 <va:valueAssertion xlink:type="resource" xlink:label="a" id="v1" test="$x gt 5"/>
 <ea:existenceAssertion xlink:type="resource" xlink:label="b" id="e1"/>
 <variable:factVariable xlink:type="resource" xlink:label="x" fallbackValue="0"/>
 <cf:conceptName xlink:type="resource" xlink:label="c"><cf:concept><cf:qname>e:Cash</cf:qname></cf:concept></cf:conceptName>
 <pf:instant xlink:type="resource" xlink:label="p"/>
 <gf:general xlink:type="resource" xlink:label="g" test=". gt 1"/>
 <df:explicitDimension xlink:type="resource" xlink:label="d"><df:dimension><df:qname>e:Country</df:qname></df:dimension><df:member><df:qname>e:ES</df:qname></df:member><df:member><df:qname>e:PT</df:qname></df:member></df:explicitDimension>
 <df:typedDimension xlink:type="resource" xlink:label="t"><df:dimension><df:qname>e:Id</df:qname></df:dimension></df:typedDimension>
 <bf:orFilter xlink:type="resource" xlink:label="o"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set" xlink:from="a" xlink:to="x" name="x"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set" xlink:from="b" xlink:to="x" name="y"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="x" xlink:to="c" complement="true"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="x" xlink:to="p"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="x" xlink:to="g"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="x" xlink:to="d"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="x" xlink:to="o"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/boolean-filter" xlink:from="o" xlink:to="t" complement="true"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2010/assertion-unsatisfied-message" xlink:from="a" xlink:to="m"/>
 <msg:message xmlns:msg="http://xbrl.org/2010/message" xlink:type="resource" xlink:label="m" xml:lang="en">{$x} is too small</msg:message>
 <validation:assertionSet xmlns:validation="http://xbrl.org/2008/validation" xlink:type="resource" xlink:label="s" id="s1"/>
 <t:table xmlns:t="http://xbrl.org/2014/table" xlink:type="resource" xlink:label="tab" id="t1"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/assertion-set" xlink:from="s" xlink:to="a"/>
 <link:arc xlink:type="arc" xlink:arcrole="http://www.eurofiling.info/xbrl/arcrole/applies-to-table" xlink:from="s" xlink:to="tab" order="1"/>
 <variable:function xlink:type="resource" xlink:label="f" name="m:half"/>
 <cfi:implementation xlink:type="resource" xlink:label="i"><cfi:input name="v"/><cfi:step name="w">$v div 4</cfi:step><cfi:output>$w * 2</cfi:output></cfi:implementation>
 <link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2010/function-implementation" xlink:from="f" xlink:to="i"/>
</link:gen></link:linkbase>"""

TABLE = """<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:e="http://e.com/tax" xmlns:table="http://xbrl.org/2014/table" xmlns:formula="http://xbrl.org/2008/formula">
<link:gen xlink:type="extended" xlink:role="r">
 <table:table xlink:type="resource" xlink:label="t"/><table:breakdown xlink:type="resource" xlink:label="y"/>
 <table:ruleNode xlink:type="resource" xlink:label="n1" id="010" abstract="true"><formula:concept><formula:qname>e:Cash</formula:qname></formula:concept></table:ruleNode>
 <table:ruleNode xlink:type="resource" xlink:label="n2" id="020" parentChildOrder="children-first"><formula:explicitDimension dimension="e:Country"><formula:member><formula:qname>e:ES</formula:qname></formula:member></formula:explicitDimension></table:ruleNode>
 <table:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2014/table-breakdown" xlink:from="t" xlink:to="y" axis="y"/>
 <table:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2014/breakdown-tree" xlink:from="y" xlink:to="n1" order="1"/>
 <table:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2014/definition-node-subtree" xlink:from="n1" xlink:to="n2" order="2"/>
</link:gen></link:linkbase>"""


@pytest.fixture(scope="module")
def taxonomy(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("links")
    (folder / "f.xml").write_text(FORMULA)
    (folder / "t.xml").write_text(TABLE)
    return Taxonomy(spark, [f"file://{folder}/f.xml", f"file://{folder}/t.xml"])


def test_assertions(taxonomy):
    found = {a.assertion_id: a for a in taxonomy.assertions()}
    assert taxonomy.has_assertions()
    assert {k: a.kind for k, a in found.items()} == {"v1": "value", "e1": "existence"}
    x = found["v1"].variables["x"]
    ns = "{http://e.com/tax}"
    assert (x.concept, x.period_type, x.fallback, list(x.xpaths)) == (f"{ns}Cash", "instant", "0", [". gt 1"])
    assert x.dimensions == [DimensionFilter(f"{ns}Country", (f"{ns}ES", f"{ns}PT"))]
    assert x.booleans == [BooleanFilter("or", (TypedFilter(f"{ns}Id", True),))]
    assert list(found["e1"].variables) == ["y"]


def test_assertions_run(spark, taxonomy):
    cash, dims = "{http://e.com/tax}Cash", {"{http://e.com/tax}Country": "{http://e.com/tax}ES"}
    rows = [("i", 0, cash, "c", "u", "9", "instant", dims, {}), ("j", 0, cash, "c", "u", "3", "instant", dims, {}), ("k", 0, cash, "c", "u", "9", "instant", {}, {})]
    facts = spark.createDataFrame(rows, "instance_id string, fact_ord long, concept string, context_id string, unit_id string, value string, period_type string, dims map<string,string>, typed map<string,string>")
    value = next(a for a in taxonomy.assertions() if a.kind == "value")
    assert sorted((r.instance_id, r.status) for r in formula.evaluate(facts, value).collect()) == [("i", "PASS"), ("j", "FAIL"), ("k", "NOT_EVALUATED")]


def test_assertion_resources_and_functions(taxonomy):
    message = taxonomy.assertion_resources().collect()
    assert [(m.assertion_id, m.text, m.lang) for m in message] == [("v1", "{$x} is too small", "en")]
    assert [(r.assertion_id, r.table_id) for r in taxonomy.assertion_tables().collect()] == [("v1", "t1")]
    assert taxonomy.custom_functions() == {("m:half", 1): (("v",), "($v div 4) * 2")}


def test_breakdown_nodes(taxonomy):
    nodes = {n.node_id: n for n in taxonomy.breakdown_nodes().collect()}
    assert (nodes["n1"].parent_id, nodes["n1"].is_abstract, nodes["n1"].concept, nodes["n1"].code, nodes["n1"].axis) == (None, True, "{http://e.com/tax}Cash", "010", "y")
    assert (nodes["n2"].parent_id, nodes["n2"].ord, nodes["n2"].parent_first, nodes["n2"].concept) == ("n1", 2.0, False, None)
    assert nodes["n2"].dims == {"{http://e.com/tax}Country": "{http://e.com/tax}ES"}
    rows = tables.axis_rows(taxonomy.breakdown_nodes()).orderBy("row_ord").collect()
    assert [(r.node_id, r.level, r.concept) for r in rows] == [("n1", 0, "{http://e.com/tax}Cash"), ("n2", 1, "{http://e.com/tax}Cash")]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    name = F.lit("{http://e.com/t}Cash")
    assert one(scalars.name_forms(name, F.lit("e"))) == ["{http://e.com/t}Cash", "http://e.com/t#Cash", "e:Cash"]
    assert one(scalars.concept_aliases(name, F.lit("e"), F.lit("id1")))[:2] == ["id1", "e_Cash"]
    assert one(scalars.duration_text(F.lit(0.25))) == "250 ms"
    assert infer_catalog("file:///x/cache/w.org/a.xsd", ["w.org"])["https://w.org/"] == "file:///x/cache/w.org"


def test_cells_offer_their_values(spark):
    body = spark.createDataFrame([("t", "A"), ("t", "B")], "table_id string, concept string")
    concepts = spark.createDataFrame([("A", ["x", "y"]), ("B", [])], "concept string, enumeration array<string>")
    assert [(r.concept, r.options) for r in tables.cell_options(body, concepts).collect()] == [("A", ["x", "y"])]


def test_context_and_tuple_content(spark):
    elements = spark.createDataFrame([("i", "c", "{http://www.xbrl.org/2003/instance}item"), ("i", "c", "{e}x")], "instance_id string, context_id string, element string")
    assert linkbase_checks.base_elements_in_contexts(elements).count() == 1
    reported = spark.createDataFrame([("i", "T", ["{http://www.w3.org/1999/xlink}href"]), ("i", "T", ["id"])], "instance_id string, concept string, attributes array<string>")
    assert linkbase_checks.tuple_attributes(reported, spark.createDataFrame([("T",)], "concept string")).count() == 1
    values = spark.createDataFrame([("i", "integer", "x"), ("i", "lang", "en-GB"), ("i", "space", "keep"), ("i", "other", "y")], "instance_id string, kind string, value string")
    assert linkbase_checks.lax_values(values).count() == 2


def test_new_filings(spark):
    import datetime

    from ledgerspark.schemas import CONTEXT

    day = datetime.date(2024, 12, 31)
    none = spark.createDataFrame([], CONTEXT)
    filings = spark.createDataFrame([("i", "s", "e", "instant", day, None, None), ("j", "s", "f", "instant", day, None, None)], "instance_id string, entity_scheme string, entity_id string, period_type string, instant date, start date, `end` date")
    templates = spark.createDataFrame([("i", "t1"), ("i", "t2")], "instance_id string, template string")
    contexts, units, indicators = dml.new_filings(filings, templates, none)
    assert (contexts.count(), units.count(), indicators.count()) == (2, 4, 2)
    assert dml.new_filings(filings, templates, contexts)[0].count() == 2
    given = spark.createDataFrame([("i", "x", False)], "instance_id string, template string, filed boolean")
    elements = spark.createDataFrame([("i", "y", True), ("j", "z", True)], "instance_id string, template string, filed boolean")
    assert sorted(r.template for r in dml.preferred_indicators(given, elements).collect()) == ["x", "z"]
    wrong = dml.creation_problems(spark.createDataFrame([("i", "D", "bad")], "instance_id string, dim string, member string"), spark.createDataFrame([("i", "E")], "instance_id string, dim string"), spark.createDataFrame([("D", "good")], "dim string, member string"))
    assert sorted((r.dim, r.problem) for r in wrong.collect()) == [("D", "not allowed"), ("E", "missing")]
