import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import messages, scalars
from ledgerspark.functions.xpath import Scope, Unsupported, Value, compile_expression, needed_functions
from ledgerspark.operators import conformance, definition_checks, dml, filters, formula, labels, linkbase_checks, report, tables
from ledgerspark.operators.filters import BooleanFilter, DimensionFilter, TypedFilter, VariableFilter
from ledgerspark.operators.findings import union
from ledgerspark.plans import reporting
from ledgerspark.schemas import CONTEXT, FACT
from ledgerspark.streaming import arrivals


def value(spark, text, **variables):
    scope = Scope({k: Value("any", F.lit(v)) for k, v in variables.items()}, fact=lambda c: F.lit("1"))
    found = compile_expression(text, scope)
    column = found.boolean() if found.kind == "boolean" else found.array() if found.kind == "sequence" else found.text()
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1 + 2 * 3", "7"), ("(1 + 2) * 3", "9"), ("-2 - -3", "1"), ("7 idiv 2", "3"), ("7 mod 4", "3"), ("10 div 4", "2.5"), ("1 div 0 = 1", None), ("2 gt 1 and not(1 = 2)", True), ("'a' = ('b', 'a')", True), ("$x > 5", True), ("$x = '7.0'", False), ("$x eq 7", True),
        ("if ($x = 7.0) then 'y' else 'n'", "y"), ("sum((1, $x, 2))", "10"), ("count(())", "0"), ("empty(())", True), ("every $i in (1, 2) satisfies $i < 3", True), ("round(2.5)", "3"), ("substring-before('a:b', ':')", "a"), ("substring-after('a:b', ':')", "b"),
        ("string-length('abc') + 1", "4"), ("xs:date('2024-12-31') > xs:date('2024-01-01')", True), ("iaf:numeric-equal(1, 2, 1)", True), ("efn:iff(true(), false())", False), ("max((3, $x))", "7"), ("concat('a', (: note :) 'b')", "ab"), ("contains(upper-case('abc'), 'B')", True), ("(1 to 3)", ["1", "2", "3"]), ("xfi:format-number(1234.5, '#,##0')", "1,234.50"), ("xfi:format-number(12.3, '0.00')", "12"),
    ],
)
def test_expressions(spark, text, expected):
    assert value(spark, text, x="7") == expected


@pytest.mark.parametrize("text", ["$nope", "unknown-function(1)", "1 +", "a/b/c", "for $x in 1", "abs()"])
def test_unsupported_is_an_error(spark, text):
    with pytest.raises(Unsupported):
        compile_expression(text)


def test_custom_functions(spark):
    customs = {("m:twice", 1): (("v",), "$v * 2"), ("m:loop", 1): (("v",), "m:loop($v)"), ("m:four", 1): (("v",), "m:twice(m:twice($v))")}
    scope = Scope(customs=customs)
    assert spark.range(1).select(compile_expression("m:four(3)", scope).text().alias("x")).first().x == "12"
    with pytest.raises(Unsupported):
        compile_expression("m:loop(1)", scope)
    assert needed_functions("m:four(1)", {k[0]: b for k, (_, b) in customs.items()}) == {"m:four", "m:twice"}


def enriched(spark):
    rows = [("i", 0, "A", "c1", "u", "10", "0", None, False, "instant", "EUR", {"D": "ES"}, {}), ("i", 1, "B", "c1", "u", "20", "0", None, False, "instant", "EUR", {"D": "ES"}, {"T": "x"}), ("i", 2, "A", "c2", None, "x", None, None, False, "duration", None, {}, {}), ("j", 0, "A", "c1", "u", "5", "0", None, False, "instant", "EUR", {"D": "PT"}, {})]
    return spark.createDataFrame(rows, FACT + ", period_type string, measure string, dims map<string,string>, typed map<string,string>")


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (VariableFilter("A"), 3), (VariableFilter(period_type="duration"), 1), (VariableFilter(unit="UR"), 3), (VariableFilter(dimensions=[DimensionFilter("D")]), 3), (VariableFilter(dimensions=[DimensionFilter("D", ("ES",), True)]), 2), (VariableFilter(dimensions=[DimensionFilter("D", (), True)]), 4),
        (VariableFilter(booleans=[BooleanFilter("and", (DimensionFilter("D", (), True),))]), 1), (VariableFilter(booleans=[BooleanFilter("or", (), True)]), 0), (VariableFilter(typed=[TypedFilter("T", True)]), 3), (VariableFilter(xpaths=[". gt 8"]), 3),
    ],
)
def test_filters(spark, f, expected):
    assert filters.select(enriched(spark), f).count() == expected


def test_set_filters_leave_own_aspects():
    both = filters.with_set_filters(VariableFilter("A", dimensions=[DimensionFilter("D", ("x",))]), VariableFilter("B", "instant", dimensions=[DimensionFilter("D"), DimensionFilter("E")]))
    assert (both.concept, both.period_type, [d.dim for d in both.dimensions]) == ("A", "instant", ["D", "E"])


def statuses(found):
    return sorted((r.instance_id, r.status) for r in found.collect())


def test_assertions(spark):
    facts = enriched(spark)
    both = {"a": VariableFilter("A", "instant"), "b": VariableFilter("B")}
    assert statuses(formula.evaluate(facts, formula.Assertion("v", "value", both, "$a lt $b"))) == [("i", "PASS"), ("j", "NOT_EVALUATED")]
    assert statuses(formula.evaluate(facts, formula.Assertion("v", "value", {"a": both["a"], "b": VariableFilter("B", fallback="0")}, "$a lt $b"))) == [("i", "PASS"), ("j", "FAIL")]
    assert statuses(formula.evaluate(facts, formula.Assertion("e", "existence", {"b": both["b"]}))) == [("i", "PASS"), ("j", "FAIL")]
    assert statuses(formula.evaluate(facts, formula.Assertion("c", "consistency", {"a": both["a"]}, "$a * 1.1", absolute_radius="0.6"))) == [("i", "FAIL"), ("j", "PASS")]
    assert statuses(formula.evaluate(facts, formula.Assertion("c", "consistency", {"a": both["a"]}, "$a * 1.1", relative_radius="0.1"))) == [("i", "PASS"), ("j", "PASS")]
    assert {r.rule_id for r in formula.evaluate(facts, formula.Assertion("x", "value", both, "a/b")).collect()} == {"internal:x"}
    keyed = formula.evaluate(facts, formula.Assertion("v", "value", both, "$a lt $b"), match_on=["context_id", "unit_id"])
    assert statuses(keyed) == [("i", "PASS"), ("j", "NOT_EVALUATED")]


def test_many_assertions_in_one_pass(spark):
    facts = enriched(spark)
    a, b, late = VariableFilter("A", "instant"), VariableFilter("B"), VariableFilter(xpaths=[". gt 8"])
    some = [
        ("value", {"a": a, "b": b}, "$a lt $b", {}), ("value", {"a": a, "b": VariableFilter("B", fallback="0")}, "$a lt $b", {}), ("existence", {"b": b}, "", {"severity": "warning"}), ("existence", {"b": VariableFilter("none")}, "", {}),
        ("consistency", {"a": a}, "$a * 1.1", {"absolute_radius": "0.6"}), ("consistency", {"a": a, "x": late}, "$a + $x", {"relative_radius": "0.1"}), ("value", {"a": a, "b": b}, "a/b", {}), ("value", {}, "1 lt 2", {}), ("consistency", {}, "1", {}),
        ("value", {"x": late}, "$x lt 9", {"severity": "warning"}),
    ]
    # more than one folder, with the same variables in several places
    assertions = [formula.Assertion(f"r{i}", kind, variables, expression, **more) for i, (kind, variables, expression, more) in enumerate(some * 2)]
    for match_on in ((), ("context_id", "unit_id")):
        if match_on:
            assertions = [x for x in assertions if x.variables]
        whole = formula.evaluate_all(facts, assertions, match_on)
        each = union([formula.evaluate(facts, x, match_on) for x in assertions])
        assert sorted(map(str, whole.collect())) == sorted(map(str, each.collect()))
    assert formula.evaluate_all(facts, []).count() == 0
    assert formula.evaluate_all(facts, assertions[:1] + assertions[6:7]).where("rule_id LIKE 'internal%'").count() == 2


def test_many_assertions_ask_facts_for_columns(spark):
    facts = enriched(spark)
    a, b, c = VariableFilter("A", fallback="1"), VariableFilter("B"), VariableFilter(xpaths=[". gt 8"], fallback="()")
    asking = ["xfi:u-equal($a, $b)", "xfi:identical-nodes($a, $c)", "xfi:decimals() eq 0", "xfi:context() eq 'c1'", "xfi:fact-explicit-dimension-value($a, 'D') eq 'ES'", "xfi:is-numeric($a)", "$a lt $b", "xfi:is-instant-period()"]
    rules = [(v, e) for e in asking * 3 for v in ({"a": a, "b": b, "c": c}, {"b": b, "a": a, "c": c})]
    assertions = [formula.Assertion(f"r{i}", "value", *r) for i, r in enumerate(rules)]
    assertions += [formula.Assertion(f"n{i}", "existence", {"x": VariableFilter(xpaths=[f". gt {i}"]), "y": VariableFilter("B", unit=str(i))}) for i in range(20)]
    for match_on in ((), ("context_id", "unit_id")):
        whole, each = formula.evaluate_all(facts, assertions, match_on), union([formula.evaluate(facts, x, match_on) for x in assertions])
        assert sorted(map(str, whole.collect())) == sorted(map(str, each.collect()))
    only = formula.evaluate_all(facts, [formula.Assertion("t", "value", {}, "1 lt 2"), formula.Assertion("n", "existence", {})])
    assert sorted((r.instance_id, r.rule_id, r.status) for r in only.collect()) == [("i", "n", "FAIL"), ("i", "t", "PASS"), ("j", "n", "FAIL"), ("j", "t", "PASS")]


def test_assertions_on_the_same_filters_share_what_is_written_and_shuffled(spark, monkeypatch):
    written, write = [], formula.materialize

    def noted(df, tag, by=None):
        written.append((tag, write(df, tag, by)))
        return written[-1][1]

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        store = sc.statusStore().executorList(False)
        return sum(store.apply(i).totalShuffleWrite() for i in range(store.size()))

    monkeypatch.setattr(formula, "materialize", noted)
    facts = write(reporting._facts(spark, "/root/testdata/sf0.001"), "facts")
    cost = []
    for times in (4, 12):
        before = shuffled()
        found = formula.evaluate_all(facts, reporting.many_assertions(times), ["context_id", "unit_id"])
        assert found.groupBy("status").count().count() == 3
        cost.append(shuffled() - before)
    assert cost[1] < 1.5 * cost[0]
    assert all(df.count() <= facts.count() for tag, df in written if tag == "matches")


def test_messages(spark):
    scope = Scope({"x": Value("any", F.lit("7"))})
    text = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert text(messages.render("x is {$x + 1}!", scope)) == "x is 8!"
    assert text(messages.render("{fmt:odd($x)}", scope, F.lit(False), "$x gt 8")) == "7 gt 8 FALSE"
    assert "concept A" in messages.filter_text(VariableFilter("A", dimensions=[DimensionFilter("D")]))


def node(name, parent, order, abstract=False, first=True, concept=None, dims=None):
    return ("t", "x", name, parent, order, name, None, abstract, first, concept, dims or {})


NODE = "table_id string, axis string, node_id string, parent_id string, ord double, label string, code string, is_abstract boolean, parent_first boolean, concept string, dims map<string,string>"


def test_axes(spark):
    tree = spark.createDataFrame([node("P", None, 1.0, dims={"D": "all"}), node("B", "P", 2.0, dims={"D": "b"}), node("A", "P", 1.0, dims={"E": "a"}), node("Q", None, 2.0, True), node("C", "Q", 1.0)], NODE)
    leaves = [r.node_id for r in tables.axis_leaves(tree).orderBy("leaf_ord").collect()]
    assert leaves == ["P", "A", "B", "C"]
    last = tree.withColumn("parent_first", F.lit(False))
    assert [r.node_id for r in tables.axis_leaves(last).orderBy("leaf_ord").collect()] == ["A", "B", "P", "C"]
    assert {r.node_id: r.span for r in tables.header_spans(tree).collect()} == {"P": 3, "A": 1, "B": 1, "Q": 1, "C": 1}
    rows = {r.node_id: (r.row_ord, r.level, r.dims) for r in tables.axis_rows(tree).collect()}
    assert rows["B"] == (2, 1, {"D": "b"}) and rows["A"] == (1, 1, {"D": "all", "E": "a"})


def test_cells_take_the_first_fact(spark):
    row = spark.createDataFrame([("t", 0, "10", "Cash", {"D": "x"})], "table_id string, row_ord int, code string, concept string, dims map<string,string>")
    column = spark.createDataFrame([("t", 0, "5", None, {"E": "def"})], "table_id string, leaf_ord int, code string, concept string, dims map<string,string>")
    contexts = spark.createDataFrame([("i", "c1", None, None, None, None, None, None, {"D": "x", "G": "skip"}, {}, {}, ""), ("i", "c2", None, None, None, None, None, None, {"D": "x"}, {"T": "1"}, {}, "")], CONTEXT)
    facts = spark.createDataFrame([("i", 4, "Cash", "c1", "u", "second", "0", None, False), ("i", 1, "Cash", "c1", "u", "first", "0", None, False), ("i", 0, "Cash", "c2", "u", "typed", "0", None, False)], FACT)
    body = tables.cells(row, column)
    found = tables.fill(body, facts, contexts, {"E": "def"}, ("G",)).first()
    assert (found.value, found.duplicates, found.cell_code) == ("first", 2, "0015")


def test_open_rows(spark):
    leaves = spark.createDataFrame([("t", "p", "A", {"D": "1", "E": "x"}), ("t", "p", "A", {"D": "2", "E": "x"}), ("t", "q", "A", {"D": "1"}), ("t", "q", "B", {"D": "2"})], "table_id string, parent_id string, concept string, dims map<string,string>")
    assert [(r.parent_id, r.dim) for r in tables.open_row_candidates(leaves).collect()] == [("p", "D")]


def test_labels(spark):
    texts = spark.createDataFrame([("A", "uno", "es", labels.STANDARD, "standard", 0), ("A", "one", "en", labels.STANDARD, "standard", 0), ("A", "ONE", "en", labels.STANDARD, "generic", 1)], "concept string, text string, lang string, role string, source string, priority int")
    concepts = spark.createDataFrame([("A",), ("B",)], "concept string")
    best = lambda **o: {r.concept: r.text for r in labels.best_labels(concepts, texts, **o).collect()}
    assert best() == {"A": "ONE", "B": "B"}
    assert best(languages=("es",), role="terse") == {"A": "uno", "B": "B"}


def test_edits(spark):
    facts = spark.createDataFrame([("i", 0, "A", "c", "u", "1", "0", None, False), ("i", 1, "B", "c", "u", "2", "0", None, False)], FACT)
    edit = "instance_id string, concept string, context_id string, unit_id string, decimals string, value string"
    after = dml.upsert_cells(facts, spark.createDataFrame([("i", "A", "c", "u", "0", " "), ("i", "B", "c", "u", "0", "5"), ("i", "C", "c", "u", "0", "7")], edit))
    assert sorted((r.concept, r.value, r.fact_ord) for r in after.collect()) == [("B", "5", 1), ("C", "7", 2)]
    moves = spark.createDataFrame([("i", "c", "d")], "instance_id string, context_id string, new_context_id string")
    moved, clash = dml.reassign_contexts(facts, moves)
    assert {r.context_id for r in moved.collect()} == {"d"} and clash.count() == 0
    taken = facts.unionByName(spark.createDataFrame([("i", 2, "A", "d", "u", "1", "0", None, False)], FACT))
    moved, clash = dml.reassign_contexts(taken, moves)
    assert sorted(r.context_id for r in moved.collect()) == ["c", "c", "d"] and clash.count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([("1.234,5",), ("1,234.5",), ("1,234",), ("1,5",), ("1.234.567",), (" 12 ",), ("-1,234,567",)], "t string")
    assert [r.x for r in df.select(scalars.normalized_number(F.col("t")).alias("x")).collect()] == ["1234.5", "1234.5", "1234", "1.5", "1234567", "12", "-1234567"]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.cell_code(F.lit("9990"), F.lit("20"))) == "10010"
    assert one(scalars.cell_code(F.lit("x"), F.lit("20"))) is None
    assert sorted(one(scalars.indicator_aliases(F.lit("es_b_01")))) == ["b_01", "es_b_01", "es_t_01", "t_01"]
    assert one(scalars.formatted(F.lit("1234.5"), F.lit("{x}monetaryItemType"), F.lit("2"))) == "1,234.50"


def test_definitions(spark):
    concepts = spark.createDataFrame([("H", definition_checks.HYPERCUBE, True), ("D", definition_checks.DIMENSION, False), ("P", "{http://www.xbrl.org/2003/instance}item", False)], "concept string, substitution_group string, abstract boolean")
    arcs = spark.createDataFrame([("r", "all", "P", "H", None, None), ("r", "hypercube-dimension", "P", "D", "scenario", "nowhere"), ("r", "dimension-default", "D", "P", None, None), ("r", "dimension-default", "D", "H", None, None)], "elr string, arcrole string, source string, target string, context_element string, target_role string")
    roles = spark.createDataFrame([("somewhere",)], "role string")
    found = sorted(r.rule_id.split(":")[1] for r in definition_checks.validate(concepts, arcs, roles).collect())
    assert found == ["DimensionDefaultTargetError", "DimensionElementIsNotAbstractError", "HasHypercubeMissingContextElementAttributeError", "HypercubeDimensionSourceError", "TargetRoleNotResolvedError", "TooManyDefaultMembersError"]


def test_links(spark):
    arcs = spark.createDataFrame([("l", "r", "a", "b"), ("l", "r", "a", "z")], "link string, elr string, source string, target string")
    locators = spark.createDataFrame([("l", "a", "f", "x"), ("l", "b", "f", "gone")], "link string, label string, file string, fragment string")
    resources = spark.createDataFrame([], "link string, label string")
    references = spark.createDataFrame([("p", "roleRef", "f", "x")] * 2, "path string, how string, file string, fragment string")
    ids = spark.createDataFrame([("f", "x")], "file string, fragment string")
    found = sorted(r.rule_id for r in linkbase_checks.validate(arcs, locators, resources, references, ids).collect())
    assert found == ["xbrl:duplicate-role-ref", "xbrl:linkbase-reference-error", "xlink:validation-error"]


def test_suites(spark, tmp_path):
    from ledgerspark.sources.suites import variations

    (tmp_path / "index.xml").write_text('<documentation><testcases root="a"><testcase uri="one.xml"/></testcases></documentation>')
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.xml").write_text('<testcase name="T"><variation id="V1"><data><instance>i.xbrl</instance><xsd readMeFirst="true">../t.xsd</xsd></data><result expected="invalid"><error>x:bad</error></result></variation><variation id="V2" status="optional"><data/><result expected="valid"/></variation></testcase>')
    found = {r.variation_id: r for r in variations(spark, "s", f"file://{tmp_path}/index.xml").collect()}
    assert (found["V1"].expected_type, found["V1"].expected_code, found["V1"].mandatory) == ("error", "x:bad", True)
    assert found["V1"].taxonomy_file.endswith(f"{tmp_path.name}/t.xsd") and found["V1"].instance_file.endswith("/a/i.xbrl")
    assert not found["V2"].mandatory
    actual = spark.createDataFrame([("s", "V1", "bad", None)], "suite_id string, variation_id string, code string, exception_message string")
    rolled = conformance.rollup(conformance.outcomes(variations(spark, "s", f"file://{tmp_path}/index.xml"), actual)).first()
    assert (rolled["pass"], rolled.status, rolled.exit_code) == (2, "PASSED", 0)


def test_reports(spark, tmp_path):
    from ledgerspark.operators.findings import finding

    rows = spark.createDataFrame([("i", "FAIL", "error"), ("i", "PASS", "error"), ("i", "FAIL", "warning"), ("j", "NOT_EVALUATED", "error")], "instance_id string, status string, severity string")
    found = finding(rows, "r", "formula", F.lit("m"), status=F.col("status")).drop("severity").withColumn("severity", F.lit(None).cast("string"))
    assert found.columns[:2] == ["instance_id", "rule_id"]
    blank = [F.lit(None).cast("string").alias(c) for c in ("concept", "context_id", "hypercube", "dimension", "constraint_type", "table_id")]
    found = rows.select("instance_id", F.lit("r").alias("rule_id"), "severity", "status", F.lit("s").alias("source"), *blank, F.lit("m").alias("message"))
    summary = {r.instance_id: (r.errors, r.warnings, r.passes, r.not_evaluated, r.passed) for r in report.summary(found).collect()}
    assert summary == {"i": (1, 1, 1, 0, False), "j": (0, 0, 0, 1, True)}
    for kind in ("json", "text"):
        report.write(found, str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).count() == (2 if kind == "json" else 4)
    assert report.only(found, "PASS").count() == 1


def test_arrivals(spark, tmp_path):
    from ledgerspark.streaming.arrivals import arriving, publish

    facts = spark.createDataFrame([("i", "c1"), ("i", "c2")], "instance_id string, context_id string")
    facts.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("i", "c1")], "instance_id string, context_id string")
    query = publish(arriving(spark, str(tmp_path / "in"), "instance_id string, context_id string"), lambda b: b.join(known, ["instance_id", "context_id"], "left_anti"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [r.context_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["c2"]


def test_finding_rates(spark, tmp_path):
    import datetime

    from ledgerspark.streaming.arrivals import arriving, finding_rates

    at = lambda minute: datetime.datetime(2024, 12, 31, 12, minute)
    rows = spark.createDataFrame([("r", at(1)), ("r", at(9)), ("r", at(11)), ("s", at(2))], "rule_id string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = finding_rates(arriving(spark, str(tmp_path / "in"), "rule_id string, at timestamp"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("rates").collect()
    assert sorted((r.rule_id, r.window.start.minute, r.findings) for r in found) == [("r", 0, 2), ("r", 10, 1), ("s", 0, 1)]


def test_repeated_new_facts_and_edits(spark):
    shape = "instance_id string, fact_ord long, concept string, context_id string, unit_id string, value string, decimals string, precision string, is_nil boolean"
    facts = spark.createDataFrame([("i", 0, "A", "c1", "u", "1", "0", None, False)], shape)
    new = spark.createDataFrame([("i", 5, "B", "c1", "u", "2", "0", None, False), ("i", 6, "B", "c1", "u", "3", "0", None, False), ("i", 7, "A", "c1", "u", "4", "0", None, False)], shape)
    both, refused = dml.add_facts(facts, new)
    assert sorted((r.concept, r.value) for r in both.collect()) == [("A", "1"), ("B", "2")]
    assert sorted(r.value for r in refused.collect()) == ["3", "4"]
    edits = spark.createDataFrame([("i", "A", "c1", "u", "0", "8", 1), ("i", "A", "c1", "u", "0", "7", 2), ("i", "D", "c1", "u", "0", "5", 1), ("i", "D", "c1", "u", "0", "6", 2)], "instance_id string, concept string, context_id string, unit_id string, decimals string, value string, edit_ord int")
    assert sorted((r.concept, r.value) for r in dml.upsert_cells(facts, edits).collect()) == [("A", "7"), ("D", "6")]


def test_own_calculations_join_the_taxonomys(spark):
    shape = "elr string, parent string, child string, weight double"
    arcs = spark.createDataFrame([("r", "A", "B", 1.0)], shape)
    own = spark.createDataFrame([("r", "A", "C", -1.0), ("r", "A", "B", 1.0), ("s", "A", "B", 1.0)], shape)
    assert sorted(tuple(r) for r in dml.merged_calculations(arcs, own).collect()) == [("r", "A", "B", 1.0), ("r", "A", "C", -1.0), ("s", "A", "B", 1.0)]


def test_progress_and_tagged_jobs(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    query = arrivals.publish(arrivals.arriving(spark, str(tmp_path / "in"), "id long"), lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "check"))
    seen = list(arrivals.progress(query, 0.01))
    assert sum(r["rows"] for r in seen) == 20
    with arrivals.tagged(spark, "validation"):
        assert "validation" in spark.sparkContext.getJobTags()
        assert spark.range(5).count() == 5
    arrivals.stop_all(spark, "validation")
    assert len(spark.sparkContext.getJobTags()) == 0
