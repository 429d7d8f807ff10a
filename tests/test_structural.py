from ledgerspark.operators import structural
from ledgerspark.schemas import CONTEXT, FACT, ISO4217, UNIT, XBRLI

M = "{x}monetaryItemType"


def relations(spark):
    instances = spark.createDataFrame([("i", "t.xsd"), ("j", " ")], "instance_id string, schema_ref string")
    concepts = spark.createDataFrame([("Cash", M, "instant"), ("Name", "{x}stringItemType", "instant"), ("Flow", M, "duration"), ("Shares", f"{{{XBRLI}}}sharesItemType", "instant")], "concept string, data_type string, period_type string")
    import datetime

    day = datetime.date(2024, 12, 31)
    contexts = spark.createDataFrame([("i", "c1", "s", "e", "instant", day, None, None, {}, {}, {}, "k"), ("i", "c2", "s", "e", "instant", day, None, None, {}, {}, {}, "k"), ("i", "c3", "s", None, "instant", day, None, None, {}, {}, {}, "z")], CONTEXT)
    units = spark.createDataFrame([("i", "EUR", "simple", [f"{{{ISO4217}}}EUR"], []), ("i", "bad", "simple", [f"{{{XBRLI}}}euro"], []), ("i", "odd", "divide", ["a", "b"], ["b"])], UNIT)
    return instances, contexts, units, concepts


def rules(spark, rows):
    facts = spark.createDataFrame([("i", n, *r) for n, r in enumerate(rows)], FACT)
    instances, contexts, units, concepts = relations(spark)
    found = structural.validate(instances, facts, contexts, units, concepts).collect()
    return sorted(f.rule_id.removeprefix("structural:") for f in found if f.rule_id not in ("structural:missing-schemaref", "structural:incomplete-context"))


def test_clean(spark):
    assert rules(spark, [("Cash", "c1", "EUR", "1", "0", None, False), ("Name", "c1", None, "x", None, None, False)]) == []


def test_each_rule(spark):
    assert rules(spark, [("Cash", "nope", "EUR", "1", "0", None, False)]) == ["unresolved-context-ref"]
    assert rules(spark, [("Cash", "c1", None, "1", "0", None, False)]) == ["unresolved-unit-ref"]
    assert rules(spark, [("Flow", "c1", "EUR", "1", "0", None, False)]) == ["period-type-mismatch"]
    assert rules(spark, [("Cash", "c1", "EUR", "1", "0", "3", False)]) == ["decimals-precision"]
    assert rules(spark, [("Cash", "c1", "EUR", "1", None, None, False)]) == ["decimals-precision"]
    assert rules(spark, [("Cash", "c1", "EUR", None, "0", None, True)]) == ["decimals-precision"]
    assert rules(spark, [("Cash", "c1", "bad", "1", "0", None, False)]) == ["monetary-unit-measure", "unit-consistency"]
    assert rules(spark, [("Cash", "c1", "odd", "1", "0", None, False)]) == ["monetary-unit-measure", "unit-consistency"]
    assert rules(spark, [("Shares", "c1", "EUR", "1", None, None, False)]) == ["unit-consistency"]


def test_duplicates_meet_over_equal_contexts(spark):
    assert rules(spark, [("Cash", "c1", "EUR", "1", "0", None, False), ("Cash", "c2", "EUR", "1.0", "0", None, False)]) == ["duplicate-fact"]
    assert rules(spark, [("Cash", "c1", "EUR", "1", "0", None, False), ("Cash", "c2", "EUR", "1", "0", None, False)]) == []


def test_filing_level_rules(spark):
    instances, contexts, *_ = relations(spark)
    assert [f.instance_id for f in structural.missing_schema_refs(instances).collect()] == ["j"]
    assert [f.context_id for f in structural.incomplete_contexts(contexts).collect()] == ["c3"]
