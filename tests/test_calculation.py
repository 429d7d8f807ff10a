from decimal import Decimal

import pytest

from ledgerspark.operators import calculation

FACT = "instance_id string, context_id string, unit_id string, concept string, value string, decimals string, precision string"


def concepts(spark, **more):
    rows = [(c, "{x}monetaryItemType", "instant", more.get(c), False) for c in "ABC"] + [("T", "{x}stringItemType", "instant", None, False), ("X", "{x}monetaryItemType", "instant", None, True)]
    return spark.createDataFrame(rows, "concept string, data_type string, period_type string, balance string, abstract boolean")


def arcs(spark, rows=(("A", "B", 1.0), ("A", "C", 1.0))):
    return spark.createDataFrame([("r", p, c, w, "optional", f"{p}{c}") for p, c, w in rows], "elr string, parent string, child string, weight double, use string, eq_key string")


def facts(spark, rows):
    return spark.createDataFrame([("i", "c1", "u1", *r) for r in rows], FACT)


@pytest.mark.parametrize(
    ("rows", "wrong"),
    [
        ([("A", "1559", None, "2"), ("B", "984.8", None, "3"), ("C", "582.334973", "1", None)], False),
        ([("A", "1", "0", None), ("B", "1", "0", None), ("C", "1", "0", None)], True),
        ([("A", "4001", "0", None), ("B", "4000", "0", None), ("C", "0.01", "0", None)], True),
        ([("A", "100", "0", None), ("B", "100", "0", None), ("C", "", "0", None)], False),
        ([("A", "2", "0", None), ("B", "1", "0", None), ("B", "1", "0", None), ("C", "1", "0", None)], False),
        ([("A", "100", "INF", None), ("B", "60.25", "INF", None), ("C", "39.75", "2", None)], False),
        ([("A", "100", None, "0"), ("B", "60", "0", None), ("C", "40", "0", None)], True),
        ([("A", "1250", "-2", None), ("B", "1200", "-2", None), ("C", "50", "-2", None)], False),
    ],
)
def test_summation(spark, rows, wrong):
    found = calculation.summation_findings(facts(spark, rows), arcs(spark), concepts(spark)).collect()
    assert len(found) == int(wrong)
    assert all(f.rule_id == "calculation:summation-inconsistent" and f.concept == "A" for f in found)


def test_totals_keep_decimals_apart_from_weights(spark):
    rows = [("A", "0.5", "INF", None), ("B", "1.5", "INF", None), ("C", "1", "INF", None)]
    found = calculation.totals(facts(spark, rows), arcs(spark, (("A", "B", 1.0), ("A", "C", -1.0))), concepts(spark)).first()
    assert found.consistent
    assert found.computed == Decimal("0.5")


def test_prohibited_twin_cancels(spark):
    both = arcs(spark).unionByName(arcs(spark, (("A", "C", 1.0),)).withColumn("use", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("prohibited")))
    rows = [("A", "1", "0", None), ("B", "1", "0", None), ("C", "5", "0", None)]
    assert calculation.summation_findings(facts(spark, rows), both, concepts(spark)).count() == 0


def test_arcs(spark):
    found = calculation.arc_findings(arcs(spark, (("A", "T", 1.0), ("A", "X", 1.0), ("A", "B", 0.0), ("A", "C", 1.0))), concepts(spark, A="debit", C="credit")).groupBy("rule_id").count().collect()
    assert {r.rule_id: r["count"] for r in found} == {"calculation:invalid-endpoint": 2, "calculation:invalid-weight": 1, "calculation:balance-weight-inconsistent": 1}


def test_rounding_places(spark):
    from decimal import ROUND_HALF_EVEN

    from pyspark.sql import functions as F

    from ledgerspark.functions.rounding import PLACES, VALUE, rounded_to

    values = [Decimal(v) for v in ("2.345", "-2.345", "2.5", "-2.5", "1250", "-1250", "0.0000000005", "123456789012345678.5", "99999999.999", "0")]
    df = spark.createDataFrame([(v, d) for v in values for d in range(-30, 13)], f"v {VALUE}, d int")
    for r in df.select("v", "d", rounded_to(F.col("v"), F.col("d")).alias("r")).collect():
        expected = r.v
        if r.d in PLACES:
            expected = r.v.quantize(Decimal(1).scaleb(-r.d), ROUND_HALF_EVEN) if r.d >= 0 else r.v.scaleb(r.d).quantize(Decimal(1), ROUND_HALF_EVEN).scaleb(-r.d)
        assert r.r == expected, r
