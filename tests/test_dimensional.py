import pytest

from ledgerspark.operators import dimensional

DIM = "{e}CountryDim"
MAP = "map<string,string>"


def contexts(spark, dims):
    return spark.createDataFrame([("i", "c", dims, {}, {k: "scenario" for k in dims})], f"instance_id string, context_id string, dims {MAP}, typed {MAP}, containers {MAP}")


def cubes(spark, kind="all", closed=True, element="scenario"):
    return (
        spark.createDataFrame([("h", kind, closed, element, 1)], "cube string, arcrole string, closed boolean, context_element string, cube_ord int"),
        spark.createDataFrame([("h", "P")], "cube string, concept string"),
        spark.createDataFrame([("h", DIM, 1)], "cube string, dim string, dim_ord int"),
        spark.createDataFrame([("h", DIM, "ES"), ("h", DIM, "PT")], "cube string, dim string, member string"),
    )


def judge(spark, dims, default=None, concept="P", **cube):
    facts = spark.createDataFrame([("i", "c", concept)], "instance_id string, context_id string, concept string")
    dimensions = spark.createDataFrame([(DIM, "explicit", default)], "dim string, dim_type string, default_member string")
    return sorted(r.constraint_type for r in dimensional.fact_findings(facts, contexts(spark, dims), *cubes(spark, **cube), dimensions).collect())


@pytest.mark.parametrize(
    ("dims", "options", "expected"),
    [
        ({DIM: "ES"}, {}, []),
        ({DIM: "ES", "{e}Other": "x"}, {}, ["UNDECLARED_DIMENSION"]),
        ({DIM: "ES", "{e}Other": "x"}, {"closed": False}, []),
        ({DIM: "FR"}, {}, ["INVALID_MEMBER"]),
        ({}, {}, ["CLOSED_MISSING_DIMENSION"]),
        ({}, {"closed": False}, ["CLOSED_MISSING_DIMENSION"]),
        ({}, {"default": "ES"}, []),
        ({DIM: "ES"}, {"kind": "notAll", "closed": False}, ["PROHIBITED_COMBINATION"]),
        ({DIM: "FR"}, {"kind": "notAll", "closed": False}, []),
        ({}, {"kind": "notAll", "closed": False}, []),
        ({DIM: "FR"}, {"concept": "Q"}, []),
    ],
)
def test_fact_against_cube(spark, dims, options, expected):
    assert judge(spark, dims, **options) == expected


def test_container(spark):
    facts = spark.createDataFrame([("i", "c", "P")], "instance_id string, context_id string, concept string")
    found = dimensional.container_mismatches(facts, contexts(spark, {DIM: "ES"}), *cubes(spark, element="segment")[:3]).collect()
    assert [f.constraint_type for f in found] == ["CONTEXT_ELEMENT_MISMATCH"]


def test_members_follow_target_roles_and_cycles(spark):
    arcs = spark.createDataFrame([("r1", "D", "A", "r2", True), ("r2", "A", "B", None, True), ("r2", "B", "A", None, True), ("r1", "A", "Z", None, True), ("r2", "B", "U", None, False)], "elr string, source string, target string, target_role string, usable boolean")
    domain, members = arcs.where("source = 'D'"), arcs.where("source <> 'D'")
    dims = spark.createDataFrame([("h", "D", "r1")], "cube string, dim string, elr string")
    found = dimensional.scoped_members(dims, domain, members).collect()
    assert sorted(r.member for r in found) == ["A", "B"]


def test_contexts(spark):
    concepts = spark.createDataFrame([(DIM, dimensional.DIMENSION_ITEM, None), ("{e}ES", "{x}item", None)], "concept string, substitution_group string, typed_domain string")
    dimensions = spark.createDataFrame([(DIM, "explicit", "{e}ES")], "dim string, dim_type string, default_member string")
    rules = lambda dims: sorted(r.rule_id.split(":")[1] for r in dimensional.context_findings(contexts(spark, dims), concepts, dimensions).collect())
    assert rules({DIM: "{e}ES"}) == ["DefaultValueUsedInInstanceError"]
    assert rules({DIM: "{e}XX"}) == ["ExplicitMemberUndefinedQNameError"]
    assert rules({"{f}Nope": "{f}x"}) == ["ExplicitMemberNotExplicitDimensionError"]
