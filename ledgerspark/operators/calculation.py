"""Calculation: do reported totals agree with the weighted sum of what they total?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import PRECISION, VALUE, accuracy, as_decimal, round_accurately
from ..functions.scalars import is_numeric_type
from ..session import materialize
from .findings import finding, union
from .graph import active_arcs

BIND = ("instance_id", "context_id", "unit_id")


def arc_findings(arcs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Arcs between concepts that can't be summed, of weight zero, or whose weight contradicts the balances."""
    side = lambda name: concepts.select(F.col("concept").alias(name), F.coalesce("abstract", F.lit(False)).alias(f"{name}_abstract"), is_numeric_type(F.col("data_type")).alias(f"{name}_numeric"), F.col("balance").alias(f"{name}_balance"))
    both = arcs.where(F.coalesce("use", F.lit("optional")) != "prohibited").join(side("parent"), "parent", "left").join(side("child"), "child", "left").withColumn("concept", F.col("parent"))
    bad_end = both.where("parent_abstract OR child_abstract OR NOT parent_numeric OR NOT child_numeric")
    signs = (F.col("parent_balance") == F.col("child_balance")) != (F.col("weight") > 0)
    contrary = both.where(F.col("parent_balance").isNotNull() & F.col("child_balance").isNotNull() & (F.col("weight") != 0) & signs)
    text = lambda what: F.concat_ws(" ", F.lit(what), "parent", F.lit("->"), "child", F.lit("in"), "elr")
    return union(
        [
            finding(bad_end, "calculation:invalid-endpoint", "calculation", text("An end is abstract or not numeric:")),
            finding(both.where("weight = 0"), "calculation:invalid-weight", "calculation", text("The weight is zero:")),
            finding(contrary, "calculation:balance-weight-inconsistent", "calculation", text("Balances and weight disagree:")),
        ]
    )


def totals(facts: DataFrame, arcs: DataFrame, concepts: DataFrame) -> DataFrame:
    """A row for each network, total and binding in which the total and an item are reported: reported, computed,
    blocked (some fact of it is reported twice), and consistent (null if blocked).

    facts need context ids that are canonical already (see keys.canonical_context) and may carry value_dec. They
    are dealt out once, by binding; sums by concept and by total both follow that partitioning. Networks
    are joined by concept and are small; the planner broadcasts them while they are.
    """
    numeric = concepts.where(~F.coalesce("abstract", F.lit(False)) & is_numeric_type(F.col("data_type"))).select("concept")
    live = active_arcs(arcs).where("parent <> child")
    live = live.join(numeric.withColumnRenamed("concept", "parent"), "parent", "left_semi").join(numeric.withColumnRenamed("concept", "child"), "child", "left_semi")
    as_item = live.select(F.col("child").alias("concept"), "elr", "parent", F.col("weight").cast("decimal(18,6)").alias("weight"))
    as_total = live.select(F.col("parent").alias("concept"), "elr", "parent").distinct().withColumn("weight", F.lit(None).cast("decimal(18,6)"))
    # written, so that the planner knows how small the networks are and doesn't deal facts out by concept
    roles = materialize(as_item.unionByName(as_total), "roles")
    value = F.col("value_dec").cast(VALUE) if "value_dec" in facts.columns else as_decimal(F.col("value"))
    used = facts.where(F.col("unit_id").isNotNull()).join(roles.select("concept").distinct(), "concept", "left_semi")
    used = used.select(*BIND, "concept", accuracy(F.col("decimals"), F.col("precision")).alias("accurate"), value.alias("v")).repartition(*BIND)
    # sums and extremes of numbers alone, which hash aggregation can hold
    by_concept = used.withColumn("rounded", round_accurately(F.col("v"), F.col("accurate"))).groupBy(*BIND, "concept").agg(
        F.count("*").alias("n"), F.sum("rounded").cast(VALUE).alias("rounded"), F.max("v").alias("v"), F.max("accurate").alias("accurate"),
        F.bool_or((F.col("accurate") == PRECISION) & F.col("v").isNotNull()).alias("zero"),
    )
    in_role = by_concept.join(roles, "concept")
    item = F.col("weight").isNotNull()
    # products lose decimal places, and most weights are signs
    weighed = F.when(F.col("weight") == 1, F.col("rounded")).when(F.col("weight") == -1, -F.col("rounded")).otherwise((F.col("rounded") * F.col("weight")).cast(VALUE))
    bound = in_role.groupBy(*BIND, "elr", "parent").agg(
        F.count_if(~item).alias("totals"), F.count_if(item).alias("items"), F.bool_or(F.col("n") > 1).alias("blocked"),
        F.sum(F.when(item, weighed)).cast(VALUE).alias("computed"), F.coalesce(F.bool_or(F.when(item, F.col("zero"))), F.lit(False)).alias("item_zero"),
        F.max(F.when(~item, F.col("v"))).alias("v"), F.max(F.when(~item, F.col("rounded"))).alias("reported"), F.max(F.when(~item, F.col("accurate"))).alias("accurate"),
    )
    bound = bound.where((F.col("totals") > 0) & (F.col("items") > 0) & F.col("v").isNotNull())
    computed = F.coalesce("computed", F.lit(0).cast(VALUE))
    like_total = F.when(F.col("item_zero"), F.lit(None).cast(VALUE)).otherwise(round_accurately(computed, F.col("accurate"), F.col("v")))
    bound = bound.withColumn("like_total", like_total)
    same = F.when(F.col("like_total").isNull() | F.col("reported").isNull(), ~(F.col("item_zero") | (F.col("accurate") == PRECISION))).otherwise(F.col("like_total") == F.col("reported"))
    return bound.select(*BIND, "elr", "parent", "reported", F.col("like_total").alias("computed"), "blocked", F.when(~F.col("blocked"), same).alias("consistent"))


def summation_findings(facts: DataFrame, arcs: DataFrame, concepts: DataFrame) -> DataFrame:
    wrong = totals(facts, arcs, concepts).where("NOT consistent").withColumn("concept", F.col("parent"))
    text = F.concat(F.lit("Reported "), F.coalesce(F.col("reported").cast("string"), F.lit("NaN")), F.lit(", computed "), F.coalesce(F.col("computed").cast("string"), F.lit("NaN")), F.lit(" in "), F.col("elr"), F.lit(", unit "), F.col("unit_id"))
    return finding(wrong, "calculation:summation-inconsistent", "calculation", text)


def validate(facts: DataFrame, arcs: DataFrame, concepts: DataFrame) -> DataFrame:
    return arc_findings(arcs, concepts).unionByName(summation_findings(facts, arcs, concepts))
