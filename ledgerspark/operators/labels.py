"""Labels and documentation of concepts and assertions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the role of a concept's standard label.
STANDARD = "http://www.xbrl.org/2003/role/label"


def _rank(column: Column, preferred: Sequence[str]) -> Column:
    found = F.array_position(F.array(*map(F.lit, preferred)), column) if preferred else F.lit(0)
    return F.when(found > 0, found).otherwise(len(preferred) + 1)


def best_labels(concepts: DataFrame, labels: DataFrame, role: str = STANDARD, languages: Sequence[str] = ("en",)) -> DataFrame:
    """(concept, text): the label in the role, else the standard one; languages as preferred, then any; then by
    priority and source; the concept's own name where it has none."""
    in_role = F.when(F.col("role") == role, 0).when(F.col("role") == STANDARD, 1)
    source = F.when(F.col("source") == "standard", 0).otherwise(1)
    order = Window.partitionBy("concept").orderBy(in_role, _rank(F.col("lang"), languages), F.col("priority").desc(), source, "text")
    best = labels.where(in_role.isNotNull()).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("concept", "text")
    return concepts.select("concept").join(best, "concept", "left").select("concept", F.coalesce("text", "concept").alias("text"))


def active_labels(arcs: DataFrame, resources: DataFrame) -> DataFrame:
    """Labels (link, concept, text, ...) of arcs (link, from, to, use, priority) that no prohibition of the same ends cancels."""
    banned = arcs.where("use = 'prohibited'").select("link", "from", "to").distinct()
    live = arcs.where(F.coalesce("use", F.lit("optional")) != "prohibited").join(banned, ["link", "from", "to"], "left_anti")
    met = live.join(resources.withColumnRenamed("label_id", "to").withColumnRenamed("priority", "own_priority"), ["link", "to"])
    return met.withColumn("priority", F.greatest(F.coalesce("priority", F.lit(0)), F.coalesce("own_priority", F.lit(0)))).drop("own_priority")


def best_resources(resources: DataFrame, languages: Sequence[str] = ("en",)) -> DataFrame:
    """Assertion resources in the first preferred language that an assertion has, the highest priority first."""
    rank = Window.partitionBy("assertion_id").orderBy(_rank(F.col("lang"), languages))
    order = Window.partitionBy("assertion_id").orderBy(F.col("priority").desc(), "text")
    return resources.withColumn("_rank", F.rank().over(rank)).where("_rank = 1").withColumn("nth", F.row_number().over(order)).drop("_rank")


def search(labels: DataFrame, text: str) -> DataFrame:
    """Concepts whose name or a label contains the text, whatever the case."""
    asked = text.lower()
    return labels.where(F.contains(F.lower("text"), F.lit(asked)) | F.contains(F.lower("concept"), F.lit(asked))).select("concept").distinct()
