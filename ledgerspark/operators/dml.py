"""Edits to filings as plans: every function takes relations and returns the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import context_id, period_key, s_equal_key

KEY = ["instance_id", "concept", "context_id"]


def add_facts(facts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with the new ones, the new ones that were refused since their concept and context are taken).

    Of new facts with one concept and context the first is accepted, by fact_ord and value, and the others are refused.
    """
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("fact_ord", "value"))
    taken = facts.select(*KEY).distinct().withColumn("_taken", F.lit(True))
    tried = new.withColumn("_nth", nth).join(taken, KEY, "left")
    free = F.col("_taken").isNull() & (F.col("_nth") == 1)
    accepted, refused = tried.where(free).select(*new.columns), tried.where(~free).select(*new.columns)
    last = facts.groupBy("instance_id").agg(F.max("fact_ord").alias("last"))
    placed = accepted.join(last, "instance_id", "left").withColumn("fact_ord", F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("instance_id").orderBy("concept", "context_id")))
    return facts.unionByName(placed.drop("last").select(*facts.columns)), refused


def update_facts(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """facts with the values of edits (instance_id, fact_ord, value)."""
    new = edits.select("instance_id", "fact_ord", F.col("value").alias("_new"), F.lit(True).alias("_edited"))
    joined = facts.join(new, ["instance_id", "fact_ord"], "left")
    return joined.withColumn("value", F.when(F.col("_edited"), F.col("_new")).otherwise(F.col("value"))).select(*facts.columns)


def remove_facts(facts: DataFrame, gone: DataFrame) -> DataFrame:
    return facts.join(gone.select("instance_id", "fact_ord"), ["instance_id", "fact_ord"], "left_anti")


def reassign_contexts(facts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with contexts changed, conflicts); a filing with any conflict keeps all its facts as they were.

    moves: instance_id, context_id, new_context_id.
    """
    moved = facts.join(moves, ["instance_id", "context_id"], "left").withColumn("target", F.coalesce("new_context_id", "context_id"))
    clash = moved.groupBy("instance_id", "concept", "target").agg(F.count("*").alias("n"), F.count("new_context_id").alias("moving")).where("n > 1 AND moving > 0")
    blocked = clash.select("instance_id").distinct().withColumn("blocked", F.lit(True))
    done = moved.join(blocked, "instance_id", "left").withColumn("context_id", F.when(F.col("blocked"), F.col("context_id")).otherwise(F.col("target")))
    return done.select(*facts.columns), clash.select("instance_id", "concept", F.col("target").alias("context_id"))


def set_indicators(indicators: DataFrame, edits: DataFrame) -> DataFrame:
    """Filing indicators with edits put in or changed."""
    new = edits.select("instance_id", "template", F.col("filed").alias("_new"))
    kept = [c for c in indicators.columns if c not in ("instance_id", "template", "filed")]
    return indicators.join(new, ["instance_id", "template"], "full").select("instance_id", "template", F.coalesce("_new", "filed").alias("filed"), *kept)


def merged_calculations(arcs: DataFrame, own: DataFrame) -> DataFrame:
    """The taxonomy's calculation arcs and those of linkbases that filings name themselves, network by network.

    arcs and own: the columns of Taxonomy.calculation_arcs(); own arcs follow, and an arc that both have is one arc.
    """
    return arcs.unionByName(own.select(*arcs.columns)).dropDuplicates()


def ensure_contexts(contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    """contexts and those of wanted (all columns but context_id and s_equal_key) that no equal one stands for."""
    period = period_key(F.col("period_type"), F.col("instant"), F.col("start"), F.col("end"))
    keyed = wanted.withColumn("s_equal_key", s_equal_key(F.col("entity_scheme"), F.col("entity_id"), period, F.col("dims"), F.col("typed"), F.col("containers")))
    new = keyed.withColumn("context_id", context_id(F.col("s_equal_key"))).dropDuplicates(["instance_id", "context_id"])
    if "typed_elements" in contexts.columns and "typed_elements" not in new.columns:
        new = new.withColumn("typed_elements", F.create_map().cast("map<string,string>"))
    return contexts.unionByName(new.join(contexts.select("instance_id", "s_equal_key"), ["instance_id", "s_equal_key"], "left_anti").select(*contexts.columns))


def upsert_cells(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """facts after cell edits (instance_id, concept, context_id, unit_id, decimals, value): blank deletes, else
    the value is changed or a fact put in. Of edits of one cell the one of the greatest edit_ord counts, where
    they have that column, else of the greatest value."""
    last = [F.col(c).desc() for c in ("edit_ord", "value") if c in edits.columns]
    edits = edits.withColumn("_nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(*last))).where("_nth = 1").drop("_nth")
    keyed = edits.select(*KEY, F.trim("value").alias("_value"), F.col("unit_id").alias("_unit"), F.col("decimals").alias("_decimals"), F.lit(True).alias("_edit"))
    old = facts.join(keyed, KEY, "left")
    kept = old.where("_edit IS NULL OR _value <> ''").withColumn("value", F.when(F.col("_edit"), F.col("_value")).otherwise(F.col("value"))).select(*facts.columns)
    fresh = edits.where(F.trim("value") != "").withColumn("value", F.trim("value"))
    absent = fresh.join(facts.select(*KEY), KEY, "left_anti").withColumns({"precision": F.lit(None).cast("string"), "is_nil": F.lit(False), "fact_ord": F.lit(None).cast("long")})
    both, _ = add_facts(kept, absent.select(*facts.columns))
    return both


def default_units(instances: DataFrame) -> DataFrame:
    """The units that a new filing starts with: euro and pure."""
    fixed = (("EUR", "{http://www.xbrl.org/2003/iso4217}EUR"), ("pure", "{http://www.xbrl.org/2003/instance}pure"))
    each = F.array(*(F.struct(F.lit(u).alias("unit_id"), F.lit("simple").alias("form"), F.array(F.lit(m)).alias("numerator"), F.array().cast("array<string>").alias("denominator")) for u, m in fixed))
    return instances.select("instance_id", F.explode(each).alias("u")).select("instance_id", "u.*")


def creation_problems(selected: DataFrame, required: DataFrame, allowed: DataFrame) -> DataFrame:
    """What hinders a new filing: required dimensions without a member, members that aren't allowed.

    selected: instance_id, dim, member; required: instance_id, dim; allowed: dim, member.
    """
    missing = required.join(selected, ["instance_id", "dim"], "left_anti").select("instance_id", "dim", F.lit(None).cast("string").alias("member"), F.lit("missing").alias("problem"))
    known = allowed.select("dim").distinct()
    wrong = selected.join(known, "dim", "left_semi").join(allowed, ["dim", "member"], "left_anti").select("instance_id", "dim", "member", F.lit("not allowed").alias("problem"))
    return missing.unionByName(wrong)


def preferred_indicators(preamble: DataFrame, elements: DataFrame) -> DataFrame:
    """Filing indicators of a filing's preamble, else those of its indicator elements."""
    return preamble.unionByName(elements.join(preamble.select("instance_id").distinct(), "instance_id", "left_anti"))


def new_filings(instances: DataFrame, templates: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contexts, units, indicators) of filings to be: instances (instance_id, entity_scheme, entity_id, period_type,
    instant, start, end), the templates each files (instance_id, template), on top of existing contexts."""
    empty = F.create_map().cast("map<string,string>")
    wanted = instances.withColumns({"dims": empty, "typed": empty, "containers": empty}).select(*(c for c in contexts.columns if c not in ("context_id", "s_equal_key", "typed_elements")))
    return ensure_contexts(contexts, wanted), default_units(instances), templates.select("instance_id", "template", F.lit(True).alias("filed"))
