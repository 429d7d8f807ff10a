"""Filings written back as instance documents, one row a filing, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import local_name, namespace
from ..schemas import ISO4217, XBRLI

#: Prefixes of the base namespaces.
PREFIXES = {XBRLI: "xbrli", ISO4217: "iso4217", "http://www.xbrl.org/2003/linkbase": "link", "http://www.w3.org/1999/xlink": "xlink", "http://xbrl.org/2006/xbrldi": "xbrldi"}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def prefixes(names: DataFrame) -> DataFrame:
    """(ns, prefix) for the namespaces of names (column name): the fixed one, else the last part of the namespace
    that starts like a word, numbered where several share it."""
    used = names.select(namespace(F.col("name")).alias("ns")).where("ns <> ''").distinct()
    fixed = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    part = F.lower(F.regexp_extract("ns", "([A-Za-z][\\w-]*)[^\\w]*$", 1))
    hint = F.coalesce(F.element_at(fixed, F.col("ns")), F.when(part == "", "ns").otherwise(part))
    nth = F.row_number().over(Window.partitionBy("hint").orderBy(~F.map_contains_key(fixed, F.col("ns")), "ns"))
    return used.withColumn("hint", hint).withColumn("nth", nth).select("ns", F.when(F.col("nth") == 1, F.col("hint")).otherwise(F.concat_ws("_", "hint", "nth")).alias("prefix"))


def _named(name: Column, table: Column) -> Column:
    return F.concat(F.element_at(table, namespace(name)), F.lit(":"), local_name(name))


def _with_context(indicators: DataFrame, contexts: DataFrame) -> DataFrame:
    """Indicators with a context of their filing: their own, else its first."""
    first = contexts.groupBy("instance_id").agg(F.min("context_id").alias("_first"))
    own = F.col("context_id") if "context_id" in indicators.columns else F.lit(None).cast("string")
    return indicators.join(first, "instance_id", "left").withColumn("context_id", F.coalesce(own, "_first", F.lit(""))).drop("_first")


def documents(instances: DataFrame, contexts: DataFrame, units: DataFrame, facts: DataFrame, indicators: DataFrame, orphans: DataFrame | None = None, preamble: DataFrame | None = None) -> DataFrame:
    """(instance_id, xml). Contexts and units stand by id, facts in their order, orphans as they were read.

    Typed members are written in their own element (typed_elements of contexts), else in one named like their dimension.
    Filings with rows in preamble (instance_id, name, value, context_id) carry their indicators as codes of reports
    in it instead of indicator elements. A filing's parts meet in one row, so a filing must fit a task.
    """
    if "typed_elements" not in contexts.columns:
        contexts = contexts.withColumn("typed_elements", F.create_map().cast("map<string,string>"))
    names = facts.select(F.col("concept").alias("name")).unionByName(units.select(F.explode(F.concat("numerator", "denominator")).alias("name")))
    names = names.unionByName(contexts.select(F.explode(F.concat(F.map_keys("dims"), F.map_values("dims"), F.map_keys("typed"), F.coalesce(F.map_values("typed_elements"), F.array().cast("array<string>")))).alias("name"))).distinct()
    # a row for each namespace of the taxonomy, which becomes a literal
    known = [x for row in prefixes(names).collect() for x in (row.ns, row.prefix)]
    table = (F.create_map(*map(F.lit, known)) if known else F.create_map()).cast("map<string,string>")
    lines = lambda parts: F.array_join(parts, "\n")

    def members(container: str) -> Column:
        inside = lambda k: F.coalesce(F.element_at("containers", k), F.lit("scenario")) == container
        element = lambda k: _named(F.coalesce(F.element_at("typed_elements", k), k), F.col("prefixes"))
        explicit = F.transform(F.array_sort(F.map_entries(F.map_filter("dims", lambda k, v: inside(k)))), lambda e: F.concat(F.lit('<xbrldi:explicitMember dimension="'), _named(e["key"], F.col("prefixes")), F.lit('">'), _named(e["value"], F.col("prefixes")), F.lit("</xbrldi:explicitMember>")))
        typed = F.transform(F.array_sort(F.map_entries(F.map_filter("typed", lambda k, v: inside(k)))), lambda e: F.concat(F.lit('<xbrldi:typedMember dimension="'), _named(e["key"], F.col("prefixes")), F.lit('"><'), element(e["key"]), F.lit(">"), escaped(e["value"]), F.lit("</"), element(e["key"]), F.lit("></xbrldi:typedMember>")))
        both = F.concat(explicit, typed)
        return F.when(F.size(both) > 0, F.concat(F.lit(f"<xbrli:{container}>"), F.array_join(both, ""), F.lit(f"</xbrli:{container}>"))).otherwise("")

    period = F.when(F.col("period_type") == "instant", F.concat(F.lit("<xbrli:instant>"), F.col("instant").cast("string"), F.lit("</xbrli:instant>"))).otherwise(
        F.concat(F.lit("<xbrli:startDate>"), F.col("start").cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"), F.col("end").cast("string"), F.lit("</xbrli:endDate>"))
    )
    context = F.concat(
        F.lit('<xbrli:context id="'), escaped(F.col("context_id")), F.lit('"><xbrli:entity><xbrli:identifier scheme="'), escaped(F.col("entity_scheme")), F.lit('">'), escaped(F.col("entity_id")), F.lit("</xbrli:identifier>"), members("segment"),
        F.lit("</xbrli:entity><xbrli:period>"), period, F.lit("</xbrli:period>"), members("scenario"), F.lit("</xbrli:context>"),
    )
    measures = lambda c: F.array_join(F.transform(c, lambda m: F.concat(F.lit("<xbrli:measure>"), _named(m, F.col("prefixes")), F.lit("</xbrli:measure>"))), "")
    unit = F.concat(
        F.lit('<xbrli:unit id="'), escaped(F.col("unit_id")), F.lit('">'),
        F.when(F.col("form") == "divide", F.concat(F.lit("<xbrli:divide><xbrli:unitNumerator>"), measures("numerator"), F.lit("</xbrli:unitNumerator><xbrli:unitDenominator>"), measures("denominator"), F.lit("</xbrli:unitDenominator></xbrli:divide>"))).otherwise(measures("numerator")),
        F.lit("</xbrli:unit>"),
    )
    tag = _named(F.col("concept"), F.col("prefixes"))
    attribute = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f' {name}="'), escaped(F.col(column)), F.lit('"'))).otherwise("")
    fact = F.concat(
        F.lit("<"), tag, F.lit(' contextRef="'), escaped(F.col("context_id")), F.lit('"'), attribute("unitRef", "unit_id"), attribute("decimals", "decimals"), attribute("precision", "precision"),
        F.when(F.col("is_nil"), F.lit(' xsi:nil="true"/>')).otherwise(F.concat(F.lit(">"), escaped(F.coalesce("value", F.lit(""))), F.lit("</"), tag, F.lit(">"))),
    )
    gather = lambda rows, key, text: rows.withColumn("prefixes", table).groupBy("instance_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(key, text.alias("_xml")))), lambda s: s["_xml"]).alias("_parts"))
    indicators = _with_context(indicators, contexts)
    reports = indicators.limit(0) if preamble is None else indicators.join(preamble.select("instance_id").distinct(), "instance_id", "left_semi")
    if preamble is not None:
        indicators = indicators.join(preamble.select("instance_id").distinct(), "instance_id", "left_anti")
    report = F.concat(F.lit('<pblo:CodigoEstado contextRef="'), escaped(F.col("context_id")), F.when(F.col("filed"), '">').otherwise('" pblo:blanco="true">'), escaped(F.col("template")), F.lit("</pblo:CodigoEstado>"))
    single = F.concat(F.lit("<pblo:"), F.col("name"), F.lit(' contextRef="'), escaped(F.coalesce("context_id", F.lit(""))), F.lit('">'), escaped(F.col("value")), F.lit("</pblo:"), F.col("name"), F.lit(">"))
    indicator = F.concat(F.lit('<find:filingIndicator contextRef="'), escaped(F.col("context_id")), F.lit('" filed="'), F.col("filed").cast("string"), F.lit('">'), escaped(F.col("template")), F.lit("</find:filingIndicator>"))
    whole = instances.withColumn("prefixes", table)
    sections = [("contexts", gather(contexts, "context_id", context)), ("units", gather(units, "unit_id", unit)), ("indicators", gather(indicators, "template", indicator)), ("facts", gather(facts, "fact_ord", fact))]
    if preamble is not None:
        sections += [("singles", gather(preamble, "name", single)), ("reports", gather(reports, "template", report))]
    if orphans is not None:
        sections.append(("orphans", gather(orphans, "fact_ord", F.col("xml"))))
    for name, part in sections:
        whole = whole.join(part.withColumnRenamed("_parts", name), "instance_id", "left")
    declared = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat(F.map_filter("prefixes", lambda k, v: ~k.isin(*PREFIXES)), F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))))), lambda e: F.concat(F.lit("xmlns:"), e["value"], F.lit('="'), e["key"], F.lit('"'))), " ")
    none = F.array().cast("array<string>")
    filed = F.when(F.size(F.coalesce("indicators", none)) > 0, F.concat(F.lit("<find:fIndicators>"), F.array_join("indicators", ""), F.lit("</find:fIndicators>\n"))).otherwise("")
    if preamble is not None:
        codes = F.when(F.size(F.coalesce("reports", none)) > 0, F.concat(F.lit("<pblo:EstadosReportados>"), F.array_join("reports", ""), F.lit("</pblo:EstadosReportados>\n"))).otherwise("")
        filed = F.concat(filed, F.array_join(F.coalesce("singles", none), ""), codes)
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<xbrli:xbrl '), declared, F.lit(' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:find="http://www.eurofiling.info/xbrl/ext/filing-indicators" xmlns:pblo="http://www.bde.es/es/fr/esrs/comun/2008-06-01/preambulo">\n<link:schemaRef xlink:type="simple" xlink:href="'), escaped(F.coalesce("schema_ref", F.lit(""))), F.lit('"/>\n'),
        lines(F.coalesce("contexts", none)), F.lit("\n"), lines(F.coalesce("units", none)), F.lit("\n"), filed, lines(F.coalesce("facts", none)), F.lit("\n"), lines(F.coalesce("orphans", none)) if orphans is not None else F.lit(""), F.lit("</xbrli:xbrl>\n"),
    )
    return whole.select("instance_id", body.alias("xml"))
