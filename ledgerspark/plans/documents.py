"""Queries of the document sink and of the sources, with their SQL twins.

Nations are filings whose facts are their customers' balances; the sink writes them as documents, and the source
queries read those documents back. Regions and nations also make a small taxonomy of schema and linkbases.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report, structural
from ..operators.findings import finding
from ..session import local_table, work_dir
from ..sources.instances import Filings
from ..sources.sinks import documents
from ..sources.taxonomies import Taxonomy
from . import model

QUERIES: dict = {}
ORACLE_SQL: dict = {}
T = "{http://e.com/t}"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, xml): a document for each nation, with a context for each market segment."""
    customers = model.table(spark, sf_dir, "customer").withColumn("instance_id", model.text("c_nationkey"))
    odd = F.col("c_nationkey") % 2 == 1
    contexts = customers.groupBy("instance_id", "c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).select(
        "instance_id", F.col("c_mktsegment").alias("context_id"), F.lit("s").alias("entity_scheme"), F.concat(F.lit("N&"), "instance_id").alias("entity_id"), F.when(odd, "duration").otherwise("instant").alias("period_type"),
        F.when(~odd, F.lit("2024-12-31")).cast("date").alias("instant"), F.when(odd, F.lit("2024-01-01")).cast("date").alias("start"), F.when(odd, F.lit("2024-12-31")).cast("date").alias("end"),
        F.create_map(F.lit(f"{T}Segment"), F.concat(F.lit(T), "c_mktsegment")).alias("dims"), F.create_map(F.lit(f"{T}Size"), model.text("n")).alias("typed"), F.create_map(F.lit(f"{T}Size"), F.lit(f"{T}number")).alias("typed_elements"),
        F.create_map(F.lit(f"{T}Segment"), F.lit("segment"), F.lit(f"{T}Size"), F.lit("scenario")).alias("containers"),
    )
    nations = model.table(spark, sf_dir, "nation").select(model.text("n_nationkey").alias("instance_id"), "n_nationkey", "n_name")
    units = nations.select("instance_id", F.lit("u").alias("unit_id"), F.when(F.col("n_nationkey") % 5 == 0, "divide").otherwise("simple").alias("form"), F.array(F.lit("{http://www.xbrl.org/2003/iso4217}EUR")).alias("numerator"), F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("{http://www.xbrl.org/2003/instance}shares"))).otherwise(F.array().cast("array<string>")).alias("denominator"))
    facts = customers.select("instance_id", F.col("c_custkey").alias("fact_ord"), F.lit(f"{T}Balance").alias("concept"), F.col("c_mktsegment").alias("context_id"), F.lit("u").alias("unit_id"), model.text(F.col("c_acctbal").cast(model.MONEY)).alias("value"), F.lit("2").alias("decimals"), F.lit(None).cast("string").alias("precision"), (F.col("c_custkey") % 7 == 0).alias("is_nil"))
    indicators = contexts.select("instance_id", F.concat(F.lit("T_"), "context_id").alias("template"), (F.col("context_id") != "BUILDING").alias("filed"), "context_id")
    instances = nations.select("instance_id", F.when(F.col("n_nationkey") % 4 != 0, F.concat_ws("", "n_name", F.lit(".xsd"))).alias("schema_ref"))
    preamble = nations.where("n_nationkey % 3 = 0").select("instance_id", F.lit("TipoEnvio").alias("name"), F.lit("Ordinario").alias("value"), F.lit("BUILDING").alias("context_id"))
    return documents(instances, contexts, units, facts, indicators, preamble=preamble)


def filings(spark: SparkSession, sf_dir: str) -> Filings:
    folder = f"{work_dir(spark)}/documents-{uuid.uuid4().hex}"
    written(spark, sf_dir).repartition("instance_id").write.partitionBy("instance_id").text(folder)
    return Filings(spark, f"{folder}/*/*.txt")



def _nation() -> Column:
    return F.regexp_extract("instance_id", "instance_id=([0-9]+)", 1).alias("nation")


CONTEXTS = "c AS (SELECT c_nationkey AS k, c_mktsegment AS s, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY ALL)"


@query(
    "sink_documents",
    f"""WITH {CONTEXTS}, x AS (SELECT k, string_agg('<xbrli:context id="' || s || '"><xbrli:entity><xbrli:identifier scheme="s">N&amp;' || k || '</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="t:Segment">t:' || s || '</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period>'
|| CASE WHEN k % 2 = 1 THEN '<xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate>' ELSE '<xbrli:instant>2024-12-31</xbrli:instant>' END || '</xbrli:period><xbrli:scenario><xbrldi:typedMember dimension="t:Size"><t:number>' || n || '</t:number></xbrldi:typedMember></xbrli:scenario></xbrli:context>', chr(10) ORDER BY s) AS contexts,
string_agg('<find:filingIndicator contextRef="' || s || '" filed="' || CASE WHEN s = 'BUILDING' THEN 'false' ELSE 'true' END || '">T_' || s || '</find:filingIndicator>', '' ORDER BY s) AS filed,
string_agg('<pblo:CodigoEstado contextRef="' || s || CASE WHEN s = 'BUILDING' THEN '" pblo:blanco="true">' ELSE '">' END || 'T_' || s || '</pblo:CodigoEstado>', '' ORDER BY s) AS reports FROM c GROUP BY k),
f AS (SELECT c_nationkey AS k, string_agg('<t:Balance contextRef="' || c_mktsegment || '" unitRef="u" decimals="2"' || CASE WHEN c_custkey % 7 = 0 THEN ' xsi:nil="true"/>' ELSE '>' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '</t:Balance>' END, chr(10) ORDER BY c_custkey) AS facts FROM customer GROUP BY 1)
SELECT CAST(n_nationkey AS VARCHAR) AS instance_id, regexp_replace(coalesce(contexts, '') || chr(10) || CASE WHEN n_nationkey % 5 = 0 THEN '<xbrli:unit id="u"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>' ELSE '<xbrli:unit id="u"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit>' END || chr(10)
|| CASE WHEN n_nationkey % 3 = 0 THEN '<pblo:TipoEnvio contextRef="BUILDING">Ordinario</pblo:TipoEnvio>' || CASE WHEN reports IS NULL THEN '' ELSE '<pblo:EstadosReportados>' || reports || '</pblo:EstadosReportados>' || chr(10) END WHEN filed IS NULL THEN '' ELSE '<find:fIndicators>' || filed || '</find:fIndicators>' || chr(10) END || coalesce(facts, '') || chr(10), '^', '') AS body
FROM nation LEFT JOIN x ON x.k = n_nationkey LEFT JOIN f ON f.k = n_nationkey""",
)
def sink_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).select("instance_id", F.regexp_extract("xml", '(?s)xlink:href="[^"]*"/>\n(.*)</xbrli:xbrl>', 1).alias("body"))


@query("source_facts", "SELECT CAST(c_nationkey AS VARCHAR) AS nation, '{http://e.com/t}Balance' AS concept, c_mktsegment AS context_id, 'u' AS unit_id, CASE WHEN c_custkey % 7 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS value, '2' AS decimals, c_custkey % 7 = 0 AS is_nil FROM customer")
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).facts().select(_nation(), "concept", "context_id", "unit_id", "value", "decimals", "is_nil")


@query("source_contexts", f"""WITH {CONTEXTS} SELECT CAST(k AS VARCHAR) AS nation, s AS context_id, 'N&' || k AS entity_id, CASE WHEN k % 2 = 1 THEN 'duration' ELSE 'instant' END AS period_type, CASE WHEN k % 2 = 1 THEN '2024-01-01' END AS "start", '{T}' || s AS member, n AS size, '{T}number' AS element, 'segment' AS container FROM c""")
def source_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda column, name: F.element_at(column, f"{T}{name}")
    return filings(spark, sf_dir).contexts().select(_nation(), "context_id", "entity_id", "period_type", F.col("start").cast("string").alias("start"), at("dims", "Segment").alias("member"), at("typed", "Size").alias("size"), at("typed_elements", "Size").alias("element"), at("containers", "Segment").alias("container"))


@query("source_units", "SELECT CAST(n_nationkey AS VARCHAR) AS nation, 'u' AS unit_id, CASE WHEN n_nationkey % 5 = 0 THEN 'divide' ELSE 'simple' END AS form, '{http://www.xbrl.org/2003/iso4217}EUR' AS numerator, CASE WHEN n_nationkey % 5 = 0 THEN '{http://www.xbrl.org/2003/instance}shares' ELSE '' END AS denominator FROM nation")
def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).units().select(_nation(), "unit_id", "form", F.array_join("numerator", ",").alias("numerator"), F.array_join("denominator", ",").alias("denominator"))


@query("source_indicators", f"WITH {CONTEXTS} SELECT CAST(k AS VARCHAR) AS nation, 'T_' || s AS template, s <> 'BUILDING' AS filed, s AS context_id FROM c")
def source_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).indicators().select(_nation(), "template", "filed", "context_id")


@query("source_members", f"WITH {CONTEXTS} SELECT CAST(k AS VARCHAR) AS nation, s AS context_id, '{T}Segment' AS dim, FALSE AS typed FROM c UNION ALL SELECT CAST(k AS VARCHAR), s, '{T}Size', TRUE FROM c")
def source_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).members().select(_nation(), "context_id", "dim", "typed")


@query("source_orphans", "SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS orphans, count(*) AS sources FROM customer GROUP BY 1")
def source_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = local_table(spark, [(f"{T}Other",)], "concept string")
    _, orphans = filings(spark, sf_dir).reported(known)
    return orphans.groupBy(_nation()).agg(F.count("*").alias("orphans"), F.count_if(F.contains("xml", F.lit("Balance"))).alias("sources"))


@query("struct_missing_schemaref", "SELECT CAST(n_nationkey AS VARCHAR) AS nation, 'structural:missing-schemaref' AS rule_id FROM nation WHERE n_nationkey % 4 = 0")
def struct_missing_schemaref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.missing_schema_refs(filings(spark, sf_dir).instances()).select(_nation(), "rule_id")


def taxonomy(spark: SparkSession, sf_dir: str) -> Taxonomy:
    """A schema and a linkbase over regions and nations, written to the work folder: a document each, some dozens of elements."""
    nations, regions = ([tuple(r) for r in model.table(spark, sf_dir, t).select(*c).collect()] for t, c in (("nation", ("n_nationkey", "n_regionkey", "n_name")), ("region", ("r_regionkey", "r_name"))))
    space = 'xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:t="http://e.com/t"'
    element = lambda name, kind, more: f'<xs:element name="{name}" id="t_{name}" type="{kind}" substitutionGroup="xbrli:item" xbrli:periodType="instant"{more}/>'
    items = [element(f"R{k}", "xbrli:monetaryItemType", ' xbrli:balance="debit"') for k, _ in regions] + [element(f"N{k}", "t:money" if k % 2 else "t:grade", ' abstract="true"' if k % 3 == 0 else "") for k, _, _ in nations]
    types = '<xs:complexType name="money"><xs:simpleContent><xs:restriction base="xbrli:monetaryItemType"/></xs:simpleContent></xs:complexType><xs:simpleType name="grade"><xs:restriction base="xs:string"><xs:enumeration value="low"/><xs:enumeration value="high"/></xs:restriction></xs:simpleType>'
    schema = f'<xs:schema {space} targetNamespace="http://e.com/t" version="v1"><xs:annotation><xs:documentation>Nations</xs:documentation><xs:appinfo><link:linkbaseRef xlink:type="simple" xlink:href="links.xml"/></xs:appinfo></xs:annotation>{"".join(items)}{types}</xs:schema>'
    locators = "".join(f'<link:loc xlink:type="locator" xlink:href="tax.xsd#t_{n}" xlink:label="{n}"/>' for n in [*(f"R{k}" for k, _ in regions), *(f"N{k}" for k, _, _ in nations)])
    arcs = lambda tag, role, more: "".join(f'<link:{tag} xlink:type="arc" xlink:arcrole="http://www.xbrl.org/2003/arcrole/{role}" xlink:from="R{r}" xlink:to="N{k}" order="{k + 1}"{more(k)}/>' for k, r, _ in nations)
    labels = "".join(f'<link:label xlink:type="resource" xlink:label="l{k}" xlink:role="http://www.xbrl.org/2003/role/label" xml:lang="en">{name}</link:label><link:labelArc xlink:type="arc" xlink:arcrole="http://www.xbrl.org/2003/arcrole/concept-label" xlink:from="N{k}" xlink:to="l{k}"/>' for k, _, name in nations)
    link = lambda tag, inside: f'<link:{tag} xlink:type="extended" xlink:role="http://e.com/r">{locators}{inside}</link:{tag}>'
    links = f'<link:linkbase {space}>{link("presentationLink", arcs("presentationArc", "parent-child", lambda k: ""))}{link("calculationLink", arcs("calculationArc", "summation-item", lambda k: f" weight=\"{-1 if k % 2 else 1}\""))}{link("labelLink", labels)}</link:linkbase>'
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/taxonomy-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in (("tax.xsd", schema), ("links.xml", links)):
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(path, name))
        out.write(bytearray(text.encode()))
        out.close()
    return Taxonomy(spark, [system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path, "tax.xsd")).toString()])


def _name(column: str) -> Column:
    return F.regexp_replace(column, "^\\{.*\\}", "").alias(column)


@query(
    "taxonomy_concepts",
    """SELECT 'R' || r_regionkey AS concept, TRUE AS monetary, FALSE AS abstract, 'debit' AS balance, '' AS enumeration FROM region
UNION ALL SELECT 'N' || n_nationkey, n_nationkey % 2 = 1, n_nationkey % 3 = 0, NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'high,low' ELSE '' END FROM nation""",
)
def taxonomy_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taxonomy(spark, sf_dir).concepts()
    return found.select(_name("concept"), F.coalesce("monetary", F.lit(False)).alias("monetary"), F.coalesce("abstract", F.lit(False)).alias("abstract"), "balance", F.coalesce(F.array_join(F.array_sort("enumeration"), ","), F.lit("")).alias("enumeration"))


@query("taxonomy_presentation", "SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, CAST(n_nationkey + 1 AS DOUBLE) AS ord, 'http://e.com/r' AS elr FROM nation")
def taxonomy_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy(spark, sf_dir).presentation_arcs().select(_name("parent"), _name("child"), "ord", "elr")


@query("taxonomy_calculation", "SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, CASE WHEN n_nationkey % 2 = 1 THEN -1e0 ELSE 1e0 END AS weight FROM nation")
def taxonomy_calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy(spark, sf_dir).calculation_arcs().select(_name("parent"), _name("child"), "weight")


@query("taxonomy_labels", "SELECT 'N' || n_nationkey AS concept, n_name AS text, 'en' AS lang, 'standard' AS source FROM nation")
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy(spark, sf_dir).labels().select(_name("concept"), "text", "lang", "source")


@query("taxonomy_metadata", "SELECT 'Nations' AS name, 'v1' AS version, 'unknown' AS publisher")
def taxonomy_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy(spark, sf_dir).metadata().select("name", "version", "publisher")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = model.table(spark, sf_dir, "nation").select(model.text("n_regionkey").alias("instance_id"), F.col("n_name").alias("concept"), F.col("n_nationkey"))
    return finding(nations, "rule", "test", F.concat(F.lit("about "), "concept"), status=F.when(F.col("n_nationkey") % 2 == 0, "PASS").otherwise("FAIL"))


@query("report_lines", "SELECT 'ERROR | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END || ' | rule | ' || n_name || ' | about ' || n_name AS line FROM nation")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_lines(_findings(spark, sf_dir)).select("line")


@query(
    "report_json",
    """SELECT CAST(n_regionkey AS VARCHAR) AS instance_id, CAST(count(*) FILTER (n_nationkey % 2 = 1) AS VARCHAR) AS errors, CAST(count(*) AS INTEGER) AS findings, min(n_name) AS first FROM nation GROUP BY 1""",
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.as_json(_findings(spark, sf_dir)).withColumn("all", F.from_json(F.get_json_object("json", "$.findings"), "array<struct<concept:string>>"))
    return found.select("instance_id", F.get_json_object("json", "$.summary.errors").alias("errors"), F.size("all").alias("findings"), F.array_min(F.transform("all", lambda x: x["concept"])).alias("first"))
