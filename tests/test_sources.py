import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources.instances import Filings
from ledgerspark.sources.sinks import documents, prefixes
from ledgerspark.sources.taxonomies import Taxonomy, TaxonomyCache, companions, resolve
from ledgerspark.sources.xml import parse

NS = 'xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:iso4217="http://www.xbrl.org/2003/iso4217" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
INSTANCE = f"""<xbrli:xbrl {NS} xmlns:e="http://e.com/tax">
<link:schemaRef xlink:type="simple" xlink:href="tax.xsd"/>
<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="s">E&amp;1</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="e:Country">e:ES</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
 <xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period><xbrli:scenario><xbrldi:typedMember dimension="e:Id"><e:v>7</e:v></xbrldi:typedMember></xbrli:scenario></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:identifier scheme="s">E&amp;1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit>
<xbrli:unit id="d"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<e:Cash id="f1" contextRef="c1" unitRef="u" decimals="0">100</e:Cash>
<e:Cash contextRef="c2" unitRef="u" xsi:nil="true"/>
<e:Unknown contextRef="c1">x &lt; y</e:Unknown>
<link:footnoteLink xlink:type="extended"><link:loc xlink:type="locator" xlink:label="a" xlink:href="#f1"/><link:loc xlink:type="locator" xlink:label="b" xlink:href="#f9"/>
<link:footnote xlink:type="resource" xlink:label="n">note</link:footnote><link:footnoteArc xlink:type="arc" xlink:from="a" xlink:to="n"/><link:footnoteArc xlink:type="arc" xlink:from="a" xlink:to="zz"/></link:footnoteLink>
</xbrli:xbrl>"""

SCHEMA = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:e="http://e.com/tax" targetNamespace="http://e.com/tax">
<xs:annotation><xs:appinfo><link:linkbaseRef xlink:type="simple" xlink:href="one.xml"/><link:linkbaseRef xlink:type="simple" xlink:href="http://far.org/x.xml"/></xs:appinfo></xs:annotation>
<xs:element name="Cash" id="e_Cash" type="xbrli:monetaryItemType" substitutionGroup="xbrli:item" xbrli:periodType="instant" xbrli:balance="debit"/>
<xs:element name="Bank" id="e_Bank" type="e:money" substitutionGroup="e:Cash" xbrli:periodType="instant"/>
<xs:element name="Coin" id="e_Coin" type="e:colour" substitutionGroup="xbrli:item" xbrli:periodType="instant"/>
<xs:element name="Loose" id="e_Loose" type="xs:string"/>
<xs:element name="Odd" id="e_Odd" type="xs:string" substitutionGroup="e:Nowhere"/>
<xs:complexType name="money"><xs:simpleContent><xs:restriction base="xbrli:monetaryItemType"/></xs:simpleContent></xs:complexType>
<xs:simpleType name="base"><xs:restriction base="xs:string"><xs:enumeration value="red"/><xs:enumeration value="blue"/></xs:restriction></xs:simpleType>
<xs:simpleType name="colour"><xs:restriction base="e:base"/></xs:simpleType>
</xs:schema>"""

LINKS = """<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">
<link:calculationLink xlink:type="extended" xlink:role="r"><link:loc xlink:type="locator" xlink:href="tax.xsd#e_Cash" xlink:label="a"/><link:loc xlink:type="locator" xlink:href="tax.xsd#e_Bank" xlink:label="b"/>
<link:calculationArc xlink:type="arc" xlink:arcrole="http://www.xbrl.org/2003/arcrole/summation-item" xlink:from="a" xlink:to="b" weight="-1" order="2"/></link:calculationLink>
<link:presentationLink xlink:type="extended" xlink:role="r"><link:loc xlink:type="locator" xlink:href="tax.xsd#e_Cash" xlink:label="a"/><link:loc xlink:type="locator" xlink:href="tax.xsd#e_Bank" xlink:label="b"/>
<link:presentationArc xlink:type="arc" xlink:arcrole="http://www.xbrl.org/2003/arcrole/parent-child" xlink:from="a" xlink:to="b" order="1"/></link:presentationLink>
<link:labelLink xlink:type="extended" xlink:role="r"><link:loc xlink:type="locator" xlink:href="tax.xsd#e_Cash" xlink:label="a"/><link:label xlink:type="resource" xlink:label="l" xlink:role="http://www.xbrl.org/2003/role/label" xml:lang="en">Cash at hand</link:label>
<link:labelArc xlink:type="arc" xlink:arcrole="http://www.xbrl.org/2003/arcrole/concept-label" xlink:from="a" xlink:to="l"/></link:labelLink>
</link:linkbase>"""


@pytest.fixture(scope="module")
def filings(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("filings")
    (folder / "a.xbrl").write_text(INSTANCE)
    (folder / "bad.xbrl").write_text("<a><b></a>")
    return Filings(spark, str(folder))


@pytest.fixture(scope="module")
def taxonomy(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("taxonomy")
    (folder / "tax.xsd").write_text(SCHEMA)
    (folder / "one.xml").write_text(LINKS)
    return Taxonomy(spark, [f"file://{folder}/tax.xsd"])


def test_instance_relations(filings):
    c1, c2 = filings.contexts().orderBy("context_id").collect()
    assert (c1.entity_id, c1.period_type, str(c1.instant)) == ("E&1", "instant", "2024-12-31")
    assert c1.dims == {"{http://e.com/tax}Country": "{http://e.com/tax}ES"}
    assert c1.typed == {"{http://e.com/tax}Id": "7"}
    assert c1.containers == {"{http://e.com/tax}Country": "segment", "{http://e.com/tax}Id": "scenario"}
    assert (c2.period_type, str(c2.start)) == ("duration", "2024-01-01")
    facts = filings.facts().orderBy("fact_ord").collect()
    assert [(f.concept[-4:], f.value, f.is_nil) for f in facts] == [("Cash", "100", False), ("Cash", None, True), ("nown", "x < y", False)]
    assert {(u.unit_id, u.form, len(u.denominator)) for u in filings.units().collect()} == {("u", "simple", 0), ("d", "divide", 1)}
    assert filings.errors().count() == 1
    assert sorted(r.label for r in filings.footnote_problems().collect()) == ["#f9", "zz"]


def test_orphans(spark, filings):
    known = spark.createDataFrame([("{http://e.com/tax}Cash",)], "concept string")
    reported, orphans = filings.reported(known)
    assert (reported.count(), orphans.count()) == (2, 1)


def test_round_trip(spark, filings, tmp_path):
    good = filings.instances().where("schema_ref IS NOT NULL")
    text = documents(good, filings.contexts(), filings.units(), filings.facts().drop("xml"), filings.indicators()).collect()
    assert len(text) == 1
    (tmp_path / "b.xbrl").write_text(text[0].xml)
    again = Filings(spark, str(tmp_path))
    drop = lambda df: sorted(str(r) for r in df.drop("instance_id", "xml", "id", "s_equal_key").collect())
    assert drop(again.facts()) == drop(filings.facts())
    assert drop(again.units()) == drop(filings.units())
    assert drop(again.contexts()) == drop(filings.contexts())


PREAMBLE = "http://www.bde.es/es/fr/esrs/comun/2008-06-01/preambulo"
FILED = INSTANCE.replace("</xbrli:xbrl>", """<f:fIndicators xmlns:f="http://www.eurofiling.info/xbrl/ext/filing-indicators"><f:filingIndicator contextRef="c2"> T1 </f:filingIndicator>
<f:filingIndicator contextRef="c1" filed="no">T2</f:filingIndicator><f:filingIndicator contextRef="c1" f:filed="1">T3</f:filingIndicator><f:filingIndicator contextRef="c1"/></f:fIndicators></xbrli:xbrl>""")
REPORTED = FILED.replace("</xbrli:xbrl>", f"""<p:EntidadPresentadora xmlns:p="{PREAMBLE}" contextRef="c2">0049</p:EntidadPresentadora><p:TipoEnvio xmlns:p="{PREAMBLE}" contextRef="c2">Ordinario</p:TipoEnvio>
<p:EstadosReportados xmlns:p="{PREAMBLE}"><p:CodigoEstado>4001</p:CodigoEstado><p:CodigoEstado contextRef="c1" p:blanco="true">4002</p:CodigoEstado></p:EstadosReportados></xbrli:xbrl>""")


def test_indicators_preamble_and_typed_elements_survive_the_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xbrl").write_text(FILED)
    (tmp_path / "in" / "b.xbrl").write_text(REPORTED)
    read = Filings(spark, str(tmp_path / "in"))
    name = F.regexp_extract("instance_id", "([a-z]).xbrl$", 1)
    shown = lambda filings: sorted((r.n, r.template, r.filed, r.context_id) for r in filings.indicators().withColumn("n", name).collect())
    assert shown(read) == [("a", "T1", True, "c2"), ("a", "T2", False, "c1"), ("a", "T3", True, "c1"), ("b", "4001", True, "c2"), ("b", "4002", False, "c1")]
    assert read.facts().count() == 6, "elements of the preamble are no facts"
    assert {r.typed_elements["{http://e.com/tax}Id"] for r in read.contexts().where("context_id = 'c1'").collect()} == {"{http://e.com/tax}v"}
    out = documents(read.instances(), read.contexts(), read.units(), read.facts(), read.indicators(), preamble=read.preamble())
    (tmp_path / "out").mkdir()
    for r in out.withColumn("n", name).collect():
        (tmp_path / "out" / f"{r.n}.xbrl").write_text(r.xml)
    again = Filings(spark, str(tmp_path / "out"))
    assert shown(again) == shown(read)
    drop = lambda df: sorted(str(r) for r in df.withColumn("n", name).drop("instance_id", "id", "s_equal_key").collect())
    assert drop(again.contexts()) == drop(read.contexts())
    assert drop(again.preamble()) == drop(read.preamble())
    assert drop(again.facts()) == drop(read.facts())


def test_document_types_are_refused_wherever_they_stand():
    for opening in (b"", b"<!-- " + b"x" * 200_000 + b" -->"):
        with pytest.raises(ValueError):
            parse(opening + b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>")
    with pytest.raises(ValueError):
        parse("<!DOCTYPE a []><a/>".encode("utf-16"))
    assert parse(b"<!-- <!DOCTYPE a> --><a>DOCTYPE</a>").text == "DOCTYPE"


def test_companions_and_cache(spark, tmp_path):
    (tmp_path / "mod").mkdir()
    (tmp_path / "tab").mkdir()
    (tmp_path / "mod" / "tax.xsd").write_text(SCHEMA)
    (tmp_path / "mod" / "one.xml").write_text(LINKS)
    (tmp_path / "tab" / "tax.xsd").write_text(SCHEMA)
    (tmp_path / "tab" / "one.xml").write_text(LINKS)
    (tmp_path / "tab" / "t-pre.xml").write_text(LINKS)
    (tmp_path / "tab" / "t-lab.xml").write_text(LINKS)
    entry = f"file://{tmp_path}/mod/tax.xsd"
    assert companions(spark, entry) == [f"file://{tmp_path}/tab/t-pre.xml"]
    cache = TaxonomyCache(2)
    first = cache.get(spark, [entry])
    assert cache.get(spark, [entry]) is first
    cache.get(spark, [entry, f"file://{tmp_path}/tab/t-pre.xml"])
    cache.get(spark, [f"file://{tmp_path}/mod/one.xml"])
    assert cache.get(spark, [entry]) is not first


def test_taxonomy_relations(taxonomy):
    concepts = {re.sub(".*}", "", c.concept): c for c in taxonomy.concepts().collect()}
    assert set(concepts) == {"Cash", "Bank", "Coin"}
    assert concepts["Bank"].monetary
    assert concepts["Cash"].balance == "debit"
    assert concepts["Coin"].enumeration == ["blue", "red"]
    assert taxonomy.skipped() == ["http://far.org/x.xml"]
    arc = taxonomy.calculation_arcs().first()
    assert (arc.parent[-4:], arc.child[-4:], arc.weight, arc.ord) == ("Cash", "Bank", -1.0, 2.0)
    assert taxonomy.presentation_arcs().count() == 1
    label = taxonomy.labels().first()
    assert (label.text, label.lang, label.source) == ("Cash at hand", "en", "standard")


def test_catalog_and_repair():
    assert resolve("file:///a/b.xsd", "../c.xsd#x", {}) == ("file:///c.xsd", "x")
    assert resolve("file:///a/b.xsd", "http://w.org/t/c.xsd", {"http://w.org/": "file:///cache/w.org"})[0] == "file:///cache/w.org/t/c.xsd"
    assert parse(b'<a xmlns:p="u">< p:b/></a>').children[0].tag == "{u}b"
    with pytest.raises(ValueError):
        parse(b"<!DOCTYPE a [<!ENTITY x 'y'>]><a/>")


def test_prefixes(spark):
    names = spark.createDataFrame([("{http://a.com/dim}X",), ("{http://b.com/dim}Y",), ("{http://www.xbrl.org/2003/instance}pure",)], "name string")
    found = {r.ns: r.prefix for r in prefixes(names).collect()}
    assert found == {"http://a.com/dim": "dim", "http://b.com/dim": "dim_2", "http://www.xbrl.org/2003/instance": "xbrli"}
    assert F is not None
