"""Filings: contexts, units, facts, footnotes and indicators of many instance documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import period_key
from ..operators.dml import preferred_indicators
from ..schemas import XBRLI
from .xml import XLINK, Node, relation, shred

LINK = "http://www.xbrl.org/2003/linkbase"
#: Fixed value: namespace of the regulator's preamble.
PREAMBLE = "http://www.bde.es/es/fr/esrs/comun/2008-06-01/preambulo"
TRUE = ("true", "1", "yes")
XSI_NIL = "{http://www.w3.org/2001/XMLSchema-instance}nil"


def normal_text(text: str) -> str:
    """A text by value: decimals without padding, booleans as words; not-a-number equals nothing, itself included."""
    text = text.strip()
    if text in ("NaN", "nan"):
        return f"NaN:{uuid.uuid4().hex}"
    if text in ("true", "1.0", "false"):
        return {"true": "true", "false": "false"}.get(text, "1")
    try:
        number = Decimal(text)
    except InvalidOperation:
        return text
    if not number.is_finite():
        return text
    return format(number.normalize() + 0, "f")


def normal_form(node: Node) -> str:
    """An element's content as one string that equal contents share."""
    attributes = ",".join(f"{k}={normal_text(v)}" for k, v in sorted(node.element.attrib.items()))
    inner = "".join(normal_form(c) for c in node) if node.children else normal_text(node.all_text())
    return f"<{node.tag} {attributes}>{inner}</>"


def _context(node: Node) -> tuple[dict, list[dict], list[dict]]:
    entity, period, scenario = node.find("entity"), node.find("period"), node.find("scenario")
    identifier = entity.find("identifier") if entity else None
    segment = (entity.find("segment") if entity else None) or node.find("segment")
    dims, typed, typed_elements, containers, members, elements, others = {}, {}, {}, {}, [], [], []
    for container, part in (("segment", segment), ("scenario", scenario)):
        for child in part or ():
            dim = child.name(child.get("dimension")) if child.local in ("explicitMember", "typedMember") else None
            if dim is None:
                others.append(f"{container}:{normal_form(child)}")
                elements += [{"context_id": node.get("id"), "element": e.tag, "container": container} for e in child.walk()]
                continue
            members.append({"context_id": node.get("id"), "dim": dim, "container": container, "typed": child.local == "typedMember"})
            containers[dim] = container
            if child.local == "explicitMember":
                dims[dim] = child.name(child.text)
            else:
                typed[dim] = child.all_text()
                if child.children:
                    typed_elements[dim] = child.children[0].tag
    at = lambda name: part.text[:10] if period is not None and (part := period.find(name)) is not None else None
    instant, start, end = at("instant"), at("startDate"), at("endDate")
    row = {
        "context_id": node.get("id"), "entity_scheme": identifier.get("scheme") if identifier else None, "entity_id": identifier.text if identifier else None,
        "period_type": "instant" if instant else "duration" if start or end else None, "instant": instant, "start": start, "end": end,
        "dims": dims, "typed": typed, "typed_elements": typed_elements, "containers": containers, "other": "|".join(sorted(others)),
    }
    return row, members, elements


def _unit(node: Node) -> dict:
    names = lambda part: [c.name(c.text) for c in part or () if c.local == "measure"]
    divide = node.find("divide")
    if divide is not None:
        return {"unit_id": node.get("id"), "form": "divide", "numerator": names(divide.find("unitNumerator")), "denominator": names(divide.find("unitDenominator"))}
    return {"unit_id": node.get("id"), "form": "simple", "numerator": names(node), "denominator": []}


def shred_instance(root: Node, path: str) -> Iterator[tuple[str, dict]]:
    order, preamble_context = 0, None
    for node in root:
        if node.tag == f"{{{XBRLI}}}context":
            row, members, elements = _context(node)
            yield "context", row
            yield from (("member", m) for m in members)
            yield from (("element", e) for e in elements)
        elif node.tag == f"{{{XBRLI}}}unit":
            yield "unit", _unit(node)
        elif node.tag == f"{{{LINK}}}schemaRef":
            yield "schema_ref", {"href": node.get(f"{XLINK}href")}
        elif node.tag == f"{{{LINK}}}footnoteLink":
            for child in node:
                yield f"footnote_{child.get(XLINK + 'type') or child.local}", {"label": child.get(f"{XLINK}label"), "href": child.get(f"{XLINK}href"), "source": child.get(f"{XLINK}from"), "target": child.get(f"{XLINK}to"), "arcrole": child.get(f"{XLINK}arcrole"), "text": child.all_text()}
        elif node.local in ("fIndicators", "filingIndicators"):
            for child in node:
                filed = next((v for k, v in child.element.attrib.items() if k.rpartition("}")[2] == "filed"), "true")
                if child.text:
                    yield "indicator", {"template": child.text, "filed": filed.strip().lower() in TRUE, "context_id": child.get("contextRef")}
        elif node.tag.startswith(f"{{{PREAMBLE}}}"):
            if node.local in ("EntidadPresentadora", "TipoEnvio"):
                yield "preamble", {"name": node.local, "value": node.text, "context_id": node.get("contextRef")}
                preamble_context = preamble_context or node.get("contextRef")
            for child in node:
                if child.local == "CodigoEstado" and child.text:
                    blank = child.get(f"{{{PREAMBLE}}}blanco", "false").strip().lower() in TRUE
                    yield "report", {"template": child.text, "filed": not blank, "context_id": child.get("contextRef") or preamble_context}
        elif node.tag == f"{{{LINK}}}linkbaseRef":
            yield "linkbase_ref", {"href": node.get(f"{XLINK}href"), "role": node.get(f"{XLINK}role")}
        elif node.get("contextRef"):
            nil = node.get(XSI_NIL, "false").strip() in ("true", "1")
            yield "fact", {
                "fact_ord": order, "concept": node.tag, "context_id": node.get("contextRef"), "unit_id": node.get("unitRef"), "value": None if nil else node.all_text(),
                "decimals": node.get("decimals"), "precision": node.get("precision"), "is_nil": nil, "id": node.get("id"),
            }
            yield "source", {"fact_ord": order, "xml": node.source()}
            order += 1


class Filings:
    """The relations of the instance documents at paths; the documents are parsed once, when rows is written."""

    def __init__(self, spark: SparkSession, paths: str | list[str], pattern: str | None = None):
        from ..session import materialize

        # by kind, so that a relation reads its own rows alone
        self.rows = materialize(shred(spark, paths, shred_instance, pattern), "filings", by="kind")

    def _relation(self, kind: str, schema: str) -> DataFrame:
        return relation(self.rows, kind, schema).withColumnRenamed("path", "instance_id")

    def contexts(self) -> DataFrame:
        found = self._relation("context", "context_id string, entity_scheme string, entity_id string, period_type string, instant date, start date, `end` date, dims map<string,string>, typed map<string,string>, typed_elements map<string,string>, containers map<string,string>, other string")
        from ..functions.keys import s_equal_key

        period = period_key(F.col("period_type"), F.col("instant"), F.col("start"), F.col("end"))
        key = F.concat_ws("\n", s_equal_key(F.col("entity_scheme"), F.col("entity_id"), period, F.col("dims"), F.col("typed"), F.col("containers")), "other")
        return found.withColumn("s_equal_key", key).drop("other")

    def units(self) -> DataFrame:
        return self._relation("unit", "unit_id string, form string, numerator array<string>, denominator array<string>")

    def facts(self) -> DataFrame:
        return self._relation("fact", "fact_ord bigint, concept string, context_id string, unit_id string, value string, decimals string, precision string, is_nil boolean, id string")

    def reported(self, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts of known concepts, orphans, which keep their source)."""
        known = concepts.select("concept")
        sources = self._relation("source", "fact_ord bigint, xml string")
        return self.facts().join(known, "concept", "left_semi"), self.facts().join(known, "concept", "left_anti").join(sources, ["instance_id", "fact_ord"])

    def members(self) -> DataFrame:
        return self._relation("member", "context_id string, dim string, container string, typed boolean")

    def elements(self) -> DataFrame:
        return self._relation("element", "context_id string, element string, container string")

    def indicators(self) -> DataFrame:
        """Filing indicators: those of a filing's preamble, else its indicator elements."""
        shape = "template string, filed boolean, context_id string"
        return preferred_indicators(self._relation("report", shape), self._relation("indicator", shape))

    def preamble(self) -> DataFrame:
        """(instance_id, name, value, context_id) of the preamble's single elements."""
        return self._relation("preamble", "name string, value string, context_id string")

    def linkbase_refs(self) -> DataFrame:
        """Linkbases that a filing names itself; see operators.dml.merged_calculations."""
        return self._relation("linkbase_ref", "href string, role string")

    def instances(self) -> DataFrame:
        refs = self._relation("schema_ref", "href string").groupBy("instance_id").agg(F.first("href").alias("schema_ref"))
        return self.rows.select(F.col("path").alias("instance_id")).distinct().join(refs, "instance_id", "left")

    def errors(self) -> DataFrame:
        return self._relation("error", "message string")

    def footnote_problems(self) -> DataFrame:
        """Footnote arcs whose ends are no locator or resource of the document, and locators of what isn't there."""
        shape = "label string, href string, source string, target string, arcrole string, text string"
        arcs, locators, resources = (self._relation(f"footnote_{k}", shape) for k in ("arc", "locator", "resource"))
        ends = locators.select("instance_id", "label").unionByName(resources.select("instance_id", "label")).distinct()
        open_ends = arcs.select("instance_id", F.explode(F.array("source", "target")).alias("label")).join(ends, ["instance_id", "label"], "left_anti")
        ids = self.facts().select("instance_id", F.concat(F.lit("#"), "id").alias("href"))
        lost = locators.where(F.startswith("href", F.lit("#"))).join(ids, ["instance_id", "href"], "left_anti").select("instance_id", F.col("href").alias("label"))
        return open_ends.unionByName(lost).distinct()
