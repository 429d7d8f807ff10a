"""Taxonomies: discovery of their files, and schemas and linkbases as relations.

Every linkbase is shredded alike into locators, arcs and resources; what an arc means follows from its arcrole
in the content, never from a file's name. Locators meet concepts by file and id.
"""

from __future__ import annotations

import posixpath
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from urllib.parse import unquote, urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import local_name
from ..operators.graph import substitution_closure
from ..session import materialize
from .xml import XLINK, XML_NS, Node, relation, shred

XS = "{http://www.w3.org/2001/XMLSchema}"
LINKBASE = "{http://www.xbrl.org/2003/linkbase}"
INSTANCE = "{http://www.xbrl.org/2003/instance}"
XBRLDT = "{http://xbrl.org/2005/xbrldt}"

#: Arcroles.
PARENT_CHILD = "http://www.xbrl.org/2003/arcrole/parent-child"
SUMMATION = ("http://www.xbrl.org/2003/arcrole/summation-item", "https://xbrl.org/2023/arcrole/summation-item")
CONCEPT_LABEL = "http://www.xbrl.org/2003/arcrole/concept-label"
ELEMENT_LABEL = "http://xbrl.org/arcrole/2008/element-label"
DIMENSION = "http://xbrl.org/int/dim/arcrole/"


def resolve(base: str, href: str, catalog: Mapping[str, str]) -> tuple[str, str]:
    """(file, fragment) of a reference: relative to its file, remote prefixes by the catalog, the longest first."""
    href, _, fragment = href.partition("#")
    whole = href if "://" in href else base if not href else urljoin(base, href) if "://" in base else posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href)))
    for prefix in sorted(catalog, key=len, reverse=True):
        if whole.startswith(prefix):
            whole = catalog[prefix].rstrip("/") + "/" + whole[len(prefix) :].lstrip("/")
            break
    if ":/" in whole and "://" not in whole:  # file:/a and file:///a are one
        whole = whole.replace(":/", ":///", 1)
    return whole, fragment


def _bases(node: Node, base: str) -> Iterator[tuple[Node, str]]:
    base = urljoin(base, node.get(f"{{{XML_NS}}}base", "")) if node.get(f"{{{XML_NS}}}base") else base
    yield node, base
    for child in node:
        yield from _bases(child, base)


def shred_taxonomy(catalog: Mapping[str, str]):
    catalog = dict(catalog)

    def shredder(root: Node, path: str) -> Iterator[tuple[str, dict]]:
        target = root.get("targetNamespace", "")
        said = next((n.all_text() for n in root.walk() if n.tag == f"{XS}documentation" and n.all_text()), None)
        yield "file", {"root": root.local, "documentation": said, "version": root.get("version"), "namespace": target or None}
        for node, base in _bases(root, path):
            href = node.get(f"{XLINK}href") or (node.get("schemaLocation") if node.tag in (f"{XS}import", f"{XS}include") else None)
            if href and node.local in ("import", "include", "linkbaseRef", "roleRef", "arcroleRef", "loc", "schemaRef"):
                file, fragment = resolve(base, href, catalog)
                yield "reference", {"how": node.local, "file": file, "fragment": fragment, "href": href}
            if node.tag == f"{XS}element" and node.get("name"):
                own = node.element.attrib
                yield "element", {
                    "concept": f"{{{target}}}{node.get('name')}", "id": node.get("id"), "data_type": node.name(node.get("type")), "substitution_group": node.name(node.get("substitutionGroup")),
                    "period_type": own.get(f"{INSTANCE}periodType"), "balance": own.get(f"{INSTANCE}balance"), "abstract": node.get("abstract", "false") in ("true", "1"), "nillable": node.get("nillable", "false") in ("true", "1"),
                    "typed_domain": own.get(f"{XBRLDT}typedDomainRef"), "domain": node.name(next((v for k, v in own.items() if k.endswith("}domain")), None)),
                    "linkrole": next((v for k, v in own.items() if k.endswith("}linkrole")), None), "head_usable": next((v for k, v in own.items() if k.endswith("}headUsable")), "false") in ("true", "1"),
                }
            if node.tag in (f"{XS}simpleType", f"{XS}complexType") and node.get("name"):
                bases = [d.name(d.get("base")) for d in node.walk() if d.local in ("restriction", "extension") and d.get("base")]
                unions = [d.name(m) for d in node.walk() if d.local == "union" for m in (d.get("memberTypes") or "").split()]
                facets = [d.get("value") for d in node.walk() if d.local == "enumeration"]
                yield "type", {"type": f"{{{target}}}{node.get('name')}", "bases": bases + unions, "is_union": bool(unions), "facets": facets}
            if node.get(f"{XLINK}type") == "extended":
                yield from _link(node, path, base, catalog)

    return shredder


def _link(node: Node, path: str, base: str, catalog) -> Iterator[tuple[str, dict]]:
    elr, link = node.get(f"{XLINK}role"), f"{path}#{id(node)}"
    for child in node:
        kind = child.get(f"{XLINK}type")
        if kind == "locator":
            file, fragment = resolve(base, child.get(f"{XLINK}href", ""), catalog)
            yield "locator", {"link": link, "elr": elr, "label": child.get(f"{XLINK}label"), "file": file, "fragment": fragment}
        elif kind == "arc":
            own = {k: v for k, v in child.element.attrib.items() if not k.startswith(XLINK)}
            key = "|".join(f"{k}={v}" for k, v in sorted(own.items()) if k not in ("use", "priority"))
            pick = lambda name: next((v for k, v in own.items() if k.rpartition("}")[2] == name), None)  # noqa: E731, B023
            yield "arc", {
                "link": link, "elr": elr, "arcrole": child.get(f"{XLINK}arcrole"), "source": child.get(f"{XLINK}from"), "target": child.get(f"{XLINK}to"), "ord": float(child.get("order", "1")), "weight": float(child.get("weight", "1")),
                "use": child.get("use", "optional"), "priority": int(child.get("priority", "0")), "key": key, "preferred_label": child.get("preferredLabel"), "closed": pick("closed") in ("true", "1"),
                "context_element": pick("contextElement"), "usable": pick("usable") not in ("false", "0"), "target_role": pick("targetRole"), "name": pick("name"), "complement": pick("complement") in ("true", "1"), "axis": pick("axis"),
            }
        elif kind == "resource":
            yield "resource", {
                "link": link, "elr": elr, "label": child.get(f"{XLINK}label"), "id": child.get("id"), "tag": child.tag, "local": child.local, "role": child.get(f"{XLINK}role"), "lang": child.get(f"{{{XML_NS}}}lang"),
                "text": child.all_text(), "attributes": {k: v for k, v in child.element.attrib.items() if not k.startswith(XLINK)} | _implementation(child), "aspects": _aspects(child),
            }


def _implementation(node: Node) -> dict:
    """Input names and body of a function's implementation: its steps are put into the output, each under its name."""
    if node.local != "implementation":
        return {}
    body = next((n.all_text() for n in node if n.local == "output"), "")
    for step in reversed([n for n in node if n.local == "step"]):
        body = body.replace(f"${step.get('name')}", f"({step.all_text()})")
    return {"inputs": " ".join(n.get("name", "") for n in node if n.local == "input"), "body": body}


def _aspects(node: Node) -> dict:
    """Names inside a rule or filter as Clark text: its concept, the members a rule sets by dimension, and the
    dimension (axis) and members that a dimension filter asks for."""
    name_in = lambda part: next((n.name(n.text) for n in part.walk() if n.local == "qname" and n.text), None) if part is not None else None
    found = {}
    if node.local in ("explicitDimension", "typedDimension"):
        found["axis"] = name_in(node.find("dimension")) or ""
        found |= {f"member:{i}": name_in(m) or "" for i, m in enumerate(c for c in node if c.local == "member")}
        return found
    for part in node.walk():
        if part.local == "explicitDimension" and part.get("dimension"):
            found[f"dim:{part.name(part.get('dimension'))}"] = name_in(part.find("member")) or ""
    holder = next((n for n in node.walk() if n.local == "concept"), None)
    found["concept"] = name_in(holder) or ""
    return found


class Taxonomy:
    """The relations of all files reached from an entry point.

    Discovery reads a frontier of files at a time, in Spark; it ends when no file names a new one. References to
    what no catalog prefix covers are listed by skipped().
    """

    ARC = "link string, elr string, arcrole string, source string, target string, ord double, weight double, use string, priority int, key string, preferred_label string, closed boolean, context_element string, usable boolean, target_role string, name string, complement boolean, axis string"
    RESOURCE = "link string, elr string, label string, id string, tag string, local string, role string, lang string, text string, attributes map<string,string>, aspects map<string,string>"

    def __init__(self, spark: SparkSession, entries: list[str], catalog: Mapping[str, str] | None = None):
        self.spark, catalog = spark, catalog or {}
        seen: set[str] = set()
        frontier = [resolve(e, "", catalog)[0] for e in entries]
        parts = []
        self._skipped: set[str] = set()
        while frontier:
            seen |= set(frontier)
            rows = materialize(shred(spark, frontier, shred_taxonomy(catalog)), "taxonomy")
            parts.append(rows)
            # names of files alone: as many as the taxonomy has
            files = {r.file for r in relation(rows, "reference", "how string, file string").select("file").distinct().collect()}
            remote = {f for f in files if f.startswith(("http://", "https://", "ftp://"))}
            self._skipped |= remote
            frontier = sorted(files - remote - seen)
        self.rows = parts[0] if len(parts) == 1 else _union(parts)

    def metadata(self) -> DataFrame:
        """(path, name, version, publisher): a schema's first documentation, cut to 80 characters, else its file's name."""
        stem = F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1)
        found = relation(self.rows, "file", "root string, documentation string, version string").where("root = 'schema'")
        return found.select("path", F.coalesce(F.substring("documentation", 1, 80), stem).alias("name"), F.coalesce("version", F.lit("unknown")).alias("version"), F.lit("unknown").alias("publisher"))

    def skipped(self) -> list[str]:
        return sorted(self._skipped)

    def elements(self) -> DataFrame:
        return relation(self.rows, "element", "concept string, id string, data_type string, substitution_group string, period_type string, balance string, abstract boolean, nillable boolean, typed_domain string, domain string, linkrole string, head_usable boolean")

    def types(self) -> DataFrame:
        return relation(self.rows, "type", "type string, bases array<string>, is_union boolean, facets array<string>")

    def concepts(self) -> DataFrame:
        """Elements whose chain of substitution groups reaches a root; monetary by type or a type's base."""
        elements = self.elements()
        reached = substitution_closure(elements.where("substitution_group IS NOT NULL"))
        monetary = self.types().select("type", F.explode("bases").alias("base")).where(local_name(F.col("base")) == "monetaryItemType").select(F.col("type").alias("data_type"), F.lit(True).alias("derived")).distinct()
        found = elements.join(reached.groupBy("concept").agg(F.first("root").alias("root")), "concept").join(monetary, "data_type", "left").join(self.enumerations(), "data_type", "left")
        return found.select("path", "concept", "id", "data_type", F.coalesce("period_type", F.lit("duration")).alias("period_type"), F.when(F.col("balance").isin("debit", "credit"), F.col("balance")).alias("balance"), "abstract", "nillable", "substitution_group", "typed_domain", (F.coalesce("derived", F.lit(False)) | (local_name(F.col("data_type")) == "monetaryItemType")).alias("monetary"), F.col("values").alias("enumeration"), "root")

    def enumerations(self) -> DataFrame:
        """(data_type, values): facet values of a type, its own narrowing its bases' (a union's are joined)."""
        types = materialize(self.types().select("type", "bases", "facets").dropDuplicates(["type"]), "types")
        known = types.where("size(facets) > 0").select(F.col("type").alias("data_type"), F.array_sort(F.array_distinct("facets")).alias("values"))
        while True:
            open_ = types.join(known, types["type"] == known["data_type"], "left_anti").select("type", F.explode("bases").alias("base"))
            derived = open_.join(known.withColumnRenamed("data_type", "base"), "base").groupBy(F.col("type").alias("data_type")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
            derived = materialize(derived, "enumerations")
            if derived.isEmpty():
                return known
            known = known.unionByName(derived)

    def locators(self) -> DataFrame:
        return relation(self.rows, "locator", "link string, elr string, label string, file string, fragment string")

    def arcs(self, *arcroles: str) -> DataFrame:
        found = relation(self.rows, "arc", self.ARC)
        return found.where(F.col("arcrole").isin(*arcroles)) if arcroles else found

    def resources(self) -> DataFrame:
        return relation(self.rows, "resource", self.RESOURCE)

    def _located(self) -> DataFrame:
        ids = self.elements().select(F.col("path").alias("file"), F.col("id").alias("fragment"), "concept")
        return self.locators().join(ids, ["file", "fragment"]).select("link", "label", "concept")

    def concept_arcs(self, *arcroles: str) -> DataFrame:
        """Arcs between concepts, their ends by name."""
        ends = self._located()
        arcs = self.arcs(*arcroles).withColumnsRenamed({"source": "from_label", "target": "to_label"})
        source = ends.select("link", F.col("label").alias("from_label"), F.col("concept").alias("source"))
        target = ends.select("link", F.col("label").alias("to_label"), F.col("concept").alias("target"))
        return arcs.join(source, ["link", "from_label"]).join(target, ["link", "to_label"])

    def presentation_arcs(self) -> DataFrame:
        return self.concept_arcs(PARENT_CHILD).select("elr", F.col("source").alias("parent"), F.col("target").alias("child"), "ord", "preferred_label")

    def calculation_arcs(self) -> DataFrame:
        found = self.concept_arcs(*SUMMATION)
        return found.select("elr", F.col("source").alias("parent"), F.col("target").alias("child"), "weight", "use", F.concat_ws("|", "source", "target", "key").alias("eq_key"), "ord")

    def definition_arcs(self) -> DataFrame:
        found = self.concept_arcs().where(F.startswith("arcrole", F.lit(DIMENSION)) & (F.col("use") != "prohibited"))
        return found.select("elr", F.regexp_replace("arcrole", "^.*/", "").alias("arcrole"), "source", "target", "ord", "closed", "context_element", "usable", "target_role")

    def hypercubes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(cubes, cube_items, cube_dims) of all has-hypercube arcs; items include the members under a primary item."""
        from ..operators.graph import member_network

        arcs = materialize(self.definition_arcs(), "definitions")
        has = arcs.where(F.col("arcrole").isin("all", "notAll")).withColumn("in_role", F.coalesce("target_role", "elr"))
        cubes = has.select(F.concat_ws(" ", "target", "elr", "arcrole").alias("cube"), "elr", "in_role", "source", F.col("target").alias("name"), "arcrole", "closed", "context_element", "ord")
        below = member_network(cubes.select("cube", "elr", F.col("source").alias("member")), arcs.where("arcrole = 'domain-member'"))
        items = below.select("cube", F.col("member").alias("concept")).distinct()
        dims = cubes.select("cube", "in_role", "name").join(arcs.where("arcrole = 'hypercube-dimension'").select(F.col("elr").alias("in_role"), F.col("source").alias("name"), F.col("target").alias("dim"), F.col("ord").alias("dim_ord"), F.coalesce("target_role", "elr").alias("elr")), ["in_role", "name"]).select("cube", "elr", "dim", "dim_ord")
        shown = cubes.select("cube", "elr", "arcrole", "closed", "context_element", F.col("ord").cast("int").alias("cube_ord")).dropDuplicates(["cube"])
        return shown, items, dims

    def labels(self) -> DataFrame:
        """Labels of concepts, standard and generic, without those that a prohibition cancels."""
        from ..operators.labels import active_labels

        arcs = self.arcs(CONCEPT_LABEL, ELEMENT_LABEL).select("link", F.col("source").alias("from"), F.col("target").alias("to"), "use", "priority", F.when(F.col("arcrole") == CONCEPT_LABEL, "standard").otherwise("generic").alias("source"))
        texts = self.resources().select("link", F.col("label").alias("label_id"), "text", "lang", "role", F.lit(0).alias("priority"))
        found = active_labels(arcs, texts).join(self._located().select("link", F.col("label").alias("from"), "concept"), ["link", "from"])
        return found.select("concept", "text", "lang", "role", "source", "priority")

    def breakdown_nodes(self) -> DataFrame:
        """Nodes of table axes: rule and aspect nodes with their axis, parent, order, codes and constraints.

        A table's arcs to its breakdowns name the axes; the nodes that a breakdown leads to stand at the top.
        """
        from ..operators.graph import closure

        nodes = self.resources().where(F.col("local").isin("ruleNode", "aspectNode", "definitionNode", "conceptRelationshipNode", "dimensionRelationshipNode")).withColumnRenamed("label", "node_id")
        tree = self.arcs().where(F.col("arcrole").rlike("(definition-node-subtree|breakdown-tree)$")).select("link", "source", "target", "ord")
        axes = self.arcs().where(F.col("arcrole").rlike("table-breakdown$")).select("link", F.col("target").alias("node"), "axis").dropDuplicates(["link", "node"])
        edges = tree.select("link", F.col("source").alias("node"), F.col("link").alias("to_link"), F.col("target").alias("to_node"))
        on_axis = closure(axes.select("axis", "link", "node"), edges, ["link", "node"]).select("link", F.col("node").alias("node_id"), "axis")
        known = nodes.select("link", F.col("node_id").alias("parent_id"))
        parents = tree.select("link", F.col("target").alias("node_id"), F.col("source").alias("parent_id"), "ord")
        placed = parents.join(known.withColumn("is_node", F.lit(True)), ["link", "parent_id"], "left").select("link", "node_id", F.when(F.col("is_node"), F.col("parent_id")).alias("parent_id"), "ord")
        dims = F.map_from_entries(F.transform(F.filter(F.map_entries("aspects"), lambda e: F.startswith(e["key"], F.lit("dim:"))), lambda e: F.struct(F.substring(e["key"], 5, 10000), e["value"])))
        flag = lambda name, default: F.coalesce(F.element_at("attributes", name).isin("true", "1"), F.lit(default))
        found = nodes.join(placed, ["link", "node_id"], "left").join(on_axis, ["link", "node_id"], "left")
        return found.select(
            F.col("link").alias("table_id"), F.coalesce("axis", F.lit("?")).alias("axis"), "node_id", "parent_id", F.coalesce("ord", F.lit(1.0)).alias("ord"), F.element_at("attributes", "tagSelector").alias("label"), F.col("id").alias("code"),
            flag("abstract", False).alias("is_abstract"), (F.coalesce(F.element_at("attributes", "parentChildOrder"), F.lit("parent-first")) == "parent-first").alias("parent_first"), F.nullif(F.element_at("aspects", "concept"), F.lit("")).alias("concept"), dims.alias("dims"),
        )

    def has_assertions(self) -> bool:
        return not self.resources().where(F.col("local").rlike("^(value|existence|consistency)Assertion$")).limit(1).isEmpty()

    def assertion_tables(self) -> DataFrame:
        """(assertion_id, table_id): the first table that an assertion's set applies to."""
        ids = self.resources().select("link", "label", F.coalesce("id", "label").alias("name"))
        ends = ids.unionByName(self.locators().select("link", "label", F.col("fragment").alias("name")))
        side = lambda end: ends.select("link", F.col("label").alias(end), F.col("name").alias(f"{end}_name"))
        named = self.arcs().where(F.col("arcrole").rlike("(assertion-set|applies-to-table)$")).join(side("source"), ["link", "source"]).join(side("target"), ["link", "target"])
        members = named.where(F.endswith("arcrole", F.lit("assertion-set"))).select(F.col("source_name").alias("set"), F.col("target_name").alias("assertion_id"))
        tables = named.where(F.endswith("arcrole", F.lit("applies-to-table"))).select(F.col("source_name").alias("set"), F.col("target_name").alias("table_id"), "ord")
        return members.join(tables, "set").groupBy("assertion_id").agg(F.min_by("table_id", F.struct("ord", "table_id")).alias("table_id"))

    def assertion_resources(self) -> DataFrame:
        """(assertion_id, text, lang, role, arcrole, priority): labels and messages of assertions."""
        texts = self.resources().select("link", F.col("label").alias("target"), "text", "lang", "role")
        ids = self.resources().select("link", F.col("label").alias("source"), F.coalesce("id", "label").alias("assertion_id")).unionByName(self.locators().select("link", F.col("label").alias("source"), F.col("fragment").alias("assertion_id")))
        arcs = self.arcs().where(F.col("arcrole").rlike("(element-label|satisfied-message|unsatisfied-message|severity)$"))
        return arcs.join(ids, ["link", "source"]).join(texts, ["link", "target"]).select("assertion_id", "text", "lang", "role", "arcrole", "priority")

    def custom_functions(self) -> dict[tuple[str, int], tuple[tuple[str, ...], str]]:
        """Functions that linkbases define, by name and number of inputs: input names and body; the last step returns."""
        found = {}
        resources = {(r.link, r.label): r for r in self.resources().where(F.col("local").isin("function", "implementation")).collect()}
        for a in self.arcs().where(F.endswith("arcrole", F.lit("function-implementation"))).orderBy("link", "source", "target").collect():
            declared, body = resources.get((a.link, a.source)), resources.get((a.link, a.target))
            if declared is not None and body is not None and "body" in body.attributes:
                names = tuple(n for n in (body.attributes.get("inputs") or "").split() if n)
                found.setdefault((declared.attributes.get("name", ""), len(names)), (names, body.attributes["body"]))
        return found

    def assertions(self) -> list:
        """Assertions with their variables and filters, ready to evaluate; taxonomies have few enough for the driver."""
        from ..operators.filters import BooleanFilter, DimensionFilter, TypedFilter, VariableFilter
        from ..operators.formula import Assertion

        resources = {(r.link, r.label): r for r in self.resources().where(F.col("local").rlike("Assertion$|^factVariable$|^(conceptName|instant|duration|period|explicitDimension|typedDimension|general|andFilter|orFilter)$")).collect()}
        arcs: dict = {}
        for a in self.arcs().where(F.col("arcrole").rlike("variable|boolean-filter")).orderBy("ord").collect():
            arcs.setdefault((a.link, a.source), []).append(a)

        def dimension(r, complement: bool):
            dim = r.aspects.get("axis") or ""
            members = tuple(v for k, v in sorted(r.aspects.items()) if k.startswith("member:") and v)
            return TypedFilter(dim, complement) if r.local == "typedDimension" else DimensionFilter(dim, members, complement)

        def boolean(link, label, complement: bool):
            r = resources[link, label]
            children = [boolean(link, a.target, a.complement) if resources[link, a.target].local in ("andFilter", "orFilter") else dimension(resources[link, a.target], a.complement) for a in arcs.get((link, label), []) if (link, a.target) in resources and resources[link, a.target].local in ("andFilter", "orFilter", "explicitDimension", "typedDimension")]
            return BooleanFilter("and" if r.local == "andFilter" else "or", tuple(children), complement)

        def variable(link, label):
            own = resources[link, label].attributes
            parts = {"fallback": own.get("fallbackValue"), "dimensions": [], "typed": [], "booleans": [], "xpaths": []}
            for a in arcs.get((link, label), []):
                r = resources.get((link, a.target))
                if r is None:
                    continue
                if r.local == "conceptName":
                    parts["concept"] = r.aspects.get("concept") or None
                elif r.local in ("instant", "duration"):
                    parts.setdefault("period_type", r.local)
                elif r.local in ("general", "period"):
                    parts["xpaths"].append(r.attributes.get("test", "true()"))
                elif r.local in ("andFilter", "orFilter"):  # complements are read inside boolean filters alone
                    parts["booleans"].append(boolean(link, a.target, False))
                elif r.local == "typedDimension":
                    parts["typed"].append(dimension(r, False))
                elif r.local == "explicitDimension":
                    parts["dimensions"].append(dimension(r, False))
            return VariableFilter(**parts)

        found = []
        for (link, label), r in sorted(resources.items()):
            if r.local not in ("valueAssertion", "existenceAssertion", "consistencyAssertion"):
                continue
            named = {a.name or a.target: variable(link, a.target) for a in arcs.get((link, label), []) if (link, a.target) in resources and resources[link, a.target].local == "factVariable"}
            own = r.attributes
            found.append(Assertion(r.id or label, r.local.removesuffix("Assertion"), named, own.get("test") or own.get("formula") or "", absolute_radius=own.get("absoluteAcceptanceRadius"), relative_radius=own.get("proportionalAcceptanceRadius")))
        return found


def companions(spark: SparkSession, entry: str) -> list[str]:
    """Presentation files in a folder tab beside an entry point, or beside its folder if that is mod or tab."""
    path = spark._jvm.org.apache.hadoop.fs.Path(entry)
    system, folder = path.getFileSystem(spark._jsc.hadoopConfiguration()), path.getParent()
    roots = [folder.getParent(), folder] if folder.getName() in ("mod", "tab") else [folder]
    found = []
    for root in roots:
        hits = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "tab/*pre*.xml"))
        found += [resolve(hit.getPath().toString(), "", {})[0] for hit in hits or []]
    return list(dict.fromkeys(found))


class TaxonomyCache:
    """The last taxonomies that were read, by entry points; the one unused for longest goes first."""

    def __init__(self, capacity: int = 5):
        self.capacity, self.held = capacity, OrderedDict()

    def get(self, spark: SparkSession, entries: list[str], catalog: Mapping[str, str] | None = None) -> Taxonomy:
        key = (tuple(entries), tuple(sorted((catalog or {}).items())))
        if key not in self.held:
            self.held[key] = Taxonomy(spark, entries, catalog)
        self.held.move_to_end(key)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return self.held[key]


def infer_catalog(entry: str, hosts: list[str]) -> dict[str, str]:
    """Prefixes of remote files that lie beside an entry point under a folder named cache, by host name."""
    root, found, _ = entry.partition("/cache/")
    return {f"{scheme}://{host}/": f"{root}/cache/{host}" for host in hosts for scheme in ("http", "https", "ftp")} if found else {}


def _union(parts: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)
