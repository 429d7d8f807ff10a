"""Conformance suites: an index of test cases, and their variations with inputs and expected outcomes."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .xml import Node, relation, shred

VARIATION = "test_case_id string, variation_id string, name string, instance_file string, taxonomy_file string, input_files array<string>, expected_type string, expected_code string, mandatory boolean"


def _beside(path: str, name: str) -> str:
    scheme, sep, rest = path.partition("://")
    return scheme + sep + posixpath.normpath(posixpath.join(posixpath.dirname(rest), name)) if sep else posixpath.normpath(posixpath.join(posixpath.dirname(path), name))


def shred_index(root: Node, path: str) -> Iterator[tuple[str, dict]]:
    """Test case files, of either dialect: documentation/testcases with a root folder, or testcases alone."""
    for group in [root] if root.local == "testcases" else [n for n in root.walk() if n.local == "testcases"]:
        folder = (group.get("root") or "").strip()
        for case in group.walk():
            uri = (case.get("uri") or "").strip()
            if case.local == "testcase" and uri:
                yield "case", {"file": _beside(path, f"{folder}/{uri}" if folder else uri)}


def expected(result: Node | None) -> tuple[str, str | None]:
    """(valid, warning or error, the code that is asked for)."""
    if result is None:
        return "valid", None
    error = result.find("error")
    said = (result.get("expected") or "").strip().lower()
    if error is not None and error.all_text():
        return "error", error.all_text()
    if said in ("invalid", "error") or error is not None:
        return "error", None
    return ("warning", None) if said == "warning" else ("valid", None)


def shred_case(root: Node, path: str) -> Iterator[tuple[str, dict]]:
    minimal = (root.get("minimal") or "").lower() != "false"
    for node in root:
        if node.local != "variation":
            continue
        data, kind, code = node.find("data"), *expected(node.find("result"))
        files = [(n, _beside(path, n.text)) for n in data or () if n.text]
        first = lambda wanted: next((f for n, f in files if wanted(n)), None)
        optional = "optional" in ((node.get("type") or "").lower(), (node.get("status") or "").lower()) or (node.get("blocked") or "").lower() == "true"
        yield "variation", {
            "test_case_id": root.get("name") or posixpath.basename(path).rpartition(".")[0], "variation_id": node.get("id"), "name": node.get("name") or node.get("id"),
            "instance_file": first(lambda n: n.local == "instance"), "taxonomy_file": first(lambda n: n.local in ("xsd", "schema") and (n.get("readMeFirst") or "").lower() == "true"),
            "input_files": [f for _, f in files], "expected_type": kind, "expected_code": code, "mandatory": minimal and not optional,
        }


def variations(spark: SparkSession, suite_id: str, index: str) -> DataFrame:
    """The variations of all test cases that an index names."""
    cases = [r.file for r in relation(shred(spark, index, shred_index), "case", "file string").distinct().collect()]
    if not cases:
        return spark.createDataFrame([], f"path string, {VARIATION}").withColumn("suite_id", F.lit(suite_id))
    found = shred(spark, cases, shred_case)
    return relation(found, "variation", VARIATION).withColumn("suite_id", F.lit(suite_id))
