"""Relational schemas of taxonomies, filings and findings.

Names (concepts, dimensions, members) are Clark text, {namespace}local, so they compare by namespace and local
name alone. Every relation of a filing is keyed by instance_id; fact_ord is a fact's place in its filing.
"""

from __future__ import annotations

CONCEPT = "concept string, data_type string, period_type string, balance string, abstract boolean, nillable boolean, substitution_group string, typed_domain string, enumeration array<string>"
LABEL = "concept string, text string, lang string, role string, source string, priority int"
PRESENTATION_ARC = "elr string, parent string, child string, ord double, preferred_label string"
CALCULATION_ARC = "elr string, parent string, child string, weight double, use string, eq_key string, ord double"
DEFINITION_ARC = "elr string, arcrole string, source string, target string, ord double, closed boolean, context_element string, usable boolean, target_role string"
HYPERCUBE = "cube string, elr string, arcrole string, closed boolean, context_element string, cube_ord int"
CUBE_ITEM = "cube string, elr string, concept string"
CUBE_DIMENSION = "cube string, elr string, dim string, dim_ord int"
CUBE_MEMBER = "cube string, elr string, dim string, member string"
DIMENSION = "dim string, dim_type string, default_member string"
DIMENSION_MEMBER = "dim string, member string, parent string, ord double, usable boolean"
BREAKDOWN_NODE = "table_id string, axis string, node_id string, parent_id string, ord double, label string, code string, is_abstract boolean, parent_first boolean, concept string, dims map<string,string>"
ASSERTION = "assertion_id string, kind string, severity string, abstract boolean, test string, formula string, absolute_radius double, relative_radius double"

CONTEXT = "instance_id string, context_id string, entity_scheme string, entity_id string, period_type string, instant date, start date, end date, dims map<string,string>, typed map<string,string>, containers map<string,string>, s_equal_key string"
UNIT = "instance_id string, unit_id string, form string, numerator array<string>, denominator array<string>"
FACT = "instance_id string, fact_ord bigint, concept string, context_id string, unit_id string, value string, decimals string, precision string, is_nil boolean"
FILING_INDICATOR = "instance_id string, template string, filed boolean"

FINDING = "instance_id string, rule_id string, severity string, status string, source string, concept string, context_id string, hypercube string, dimension string, constraint_type string, table_id string, message string"

XBRLI = "http://www.xbrl.org/2003/instance"
ISO4217 = "http://www.xbrl.org/2003/iso4217"
