"""Scalar derivations on reported values, codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_WORDS = ("monetary", "decimal", "integer", "float", "double")


def local_name(clark: Column) -> Column:
    return F.regexp_replace(clark, "^\\{[^}]*\\}", "")


def namespace(clark: Column) -> Column:
    return F.regexp_extract(clark, "^\\{([^}]*)\\}", 1)


def clark(ns: Column, local: Column) -> Column:
    return F.concat(F.lit("{"), ns, F.lit("}"), local)


def is_numeric_type(data_type: Column) -> Column:
    """Numeric, by the words in the type's local name."""
    return F.coalesce(F.lower(local_name(data_type)).rlike("|".join(NUMERIC_WORDS)), F.lit(False))


def enumeration_uri(name: Column) -> Column:
    """ns#local, as extensible enumerations write their members."""
    return F.concat(namespace(name), F.lit("#"), local_name(name))


def name_forms(name: Column, prefix: Column) -> Column:
    """The lexical forms under which one name may be reported."""
    return F.array_distinct(F.filter(F.array(name, enumeration_uri(name), F.concat(prefix, F.lit(":"), local_name(name))), lambda x: x.isNotNull()))


def concept_aliases(name: Column, prefix: Column, identifier: Column) -> Column:
    """Keys under which a locator may refer to a concept: its id, its local name, the latter with prefix or digest."""
    local = local_name(name)
    return F.array_distinct(F.filter(F.array(identifier, F.concat(prefix, F.lit("_"), local), F.concat(F.substring(F.sha2(namespace(name), 256), 1, 8), F.lit("_"), local), local), lambda x: x.isNotNull()))


def cell_code(row_code: Column, column_code: Column) -> Column:
    """The zero-padded sum of a cell's row and column codes; null where the row's is no whole number."""
    row, column = row_code.try_cast("int"), F.coalesce(column_code.try_cast("int"), F.lit(0))
    return F.when(row.isNotNull(), F.format_string("%04d", row + column))


def indicator_aliases(template: Column) -> Column:
    """The spellings of a template code: t and b, each with and without the es_ prefix."""
    bare = F.regexp_replace(F.lower(template), "^es_", "")
    kind, rest = F.substring(bare, 1, 1), F.substring(bare, 2, 1000)
    forms = [F.concat(F.lit(prefix + letter), rest) for prefix in ("", "es_") for letter in ("t", "b")]
    return F.when(kind.isin("t", "b"), F.array(*forms)).otherwise(F.array(F.lower(template)))


def normalized_number(text: Column) -> Column:
    """A number as people write it, in canonical form: of two kinds of separators the last is the decimal one, and a
    lone comma is decimal unless exactly three digits follow it."""
    t = F.regexp_replace(F.trim(text), "[\\s\\u00A0]", "")
    comma, point = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    has_comma, has_point = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    return (
        F.when(has_comma & has_point & (comma > point), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_comma & has_point, F.replace(t, F.lit(","), F.lit("")))
        .when(has_comma & (F.regexp_count(t, F.lit(",")) > 1), F.replace(t, F.lit(","), F.lit("")))
        .when(has_comma & t.rlike("^[+-]?\\d{1,3},\\d{3}$"), F.replace(t, F.lit(","), F.lit("")))
        .when(has_comma, F.replace(t, F.lit(","), F.lit(".")))
        .when(F.regexp_count(t, F.lit("\\.")) > 1, F.replace(t, F.lit("."), F.lit("")))
        .otherwise(t)
    )


def valid_value(value: Column, category: Column) -> Column:
    """Whether a lexical value fits its category: monetary, decimal, integer, date, boolean or string."""
    return (
        F.when(category.isin("monetary", "decimal"), F.trim(value).try_cast("decimal(38,10)").isNotNull())
        .when(category == "integer", F.trim(value).rlike("^[+-]?\\d+$"))
        .when(category == "date", F.trim(value).rlike("^\\d{4}-\\d{2}-\\d{2}$") & F.trim(value).try_cast("date").isNotNull())
        .when(category == "boolean", F.lower(F.trim(value)).isin("true", "false", "1", "0"))
        .otherwise(F.lit(True))
    )


def formatted(value: Column, data_type: Column, decimals: Column) -> Column:
    """A value for display: numbers grouped by thousands, percentages times 100, others as they are."""
    number, local = F.trim(value).try_cast("decimal(38,10)"), F.lower(local_name(data_type))
    places = F.greatest(F.lit(0), F.coalesce(decimals.try_cast("int"), F.lit(0)))
    grouped = F.call_function("format_number", number, places)
    return F.when(number.isNull(), value).when(F.contains(local, F.lit("percent")), F.concat(F.call_function("format_number", number * 100, places), F.lit("%"))).when(is_numeric_type(data_type), grouped).otherwise(value)


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).otherwise(F.format_string("%.2f s", seconds))


def truthy(value: Column) -> Column:
    """The effective boolean value of a text."""
    return F.coalesce(~F.lower(F.trim(value)).isin("", "false", "0"), F.lit(False))
