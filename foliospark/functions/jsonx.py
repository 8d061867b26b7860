"""JSON that models and logs produce: recovery of an object from surrounding text, and type-faithful access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T


def whole(raw: Column) -> Column:
    """VARIANT of a text that is one JSON value; null for anything else. The parser stops after a value, so the text is read as a list of one."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    return T.let(items, lambda own: F.when(F.size(own) == 1, F.get(own, F.lit(0))))


def recover(raw: Column) -> Column:
    """VARIANT of the whole text, else of what lies between its first { and its last }; null if neither is one value."""
    return F.coalesce(whole(raw), whole(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))))


def get(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, VOID (a JSON null), a number's type, ARRAY<...> or OBJECT<...>; null where there is nothing."""
    return F.schema_of_variant(v)


def string(doc: Column, path: str) -> Column:
    """A value that is a string; numbers, lists and the like are null."""
    v = get(doc, path)
    return F.when(kind(v) == "STRING", v.cast("string"))


def number(doc: Column, path: str) -> Column:
    """A value that is a number, or a boolean as 1 or 0, as a double; strings are null."""
    v = get(doc, path)
    return F.when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), v.cast("double")).when(kind(v) == "BOOLEAN", v.cast("boolean").cast("double"))


def items(doc: Column, path: str) -> Column:
    """The elements of an array; an empty array for anything that is none."""
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def strings(doc: Column, path: str) -> Column:
    """The string elements of an array, others dropped; an empty array for anything that is no array."""
    return F.transform(F.filter(items(doc, path), lambda v: kind(v) == "STRING"), lambda v: v.cast("string"))


def trimmed_strings(doc: Column, path: str) -> Column:
    """strings() without white space at their ends, empty ones dropped, each once."""
    return F.array_distinct(F.filter(F.transform(strings(doc, path), T.strip), lambda s: s != ""))


def truthy(doc: Column, path: str) -> Column:
    """False for nothing, null, false, 0, and empty strings, lists and objects."""
    v = get(doc, path)
    return F.coalesce(F.when(number(doc, path).isNotNull(), number(doc, path) != 0).otherwise(~F.to_json(v).isin("null", '""', "[]", "{}")), F.lit(False))


def shown(v: Column) -> Column:
    """A string as it is, anything else as JSON."""
    return F.when(kind(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


def identity(v: Column) -> Column:
    """The text by which values are told apart: true equals "True" and 1 equals "1"; objects and lists go by their JSON."""
    return F.when(kind(v) == "BOOLEAN", F.initcap(F.to_json(v))).when(kind(v) == "VOID", "None").otherwise(shown(v))


def shown_as(identity: Column) -> Column:
    """shown() of a boolean or a null by its identity; of all others shown() is the identity."""
    return F.when(identity == "None", "null").otherwise(F.lower(identity))
