"""JSON documents with their types: VARIANT columns, so that numbers, booleans and nesting are what they were."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"
BAD = "__weir_bad"


def document(text: Column) -> Column:
    """The document of a JSON text; null of what isn't JSON, names a property twice, or is blank."""
    return F.try_parse_json(F.nullif(F.trim(text), F.lit("")))


def properties(doc: Column) -> Column:
    """map<name, variant> of a document's own properties; null of anything but an object."""
    return F.try_variant_get(doc, "$", FIELDS)


def merged(base: Column, over: Column) -> Column:
    """The document that has the properties of both objects, those of over where both have one; what is no object has none.

    Only whole properties are taken: a nested object of over takes the place of base's, and a JSON null is a value like any other."""
    none = F.create_map().cast(FIELDS)
    a, b = (F.coalesce(properties(c), none) for c in (base, over))
    return F.to_variant_object(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def text_at(doc: Column, path: str) -> Column:
    """What a path leads to as text, blank as null: a string itself, anything else as JSON."""
    return F.nullif(F.trim(F.try_variant_get(doc, path, "string")), F.lit(""))


def read_as(text: Column, fields: str) -> Column:
    """A JSON object as a struct of the fields; null of anything else, and where a property is of another type than its field.

    Nothing is converted: a number in quotes is a text.  Properties without a field are left out, fields without a property are null."""
    found = F.from_json(text, f"{fields}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    return F.when(properties(document(text)).isNotNull() & found[BAD].isNull(), found.dropFields(BAD))


def typed(text: Column, fields: str, default: Column) -> Column:
    """read_as(), and the default as a whole where that is null."""
    return F.coalesce(read_as(text, fields), default)
