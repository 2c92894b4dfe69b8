"""Facet projection and the filterability test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Front-matter keys that the renderer owns.
OWNED_KEYS = ["type", "title", "description", "generated", "sources", "links"]

EMPTY_JSON = ["null", '""', "[]", "{}"]

_SCALAR = r"^(STRING|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def as_map(structured: Column) -> Column:
    """MAP<STRING, VARIANT> of a JSON object; empty when there is none."""
    parsed = F.from_json(structured, "map<string,variant>")
    return F.coalesce(parsed, F.expr("cast(map() as map<string,variant>)"))


def canonical_json(raw: Column) -> Column:
    """Keys sorted at every depth; NULL when the text is not valid JSON."""
    return F.to_json(F.try_parse_json(raw))


def _is_scalar(v: Column) -> Column:
    return F.schema_of_variant(v).rlike(_SCALAR)


def is_filterable(v: Column) -> Column:
    """A scalar, or a list of scalars. A list holding a null is neither."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return _is_scalar(v) | F.coalesce(
        F.forall(items, lambda e: e.isNotNull() & F.coalesce(_is_scalar(e), F.lit(False))),
        F.lit(False),
    )


def is_empty(v: Column) -> Column:
    return v.isNull() | F.to_json(v).isin(*EMPTY_JSON)


def facets(structured: Column, opaque_keys: Column | None = None) -> Column:
    """MAP<STRING, STRING> from key to JSON text of each filterable field."""

    def keep(k: Column, v: Column) -> Column:
        ok = ~k.isin(*OWNED_KEYS) & ~is_empty(v) & is_filterable(v)
        if opaque_keys is None:
            return ok
        return ok & ~F.coalesce(F.array_contains(opaque_keys, k), F.lit(False))

    return F.transform_values(F.map_filter(as_map(structured), keep), lambda _, v: F.to_json(v))


def source_fields(structured: Column) -> Column:
    """MAP<STRING, STRING> from key to JSON text of every field, whatever its kind."""
    return F.transform_values(as_map(structured), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def concept_type(structured: Column) -> Column:
    """The source's own `type` where it says anything, else `concept`."""
    v = F.element_at(as_map(structured), "type")
    said = ~is_empty(v) & ~F.to_json(v).isin("0", "false", "0.0")
    spelled = F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(
        v.cast("string")
    )
    return F.when(F.coalesce(said, F.lit(False)), spelled).otherwise("concept")


def json_string(s: Column) -> Column:
    """One string as JSON text."""
    quoted = F.to_json(F.array(s))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def facet_equals(facets_map: Column, key: str, value: str) -> Column:
    """A facet holds a value, either as the scalar or as a member of its list."""
    v = F.try_parse_json(F.element_at(facets_map, key))
    listed = F.array_contains(F.try_variant_get(v, "$", "array<string>"), value)
    scalar = F.try_variant_get(v, "$", "string") == value
    return F.coalesce(listed, F.lit(False)) | F.coalesce(scalar, F.lit(False))
