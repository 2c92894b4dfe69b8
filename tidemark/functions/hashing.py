"""Content hash (P10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefixed(c: Column) -> Column:
    """Length-prefix a field, so that two fields can never run into each other."""
    return F.concat(F.length(c).cast("string"), F.lit(":"), c)


def content_hash(
    doc_id: Column,
    title: Column,
    text: Column,
    structured: Column,
    relations: Column,
    deleted: Column,
) -> Column:
    """SHA-256 over what the diff must react to.

    The anchor is left out because its stamp is volatile, `grounded_by` because drift
    detection covers it. Relations are sorted first, so their order is no change.
    """
    ordered = F.array_sort(F.coalesce(relations, F.array().cast("array<string>")))
    return F.sha2(
        F.concat(
            _prefixed(doc_id),
            _prefixed(F.coalesce(title, F.lit(""))),
            _prefixed(F.coalesce(text, F.lit(""))),
            _prefixed(F.coalesce(structured, F.lit("{}"))),
            F.size(ordered).cast("string"),
            F.lit("|"),
            F.array_join(F.transform(ordered, _prefixed), ""),
            F.when(F.coalesce(deleted, F.lit(False)), "1").otherwise("0"),
        ),
        256,
    )


def config_digest(config_json: Column) -> Column:
    """The first 8 hex digits that tell two configurations of a source apart."""
    return F.left(F.sha2(config_json, 256), F.lit(8))
