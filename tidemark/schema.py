"""Column layout of the tables that jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

# `structured` is canonical JSON text (keys sorted at every depth). VARIANT cannot be
# compared or grouped, so it is parsed to VARIANT only where a field is read.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("native_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("retrieved_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("structured", T.StringType()),
        # keys of `structured` whose source value was a date: hashed, never a facet
        T.StructField("opaque_keys", STRINGS),
        T.StructField("relations", STRINGS),
        T.StructField("grounded_by", STRINGS),
        T.StructField("deleted", T.BooleanType()),
    ]
)

DOCUMENT_COLUMNS = DOCUMENTS.fieldNames()

LINEAGE = T.StructType(
    [
        T.StructField("owner_id", T.StringType()),
        # an empty map is a recorded state; a missing row is another one
        T.StructField("recorded", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Lineage as stored: NULL `recorded` is an owner that was looked at and never rebuilt with grounding.
TRACKED = T.StructType([*LINEAGE.fields, T.StructField("declared", STRINGS)])

CITED = T.StructType(
    [T.StructField("grounding_id", T.StringType()), T.StructField("owner_id", T.StringType())]
)

SUSPECTS = T.StructType([T.StructField("doc_id", T.StringType())])

CURSORS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        # NULL marks a row written before cursors were kept per configuration
        T.StructField("instance_key", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("systems", STRINGS),
        T.StructField("run_id", T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("added", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("removed", T.LongType()),
        T.StructField("unchanged", T.LongType()),
        T.StructField("failures", T.LongType()),
        T.StructField("stage_ms", T.MapType(T.StringType(), T.LongType())),
    ]
)

SUBJECT_MAP = T.StructType(
    [
        T.StructField("owner_id", T.StringType()),
        T.StructField("grounding_id", T.StringType()),
    ]
)

FAILURE_COLUMNS = ["path", "law", "message"]


def failure(path: Column | str, law: str, message: Column | str) -> list[Column]:
    """The three columns of a `failures` row."""
    return [
        (F.col(path) if isinstance(path, str) else path).alias("path"),
        F.lit(law).alias("law"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    ]


def empty_strings() -> Column:
    return F.array().cast("array<string>")
