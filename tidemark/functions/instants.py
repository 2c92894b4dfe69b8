"""Aware-instant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

_AWARE = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?"
    r"(Z|[+-]\d{2}(:?\d{2})?)\z"
)


def aware_instant(c: Column) -> Column:
    """ISO-8601 with an offset to TIMESTAMP; NULL for a naive or malformed stamp."""
    text = F.replace(strip(c), F.lit(","), F.lit("."))
    # the cast reads seconds and a spelled-out offset only
    whole = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-].*)\z", "$1:00$2")
    whole = F.regexp_replace(whole, r"([+-]\d{2})(\d{2})\z", "$1:$2")
    whole = F.regexp_replace(whole, r"(:\d{2}:[.\d]+[+-]\d{2})\z", "$1:00")
    return F.when(text.rlike(_AWARE), F.try_to_timestamp(whole))


def iso(c: Column) -> Column:
    """A timestamp as an offset-carrying ISO-8601 stamp."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
