"""Front-matter split, parse and render."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.functions.facets import json_string
from tidemark.functions.instants import iso

_FENCE = "---"
_CLOSING = "\n---"

# Characters that a YAML reader refuses or folds, though JSON allows them
# raw: C1 controls, the Unicode line separators, the byte-order mark, non-characters.
_YAML_UNSAFE = "[\\x7f-\\x9f\\u2028\\u2029\\ufeff\\ufffe\\uffff]"


def split_front_matter(text: Column) -> Column:
    """STRUCT<head, body>; `head` is NULL when there is no closed fence."""
    # found by position: a pattern would walk whole texts for a few lines at their start
    at = F.locate(_CLOSING, text, len(_FENCE) + 1)
    fenced = text.startswith(_FENCE) & (at > 0)
    rest = F.substring(text, at + len(_CLOSING), F.length(text))
    return F.struct(
        F.when(fenced, F.substring(text, F.lit(len(_FENCE) + 1), at - len(_FENCE) - 1)).alias("head"),
        F.when(fenced, F.ltrim(rest, F.lit("\n"))).otherwise(text).alias("body"),
    )


def _plain(value: object) -> object:
    """A YAML value as something JSON can carry."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if value is None or isinstance(value, (str, int, float)):
        return value
    return str(value)


def _dated(value: object) -> bool:
    if isinstance(value, list):
        return any(_dated(v) for v in value)
    return isinstance(value, (dt.date, bytes))


# a string without escapes or characters that YAML folds or refuses, or a plain number
_TEXT = r'"[^"\\\x00-\x1f\x7f-\x9f\u2028\u2029\ufeff\ud800-\udfff\ufffe\uffff]*"'
_VALUE = rf"(?:{_TEXT}|0|[1-9][0-9]{{0,17}})"
_KEY = rf"(type|title|description|generated|by|at|sources|id|resource|content_hash|links|{_TEXT[:-2]}{{1,200}}\")"
_LINE = re.compile(rf"(- |  )?(?:{_KEY}:(?: ({_VALUE}|\[\]))?|({_VALUE}))")


def rendered_head(head: str) -> dict | None:
    """A head as `head` writes it: what YAML gives for it, or None where YAML has to be asked."""

    def value(token: str) -> str | int:
        return token[1:-1] if token[0] == '"' else int(token)

    out: dict = {}
    open_ = None
    for line in head.strip("\n").split("\n"):
        found = _LINE.fullmatch(line)
        if not found:
            return None
        lead, key, given, item = found.groups()
        if key and key[0] == '"':
            key = key[1:-1]
        if not lead:
            if key is None:
                return None
            open_ = key if given is None else None
            out[key] = None if given is None else [] if given == "[]" else value(given)
            continue
        if open_ is None or (key is not None and given in (None, "[]")):
            return None
        block = out[open_]
        if lead == "- ":
            if block is None:
                block = out[open_] = []
            if not isinstance(block, list):
                return None
            block.append(value(item) if key is None else {key: value(given)})
            continue
        if block is None:
            block = out[open_] = {}
        entry = block[-1] if isinstance(block, list) else block
        if key is None or not isinstance(entry, dict):
            return None
        entry[key] = value(given)
    return out


_PARSED = T.StructType(
    [
        T.StructField("front", T.StringType()),
        T.StructField("opaque", T.ArrayType(T.StringType())),
    ]
)


@pandas_udf(_PARSED)
def parse_head(heads: pd.Series) -> pd.DataFrame:
    """YAML head to canonical JSON, plus the keys whose value was a date.

    Malformed YAML and a head that is not a mapping both give an empty object. This is
    the one Python function on the ingest path, and it only sees the head. A head in the form
    that this package renders is read line by line, every other one by the YAML parser.
    """
    try:
        import yaml
    except ImportError as exc:
        raise ImportError("front matter needs the PyYAML package") from exc

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def load(head: str | None) -> dict:
        if not isinstance(head, str):
            return {}
        try:
            data = yaml.load(head, Loader=loader)
        except (yaml.YAMLError, ValueError):
            return {}
        return data if isinstance(data, dict) else {}

    # parsed one by one: the objects of a whole batch take many times the memory of its text
    front, opaque = [], []
    for head in heads:
        known = rendered_head(head) if isinstance(head, str) else None
        if known is not None:
            front.append(json.dumps(known, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
            opaque.append([])
            continue
        p = load(head)
        front.append(json.dumps(_plain(p), sort_keys=True, ensure_ascii=False, separators=(",", ":")))
        opaque.append(sorted(str(k) for k, v in p.items() if _dated(v)))
    return pd.DataFrame({"front": front, "opaque": opaque})


def without_keys(front: Column, keys: Iterable[str]) -> Column:
    """A JSON object without some keys, as JSON text with keys sorted."""
    names = list(keys)
    kept = F.map_filter(
        F.from_json(front, "map<string,variant>"), lambda k, _: ~k.isin(*names)
    )
    entries = F.array_sort(
        F.transform(
            F.map_entries(F.transform_values(kept, lambda _, v: F.to_json(v))),
            lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")),
        )
    )
    return F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","
        ),
        F.lit("}"),
    )


def yaml_safe(quoted: Column) -> Column:
    """Quoted JSON strings with the characters a YAML reader would not keep escaped."""
    escaped = F.array_join(
        F.transform(
            F.split(quoted, ""),
            lambda c: F.when(
                c.rlike(_YAML_UNSAFE),
                F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")),
            ).otherwise(c),
        ),
        "",
    )
    return F.when(quoted.rlike(_YAML_UNSAFE), escaped).otherwise(quoted)


def yaml_quoted(s: Column) -> Column:
    """A string as a double-quoted scalar that both JSON and YAML read alike."""
    return yaml_safe(json_string(F.coalesce(s, F.lit(""))))


def head(
    *,
    type_: Column,
    title: Column,
    description: Column,
    generated_by: Column,
    generated_at: Column,
    facets: Column,
    sources: Column,
    links: Column,
) -> Column:
    """The lines between the fences, in fixed key order."""

    def q(c: Column) -> Column:
        return json_string(F.coalesce(c, F.lit("")))

    def lines(items: Column, one: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(items, one), "")

    newline = F.lit("\n")
    facet_lines = lines(
        F.array_sort(
            F.transform(
                F.map_entries(facets),
                lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")),
            )
        ),
        lambda e: F.concat(q(e["k"]), F.lit(": "), e["v"], newline),
    )
    source_lines = lines(
        sources,
        lambda s: F.concat(
            F.lit("- id: "), q(s["id"]),
            F.lit("\n  resource: "), q(s["resource"]),
            F.lit("\n  content_hash: "), q(s["content_hash"]),
            newline,
        ),
    )
    link_lines = lines(links, lambda v: F.concat(F.lit("- "), q(v), newline))
    return F.concat(
        F.lit("type: "), q(type_),
        F.lit("\ntitle: "), q(title),
        F.lit("\ndescription: "), q(description),
        F.lit("\ngenerated:\n  by: "), q(generated_by),
        newline,
        F.when(generated_at.isNotNull(), F.concat(F.lit("  at: "), q(iso(generated_at)), newline)).otherwise(""),
        facet_lines,
        F.when(F.size(sources) > 0, F.concat(F.lit("sources:\n"), source_lines)).otherwise("sources: []\n"),
        F.when(F.size(links) > 0, F.concat(F.lit("links:\n"), link_lines)).otherwise(""),
    )


def rendered(front: Column, title: Column, body: Column) -> Column:
    """Fenced front matter, the title heading, then the body."""
    return F.concat(
        F.lit("---\n"), yaml_safe(front), F.lit("---\n\n# "), title, F.lit("\n\n"), body, F.lit("\n")
    )
