"""Identity rules: qualified ids, paths and the id-resolution job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# Document formats whose extension is not part of an identity.
DOCUMENT_EXTENSIONS = [
    "md", "markdown", "mdx", "txt", "rst", "adoc", "asciidoc", "htm", "html", "xhtml",
]

# Printable characters that are escaped in a path segment. `%` leads,
# so that escapes written for the others are not escaped again.
UNSAFE_CHARACTERS = ["%", "@", "/", "<", ">", ":", '"', "|", "?", "*", "\\"]

_CONTROLS = [chr(i) for i in range(0x20)] + ["\x7f"]

# scheme, authority, path, query, fragment
_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def doc_id(system: Column, native_id: Column) -> Column:
    return F.concat(system, F.lit(":"), native_id)


def system_of(qualified: Column) -> Column:
    """The part before the first colon."""
    return F.substring_index(qualified, ":", 1)


def native_of(qualified: Column) -> Column:
    """The part after the first colon; empty when there is none."""
    at = F.instr(qualified, ":")
    return F.when(at > 0, F.substr(qualified, at + 1)).otherwise("")


def is_qualified(c: Column) -> Column:
    """Both halves of `system:native_id` are present."""
    at = F.instr(c, ":")
    return F.coalesce((at > 1) & (at < F.length(c)), F.lit(False))


def qualified_relations(system: Column, targets: Column) -> Column:
    """P5: prefix the own system, drop NULLs, sort; duplicates stay."""
    kept = F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda t: t.isNotNull())
    return F.array_sort(F.transform(kept, lambda t: F.concat(system, F.lit(":"), t)))


def grounding_refs(targets: Column) -> Column:
    """Only fully qualified ids, sorted, never prefixed."""
    return F.array_sort(
        F.filter(F.coalesce(targets, F.array().cast("array<string>")), is_qualified)
    )


def resource_key(url: Column, system: Column, native_id: Column) -> Column:
    """The identity that source entries are compared by."""
    return F.coalesce(F.nullif(url, F.lit("")), doc_id(system, native_id))


def concept_path(qualified: Column) -> Column:
    """Bundle path of a document; the system is not part of it."""
    stem = F.regexp_replace(native_of(qualified), r"\.md\z", "")
    return F.concat(F.lit("concepts/"), F.btrim(stem, F.lit("/")), F.lit("/overview.md"))


def path_problem(path: Column) -> Column:
    """Why a path must not be written or removed; NULL when it is safe."""
    return (
        F.when(path.isNull() | (path == ""), "empty file path")
        .when(path.startswith("/"), "absolute path not allowed")
        .when(F.array_contains(F.split(path, "/"), ".."), "'..' not allowed in path")
    )


def joined_path(base: str, path: Column) -> Column:
    """Prefix and normalise a path that `path_problem` found safe."""
    whole = F.concat(F.lit(base.rstrip("/") + "/"), path) if base else path
    kept = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    return F.when(F.size(kept) > 0, F.array_join(kept, "/")).otherwise(".")


def _url_text(raw: Column) -> Column:
    return F.translate(raw, "\t\r\n", "")


def is_url(raw: Column) -> Column:
    """An id is a URL only when it has both a scheme and an authority."""
    return F.coalesce(_url_text(strip(raw)).rlike(_URL), F.lit(False))


def _hex(character: str) -> str:
    return f"%{ord(character):02X}"


def escaped(segment: Column) -> Column:
    """Percent-escape one segment, including a trailing dot or space."""
    out = segment
    for ch in UNSAFE_CHARACTERS:
        out = F.replace(out, F.lit(ch), F.lit(_hex(ch)))
    with_controls = out
    for ch in _CONTROLS:
        with_controls = F.replace(with_controls, F.lit(ch), F.lit(_hex(ch)))
    out = F.when(segment.rlike(r"[\x00-\x1f\x7f]"), with_controls).otherwise(out)
    return F.regexp_replace(F.regexp_replace(out, r"\.\z", "%2E"), r" \z", "%20")


def with_identity(df: DataFrame, raw: str = "raw_id") -> DataFrame:
    """Adds native_id, reject_reason and is_url; one of the first two is NULL.

    A URL keeps everything but its scheme; its host is lower-cased and marked with
    `@`, so that it never meets a plain path. Query and fragment travel, escaped, on
    the last segment. Distinct ids stay distinct through the final bundle path.

    Written as successive projections, so that no step repeats the one before it.
    """
    none = F.array().cast("array<string>")

    def part(i: int) -> Column:
        return F.regexp_extract("__url", _URL, i)

    keep = df.columns
    split = (
        df.withColumns({"__text": strip(F.col(raw)), "is_url": is_url(F.col(raw))})
        .withColumn("__url", F.when(F.col("is_url"), _url_text(F.col("__text"))).otherwise(""))
        .select(
            *keep, "is_url", "__text",
            part(2).alias("__authority"),
            F.when(F.col("is_url"), part(3)).otherwise(F.col("__text")).alias("__path"),
            F.concat(
                F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise(""),
                F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""),
            ).alias("__tail"),
            F.substring_index(part(2), "@", -1).alias("__host"),
        )
    )
    segments = F.filter(F.split("__path", "/"), lambda s: ~s.isin("", "."))
    userinfo = F.left("__authority", F.length("__authority") - F.length("__host"))
    cut = split.select(
        *keep, "is_url", "__text", "__tail",
        F.concat(F.lit("@"), escaped(F.concat(userinfo, F.lower("__host")))).alias("__head"),
        segments.alias("__segments"),
    )
    stem = F.regexp_replace(
        F.get("__segments", F.size("__segments") - 1),
        rf"(?is)\.({'|'.join(DOCUMENT_EXTENSIONS)})\z", "",
    )
    stemmed = cut.withColumn("__stem", F.when(F.size("__segments") > 0, stem))
    last = (
        F.when(F.col("__stem").isNotNull(), F.array(F.concat("__stem", "__tail")))
        .when(F.col("__tail") != "", F.array("__tail"))
        .otherwise(none)
    )
    leading = F.slice("__segments", 1, F.greatest(F.size("__segments") - 1, F.lit(0)))
    pieced = stemmed.withColumn(
        "__pieces",
        F.concat(
            F.when(F.col("is_url"), F.array("__head")).otherwise(none),
            F.transform(F.concat(leading, last), escaped),
        ),
    ).withColumn("__slug", F.array_join("__pieces", "/"))
    climbs = F.exists("__segments", lambda s: s.rlike(r"(?i)^(\.|%2e){2}\z"))
    judged = pieced.withColumn(
        "reject_reason",
        F.when(F.col(raw).isNull() | (F.col("__text") == ""), "document id is empty")
        .when(climbs, "document id escapes the bundle")
        .when(F.col("__stem") == "", "document id has no content beyond its extension")
        .when(F.size("__pieces") == 0, "document id has no path content"),
    )
    # a slug that ends in .md would lose it once more in the bundle path
    settled = F.regexp_replace("__slug", r"\.md\z", "%2Emd")
    return judged.select(
        *keep,
        F.when(F.col("reject_reason").isNull(), settled).alias("native_id"),
        "reject_reason",
        "is_url",
    )
