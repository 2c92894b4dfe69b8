"""Concept assembly: links, sources, projection, rendered files, summary."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import facets, frontmatter, identity
from tidemark.operators.changes import ADDED, MODIFIED, REMOVED
from tidemark.operators.joins import guarded_broadcast, skew_safe_join
from tidemark.schema import empty_strings

# Summary sections in the order they are rendered.
SECTIONS = ["Added", "Modified", "Removed", "Conflicts", "Gaps", "Notes"]

_SOURCE = "struct<id:string,resource:string,content_hash:string>"


def resolved_links(items: DataFrame, known: DataFrame, rows: int | None = None) -> DataFrame:
    """(doc_id, links), the known relation paths of each item, sorted, repeats kept.

    A page that everything links to is a hot key, hence the salted join. The list is no
    longer than the item's own relations array.
    """
    links = items.select("doc_id", F.explode("relations").alias("target")).select(
        "doc_id", "target", identity.concept_path(F.col("target")).alias("path")
    )
    targets = known.select("path").distinct()
    kept = skew_safe_join(links, targets, "path", "left_semi", ["doc_id", "target"], rows=rows)
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("path")).alias("links"))


def link_targets(items: DataFrame) -> DataFrame:
    """One path per relation of an item, repeats kept."""
    return items.select(F.explode("relations").alias("target")).select(
        identity.concept_path(F.col("target")).alias("path")
    )


def cited_sources(kept: DataFrame) -> DataFrame:
    """(doc_id, cited): grounding sources in rank order, at most the cap per owner."""
    return (
        kept.groupBy(F.col("owner_id").alias("doc_id"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank",
                        identity.doc_id(F.col("anchor.system"), F.col("anchor.native_id")).alias("id"),
                        "resource",
                        F.col("anchor.content_hash").alias("content_hash"),
                    )
                )
            ).alias("ranked")
        )
        .select(
            "doc_id",
            F.transform(
                "ranked",
                lambda s: F.struct(
                    s["id"].alias("id"), s["resource"].alias("resource"),
                    s["content_hash"].alias("content_hash"),
                ),
            ).alias("cited"),
        )
    )


def dropped_links(items: DataFrame, known: DataFrame, rows: int | None = None) -> DataFrame:
    """J7 seen from the other side: (doc_id, dropped), the relation paths nobody has.

    Few links dangle, so this is the small half: assembly joins it and the text of the
    items stays where it is.
    """
    links = items.select("doc_id", F.explode("relations").alias("target")).select(
        "doc_id", "target", identity.concept_path(F.col("target")).alias("path")
    )
    targets = known.select("path").distinct()
    lost = skew_safe_join(links, targets, "path", "left_anti", ["doc_id", "target"], rows=rows)
    return lost.groupBy("doc_id").agg(F.collect_set("path").alias("dropped"))


def assemble(
    items: DataFrame,
    prose: DataFrame | None,
    known: DataFrame,
    generated_by: str,
    kept: DataFrame | None = None,
    link_rows: int | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per produced concept, holding both the projection and the file.

    Structure comes from the document alone. `prose` gives title, description and body,
    and an item without prose is dropped; without a prose table the document speaks for
    itself and its text is not joined to anything. The owner's source leads, grounding
    follows. `settle` lets the small sides be counted and, where few, broadcast.
    """

    def small(df: DataFrame) -> DataFrame:
        if settle is None:
            return df
        written = settle(df)
        return guarded_broadcast(written, written.count())

    paths = items.select(identity.concept_path(F.col("doc_id")).alias("path"))
    lost = small(dropped_links(items, known.select("path").unionByName(paths), link_rows))
    own = F.struct(
        identity.doc_id(F.col("system"), F.col("native_id")).alias("id"),
        identity.resource_key(F.col("url"), F.col("system"), F.col("native_id")).alias("resource"),
        F.col("content_hash"),
    )
    if prose is None:
        spoken = items.withColumns(
            {"p_title": F.col("title"), "p_description": F.col("title"), "p_body": F.col("text")}
        )
    else:
        # the item's own text is not needed once prose exists
        spoken = items.drop("text", "title").join(
            prose.select(
                "doc_id",
                F.col("title").alias("p_title"),
                F.col("description").alias("p_description"),
                F.col("body").alias("p_body"),
            ),
            "doc_id",
        )
    joined = spoken.join(lost, "doc_id", "left")
    cited = F.array().cast(f"array<{_SOURCE}>")
    if kept is not None:
        joined = joined.join(small(cited_sources(kept)), "doc_id", "left")
        cited = F.coalesce(F.col("cited"), cited)
    gone = F.coalesce("dropped", empty_strings())
    links = F.array_sort(
        F.filter(
            F.transform("relations", identity.concept_path), lambda p: ~F.array_contains(gone, p)
        )
    )
    framed = joined.select(
        identity.concept_path(F.col("doc_id")).alias("path"),
        "doc_id",
        facets.concept_type(F.col("structured")).alias("type"),
        facets.facets(F.col("structured"), F.col("opaque_keys")).alias("facets"),
        F.concat(F.array(own), cited).alias("sources"),
        links.alias("links"),
        F.col("retrieved_at").alias("generated_at"),
        F.lit(generated_by).alias("generated_by"),
        "p_title", "p_description", "p_body",
    )
    shown = ["path", "doc_id", "type", "facets", "sources", "links", "generated_at", "generated_by"]
    headed = framed.withColumn(
        "front",
        frontmatter.head(
            type_=F.col("type"),
            title=F.col("p_title"),
            description=F.col("p_description"),
            generated_by=F.col("generated_by"),
            generated_at=F.col("generated_at"),
            facets=F.col("facets"),
            sources=F.col("sources"),
            links=F.col("links"),
        ),
    )
    content = frontmatter.rendered(F.col("front"), F.col("p_title"), F.col("p_body"))
    return headed.select(*shown, content.alias("content"))


def files_of(assembled: DataFrame) -> DataFrame:
    return assembled.select("path", "content")


def projection_of(assembled: DataFrame) -> DataFrame:
    return assembled.drop("content")


def claims(changes: DataFrame) -> DataFrame:
    """A5: summary rows (section, item), one path per changed document."""
    section = (
        F.when(F.col("kind") == ADDED, "Added")
        .when(F.col("kind") == MODIFIED, "Modified")
        .when(F.col("kind") == REMOVED, "Removed")
    )
    return changes.where(F.col("kind").isin(ADDED, MODIFIED, REMOVED)).select(
        section.alias("section"), identity.concept_path(F.col("doc_id")).alias("item")
    )


def sources_changed(items: DataFrame) -> DataFrame:
    """A5: the anchor of every rendered item."""
    return items.select("doc_id", "system", "native_id", "url", "retrieved_at", "content_hash")


def summary(changes: DataFrame, notes: list[DataFrame], conflicts: DataFrame | None = None,
            gaps: DataFrame | None = None) -> DataFrame:
    """The change summary as a long table (section, item), however many items there are."""
    parts = [claims(changes)]
    parts += [n.select(F.lit("Notes").alias("section"), F.col("note").alias("item")) for n in notes]
    for section, df in (("Conflicts", conflicts), ("Gaps", gaps)):
        if df is not None:
            parts.append(df.select(F.lit(section).alias("section"), F.col("item")))
    return reduce(DataFrame.unionByName, parts)
