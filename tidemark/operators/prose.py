"""Batch prose generation with an injected callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import __version__
from tidemark.functions import facets, identity, text
from tidemark.operators.joins import skew_safe_join

PRODUCER = "tidemark"

GROUNDING_LEAD = "\n\nFurther reading, kept elsewhere. It supports the document above and is not its topic.\n\n"

PROSE = "doc_id string, title string, description string, body string"


@dataclass(frozen=True)
class Verbatim:
    """The default generator: title and text as they are, and no grounding."""

    grounds: bool = False
    actor: str = f"{PRODUCER}/{__version__}"


@dataclass(frozen=True)
class Generator:
    """A callable over batches: (doc_id, prompt) in, (doc_id, title, description, body) out.

    It may return fewer rows than it was given; the others are dropped from the run. It
    sees prompts only, so paths, links, sources and deletions are never its choice.
    `grounds` says whether it reads related documents.
    """

    write: Callable[[pd.DataFrame], pd.DataFrame]
    model: str
    grounds: bool = True
    max_source_chars: int | None = None
    parallelism: int | None = None

    @property
    def actor(self) -> str:
        return f"{PRODUCER}/{self.model.rsplit('/', 1)[-1]}"


def grounding_blocks(kept: DataFrame, texts: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc_id, block, notes) per owner; a budget, if any, shared evenly by its documents.

    With a budget, texts are cut to the share before they are brought together, so an owner's
    block is bounded by it however long the cited documents are.
    """
    whole = (1 << 31) - 1
    sizes = kept.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_docs"))
    share = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("n_docs"))).cast("int") if budget else F.lit(whole)
    sized = kept.select("owner_id", "grounding_id", "rank").join(sizes, "owner_id").withColumn(
        "share", share
    )
    bodies = texts.select(F.col("doc_id").alias("grounding_id"), F.col("text").alias("body"))
    joined = skew_safe_join(sized, bodies, "grounding_id", "inner", ["owner_id"])
    cut = joined.select(
        "owner_id", "rank", "share", "n_docs", "grounding_id",
        text.truncated(F.col("body"), F.col("share")).alias("body"),
        (F.length("body") > F.col("share")).alias("was_cut"),
    )
    note = F.concat(
        identity.concept_path(F.col("owner_id")), F.lit(": grounding "), F.col("grounding_id"),
        F.lit(" cut to "), F.col("share").cast("string"),
        F.lit(f" characters, its part of {budget} for "), F.col("n_docs").cast("string"), F.lit(" documents"),
    )
    parts = F.array_sort(
        F.collect_list(
            F.struct(
                "rank",
                F.concat(F.lit("--- "), "grounding_id", F.lit(" ---\n"), "body").alias("part"),
                F.when(F.col("was_cut"), note).alias("note"),
            )
        )
    )
    return cut.groupBy(F.col("owner_id").alias("doc_id")).agg(parts.alias("parts")).select(
        "doc_id",
        F.concat(
            F.lit(GROUNDING_LEAD),
            F.array_join(F.col("parts.part"), "\n\n"),
        ).alias("block"),
        F.array_compact(F.col("parts.note")).alias("notes"),
    )


def prompts(items: DataFrame, blocks: DataFrame | None, limit: int | None = None) -> DataFrame:
    """(doc_id, prompt, notes) for a generator; texts are whole without a `limit`.

    A prompt shows every field of the source, nested and empty ones too, and not only facets.
    """
    cut = text.truncated(F.col("text"), limit) if limit else F.col("text")
    note = F.when(
        F.length("text") > (limit or (1 << 31) - 1),
        F.concat(
            identity.concept_path(F.col("doc_id")),
            F.lit(f": text cut to {limit} characters for the prompt"),
        ),
    )
    base = items.select(
        "doc_id",
        text.prompt(
            F.col("native_id"), F.col("title"), facets.source_fields(F.col("structured")), cut,
        ).alias("prompt"),
        F.array_compact(F.array(note)).alias("notes"),
    )
    if blocks is None:
        return base
    more = blocks.select("doc_id", "block", F.col("notes").alias("more"))
    empty = F.array().cast("array<string>")
    return base.join(more, "doc_id", "left").select(
        "doc_id",
        F.concat("prompt", F.coalesce("block", F.lit(""))).alias("prompt"),
        F.concat("notes", F.coalesce("more", empty)).alias("notes"),
    )


def generate(prompted: DataFrame, generator: Generator) -> DataFrame:
    """C4: run the callable over batches. Write the result before anything reads it twice."""
    write = generator.write

    def batches(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            yield write(chunk)[["doc_id", "title", "description", "body"]]

    source = prompted.select("doc_id", "prompt")
    if generator.parallelism:
        source = source.repartition(generator.parallelism, "doc_id")
    return source.mapInPandas(batches, PROSE)


def prose_rejects(prose: DataFrame) -> DataFrame:
    """E5: rows whose title, description or body is empty."""
    bad = [
        F.col(c).isNull() | (text.strip(F.col(c)) == "") for c in ("title", "description", "body")
    ]
    reason = (
        F.when(bad[0], "title must be non-empty")
        .when(bad[1], "description must be non-empty")
        .when(bad[2], "body must be non-empty")
    )
    return prose.select("doc_id", reason.alias("reject_reason")).where(
        F.col("reject_reason").isNotNull()
    )


def finished(prose: DataFrame) -> DataFrame:
    """The body without a heading that repeats the title."""
    return prose.withColumn("body", text.without_echoed_heading(F.col("body"), F.col("title")))
