"""A corpus pipeline: each stage works on all that its predecessor kept.

All stages but the last return the columns of ``documents``, in order, whatever further columns there
are; none of their names clashes with a stage's own. Empty tables go through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, jaccard, packing, quality, substring
from tidemark.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from the labels of documents at hand.

    A null text is judged as an empty one. Repeated rows and null ids are judged like any row, each
    by its text alone. With labels of one kind, or none, all rows get one score and go or stay together.
    """
    rules = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", Scratch(spark, "quality"))
    scored = quality.score(docs, rules, "__score")
    return scored.where(F.col("__score") >= quality.ACCEPT).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest ``doc_id``.

    Null and empty texts are one text. Of rows with one id and text a single one stays; a text that
    only rows without an id have is kept once. Rows of one id with different texts are different rows.
    """
    found = exact.exact_duplicates(docs)
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    keys = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest_own") == F.col("__digest"))
    named = docs.withColumn("__digest_own", digest).join(stay, keys, "left_semi")
    return named.dropDuplicates(["doc_id", "__digest_own"]).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest ``doc_id``.

    Null, empty and wordless texts are similar to nothing and stay, rows without an id too. All rows
    of an id stay or go together.
    """
    found = jaccard.similar_documents(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; those with nothing repeated stay as they are.

    No row goes, also where nothing of its text is left. Null texts stay null, and rows without an
    id stay whole; ``n_chars`` follows a text that was cut.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring.substring_duplicates(docs, extra=rest or None)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text")) if rest else F.col("kept")
    out = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"rest.`{c}`") for c in rest}
    if "n_chars" in rest:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(changed, length).otherwise(out["n_chars"])
    return cut.select(*(out[c].alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the corpus in sequences for training; a null or empty text has its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Scores, components and token ids have no SQL form here; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
