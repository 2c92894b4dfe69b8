"""Fetch laws, keyed diff, overlay and mirror advance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import facets, identity
from tidemark.functions.hashing import content_hash
from tidemark.functions.text import is_blank
from tidemark.operators.joins import BROADCAST_ROWS, guarded_broadcast
from tidemark.schema import DOCUMENT_COLUMNS, DOCUMENTS, failure


def canonical_documents(df: DataFrame) -> DataFrame:
    """Complete a normalised source to the document layout; ids and hashes are ours.

    A source supplies system, native_id and content; the id and the hash are always
    computed here, so a source cannot forge either.
    """
    have = set(df.columns)

    def col(name: str) -> Column:
        field = DOCUMENTS[name]
        value = F.col(name) if name in have else F.lit(None)
        return value.cast(field.dataType)

    strings = F.array().cast("array<string>")
    base = df.select(
        *[c for c in df.columns if c not in DOCUMENT_COLUMNS],
        identity.doc_id(F.col("system"), F.col("native_id")).alias("doc_id"),
        F.col("system"),
        F.col("native_id"),
        col("url").alias("url"),
        col("retrieved_at").alias("retrieved_at"),
        F.coalesce(col("title"), F.lit("")).alias("title"),
        F.coalesce(col("text"), F.lit("")).alias("text"),
        # keys sorted at every depth: their order is no change; text that is no JSON stays as it is
        F.coalesce(facets.canonical_json(col("structured")), col("structured"), F.lit("{}")).alias("structured"),
        F.coalesce(col("opaque_keys"), strings).alias("opaque_keys"),
        F.coalesce(col("relations"), strings).alias("relations"),
        F.coalesce(col("grounded_by"), strings).alias("grounded_by"),
        F.coalesce(col("deleted"), F.lit(False)).alias("deleted"),
    )
    hashed = base.withColumn(
        "content_hash",
        content_hash(
            F.col("doc_id"), F.col("title"), F.col("text"), F.col("structured"),
            F.col("relations"), F.col("deleted"),
        ),
    )
    return hashed.select(*DOCUMENT_COLUMNS)


# ---------------------------------------------------------------- fetch laws


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """A2: ids that a fetch carries more than once."""
    return (
        docs.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def fetch_contract_failures(docs: DataFrame, complete: bool) -> DataFrame:
    """L1: duplicate id, invisible native id, or a tombstone from a partial fetch."""
    found = [
        duplicate_ids(docs).select(
            "doc_id",
            *failure(
                "doc_id", "fetch-contract",
                F.concat(F.lit("more than one record claims this id: "), F.col("doc_id")),
            )[1:],
        ),
        docs.where(is_blank(F.col("native_id"))).select(
            "doc_id",
            *failure(
                "doc_id", "fetch-contract",
                F.concat(F.lit("record without a visible source id: "), F.coalesce("doc_id", F.lit(""))),
            )[1:],
        ),
    ]
    if not complete:
        found.append(
            docs.where("deleted").select(
                "doc_id",
                *failure(
                    "doc_id", "fetch-contract",
                    F.concat(
                        F.lit("deletion reported by a partial fetch: "), F.col("doc_id")
                    ),
                )[1:],
            )
        )
    return reduce(DataFrame.unionByName, found).withColumnRenamed("doc_id", "path")


#: Parts that two evaluations are compared in before any document is.
STABILITY_BUCKETS = 256


def _print_of(df: DataFrame) -> DataFrame:
    """What two evaluations must agree on; the hash leaves `grounded_by` out."""
    return df.select(
        "doc_id", "content_hash", F.array_join(F.array_sort("grounded_by"), "\n").alias("grounding")
    )


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(STABILITY_BUCKETS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(bucket, n, low, high): a 128-bit multiset fingerprint of each bucket of documents.

    Sums of two hashes don't depend on order or partitioning, so tasks add up their own rows and
    at most `STABILITY_BUCKETS` rows a task are shuffled.
    """

    def total(*seed: Column) -> Column:
        return F.sum(F.xxhash64("doc_id", "content_hash", "grounding", *seed).cast("decimal(20,0)"))

    rows = _print_of(docs).withColumn("bucket", _bucket())
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), total().alias("low"), total(F.lit("high")).alias("high")
    )


def unstable_buckets(first: DataFrame, second: DataFrame) -> DataFrame:
    """A10/L2: buckets whose fingerprints differ between two evaluations of one normaliser.

    Both must be built from separate reads: a cached or shared input would compare one
    result with itself.
    """
    a, b = (fingerprints(df).select("bucket", F.struct("n", "low", "high").alias(name)) for df, name in ((first, "a"), (second, "b")))
    return a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def stability_failures(first: DataFrame, second: DataFrame, odd: DataFrame | None = None) -> DataFrame:
    """A10/L2: documents that two evaluations of one normaliser disagree on.

    Only documents of buckets whose fingerprints differ are compared one by one; a stable
    normaliser shuffles no id. `odd` has those buckets where they are known.
    """
    if odd is None:
        odd = unstable_buckets(first, second)

    def side(df: DataFrame, sign: int) -> DataFrame:
        rows = _print_of(df).withColumn("bucket", _bucket())
        # at most STABILITY_BUCKETS rows
        return rows.join(F.broadcast(odd), "bucket", "left_semi").withColumn("sign", F.lit(sign))

    return (
        side(first, 1)
        .unionByName(side(second, -1))
        .groupBy("doc_id", "content_hash", "grounding")
        .agg(F.sum("sign").alias("balance"))
        .where(F.col("balance") != 0)
        .select("doc_id")
        .distinct()
    )


# ---------------------------------------------------------------- diff

ADDED, MODIFIED, REMOVED = "added", "modified", "removed"
UNCHANGED, IGNORED = "unchanged", "ignored_tombstone"


def diff(docs: DataFrame, mirror: DataFrame, fetched: int | None = None) -> DataFrame:
    """(doc_id, kind) for every fetched document.

    Absence never means deletion: only fetched rows are classified. Both sides are cut
    to two or three columns before the shuffle, so no text moves. A fetch known to be
    small filters the mirror in place first, so that the mirror does not move either.
    """
    now = docs.select("doc_id", "content_hash", "deleted")
    was = mirror.select("doc_id", F.col("content_hash").alias("old_hash"))
    if fetched is not None and fetched <= BROADCAST_ROWS:
        was = was.join(F.broadcast(docs.select("doc_id").distinct()), "doc_id", "left_semi")
    kind = (
        F.when(F.col("deleted") & F.col("old_hash").isNotNull(), REMOVED)
        .when(F.col("deleted"), IGNORED)
        .when(F.col("old_hash").isNull(), ADDED)
        .when(F.col("old_hash") != F.col("content_hash"), MODIFIED)
        .otherwise(UNCHANGED)
    )
    return now.join(was, "doc_id", "left").select("doc_id", kind.alias("kind"))


def change_counts(changes: DataFrame) -> DataFrame:
    """A1: documents per kind of change."""
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def run_summary(changes: DataFrame) -> DataFrame:
    """A1: one row of counts with the no-op flag; unchanged documents do not clear it."""

    def count_of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    counted = changes.agg(
        *[count_of(k).alias(k) for k in (ADDED, MODIFIED, REMOVED, UNCHANGED)]
    )
    return counted.withColumn(
        "is_noop", (F.col(ADDED) + F.col(MODIFIED) + F.col(REMOVED)) == 0
    )


def changed_ids(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("kind").isin(ADDED, MODIFIED)).select("doc_id")


def removed_ids(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("kind") == REMOVED).select("doc_id")


# ---------------------------------------------------------------- overlay and advance


def overlay(mirror: DataFrame, docs: DataFrame, fetched: int | None = None) -> DataFrame:
    """The mirror with this run's live copies in place of its own.

    A document tombstoned in this run keeps its mirror copy here.
    """
    live = docs.where(~F.col("deleted"))
    ids = guarded_broadcast(live.select("doc_id"), fetched)
    return mirror.join(ids, "doc_id", "left_anti").unionByName(live)


def advance_mirror(mirror: DataFrame, docs: DataFrame, fetched: int | None = None) -> DataFrame:
    """K1: upsert every fetched live document, unchanged ones too; drop tombstones.

    With a fetch known to be small its ids are broadcast and the mirror is rewritten
    without a shuffle; a larger fetch is joined by shuffle.
    """
    ids = guarded_broadcast(docs.select("doc_id"), fetched)
    live = docs.where(~F.col("deleted"))
    return mirror.join(ids, "doc_id", "left_anti").unionByName(live)


def run_systems(docs: DataFrame) -> DataFrame:
    """Systems named by this fetch, tombstones included."""
    return docs.select("system").distinct()


def known_paths(
    mirror: DataFrame,
    docs: DataFrame,
    systems: DataFrame,
    changes: DataFrame,
    wanted: DataFrame | None = None,
    wanted_rows: int | None = None,
) -> DataFrame:
    """Paths a link may point at once this run is published.

    A run asks about the targets of its own links only; with `wanted` the answer is cut
    to those paths before anything is shuffled.
    """
    path = identity.concept_path(F.col("doc_id")).alias("path")
    in_scope = mirror.select("doc_id", "system").join(systems, "system", "left_semi")
    live = docs.where(~F.col("deleted"))
    every = in_scope.select(path).unionByName(live.select(path))
    if wanted is not None:
        every = every.join(guarded_broadcast(wanted.select("path"), wanted_rows), "path", "left_semi")
    return every.distinct().join(removed_ids(changes).select(path), "path", "left_anti")


def removed_paths(changes: DataFrame) -> DataFrame:
    """Paths to delete, taken from the change set and from nowhere else."""
    return removed_ids(changes).select(
        identity.concept_path(F.col("doc_id")).alias("path")
    ).distinct()
